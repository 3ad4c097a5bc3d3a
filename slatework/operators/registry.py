"""Name registry, resolution ladder, audits and review workflow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slatework.functions.names import clean_source_name, name_parts, normalize_name
from slatework.operators.aggregates import joined_values
from slatework.operators.joins import mentions
from slatework.operators.ordering import join_on, top_rows, with_positions
from slatework.operators.similarity import similar_pairs
from slatework.operators.stints import known_teams
from slatework.session import settle

REVIEW_TYPES = ("fuzzy_same_last_name", "first_initial_last", "unique_last_name")


def title_name(value: Column | str) -> Column:
    return F.initcap(normalize_name(value))


def seed_registry(people: DataFrame, *, name: str, person_id: str) -> DataFrame:
    """People table -> registry rows, one per canonical name (lowest id wins)."""
    seeded = people.select(title_name(name).alias("canonical_name"), F.col(person_id).alias("mlb_id")).where("canonical_name <> ''")
    seeded = top_rows(seeded, ["canonical_name"], [F.col("mlb_id").asc_nulls_last()])
    return seeded.withColumn("aliases", F.array().cast("array<string>")).withColumns(name_parts("canonical_name"))


def registry_keys(registry: DataFrame) -> DataFrame:
    """Every normalized spelling of every entry: (key, canonical_name, is_canonical)."""
    spellings = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = registry.select("canonical_name", F.explode(spellings).alias("__spelling"))
    rows = rows.select("canonical_name", normalize_name("__spelling").alias("key"))
    rows = rows.withColumn("is_canonical", F.col("key") == normalize_name("canonical_name"))
    return rows.where("key <> ''").distinct()


def name_map(registry: DataFrame) -> DataFrame:
    """Spelling -> canonical name, plus 'last_<surname>' for surnames only one entry has.

    Of several entries with one spelling the canonical owner wins, then the first name in order.
    """
    keys = registry_keys(registry)
    spelled = keys.groupBy("key").agg(F.min(F.struct(~F.col("is_canonical"), "canonical_name"))["canonical_name"].alias("canonical_name"))
    last = registry.select(normalize_name("last_name").alias("__last"), "canonical_name").where("__last <> ''")
    unique = last.groupBy("__last").agg(F.count(F.lit(1)).alias("__n"), F.min("canonical_name").alias("canonical_name")).where("__n = 1")
    return spelled.unionByName(unique.select(F.concat(F.lit("last_"), "__last").alias("key"), "canonical_name"))


def resolve_names(names: DataFrame, registry: DataFrame, *, raw: str, fuzzy: bool = True, minimum: float = 96.0, margin: float = 3.0) -> DataFrame:
    """Resolve each distinct raw name to a registry entry.

    Tiers: exact canonical, exact alias, the only entry with the surname, the only one with surname and
    first name, the only one with surname and initial, then a near-identical spelling among entries of the
    surname that beats the next one by ``margin``.  Otherwise ambiguous, unresolved or empty.

    Every tier is an equi join on a key that the registry side holds once (a count and one name), so a
    surname shared by many entries is never multiplied out.
    """
    wanted = names.select(raw).distinct().withColumn("normalized_name", normalize_name(raw))
    parts = name_parts("normalized_name")
    wanted = wanted.withColumns({"__last": parts["last_name"], "__first": parts["first_name"], "__initial": parts["first_initial"]})

    exact = registry_keys(registry).groupBy(F.col("key").alias("normalized_name")).agg(
        F.min(F.when(F.col("is_canonical"), F.col("canonical_name"))).alias("__canonical"),
        F.min(F.when(~F.col("is_canonical"), F.col("canonical_name"))).alias("__alias"),
        F.count(F.lit(1)).alias("__exact_n"),
    )
    entries = registry.select(
        "canonical_name",
        normalize_name("last_name").alias("__last"),
        normalize_name("first_name").alias("__first"),
        normalize_name("first_initial").alias("__initial"),
    ).where("__last <> ''")

    def only(keys: Sequence[str], tag: str) -> DataFrame:
        return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__{tag}_n"), F.min("canonical_name").alias(f"__{tag}"))

    found = (
        wanted.join(exact, "normalized_name", "left")
        .join(only(["__last"], "surname"), "__last", "left")
        .join(only(["__last", "__first"], "firstlast"), ["__last", "__first"], "left")
        .join(only(["__last", "__initial"], "initial_last"), ["__last", "__initial"], "left")
    )
    tiers = [
        ("exact_canonical", F.col("__canonical"), F.col("__canonical").isNotNull()),
        ("exact_alias", F.col("__alias"), F.col("__alias").isNotNull()),
        ("unique_last_name", F.col("__surname"), F.col("__surname_n") == 1),
        ("exact_first_last", F.col("__firstlast"), (F.col("__surname_n") > 1) & (F.col("__firstlast_n") == 1)),
        ("first_initial_last", F.col("__initial_last"), (F.col("__surname_n") > 1) & (F.col("__initial_last_n") == 1)),
    ]
    kind, chosen = F.when(F.col("normalized_name") == "", "empty"), F.when(F.col("normalized_name") == "", None)
    for label, value, holds in tiers:
        kind, chosen = kind.when(holds, label), chosen.when(holds, value)
    found = found.withColumns({"match_type": kind, "__chosen": chosen})

    if fuzzy:
        rest = found.where("match_type is null and __surname_n > 1").select("__last", F.col("normalized_name").alias("__want")).distinct()
        spellings = registry_keys(registry).join(entries.select("canonical_name", "__last").distinct(), "canonical_name")
        pairs = similar_pairs(rest, spellings, left_text="__want", right_text="key", threshold=minimum - margin, within=["__last"])
        scored = pairs.join(spellings.select("__last", "key", "canonical_name"), ["__last", "key"]).groupBy("__want", "canonical_name").agg(
            F.max("similarity").alias("__score")
        )
        best = top_rows(scored, ["__want"], [F.col("__score").desc(), F.col("canonical_name").desc()], 2, rank="__r").groupBy("__want").agg(
            F.max(F.when(F.col("__r") == 1, F.col("canonical_name"))).alias("__near"),
            F.max(F.when(F.col("__r") == 1, F.col("__score"))).alias("__top"),
            F.max(F.when(F.col("__r") == 2, F.col("__score"))).alias("__next"),
        )
        # Spellings below minimum - margin are not fetched: they are too far behind to matter.
        clear = (F.col("__top") >= minimum - 1e-9) & (F.col("__next").isNull() | (F.col("__top") - F.col("__next") >= margin - 1e-9))
        best = best.where(clear).select(F.col("__want").alias("normalized_name"), "__near")
        found = found.join(best, "normalized_name", "left").withColumns(
            {
                "__chosen": F.when(F.col("match_type").isNull(), F.col("__near")).otherwise(F.col("__chosen")),
                "match_type": F.when(F.col("match_type").isNull() & F.col("__near").isNotNull(), "fuzzy_same_last_name").otherwise(F.col("match_type")),
            }
        )
    matched = F.col("__chosen").isNotNull()
    candidates = F.when(F.col("normalized_name") == "", 0).otherwise(F.coalesce("__exact_n", "__surname_n", F.lit(0)))
    ambiguous = F.col("match_type").isNull() & (F.col("__surname_n") > 1)
    return found.select(
        raw,
        "normalized_name",
        F.coalesce("__chosen", "normalized_name").alias("canonical_name"),
        matched.alias("matched"),
        F.coalesce("match_type", F.when(ambiguous, "ambiguous_last_name").otherwise("unresolved")).alias("match_type"),
        F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"),
        candidates.cast("long").alias("candidate_count"),
    )


def canonical_names(sources: Sequence[tuple[DataFrame, str]], registry: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """(raw_name, canonical_name) for the distinct names of several (table, column) sources, resolved once.

    The distinct names and their resolution are written out: every table that needs canonical names then
    joins this map instead of running the ladder again.  All sources go through one ``distinct``: with one of its own for each,
    a task would hold the names of its share once per source.
    """
    distinct = reduce(DataFrame.unionByName, [df.select(F.col(column).alias("raw_name")).where("raw_name is not null") for df, column in sources]).distinct()
    return settle(resolve_names(settle(distinct), registry, raw="raw_name", fuzzy=fuzzy).select("raw_name", "canonical_name"))


def with_canonical(df: DataFrame, canonical: DataFrame, *, raw: str, name: str) -> DataFrame:
    """Attach the canonical name from a ``canonical_names`` map."""
    return df.join(canonical.select(F.col("raw_name").alias(raw), F.col("canonical_name").alias(name)), raw, "left")


def observed_team_rows(events: DataFrame, *, raw: str, half: str, home: str, away: str) -> DataFrame:
    """(raw, team, events): one row for every team a raw name batted for, however many those are."""
    team = F.when(F.col(half).ilike("Bottom%"), F.col(home)).otherwise(F.col(away))
    seen = events.where(F.coalesce(F.col(raw), F.lit("")) != "").select(raw, team.alias("team"))
    return seen.where("team is not null").groupBy(raw, "team").agg(F.count(F.lit(1)).alias("events"))


def observed_teams(events: DataFrame, *, raw: str, half: str, home: str, away: str) -> DataFrame:
    """Teams a raw name batted for, as 'A|B', where a name has few teams; ``observed_team_rows`` has no such bound."""
    return joined_values(observed_team_rows(events, raw=raw, half=half, home=home, away=away), keys=[raw], value="team", name="observed_teams")


def transaction_teams(transactions: DataFrame, registry: DataFrame, *, text: str, team: str) -> DataFrame:
    """Teams whose transaction texts name a registry entry, as 'A|B' per canonical name."""
    lines = transactions.where(F.col(team).isNotNull() & F.col(text).isNotNull()).select(normalize_name(text).alias("__line"), team)
    people = registry.select("canonical_name", normalize_name("canonical_name").alias("__name")).where("__name <> ''")
    found = mentions(lines, people, text="__line", name="__name").distinct()
    return joined_values(found.join(people, "__name"), keys=["canonical_name"], value=team, name="transaction_teams")


def transaction_moves(transactions: DataFrame, registry: DataFrame, *, text: str, team: str, date: str) -> DataFrame:
    """(canonical_name, team, date) for every registry entry that a dated transaction text names.

    A text is read once, however many transactions share it: the distinct texts are written before their words are taken.
    """
    lines = transactions.where(F.col(team).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("__text"), team, date)
    read = settle(lines.select("__text").distinct()).withColumn("__line", normalize_name("__text"))
    people = registry.select("canonical_name", normalize_name("canonical_name").alias("__name")).where("__name <> ''")
    named = mentions(read, people, text="__line", name="__name").join(people, "__name").select("__text", "canonical_name").distinct()
    return lines.join(named, "__text").select("canonical_name", team, date).distinct()


def _team_set(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    teams = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(teams, lambda t: t != "")


def _blank(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def team_validation(source: Column | str, player_team: Column | str, observed: Column | str, event_source: str = "play_by_play_plays") -> Column:
    source, player_team = (F.col(c) if isinstance(c, str) else c for c in (source, player_team))
    return (
        F.when(source != event_source, "not_available")
        .when(_blank(observed), "no_observed_team")
        .when(_blank(player_team), "no_player_team")
        .when(F.array_contains(_team_set(observed), F.trim(player_team)), "team_match")
        .otherwise("team_mismatch")
    )


def historical_team_validation(observed: Column | str, roster: Column | str, transactions: Column | str) -> Column:
    seen, on_roster, traded = _team_set(observed), _team_set(roster), _team_set(transactions)
    return (
        F.when(_blank(observed), "no_observed_team")
        .when(F.arrays_overlap(seen, on_roster), "official_roster_match")
        .when(F.arrays_overlap(seen, traded), "official_transaction_match")
        .when((F.size(on_roster) > 0) | (F.size(traded) > 0), "official_history_mismatch")
        .otherwise("no_official_history")
    )


def slate_team_validation(team: Column | str, current: Column | str, roster: Column | str, transactions: Column | str) -> Column:
    team, current = (F.col(c) if isinstance(c, str) else c for c in (team, current))
    past = F.array_union(_team_set(roster), _team_set(transactions))
    has_team, has_current, was_there = ~_blank(team), ~_blank(current), F.array_contains(past, team)
    return (
        F.when(has_team & has_current & (team == current), "current_team_match")
        .when(has_team & was_there, "historical_team_match")
        .when(has_team & has_current, "possible_team_mismatch")
        .otherwise("unknown")
    )


def review_status(source: Column | str, raw: Column | str, cleaned: Column | str, matched: Column | str, match_type: Column | str, validation: Column | str, event_source: str = "play_by_play_plays") -> Column:
    source, raw, cleaned, matched, match_type, validation = (
        F.col(c) if isinstance(c, str) else c for c in (source, raw, cleaned, matched, match_type, validation)
    )
    return (
        F.when(~matched, "pending")
        .when(validation == "team_mismatch", "pending_review")
        .when(match_type.isin(*REVIEW_TYPES), "pending_review")
        .when(F.size(F.split(F.trim(cleaned), r"\s+")) == 1, "pending_review")
        .when((source == event_source) & (cleaned != raw), "pending_review")
        .otherwise("auto_matched")
    )


def audit_source(names: DataFrame, registry: DataFrame, people: DataFrame, *, source: str, raw: str, person: str, team: str, observed: DataFrame | None = None, event_source: str = "play_by_play_plays", fuzzy: bool = True) -> DataFrame:
    """One audit row per distinct raw name of a source: proposal, team check and review status."""
    # Written before they are cleaned: filters on cleaned names would otherwise be pushed to every event row.
    distinct = settle(names.select(raw).where(F.coalesce(F.col(raw), F.lit("")) != "").distinct())
    distinct = distinct.withColumn("cleaned_name", clean_source_name(raw, from_plays=source == event_source))
    resolved = resolve_names(distinct, registry, raw="cleaned_name", fuzzy=fuzzy)
    joined = distinct.join(resolved, "cleaned_name")
    teams = top_rows(people.select(title_name(person).alias("canonical_name"), F.col(team).alias("player_team")), ["canonical_name"], [F.col("player_team").asc_nulls_last()])
    joined = joined.join(teams, "canonical_name", "left")
    joined = joined.join(observed, raw, "left") if observed is not None else joined.withColumn("observed_teams", F.lit(None).cast("string"))
    audit = joined.withColumns({"source_table": F.lit(source), "team_validation": team_validation(F.lit(source), "player_team", "observed_teams", event_source)})
    return audit.withColumn(
        "review_status", review_status("source_table", raw, "cleaned_name", "matched", "match_type", "team_validation", event_source)
    )


def with_team_history(audit: DataFrame, seen: DataFrame, *, roster: DataFrame, moves: DataFrame, raw: str, date: str, team: str = "team") -> DataFrame:
    """Audit rows with the official teams of their proposed entry on the days the raw name was seen, and what they say.

    ``seen`` holds (raw, date); ``roster`` and ``moves`` are stints by canonical name.
    """
    audit = settle(audit)
    days = settle(seen.select(raw, date).join(audit.select(raw, "canonical_name"), raw))
    for stints, name in ((roster, "official_roster_teams"), (moves, "official_transaction_teams")):
        audit = audit.join(known_teams(days, stints, key=raw, person="canonical_name", team=team, date=date, name=name), raw, "left")
    return audit.withColumn("historical_team_validation", historical_team_validation("observed_teams", "official_roster_teams", "official_transaction_teams"))


def apply_decisions(audit: DataFrame, decisions: DataFrame, *, keys: Sequence[str], status: str = "review_status") -> DataFrame:
    """Audit with the status of each decided key replaced (bulk review)."""
    decided = decisions.select(*keys, F.col(status).alias("__status"))
    return audit.join(decided, list(keys), "left").withColumn(status, F.coalesce("__status", status)).select(*audit.columns)


def decision_effect(audit: DataFrame, decisions: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Dry run: how many audit rows each decided key would change."""
    return audit.join(decisions.select(*keys).distinct(), list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("affected_rows"))


def apply_aliases(registry: DataFrame, audit: DataFrame, *, alias: str = "alias_to_apply") -> DataFrame:
    """Registry with the approved aliases added and unknown canonical names inserted.

    An alias is added once per normalized spelling and not if the entry already has it, raw or normalized.
    Rows matched automatically but for the wrong team are skipped.  The changes are found by joins on
    (canonical name, spelling); the registry's arrays are only touched to append what is new.
    """
    ready = audit.where(
        F.col("review_status").isin("approved", "auto_matched")
        & ~((F.col("review_status") == "auto_matched") & (F.coalesce("team_validation", F.lit("")) == "team_mismatch"))
    )
    wanted = ready.select("canonical_name", F.col(alias).alias("__alias"), normalize_name(alias).alias("key")).where("key <> ''")
    wanted = top_rows(wanted, ["canonical_name", "key"], [F.col("__alias")])
    held = registry.select("canonical_name", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("__a")).select("canonical_name", normalize_name("__a").alias("key")).distinct()
    known = wanted.join(registry.select("canonical_name"), "canonical_name", "left_semi")
    new = known.join(held, ["canonical_name", "key"], "left_anti").groupBy("canonical_name").agg(F.sort_array(F.collect_list("__alias")).alias("__new"))
    grown = registry.join(new, "canonical_name", "left").withColumn(
        "aliases", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("__new", F.array().cast("array<string>")))
    ).select(*registry.columns)
    unknown = wanted.join(registry.select("canonical_name"), "canonical_name", "left_anti").select(title_name("__alias").alias("canonical_name"), "__alias")
    unknown = top_rows(unknown, ["canonical_name"], [F.col("__alias")]).join(registry.select("canonical_name"), "canonical_name", "left_anti")
    inserted = unknown.withColumns({"aliases": F.array("__alias"), **name_parts("canonical_name")}).drop("__alias")
    return grown.unionByName(inserted, allowMissingColumns=True)


PENDING = ("pending", "pending_review")
HISTORY = ("official_roster_teams", "official_transaction_teams", "historical_team_validation")


def _evidence(resolutions: DataFrame) -> DataFrame:
    return resolutions.select("source_table", "raw_name", *[c for c in ("normalized_name", "candidate_count", "candidates", "ambiguous") if c in resolutions.columns])


def pending_list(aliases: DataFrame, resolutions: DataFrame, *, source: str | None = None) -> DataFrame:
    """Every pending alias row with its resolution's evidence, in the order a reviewer's CSV lists them (``place`` from 0)."""
    rows = aliases.where(F.col("review_status").isin(*PENDING))
    if source is not None:
        rows = rows.where(F.col("source_table") == source)
    named = ["source_table", "raw_name", "alias_to_apply", "proposed_canonical_name", "proposed_match_type", "review_status"]
    listed = rows.select(*named).join(_evidence(resolutions), ["source_table", "raw_name"], "left")
    return with_positions(listed, [], [F.col("source_table"), F.col("alias_to_apply"), F.col("raw_name"), F.col("proposed_canonical_name")], position="place").drop("group_rows")


def pending_groups(aliases: DataFrame, resolutions: DataFrame, *, samples: int = 20, people: DataFrame | None = None, person: str = "full_name", details: Sequence[str] = ("team_code",)) -> DataFrame:
    """Pending alias rows grouped by proposal, with the count of all variants, the first ``samples`` of their distinct
    raw names, the resolution's evidence, what is known of teams, and the proposed person's details.

    Columns that ``aliases`` or ``resolutions`` lack are left out.  ``place`` is the order of the review list: by source, largest first.
    """
    rows = aliases.where(F.col("review_status").isin(*PENDING)).join(_evidence(resolutions), ["source_table", "raw_name"], "left")
    keys = ["source_table", "alias_to_apply", "proposed_canonical_name", "proposed_match_type", "review_status"]
    names = joined_values(rows, keys=keys, value="raw_name", separator=" || ", name="raw_name_samples", most=samples)
    most = [c for c in ("observed_teams", "team_validation", *HISTORY, "candidate_count", "candidates") if c in rows.columns]
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_variant_count"), F.max(F.col("ambiguous").cast("int")).alias("ambiguous_flag"), *[F.max(c).alias(c) for c in most]
    )
    out = join_on(grouped, names, keys, "left").withColumn("raw_name_samples", F.coalesce("raw_name_samples", F.lit("")))
    if people is not None:
        first = top_rows(people.where(F.col(person).isNotNull()).select(F.col(person).alias("proposed_canonical_name"), *details), ["proposed_canonical_name"], [F.col(d).asc_nulls_last() for d in details])
        out = out.join(first, "proposed_canonical_name", "left")
    order = [F.col("source_table"), F.col("raw_variant_count").desc(), *[F.col(c) for c in keys[1:]]]
    return with_positions(out, [], order, position="place").drop("group_rows")


# Order in which team problems are listed.
GAP_ORDER = {"team_mismatch": 1, "no_player_team": 2, "no_observed_team": 3}


def gap_priority(validation: Column | str) -> Column:
    validation, chain = F.col(validation) if isinstance(validation, str) else validation, F
    for label, place in GAP_ORDER.items():
        chain = chain.when(validation == label, F.lit(place))
    return chain.otherwise(F.lit(4))


def failed_predictions(results: DataFrame, picks: DataFrame, *, on: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Predicted strikeouts that ended in a hit or home run."""
    joined = results.join(picks, list(on))
    wrong = (F.col(predicted).ilike("%strikeout%") | (F.col(predicted) == "SO")) & (
        F.col(actual).ilike("%hit%") | F.col(actual).ilike("%home run%")
    )
    return joined.where(wrong)


def factor_or_default(df: DataFrame, factors: DataFrame, *, key: str, factor: str, constants: dict[str, float], use_table: bool = True, default: float = 1.0, name: str = "park_factor") -> DataFrame:
    """Per-key factor from a table, for keys it lacks from constants, else the default.

    A caller who distrusts a small table passes ``use_table=False``.
    """
    usable = factors.where(F.col(key).isNotNull() & F.col(factor).isNotNull())
    table = F.create_map(*[F.lit(x) for pair in constants.items() for x in pair])
    constant = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(float(default))) if constants else F.lit(float(default))
    if not use_table:
        return df.withColumn(name, constant)
    one = top_rows(usable.select(key, F.col(factor).alias("__f")), [key], [F.col("__f")])
    return df.join(one, key, "left").withColumn(name, F.coalesce("__f", constant)).drop("__f")
