"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slatework.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def vocabulary() -> dict[str, str]:
    """The byte-level vocabulary's files, as the installed package places them."""
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@query("op8_squares_packing")
def squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.packing_squares import pack

    return pack(table(spark, folder, "documents"), **vocabulary())


@query("op2_sharding")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.sharding import shard, winning_shard

    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    docs = table(spark, folder, "documents").select("doc_id", "text")
    placed = shard(docs, size=size)
    return placed.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", winning_shard(F.col("doc_id"), 17, 17).alias("grown_shard"),
    )


@query("op10_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.common import crc_share
    from slatework.llm.language import detect, fit

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_share("doc_id", 3) != 1))
    found = detect(docs, model)
    return found.select("doc_id", (crc_share("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.common import crc_share
    from slatework.llm.toxicity import fit, score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels").where(crc_share("doc_id", 5) != 0))
    held_out = (crc_share("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted", "plain_hits", "misspelt_hits", "quoted_hits")


@query("op6_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.quality_mcd import STATS, judge

    judged = judge(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *STATS, "base_failed", "kept", "distance")


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""


@query("op1_minhash_dedup", NEAR_DUPLICATES_SQL)
def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.minhash import near_duplicates

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


NEAR_VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON e.vec_id = c.a
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a
"""


@query("op5_vector_forest", NEAR_VECTORS_SQL)
def vector_forest(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.vector_forest import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


#: Shares of the tokens that well-rated and poorly rated text shall have.
MIXTURE = {"good": 0.95, "poor": 0.05}


def rated() -> Column:
    return F.when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("poor"))


@query("op3_mixing")
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.mixing import mix

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return mix(docs, table(spark, folder, "labels"), MIXTURE, domain=rated())


CHAT_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS said
  FROM turns GROUP BY conv_id),
alone AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY said, n_turns),
prefixes AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole))
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_copies,
       array_to_string(list_transform(said, lambda x:
         '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text
FROM alone WHERE said NOT IN (SELECT said FROM prefixes)
"""


@query("op4_chat", CHAT_SQL)
def chat(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.chat import render

    return render(table(spark, folder, "conversations"))


@query("op9_token_matrices")
def token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.packing_ids import pack_ids

    packed = pack_ids(table(spark, folder, "documents"), **vocabulary())
    return packed.select(
        "sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", F.crc32("positions").alias("positions_crc32"), "doc_ids", "starts"
    )


RESAMPLING_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM split),
crcs AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM runs), bits),
placed AS (SELECT side, id, bucket FROM runs JOIN crcs USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS gain FROM counts),
weights AS (SELECT id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM (SELECT id AS doc_id, w FROM split WHERE side = 'd') LEFT JOIN weights ON doc_id = id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS of FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * of // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op11_resampling", RESAMPLING_SQL)
def resampling(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.importance import resample

    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


FILL_IN_MIDDLE_SQL = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS p4 FROM given),
cut AS (
  SELECT doc_id, n, text, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p3 >= 90 THEN 'plain'
              WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
                        ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query("op12_fill_in_middle", FILL_IN_MIDDLE_SQL)
def filled_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from slatework.llm.fim import fill_in_middle, restore

    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = restore(fill_in_middle(docs))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


WARC_SQL = """
WITH given AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
told AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM given),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM told WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM told LEFT JOIN firsts USING (payload_digest)
"""


@query("op13_warc", WARC_SQL)
def warc(spark: SparkSession, folder: str) -> DataFrame:
    import uuid

    from slatework.llm.warc import read_records, with_full_payload, write_archives
    from slatework.session import scratch_folder

    pages = table(spark, folder, "pages")
    archives = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, archives)
    values = {"payload_bytes": "CAST(octet_length(payload) AS LONG)", "digest": "sha2(payload, 256)"}
    read = with_full_payload(read_records(index, archives), values)
    kind = pages.schema["page_id"].dataType
    ids = [F.col(c).cast(kind).alias(c) for c in ("page_id", "refers_to")]
    return read.select(ids[0], "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", ids[1])
