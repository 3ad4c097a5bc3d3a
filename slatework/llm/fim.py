"""Fill-in-the-middle by displacement scatter.

A text is cut twice at code points drawn from a seeded digest of its key, and written as prefix, suffix and middle
behind markers (``psm``), suffix first (``spm``), or left as it is (``plain``).  No text is cut or joined as a
string.  Over the bytes of a batch, the start of every part adds its change of displacement to a difference array,
whose running sum is how far each byte moves; one scatter then writes all outputs.  ``restore`` finds the markers
in the outputs, builds the displacements the other way and gathers.

NULL and empty texts are empty and plain, as are texts that hold a marker themselves.  NULL keys draw as the key ''.
Repeated rows give equal outputs.  A part may be empty.  Extra columns travel along as far as ``keep`` names them;
those named like an added column are replaced by it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, functions as F

from slatework.llm.common import free_of
from slatework.llm.encoding import slices

#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
FORMS = np.array(["plain", "psm", "spm"], dtype=object)
PLAIN, PSM, SPM = range(3)


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the hex sha256 of ``<seed>:<key>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(markers: Sequence[str]) -> list[bytes]:
    """The markers as bytes.  Between one ``<`` and one ``>``, they cannot arise where a marker meets a text."""
    coded = [m.encode() for m in markers]
    if len(set(coded)) != 3 or any(m[:1] != b"<" or m[-1:] != b">" or len(m) < 2 or set(m[1:-1]) & set(b"<>") for m in coded):
        raise ValueError("give three different markers like <P>, with no other angle bracket inside")
    return coded


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (with the end as a last entry)."""
    data = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    held = data.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def texts_of(raw: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    valid = None
    if missing is not None and missing.any():
        valid = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    buffers = [valid, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def _found(raw: np.ndarray, offsets: np.ndarray, markers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, marker) of every marker that lies whole within a text, by place."""
    places, kinds = [], []
    opened = np.flatnonzero(raw == ord("<"))
    for kind, marker in enumerate(markers):
        at = opened[opened + len(marker) <= len(raw)]
        for step, byte in enumerate(marker[1:], 1):
            at = at[raw[at + step] == byte]
        places.append(at)
        kinds.append(np.full(len(at), kind))
    places, kinds = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(places, kind="stable")
    places, kinds = places[order], kinds[order]
    owner = np.searchsorted(offsets, places, side="right") - 1
    sizes = np.array([len(m) for m in markers])
    whole = places + sizes[kinds] <= offsets[owner + 1]
    return owner[whole], places[whole], kinds[whole]


def _displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """How far each of ``size`` bytes moves: parts begin at ``starts`` (rising, some empty) and move by ``shifts``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change)[:size]


def scatter(raw: np.ndarray, offsets: np.ndarray, drawn: Sequence[np.ndarray], rate: int, suffix_first: int, markers: list[bytes]) -> dict[str, np.ndarray]:
    """The outputs of all texts of a batch, their offsets, forms and part sizes in code points."""
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(chars[:-1], offsets)
    n = np.diff(first)
    h1, h2, h3, h4 = drawn
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    form = np.where(h4 % 100 < suffix_first, SPM, PSM)
    form[(n == 0) | (h3 % 100 >= rate)] = PLAIN
    form[_found(raw, offsets, markers)[0]] = PLAIN
    plain, spm = form == PLAIN, form == SPM

    begin, end = offsets[:-1], offsets[1:]
    a, b = chars[first[:-1] + low], chars[first[:-1] + high]
    p, s, m = (len(x) for x in markers)
    out_offsets = np.concatenate([[0], np.cumsum(end - begin + np.where(plain, 0, p + s + m))])
    out = out_offsets[:-1]
    prefix_at = np.where(spm, out + s + (end - b) + p, out + p)
    suffix_at = np.where(spm, out + s, out + p + (a - begin) + s)
    middle_at = out + p + s + (a - begin) + (end - b) + m
    shifts = np.stack([prefix_at - begin, middle_at - a, suffix_at - b], axis=1)
    shifts[plain] = (out - begin)[plain, None]
    moved = _displaced(np.stack([begin, a, b], axis=1).ravel(), shifts.ravel(), len(raw))
    output = np.empty(out_offsets[-1], np.uint8)
    output[np.arange(len(raw)) + moved] = raw
    for marker, at in zip(markers, (prefix_at, suffix_at, middle_at)):
        for step, byte in enumerate(marker):
            output[at[~plain] - len(marker) + step] = byte
    return {"output": output, "offsets": out_offsets, "n": n, "form": form, "prefix": low, "middle": high - low, "plain": plain}


def gather(raw: np.ndarray, offsets: np.ndarray, form: np.ndarray, markers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that outputs were made from, their offsets, and which outputs are none (markers missing or out of order)."""
    owner, place, kind = _found(raw, offsets, markers)
    cut = form[owner] != PLAIN
    owner, place, kind = owner[cut], place[cut], kind[cut]
    counts = np.bincount(owner, minlength=len(form))
    bad = (form != PLAIN) & (counts != 3)
    own = ~bad[owner]
    owner, place, kind = owner[own], place[own], kind[own]
    at = np.zeros((len(form), 3), np.int64)
    order = np.full((len(form), 3), -1)
    held = np.flatnonzero((form != PLAIN) & ~bad)
    at[held], order[held] = place.reshape(-1, 3), kind.reshape(-1, 3)
    goal = np.where((form == SPM)[:, None], [1, 0, 2], [0, 1, 2])
    bad |= (form != PLAIN) & ((order != goal).any(axis=1) | (at[:, 0] != offsets[:-1]))

    begin, end = offsets[:-1], offsets[1:]
    p, s, m = (len(x) for x in markers)
    psm, spm = (form == PSM) & ~bad, (form == SPM) & ~bad
    prefix_at = np.select([psm, spm], [at[:, 0] + p, at[:, 1] + p], begin)
    suffix_at = np.select([psm, spm], [at[:, 1] + s, at[:, 0] + s], end)
    middle_at = np.where(psm | spm, at[:, 2] + m, end)
    sizes = np.stack([
        np.select([psm, spm], [at[:, 1] - prefix_at, at[:, 2] - prefix_at], end - begin),
        end - middle_at,
        np.select([psm, spm], [at[:, 2] - suffix_at, at[:, 1] - suffix_at], 0),
    ], axis=1)
    sizes[bad] = 0
    ends = np.cumsum(sizes.ravel())
    starts = ends - sizes.ravel()
    size = int(ends[-1]) if len(ends) else 0
    source = np.stack([prefix_at, middle_at, suffix_at], axis=1).ravel()
    moved = _displaced(starts, source - starts, size)
    return raw[np.arange(size) + moved], np.concatenate([[0], ends[2::3]]), bad


def _cut(text: str, keep: list[str], added: list[str], rate: int, suffix_first: int, markers: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                drawn = [batch.column(f"__h{i}").to_numpy() for i in range(4)]
                made = scatter(*flat(batch.column(text)), drawn, rate, suffix_first, markers)
                parts = [pa.array(made[x], pa.int64(), mask=made["plain"]) for x in ("prefix", "middle")]
                columns = [pa.array(made["n"], pa.int64()), pa.array(FORMS[made["form"]], pa.string()), *parts, texts_of(made["output"], made["offsets"])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *added])

    return run


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",), seed: int = 1, rate: int = 90, suffix_first: int = 20, markers: Sequence[str] = MARKERS, prefix: str = "") -> DataFrame:
    """The kept columns with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    About ``rate`` percent of the texts are cut, ``suffix_first`` percent of those in the form ``spm``.
    """
    coded = _checked(markers)
    added = [prefix + a for a in ADDED]
    keep = free_of(list(keep), added)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += ", ".join(f"`{a}` {t}" for a, t in zip(added, ("long", "string", "long", "long", "string")))
    asked = docs.select(*dict.fromkeys([*keep, text]), *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(key), seed))])
    return asked.mapInArrow(_cut(text, keep, added, rate, suffix_first, coded), schema)


def _rebuild(output: str, form: str, name: str, keep: list[str], markers: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, output):
                said = batch.column(form).to_pylist()
                known = np.array([{"plain": PLAIN, "psm": PSM, "spm": SPM}.get(f, -1) for f in said], np.int64)
                raw, offsets = flat(batch.column(output))
                texts, ends, bad = gather(raw, offsets, np.where(known < 0, PLAIN, known), markers)
                restored = texts_of(texts, ends, bad | (known < 0))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], restored], names=[*keep, name])

    return run


def restore(outputs: DataFrame, *, output: str = "output", form: str = "form", name: str = "restored", markers: Sequence[str] = MARKERS) -> DataFrame:
    """All columns with the text rebuilt from output and form; NULL where the output is not of that form."""
    coded = _checked(markers)
    keep = free_of(outputs.columns, [name])
    schema = "".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}, " for c in keep)
    return outputs.mapInArrow(_rebuild(output, form, name, keep, coded), f"{schema}`{name}` string")
