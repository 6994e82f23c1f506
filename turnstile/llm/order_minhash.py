"""Document fingerprints by Order MinHash.

A text's k-mers (`K` code points; the whole text if shorter) are numbered by occurrence, so a repeated one
counts each time. Each of `SKETCHES` hash orders picks the `TUPLE` least of them, puts them back into text
order and hashes the tuple to 16 bits. Moving a passage changes tuples though the set of k-mers stays, which
makes the share of equal entries follow edit distance rather than set overlap.

Nulls: a NULL text is an empty one; empty texts share one fingerprint. Equal texts have equal fingerprints.
Repeated rows are fingerprinted each. Result columns replace input columns of the same name. edit_report()
orders rows by id, NULL last, equal ids by their texts' hash; the order of rows equal in both does not matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import common as C

K, TUPLE, SKETCHES = 9, 2, 32
#: k-mers looked at in each order: those below a bound that lets through this many on average.
EXPECTED = 14
#: Code points taken at a time.
CHUNK = 1 << 17

_ODD = np.random.RandomState(8).randint(0, 1 << 31, SKETCHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = 0xA24BAED4963EE407
_powers = C._Powers(_BASE)


def _kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every occurrence-numbered k-mer, text after text, and len + 1 offsets."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _powers.get(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    count = np.where(size >= K, size - K + 1, (size > 0).astype(np.int64))
    start = np.cumsum(size) - size
    at = C.ranges(start, count)
    end = at + np.repeat(np.minimum(size, K), count)
    h = C.mix((total[end] - total[at]) * down[at])
    # Which k-mers stand more than once in their text, and the how-manieth each is.
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), count)
    own = C.mix(h ^ (text * np.uint64(0x9E3779B97F4A7C15)))
    order = np.sort(own)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if len(again):
        maybe = np.zeros(1 << 16, bool)
        maybe[(again >> np.uint64(48)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(own >> np.uint64(48)).astype(np.int64)])
        found = np.minimum(np.searchsorted(again, own[some]), len(again) - 1)
        some = some[again[found] == own[some]]
        rank = np.argsort(own[some], kind="stable")
        v = own[some][rank]
        head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        number = np.arange(len(v)) - np.repeat(head, np.diff(np.append(head, len(v))))
        h[some[rank]] = C.mix(h[some[rank]] + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return h, np.concatenate(([0], np.cumsum(count)))


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, SKETCHES) 16-bit entries."""
    h, off = _kmers(texts)
    n = np.diff(off)
    out = np.zeros((len(texts), SKETCHES), np.uint16)
    low = (h >> np.uint64(32)).astype(np.uint32)
    full = 0xFFFFFFFF
    bound = np.minimum(full, (EXPECTED / np.maximum(n, 1) * (full + 1))).astype(np.uint32)
    bound[n <= 2 * EXPECTED] = full
    each = np.repeat(bound, n)
    need = np.minimum(n, TUPLE)
    for i in range(SKETCHES):
        v = low * _ODD[i]
        at = np.flatnonzero(v <= each)
        text = np.searchsorted(off, at, "right") - 1
        if (short := np.flatnonzero(np.bincount(text, minlength=len(texts)) < need)).size:
            # Too few below the bound: all of these texts' k-mers are looked at.
            at = np.union1d(at, C.ranges(off[short], n[short]))
            text = np.searchsorted(off, at, "right") - 1
        order = np.lexsort((at, v[at], text))
        at, text = at[order], text[order]
        head = np.searchsorted(text, np.arange(len(texts)))
        tuples = np.zeros(len(texts), np.uint64)
        rows = np.flatnonzero(need)
        picks = np.stack([at[np.minimum(head[rows] + k, len(at) - 1)] for k in range(TUPLE)], 1) if len(rows) else np.zeros((0, TUPLE), np.int64)
        picks[need[rows, None] <= np.arange(TUPLE)] = -1
        for k, pos in enumerate(np.sort(picks, 1).T):
            tuples[rows] = C.mix(tuples[rows] * np.uint64(3) + np.where(pos >= 0, h[pos], np.uint64(k)) + np.uint64(1))
        out[:, i] = (tuples >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def _hex(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `fingerprint`, 4 hexadecimal digits for each entry."""
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c != "fingerprint"]
    schema = T.StructType([docs.schema[i] for i in keep] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.chunks(C.plain_text(batch.column(at)), CHUNK):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(_hex(fingerprints(_texts(part.column(at)))))], schema.names)

    return docs.mapInArrow(C.released(run), schema)


def _deal(heads: list[tuple[bool, int, int]]) -> Callable:
    """Each row with its range, and the first of a range also, as an extra, for the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            own = [bisect_right(heads, k) - 1 for k in keys]
            first = [i for i, (k, p) in enumerate(zip(keys, own, strict=True)) if k == heads[p]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([False] * len(own)), *batch.columns], ["p", "extra", *batch.schema.names])
            if first:
                part = batch.take(pa.array(first))
                before = [(own[i] - 1) % len(heads) for i in first]
                yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array([True] * len(first)), *part.columns], ["p", "extra", *batch.schema.names])

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist(), _texts(batch.column(6)), strict=True)

    def solve(held: list) -> pa.RecordBatch | None:
        """Rows that are followed by another of their range."""
        pairs = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][1]]
        if not pairs:
            return None
        texts, edited = [r[3] for r in held], []
        for i in pairs:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 3] + texts[i + 1][: n // 3])
        prints, changed = fingerprints(texts), fingerprints(edited)
        at = np.array(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(_hex(prints[at])),
                pa.array(_hex(changed)),
                pa.array(likeness(prints[at], changed)),
                pa.array(likeness(prints[at], prints[at + 1])),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held, size = [], 0
    for row in rows():
        held.append(row)
        size += len(row[3])
        if size >= CHUNK and len(held) > 1:
            if (out := solve(held)) is not None:
                yield out
            held = held[-1:]
            size = len(held[0][3])
    if (out := solve(held)) is not None:
        yield out


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text, whose last third begins the next document in descending order
    of the integer id_col, and against that next document. The text is shuffled once, by id range; the row
    that follows a range is the first of the next one, which is dealt to both."""
    p = C.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.expr(f"coalesce(~cast(`{id_col}` as bigint), 0L)").alias("o"), F.xxhash64(text_col).alias("h"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Several ranges for each partition: hashed, they fill partitions more evenly.
    keys = rows.select("none", "o", "h").repartitionByRange(4 * p, "none", "o", "h")
    first = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "o", "h")).alias("k"))
    heads = sorted((r.k.none, r.k.o, r.k.h) for r in first.collect())  # one for each range
    shape = "none boolean, o long, h long, id long, text string"
    dealt = rows.mapInArrow(C.released(_deal(heads)), f"p int, extra boolean, {shape}").repartition(p, "p").sortWithinPartitions("p", "extra", "none", "o", "h")
    out = dealt.mapInArrow(C.released(_report), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
