"""Removal of repeated passages by super-k-mers.

A window is `WINDOW` consecutive words of one text. Its minimiser is the least hash among its 5-word
sequences, so equal windows have equal minimisers; consecutive windows with one minimiser travel as one
packed string of words to the minimiser's bucket. Of the equal strings that a task gathers one travels, with
their number, so a bucket holds distinct strings however often a passage stands in the corpus. It counts its
windows exactly: the windows of the strings are sorted by a 64-bit hash and equal hashes are compared word by
word. The runs of repeated windows of a string go to the places where it stands by a join on the string's
digest, which may be split; only places whose digest may have runs are shuffled.

Sequences that open more than one super-k-mer in two thousand (frequent lines) are taken as minimisers
only by windows that hold nothing else, so that a common line with many neighbours does not fill one
bucket; that list has at most 2,000 entries and changes the order of minimisers, never a result. Equal
texts meet their ranges once per packed block.

Nulls: a NULL text has no words and stays NULL. A text shorter than the window keeps all its words.
Repeated rows are texts that repeat each other. Result columns replace input columns of the same name;
all other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import common as C

WINDOW, SEED_WORDS = 35, 5
HOT_SHARE = 1000
#: Raw bytes that a task gathers before it packs them by bucket, and that a bucket unpacks at a time.
GATHER, UNPACK = 24 << 20, 16 << 20
KEY = 12


def _keys(texts: pa.Array) -> list[bytes]:
    return [hashlib.md5(x.as_buffer() if x.as_buffer() is not None else b"").digest()[:KEY] for x in texts]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _super_kmers(w: C.Words, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, minimiser) of every super-k-mer."""
    g = C.grams(w.hashes(), SEED_WORDS)
    rank = g >> np.uint64(1)
    if len(hot) and len(g):
        at = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
        rank = rank | ((hot[at] == rank).astype(np.uint64) << np.uint64(63))
    windows = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = _least(rank, WINDOW - SEED_WORDS + 1)
    idx = C.ranges(w.first[:-1], windows)
    text = np.repeat(np.arange(len(windows)), windows)
    v = least[idx]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], idx[at], np.diff(np.append(at, len(v))), v[at]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of text: minimisers with a share of 1 / HOT_SHARE or more; the first row has the total."""
    for batch in batches:
        text = C.plain_text(batch.column(0))
        for a, b in C.chunks(text):
            v = _super_kmers(C.Words(text.slice(a, b - a)), np.zeros(0, np.uint64))[3]
            key, count = np.unique(v, return_counts=True)
            much = (count >= 2) & (count * HOT_SHARE >= len(v))
            out = [pa.array(np.append(key[much], np.uint64(0)).view(np.int64)), pa.array(np.append(count[much], 0)), pa.array([0] * int(much.sum()) + [len(v)])]
            yield pa.RecordBatch.from_arrays(out, ["v", "c", "total"])


def frequent_seeds(texts: DataFrame) -> np.ndarray:
    found = C.store(texts.mapInArrow(C.released(_frequent), "v long, c long, total long"), "frequent")
    total = found.agg(F.sum("total")).first()[0] or 0
    # The counts of all kept values add up to no more than the total: at most 2 * HOT_SHARE rows.
    rows = found.groupBy("v").agg(F.sum("c").alias("c")).where((F.col("c") > 0) & (F.col("c") * 2 * HOT_SHARE >= total)).collect()
    return np.sort(np.array([r.v for r in rows], np.int64).view(np.uint64))


def _join(w: C.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept words of each text joined by single spaces: bytes, text offsets, and each kept word's start."""
    length = (w.end - w.begin)[keep]
    count = np.add.reduceat(np.append(keep, False).astype(np.int64), w.first)[:-1] if len(keep) else np.zeros(len(w.first) - 1, np.int64)
    count[np.diff(w.first) == 0] = 0
    first = np.zeros(len(length), bool)
    starts = np.concatenate(([0], np.cumsum(count)))
    first[starts[:-1][count > 0]] = True
    end = np.cumsum(length + ~first)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    solid = np.ones(len(out), bool)
    solid[(end - length - 1)[~first]] = False
    out[solid] = w.buf[w.is_word][np.repeat(keep, w.end - w.begin)]
    return out, np.concatenate(([0], end))[starts], end - length


def _strings(texts: pa.Array, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, first word in it, minimiser) of every super-k-mer of some texts, and its packed string."""
    w = C.Words(texts)
    t, i, n, v = _super_kmers(w, hot)
    if not len(t):
        return t, i, v, []
    flat, _, at = _join(w, np.ones(len(w.begin), bool))
    data, last = flat.tobytes(), i + n + WINDOW - 2
    stop = at[last] + (w.end - w.begin)[last]
    return t, i - w.first[t], v, [data[x:y] for x, y in zip(at[i].tolist(), stop.tolist(), strict=True)]


def _digests(strings: list[bytes]) -> np.ndarray:
    """Two longs for each string."""
    return np.frombuffer(b"".join(hashlib.md5(x).digest() for x in strings), "<i8").reshape(-1, 2)


def _pack(buckets: int, hot: np.ndarray) -> Callable:
    def flush(rows):
        strings = pa.array([x for r in rows for x in r[3]], pa.binary()).dictionary_encode()  # equal ones once, with their number
        code = strings.indices.to_numpy()
        first = np.unique(code, return_index=True)[1]
        count = np.bincount(code, np.concatenate([r[2] for r in rows])).astype(np.int64)
        bucket, sub = (np.concatenate([r[i] for r in rows])[first] for i in (0, 1))
        order = np.argsort(bucket, kind="stable")
        bucket, sub, count = bucket[order], sub[order], count[order]
        strings, order = strings.dictionary.to_pylist(), order.tolist()
        cut = np.flatnonzero(np.diff(bucket)) + 1
        zip_ = zstandard.ZstdCompressor(level=5)
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            out.append(zip_.compress(pickle.dumps((sub[a:b], count[a:b], b"\n".join(strings[i] for i in order[a:b])), 5)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate(([0], cut))].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            text = C.plain_text(batch.column(0))
            for a, b in C.chunks(text):
                part = text.slice(a, b - a).dictionary_encode()  # equal texts once, with their number
                copies = np.bincount(part.indices.to_numpy(), minlength=len(part.dictionary))
                t, _, v, strings = _strings(part.dictionary, hot)
                if not len(t):
                    continue
                rows.append(((v % np.uint64(buckets)).astype(np.int64), (v >> np.uint64(40)).astype(np.uint16), copies[t], strings))
                size += sum(map(len, strings))
                if size >= GATHER:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return run


def _places(groups: int, hot: np.ndarray) -> Callable:
    """Every place of a super-k-mer: the digest (x, y) of its string, the group and key of the text, the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = C.plain_text(batch.column(0))
            for a, b in C.chunks(text):
                texts = text.slice(a, b - a).unique()
                t, start, _, strings = _strings(texts, hot)
                if not len(t):
                    continue
                keys = _keys(texts)
                group = np.array([int.from_bytes(k[:4], "little") % groups for k in keys], np.int32)
                d = _digests(strings)
                columns = [np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), group[t]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(keys, pa.binary()).take(pa.array(t)), pa.array(start.astype(np.int32))], ["x", "y", "g", "k", "f"])

    return run


def _repeated(packed: pa.Array, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window in it) of the windows found twice or more among distinct strings with copies."""
    w = C.Words(packed)
    windows = np.diff(w.first) - WINDOW + 1
    idx = C.ranges(w.first[:-1], windows)
    owner = np.repeat(np.arange(len(windows)), windows)
    key = C.grams(w.hashes(), WINDOW)[idx]
    order = np.argsort(key, kind="stable")
    weight = copies[owner][order]
    head = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    size = np.diff(np.append(head, len(order)))
    total = np.add.reduceat(weight, head)
    again = np.repeat(total >= 2, size)
    # Equal hashes of different positions: compare the words themselves.
    data, begin, end = w.buf.tobytes(), w.begin, w.end
    for h, n in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        at = idx[order[h : h + n]]
        texts = [data[x:y] for x, y in zip(begin[at].tolist(), end[at + WINDOW - 1].tolist(), strict=True)]
        if texts.count(texts[0]) != n:
            each: dict[bytes, int] = defaultdict(int)
            for x, c in zip(texts, weight[h : h + n].tolist(), strict=True):
                each[x] += c
            again[h : h + n] = [each[x] >= 2 for x in texts]
    hit = np.sort(order[again])
    return owner[hit], (idx - w.first[owner])[hit]


def _count() -> Callable:
    """Runs of repeated windows (first and last) in each distinct packed string, by its digest."""

    def solve(payloads: list[bytes], raw: int) -> Iterator[pa.RecordBatch]:
        parts = raw // UNPACK + 1
        for part in range(parts):
            copies: dict[bytes, int] = defaultdict(int)
            for p in payloads:
                sub, count, blob = pickle.loads(zstandard.ZstdDecompressor().decompress(p))
                own, use = blob.split(b"\n"), np.flatnonzero(sub % parts == part)
                for i, c in zip(use.tolist(), count[use].tolist(), strict=True):
                    copies[own[i]] += c
            if not copies:
                continue
            strings = list(copies)
            owner, window = _repeated(pa.array(strings, pa.large_binary()).view(pa.large_string()), np.array(list(copies.values()), np.int64))
            if not len(owner):
                continue
            new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(window) != 1)))
            lo, hi, own = window[new], window[np.append(new[1:], True)], owner[new]
            d = _digests([strings[i] for i in own.tolist()])
            columns = [np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), lo.astype(np.int32), hi.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["x", "y", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield from solve(held, size)
                    held, size = [], 0
                now = bucket
                held.append(payload.as_py())
                size += zstandard.frame_content_size(held[-1])
        if held:
            yield from solve(held, size)

    return run


def _block(text_at: int, groups: int) -> Callable:
    """Rows of the table as compressed blocks by group of their text's key."""

    def flush(tables: list[pa.Table], group: list[np.ndarray]) -> pa.RecordBatch:
        table, g = pa.concat_tables(tables), np.concatenate(group)
        order = np.argsort(g, kind="stable")
        table, g = table.take(pa.array(order)).combine_chunks(), g[order]
        cut = np.flatnonzero(np.diff(g)) + 1
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
            part = table.slice(a, b - a)
            part = part.set_column(text_at, part.schema.names[text_at], part.column(text_at).combine_chunks().dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as s:
                s.write_table(part)
            out.append(zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array(g[np.concatenate(([0], cut))].astype(np.int32)), pa.array([1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(out, pa.binary())], ["g", "kind", "k", "f", "t", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, group, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            d = C.plain_text(batch.column(text_at)).dictionary_encode()
            own = np.array([int.from_bytes(k[:4], "little") % groups for k in _keys(d.dictionary)])
            tables.append(pa.Table.from_batches([batch]))
            group.append(own[d.indices.to_numpy()])
            size += batch.nbytes
            if size >= GATHER:
                yield flush(tables, group)
                tables, group, size = [], [], 0
        if tables:
            yield flush(tables, group)

    return run


def _apply(text_at: int, names: list[str], keep: list[int], as_is: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, set[tuple[int, int]]] = defaultdict(set)  # equal texts of several chunks have equal ranges
        now = None
        for batch in batches:
            g, kind, k, f, t = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if g[i] != now:
                    now = g[i]
                    found.clear()
                if kind[i] == 0:
                    found[k[i]].add((f[i], t[i]))
                    continue
                block = zstandard.ZstdDecompressor().decompress(batch.column(5)[i].as_py())
                for part in pa.ipc.open_stream(block):
                    code = part.column(text_at)
                    texts = C.plain_text(code.dictionary)
                    w = C.Words(texts)
                    stay = np.ones(len(w.begin), bool)
                    gone = np.zeros(len(texts), np.int64)
                    for j, key in enumerate(_keys(texts)):
                        base = w.first[j]
                        for x, y in found.get(key, ()):
                            stay[base + x : base + y] = False
                        gone[j] = w.first[j + 1] - base - np.count_nonzero(stay[base : w.first[j + 1]])
                    flat, off, _ = _join(w, stay)
                    kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())
                    if as_is:
                        kept = pa.compute.if_else(pa.array(gone == 0), texts.cast(pa.string()), kept)
                    if not len(texts):  # NULL texts only
                        kept, counts, gone = pa.array([""]), np.zeros(1, np.int64), np.zeros(1, np.int64)
                    else:
                        counts = np.diff(w.first)
                    index = code.indices
                    known = index.fill_null(0)
                    zero = lambda v, known=known, index=index: pa.compute.if_else(index.is_null(), pa.scalar(0, pa.int64()), pa.array(v).take(known))
                    columns = [part.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, kept.take(index), zero(counts), zero(gone)], names)

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", as_is: bool = False) -> DataFrame:
    """docs with the words of text_col that no repeated window covers, joined by single spaces, and the
    counts n_words and n_removed. With as_is, texts that lose nothing stay as they are."""
    spark = docs.sparkSession
    p = C.partitions(spark)
    texts = docs.select(text_col)
    hot = frequent_seeds(texts)
    packed = texts.mapInArrow(C.released(_pack(16 * p, hot)), "bucket int, payload binary")
    packed = packed.repartition(p, "bucket").sortWithinPartitions("bucket")
    runs = C.store(packed.mapInArrow(C.released(_count()), "x long, y long, lo int, hi int"), "runs")
    places = texts.mapInArrow(C.released(_places(4 * p, hot)), "x long, y long, g int, k binary, f int")
    places = C.flagged(places, F.col("x"), runs.select(F.col("x").alias("k")), "maybe").where("maybe").drop("maybe")
    found = places.join(runs, ["x", "y"]).select("g", F.lit(0).alias("kind"), "k", (F.col("f") + F.col("lo")).alias("f"), (F.col("f") + F.col("hi") + WINDOW).alias("t"), F.lit(None).cast("binary").alias("payload"))
    shape = "g int, kind int, k binary, f int, t int, payload binary"
    blocks = docs.mapInArrow(C.released(_block(docs.columns.index(text_col), 4 * p)), shape)
    keep = [i for i, c in enumerate(docs.columns) if c not in (text_col, "n_words", "n_removed")]
    fields = [docs.schema[i] for i in keep] + [T.StructField(text_col, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType(fields)
    both = found.union(blocks).repartition(p, "g").sortWithinPartitions("g", "kind")
    return both.mapInArrow(C.released(_apply(docs.columns.index(text_col), schema.names, keep, as_is)), schema)
