"""Helpers of the text operators: words and their hashes in numpy, written tables, links to groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.session import scratch_path, tune

#: Bytes that separate words: the complement of [^\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text taken at a time; a longer text is taken alone.
CHUNK = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches cut by bytes: texts differ much in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return tune(spark)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run(), after which a worker gives back what it freed: it waits for its next task, beside others, with
    little memory."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up, self.down


_bytes, _words = _Powers(_BASE), _Powers(_WORD_BASE)


def plain_text(column: pa.Array) -> pa.Array:
    """The column as large_string, NULL as empty."""
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text."""
    off = raw(column)[1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of some texts: byte spans, 64-bit hashes, and `first`, the index of each text's first word (len + 1)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.buf, self.off = raw(column)
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        word = _IS_WORD[self.buf]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        inner = self.off[(self.off > 0) & (self.off < n)]
        begin[inner] |= word[inner]
        stop[inner - 1] |= word[inner - 1]
        self.begin = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.begin, self.off)
        self.is_word = word

    def hashes(self) -> np.ndarray:
        up, down = _bytes.get(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.begin]) * down[self.begin])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; len(h) - k + 1 of them, text bounds not heeded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _words.get(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the codes (uint64, above 0) from each start to its end."""
    up, down = _words.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes) * up[: len(codes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts, lengths)
    return np.arange(total) + shift


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), u > v, has one link down and none up, or links up only."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return nodes.agg(F.count_if(F.expr("down > 1 or down = 1 and up = 1"))).first()[0] == 0


def connected(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; each is a minimum per node and a join, so a node with
    very many links is combined before the shuffle and never gathered. Every step is written to the
    shared folder. Links that are stars already, before a step or after it, need no further one.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = store(edges, label)
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    while not _stars(edges):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), turned)).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = store(small.select("e.u", "e.v").where("u > v").distinct(), label)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of the membership table that `flagged` broadcasts: 2 MiB of bits in 2^18 rows, whatever the input.
SLOTS = 1 << 24


def flagged(df: DataFrame, key, keys: DataFrame, name: str) -> DataFrame:
    """df with boolean `name`: false means that the row's key (a long) is surely not in `keys` (column k).

    One bit per hash slot, so the broadcast side has a fixed size. A row flagged true still has to be
    joined; the others are spared the shuffle.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bits = keys.select(slot(F.col("k")).alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("_word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("_bits"))
    df = df.withColumn("_slot", slot(key)).withColumn("_word", F.expr("cast(_slot div 64 as int)"))
    df = df.join(F.broadcast(bits), "_word", "left")
    hit = F.expr("coalesce(getbit(_bits, cast(_slot % 64 as int)), 0) = 1")
    return df.withColumn(name, hit).drop("_slot", "_word", "_bits")
