"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a character model of order `ORDER`. Every task counts the n-grams of its trusted texts before
they are shuffled; lower orders are continuation counts, discounts come from the counts of counts, and
probabilities and context weights are joined order by order. An n-gram is one 64-bit number, 12 bits for a
character (code points from 4,000 on share 94 classes), so its prefix and suffix are shifts and masks.

Scoring joins text and model shard by shard. All entries that a character's probability can need beyond
order two hold the two characters before it, so the model is cut by these into shards of about `ENTRIES`
entries; each is broadcast and gives every text the sum over the positions that belong to the shard, and
the sums are added by row. Texts are never shuffled for it, and what a broadcast holds has a fixed size
however large the model grows.

A text's perplexity is compared with its language's threshold, from trusted texts that the model has not seen
(one in `UNSEEN`): in logarithms, the median plus `SPREAD` times the distance from the median to the 95th
percentile, that distance taken 3 / sqrt(n) larger for n such texts, about two standard errors of its estimate.
This is no quantile: it lies 3.3 standard deviations above the middle of many normal values, more of few.
Languages with fewer than `LEAST_TEXTS` such texts take the quantiles of all.

Nulls: a NULL, empty or shorter text than `LEAST_CHARS` characters has a perplexity (NULL without
characters) and is kept. Labels that are NULL or have no id trust nothing; without trusted texts all are
kept. A NULL language takes the quantiles of all. Rows with the same id and text are scored once and
returned as often as they came. Columns of the input named like a result do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as C

ORDER, BITS = 5, 12
ENTRIES = 3_000_000
UNSEEN, SPREAD, LEAST_TEXTS, LEAST_CHARS = 8, 2.0, 20, 100
#: Distinct n-grams that a task gathers before it merges them.
GATHER = 3_000_000
_MASK = (1 << BITS) - 1
_VOCABULARY = 1 << BITS


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ORDER-grams that end at each character, the text of each, and the numbers of characters."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points < 4000, points + 1, 4001 + points % 94)
    text = np.repeat(np.arange(len(texts)), size)
    pad = ORDER - 1  # zeros before each text stand for its start
    padded = np.zeros(len(points) + pad * len(texts), np.int64)
    at = np.arange(len(points)) + (text + 1) * pad
    padded[at] = points
    key = np.zeros(len(points), np.int64)
    for k in range(ORDER):
        key = (key << BITS) | padded[at - pad + k]
    return key, text, size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merge(held):
        key = np.concatenate([k for k, _ in held])
        count = np.concatenate([c for _, c in held])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[head], np.add.reduceat(count, head)

    held, size = [], 0
    for batch in batches:
        text = C.plain_text(batch.column(0))
        for a, b in C.chunks(text):
            key = _codes(text.slice(a, b - a).to_pylist())[0]
            if len(key):
                held.append(np.unique(key, return_counts=True))
                size += len(held[-1][0])
            if size > GATHER:
                held = [merge(held)]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["g", "c"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(held)], ["g", "c"])


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 3 * y)
    return tuple(min(max(x, 0.1), k) for k, x in zip((1, 2, 3), d, strict=True))


def fit(texts: DataFrame) -> DataFrame:
    """The model as (kind, k, v): natural logarithms of the probabilities of n-grams (kind 1 to ORDER) and of
    the weights of contexts of length 1 to ORDER - 1 (kind 11 and up), and of an unknown character (kind 0)."""
    counts = {ORDER: C.store(texts.mapInArrow(C.released(_count), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "counts")}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << BITS * n) - 1))
        counts[n] = C.store(counts[n + 1].groupBy(suffix.alias("g")).agg(F.count("*").alias("c")), "counts")
    parts, lower = [], None
    for n in range(1, ORDER + 1):
        t = counts[n]
        seen = t.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        d = _discounts([seen[f"n{k}"] for k in (1, 2, 3, 4)])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("h", F.shiftright("g", BITS)).withColumn("off", off)
        # What the discounts take from a context goes to the next order.
        contexts = C.store(t.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("weight")), "contexts")
        t = t.join(contexts, "h").withColumn("own", (F.col("c") - F.col("off")) / F.col("total"))
        if n == 1:
            t = t.withColumn("p", F.col("own") + F.col("weight") / _VOCABULARY)
            parts.append(contexts.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k"), F.log(F.col("weight") / _VOCABULARY).alias("v")))
        else:
            suffix = F.col("g").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))
            t = t.withColumn("s", suffix).join(lower, "s").withColumn("p", F.col("own") + F.col("weight") * F.col("q"))
            parts.append(contexts.select(F.lit(9 + n), F.col("h"), F.log("weight")))
        level = C.store(t.select("g", "p"), "level")
        lower = level.select(F.col("g").alias("s"), F.col("p").alias("q"))
        parts.append(level.select(F.lit(n), F.col("g"), F.log("p")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return C.store(out.withColumn("v", F.col("v").cast("float")), "model")


class _Index:
    """Values of 64-bit keys, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, self.keys, self.values = [], keys, values
        rest, salt = np.arange(len(keys)), 1
        while len(rest):
            bits = max(4, int(np.ceil(np.log2(len(rest) + 1))) + 1)
            slot = self._slot(keys[rest], salt, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = rest
            self.levels.append((salt, bits, table))
            rest = rest[table[slot] != rest]
            salt += 1

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
        x = (keys.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; whether there is one)"""
        out, found = np.zeros(len(keys), np.float64), np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        for salt, bits, table in self.levels:
            if not len(rest):
                break
            own = keys[rest]
            at = table[self._slot(own, salt, bits)]
            ok = (at >= 0) & (self.keys[at] == own)
            hit = rest[ok]
            out[hit], found[hit] = self.values[at[ok]], True
            rest = rest[~ok]
        return out, found


class Shard:
    """What the positions of one shard need of the model."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.single = np.full(_VOCABULARY, float(value[kind == 0][0]) if (kind == 0).any() else -np.log(_VOCABULARY))
        one = kind == 1
        self.single[key[one]] = value[one]
        pick = lambda k: _Index(np.ascontiguousarray(key[kind == k]), value[kind == k])
        self.grams = {n: pick(n) for n in range(2, ORDER + 1)}
        self.contexts = {n: pick(9 + n) for n in range(2, ORDER + 1)}

    def logs(self, key: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of the last character of each ORDER-gram."""
        out = np.zeros(len(key))
        rest = np.arange(len(key))
        for n in range(ORDER, 1, -1):
            own = key[rest] & ((1 << BITS * n) - 1)
            value, found = self.grams[n].get(own)
            out[rest[found]] += value[found]
            rest, own = rest[~found], own[~found]
            if not len(rest):
                return out
            out[rest] += self.contexts[n].get(own >> BITS)[0]  # weight 1 if the context is unknown
        out[rest] += self.single[key[rest] & _MASK]
        return out


_shards: dict[str, Shard] = {}


def _scorer(shard, number: int, shards: int) -> Callable:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _shards:  # a worker keeps the last one
            _shards.clear()
            _shards[name] = Shard(*shard.value)
        model = _shards[name]
        for batch in batches:
            text = C.plain_text(batch.column(3))
            for a, b in C.chunks(text, 1 << 20):
                key, at, size = _codes(text.slice(a, b - a).to_pylist())
                if shards > 1:
                    own = np.flatnonzero(((key >> BITS) & ((1 << 2 * BITS) - 1)) % shards == number)
                    key, at = key[own], at[own]
                total = np.bincount(at, model.logs(key), b - a) if len(key) else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(size), pa.array(total)], ["id", "lang", "h", "n", "s"])

    return run


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, h, rows, n, mean) of the distinct rows of docs (id, lang, h, text): their number, characters
    and the mean logarithm of a character's probability."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // ENTRIES))
    # Grams above order two hold the two characters before the last; contexts end with them.
    before = F.when(F.col("kind") > 10, F.col("k")).otherwise(F.shiftright("k", BITS)).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    everywhere = F.col("kind").isin(0, 1, 2, 11)
    out = None
    for s in range(shards):
        part = model.where(everywhere | (before % shards == s)).toArrow()
        arrays = tuple(part.column(c).to_numpy() for c in ("kind", "k", "v"))
        held = spark.sparkContext.broadcast(arrays)
        own = docs.mapInArrow(C.released(_scorer(held, s, shards)), "id long, lang string, h long, n long, s double").withColumn("shard", F.lit(s))
        out = own if out is None else out.union(own)
    rows = out.groupBy("id", "lang", "h").agg(F.count(F.when(F.col("shard") == 0, 1)).alias("rows"), F.max("n").alias("n"), F.sum("s").alias("s"))
    return rows.select("id", "lang", "h", "rows", "n", F.when(F.col("n") > 0, F.col("s") / F.col("rows") / F.col("n")).alias("mean"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id_col, lang_col, n_chars, perplexity, threshold, kept) of every row; labels (id_col, quality) with
    quality 1 are trusted."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    trusted = C.store(labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("k")).distinct(), "trusted")
    unseen = lambda c: F.pmod(F.xxhash64(c), F.lit(UNSEEN)) == 0
    learn = trusted.where(~unseen("k"))
    texts = C.flagged(docs.where("id is not null"), F.col("id"), learn, "maybe").where("maybe")
    texts = texts.join(learn, texts["id"] == learn["k"], "left_semi").select("text")
    scores = C.store(score(docs, fit(texts)), "scores")
    scores = scores.withColumn("bits", -F.col("mean"))
    sample = scores.join(trusted.where(unseen("k")), F.col("id") == F.col("k"), "left_semi").where(f"n >= {LEAST_CHARS}")
    quantiles = F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(0.95)), F.lit(10_000))
    level = (F.col("q")[0] + SPREAD * (1 + 3 / F.sqrt("c")) * (F.col("q")[1] - F.col("q")[0])).alias("level")
    by_lang = sample.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("c"), quantiles.alias("q")).where((F.col("c") >= LEAST_TEXTS) & F.col("l").isNotNull()).select("l", level)
    of_all = sample.agg(F.count("*").alias("c"), quantiles.alias("q")).select(F.when(F.col("c") >= LEAST_TEXTS, level).alias("any"))
    out = scores.join(by_lang, F.col("lang") == F.col("l"), "left").join(F.broadcast(of_all), F.lit(True))  # one row
    threshold = F.coalesce("level", "any")
    far = F.coalesce((F.col("n") >= LEAST_CHARS) & (F.col("bits") > threshold), F.lit(False))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("n").alias("n_chars"), F.exp("bits").alias("perplexity"), F.exp(threshold).alias("threshold"), (~far).alias("kept"))
