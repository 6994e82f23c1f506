"""Language identification by the nearest of several clustered centroids of each language.

A text's features are the 1-, 2- and 3-grams of its letters, lower-cased, each word bordered by a space at
either end, hashed into `SLOTS` slots. A slot weighs (1 + ln count) times its inverse document frequency and
the vector is brought to length 1. Document frequencies count every text that may be learnt from. Each
language has up to `CLUSTERS` centroids, found by spherical k-means; a text gets the language of the centroid
with the greatest cosine, which is its score. A text farther from that centroid (1 - cosine) than `SLACK` times
the distance within which a share `QUANTILE` of the centroid's own texts lie is `rejected`: it resembles no
language that was learnt.

Only the centroids are fitted on a sample: at most `SAMPLE` texts of each language, those with the least hash,
copies counted once. The model holds `SLOTS` numbers for each centroid and at most `LANGUAGES` languages (the
commonest values of the column) are learnt, so its size has a bound that does not depend on the corpus.

Nulls: a NULL text, an empty one and one without any letter get `und` and score 0 and are not rejected; nothing
is learnt from them, nor from rows whose language is NULL. Where nothing can be learnt every text gets `und`.
Equal cosines: the language first in code point order. Repeated rows are judged each. Texts of any length are
read whole. Other columns pass through; `lang_pred`, `score` and `rejected` replace columns of these names.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import common as C

SLOTS = 1 << 14
SAMPLE, CLUSTERS, LANGUAGES, ROUNDS = 1000, 4, 256, 12
QUANTILE, SLACK = 0.99, 1.1
UNKNOWN = "und"
#: Texts whose slots are counted together.
TOGETHER = 64

_BORDER, _NONE = 32, (1 << 21) - 1
_FACTOR, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 14)


@cache
def _letters() -> np.ndarray:
    """The small letter of every letter, 0 for any other code point, by the rules of Unicode."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every n-gram of all texts, and the text it stands in."""
    buf, off = C.raw(column)
    size = np.diff(np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off])
    low = _letters()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
    at = np.flatnonzero(low)
    text = np.repeat(np.arange(len(size)), size)[at]
    here = low[at].astype(np.uint64)
    begin = np.ones(len(at), bool)
    begin[1:] = (np.diff(at) != 1) | (np.diff(text) != 0)
    end = np.ones(len(at), bool)
    end[:-1] = begin[1:]
    before, after = np.full((2, len(at)), _BORDER, np.uint64)
    before[1:][~begin[1:]] = here[:-1][~begin[1:]]
    after[:-1][~end[:-1]] = here[1:][~end[:-1]]
    two, one = np.uint64(42), np.uint64(21)
    middle = here << one
    grams = [middle, before << two | middle | np.uint64(_NONE), before << two | middle | after]
    grams.append((here[end] << two) | np.uint64(_BORDER << 21 | _NONE))
    slot = (np.concatenate(grams) * _FACTOR >> _SHIFT).astype(np.int64)
    return slot, np.concatenate((text, text, text, text[end]))


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, text from the first on, slot, count) of texts taken together, ordered by text and slot."""
    for a, b in C.chunks(column):
        for c in range(a, b, TOGETHER):
            n = min(TOGETHER, b - c)
            slot, text = _slots(column.slice(c, n))
            count = np.bincount(text * SLOTS + slot, minlength=n * SLOTS)
            some = np.flatnonzero(count)
            yield c, c + n, some // SLOTS, some % SLOTS, count[some]


def _weights(text: np.ndarray, slot: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the counts, every text's of length 1."""
    w = (1 + np.log(count)) * idf[slot]
    norm = np.sqrt(np.bincount(text, w * w, n))
    return w / np.where(norm > 0, norm, 1)[text]


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, SLOTS), of length 1
    radius: np.ndarray  # distance from which a text is rejected

    def nearest(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of every text's nearest centroid, -1 without a letter or a model, and the cosine."""
        best, score = np.full(len(column), -1), np.zeros(len(column))
        if not self.langs:
            return best, score
        for a, b, text, slot, count in counted(column):
            dense = np.zeros((b - a, SLOTS), np.float32)
            dense[text, slot] = _weights(text, slot, count, b - a, self.idf)
            cosine = dense @ self.centroids.T
            some = np.unique(text)
            best[a + some] = cosine[some].argmax(1)
            score[a + some] = np.clip(cosine[some].max(1), 0, 1)
        return best, score


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each slot stands; their number as slot -1."""
    total, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for _, _, text, slot, _ in counted(C.plain_text(batch.column(0))):
            total += np.bincount(slot, minlength=SLOTS)
            n += len(np.unique(text))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["slot", "n"])


def _vectors(idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # no more than there are sampled texts
        for batch in batches:
            new = [i for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(new, pa.int64()))
            for a, b, text, slot, count in counted(C.plain_text(batch.column(2))):
                w = _weights(text, slot, count, b - a, idf).astype(np.float32)
                ends = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (slot.astype(np.int32), w)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], ["lang", "h", "slots", "weights"])

    return run


def cluster(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the rows (of length 1) by spherical k-means, and each row's centroid. Seeds: the row
    nearest to the mean, then always the one farthest from all seeds."""
    mean = x.sum(0)
    seeds = [int((x @ mean).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)) and near.min() < 1 - 1e-6:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centroids, of = x[seeds], None
    for _ in range(ROUNDS):
        now = (x @ centroids.T).argmax(1)
        if of is not None and (now == of).all():
            break
        held, of = np.unique(now, return_inverse=True)
        centroids = np.zeros((len(held), x.shape[1]), x.dtype)
        for i in range(len(held)):
            centroids[i] = x[of == i].sum(0)
        centroids /= np.maximum(np.sqrt((centroids**2).sum(1, keepdims=True)), 1e-12)
    return centroids, (x @ centroids.T).argmax(1)


def _cluster_language(table: pa.Table) -> pa.Table:
    """Centroids of one language: at most SAMPLE rows."""
    table = table.combine_chunks().sort_by("h")
    lists = [table.column(c).combine_chunks() for c in ("slots", "weights")]
    size = lists[0].value_lengths().to_numpy()
    x = np.zeros((len(size), SLOTS), np.float32)
    x[np.repeat(np.arange(len(size)), size), lists[0].flatten().to_numpy()] = lists[1].flatten().to_numpy()
    centroids, of = cluster(x[size > 0]) if (size > 0).any() else (x[:0], np.zeros(0, np.int64))
    far = 1 - (x[size > 0] * centroids[of]).sum(1)
    radius = [float(np.quantile(far[of == i], QUANTILE)) if (of == i).any() else 0.0 for i in range(len(centroids))]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(centroids) + 1, dtype=np.int32) * SLOTS), pa.array(centroids.ravel()))
    lang = pa.array([table.column("lang")[0].as_py()] * len(centroids), pa.string())
    return pa.table([lang, pa.array(range(len(centroids)), pa.int32()), flat, pa.array(radius, pa.float64())], names=["lang", "k", "centroid", "radius"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of docs; the caller leaves held-out rows away."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    counts = rows.select("text").mapInArrow(C.released(_frequencies), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r.slot: r.n for r in counts.collect()}  # SLOTS rows and one
    n = found.pop(-1, 0) or 0
    df = np.zeros(SLOTS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    keys = rows.select("lang", "h").distinct()
    common = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    # Of a common language the least hashes are cut out first: about twice SAMPLE are left to rank.
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    near = keys.join(F.broadcast(common), "lang").withColumn("_share", share).where(F.col("_share") * F.col("count") < 2 * SAMPLE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_share", "h"))
    picks = near.withColumn("_place", place).where(F.col("_place") <= SAMPLE).select("lang", "h")
    sample = rows.join(F.broadcast(picks), ["lang", "h"], "left_semi")  # at most LANGUAGES * SAMPLE pairs
    vectors = sample.select("lang", "h", "text").mapInArrow(C.released(_vectors(idf)), "lang string, h long, slots array<int>, weights array<float>")
    vectors = vectors.groupBy("lang", "h").agg(F.first("slots").alias("slots"), F.first("weights").alias("weights"))
    fitted = vectors.groupBy("lang").applyInArrow(_cluster_language, "lang string, k int, centroid array<float>, radius double")
    best = fitted.toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    flat = pa.concat_arrays([pa.array([], pa.list_(pa.float32())), *best.column("centroid").chunks]).flatten()
    centroids = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(best.num_rows, SLOTS)
    return Model(idf, best.column("lang").to_pylist(), centroids, best.column("radius").to_numpy() * SLACK)


def _judge(model: Model, text_at: int, names: list[str], keep: list[int]) -> Callable:
    langs = np.array([*model.langs, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = model.nearest(C.plain_text(batch.column(text_at)))
            far = (best >= 0) & (1 - score > np.append(model.radius, math.inf)[best])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(langs[best], pa.string()), pa.array(score), pa.array(far)], names)

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine with the nearest centroid) and rejected."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    keep = [i for i, c in enumerate(docs.columns) if c not in {f.name for f in new}]
    schema = T.StructType([docs.schema[i] for i in keep] + new)
    return docs.mapInArrow(C.released(_judge(model, docs.columns.index(text_col), schema.names, keep)), schema)
