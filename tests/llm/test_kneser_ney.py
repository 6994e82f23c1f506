import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, kneser_ney
from turnstile.llm.kneser_ney import BITS, ORDER


def code(c):
    return ord(c) + 1 if ord(c) < 4000 else 4001 + ord(c) % 94


def grams(text):
    padded = [0] * (ORDER - 1) + [code(c) for c in text]
    return [tuple(padded[i : i + ORDER]) for i in range(len(text))]


class Plain:
    """Interpolated modified Kneser-Ney in dictionaries."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter(g for t in texts for g in grams(t))}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.off, self.context = {}, {}
        for n, counts in self.counts.items():
            seen = Counter(counts.values())
            d = kneser_ney._discounts([seen[k] for k in (1, 2, 3, 4)])
            self.off[n] = lambda c, d=d: d[min(c, 3) - 1]
            total, lost = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                lost[g[:-1]] += self.off[n](c)
            self.context[n] = {h: (total[h], lost[h] / total[h]) for h in total}

    def p(self, g):
        n = len(g)
        lower = self.p(g[1:]) if n > 1 else 1 / (1 << BITS)
        if g[:-1] not in self.context[n]:
            return lower
        total, weight = self.context[n][g[:-1]]
        c = self.counts[n].get(g, 0)
        return (c - self.off[n](c) if c else 0) / total + weight * lower


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice("abcd é中") for _ in range(rng.randrange(200))) for _ in range(60)] + [""]


@pytest.fixture(scope="module")
def model(spark, texts):
    docs = common.prepare(spark).createDataFrame([(t,) for t in texts], "text string")
    return kneser_ney.fit(docs)


def shard_of(model):
    p = model.toPandas()
    return kneser_ney.Shard(p.kind.values, p.k.values, p.v.values)


def test_probabilities_equal_plain_program(model, texts):
    plain, shard = Plain(texts), shard_of(model)
    for t in ["abc d", "zzz", "中é aaaa", texts[0], "\U0001f600x"]:
        own = grams(t)
        keys = np.array([sum(c << BITS * (ORDER - 1 - i) for i, c in enumerate(g)) for g in own], np.int64)
        assert np.allclose(shard.logs(keys), [math.log(plain.p(g)) for g in own], atol=1e-4)


def test_probabilities_sum_to_one(model):
    shard = shard_of(model)
    for h in ("abcd", "zzzz", "", "a", "  é中"):
        key = 0
        for c in ([0] * 4 + [code(x) for x in h])[-4:]:
            key = (key << BITS) | c
        assert abs(np.exp(shard.logs((np.int64(key) << BITS) | np.arange(1 << BITS, dtype=np.int64))).sum() - 1) < 1e-4


def test_shards_add_up(spark, model, texts, monkeypatch):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string").withColumn("h", F.xxhash64("text")).select("id", "lang", "h", "text")
    whole = {r.id: r["mean"] for r in kneser_ney.score(docs, model).collect()}
    monkeypatch.setattr(kneser_ney, "ENTRIES", model.count() // 3)
    parts = {r.id: r["mean"] for r in kneser_ney.score(docs, model).collect()}
    assert all(whole[i] is None and parts[i] is None or abs(whole[i] - parts[i]) < 1e-9 for i in whole)


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["the", "old", "house", "stood", "near", "a", "green", "river"]) for _ in range(60))
    rows = [(i, say(), "en") for i in range(400)] + [(1000 + i, "".join(chr(33 + rng.randrange(90)) for _ in range(300)), "en") for i in range(20)]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(None, 1), (1, None), (5000, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(clashing(docs, "h", "kept", "maybe"), labels).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[1000 + i].kept for i in range(20))


def test_slightly_damaged_texts_go(spark):
    """One word of sixty is jumbled: beyond the border, but not far from it."""
    rng = random.Random(11)
    vocabulary = ["the", "old", "house", "stood", "near", "a", "green", "river"]

    def say(jumbled=0):
        w = [rng.choice(vocabulary) for _ in range(60)]
        for i in rng.sample(range(60), jumbled):
            w[i] = "".join(rng.sample(w[i] + "eaotn", len(w[i])))
        return " ".join(w)

    rows = [(i, say(), "en") for i in range(1600)] + [(2000 + i, say(1), "en") for i in range(40)]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)], "doc_id long, quality int")
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels).collect() if r.kept}
    assert len([i for i in kept if i < 1600]) >= 0.98 * 1600
    gone = 40 - len([i for i in kept if i >= 2000])
    assert gone >= 0.7 * 40, gone


def test_odd_rows(spark):
    docs = odd_docs(common.prepare(spark))
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = kneser_ney.classify(docs, labels).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], len(r[1] or "")) for r in odd_rows())
    assert all(r.kept and (r.perplexity is None) == (r.n_chars == 0) for r in got)
    nothing = labels.limit(0)
    assert all(r.kept for r in kneser_ney.classify(docs, nothing).collect())
    assert kneser_ney.classify(no_docs(spark), labels).count() == 0
