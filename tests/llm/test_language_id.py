import random
import re
import unicodedata
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, language_id
from turnstile.llm.queries import QUERIES

SYLLABLES = {"aa": "ka to mi no shi".split(), "bb": "der ung sch ein ver".split(), "cc": "ção lhe nha dos ões".split()}


def said(rng, lang):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40))).capitalize() + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(said(rng, lang), lang) for lang in SYLLABLES for _ in range(150)] + [("12 34", "aa"), (None, "bb"), ("kato", None)]
    return language_id.train(common.prepare(spark).createDataFrame(rows, "text string, lang string"))


def grams(text):
    out = []
    for word in re.findall(r"[^\W\d_]+", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text)):
        w = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in word) + " "
        out += [w[i] for i in range(1, len(w) - 1)] + [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    return Counter(out)


def slot(gram):
    code = [ord(c) for c in gram]
    none = (1 << 21) - 1
    key = code[0] << 21 if len(code) == 1 else code[0] << 42 | code[1] << 21 | (code[2] if len(code) == 3 else none)
    return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50


def test_counts_equal_plain_ones():
    texts = ["The cat's Öl; x9y", "", "  ", "é́ 中文 \u0085 ’A", "a", "ab ab", "Z" * 50, "0 1", "ǅ İx"]
    column = pa.array(texts, pa.large_string())
    got = {}
    for a, _, text, where, count in language_id.counted(column):
        for t, s, n in zip(text.tolist(), where.tolist(), count.tolist(), strict=True):
            got[a + t, s] = n
    want = Counter()
    for i, t in enumerate(texts):
        for g, n in grams(t).items():
            want[i, slot(g)] += n
    assert got == dict(want)


def test_cosines_equal_plain_ones(model):
    rng = random.Random(2)
    for lang in SYLLABLES:
        text = said(rng, lang)
        vector = np.zeros(language_id.SLOTS)
        counts = Counter()
        for g, n in grams(text).items():
            counts[slot(g)] += n
        for s, n in counts.items():
            vector[s] = (1 + log(n)) * model.idf[s]
        cosine = model.centroids @ (vector / np.linalg.norm(vector))
        best, score = model.nearest(pa.array([text], pa.large_string()))
        assert model.langs[best[0]] == model.langs[cosine.argmax()] == lang and abs(score[0] - cosine.max()) < 1e-5


def test_held_out_texts_and_rejection(spark, model):
    rng = random.Random(3)
    rows = [(said(rng, lang), lang) for lang in SYLLABLES for _ in range(60)]
    got = language_id.identify(spark.createDataFrame(rows, "text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang for r in got) and sum(r.rejected for r in got) <= 0.1 * len(got)
    strange = language_id.identify(spark.createDataFrame([("Привет как дела друг",), ("zzz qqq xxx",)], "text string"), model).collect()
    assert all(r.rejected for r in strange)


def test_centroids_of_two_kinds():
    x = np.zeros((20, language_id.SLOTS), np.float32)
    x[:10, 1] = x[10:, 2] = 1
    centroids, of = language_id.cluster(x)
    assert len(centroids) == 2 and len(set(of[:10])) == len(set(of[10:])) == 1 and of[0] != of[10]


def test_odd_rows(spark, model):
    docs = clashing(odd_docs(spark), "score", "lang_pred", "slot", "h")
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.slot == "mine"
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, False)
        else:
            assert r.lang_pred in SYLLABLES
    trained = language_id.train(clashing(odd_docs(spark), "slot", "h", "k"))
    assert set(trained.langs) <= {"en", "fr"}


def test_nothing_to_learn(spark):
    empty = language_id.train(common.prepare(spark).createDataFrame([("a b", None), (None, "x"), ("1", "y")], "text string, lang string"))
    assert [(r.lang_pred, r.score) for r in language_id.identify(odd_docs(spark), empty).collect()] == [("und", 0.0)] * len(odd_rows())
    assert language_id.identify(no_docs(spark), empty).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    right = total = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        if r.held_out and d.lang and re.search(r"[^\W\d_]{3}", d.text or ""):
            total += 1
            right += r.lang_pred == d.lang
    assert right >= 0.95 * total
