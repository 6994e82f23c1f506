import math
import random
from collections import Counter

from tests.llm.odd import WORD, clashing, no_docs, odd_docs, odd_rows, words
from turnstile.llm import common, divergence


def base(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside), n < 50 or 100 * len(inside) > 50 * n


def plain(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_columns(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "\n", " ", "\t", "|", "x y z ", "é"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    docs = common.prepare(spark).createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: plain(r) for r in divergence.judge(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_odd_rows(spark):
    got = divergence.judge(clashing(odd_docs(common.prepare(spark)), "_words", "kept", "n_words", "_lang")).collect()
    assert Counter((r.doc_id, *plain(r)) for r in got) == Counter((r[0], *base(r[1])) for r in odd_rows())
    assert all(not r.kept for r in got if r.base_failed)


def js(p, q):
    a, b = sum(p), sum(q)
    p, q = [x / a for x in p], [x / b for x in q]
    part = lambda x, m: x * math.log2(x / m) if x else 0
    return math.sqrt(sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q, strict=True)) / 2)


def test_distance(spark):
    rows = [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 0.0], [0.0, 5.0]), ([4.0, 4.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    got = [r.d for r in df.select(divergence._distance("p", "q").alias("d")).collect()]
    assert all(abs(g - js(*r)) < 1e-9 for g, r in zip(got, rows, strict=True)) and got[1] == 1
    none = spark.createDataFrame([([0.0], [1.0])], "p array<double>, q array<double>")
    assert none.select(divergence._distance("p", "q").alias("d")).first().d is None


def test_distances_equal_plain_histograms(spark):
    rng = random.Random(3)
    said = [f"{rng.choice('abc')}{i % 30}" for i in range(4000)]
    texts = [" ".join(rng.choice(said) for _ in range(rng.choice([60, 200]))) for _ in range(60)] + ["Q9|" * 5 + " Zz!" * 80]
    docs = common.prepare(spark).createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    total = Counter(w for t in texts for w in words(t))
    common_words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON]]
    own = lambda t: [sum(w not in common_words for w in words(t)), *(words(t).count(w) for w in common_words)]
    good = [t for t in texts if not base(t)[5]]
    reference = [sum(c) for c in zip(*map(own, good), strict=True)]
    for i, t in enumerate(texts):
        assert abs(got[i].word_distance - js(own(t), reference)) < 1e-9
    assert not got[60].kept and sum(got[i].kept for i in range(60)) == len([t for t in texts[:60] if not base(t)[5]])


def test_short_languages_and_no_rows_are_not_judged(spark):
    docs = spark.createDataFrame([(1, "one two three " * 5 + "x " * 0, "xx")], "doc_id long, text string, lang string")
    (r,) = divergence.judge(docs).collect()
    assert r.char_distance is None and r.word_distance is None
    assert divergence.judge(no_docs(spark)).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = common.read_table(common.prepare(spark), sf_dir, "documents")
    good = common.read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    got = divergence.judge(docs).join(good, "doc_id").where("not base_failed")
    assert got.where("not kept").count() <= 0.02 * got.count()
