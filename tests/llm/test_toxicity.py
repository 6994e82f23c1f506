import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, toxicity

RUDE = ["idiot", "scum", "moron", "worthless", "pathetic"]


def said(rng, rude=0):
    w = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sho", "ku"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 90))]
    for _ in range(rude):
        w[rng.randrange(len(w))] = rng.choice(RUDE)
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    return [(i, said(rng, 3 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    docs = common.prepare(spark).createDataFrame([r[:2] for r in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus if i % 4] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_held_out_texts(spark, corpus, model):
    docs = spark.createDataFrame([r[:2] for r in corpus if r[0] % 4 == 0], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.judge(docs, model).collect()}
    right = sum(got[i] == t for i, _, t in corpus if i % 4 == 0)
    assert right >= 0.98 * len(got)


def test_gapped_and_inserted_insults(model):
    rng = random.Random(8)
    calm = model.score(pa.array([said(rng) for _ in range(40)], pa.large_string()))
    assert (calm < toxicity.THRESHOLD).all()
    for rude in ("i.d.i.o.t s-c-u-m", "i d i o t you m o r o n", "IDIOT! Scum...", "idiiot worthlesss patheticc", "mo*ron wor_thless"):
        assert model.score(pa.array([said(rng) + " " + rude], pa.large_string()))[0] >= toxicity.THRESHOLD, rude


def kernel(s, t, lam=toxicity.DECAY, n=toxicity.ORDER):
    from itertools import combinations

    def profile(x):
        out = {}
        for at in combinations(range(len(x)), n):
            key = "".join(x[i] for i in at)
            out[key] = out.get(key, 0) + lam ** (at[-1] - at[0] + 1)
        return out

    p, q = profile(s), profile(t)
    return sum(v * q.get(k, 0) for k, v in p.items())


def test_kernels_equal_all_subsequences():
    names = ["^idiot$", "^id-iot$", "^banana$", "^aaaa$", "abc", "^i$", "^дурак$", "^ду_рак$", "^漢字仮名$"]
    land = toxicity.Landmarks(names)
    got, powers = land.likeness(names), land.kernels(names)
    others = ["^idiot$", "^дурачок$", "^漢字$", "zzz", "^кот$"]  # characters that no landmark has match nothing
    more = toxicity.Landmarks(names).likeness(others)
    for rows, values in ((names, got), (others, more)):
        for i, s in enumerate(rows):
            for j, t in enumerate(names):
                want = kernel(s, t) / (kernel(s, s) * kernel(t, t)) ** 0.5
                assert abs(values[i, j] - want) < 1e-3, (s, t)
    assert np.allclose(powers, got**toxicity.POWER)


def test_two_inserted_letters_and_figures(model):
    rng = random.Random(9)
    for rude in ("1d10t", "m0r0n 5cum", "idxioqt morzonv scuwqm worthlebss pathetkic", "w0rthle55 p4thetic"):
        assert model.score(pa.array([said(rng) + " " + rude], pa.large_string()))[0] >= toxicity.THRESHOLD, rude


def test_fragments_of_units():
    names = ["^ab$", "^abc$", "^lowei$", "^loweischaft$"]
    hashes, of = toxicity.fragments(names)
    by = {n: set(hashes[of == i].tolist()) for i, n in enumerate(names)}
    assert len(by["^ab$"]) == 1 and len(by["^abc$"]) == 2
    # Runs of five and openings of six (^lowe, lowei, owei$; ^lowei), and the whole.
    shared = by["^lowei$"] & by["^loweischaft$"]
    assert len(shared) == 3 and len(by["^lowei$"]) == 5
    again, _ = toxicity.fragments(["x", "^loweiung$", ""])
    assert shared <= set(again.tolist())


def test_discoveries():
    assert toxicity.discovered([], 10) == {}
    assert toxicity.discovered([(1, 50.0), (2, 1.0)], 1000) == {1: 50.0}
    # As many of one strength as there are prove each other.
    assert len(toxicity.discovered([(i, 14.0) for i in range(200)], 100_000)) == 200
    assert toxicity.discovered([(1, 14.0)], 100_000) == {}


def test_evidence_equals_plain_counts(spark, corpus, monkeypatch):
    rows = spark.createDataFrame([(i, t, x) for i, x, t in corpus], "h long, toxic int, text string")
    got = toxicity.evidence(rows)
    n = [0, 0]
    counts = {}
    for _, x, t in corpus:
        n[t] += 1
        for h in set(toxicity.fragments(toxicity._pieces(toxicity.units(pa.array([x], pa.large_string()))[0])[0])[0].tolist()):
            counts.setdefault(h, [0, 0])[t] += 1

    def ratio(b, a):
        from math import log

        def part(k, m, p):
            return (k * log(p) if k else 0) + ((m - k) * log(1 - p) if m - k else 0)

        p = (a + b) / sum(n)
        return 2 * (part(a, n[1], a / n[1]) + part(b, n[0], b / n[0]) - part(a, n[1], p) - part(b, n[0], p))

    some = sorted(((ratio(b, a), h) for h, (b, a) in counts.items() if a >= toxicity.SUPPORT and a / n[1] > 8 * b / n[0]), reverse=True)
    want = toxicity.discovered([(h, r) for r, h in some], sum(a > 0 for _, a in counts.values()))
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-6 for h in got)


def test_odd_rows(spark, model):
    got = toxicity.judge(clashing(odd_docs(spark), "score", "unit", "_label"), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and {r.unit for r in got} == {"mine"}


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    for rows, share in (([(1, 1)], 2 / 3), ([], 1 / 2), ([(1, 0)], 1 / 3)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.judge(docs, toxicity.train(docs, labels)).collect()
        assert all(abs(r.score - share) < 1e-6 for r in got)
    assert toxicity.judge(no_docs(spark), toxicity.train(no_docs(spark), labels)).count() == 0


def test_nothing_is_predicted_without_a_fit(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, 1)], [(1, 0), (2, 0), (3, 0)], [(1, 1), (3, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(r.predicted == 0 for r in toxicity.judge(docs, model).collect()), rows
