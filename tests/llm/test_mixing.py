import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.odd import clashing, no_docs, odd_docs, words
from turnstile.llm import common, mixing


def naive(votes, caps, seats):
    queue = [(-v, i, 0) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(queue)
    won = [0] * len(votes)
    for _ in range(seats):
        if not queue:
            break
        _, i, k = heapq.heappop(queue)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i, won[i]))
    return won


@pytest.mark.parametrize("seed", range(6))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 7, 40])
    votes = [rng.choice([0, 1, 1, 3, rng.randint(1, 1000), rng.random() * 50]) for _ in range(n)]
    seats = rng.choice([0, 1, n, 3 * n, 100 * n])
    total = sum(votes)
    caps = [rng.choice([10**6, int(2 + 1.1 * v / total * seats) if total else 1]) for v in votes]
    rows = [(i, float(v), c, seats) for i, (v, c) in enumerate(zip(votes, caps, strict=True))]
    df = spark.createDataFrame(rows, "_order long, v double, cap long, seats long")
    got = {r._order: r.won for r in mixing.apportion(df, "v", "cap", "seats", "won", []).collect()}
    want = naive(votes, caps, seats)
    assert [got[i] for i in range(n)] == want


def filled(sizes):
    """Targets by handing the excess on, round by round; sizes in source order."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, full = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        if not free:
            return [2.0 * s for s in sizes]
        unit = (total - sum(2 * sizes[i] for i in full)) / sum(weight[i] for i in free)
        new = {i for i in free if unit * weight[i] > 2 * sizes[i]}
        if not new:
            return [2.0 * s if i in full else unit * weight[i] for i, s in enumerate(sizes)]
        full |= new


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1, 1], [5, 5, 5, 1000], [0, 7, 0, 9], [1, 2, 4, 8, 16, 32, 64]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(chr(97 + i) if i + 1 < len(sizes) else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("_r").collect()]
    assert got == pytest.approx(filled(sizes))


def rows_of(spark, docs):
    return mixing.mix(mixing.sized(common.prepare(spark) and docs)).collect()


def test_the_mix_comes_near_its_targets_and_agrees_with_itself(spark, sf_dir):
    docs = common.read_table(common.prepare(spark), sf_dir, "documents")
    got = rows_of(spark, docs)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum((t.e - t.b) * t.times for t in r._takes or [])
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, filled([sizes[s] for s in order]), strict=True):
        assert {r.source_size for r in by[s]} == {sizes[s]}
        assert by[s][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in by[s]) - target) <= 1.5 * mixing.BLOCK
    assert {(r.doc_id, r.taken) for r in rows_of(spark, docs)} == {(r.doc_id, r.taken) for r in got}


def test_many_shards_change_no_source(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 500)
    test_the_mix_comes_near_its_targets_and_agrees_with_itself(spark, sf_dir)


def test_mixed_texts_hold_the_words_taken(spark):
    docs = clashing(odd_docs(spark), "size", "taken", "_x", "target")
    docs = docs.withColumn("size", F.lit("mine"))
    taken = sum(r.taken for r in rows_of(spark, odd_docs(spark)))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == taken > 0


def test_no_rows(spark):
    assert rows_of(spark, no_docs(spark)) == [] and mixing.mixed_documents(no_docs(spark)).count() == 0


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken, r.target) for r in rows_of(spark, docs)} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
