import random

import pytest

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows, prose, words
from turnstile.llm import common, near_duplicates


def shingles(text):
    w = words((text or "").encode().lower().decode() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component id by (id, text)"""
    sets = {(i, t): shingles(t) for i, t in rows}
    keys = list(sets)
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            p, q = sets[keys[a]], sets[keys[b]]
            if p and q and 100 * len(p & q) >= 75 * len(p | q):
                parent[top(keys[a])] = top(keys[b])
    groups = {}
    for k in keys:
        groups.setdefault(top(k), []).append(k)
    out = {}
    for g in groups.values():
        ids = [i for i, _ in g if i is not None]
        for k in g:
            out[k] = (len(sets[k]), min(ids) if ids else None)
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates._components(common.prepare(spark) and docs, "doc_id", "text")
    keyed = docs.selectExpr("doc_id AS id", "text", "xxhash64(text) AS k").distinct()
    joined = got.join(keyed, (got.id.eqNullSafe(keyed.id)) & (got.k == keyed.k)).select(got.id, "text", "n_shingles", "component_id", "kept").collect()
    want = brute(rows)
    assert len(joined) == len(rows)
    for r in joined:
        n, c = want[(r.id, r.text)]
        if n == 0:
            c = r.id
        assert (r.n_shingles, r.component_id, r.kept) == (n, c, r.id == c), r


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in odd_rows()])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_copies_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    bases = [prose(rng, rng.choice([3, 5, 8, 40, 120])) for _ in range(30)]
    rows = []
    for i in range(220):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 15])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        if rng.random() < 0.2:
            w = w[: rng.randrange(1, len(w) + 1)]
        rows.append((i, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    check(spark, rows)


def test_a_shared_passage_does_not_link_and_blocks_lose_nothing(spark, monkeypatch):
    """Many documents around a common passage, half of it: candidates without links, and links among them."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "PAIRS", 500)
    rng = random.Random(5)
    common_part = prose(rng, 50, 10_000)
    rows = []
    for i in range(160):
        rest = prose(rng, rng.choice([6, 14, 25, 50]), 10_000)
        rows.append((i, " ".join(common_part + rest)))
    check(spark, rows)


def test_one_of_each_group_stays(spark):
    docs = clashing(odd_docs(spark), "k", "id", "kept", "_maybe", "root", "_word")
    kept = near_duplicates.keep_one(common.prepare(spark) and docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    # 5 holds the passage of 4 nearly whole; 99 repeats 3; the row without an id repeats 4.
    assert ids == sorted([0, 1, 2, 3, 4, 4, 6, 7, 8, 9, -1])


def test_exactly_one_row_of_each_group_stays(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(prose(rng, 40, 10_000)) for _ in range(3))
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (2, a, "x"), (None, a, "x")]  # a repeated row and copies
    rows += [(None, b, "x"), (None, b, "x"), (None, b + " end", "y")]  # no id at all
    rows += [(5, c, "x"), (5, c + " end", "x"), (6, c, "x"), (7, None, "x"), (7, None, "x"), (8, "", "x")]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    kept = near_duplicates.keep_one_row(clashing(docs, "k", "root", "first", "_id", "_row", "_maybe"))
    got = kept.collect()
    assert kept.columns[:3] == docs.columns and {r["_row"] for r in got} == {"mine"}
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 5, 7, 7, 8]
    assert {r.text for r in got if r.doc_id == 1} == {a}
    assert near_duplicates.keep_one_row(no_docs(spark)).count() == 0


def test_no_rows(spark):
    assert near_duplicates.components(no_docs(spark)).count() == 0
    assert near_duplicates.keep_one(no_docs(spark)).count() == 0


@pytest.mark.parametrize("links, steps", [([(1, i) for i in range(2, 9)], 0), ([], 0), ([(i, i + 1) for i in range(1, 40)] + [(60, 50), (60, 55)], 9)])
def test_links_that_are_stars_take_no_step(spark, monkeypatch, links, steps):
    stored, store = [], common.store
    monkeypatch.setattr(common, "store", lambda df, label: stored.append(label) or store(df, label))
    roots = {r.node: r.root for r in common.connected(spark.createDataFrame(links, "a long, b long"), "c").collect()}
    assert roots == {n: 50 if n >= 50 else 1 for link in links for n in link}
    assert len(stored) <= 1 + steps
