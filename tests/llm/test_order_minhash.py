import hashlib
import random

import numpy as np

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, order_minhash


def brute(text):
    """One text's entries: its numbered k-mers, the least of each order, back in text order."""
    h, _ = order_minhash._kmers([text])
    out = []
    for odd in order_minhash._ODD:
        v = (h >> np.uint64(32)).astype(np.uint32) * odd
        least = sorted(sorted(range(len(h)), key=lambda i: (v[i], i))[: order_minhash.TUPLE])
        least = [-1] * (min(order_minhash.TUPLE, 2) - len(least)) + least
        x = np.zeros(1, np.uint64)
        for k, i in enumerate(least):
            x = common.mix(x * np.uint64(3) + (h[i] if i >= 0 else np.uint64(k)) + np.uint64(1))
        out.append(int(x[0] >> np.uint64(48)) if text else 0)
    return out


def test_entries_equal_a_plain_search():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 200))) for _ in range(80)] + ["x" * 300, "", "a", "abc", "é中" * 40]
    got = order_minhash.fingerprints(texts)
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == brute(t)
    assert (got == np.concatenate([order_minhash.fingerprints([t]) for t in texts])).all()


def test_repeated_kmers_are_numbered():
    h, off = order_minhash._kmers(["ab" * 100, "ab" * 100])
    one, two = h[: off[1]], h[off[1] :]
    assert len(set(one.tolist())) == len(one) and (one == two).all()


def test_order_and_edits_show():
    rng = random.Random(2)
    a, b = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(2)]
    swapped, edited, other = a[1000:] + a[:1000], a[:1900] + b[:100], b
    p = order_minhash.fingerprints([a, swapped, edited, other])
    like = [order_minhash.likeness(p[0], x) for x in p]
    assert like[0] == 1 and like[2] > like[1] > like[3] and like[3] < 0.1


def report(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        out.append((d, n, hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()))
    return out


def test_edit_report_follows_descending_ids(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in odd_rows()[:10]] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(300)]
    for chunk in (1 << 17, 50):
        monkeypatch.setattr(order_minhash, "CHUNK", chunk)
        docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = order_minhash.edit_report(clashing(docs, "o", "p", "extra", "none")).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(report(rows))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    single = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [(r.edited_sha256, r.near_next) for r in order_minhash.edit_report(single).collect()] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]


def test_ties_nulls_and_repeated_rows(spark):
    docs = odd_docs(common.prepare(spark))
    got = order_minhash.edit_report(docs).collect()
    assert len(got) == len(odd_rows())
    prints = {r.doc_id: r.fingerprint for r in order_minhash.fingerprint(clashing(docs, "fingerprint")).collect()}
    assert prints[0] == prints[1] and len(prints[4]) == 4 * order_minhash.SKETCHES
    assert all(r.fingerprint == prints[r.doc_id] for r in got if r.doc_id in (2, 3, 4, 8))


def test_no_rows(spark):
    assert order_minhash.edit_report(no_docs(spark)).count() == 0
    assert order_minhash.fingerprint(no_docs(spark)).count() == 0
