import random
from collections import Counter

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows, prose, words
from turnstile.llm import common, repeats


def brute(texts, n=35):
    own = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts):
    docs = common.prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.remove_repeats(docs).collect()}
    for i, (t, want) in enumerate(zip(texts, brute(texts), strict=True)):
        n, x, kept = got[i]
        assert (n, x) == want[:2] and (kept or "") == want[2], i
        assert (kept is None) == (t is None)


def test_random_passages_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (35, 36, 50, 90, 34)]
    line = prose(rng, 9)
    texts = [None, "", "a b"]
    for _ in range(150):
        w = prose(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages)
            w += line + prose(rng, rng.randrange(4))
        text = " ".join(w) if rng.random() < 0.7 else "\t\n ".join(w)
        texts += [text] * rng.choice([1, 1, 1, 2, 5])
    texts.append(" ".join(["same"] * 36))  # windows of one text repeat each other
    texts.append(" ".join(["same"] * 35))
    texts.append(" ".join(["other"] * 35))
    check(spark, texts)


def test_few_words_make_every_seed_frequent(spark):
    rng = random.Random(4)
    check(spark, [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(60)])


def test_buckets_beyond_a_part_are_solved_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "UNPACK", 2_000)
    monkeypatch.setattr(repeats, "GATHER", 5_000)
    test_random_passages_equal_brute_force(spark)


def test_a_passage_of_many_texts_reaches_its_bucket_once():
    import pickle

    import numpy as np
    import pyarrow as pa
    import zstandard

    rng = random.Random(8)
    passage = prose(rng, 90)
    texts = [" ".join(prose(rng, 3, 10_000) + passage) for _ in range(500)]
    rows = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, 500, 50)]
    payloads = [x for b in repeats._pack(4, np.zeros(0, np.uint64))(iter(rows)) for x in b.column(1).to_pylist()]
    unpacked = [pickle.loads(zstandard.ZstdDecompressor().decompress(x)) for x in payloads]
    inside = [x for u in unpacked for x in u[-1].split(b"\n") if x.decode() in " ".join(passage)]
    assert inside and len(inside) == len(set(inside))
    assert max(int(u[1].max()) for u in unpacked) == 500


def test_equal_hashes_are_compared(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(common, "grams", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    a, b = " ".join(f"a{i}" for i in range(36)), " ".join(f"b{i}" for i in range(35))
    owner, window = repeats._repeated(pa.array([a, b, "x " + b], pa.large_string()), np.array([1, 1, 1]))
    assert list(zip(owner, window, strict=True)) == [(1, 0), (2, 1)]


def test_odd_rows_and_clashing_columns(spark):
    docs = clashing(odd_docs(spark), "g", "kind", "payload", "n_words", "bucket")
    got = repeats.remove_repeats(common.prepare(spark) and docs).collect()
    rows = odd_rows()
    want = Counter((r[0], *w[:2]) for r, w in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == want
    assert {r.g for r in got} == {"mine"}


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    rng = random.Random(12)
    twice = prose(rng, 40, 10_000)
    whole = ["a  b\tc\n\nd ", "\n" + "\t".join(prose(rng, 50, 10_000)) + "  ", "", " ", None, "é\r\n中"]
    cut = ["x\n" + "\t".join(twice) + "  y", " ".join(twice) + "\nz"]
    docs = common.prepare(spark).createDataFrame(list(enumerate(whole + cut)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.remove_repeats(docs, as_is=True).collect()}
    assert [got[i] for i in range(len(whole) + 2)] == [*whole, "x y", "z"]


def test_no_rows(spark):
    assert repeats.remove_repeats(no_docs(spark)).count() == 0
