import hashlib
import random
from collections import Counter

import pytest

from tests.llm.odd import SCHEMA, clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, token_alignment
from turnstile.llm.queries import QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def byte_of():
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def plain_alignment(rows, files):
    """[(id, n_a, n_b, groups, links, best, count_sum, digest)] of (id, text), by the libraries and offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(files[0])
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=files[1])
    letters = byte_of()

    def tokens(text):
        a = t.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in x)) for i, x in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()) for i, p in zip(s.encode(text), s.encode(text, out_type=str), strict=True)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    found, linked = [], Counter()
    for i, text in rows:
        a, b = tokens(text) if text else ([], [])
        ends, groups, links = {}, [], []
        at = 0
        for k, (_, x) in enumerate(b):
            at += len(x)
            ends[at] = k
        at = p = q = 0
        for k, (_, x) in enumerate(a):
            at += len(x)
            if at in ends:
                m = ends[at]
                groups.append(",".join(str(y) for y, _ in a[p : k + 1]) + "|" + ",".join(str(y) for y, _ in b[q : m + 1]))
                links.append((a[k][0], b[m][0]))
                p, q = k + 1, m + 1
        linked.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = {}
    for (_, b), n in linked.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (i, a, b, len(g), len(ls), sum(linked[x] == most[x[1]] for x in ls), sum(linked[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, ls in found
    ], linked


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


TEXTS = [
    "The cat's hat; it's 12 o'clock.", " leading", "trailing  ", "a\n\n b\t c", "<|endoftext|> <s> </s> <unk>", "▁ marked", "é́ 中文字 ñandú œuvre", "😀👍🏽 ok", "  x", "x" * 700,
    "don't DON'T 'll 's", "1234567 3.14", "\x00\x01", "ﬁ ① ½", "ab " * 50, "Ünïcödé Straße", "\r\n\r\n", " ", "\u0085 ​",
]


def test_equals_plain_alignment(spark, files):
    rng = random.Random(4)
    some = "the The  in, 'Re\n Öl 中 é 12 ! \t x".split(" ")
    rows = [(i, t) for i, t in enumerate(TEXTS * 2 + [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 80))) for _ in range(150)])]
    rows += [(r[0], r[1]) for r in odd_rows()]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.align(docs, *files)
    want, linked = plain_alignment(rows, files)
    assert rows_of(got.documents) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n for r in got.links.collect()} == dict(linked)


def test_quick_encoder_equals_the_tokenizer(files):
    """Every code point below AGREED, between letters, figures, marks and spaces; and some texts beyond."""
    a = token_alignment.ByteLevel(files[0])
    assert a.fast is not None
    for lo in range(0, token_alignment.AGREED, 1 << 13):
        points = [chr(c) for c in range(lo, lo + (1 << 13)) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c} {c}1{c}. {c}\n{c}'s  {c}" for c in points]
        if texts:
            slow = [e.ids for e in a.slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            assert [x.tolist() for x in a.encode(texts)] == slow
    strange = ["x \U000e0041 \U00030001y", "plain"]
    assert [x.tolist() for x in a.encode(strange)] == [a.slow.encode(" " + t, add_special_tokens=False).ids for t in strange]


def test_chunks_of_a_few_windows(files):
    """However the windows are cut into chunks and whatever is remembered, the groups are the same."""
    a, b = token_alignment.ByteLevel(files[0]), token_alignment.Pieces(files[1])
    rows = list(enumerate(t for t in TEXTS if t[0] != "▁"))
    want, _ = plain_alignment(rows, files)
    memo = token_alignment.Memo()
    for (_, text), w in zip(rows * 2, want * 2, strict=True):
        own = token_alignment.windows(a.encode([text]), b.encode([text]), a.vocabulary, b.vocabulary)
        (said,) = memo.said(memo.numbers(own), own.first)
        assert hashlib.sha256(said.encode()).hexdigest() == w[-1]
    assert memo.times.sum() > len(memo.sizes) == len(memo.number) and len(memo.pairs()) == memo.sizes.sum()


def test_columns_of_any_name(spark, files):
    docs = clashing(odd_docs(spark), "chunk", "id", "windows", "n_a")
    got = token_alignment.align(docs, *files, groups=True).documents
    assert got.count() == len(odd_rows()) and "groups" in got.columns
    assert token_alignment.align(no_docs(spark), *files).documents.count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert rows_of(token_alignment.align(nothing, *files).documents) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_other_kinds_of_tokenizers_are_refused(files):
    with pytest.raises(ValueError):
        token_alignment.ByteLevel(tokenizer_file("word_bpe_49k.json"))


def test_whole_table(spark, sf_dir, files):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_token_alignment"](spark, sf_dir)) == sorted(plain_alignment(rows, files)[0], key=str)
