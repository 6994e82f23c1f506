import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.odd import clashing, no_docs, odd_docs, odd_rows
from turnstile.llm import common, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_encode_as_whole_texts(tokenizer):
    rng = random.Random(1)
    letters = "aB'sdréΣσ \n\ṯ́ \u0085 中文 1２９<|>-,.̸=Ĳŉß%H"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|STARTOFTEXT|> don't we'LL 's", "éa. (É) 3.14"]
    ids, starts = token_files.Encoder(PATH).encode(pa.array(texts, pa.large_string()), 1)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_files_hold_every_document_in_order(spark, tokenizer):
    docs = clashing(odd_docs(common.prepare(spark)), "doc", "start", "shard")
    folder = token_files.new_folder(spark)
    shards = token_files.write_tokens(docs, folder, PATH)
    got = sorted(token_files.read_digests(shards, folder, "long").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows()), key=lambda i: (i is None, i))
    at = 0
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in got:
        assert r.start == at
        at += r.n_tokens
        sums = {zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts[r.doc_id]}
        assert r.ids_crc32 in sums
    parts = shards.orderBy("shard").collect()
    assert [p.base for p in parts] == [sum(q.n_tokens for q in parts[:i]) for i in range(len(parts))]


def test_a_shard_is_mapped_from_its_files(spark, tokenizer):
    docs = common.prepare(spark).createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    folder = token_files.new_folder(spark)
    for r in token_files.write_tokens(docs, folder, PATH, end_id=2).collect():
        ids = np.frombuffer(token_files.mapped(folder, f"{r.shard:06d}.ids"), r.dtype)
        off = np.frombuffer(token_files.mapped(folder, f"{r.shard:06d}.off"), "<i8")
        assert len(off) == r.n_docs + 1 and off[-1] == len(ids) == r.n_tokens and ids[-1] == 2


def test_no_rows(spark):
    folder = token_files.new_folder(common.prepare(spark))
    shards = token_files.write_tokens(no_docs(spark), folder, PATH)
    assert shards.count() == 0 and token_files.read_digests(shards, folder, "long").count() == 0
