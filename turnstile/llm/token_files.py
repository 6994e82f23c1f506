"""Token files: flat unsigned integers, 64-bit document offsets, one pair of files per range of ids.

Documents are dealt by id range, sorted, encoded and written as `<shard>.ids` (all ids one after the other,
16 bits each if the vocabulary allows, else 32), `<shard>.off` (int64 offset of every document in the shard
and the end) and `<shard>.doc` (the document ids, an Arrow file). The table `shards` has each shard's base,
the prefix sum of the counts before it, so a document's place in the whole is base + offset. All of it is
memory-mapped when read. Files are written under a name of their own and then renamed, so a repeated task
replaces a shard with the same bytes.

White space separates words in this vocabulary, and so does the border between a letter and punctuation, so
a text's ids are those of these pieces, one after the other; each distinct piece of a batch is encoded once.

Nulls: a NULL text is empty and has the end id alone. Ids ascend, NULL last; rows with equal ids follow
their texts' hashes. Repeated rows are written each. Other columns are not read. No rows: no shards.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstile.llm import common as C
from turnstile.session import scratch_path

#: Pieces of words that are encoded at a time.
TOGETHER = 400

# Classes of bytes: white space, ASCII letters, punctuation that a word is cut at beside a letter (the
# tokenizer cuts there as well), and all others.
_SPACE, _LETTER, _CUT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = _CUT
_CLASS[list(C.SEPARATORS)] = _SPACE
#: Second bytes of the small letters from U+00DF on that have the first byte 0xC3.
_TRAIL = np.zeros(256, bool)
_TRAIL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True


class Encoder:
    """Ids of whole texts by the distinct pieces of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their number for each piece."""
        buf, off = C.raw(column)
        kind = _CLASS[buf]
        small = (kind == _LETTER) & (buf >= 97)
        wide = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else off[:0]
        wide = wide[_TRAIL[buf[wide + 1]]]
        small[wide] = small[wide + 1] = True
        size = np.diff(off)
        # One word to the tokenizer and in its own spelling: small letters or punctuation only.
        whole = np.add.reduceat(small, off[:-1], dtype=np.int64) == size
        whole |= np.add.reduceat(kind == _CUT, off[:-1], dtype=np.int64) == size
        ids: list = [None] * len(column)
        own = np.flatnonzero(whole)
        part = column.take(pa.array(own))
        flat, at = C.raw(part)
        text = np.full(len(flat) + len(own), 0x20, np.uint8)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(own)), np.diff(at))] = flat
        text, at = text.tobytes(), at + np.arange(len(at))
        odd = np.flatnonzero(~whole).tolist()
        groups = []
        for a in range(0, len(own), TOGETHER):
            some = own[a : a + TOGETHER]
            words = text[at[a] : at[a + len(some)] - 1].decode()
            got = np.array(self.tokenizer.encode_batch_fast([words], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(some):
                groups.append((some, got, np.diff(ends, prepend=0)))
            else:  # not one word each after all
                odd += some.tolist()
        words = column.take(pa.array(odd, pa.int64())).to_pylist()
        for a in range(0, len(odd), TOGETHER):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + TOGETHER], add_special_tokens=False)]
            groups.append((np.array(odd[a : a + TOGETHER]), np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got])))
        if not groups:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        which, ids, size = (np.concatenate(x) for x in zip(*groups, strict=True))
        base, order = np.cumsum(size) - size, np.argsort(which)
        return ids[C.ranges(base[order], size[order])], size[order]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with end_id after each text, and len + 1 offsets."""
        buf, off = C.raw(texts)
        kind = _CLASS[buf]
        word = kind != _SPACE
        begin = word.copy()
        begin[1:] &= kind[1:] != kind[:-1]
        if b"<|" in buf.tobytes():  # a special token could stand here: it is neither cut nor lowered
            begin[1:] &= kind[:-1] == _SPACE
        else:
            # Of neighbours of different classes only a letter and punctuation are cut apart.
            begin[1:] &= (kind[:-1] == _SPACE) | ((kind[1:] ^ kind[:-1]) == (_LETTER ^ _CUT))
            # A capital before a mark may compose differently than its small letter.
            low = C.LOWER[buf]
            keep = np.flatnonzero((buf[1:] >= 128) & (low[:-1] != buf[:-1])) if len(buf) else off[:0]
            low[keep] = buf[keep]
            buf = low
        begin[(heads := off[:-1][off[:-1] < len(buf)])] |= word[heads]
        at = np.flatnonzero(begin)
        length = np.add.reduceat(word, at, dtype=np.int64) if len(at) else at
        flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int64)), pa.py_buffer(buf[word].tobytes()))
        coded = flat.dictionary_encode()
        ids, size = self.pieces(coded.dictionary)
        base = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        total = np.concatenate(([0], np.cumsum(n)))
        starts = total[np.searchsorted(at, off)] + np.arange(len(off))  # one end id for each text before
        out = np.full(int(starts[-1]), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[starts[1:] - 1] = False
        out[body] = ids[C.ranges(base[code], n)]
        return out, starts


_encoders: dict[str, Encoder] = {}


def _put(folder: str, name: str, write: Callable) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        write(f)
    fs.move(part, f"{path}/{name}")


def mapped(folder: str, name: str) -> pa.Buffer:
    """A file of the folder, memory-mapped; one of a remote store is first copied to the task's own disk."""
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    if fs.type_name == "local":
        return pa.memory_map(path).read_buffer()
    with tempfile.TemporaryDirectory() as own:
        pafs.copy_files(path, f"{own}/f", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        return pa.memory_map(f"{own}/f").read_buffer()


def _writer(folder: str, tokenizer: str, kind: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        shard = TaskContext.get().partitionId()
        offsets, docs = [np.zeros(1, np.int64)], []

        def write(f):
            for batch in batches:
                text = C.plain_text(batch.column(1))
                for a, b in C.chunks(text, 8 << 20):
                    ids, starts = encoder.encode(text.slice(a, b - a), end_id)
                    f.write(ids.astype(kind).tobytes())
                    offsets.append(offsets[-1][-1] + starts[1:])
                docs.append(batch.column(0))

        _put(folder, f"{shard:06d}.ids", write)
        if not docs:
            return
        off = np.concatenate(offsets)
        _put(folder, f"{shard:06d}.off", lambda f: f.write(off.astype("<i8").tobytes()))

        def write_docs(f):
            with pa.ipc.new_file(f, pa.schema([("doc", docs[0].type)])) as out:
                for d in docs:
                    out.write_batch(pa.RecordBatch.from_arrays([d], ["doc"]))

        _put(folder, f"{shard:06d}.doc", write_docs)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(off) - 1]), pa.array([int(off[-1])])], ["shard", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of all documents into `folder` and return the table of shards:
    (shard, n_docs, n_tokens, base, dtype). `tokenizer` is the path of a tokenizers file."""
    from tokenizers import Tokenizer

    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    order = [F.col("doc").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(C.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    shards = C.store(rows.mapInArrow(C.released(_writer(folder, tokenizer, kind, end_id)), "shard int, n_docs long, n_tokens long"), "shards")
    # One row per shard: as many as partitions.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).withColumn("dtype", F.lit(kind))


def _reader(folder: str, id_type: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{r['shard']:06d}"
                ids, off = np.frombuffer(mapped(folder, f"{name}.ids"), r["dtype"]), np.frombuffer(mapped(folder, f"{name}.off"), "<i8")
                at = 0
                for part in (table := pa.ipc.open_file(mapped(folder, f"{name}.doc")).read_all()).to_batches():
                    own = off[at : at + part.num_rows + 1]
                    at += part.num_rows
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(r["base"] + own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], ["doc", "start", "n_tokens", "crc"])
                assert at == len(off) - 1 == table.num_rows

    return run


def read_digests(shards: DataFrame, folder: str, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = shards.repartition(C.partitions(shards.sparkSession), "shard")
    out = rows.mapInArrow(C.released(_reader(folder, id_type)), f"doc {id_type}, start long, n_tokens long, crc long")
    return out.select(F.col("doc").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
