"""Alignment of the tokens of two tokenizers, by anchors at white space.

Tokenizer A is a byte-level BPE (a `tokenizers` file), B a sentencepiece model. A encodes a space and the text, B
the text, before which it puts a space itself, so both spell the same bytes. A byte offset at which a token of
either ends is a shared end; shared ends cut the tokens into groups, and the two tokens that end at one are
linked.

A text is encoded whole. Then the shared ends before tokens that begin with a space in either tokenizer are its
anchors, verified against the bytes of the text, and split it into windows, mostly words: a window is the
tuple of its ids in A and in B. Equal windows have equal groups and links, so these are worked out once and
remembered by the tuples. A task remembers up to `WINDOWS` windows or those of `BYTES` of text (or of one
longer text); then it writes them out as a chunk and starts anew. A document is stored as the numbers of its
windows in its chunk.

How often a pair of ids is linked in the corpus is summed over the chunks' windows, each with the number of
its occurrences, so a frequent pair is one row of a chunk. The counts come back to the chunks the same way, a
row for each pair of a chunk, and are added up for windows first and then for documents. The table of the
highest count of each id of B is broadcast: it has no more rows than B has pieces.

Special tokens in a text are plain text. Nulls: texts that are NULL or empty, or whose tokens of A or B do not
spell exactly a space and the text (a piece for unknown characters, a normalised character), have no tokens: counts
0, empty groups, digest ''. Rows with a NULL id and repeated rows are aligned each. Other columns are not read. No
rows: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import common as C

WINDOWS, BYTES = 1 << 17, 24 << 20
#: Texts with a code point from here on are cut by the tokenizer's own rule: two libraries may know different
#: versions of Unicode. Below it they agree (tested).
AGREED = 0x30000
_STRANGE = re.compile(f"[{chr(AGREED)}-{chr(sys.maxunicode)}]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next
    of those from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes of every id: as one string, with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        return self.data[C.ranges(self.start[ids], self.size[ids])]


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        if said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path} is no byte-level BPE that keeps every byte")
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters, ids = _byte_letters(), self.slow.get_vocab()
        tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)
        # With every single byte in the vocabulary the ids spell the bytes they were made from.
        self.lossless = {bytes([b]) for b in range(256)} <= set(tokens)
        self.fast = self._ranked(model, tokens, pre)

    def _ranked(self, model: dict, tokens: list[bytes], pre: dict):
        """The same merges by rank, if ids ascend with them: quicker, the result is the same."""
        import tiktoken

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in merges]
        plain = not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout") or len(model["vocab"]) != 256 + len(merges)
        if plain or made != list(range(256, 256 + len(merges))):
            return None
        ranks = {tokens[i]: i for i in model["vocab"].values()}
        # Fixed value: the rule by which byte-level pre-tokenizers cut texts.
        rule = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranked", pat_str=rule, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.fast is None or _STRANGE.search(t)]
        for i in set(range(len(texts))) - set(odd):
            out[i] = self.fast.encode_to_numpy(" " + texts[i], disallowed_special=()).astype(np.int64)
        for i, e in zip(odd, self.slow.encode_batch_fast([" " + texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int64)
        return out


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(2)
def _tokenizers(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_file), Pieces(b_file)


def _spelling(want: np.ndarray, off: np.ndarray, ids: list[np.ndarray], v: Vocabulary) -> np.ndarray:
    """Of each text, whether its ids spell its bytes in `want`."""
    size = np.array([v.size[x].sum() for x in ids], np.int64)
    right = size == np.diff(off)
    some = np.flatnonzero(right & (size > 0))
    if len(some):
        got = v.spelt(np.concatenate([ids[i] for i in some]))
        same = got == want[C.ranges(off[some], size[some])]
        right[some] = np.logical_and.reduceat(same, np.cumsum(size[some]) - size[some])
    return right


def _hash(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return C.spans(ids.astype(np.uint64) + np.uint64(1), start, end)


@dataclass
class Windows:
    """Windows of some texts: bounds in the ids of A and B, and in the groups; `first` of each text (len + 1)."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray  # one behind the last token of each group
    end_b: np.ndarray
    last: np.ndarray  # of each window: its last group
    first: np.ndarray


def windows(a: list[np.ndarray], b: list[np.ndarray], va: Vocabulary, vb: Vocabulary) -> Windows:
    """Groups and windows of texts whose ids spell the same bytes."""
    ids_a, ids_b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
    ends_a, ends_b = np.cumsum(va.size[ids_a]), np.cumsum(vb.size[ids_b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    place = np.full(total + 1, -1, np.int32)
    place[ends_b] = np.arange(len(ids_b))
    at = place[ends_a]
    group_a = np.flatnonzero(at >= 0)
    group_b = at[group_a].astype(np.int64)
    end_a, end_b = group_a + 1, group_b + 1
    # An anchor: a space begins either next token, or a text ends.
    texts_a = np.cumsum([len(x) for x in a])
    anchor = np.zeros(len(group_a), bool)
    if len(group_a):
        anchor[:-1] = va.spaced[ids_a[end_a[:-1]]] & vb.spaced[ids_b[end_b[:-1]]]
        anchor[np.searchsorted(end_a, texts_a[texts_a > 0])] = True
    last = np.flatnonzero(anchor)
    first = np.concatenate(([0], np.searchsorted(end_a[last], texts_a, "right"))) if len(a) else np.zeros(1, np.int64)
    return Windows(ids_a, ids_b, end_a, end_b, last, first)


def _same(ids: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    size = end - start
    if (size != size[like]).any():
        return False
    return bool((ids[C.ranges(start, size)] == ids[C.ranges(start[like], size)]).all())


def _distinct(a: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of equal spans of ids, and the kind of every span. Spans are told apart by a hash, and all
    those of a kind compared; where that fails every span is a kind of its own."""
    _, one, of = np.unique(C.mix(_hash(a, from_a, to_a)) ^ _hash(b, from_b, to_b), return_index=True, return_inverse=True)
    if _same(a, from_a, to_a, one[of]) and _same(b, from_b, to_b, one[of]):
        return one, of
    return np.arange(len(of)), np.arange(len(of))


def _named(a: np.ndarray, from_a: np.ndarray, to_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """The id tuples of spans."""
    a, b = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
    for i, j, m, n in zip((4 * from_a).tolist(), (4 * to_a).tolist(), (4 * from_b).tolist(), (4 * to_b).tolist(), strict=True):
        yield a[i:j], b[m:n]


def _spelt(ids: bytes) -> str:
    return ",".join(map(str, np.frombuffer(ids, "<i4").tolist()))


class Memo:
    """Windows seen so far, by their id tuples: a window's number leads to its groups, a group's to its text and to
    the pair of tokens that end it."""

    def __init__(self):
        self.number: dict[tuple[bytes, bytes], int] = {}
        self.group: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []  # of the groups
        self.pair: list[int] = []
        self.sizes = self.starts = self.groups = np.zeros(0, np.int64)  # of the windows
        self.times = np.zeros(0, np.int64)
        self.bytes = 0

    def _learn(self, w: Windows, new: np.ndarray) -> None:
        """Groups and links of the windows at `new`."""
        begin = np.concatenate(([0], w.last[:-1] + 1))[new]
        size = w.last[new] + 1 - begin
        group = C.ranges(begin, size)
        spans = []
        for ids, ends in ((w.a, w.end_a), (w.b, w.end_b)):
            spans += [ids, np.where(group > 0, ends[group - 1], 0), ends[group]]
        one, of = _distinct(*spans)
        known, numbers = len(self.group), []
        for name in _named(*(x if k % 3 == 0 else x[one] for k, x in enumerate(spans))):
            numbers.append(n := self.group.setdefault(name, len(self.group)))
            if n == len(self.texts):
                self.texts.append(f"{_spelt(name[0])}|{_spelt(name[1])}")
                self.pair.append(int.from_bytes(name[0][-4:], "little") << 32 | int.from_bytes(name[1][-4:], "little"))
        assert len(self.texts) == len(self.group) >= known
        self.sizes = np.concatenate((self.sizes, size))
        self.groups = np.concatenate((self.groups, np.array(numbers, np.int64)[of]))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def numbers(self, w: Windows) -> np.ndarray:
        """The number of every window."""
        if not len(w.last):
            return np.zeros(0, np.int64)
        end_a, end_b = w.end_a[w.last], w.end_b[w.last]
        start_a, start_b = np.concatenate(([0], end_a[:-1])), np.concatenate(([0], end_b[:-1]))
        one, of = _distinct(w.a, start_a, end_a, w.b, start_b, end_b)
        known, number = len(self.number), self.number
        mine = np.array([number.setdefault(name, len(number)) for name in _named(w.a, start_a[one], end_a[one], w.b, start_b[one], end_b[one])])
        fresh = np.flatnonzero(mine >= known)
        if len(fresh):
            _, first = np.unique(mine[fresh], return_index=True)
            self._learn(w, one[fresh[first]])
        out = mine[of]
        counts = np.bincount(out, minlength=len(self.sizes))
        counts[: len(self.times)] += self.times
        self.times = counts
        return out

    def said(self, number: np.ndarray, first: np.ndarray) -> list[str]:
        """The groups of texts as text, from the numbers of their windows; `first` of each text (len + 1)."""
        size = self.sizes[number]
        texts = np.array([*self.texts, None], object)[self.groups[C.ranges(self.starts[number], size)]].tolist()
        ends = np.concatenate(([0], np.cumsum(size)))[first].tolist()
        return [";".join(texts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def pairs(self) -> np.ndarray:
        """The linked pairs of all windows, one window after the other."""
        return np.array(self.pair, np.int64)[self.groups]


_DOC = "n_a long, n_b long, n_groups long, groups_sha256 string, groups string, windows array<int>"
_CHUNK = "sizes array<int>, times array<long>, pairs array<long>"


def _aligner(a_file: str, b_file: str, id_type: pa.DataType, spelled: bool) -> Callable:
    """Rows of documents, and behind those of a chunk one row of its windows."""
    names = ["chunk", "id", "is_doc", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "windows", "sizes", "times", "pairs"]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(a_file, b_file)
        memo, chunk = Memo(), TaskContext.get().partitionId() << 32

        def documents(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
            buf, off = C.raw(column)
            texts = column.to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            got_a, got_b = a.encode([texts[i] for i in some]), b.encode([texts[i] for i in some])
            # A space and the text, of each.
            size = np.diff(off)[some] + 1
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            want = np.full(int(ends[-1]), 0x20, np.uint8)
            text = np.ones(len(want), bool)
            text[ends[:-1]] = False
            want[text] = buf
            right = _spelling(want, ends, got_b, b.vocabulary)
            if not a.lossless:
                right &= _spelling(want, ends, got_a, a.vocabulary)
            none = np.zeros(0, np.int64)
            own_a, own_b = [none] * len(texts), [none] * len(texts)
            for k, i in enumerate(some):
                if right[k]:
                    own_a[i], own_b[i] = got_a[k], got_b[k]
            w = windows(own_a, own_b, a.vocabulary, b.vocabulary)
            number = memo.numbers(w)
            memo.bytes += len(buf)
            bounds = np.concatenate(([0], w.last + 1))[w.first]  # groups before each text
            said = memo.said(number, w.first)
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, chunk)), ids, pa.array([True] * n), pa.array([len(x) for x in own_a], pa.int64()),
                    pa.array([len(x) for x in own_b], pa.int64()), pa.array(np.diff(bounds)), pa.array(digest, pa.string()),
                    pa.array(said if spelled else [None] * n, pa.string()),
                    pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(number.astype(np.int32))),
                    pa.nulls(n, ints), pa.nulls(n, longs), pa.nulls(n, longs),
                ],
                names,
            )

        def windows_row() -> pa.RecordBatch:
            one = [pa.array([v], kind) for v, kind in ((memo.sizes, ints), (memo.times, longs), (memo.pairs(), longs))]
            blank = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.string())] * 2 + [pa.nulls(1, ints)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, id_type), pa.array([False]), *blank, *one], names)

        for batch in batches:
            column = C.plain_text(batch.column(1))
            for i, j in C.chunks(column):
                yield documents(batch.column(0).slice(i, j - i), column.slice(i, j - i))
                if len(memo.sizes) >= WINDOWS or memo.bytes >= BYTES:
                    if len(memo.sizes):
                        yield windows_row()
                    memo, chunk = Memo(), chunk + 1
        if len(memo.sizes):
            yield windows_row()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of a chunk and how often it is linked there."""
    for batch in batches:
        for chunk, sizes, times, pairs in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
            sizes, times, pairs = (x.values.to_numpy(zero_copy_only=False) for x in (sizes, times, pairs))
            pair, of = np.unique(pairs, return_inverse=True)
            n = np.bincount(of, np.repeat(times, sizes)).astype(np.int64)  # exact below 2^53
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunk)), pa.array(pair), pa.array(n)], ["chunk", "pair", "n"])


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums of their links' counts."""
    rows = documents.column("is_doc").to_numpy().astype(bool)
    own = documents.filter(pa.array(rows)).drop_columns(["is_doc", "sizes", "pairs"]).combine_chunks()
    lists = own.column("windows").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    per = np.zeros((2, 0), np.int64)
    if not rows.all():
        chunk = documents.filter(pa.array(~rows))
        size, pairs = (np.asarray(chunk.column(c)[0].values) for c in ("sizes", "pairs"))
        known = counts.sort_by("pair")
        at = np.searchsorted(known.column("pair").to_numpy(), pairs)
        n, best = known.column("n").to_numpy()[at], known.column("best").to_numpy().astype(np.int64)[at]
        begin = np.cumsum(size) - size
        per = np.array([np.add.reduceat(x, begin) for x in (n, best)])
    off = lists.offsets.to_numpy().astype(np.int64)
    index = lists.values.to_numpy()[off[0] : off[-1]]
    sums = [np.concatenate(([0], np.cumsum(x[index])))[off - off[0]] for x in per]
    out = own.drop_columns(["windows", "chunk"])
    return out.append_column("count_sum", pa.array(np.diff(sums[0]))).append_column("n_best", pa.array(np.diff(sums[1])))


@dataclass
class Alignment:
    documents: DataFrame  # id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups)
    links: DataFrame  # a_id, b_id, n (how often linked in the corpus), best (the most frequent of b_id, ties included)


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> Alignment:
    """Align the tokens of every text; with `groups`, documents has them as text `a1,a2|b1;a3|b2,b3`."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("id", id_type), T.StructField("is_doc", T.BooleanType())]
        + T.StructType.fromDDL(f"{_DOC}, {_CHUNK}").fields
    )
    from pyspark.sql.pandas.types import to_arrow_type

    run = _aligner(a_file, b_file, to_arrow_type(id_type), groups)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(C.released(run), schema)
    rows = C.store(rows, "alignment")
    own = rows.where(~F.col("is_doc")).select("chunk", "sizes", "times", "pairs").mapInArrow(C.released(_pairs), "chunk long, pair long, n long")
    own = C.store(own, "pairs")
    total = own.groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = total.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_most"))  # as many rows as B has pieces, at most
    total = total.join(F.broadcast(most), b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))
    total = C.store(total, "links")
    counts = own.select("chunk", "pair").join(total, "pair")
    columns = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "groups"]
    result = T.StructType([schema[c] for c in columns] + [T.StructField("count_sum", T.LongType()), T.StructField("n_best", T.LongType())])
    rows = rows.select("chunk", "is_doc", *columns, "windows", "sizes", "pairs")
    done = rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_summed, result)
    shown = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    links = total.select(F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "n", "best")
    return Alignment(done.select(*shown, *(["groups"] if groups else [])), links)
