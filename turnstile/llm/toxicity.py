"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

A text is judged by its worst units. Units are its words, lower-cased, reduced to letters and digits,
figures among letters read as the letters they are written for, and marked at both ends, and runs of three or more single letters joined; a unit longer than 24 characters is
cut into overlapping pieces. Two units are compared by the characters they share in order: every common subsequence of three
counts `DECAY` to the power of the length it spans in either, so a gap or an inserted character lowers the
kernel and does not break it. The kernel against some landmark units, whitened by theirs among themselves
(Nystroem), is a short feature vector on which a linear SVM is fitted. Characters are compared as they are, in
any script; those that no landmark has match nothing.

Labels belong to texts, so it must be found which units make a text toxic. Over all texts that may be learnt
from, copies counted once, Spark counts in how many toxic and clean ones each fragment (a run of `FRAGMENT`
characters of a unit, its opening of up to `OPENING`, or a whole unit) stands, the clean ones for those fragments that at least `SUPPORT` toxic
texts have. A fragment is evidence if its log-likelihood ratio passes a test that allows for the number of
fragments tried (a false discovery rate of `FALSE`). Positives are the units with evidence in a sample of the toxic texts, those of toxic texts
without any that the fit finds worst (round by round), and altered copies of the former: one or two
characters inserted, or one left out. Negatives are units of a sample of clean texts and altered
copies of them, and the units that the first fit got most wrong in any clean text that may be learnt from.

Two units are as like as the power `POWER` of the normalised kernel, which is a kernel too: what shares a few
common subsequences with a landmark is not near it. The score is the logistic function of
the two worst values in the text and the number of units beyond the SVM's border, fitted on texts that took
no part in choosing or fitting units (one in `FOLDS`, by the hash of the text; all, if these lack a class).

Bounds: `SAMPLE` texts of each class, those with the least hash, give units to the fit, a text at most `UNITS`
distinct ones (those with most evidence, then the longest), so that long texts take part as others do; the
`EVIDENCE` strongest fragments are kept, `WORST` units are mined, `BORDER` texts of each class fit the
border. Counting, mining and scoring read every text whole.

Nulls: a NULL or empty text has no unit and gets the score of the least suspicious text. Labels that are
NULL, belong to no row or to a NULL id are not used; a text with labels of both classes has the commoner one, toxic
if they are as many. Without two classes of labelled texts nothing can be
fitted: every text gets the smoothed share of toxic labels as its score, and none is predicted. Repeated rows are scored each. Other columns pass through; `score` and `predicted`
replace columns of these names.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import common as C

SAMPLE, UNITS, LANDMARKS, FOLDS, ROUNDS = 1000, 1000, 64, 4, 3
EVIDENCE, WORST, BORDER = 8192, 4000, 4000
FRAGMENT, OPENING, SUPPORT, FALSE = 5, 9, 3, 0.05
LONGEST, DECAY, ORDER, POWER = 24, 0.7, 3, 3
#: Values up to this are alike.
FLOOR = -0.4
THRESHOLD = 0.3
_NOT_PLAIN = re.compile(r"[\W_]+")


#: Letters that figures are written for: fixed values.
_LETTERS_OF = str.maketrans("431057", "aeiost")


def _plain(word: str) -> str:
    word = word.lower()
    if not word.isalpha():
        word = _NOT_PLAIN.sub("", word)
        if not word.isdecimal():
            word = word.translate(_LETTERS_OF)
    return f"^{word}$" if word else ""


def units(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of some texts, and (unit, text) of each place."""
    w = C.Words(column)
    length = w.end - w.begin
    off = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(off), pa.py_buffer(w.buf[w.is_word].tobytes())).dictionary_encode()
    code = coded.indices.to_numpy()
    names: dict[str, int] = {}
    to = np.array([names.setdefault(_plain(x), len(names)) for x in coded.dictionary.to_pylist()], np.int64)
    text = np.repeat(np.arange(len(column)), np.diff(w.first))
    unit = to[code] if len(code) else code
    one = length == 1
    one[one] = ((w.buf[w.begin[one]] | 32) >= 97) & ((w.buf[w.begin[one]] | 32) <= 122)
    if len(one) > 2 and (three := one[:-2] & one[1:-1] & one[2:] & (text[:-2] == text[2:])).any():
        inside = np.zeros(len(one), bool)
        for k in range(3):
            inside[k : len(one) - 2 + k] |= three
        at = np.flatnonzero(inside)
        new = np.concatenate(([True], (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])))
        extra = []
        for run in np.split(at, np.flatnonzero(new)[1:]):
            name = _plain((w.buf[w.begin[run]] | 32).tobytes().decode())
            extra.append((names.setdefault(name, len(names)), text[run[0]]))
        unit = np.concatenate((unit, [u for u, _ in extra]))
        text = np.concatenate((text, [t for _, t in extra]))
    return list(names), unit, text


def _pieces(names: list[str]) -> tuple[list[str], np.ndarray]:
    """Units cut to at most LONGEST characters, and the unit each piece is of."""
    if all(len(x) <= LONGEST for x in names):
        return names, np.arange(len(names))
    out, of = [], []
    for i, x in enumerate(names):
        for a in range(0, max(1, len(x) - LONGEST // 2), LONGEST // 2) if len(x) > LONGEST else (0,):
            out.append(x[a : a + LONGEST])
            of.append(i)
    return out, np.array(of)


def _triples(n: int) -> tuple[np.ndarray, ...]:
    """Of a string of n characters: the pairs of places in order, of each three places its pair and the last
    place, and the weight of the three."""
    pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
    number = {tuple(p): k for k, p in enumerate(pairs.tolist())}
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)])
    pair = np.array([number[i, j] for i, j, _ in at.tolist()])
    return pairs, pair, at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


_TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def _triples_of(n: int) -> tuple[np.ndarray, ...]:
    if n not in _TRIPLES:
        _TRIPLES[n] = _triples(n)
    return _TRIPLES[n]


def _own_kernel(points: np.ndarray) -> np.ndarray:
    """Kernel of each row of code points with itself: common subsequences are built up a character at a time,
    each step summing over all earlier pairs of places, discounted by their distance."""
    b, n = points.shape
    same = (points[:, :, None] == points[:, None, :]).astype(np.float32)
    step = np.subtract.outer(np.arange(n), np.arange(n))
    back = np.where(step > 0, DECAY ** np.maximum(step, 0), 0).astype(np.float32).T

    def before(x: np.ndarray) -> np.ndarray:
        x = (x.reshape(b * n, n) @ back).reshape(b, n, n)
        return (x.transpose(0, 2, 1).reshape(b * n, n) @ back).reshape(b, n, n).transpose(0, 2, 1)

    ways = same
    for _ in range(ORDER - 1):
        ways = same * before(ways)
    return ways.sum((1, 2)) * DECAY**2


def _by_length(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the strings of each length from ORDER on, some thousands at a time."""
    size = np.array([len(x) for x in names], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    for n in range(ORDER, LONGEST + 1):
        own = np.flatnonzero(size == n)
        for a in range(0, len(own), step := max(64, 200_000 // n**2)):
            part = own[a : a + step]
            yield part, points[start[part][:, None] + np.arange(n)]


@dataclass
class Subsequences:
    """Numbers of the subsequences of ORDER characters that some strings have; 0 for all others."""

    alphabet: np.ndarray  # sorted code points; a character's code is its place + 1
    pair: np.ndarray  # row of two codes
    last: np.ndarray  # (rows, codes)

    @classmethod
    def of(cls, names: list[str]) -> tuple[Subsequences, dict[tuple[int, int, int], int]]:
        alphabet = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32))
        out = cls(alphabet, np.zeros((len(alphabet) + 1) ** 2, np.int32), np.zeros((1, len(alphabet) + 1), np.int32))
        triples: set = set()
        for _, points in _by_length(names):
            pairs, pair, last, _ = _triples_of(points.shape[1])
            c = out.codes(points)
            triples.update(zip(c[:, pairs[pair, 0]].ravel().tolist(), c[:, pairs[pair, 1]].ravel().tolist(), c[:, last].ravel().tolist(), strict=True))
        number = {t: i + 1 for i, t in enumerate(sorted(triples))}
        rows = {p: i + 1 for i, p in enumerate(sorted({t[:2] for t in triples}))}
        for (x, y), i in rows.items():
            out.pair[x * (len(alphabet) + 1) + y] = i
        out.last = np.zeros((len(rows) + 1, len(alphabet) + 1), np.int32)
        for t, i in number.items():
            out.last[rows[t[:2]], t[2]] = i
        return out, number

    def codes(self, points: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(points.shape, np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.int32)

    def places(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `last` each subsequence of strings of one length is, and the weights."""
        c, width = self.codes(points), len(self.alphabet) + 1
        pairs, pair, last, weight = _triples_of(points.shape[1])
        row = self.pair[c[:, pairs[:, 0]] * width + c[:, pairs[:, 1]]] * width
        return row[:, pair] + c[:, last], weight


def _norms(names: list[str]) -> np.ndarray:
    out = np.ones(len(names), np.float32)
    for own, points in _by_length(names):
        out[own] = np.sqrt(_own_kernel(points))
    return out


class Landmarks:
    """Nystroem features: powers of the kernels against the landmarks, whitened by the landmarks' own."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.known, number = Subsequences.of(marks)
        self.table = np.zeros((len(number) + 1, len(marks)), np.float32)
        norms = _norms(marks)
        flat = self.known.last.ravel()
        for own, points in _by_length(marks):
            place, weight = self.known.places(points)
            for m, rows in zip(own.tolist(), flat[place], strict=True):
                np.add.at(self.table[:, m], rows, weight / norms[m])
        self.table[0] = 0
        k = self.kernels(marks)
        values, vectors = np.linalg.eigh((k + k.T).astype(np.float64) / 2)
        self.white = vectors / np.sqrt(np.maximum(values, 1e-3))

    def likeness(self, names: list[str]) -> np.ndarray:
        """The kernel against every landmark, 1 for equal strings."""
        marks = self.table.shape[1]
        out = np.zeros((len(names), marks), np.float32)
        flat = self.known.last.ravel()
        for own, points in _by_length(names):
            place, weight = self.known.places(points)
            row = flat[place]
            step = max(1, (1 << 19) // (len(weight) * max(1, marks)))
            for a in range(0, len(own), step):
                part = row[a : a + step]
                out[own[a : a + step]] = weight @ self.table.take(part.ravel(), 0).reshape(*part.shape, marks)
            out[own] /= np.sqrt(_own_kernel(points))[:, None]
        return out

    def kernels(self, names: list[str]) -> np.ndarray:
        return self.likeness(names) ** POWER

    def features(self, names: list[str]) -> np.ndarray:
        return self.kernels(names) @ self.white


#: Units handled at a time.
SLICE = 16_384
#: Units whose values a task remembers.
REMEMBERED = 1 << 18

@dataclass
class Model:
    land: Landmarks
    weights: np.ndarray  # of each landmark's kernel
    bias: float
    border: np.ndarray | None = None  # weights of features(), the constant last
    fitted: bool = True  # a share of labels says nothing about any one text

    def values(self, names: list[str]) -> np.ndarray:
        """The SVM's value of each unit, the worst piece counting."""
        parts, of = _pieces(names)
        value = np.zeros(len(parts), np.float32)
        for a in range(0, len(parts), SLICE):
            value[a : a + SLICE] = self.land.kernels(parts[a : a + SLICE]) @ self.weights + np.float32(self.bias)
        if len(parts) == len(names):
            return value
        out = np.full(len(names), -np.inf, np.float32)
        np.maximum.at(out, of, value)
        return out

    def features(self, column: pa.Array, memo: dict[str, float] | None = None) -> np.ndarray:
        names, unit, text = units(column)
        memo = {} if memo is None else memo
        new = [x for x in names if x not in memo]
        if len(memo) + len(new) > REMEMBERED:
            memo.clear()
            new = names
        memo.update(zip(new, self.values(new).tolist(), strict=True))
        return _features(np.array([memo[x] for x in names], np.float32), unit, text, len(column))

    def score(self, column: pa.Array, memo: dict[str, float] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column, memo) @ self.border, -500, 500)))


def _features(value: np.ndarray, unit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of n texts: largest and second largest value over all places, log of the number above 0, and 1."""
    out = np.zeros((n, 4))
    out[:, :2], out[:, 3] = FLOOR, 1
    if len(unit):
        v = value[unit]
        some = np.flatnonzero(v > FLOOR)
        v, t = v[some], text[some]
        order = np.lexsort((-v, t))
        v, t = v[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        out[t[first], 0] = v[first]
        second = first[first + 1 < len(t)] + 1
        second = second[t[second] == t[second - 1]]
        out[t[second], 1] = v[second]
        out[:, 2] = np.log1p(np.bincount(t[v > 0], minlength=n))
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin."""
    x1 = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3

    def loss(w):
        gap = np.maximum(0, 1 - y * (x1 @ w))
        return 0.5 * w @ ridge @ w + cost * (weight * gap**2).sum()

    now = loss(w)
    for _ in range(rounds):
        act = y * (x1 @ w) < 1
        xa, wa = x1[act], weight[act]
        grad = ridge @ w - 2 * cost * xa.T @ (wa * (y[act] - xa @ w))
        step = np.linalg.solve(ridge + 2 * cost * (xa * wa[:, None]).T @ xa, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-6 * max(1, last):
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic fit of labels on the features, with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, w, ridge = np.where(y == 1, hi, lo), np.zeros(x.shape[1]), np.diag([0.02] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        w = w + 0.7 * np.linalg.solve(h, x.T @ (weight * (t - p)) - ridge @ w)
    return w


def fragments(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fragments of units (as longs), and the unit each is of: runs of FRAGMENT characters, openings
    of more (up to OPENING), and the whole unit."""
    size = np.array([len(x) for x in names], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    runs = np.maximum(size - FRAGMENT + 1, 0)
    begin, of = [C.ranges(start, runs)], [np.repeat(np.arange(len(names)), runs)]
    length = [np.full(len(of[0]), FRAGMENT)]
    for n in range(FRAGMENT + 1, OPENING + 1):
        long = np.flatnonzero(size > n)
        begin.append(start[long])
        of.append(long)
        length.append(np.full(len(long), n))
    begin, of, length = (np.concatenate(x) for x in ([*begin, start], [*of, np.arange(len(names))], [*length, size]))
    hashes = C.spans(points, begin, begin + length)
    hashes[len(hashes) - len(names) :] ^= np.uint64(1)  # a whole unit is no run
    return hashes.view(np.int64), of


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def altered(unit: str, rng: random.Random) -> list[str]:
    """Copies of a unit as people disguise words: a character or two inserted, one left out."""
    body = unit[1:-1]
    if len(body) < 4:
        return []
    out = []
    for n in (1, 1, 2, 2):
        x = body
        for _ in range(n):
            at = rng.randrange(1, len(x))
            x = x[:at] + (x[at] if rng.random() < 0.4 else rng.choice(_LETTERS)) + x[at:]
        out.append(x)
    at = rng.randrange(1, len(body) - 1)
    out.append(body[:at] + body[at + 1 :])
    return [f"^{x}$"[:LONGEST] for x in out if x != body]


#: Positive units among which landmarks are chosen.
REPRESENTED = 400


def represented(units_: list[str], weight: np.ndarray, n: int) -> list[str]:
    """n of the units to which the others, by weight, are most alike: each adds the most to the sum of every
    unit's likeness to the nearest chosen one."""
    alike = np.maximum(Landmarks(units_).likeness(units_), 0)
    near, chosen = np.zeros(len(units_), np.float32), []
    for _ in range(min(n, len(units_))):
        more = weight @ np.maximum(alike - near[:, None], 0)
        more[chosen] = -1
        chosen.append(int(more.argmax()))
        near = np.maximum(near, alike[:, chosen[-1]])
    return [units_[i] for i in chosen]


def fit_units(toxic: list[list[str]], clean: list[list[str]], evidence: dict[int, float], mined: list[str]) -> tuple[Landmarks, np.ndarray, float]:
    """(landmarks, weight of each one's kernel, bias) from the distinct units of toxic and clean texts, the
    fragments that are evidence and units of clean texts that are known to be hard."""
    texts, y, names = [], [], {}
    for label, group in ((1, toxic), (0, clean)):
        for own in group:
            texts.append(np.array(sorted({names.setdefault(p, len(names)) for p in _pieces(own)[0] if len(p) >= ORDER}), np.int64))
            y.append(label)
    keys = np.array(sorted(evidence), np.int64)
    hashes, of = fragments(mined)
    told = set(of[np.isin(hashes, keys)].tolist())
    mined = [x for i, x in enumerate(mined) if i not in told]  # a clean text may well hold an insult
    for x in mined:
        names.setdefault(x, len(names))
    words, y, rng = list(names), np.array(y), random.Random(11)
    seen = np.zeros((2, len(words)))
    for u, t in zip(texts, y, strict=True):
        seen[t, u] += 1
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    gain = np.log((seen[1] + 0.1) / (n1 + 1)) - np.log((seen[0] + 0.1) / (n0 + 1))
    proven = np.zeros(len(words), bool)
    for a in range(0, len(words), SLICE):
        hashes, of = fragments(words[a : a + SLICE])
        proven[a + of[np.isin(hashes, keys)]] = True
    told = proven.copy()
    proven &= (seen[1] > 0) & (gain > 1)
    base = np.flatnonzero(proven)
    if not len(base):  # too few texts for a proof: units of several toxic texts that no clean one has
        base = np.flatnonzero((gain > 2.5) & (seen[1] >= 2))
        base = base[np.argsort(-gain[base] * np.sqrt(seen[1][base]), kind="stable")][:300]
    base = base[np.argsort(-seen[1][base], kind="stable")][:2500]
    clean_units = np.flatnonzero((seen[0] > 0) & ~told)
    clean_units = np.setdiff1d(clean_units, base)
    hard = np.union1d(clean_units[np.argsort(-seen[0][clean_units], kind="stable")[:3000]], [names[x] for x in mined]).astype(np.int64)
    if not len(base):
        base = hard[:1]
    copies = [x for u in base[:600].tolist() for x in altered(words[u], rng)]
    copies = [x for x in dict.fromkeys(copies) if x not in names and len(x) >= ORDER]
    near = [x for u in rng.sample(hard.tolist(), min(1000, len(hard))) for x in altered(words[u], rng)[::3]]
    near = [x for x in dict.fromkeys(near) if x not in names and len(x) >= ORDER]
    marks = represented([words[u] for u in base[:REPRESENTED]], np.sqrt(seen[1][base[:REPRESENTED]]), LANDMARKS * 2 // 3)
    positive, worst = base, hard
    for turn in range(ROUNDS):
        others = [words[u] for u in worst.tolist() if words[u] not in marks][: LANDMARKS - len(marks)]
        land = Landmarks(marks + others)
        use = [words[u] for u in positive] + copies + [words[u] for u in hard] + near
        target = np.concatenate((np.ones(len(positive) + len(copies)), -np.ones(len(hard) + len(near))))
        weight = np.concatenate((np.sqrt(seen[1][positive] + 1), np.full(len(copies), 0.4), np.full(len(hard), 1.5), np.full(len(near), 0.3)))
        w, b = _svm(land.features(use), target, weight)
        weights = (land.white @ w).astype(np.float32)
        if turn == ROUNDS - 1:
            break
        f = Model(land, weights, b).values(words)
        held = set(positive.tolist())
        best = [t[np.argmax(f[t])] for t, v in zip(texts, y, strict=True) if v == 1 and len(t) and not held & set(t.tolist())]
        # A witness that clean texts hold as often says nothing.
        positive = np.union1d(base, np.array([u for u in best if gain[u] > 1.5 and f[u] > -0.3], np.int64)).astype(np.int64)
        worst = np.setdiff1d(np.union1d(clean_units, hard), positive)
        worst = worst[np.argsort(-f[worst], kind="stable")[:2500]]
        hard = np.setdiff1d(np.union1d(hard, worst), positive)
    return land, weights, b


# --- on Spark ------------------------------------------------------------------------------------


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, toxic, text, fold) of every distinct text with a label."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_label"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Ids and hashes first, so that of all texts those with a label move, once however many copies they have.
    one = texts.select("_id", "h").join(labels, F.col("_id") == F.col("_label")).groupBy("h")
    one = one.agg(F.min("_id").alias("_first"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    one = C.store(one, "labels")
    texts = C.flagged(texts, F.col("h"), one.select(F.col("h").alias("k")), "_given").where("_given").drop("_given")
    rows = texts.join(one.withColumnRenamed("h", "_h"), (F.col("_id") == F.col("_first")) & (F.col("h") == F.col("_h")))
    rows = rows.dropDuplicates(["_id", "h"]).select("h", "toxic", "text", F.pmod(F.xxhash64("h"), F.lit(FOLDS)).cast("int").alias("fold"))
    return C.store(rows, "labelled")


def _bit(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = C.mix(h.view(np.uint64)) >> np.uint64(40)  # C.SLOTS of them
    return (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)


def _fragment_counts(bits: np.ndarray | None) -> Callable:
    """In how many of a task's texts each fragment stands: (fragment, n); only those with their bit set, if
    bits are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2

        def flush(parts):
            key, of = np.unique(np.concatenate(parts[::2]), return_inverse=True)
            return [key, np.bincount(of, np.concatenate(parts[1::2])).astype(np.int64)]

        waiting: list = []
        for batch in batches:
            column = C.plain_text(batch.column(0))
            for a, b in C.chunks(column):
                names, unit, text = units(column.slice(a, b - a))
                parts, part_of = _pieces(names)
                hashes, of = fragments(parts)
                if bits is not None:
                    word, bit = _bit(hashes)
                    some = (bits[word] >> bit) & np.uint64(1) == 1
                    hashes, of = hashes[some], of[some]
                key, number = np.unique(hashes, return_inverse=True)
                of = part_of[of]
                order = np.argsort(of, kind="stable")
                number = number[order]
                first = np.searchsorted(of[order], np.arange(len(names) + 1))
                pair = np.unique(text.astype(np.int64) * len(names) + unit) if len(unit) else np.zeros(0, np.int64)
                unit, text = (pair % len(names), pair // len(names)) if len(pair) else (pair, pair)
                n = (first[1:] - first[:-1])[unit]
                hit = np.unique(np.repeat(text, n) * max(1, len(key)) + number[C.ranges(first[unit], n)])
                waiting += [key, np.bincount(hit % max(1, len(key)), minlength=len(key))]
                if sum(len(x) for x in waiting[::2]) > 1 << 21:
                    held = flush([*held, *waiting])
                    waiting = []
                    if len(held[0]) > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["fragment", "n"])
                        held = [np.zeros(0, np.int64)] * 2
        held = flush([*held, *waiting])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["fragment", "n"])

    return run


def evidence(rows: DataFrame) -> dict[int, float]:
    """Fragments that stand far more often in toxic texts, with their log-likelihood ratio; at most EVIDENCE."""
    schema = "fragment long, n long"
    count = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = float(count.get(1, 0)), float(count.get(0, 0))
    if not n1 or not n0:
        return {}
    toxic = rows.where("toxic = 1").select("text").mapInArrow(C.released(_fragment_counts(None)), schema)
    toxic = C.store(toxic.groupBy("fragment").agg(F.sum("n").alias("a")), "fragments")
    tried = toxic.count()
    toxic = toxic.where(F.col("a") >= SUPPORT)
    bits = np.zeros(C.SLOTS // 64, np.uint64)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(C.SLOTS // 64, np.uint64)
        for batch in batches:
            word, bit = _bit(batch.column(0).to_numpy())
            np.bitwise_or.at(own, word, np.uint64(1) << bit)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], ["word", "bits"])

    set_ = toxic.select("fragment").mapInArrow(C.released(bits_of), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[set_.column(0).to_numpy()] = set_.column(1).to_numpy().view(np.uint64)
    clean = rows.where("toxic = 0").select("text").mapInArrow(C.released(_fragment_counts(bits)), schema)
    clean = clean.groupBy("fragment").agg(F.sum("n").alias("b"))
    both = toxic.join(clean, "fragment", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    a, b, p1, p0 = F.col("a"), F.col("b"), F.lit(n1), F.lit(n0)

    def part(k, n, share):  # k of n at this share
        rest = F.greatest(n - k, F.lit(0.0))
        return F.when(k > 0, k * F.log(share)).otherwise(0) + F.when(rest > 0, rest * F.log(F.greatest(1 - share, F.lit(1e-12)))).otherwise(0)

    all_ = (a + b) / (p1 + p0)
    ratio = 2 * (part(a, p1, a / p1) + part(b, p0, b / p0) - part(a, p1, all_) - part(b, p0, all_))
    both = both.where((a / p1) > 8 * (b / p0)).select("fragment", ratio.alias("ratio")).orderBy(F.desc("ratio"), "fragment").limit(EVIDENCE)
    return discovered([(r.fragment, r.ratio) for r in both.collect()], tried)


def discovered(ranked: list[tuple[int, float]], tried: int) -> dict[int, float]:
    """The ratios that stand a test of `tried` of them: as many of the largest as leave an expected share FALSE of
    errors among them (Benjamini and Hochberg, with half the tail of chi squared)."""
    last = 0
    for i, (_, ratio) in enumerate(ranked, 1):
        if 0.5 * math.erfc(math.sqrt(max(ratio, 0) / 2)) <= FALSE * i / max(1, tried):
            last = i
    return dict(ranked[:last])


def _units_of(found: dict[int, float]) -> Callable:
    """The distinct units of each text: at most UNITS, those with most evidence first, then the longest."""
    keys = np.array(sorted(found), np.int64)
    worth = np.array([found[k] for k in keys.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = C.plain_text(batch.column(0))
            for a, b in C.chunks(text):
                names, unit, at = units(text.slice(a, b - a))
                value = np.zeros(len(names))
                if len(names) and len(keys):
                    hashes, of = fragments(names)
                    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[place] == hashes
                    np.maximum.at(value, of[hit], worth[place[hit]])
                size = np.array([len(x) for x in names], np.int64)
                own = []
                order = np.argsort(at, kind="stable")
                for part in np.split(unit[order], np.searchsorted(at[order], np.arange(1, b - a))):
                    part = np.unique(part)
                    part = part[np.lexsort((part, -size[part], -value[part]))][:UNITS]
                    own.append([names[u] for u in part.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), batch.column(1).slice(a, b - a)], ["units", "toxic"])

    return run


def _worst_units(model: Model, n: int) -> Callable:
    """The units of a task's texts with the greatest values, n of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst: dict[str, float] = {}
        memo: dict[str, float] = {}
        for batch in batches:
            column = C.plain_text(batch.column(0))
            for a, b in C.chunks(column):
                names = units(column.slice(a, b - a))[0]
                new = [x for x in _pieces(names)[0] if x not in memo]
                if len(memo) + len(new) > REMEMBERED:
                    memo.clear()
                value = model.values(new)
                memo.update(dict.fromkeys(new, 0.0))
                worst.update((new[i], float(value[i])) for i in np.flatnonzero(value > FLOOR).tolist())
                if len(worst) > 4 * n:
                    worst = dict(sorted(worst.items(), key=lambda x: (-x[1], x[0]))[:n])
        best = sorted(worst.items(), key=lambda x: (-x[1], x[0]))[:n]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.string()), pa.array([v for _, v in best], pa.float64())], ["unit", "value"])

    return run


def _text_features(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            text = C.plain_text(batch.column(0))
            for a, b in C.chunks(text):
                found = model.features(text.slice(a, b - a), memo)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(a, b - a)], ["x", "toxic"])

    return run


def _some(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows of each class, those with the least hash."""
    picks = [rows.where(F.col("toxic") == t).select("h").orderBy("h").limit(n) for t in (0, 1)]
    return rows.join(F.broadcast(picks[0].union(picks[1])), "h", "left_semi")  # at most 2 n keys


def _texts_of(sample: pa.Table) -> list[list[list[str]]]:
    """Units of the toxic and of the clean texts, in order, every distinct unit held once."""
    units_ = pa.concat_arrays(sample.column("units").chunks) if sample.num_rows else pa.array([], pa.list_(pa.string()))
    coded = units_.flatten().dictionary_encode()
    names, code, off = coded.dictionary.to_pylist(), coded.indices.to_pylist(), units_.offsets.to_numpy()
    off = (off - off[0]).tolist()
    texts: list = [[], []]
    for a, b, toxic in zip(off[:-1], off[1:], sample.column("toxic").to_pylist(), strict=True):
        texts[1 - toxic].append([names[c] for c in code[a:b]])
    return [sorted(t) for t in texts]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labels (id_col, toxic) of the documents; the caller leaves held-out labels away. The driver gives back
    what memory the fit has freed."""
    (model,) = C.released(lambda _: iter([_train(docs, labels, id_col, text_col)]))(iter(()))
    return model


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model:
    rows = _labelled(docs, labels, id_col, text_col)
    counts = {(r.toxic, r.border): r["count"] for r in rows.groupBy("toxic", (F.col("fold") == 0).alias("border")).count().collect()}
    total = {t: counts.get((t, True), 0) + counts.get((t, False), 0) for t in (0, 1)}
    given = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    share = ((given.toxic or 0) + 1) / (given.n + 2)
    if not total[0] or not total[1]:
        return Model(Landmarks(["^a$"]), np.zeros(1, np.float32), 0.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]), fitted=False)
    apart = all(counts.get(k, 0) for k in ((0, True), (1, True), (0, False), (1, False)))
    own = rows.where("fold != 0") if apart else rows
    found = evidence(own)
    sample = _some(own, SAMPLE).select("text", "toxic").mapInArrow(C.released(_units_of(found)), "units array<string>, toxic int").toArrow()
    groups = _texts_of(sample)
    del sample
    land, weights, bias = fit_units(*groups, found, [])
    clean = own.where("toxic = 0").select("text")
    worst = clean.mapInArrow(C.released(_worst_units(Model(land, weights, bias), WORST // 4)), "unit string, value double")
    worst = worst.groupBy("unit").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "unit").limit(WORST).collect()
    land, weights, bias = fit_units(*groups, found, [r.unit for r in worst])
    model = Model(land, weights, bias)
    judged = _some(rows.where("fold = 0") if apart else rows, BORDER).select("text", "toxic").mapInArrow(C.released(_text_features(model)), "x array<double>, toxic int").collect()
    judged.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.array([r.x for r in judged]), np.array([r.toxic for r in judged])
    toxic_share = total[1] / (total[0] + total[1])
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    model.border = _logistic(x, y, weight)
    return model


def _scorer(model: Model, text_at: int, names: list[str], keep: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            text = C.plain_text(batch.column(text_at))
            for a, b in C.chunks(text):
                score = model.score(text.slice(a, b - a), memo)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in keep), pa.array(score), pa.array((model.fitted & (score >= THRESHOLD)).astype(np.int32))], names)

    return run


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on; 0 if nothing was fitted)."""
    keep = [i for i, c in enumerate(docs.columns) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[i] for i in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(C.released(_scorer(model, docs.columns.index(text_col), schema.names, keep)), schema)
