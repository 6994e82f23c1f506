"""Repair of conversation structure by weighted CYK parsing.

The rows of a conversation must give roles of the form (system? (user assistant)+)?, by role initials
`(s?(ua)+)?`. The repair grammar in Chomsky normal form has one symbol [p, q] for each pair of states of that
form (start, after a system row, after a user row, after an assistant row):

    [p, q] -> [p, r] [r, q]      for every state r
    [p, q] -> row                kept (cost 0), given the role user or assistant (1), or deleted (2)
    [p, q] -> nothing            or inserted rows of empty text (5 each)

A kept or rerolled row that is truncated costs 5 more; blank and duplicate rows must be deleted. A cell
[p, q] of a span holds the least (cost, audit): the cost and, of all edits that cost so much, the least string
of their initials D, I, K, R. Insertion closure puts the inserted rows before and behind every row into its
own cells. Spans are combined bottom-up by length, 1, 2, 4 and so on. One split of a span is enough: the symbols
are pairs of states, so whichever way a span is split, its cells are the same (the tests compare with a table
of all spans and splits); and of two audits of one cost neither begins with the other (each initial
has its own cost and every row one initial besides I), so the least parts make the least whole.

On Spark: equal rows of a turn are counted first. The rows are sorted by range of (conversation, turn, role,
text), so a conversation of any size is cut over several tasks; each task parses its rows and returns one
row of cells for every conversation or piece of at most `PIECE` rows. Pieces meet by conversation, a
hundredth or less of the rows, and are combined in order. Behind them the rows stream through once more to
write the repaired text and its digest (a digest over one text has one order: a task does this for one
conversation, holding a batch of rows and the audit).

Faults, the first of a row counting: blank (no character besides white space), duplicate (role and text seen
earlier in the conversation), truncated (the last character besides white space is not one of . ! ?).

Nulls: a NULL role or text is one space (so such a text is blank, such a role none of the three). A NULL
conversation id is a conversation of its own. Rows are ordered by turn, NULL first; rows of equal turn by role
and text, so repeated rows stand side by side. Only the first character of a role decides what it is. A
conversation without rows (in `conversations` of report()) has counts and cost 0, an empty audit and the digest of an empty
text. No table, no rows. Very long texts are only looked at; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows parsed together.
PIECE = 4096
#: Spans whose cells are remembered have up to so many rows.
REMEMBERED = 64

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a row of an initial leads: the language (s?(ua)+)?.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)

#: The least (cost, audit) of each symbol [p, q], as cells[4 * p + q]; None where there is none.
Cells = tuple


def _less(a, b):
    return b if a is None or (b is not None and b < a) else a


def joined(left: Cells, right: Cells) -> Cells:
    """[p, q] -> [p, r] [r, q]."""
    out: list = [None] * 16
    for p in STATES:
        for r in STATES:
            x = left[4 * p + r]
            if x is not None:
                for q in STATES:
                    y = right[4 * r + q]
                    if y is not None:
                        out[4 * p + q] = _less(out[4 * p + q], (x[0] + y[0], x[1] + y[1]))
    return tuple(out)


def _insertions() -> Cells:
    """Cells of no row: nothing, or as few inserted rows as lead from p to q."""
    out: list = [(0, "") if p == q else None for p in STATES for q in STATES]
    for _ in STATES:
        for p in STATES:
            for r in STATES:
                if out[4 * p + r] is not None:
                    for initial in "ua":
                        if (q := MOVES[initial].get(r)) is not None:
                            cost, audit = out[4 * p + r]
                            out[4 * p + q] = _less(out[4 * p + q], (cost + INSERT, audit + "I"))
    return tuple(out)


NOTHING = _insertions()


@lru_cache(64)
def row_cells(kind: str) -> Cells:
    """Cells of one row. Its kind: D if it must go, else its initial (s, u, a, or another), and ! if truncated."""
    out: list = [(DELETE, "D") if p == q else None for p in STATES for q in STATES]
    if kind != "D":
        more = TRUNCATED if kind.endswith("!") else 0
        for p, q in MOVES.get(kind[0], {}).items():
            out[4 * p + q] = _less(out[4 * p + q], (KEEP + more, "K"))
        for initial in "ua":
            for p, q in MOVES[initial].items():
                out[4 * p + q] = _less(out[4 * p + q], (REROLE + more, "R"))
    return joined(joined(NOTHING, tuple(out)), NOTHING)


def parse(kinds: tuple[str, ...]) -> Cells:
    """Cells of all rows, span by span from short to long."""
    return combined([row_cells(k) for k in kinds])


def combined(cells: list[Cells]) -> Cells:
    """Cells of neighbouring spans as one, in pairs."""
    while len(cells) > 1:
        pairs = [joined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else NOTHING


_remembered = lru_cache(1 << 14)(parse)


def _parse_piece(kinds: list[str]) -> Cells:
    """As parse(); short spans, which come again and again, are looked up."""
    return combined([_remembered(tuple(kinds[a : a + REMEMBERED])) for a in range(0, len(kinds), REMEMBERED)])


def best(cells: Cells) -> tuple[int, str]:
    """Least cost and audit from the start to an accepting state."""
    out = None
    for q in ENDS:
        out = _less(out, cells[4 * START + q])
    return out


class Repaired:
    """The repaired rows by an audit: fed with the rows in order, it calls put(role, text, edit) for each row
    that the result has."""

    def __init__(self, audit: str, put: Callable[[str, str, str], None]):
        self.audit, self.at, self.state, self.put = audit, 0, START, put

    def _out(self, role: str, text: str, initial: str, edit: str) -> None:
        self.put(role, text, edit)
        self.state = MOVES[initial][self.state]

    def _next(self) -> tuple[str, str]:
        return ("a", "assistant") if self.state == USER else ("u", "user")

    def insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            initial, role = self._next()
            self._out(role, "", initial, "I")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._out(role, text, role[0], edit)
        elif edit == "R":
            initial, name = self._next()
            self._out(name, text, initial, edit)


#: Texts without a character besides white space, and those whose last such character ends a sentence.
_BLANK = r"^[\x20\x09-\x0D]*\z"
_STOPPED = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows of conversations (conv_id, turn, role, text) with faults put in by
    crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes its [.!?] away, 3 repeats
    it, 4 makes it a user's. NULL is one space, in the key as well."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    rows = rows.where("_kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)))
    return rows.drop("col")


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, role, text) with `n`, how often each stands there, and `fault` of the first of
    them (blank, duplicate, truncated or NULL; the others are duplicates, or blank as it is)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.groupBy(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.agg(F.count("*").alias("n"))
    rows = rows.withColumn("_key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy(F.col("conv").alias("_conv"), F.col("_key").alias("_same")).agg(F.min(turn).alias("_first"))
    rows = rows.join(first, (F.col("_key") == F.col("_same")) & F.col("conv").eqNullSafe(F.col("_conv")))
    fault = F.when(F.col("text").rlike(_BLANK), "blank").when(~turn.eqNullSafe(F.col("_first")), "duplicate")
    fault = fault.when(~F.col("text").rlike(_STOPPED), "truncated")
    return rows.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


#: What a task reports of a conversation, or of a piece of it.
_PIECE = (
    "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, "
    "turns long, costs array<long>, audits array<string>"
)
_LEGAL = ("su", "ua", "au")


class Piece:
    """Rows of one conversation that are parsed together."""

    def __init__(self):
        self.kinds: list[str] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, fault: str | None, n: int = 1) -> None:
        """n equal rows of one fault."""
        if self.rows:
            self.illegal += (self.last + initial) not in _LEGAL
        else:
            self.first = initial
        self.illegal += n - 1  # equal initials
        self.last = initial
        self.rows += n
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += n * (fault == "blank")
        self.duplicate += n * (fault == "duplicate")
        self.truncated += n * (fault == "truncated")
        kind = "D" if fault in ("blank", "duplicate") else (initial or " ") + ("!" if fault else "")
        self.kinds += [kind] * n

    def report(self) -> dict:
        cells = _parse_piece(self.kinds)
        out = {k: v for k, v in vars(self).items() if k != "kinds"}
        return out | {"costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and piece of sorted rows (conv, turn, role, n, fault)."""
    task, seq = TaskContext.get().partitionId(), 0
    own, conv, out = None, None, []

    def close():
        nonlocal seq
        out.append({"conv": conv, "seq": (task << 32) + seq, "piece": own.report()})
        seq += 1

    def batch_of():
        done = pa.RecordBatch.from_pylist(out, schema)
        out.clear()
        return done

    schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("piece", _ARROW_PIECE)])
    for batch in batches:
        for c, turn, initial, n, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if own is not None and c != conv:
                close()
                own = None
            conv = c
            copies = fault if fault == "blank" else "duplicate"
            for how, m in ((fault, 1), (copies, n - 1)):
                while m:
                    if own is not None and own.rows >= PIECE:
                        close()
                        own = None
                    own = own or Piece()
                    own.add(turn, initial, how, k := min(m, PIECE - own.rows))
                    m -= k
            if len(out) >= 256:
                yield batch_of()
    if own is not None:
        close()
    if out:
        yield batch_of()


_LONG, _TEXT = pa.int64(), pa.string()
_ARROW_PIECE = pa.struct(
    [(c, _LONG) for c in ("rows", "blank", "duplicate", "truncated", "illegal")]
    + [("first", _TEXT), ("last", _TEXT), ("first_turn", _LONG), ("last_turn", _LONG), ("turns", _LONG), ("costs", pa.list_(_LONG)), ("audits", pa.list_(_TEXT))]
)


def _whole(pieces: list[dict]) -> dict:
    """What the pieces of a conversation say together."""
    out = {k: sum(p[k] for p in pieces) for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += sum((a["last"] + b["first"]) not in _LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
    timed = [p for p in pieces if p["turns"]]
    out["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - out.pop("turns") if timed else 0
    cells = [tuple(None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)) for p in pieces]
    cost, audit = best(combined(cells))
    return out | {"gaps": gaps, "cost": cost, "audit": audit}


_REPORT = "conv string, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORTED = [x.split()[0] for x in _REPORT.split(", ")]
_ROWS = "conv string, position long, role string, text string, edit string"


class _Reports:
    """One row of counts and a digest for each conversation."""

    schema = pa.schema([(c, _TEXT if c in ("conv", "audit", "repaired_sha256") else _LONG) for c in _REPORTED])

    def __init__(self):
        self.out: list[dict] = []

    def begin(self, conv, whole: dict) -> None:
        self.digest, self.some, self.row = hashlib.sha256(), False, whole | {"conv": conv}

    def put(self, role: str, text: str, edit: str) -> None:
        self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def end(self) -> None:
        self.out.append(self.row | {"repaired_sha256": self.digest.hexdigest()})


class _Rows:
    """The repaired rows themselves."""

    schema = pa.schema([("conv", _TEXT), ("position", _LONG), ("role", _TEXT), ("text", _TEXT), ("edit", _TEXT)])

    def __init__(self):
        self.out: list[dict] = []

    def begin(self, conv, whole: dict) -> None:
        self.conv, self.position = conv, 0

    def put(self, role: str, text: str, edit: str) -> None:
        self.out.append({"conv": self.conv, "position": self.position, "role": role, "text": text, "edit": edit})
        self.position += 1

    def end(self) -> None:
        pass


def _streamed(sink_of: Callable) -> Callable:
    """Reads, sorted, each conversation's pieces and then its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, pieces, repair, conv = sink_of(), [], None, None

        def finish():
            if repair is not None:
                repair.insertions()
                sink.end()

        for batch in batches:
            for c, piece, role, text, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if piece is not None:
                    if repair is not None:
                        finish()
                        repair, pieces = None, []
                    conv = c
                    pieces.append(piece)
                    continue
                if repair is None:
                    whole = _whole(pieces)
                    sink.begin(conv, whole)
                    repair = Repaired(whole["audit"], sink.put)
                for _ in range(n):
                    repair.row(role, text)
            if sink.out:
                yield pa.RecordBatch.from_pylist(sink.out, sink.schema)
                sink.out.clear()
        finish()
        if sink.out:
            yield pa.RecordBatch.from_pylist(sink.out, sink.schema)

    return run


def _parsed(rows: DataFrame) -> DataFrame:
    """Pieces and rows of the conversations, each conversation's in order."""
    spark = rows.sparkSession
    rows = C.store(faults(rows), "faults")
    n = C.partitions(spark)
    timed = F.col("turn").isNotNull().alias("_timed")
    order = ["conv", timed, "turn", "role", "text"]
    # The borders of the ranges are drawn from a sample of keys, which must not hold whole texts.
    dealt = rows.repartitionByRange(n, "conv", timed, "turn", F.left("role", F.lit(32)), F.left("text", F.lit(32)))
    dealt = dealt.sortWithinPartitions(*order).select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "fault")
    pieces = C.store(dealt.mapInArrow(C.released(_pieces), f"conv string, seq long, piece struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>"), "pieces")
    nothing = lambda kind: F.lit(None).cast(kind)
    both = pieces.select("conv", "seq", "piece", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("long").alias("n"))
    both = both.unionByName(rows.select("conv", nothing("long").alias("seq"), nothing(pieces.schema["piece"].dataType).alias("piece"), "turn", "role", "text", "n"))
    dealt = both.repartition(n, "conv").sortWithinPartitions("conv", F.col("seq").isNull(), "seq", F.col("turn").isNotNull(), "turn", "role", "text")
    return dealt.select("conv", "piece", "role", "text", "n")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its rows (conv_id, turn, role, text)."""
    found = _parsed(rows).mapInArrow(C.released(_streamed(_Reports)), _REPORT)
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows (conv_id as text, position, role, text, edit: I, K or R)."""
    return _parsed(rows).mapInArrow(C.released(_streamed(_Rows)), _ROWS).withColumnRenamed("conv", "conv_id")
