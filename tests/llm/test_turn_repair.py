import hashlib
import itertools
import random
import re
import zlib

import pytest

from turnstile.llm import common, turn_repair
from turnstile.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, more string"
WHITE = " \t\n\v\f\r"


def cheapest(kinds):
    """(cost, audit) by trying every edit of every row, left to right; at most two rows are inserted at a place."""
    states = {"": {(0, "")}}  # initials of the result so far
    for i, kind in enumerate([*kinds, None]):
        for _ in range(2):
            grown = {k: set(v) for k, v in states.items()}
            for done, costs in states.items():
                for new in "ua":
                    grown.setdefault(done + new, set()).update((c + 5, a + "I") for c, a in costs)
            states = {k: {min(v)} for k, v in grown.items() if re.fullmatch("(s?(ua)*u?)?", k)}
        if kind is None:
            break
        after = {}
        for done, costs in states.items():
            for c, a in costs:
                after.setdefault(done, set()).add((c + 2, a + "D"))
                if kind != "D":
                    more = 5 if kind.endswith("!") else 0
                    after.setdefault(done + kind[0], set()).add((c + more, a + "K"))
                    for new in "ua":
                        after.setdefault(done + new, set()).add((c + more + 1, a + "R"))
        states = {k: {min(v)} for k, v in after.items() if re.fullmatch("(s?(ua)*u?)?", k)}
    return min(x for k, v in states.items() if re.fullmatch("(s?(ua)+)?", k) for x in v)


def every_split(kinds):
    """The table of all spans, every split of each tried."""
    n, cells = len(kinds), {}
    for i, k in enumerate(kinds):
        cells[i, i + 1] = turn_repair.row_cells(k)
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            parts = [turn_repair.joined(cells[i, m], cells[m, i + size]) for m in range(i + 1, i + size)]
            assert all(p == parts[0] for p in parts)  # one split is enough
            cells[i, i + size] = parts[0]
    return cells[0, n] if n else turn_repair.NOTHING


KINDS = ["s", "u", "a", "x", "s!", "u!", "a!", "x!", "D"]


def test_cells_equal_all_spans_and_plain_search():
    rng = random.Random(3)
    some = [k for n in range(4) for k in itertools.product(KINDS, repeat=n)]
    some += [tuple(rng.choice(KINDS if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(4, 12))) for _ in range(250)]
    for kinds in some:
        cells = turn_repair.parse(kinds)
        assert turn_repair.best(cells) == cheapest(kinds), kinds
        if len(kinds) > 3:
            assert cells == every_split(kinds)


def plain_report(turns):
    """conv_id -> the columns of the report, one conversation after the other."""
    out = {}
    by = {}
    for conv, turn, role, text in turns:
        rows = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            solid = text.strip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds.append("D" if fault in ("blank", "duplicate") else (role[:1] or "-") + ("!" if fault else ""))
        cost, audit = cheapest(kinds)
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turned = [r[0] for r in rows if r[0] is not None]
        gaps = max(turned) - min(turned) + 1 - len(set(turned)) if turned else 0
        lines, at, state = [], 0, ""
        for edit in audit:
            _, role, text = rows[at] if edit != "I" else (None, None, "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
            state = role[:1]
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "why", "  ", None, "", "ü? \n", "Well. ", "say \u0085"]), "m") for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(500, t, "ua"[t % 2] == "u" and "user" or "assistant", f"turn {t}.", "m") for t in range(60)]  # long
    rows += [(501, 1, "user", "same.", "m")] * 40 + [(501, None, "assistant", "no turn.", "m"), (501, 2, "assistant", "x" * 5000, "m")]
    rows += [(None, None, None, None, None), (None, 3, "user", "who?", None), (502, None, "user", "a.", "m"), (502, None, "assistant", "b", "m")]
    rows += [(503, 2**62, "user", "far.", "m"), (503, 0, "assistant", "near.", "m")]
    return rows


def checked(spark, rows):
    turns = common.prepare(spark).createDataFrame(rows, SCHEMA)
    got = turn_repair.report(turn_repair.damaged(turns), turns).collect()
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r.conv_id: tuple(r[f] for f in fields) for r in got}
    assert len(found) == len(got)
    want = plain_report([r[:4] for r in rows])
    assert found == want, [(k, found.get(k), want[k]) for k in want if found.get(k) != want[k]][:3]


def test_odd_conversations(spark):
    checked(spark, odd_turns())


def test_conversations_in_pieces(spark, monkeypatch):
    """Cut at a few rows, every conversation is combined from many pieces (the tasks see the same number)."""
    rows = [r for r in odd_turns() if r[0] in (None, 500, 501, 502)]
    turns = common.prepare(spark).createDataFrame(rows, SCHEMA)
    faulty = turn_repair.faults(turn_repair.damaged(turns)).collect()
    order = sorted(faulty, key=lambda r: (r.conv or "", r.turn is not None, r.turn or 0, r.role.encode(), r.text.encode()))
    for size in (1, 2, 7):
        monkeypatch.setattr(turn_repair, "PIECE", size)
        by = {}
        for r in order:
            own = by.setdefault(r.conv, [turn_repair.Piece()])
            for how, m in ((r.fault, 1), (r.fault if r.fault == "blank" else "duplicate", r.n - 1)):
                for _ in range(m):
                    if own[-1].rows == size:
                        own.append(turn_repair.Piece())
                    own[-1].add(r.turn, r.role[:1], how)
        want = plain_report([r[:4] for r in rows])
        for conv, own in by.items():
            w = turn_repair._whole([p.report() for p in own])
            got = tuple(w[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
            assert got == want[None if conv is None else int(conv)][:7]


def test_no_rows(spark):
    empty = common.prepare(spark).createDataFrame([], SCHEMA)
    assert turn_repair.report(turn_repair.damaged(empty), empty).collect() == []
    # All rows of a conversation dropped.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    checked(spark, [(gone, 0, "user", "a.", None)])


def test_repaired_rows_alternate(spark):
    turns = common.prepare(spark).createDataFrame(odd_turns(), SCHEMA).drop("more")
    by = {}
    for r in turn_repair.repaired(turns).collect():
        by.setdefault(r.conv_id, []).append((r.position, r.role, r.edit))
    for rows in by.values():
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role, _ in sorted(rows)))


@pytest.mark.parametrize("name", ["op12_turn_repair"])
def test_whole_table(spark, sf_dir, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == plain_report(rows)
