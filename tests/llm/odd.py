"""Documents of every odd kind, and plain Python counterparts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_SAID = " ".join(f"w{i}" for i in range(60))


def odd_rows() -> list[tuple]:
    long = " ".join(random.Random(1).choice(["ab", "cd", "ef", "gh", "ij"]) + str(i % 97) for i in range(30_000))
    texts = [None, "", " \t\n", "word", _SAID, "x " + _SAID + " y", "é́ 中文 \u0085 \x00 ’", "same " * 500, long, "Z" * 5_000]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None)[i % 3], len(t) if t else 0) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, _SAID, None, None, None))
    rows.append((None, None, None, None, None))
    rows.append((99, "word", "en", "a", None))
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs, *names):
    """docs with more columns, named like results and helpers."""
    for n in names:
        docs = docs.selectExpr("*", f"'mine' AS `{n}`")
    return docs


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]
