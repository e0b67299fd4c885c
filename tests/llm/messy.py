"""Small tables of hard cases: nulls, blanks, very long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ONE_WORD = "z" * 60_000
WORDS = "the of and river stone light dark over under long small great water fire tree leaf hill road night day".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", ","]) for _ in range(n))


TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one",
    "Two words",
    "a b c",
    "A B C",
    "▁    ﬀ 日本語 😀 é́",
    "\\ <|turn|> [INST] </s>",
    prose(1, 120),
    prose(1, 120),
    prose(1, 119) + " changed",
    prose(2, 80) + "\n" + prose(2, 80) + "\n\n" + prose(2, 80),
    "!!! ### $$$ 123 456",
    "la " * 300,
    LONG,
    ONE_WORD,
]


def rows() -> list[tuple]:
    """(doc_id, text) with a null id, a repeated id and a repeated row."""
    out = [(i, t) for i, t in enumerate(TEXTS)]
    return [*out, (None, prose(3, 60)), (4, "other text under a used id"), (9, TEXTS[9]), (9, TEXTS[9])]


def documents(spark, given=None):
    """The rows with clashing and odd extra columns."""
    data = rows() if given is None else given
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, found int, shard string, `a.b c` int, w0 int, label int, rid int, lang_pred int"
    return spark.createDataFrame([(i, t, None, "s", 1, 0.5, "x", 1, "q", 7, 1, 2, 3, 4) for i, t in data], schema)


def empty(spark):
    return documents(spark, [])
