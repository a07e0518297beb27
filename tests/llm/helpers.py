"""Small frames and edge cases shared by the tests of the text operators."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = "the of and tion ing her ere ent tha nth was eth for dth hat she ion int his sth ers ver wit thi oft".split()


def prose(seed: int, words: int, lines: int = 1) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(lines):
        out.append(" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)))
    return "\n".join(out)


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) as a documents table."""
    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    long = prose(7, 40_000)
    same = prose(8, 60, 5)
    return [
        (1, None, None, None),
        (None, prose(1, 50), "en", "a"),
        (None, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "de", "b"),
        (4, "...!?\n--\n", "de", None),
        (5, long, "en", "a"),
        (6, same, "en", "a"),
        (6, same, "en", "a"),
        (7, same, None, "b"),
        (8, "Ünïcödé 中文 \U0001f600 İ ß", "fr", "c"),
        (9, "a", "fr", "c"),
        (10, "x\x00y <|endoftext|> z", "en", "a"),
    ]
