"""Small tables with everything that operators must take: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing ion er th re an on at".split(), "de": "sch ein ung der die ich keit heit ver ge".split(), "fr": "eau oi le que les ment ai ou re pa".split()}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    s = SYLLABLES[lang]
    return ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, lang: str = "en", n: int = 60) -> str:
    out, line = [], []
    for w in words(rng, lang, n):
        line.append(w)
        if len(line) > 11:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line) + "."])


def odd_documents(spark):
    """Nulls in any column, empty text, blanks, a very long text, repeated rows, extra columns with names of ours."""
    rng = random.Random(1)
    rows = [
        (1, prose(rng), "en", "a", 10), (1, prose(random.Random(2)), "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "de", "b", 4), (None, "no id here at all", "en", "b", 5),
        (5, "word " * 30_000, "en", "a", 150_000), (6, prose(rng, "de"), "de", None, 9), (6, None, None, None, None), (7, "ß 🙂 é\u0000x", "fr", "c", 3), (8, prose(rng, "fr"), "fr", "c", 3), (8, prose(random.Random(9), "fr"), "fr", "c", 3),
    ]
    rows += [(9, "same text for two rows of one id", "en", "a", 1)] * 2
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as score", "1 as held_out", "'k' as copy", "2 as node", "'t' as found", "0 as curve_key", "'p' as prefix", "'z' as _text", "1 as rate", "3 as u")


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
