"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ROW = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, component_id string"


def words(text: str | None, fold: bool = True) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if fold else text or "")


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


def awkward() -> list[tuple]:
    """Nulls in each column, empty and blank texts, ties, repeated rows, short, long and odd texts; more columns than asked for."""
    base = prose(1, 120)
    texts = [
        (None, base), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, base), (5, base), (5, base), (6, base.upper()), (7, "one"), (8, "one"), (9, "two words"),
        (10, "Two  words "), (11, "\x1c odd\x85 ünï 漢字 \U0001f600 \x1f"), (12, "a a a a a a a a a a a a a a a a a a a a a a a a"), (13, "a " * 40), (14, edited(base, 3, 0.02)),
        (15, edited(base, 4, 0.5)), (16, " ".join(prose(k, 3000) for k in range(20))), (17, "y" * 30000), (18, prose(5, 40) + " " + base), (19, prose(6, 60)), (-3, base + " end"),
    ]
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 7 == 0 else "src", None, 7, False, 0.5, "c") for k, (i, t) in enumerate(texts)]


def documents(spark, rows: list[tuple] | None = None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([r + (None, None, None, 7, False, 0.5, "c")[: 9 - len(r)] if len(r) < 9 else r for r in rows], ROW)


def plain(spark, texts: list[str | None]):
    return documents(spark, [(i, t, "en", "s", len(t or ""), 7, False, 0.5, "c") for i, t in enumerate(texts)])
