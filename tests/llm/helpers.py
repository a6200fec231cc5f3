"""Small document tables for the tests of ledgerspark.llm."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 string, place string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(spark, texts, sources=None, langs=None, ids=None):
    """Documents with extra columns whose names clash with internal ones."""
    rows = []
    for i, t in enumerate(texts):
        rows.append(
            (
                i if ids is None else ids[i],
                t,
                "en" if langs is None else langs[i],
                "src" if sources is None else sources[i],
                None if t is None else len(t),
                "extra",
                "extra",
                None,
                i,
            )
        )
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts() -> list[str | None]:
    """Nulls, blanks, repeats, long and non-ASCII texts."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [
        None, "", " \t\n", "one", "two words", "one", "ÀÉ straße 日本 🎉 ſK", "a b c \x1c d", long, long,
        "x" * 5000, "for " * 300, "A B C D E F", "a b c d e f", "́ combining", "'s don't  it's\n\n x ",
        prose(rng, 120), prose(rng, 121), None,
    ]
