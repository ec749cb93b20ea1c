"""Small documents with every awkward case, as rows and as a DataFrame."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

LICENSE = "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance. "


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(1, 8))) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, near and exact copies, shared lines, and odd texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(1, 150)) for _ in range(n)]
    base = prose(rng, 120)
    for k in range(6):  # near copies
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[5]]  # exact copies
    passage = prose(rng, 90)
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 12) for _ in range(3)]
    texts += [LICENSE + prose(rng, 20), LICENSE + prose(rng, 25), "one two", "one two", "ONE  two\n", "", None, " \n\t ", "x" * 900]
    texts += ["ab" * 400, "été ÜBER 東京 😀   d'août\r\n  end", "\x00\x1c\x85 odd", prose(rng, 3000), "a" * 5 + "é" * 700 + "b" * 5]
    ids = list(range(7, 7 + 3 * len(texts), 3))
    out = [(i, t, ("en", "de", None)[i % 3], f"src{0 if i % 2 else i % 5}", len(t or "")) for i, t in zip(ids, texts)]
    return out


def documents(spark: SparkSession, data: list[tuple], extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # columns with names that the operators use themselves
        for name in ("n", "grp", "ids", "digest", "kind", "row", "token", "weight", "score"):
            df = df.selectExpr("*", f"'own' AS {name}")
    return df.repartition(3)


def by_id(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
