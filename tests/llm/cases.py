"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, odd columns."""

import random

from pyspark.sql import functions as F

#: Column names that operators use inside.
CLASH = ["key", "id", "comp", "rep", "part", "group", "n_words", "kept", "score", "_w", "d", "tie", "row", "bands", "digest", "item_id", "count", "n"]


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def awkward_texts() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\r"), (7, "one two"), (8, "ONE two"),
        (9, prose(2, 6000)), (9, prose(2, 6000)), (10, prose(3, 30)), (None, base), (None, None), (11, "x\u00a0y \u00c9t\u00e9 " * 10),
        (12, prose(4, 40) + "\n" + prose(4, 40) + "\n" + prose(4, 40)), (13, "<|endoftext|> a<|startoftext|>b 'S don't"), (14, "\U0001f600" * 50 + " \u0301a"),
    ]


def documents(spark, rows=None):
    df = spark.createDataFrame(awkward_texts() if rows is None else rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return documents(spark, [])
