"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words bigint, "
          "_text string, _row bigint, _id bigint, cleaned string, row_key bigint")


def frame(spark, rows):
    """(doc_id, text[, source]) rows under the columns of documents and some with clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), 0.5, -1, "x", -1, -1, "x", -1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edges():
    long_text = prose(99, 30_000, 5_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One."), (4, "One."), (None, "One."), (None, None),
        (5, prose(5, 120)), (6, prose(5, 120)), (6, prose(5, 120)), (7, "é ü ñ \U0001f600 x\x00y"),
        (8, "same " * 300), (9, "a b " * 200), (10, long_text), (11, long_text + " tail"),
    ]


def keyed(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
