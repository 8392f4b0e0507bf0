"""Small tables with every kind of odd row."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string, fp int, c0 int"


def docs(spark, rows, schema=DOCS):
    """(doc_id, text) pairs as a documents table with extra, clashing columns."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, None) for i, t in rows], schema)


def odd_rows(seed: int = 1):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}é" for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = sentence(30_000)
    shared = sentence(70)
    rows = [(k, sentence(rng.randrange(5, 200))) for k in range(30)]
    rows += [(30 + k, f"{sentence(20)}\n{shared}  {sentence(15)}") for k in range(6)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, long), (43, long + " end"), (44, "a " * 500), (45, "a " * 300)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "Ünï\x0bcode\x0cwords 🙂 \x1c x"), (54, "x" * 50_000)]
    rows += [(None, shared), (None, None), (3, rows[3][1])]
    return rows


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
