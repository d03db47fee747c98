"""Small inputs for the training-data operators: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, node string, n int, size string"


def sentence(rng: random.Random, n: int) -> str:
    words = ["alpha", "beta", "gamma", "delta", "omega", "rivière", "straße", "niño", "lorem", "ipsum", "dolor", "amet", "kilo", "mega", "pico"]
    return " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n))


def hard_texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text) with the hard cases among plain ones."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "CHANGED"
    texts: list[tuple] = [(i, sentence(rng, rng.randrange(30, 200))) for i in range(40)]
    texts += [(100, base), (101, base), (102, " ".join(near)), (103, base.upper()), (104, "  " + base + "\n")]
    texts += [(110, None), (111, ""), (112, " \n\t "), (113, "one"), (114, "one two three four"), (115, "ONE"), (None, base), (None, None)]
    texts += [(120, sentence(rng, 8) + "\n" + "\n".join(["same line here"] * 5)), (121, "a" * 3000), (122, "ab " * 2000), (100, base)]
    texts += [(130, sentence(rng, 9000)), (131, "x\u2028y\x0bz é" * 10)]
    return texts


def documents(spark, rows: list[tuple]):
    """A documents table with extra columns whose names operators use themselves."""
    langs, sources = ("en", "fr", None), ("src0", "src1", None)
    full = [(i, t, langs[k % 3], sources[k % 2], len(t or ""), "x", "y", "z", k, "s") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)
