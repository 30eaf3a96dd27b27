"""Small document tables with the awkward cases in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, n_tokens string"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source). The extra columns
    bear names that the operators also use."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None, "x", "clash") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, words: int = 200) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))
