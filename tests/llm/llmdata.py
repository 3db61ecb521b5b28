"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_words int"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), "clash", -1) for i, t in enumerate(texts)]


def prose(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed: int = 1) -> list[str | None]:
    """Nulls, empty, blank, very long, tied and repeated texts, near copies and shared passages."""
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    passage = prose(rng, 30)
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base[0].split())) for k in range(5, 25)]
    out = [None, "", "  \t\n", "one", "one two three", *base, base[3], base[3], *near]
    out += [f"{prose(rng, 25)} {passage}\n{prose(rng, 10)}" for _ in range(6)]
    out += ["Ü, " * 300, "same " * 50, prose(rng, 20_000, 3000), base[0].upper(), "a b \x1f c " * 9, None, ""]
    return out


def spark_docs(spark, data=None):
    return spark.createDataFrame(rows(awkward()) if data is None else data, DOCS)
