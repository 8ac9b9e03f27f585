"""Documents for the text operators: hand-made cases, and random texts with planted copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ("edge", "h", "size", "n", "fp", "_drop", "_id", "kept_text", "kept_id", "position", "bucket", "row", "a.b")


def documents(spark, texts, clashes: bool = False):
    """texts: (doc_id, text) or (doc_id, text, source)."""
    rows = [(t[0], t[1], "en", t[2] if len(t) > 2 else f"s{(t[0] or 0) % 3}", len(t[1] or "")) for t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


def corpus(n: int = 60, seed: int = 0, words: int = 80) -> list[tuple[int, str]]:
    """Random texts; some are exact copies, near copies, or share a long passage."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiéß", k=rng.randint(1, 9))) for _ in range(400)]
    make = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, out = make(35), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            text = out[-1][1]
        elif kind == 2 and len(out) > 1:
            w = out[-2][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"{make(rng.randint(0, 30))}\n{passage}  {make(rng.randint(0, 30))}"
        else:
            text = make(rng.randint(1, words)) + rng.choice(["", ".\n", "\t x"])
        out.append((i, text))
    return out


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (7, "<|endoftext|> a\u0301 日本語 \u00a0x"), (8, "word " * 3000), (9, "x" * 5000)]
