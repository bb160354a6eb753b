"""Fixtures shared by the tests of the training-data operators."""

import random

SYLLABLES = ["the ", "of ", "ing", "é", "tion ", "er ", "a", "\n", "b. ", "and "]

# columns that carry names of results or of intermediate columns
CLASHES = {
    "size": 1, "copies": 2, "kept": True, "n_words": 3, "_row": "r", "_th": 4, "_hash": 5, "group": "g", "chunk": 6, "blob": "b",
    "spans": "s", "base": "x", "quality": 0.5, "component_id": 7, "target": 1.0, "offset": 0.0, "n": 8, "cls": "c", "start": 9,
}


def random_texts(seed: int, n: int = 60) -> list[str]:
    """Texts that share passages of all lengths."""
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(SYLLABLES) for _ in range(k))
    base = [word(300) for _ in range(4)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            b = rnd.choice(base)
            s = rnd.randint(0, len(b) - 1)
            t += b[s:s + rnd.randint(1, 600)] + rnd.choice(["", "X", "é ", word(40)])
        out.append(t)
    return out


def edge_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empties, repeats, ties and long texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (None, "the of and", "a"), (None, None, None), (4, "one", "a"),
        (5, "same text here and there again", "b"), (5, "same text here and there again", "b"), (6, "same text here and there again", "b"),
        (7, long, "a"), (8, long, None), (9, "x" * 50_000, "c"), (10, "ab " * 2_000, "c"), (11, "All rights reserved. a@b.co +1 (386) 555-3733", "é"),
    ]


def documents(spark, rows, extra: bool = False):
    """A documents table of (doc_id, text, source) rows."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({"lang": F.lit("en"), "n_chars": F.char_length("text").cast("long")})
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if extra else df


def sort_key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=sort_key)
