"""Small tables with the awkward rows that every operator must take."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, shard int, rank int, score double, length long, component_id long, set_id string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, schema=SCHEMA):
    """rows of (doc_id, text[, source]); the columns with clashing names are filled with noise."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None,
             "k", -1, 7, 0.25, 3, -5, "x") for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(long_words=30_000):
    """Nulls, empty and blank texts, one very long text, repeated rows, ties, copies and near copies."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
        (8, "One"), (9, "two words"), (10, prose(2, long_words)), (11, base + " " + prose(3, 50)),
        (None, base), (None, None), (12, "é ü ß 日本 “quoted” <|endoftext|> it's 3½"), (13, prose(3, 50)),
        (14, "x " * 50), (15, prose(4, 13)), (16, "before " + prose(4, 13) + " after"),
    ]
