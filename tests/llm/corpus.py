"""Small documents with every awkward case, and brute-force helpers."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names clash with those of results
    T.StructField("shard", T.StringType()), T.StructField("score", T.StringType()), T.StructField("epoch", T.StringType()),
    T.StructField("start", T.StringType()), T.StructField("n_links", T.StringType()), T.StructField("n_words", T.StringType()),
])
WORDS = [a + b for a in "ka lo mi ne ru sa to vi".split() for b in "ban dor fel gim hup jat kel".split()]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + ("." if draw.random() < 0.1 else "") for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), None, "", "   \n\t ", "one two", "one two", "one two three four five six seven",
        prose(2, 6000), "same line here\n" + prose(3, 40), "same line here\n\n" + prose(4, 40), "same line here \n" + prose(5, 40),
        "same line here", "a  b\tc d \x01 \x1c! é́ <|endoftext|>\n\n\nend\n", "spam spam " * 30, "## $$ %% && " * 20,
        prose(6, 60) + "\n" + prose(7, 60) + "\n" + prose(6, 60),
    ]
    out = [(i, t, "en" if i % 3 else None, "s1" if i < 12 else ("s2" if i % 2 else None), 0, *["x"] * 6) for i, t in enumerate(texts)]
    out += [(100 + i, prose(50 + i, 30 + i), "en", "big", 0, *["x"] * 6) for i in range(40)]
    return out + [out[0], out[3]]  # repeated rows


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
