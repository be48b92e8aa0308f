import os
import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("id", "_unit", "bucket", "kept_text", "n_words", "fingerprint", "th", "i", "_i", "c0", "_n_chars", "stratum", "shard", "queue", "seg",
                                                  "g", "lo", "hi", "n", "digest", "altered", "path", "root", "_at", "y", "h", "size", "runs", "best", "kept", "score")],
])


def edge_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() + ("\n" if rnd.random() < 0.08 else "") for _ in range(n))
    passage, lines = text(80), "\n".join(text(6) for _ in range(5))
    a, long = text(120), text(20_000)
    texts = [
        (1, None), (2, ""), (3, " \t\n\v\f\r "), (None, None), (None, a), (None, a), (4, a), (4, a), (4, text(90)), (5, a.replace(" ", "  ", 5)),
        (6, text(40) + " " + passage + " " + text(30)), (7, passage), (8, long), (9, long + " " + passage), (10, text(50) + "\n" + lines + "\n" + text(20)),
        (11, lines + "\n" + lines), (12, "x " * 300), (13, "y"), (14, "é日本 " * 60), (15, "日本語" * 400), (16, "A b C d e F " * 30), (17, "same line\n" * 12),
        (18, "a b c d"), (19, "A B C D"), (-5, passage + "\n\n" + lines), (20, "\x00\x01 zero " * 20), (21, "one two three"),
    ]
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s1", None]), None if t is None else len(t), *(["clash"] * (len(SCHEMA) - 5))) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    if not os.path.isdir(SF):
        pytest.skip("given tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")
