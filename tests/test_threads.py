"""Reply threads against a walk that judges one row after the other."""

import random

import pytest
from pyspark.sql import functions as F

from voxtide.operators import language, threads

SCHEMA = "post_id string, parent_post_id string, node_type string, text string, lang string, ingest_seq long"


@pytest.fixture(scope="module")
def detector(spark):
    rows = [("en", "the cat sat on the mat and the dog ran"), ("fr", "le chat est sur la table avec le chien")]
    return language.language_profile(spark.createDataFrame(rows, "lang string, text string"), ["en", "fr"])


def fuzzy(text):
    return "".join(c for c in text.lower() if c.isalnum() or c == " ").strip()


def walk(rows, depth=6):
    """Posts first, then every accepted post's thread, each reply before those to it."""
    memory, out = {}, {}
    kids = {}
    for r in sorted(rows, key=lambda r: r[5]):
        kids.setdefault(r[1], []).append(r)

    def accept(r):
        text, lang = r[3], r[4]
        if len(text.strip()) < 15 or lang != "en" or "buy now" in text.lower():
            return False
        return memory.setdefault(fuzzy(text), text) == text

    def below(node, step):
        for r in kids.get(node, []) if step <= depth else []:
            if r[2] == "threadViewPost" and accept(r):
                out[r[0]] = step
                below(r[0], step + 1)

    for post in [r for r in kids.get(None, []) if accept(r)]:
        below(post[0], 1)
    return out


def found(spark, detector, rows, depth=6):
    df = spark.createDataFrame(rows, SCHEMA)
    out = threads.judged_threads(df, detector, F.col("node_type") == "threadViewPost", depth).collect()
    assert all(r.text for r in out)
    return {r.post_id: r.depth for r in out}


def test_pruned_rows_enter_no_memory(spark, detector):
    t, u = "we all like useful tools", "another opinion about tools"
    rows = [("p", None, "threadViewPost", "a post that starts a thread", "en", 0),
            ("r1", "p", "threadViewPost", t, "en", 1), ("r2", "p", "threadViewPost", t + "!", "en", 2),
            ("c1", "r2", "threadViewPost", u + ".", "en", 3), ("r3", "p", "threadViewPost", u, "en", 4), ("r4", "p", "threadViewPost", u + ".", "en", 5),
            ("c4", "r4", "threadViewPost", t + "?", "en", 6), ("c3", "r3", "threadViewPost", "a reply below the third one", "en", 7)]
    assert found(spark, detector, rows) == walk(rows) == {"r1": 1, "r3": 1, "c3": 2}


def test_posts_are_remembered_before_replies(spark, detector):
    t = "a text that a later post repeats"
    rows = [("p1", None, "threadViewPost", "the first of the two posts", "en", 0), ("r1", "p1", "threadViewPost", t + "!", "en", 1),
            ("p2", None, "threadViewPost", t, "en", 2), ("r2", "p2", "threadViewPost", t, "en", 3), ("p3", None, "threadViewPost", t + ".", "en", 4),
            ("r3", "p3", "threadViewPost", "below a rejected post", "en", 5), ("b", "p1", "blockedPost", "a blocked reply is no reply", "en", 6)]
    assert found(spark, detector, rows) == walk(rows) == {"r2": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_match_a_sequential_walk(spark, detector, seed):
    rng = random.Random(seed)
    texts = [f"opinion number {i} about the tools" for i in range(12)]
    rows = []
    for i in range(600):
        # one post owns a third of all rows, and chains run deeper than the limit
        parent = None if i < 5 else "0" if rng.random() < 0.33 else str(rng.randrange(max(0, i - 25), i))
        text = rng.choice(texts) + rng.choice(["", "", "!", "."]) if rng.random() < 0.6 else f"a text of its own {i}"
        if rng.random() < 0.05:
            text = rng.choice(["short", text + " Buy now!"])
        rows.append((str(i), parent, "blockedPost" if rng.random() < 0.05 and parent else "threadViewPost", text, "fr" if rng.random() < 0.05 else "en", i))
    assert found(spark, detector, rows) == walk(rows)


def test_no_rows_and_no_replies(spark, detector):
    assert found(spark, detector, [("p", None, "threadViewPost", "a post without any reply", "en", 0)]) == {}
    empty = spark.createDataFrame([], SCHEMA)
    assert threads.judged_threads(empty, detector, F.lit(True)).count() == 0
