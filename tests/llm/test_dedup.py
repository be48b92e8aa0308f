"""Substring, suffix-array, line and SimHash dedup against brute force."""

import brute
import pytest
from fixtures import rows_of, same

from voxtide.llm import units
from voxtide.llm.line_dedup import line_dedup, winnow
from voxtide.llm.simhash_dedup import components, keep_one, links, segments, simhash_dedup
from voxtide.llm.substring_dedup import levels, substring_dedup
from voxtide.llm.suffix_dedup import intervals, repeat_groups, suffix_dedup


def spans(row):
    return [(s.start, s.length) for s in row.spans]


@pytest.mark.parametrize("table", ["edge", "given"])
def test_substring(request, table):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_words, r.n_removed, spans(r), r.kept_text) for r in substring_dedup(docs, min_words=35).collect()]
    same(got, brute.substring(rows_of(docs), 35))


def test_substring_levels(edge):
    assert levels(35, 20) == [18, 35] and levels(35, 9) == [9, 18, 35] and levels(5, 20) == [5] and levels(1, 1) == [1]
    for k, start in ((35, 9), (8, 20), (1, 1)):
        got = [(r.doc_id, r.n_words, r.n_removed, spans(r), r.kept_text) for r in substring_dedup(edge, min_words=k, start_words=start).collect()]
        same(got, brute.substring(rows_of(edge), k))


@pytest.mark.parametrize("table", ["edge", "given"])
def test_suffix(request, table):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_bytes, r.n_removed, spans(r), bytes(r.kept)) for r in suffix_dedup(docs, min_bytes=50).collect()]
    same(got, brute.suffix(rows_of(docs), 50))


def test_interval_tree():
    # banana: suffixes a, ana, anana, banana, na, nana
    found = {(a, b, n) for a, b, n, _ in intervals([0, 1, 3, 0, 0, 2], 1)}
    assert found == {(0, 2, 1), (1, 2, 3), (4, 5, 2)}
    assert {x[:3] for x in intervals([0, 1, 3, 0, 0, 2], 1) if x[3]} == {(0, 2, 1), (4, 5, 2)}
    assert intervals([], 1) == [] and intervals([0], 1) == []


def test_repeat_groups_have_all_occurrences(given):
    text = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(given)}
    groups = {}
    for r in repeat_groups(given, min_bytes=50).collect():
        groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
    assert groups
    for (_, n), places in groups.items():
        strings = {text[d][s: s + n] for d, s in places}
        assert len(strings) == 1 and len(places) > 1 and n >= 50
        string = strings.pop()
        everywhere = {(d, i) for d, t in text.items() for i in range(len(t) - n + 1) if t[i: i + n] == string} if len(groups) < 50 else places
        assert places == everywhere


@pytest.mark.parametrize("table", ["edge", "given"])
@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines(request, table, run):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(docs, min_run=run).collect()]
    same(got, brute.lines(rows_of(docs), run))


def long_lines():
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    one, two, short, three = word("a", 52), word("b", 30) + "\n" + word("c", 20), word("d", 49), "p q\nr\ns t"
    return [(1, one), (2, f"x y\n{one}\nz"), (3, one.replace(" ", "  ")), (4, two), (5, f"k\n{two}\n{short}"), (6, two.replace("\n", "\nm\n")), (7, short), (8, f"{one}\n{two}"),
            (9, f"{one}\n\nend"), (10, f"v\n{one}\nend"), (11, three), (12, f"{three}\nw\n{one}\n{one}"), (None, short), (13, f"{one}\nend")]


def brute_passages(rows, k, n_words):
    """Later windows of k lines, or of fewer with n_words words, go."""
    import xxhash

    seen, out = set(), [None] * len(rows)
    for n in sorted(range(len(rows)), key=lambda i: (brute.INF if rows[i]["doc_id"] is None else rows[i]["doc_id"], xxhash.xxh64_intdigest((rows[i]["text"] or "").encode()) >> 1)):
        all_lines = (rows[n]["text"] or "").split("\n")
        own, gone = [(i, brute.words(x)) for i, x in enumerate(all_lines) if brute.words(x)], set()
        for size in range(1, k + 1):
            for i in range(len(own) - size + 1):
                window = tuple(" ".join(x) for _, x in own[i: i + size])
                if size == k or sum(len(x) for _, x in own[i: i + size]) >= n_words:
                    if window in seen:
                        gone.update(j for j, _ in own[i: i + size])
                    seen.add(window)
        out[n] = (rows[n]["doc_id"], len(own), len(gone), "\n".join(x for i, x in enumerate(all_lines) if i not in gone))
    return out


def test_long_lines_are_runs(spark, edge, given):
    own = spark.createDataFrame(long_lines(), "doc_id long, text string")
    for docs in (own, edge, given):
        for k in (1, 3):
            got = [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(docs, min_run=k, min_words=50).collect()]
            same(got, brute_passages(rows_of(docs), k, 50))


def test_pipeline_cuts_long_lines(spark):
    import corpus_pipeline

    own = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in long_lines()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, own, "").collect()}
    assert got[1] == long_lines()[0][1] and got[2] == "x y\nz" and got[3] == "" and got[5] == "k\n" + long_lines()[6][1] and got[8] == "" and got[7] == got[None]


def test_winnow_guarantee():
    a, b = [9, 4, 7, 7, 1, 8, 3, 3, 2], [5, 7, 7, 1, 8, 6]
    shared = {a[p] for p, *_ in winnow(a, 3)} & {b[p] for p, *_ in winnow(b, 3)}
    assert 1 in shared
    for p, first, last in winnow(a, 3):
        assert first <= p < first + 3 and last <= p


def test_line_dedup_carries_columns(edge):
    out = line_dedup(edge, carry=("n_chars", "kept_text"))
    assert out.columns[-2:] == ["c0", "c1"] and {r.c1 for r in out.collect()} == {"clash"}


@pytest.mark.parametrize("table", ["edge", "given"])
def test_simhash(request, table):
    docs = request.getfixturevalue(table)
    got = [(r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in simhash_dedup(docs).collect()]
    same(got, brute.classes(rows_of(docs))[0])


def test_simhash_keeps_one_of_each(edge):
    rows = rows_of(edge)
    _, number = brute.classes(rows)
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(texts) == len(set(number))
    for n in set(number):
        ids = [brute.INF if r["doc_id"] is None else r["doc_id"] for r, m in zip(rows, number) if m == n]
        own = [(d, t) for d, t in texts if any(r["doc_id"] == d and r["text"] == t and m == n for r, m in zip(rows, number))]
        assert len(own) == 1 and (brute.INF if own[0][0] is None else own[0][0]) == min(ids)


def test_links_connect_all_near_marks(spark):
    import random

    import numpy as np

    rnd = random.Random(1)
    marks = [rnd.getrandbits(64) for _ in range(300)]
    hub = marks[0]
    for _ in range(200):  # one large group, and chains
        marks.append(hub ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 2))))
    for k in range(40):
        marks.append(marks[-1] ^ sum(1 << b for b in rnd.sample(range(64), 4)))
    marks = sorted(set(marks))
    v = np.array(marks, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fingerprint long")
    found = links(df, 4)
    edges = {(r.a, r.b) for r in found.collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in edges) and len(edges) < len(marks) * 64
    root = {r.node: r.root for r in components(found).collect()}
    s = v.view(np.int64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 4):
            assert root[int(s[i])] == root[int(s[i + 1 + j])]
    assert [len(segments(d)) for d in (0, 1, 2, 3, 4, 5)] == [1, 1, 2, 2, 3, 3]


def test_empty_tables(empty):
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0 and line_dedup(empty).count() == 0
    assert simhash_dedup(empty).count() == 0 and keep_one(empty).count() == 0 and repeat_groups(empty).count() == 0


def test_texts_are_shuffled_once(edge):
    plan = substring_dedup(edge)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert units.deal(edge).n >= 1
