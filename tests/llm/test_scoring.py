"""Periodic runs, Merkle proofs and toxic sentences against brute force and held-out rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from fixtures import rows_of, same
from pyspark.sql import functions as F

from voxtide.llm import merkle as M
from voxtide.llm import runs as R
from voxtide.llm import toxicity as T
from voxtide.llm.queries import QUERIES, with_planted_runs


# ---- periodic runs ---------------------------------------------------------------

def runs_in(w, least=6, times=4):
    """Every period by itself: stretches in which words a period apart are equal."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(text, least=6, times=4):
    w = brute.words(text)
    found = runs_in(w, least, times)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return len(w), found, best, " ".join(x for i, x in enumerate(w) if i not in gone)


def told(r):
    return r["n_words"], [tuple(x.values()) for x in r["runs"]], r["best"] and tuple(r["best"].values()), r["kept"]


def test_runs_of_random_texts():
    rnd = random.Random(4)
    for _ in range(60):
        texts = [None, ""]
        for _ in range(4):
            w = []
            while len(w) < rnd.randint(0, 70):
                w += [rnd.choice("abc") for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 8)
            texts.append(" ".join(w))
        batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
        for least, times in ((6, 4), (2, 2), (5, 3)):
            assert [told(r) for r in R._runs(batch, least, times).to_pylist()] == [collapsed(t, least, times) for t in texts]


@pytest.mark.parametrize("table", ["edge", "given"])
def test_runs(request, table):
    docs = with_planted_runs(request.getfixturevalue(table))
    got = [(r.doc_id, *told(r.asDict(True))) for r in R.find_runs(docs).collect()]
    rows = rows_of(docs)
    want = [(r["doc_id"], *collapsed(r["text"])) for r in rows if len(brute.words(r["text"])) < 3000]
    assert len(got) == len(rows)
    same([r for r in got if r[1] < 3000], want)


def test_planted_words_repeat(spark):
    text = " ".join(f"w{i}" for i in range(200))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    df = spark.createDataFrame([(i, text) for i in ids] + [(ids[0], None), (None, text), (ids[1], " \n")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in with_planted_runs(df).collect()}
    for i in ids:
        g, w = zlib.crc32(str(i).encode()) // 10, text.split()
        a = g % 200
        p = 1 + (200 - a) // (3 + g % 8)
        assert (i, " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, 200)])) in got
    assert {(ids[0], None), (None, text), (ids[1], " \n")} <= got


def test_long_periodic_texts_stay_cheap():
    for text in ("a " * 30_000, "a b " * 20_000, " ".join(str(i % 997) for i in range(30_000))):
        r = R._runs(pa.record_batch({"id": [1], "text": [text]}), 6, 4).to_pylist()[0]
        assert len(r["runs"]) == 1 and r["best"]["length"] == r["n_words"] and len(r["kept"].split()) == r["best"]["period"]
    with pytest.raises(ValueError):
        R.find_runs(None, times=1)


# ---- Merkle proofs ---------------------------------------------------------------

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes, arity):
    """Root, and the siblings (left, right) of every leaf from the leaf up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // arity * arity
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1: a + arity])))
            at[i] = p // arity
        nodes = [sha("".join(nodes[a: a + arity])) for a in range(0, len(nodes), arity)]
    return nodes[0], paths


def proofs_of(rows, change, arity):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(told(r[f]) for f in M.FIELDS))
    groups = {}
    for r in rows:
        own, other = leaf(r), leaf({**r, "text": change(r["text"])})
        groups.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), own, "" if other == own else other, r["doc_id"]))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for k in keys:
        groups[k].sort()
        built[k] = tree([own for _, own, _, _ in groups[k]], arity)
    root, above = tree([built[k][0] for k in keys], arity)
    for k, top in zip(keys, above):
        for (_, own, other, doc), path in zip(groups[k], built[k][1]):
            h = other or own
            for a, b in path + top:
                h = sha(a + h + b)
            yield doc, own, built[k][0], root, sha("".join(a + b for a, b in path + top)), h


@pytest.mark.parametrize("table", ["edge", "given"])
@pytest.mark.parametrize("arity", [2, 3])
def test_merkle(request, table, arity):
    docs = request.getfixturevalue(table)
    out = M.merkle_proofs(docs, arity=arity, altered={"text": F.translate(docs["text"], "ae", "")})
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", M.proof_digest("path"), M.fold(F.coalesce("altered_leaf", "leaf"), "path")).collect()]
    want = list(proofs_of([r.asDict() for r in docs.select(*M.FIELDS).collect()], lambda t: t and t.replace("a", "").replace("e", ""), arity))
    same(got, want)


def test_merkle_of_one_row_and_of_one_group(spark):
    one = spark.createDataFrame([(5, "t", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r, = M.merkle_proofs(one).collect()
    assert r.leaf == r.subroot == r.root and r.path == [] and r.altered_leaf is None
    assert r.leaf == sha("1:5--1:11:t")
    many = spark.range(0, 82).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    rows = M.merkle_proofs(many).collect()
    assert len(rows) == 82 and {len(r.path) for r in rows} == {5} and {r.root for r in rows} == {rows[0].subroot}


def test_any_change_breaks_the_proof(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    out = M.merkle_proofs(docs, altered={"text": changed})
    ok = out.select("doc_id", (M.fold(F.coalesce("altered_leaf", "leaf"), "path") == F.col("root")).alias("ok")).collect()
    assert all(r.ok == (r.doc_id % 3 != 0) for r in ok)


# ---- toxic sentences -------------------------------------------------------------

def test_sentences_and_features():
    bags = T.bags_of(pa.array(["Ab cd. Ab?", None, "  ...", "ÉTÉ\nété", "x"]))
    assert bags.text.tolist() == [0, 0, 3, 3, 4] and bags.n == 5
    assert bags.start.tolist() == [0, 7, 0, 6, 0] and bags.end.tolist() == [5, 9, 5, 11, 1]
    parts = [bags.features[a:b].tolist() for a, b in zip(bags.first[:-1], bags.first[1:])]
    assert parts[2] == parts[3] and parts[0][:3] == parts[1] and len(parts[0]) == 6
    both = T.joined([bags, T.bags_of(pa.array([None])), bags])
    assert both.n == 11 and both.text.tolist() == [0, 0, 3, 3, 4, 6, 6, 9, 9, 10] and both.features.tolist() == bags.features.tolist() * 2
    assert np.diff(both.first).tolist() == np.diff(bags.first).tolist() * 2
    long = T.bags_of(pa.array(["insulting insulted"])).features.reshape(2, 3)
    assert long[0, 1] == long[1, 1] and long[0, 2] == long[1, 2] and long[0, 0] != long[1, 0]


def test_gradient_is_that_of_the_noisy_or():
    rnd = np.random.default_rng(1)
    z, text, y = rnd.normal(-1, 1, 9), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1, 0, 1, 0])

    def loss(z):
        p = 1 / (1 + np.exp(-z))
        whole = np.array([1 - np.prod(1 - p[text == i]) for i in range(4)])
        assert np.allclose(whole, T.noisy_or(p, text, 4))
        return -sum(np.log(w) if t else np.log(1 - w) for w, t in zip(whole, y))

    slope = T.gradient(1 / (1 + np.exp(-z)), text, y)
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-6
        assert abs((loss(z + step) - loss(z - step)) / 2e-6 - slope[i]) < 1e-5


@pytest.fixture(scope="module")
def insults(spark):
    """Texts of 3 to 12 sentences; toxic ones hold one or two with a bad word."""
    rnd = random.Random(8)
    words, bad = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"], ["vile", "rotten", "foul"]
    rows, where = [], {}
    for i in range(1500):
        toxic = i % 4 == 0
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(4, 12))) for _ in range(rnd.randint(3, 12))]
        if toxic:
            k = rnd.randrange(len(parts))
            parts[k] = parts[k] + " " + rnd.choice(bad)
            where[i] = k
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), where


def test_learns_and_locates(insults):
    docs, labels, where = insults
    model = T.train(docs, labels.where("doc_id % 5 <> 0"))
    rows = [r for r in T.toxic_sentences(docs, *model).join(docs, "doc_id").join(labels, "doc_id").collect() if r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) >= 0.98 * len(rows)
    right = 0
    for r in rows:
        if r.toxic and r.score >= 0.5:
            spans = [r.text.encode()[s.start: s.start + s.length].decode() for s in r.sentences]
            right += r.text.split(". ")[where[r.doc_id]].rstrip(".") in spans
    assert right >= 0.95 * sum(r.toxic for r in rows)
    assert all(abs(r.score) <= 1 and (r.sentences or r.score < 0.5) for r in rows)


def test_sample_is_bounded(insults):
    docs, labels, _ = insults
    assert T.sample_of(docs, labels, "doc_id", "text", "toxic", T.Sample(rows=100)).count() == 100
    few = T.sample_of(docs.union(docs), labels, "doc_id", "text", "toxic", T.Sample(bytes=20_000)).selectExpr("sum(length(text)) b", "count(*) n", "count(distinct id) d").first()
    assert 18_000 < few.b <= 20_000 and few.n == few.d
    none = T.sample_of(docs, labels, "doc_id", "text", "toxic", T.Sample(row_bytes=3))
    assert none.count() == 0


def test_toxic_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (10, None), (77, 1)], "doc_id long, toxic int")
    model = T.train(edge, labels)
    rows = T.toxic_sentences(edge, *model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {(r.score, r.n_sentences, tuple(r.sentences)) for r in rows if r.doc_id in (1, 2, 3)} == {(0.0, 0, ())}
    weights, bias = T.train(empty, labels)
    assert not weights.any() and T.toxic_sentences(empty, weights, bias).count() == 0
    assert R.find_runs(empty).count() == 0 and M.merkle_proofs(empty).count() == 0
    assert T.toxic_sentences(edge.where("doc_id = 8"), weights, 5.0).first().score > 0.99


# ---- the registered queries --------------------------------------------------------

CONTRACTS = {
    "op11_toxic_sentences": "doc_id bigint, held_out boolean, score double, predicted int",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, name):
    out = QUERIES[name](spark, SF)
    want = [tuple(x.split(" ")) for x in CONTRACTS[name].split(", ")]
    assert out.dtypes[:len(want)] == want
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        crc = zlib.crc32(str(r.doc_id).encode())
        if name.startswith("op11"):
            assert r.held_out == (crc % 5 == 0) and r.predicted == int(r.score >= 0.5)
        if name.startswith("op12"):
            assert (r.start is None) == (r.n_runs == 0) and (r.n_runs == 0 or r.exponent_milli == 1000 * r.length // r.period)
        if name.startswith("op13"):
            assert r.verified or crc % 2 == 0
