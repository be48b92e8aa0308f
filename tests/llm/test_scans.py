"""Quality rules, sharding, license scans, packing, token counts and
decontamination against brute force."""

import collections
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from fixtures import rows_of, same
from pyspark.sql import functions as F

from voxtide.llm import decontaminate as D
from voxtide.llm import license_scan as L
from voxtide.llm import quality_rules as Q
from voxtide.llm.packing import Mixture, WordEncoder, pack
from voxtide.llm.sharding import hilbert_index, hilbert_shards, write_shards
from voxtide.llm.token_counts import PrefixCounter, chars_within, prefix_counts, tokens_at

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


# ---- quality rules -------------------------------------------------------------

def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("table", ["edge", "given"])
def test_quality_counts(request, spark, table):
    docs = request.getfixturevalue(table)
    got = [tuple(r) for r in Q.quality_rules(docs, labels_of(spark, [])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    same(got, [(r["doc_id"], *brute.quality_counts(r["text"])) for r in rows_of(docs)])


def test_binomial_tail_is_exact():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (60, 0, 0.05), (200, 12, 0.04), (5, 5, 0.9), (7, 9, 0.1)):
        want = sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
        assert abs(Q.binomial_tail(k, n, p) - want) < 1e-9


def test_certified_cutoffs_bound_false_rejections():
    n, g = 4000, len(Q.GRID)
    none, all_bad = np.zeros(g, int), np.full(g, 500)
    risky = np.maximum(np.arange(g) - 3, 0) * 40  # stricter cutoffs reject more good rows
    table = {("en", r): (none, np.zeros(g, int), n, 500, none, np.array([n])) for r in Q.RULES}
    table["en", "symbols"] = (risky, np.minimum(500, np.arange(1, g + 1) * 60), n, 500, risky, np.array([n]))
    table["de", "symbols"] = (none, all_bad, n, 500, none, np.array([100]))  # too few labels to certify
    cuts = Q.certify(table, Q.Risk())
    assert set(cuts) == {("en", "symbols")}
    at = Q.GRID.index(cuts["en", "symbols"])
    level, limit = 0.05 / len(table), 0.02 / len(Q.RULES)
    assert Q.binomial_tail(int(risky[at]), n, limit) <= level and all(Q.binomial_tail(int(risky[i]), n, limit) <= level for i in range(at))
    assert Q.certify({}, Q.Risk()) == {}


def make_labelled(spark, n=9000):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "#" * bad for w in words), "en" if i % 3 else "de"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0, "clash"))
    labels += [(None, 1, 0, ""), (3, None, 0, ""), (0, 0, 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels_of(spark, labels)


def test_rules_reject_junk_and_keep_the_good(spark):
    docs, labels = make_labelled(spark)
    got = {r.doc_id: (r.kept, r.failed_rule) for r in Q.quality_rules(docs, labels).collect()}
    assert len(got) == 9000 and all(got[i][0] == bool(i % 5) for i in got)
    assert {rule for kept, rule in got.values() if not kept} == {"symbols"}
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i][0]}


def test_each_stratum_is_certified_by_its_own_good_rows(spark):
    """In "en" symbols mark junk; in "no labels" and "few" good rows have them too."""
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(8300):
        stratum = "en" if i < 8000 else "few" if i < 8200 else "no labels"
        junk = stratum == "en" and i % 5 == 0
        rows.append((i, " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) + "#" * (junk or stratum != "en") for _ in range(60)), stratum))
        if stratum == "en" or stratum == "few" and i % 50 == 0:
            labels.append((i, int(not junk), 0, ""))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels_of(spark, labels)
    assert {r.doc_id for r in Q.keep_good(docs, known).collect()} == {i for i in range(8300) if i >= 8000 or i % 5}
    assert {r.doc_id for r in Q.quality_rules(docs, known).where("not kept").collect()} == {i for i in range(0, 8000, 5)}


def test_every_stratum_that_can_pass_is_tested(spark):
    strata, good = 1100, 80
    rows = spark.range(strata * (good + 20)).selectExpr("id", f"concat('s', cast(id % {strata} as string)) stratum", f"cast(id < {strata * good} as int) quality")
    counts = rows.select("id", "stratum", *[F.lit(60 if c == "n_words" else 0).cast("long").alias(c) for c in Q.COUNTS if c != "n_symbols"],
                         F.when(F.col("quality") == 0, 60).otherwise(0).cast("long").alias("n_symbols"))
    cuts = Q.thresholds(counts, rows.select(F.col("id").alias("doc_id"), "quality"), risk=Q.Risk(reject=0.5)).collect()
    assert len(cuts) == strata and all(r.cut_symbols == Q.GRID[0] and r.cut_bangs is None for r in cuts)


def test_keep_good_matches_verdicts(edge, spark):
    labels = labels_of(spark, [(4, 1, 0, ""), (12, 0, 0, "")])
    kept = Q.keep_good(edge, labels)
    assert kept.schema == edge.schema
    want = [r["doc_id"] for r in Q.quality_rules(edge, labels).where("kept").collect()]
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(map(repr, want))


# ---- sharding ------------------------------------------------------------------

@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (1, 4)])
def test_hilbert_curve_visits_all_cells_by_single_steps(spark, axes, bits):
    points = [F.pmod(F.shiftright("id", bits * i), F.lit(1 << bits)) for i in range(axes)]
    rows = sorted((r.h, tuple(r.p)) for r in spark.range((1 << bits) ** axes).select(hilbert_index(points, bits).alias("h"), F.array(*points).alias("p")).collect())
    assert [h for h, _ in rows] == list(range(len(rows)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(rows, rows[1:]))


@pytest.mark.parametrize("table", ["edge", "given"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    got = hilbert_shards(docs, shards=7).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got],
         [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows_of(docs)])
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) <= set(range(7)) and max(sizes.values()) - min(sizes[s] for s in range(7)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_strings_are_cut_by_their_whole_value(spark):
    from voxtide.llm.sharding import _string_level, string_cuts

    rows = [(i, "x", f"common_crawl_202{3 + i % 2}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = hilbert_shards(docs, dims=("source",), shards=2).join(docs, "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert [r.n for r in got] == [1, 1]
    rnd = random.Random(5)
    names = [None, "", "a", "hot"] + [f"https://host{i}.example/path" for i in range(40)] + ["ähnlich", "日本"]
    values = [rnd.choice(names) if rnd.random() < 0.7 else "hot" for _ in range(1500)]
    table = spark.createDataFrame([(v, rnd.choice("pq")) for v in values], "d0 string, d1 string")
    key = lambda v: (v is not None, (v or "").encode())
    for levels in (2, 16):
        want = collections.Counter(sorted(values, key=key)[-(-k * len(values) // levels) - 1] for k in range(1, levels))
        cuts = string_cuts(table, ["d0", "d1"], levels)
        assert cuts["d0"] == sorted(want.items(), key=lambda x: key(x[0])) and sum(k for _, k in cuts["d1"]) == levels - 1
        got = {r[0]: r[1] for r in table.select("d0", _string_level("d0", cuts["d0"])).distinct().collect()}
        assert got == {v: sum(k for c, k in want.items() if key(c) < key(v)) for v in set(values)}
    assert string_cuts(table.limit(0), ["d0"], 16) == {"d0": []} and string_cuts(table, [], 16) == {}


def test_written_shards_prune(spark, given):
    from voxtide.session import shared_dir

    path = shared_dir(spark, "shards")
    write_shards(given, path, shards=8)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(given.columns).collect())) == sorted(map(repr, given.collect()))
    spans = back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).collect()
    assert sum(r.n for r in spans) < 8 * given.select("lang").distinct().count()


# ---- license scans -------------------------------------------------------------

@pytest.mark.parametrize("table", ["edge", "given"])
def test_license_base(request, table):
    docs = request.getfixturevalue(table)
    got = [tuple(r) for r in L.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    same(got, [(r["doc_id"], *brute.license_base(r["text"])) for r in rows_of(docs)])


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
    ("mit dem und der", ""), ("released under the GPL, version 3 or later", "gpl-3.0"), ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
    ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"), ("All Rights Reserved.", "reserved"),
    ("see http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("dedicated to the public domain", "public-domain"), ("", ""),
    ("cc by cc by", "cc-by"), ("Dual licensed: MIT License and the BSD-3-Clause license", "bsd-3-clause,mit"),
])
def test_license_rules(text, labels):
    got = L.scan(text)
    assert got["labels"] == labels and 0 <= got["score"] <= 1 and (got["score"] > 0) == bool(labels)


BODIES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright",
    "bsd-3-clause": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "zlib": "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "agpl-3.0": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl-2.0": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this file",
    "cc-by-sa": "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    "proprietary": "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "reserved": "No part of this book may be reproduced in any form",
}


@pytest.mark.parametrize("label", list(BODIES))
def test_license_sentences(label):
    text = "# " + BODIES[label].upper() + "\n\nint main() {}"
    got = L.scan(text)
    # the base phrases' labels stay whatever the sentence is
    assert {d["label"] for d in got["detections"]} == {label} and got["score"] >= 0.6
    assert set(got["labels"].split(",")) == {label} | set(filter(None, got["base_labels"].split(",")))
    # its beginning alone says nothing
    words = BODIES[label].split()
    assert not L.scan(" ".join(words[: len(words) // 6]))["detections"]


@pytest.mark.parametrize("text, labels", [
    ("foo is MIT-licensed", "mit"), ("Released under MIT.", "mit"), ("available under the ISC", "isc"), ("License: GPLv3", "gpl-3.0"), ("license proprietary", ""), ("copyright.gov", ""),
    ("A permit was licensed by the town under the bridge; the software is free of charge.", ""),
])
def test_license_short_forms(text, labels):
    assert L.scan(text)["labels"] == labels


def test_license_sentences_are_behind_their_gate():
    """A sentence spelled out, gaps and alternatives filled in, holds one of its keywords."""
    import re

    def spelled(p):
        while (q := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\{0,\d+\}\??|\?)?", r"\1", re.sub(r"\(\?![^()]*\)", "", p))) != p:
            p = q
        return re.sub(r" +", " ", re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"([\w ])\?", r"\1", p)).replace(" * ", " some one ").replace(r"\S+", "word").replace(r"\S", "w")).strip()

    seen = set()
    for label, _, confidence, pattern in L.SENTENCES:
        assert pattern not in seen and 0 < confidence <= 1
        seen.add(pattern)
        found = {d["label"] for d in L.scan(spelled(pattern))["detections"]}
        assert label in found, (label, spelled(pattern))
    assert len(seen) > 100


def test_license_gate_and_suppression():
    rules, by_word = L.rules()
    assert len(rules) > 200 and all(by_word.values())
    words = lambda t: t.encode().translate(L._TABLE).split()
    rnd = random.Random(0)
    parts = ["licensed under the", "gnu general public license", "version 2", "or later", "apache license 2.0", "mit license", "terms of", "x", "spdx license identifier", "cc by nc 4.0", "the", "all rights reserved"]
    for _ in range(200):
        text = " ".join(rnd.choice(parts) for _ in range(12))
        w = words(text)
        norm = b" " + b" ".join(w) + b" "
        found = sorted(((m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(norm)), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].order))
        kept = []
        for a, b, r in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, r))
        assert [(a, b, r.order) for a, b, r in L.detect(w, norm)] == sorted((a, b, r.order) for a, b, r in kept)


# ---- packing -------------------------------------------------------------------

def check_packing(docs, out, length):
    tk = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in rows_of(docs):
        want[r["doc_id"], np.array(tk.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()] += 1
    got, pieces = collections.Counter(), collections.defaultdict(list)
    for p in out:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        pieces[p.doc_id, p.doc_tokens].append(p)
    for (d, n), own in pieces.items():  # documents may share id and size; they are told apart by their ids
        bodies = [b for (i, b), k in want.items() for _ in range(k) if i == d and len(b) == 4 * n]
        assert sum(p.length for p in own) == n * len(bodies)
        for p in own:
            assert any(b[4 * p.start: 4 * (p.start + p.length)] == p.ids for b in bodies)
        for b in bodies:
            got[d, b] += 1
    assert got == want
    windows = collections.defaultdict(list)
    for p in out:
        windows[p.sequence_id].append(p)
    assert sorted(windows) == list(range(len(windows)))
    for w, own in windows.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or w == len(windows) - 1 and 0 < at <= length
    return windows


@pytest.mark.parametrize("table", ["edge", "given"])
def test_packing(request, table):
    docs = request.getfixturevalue(table)
    check_packing(docs, pack(docs, P.path("word_bpe_49k.json"), length=512).collect(), 512)


def test_every_window_has_the_target_mixture(given):
    out = pack(given, P.path("word_bpe_49k.json"), length=4096).collect()
    total = collections.Counter()
    for p in out:
        total[p.source] += p.length
    windows = check_packing(given, out, 4096)
    for w in list(windows)[:-1]:
        for s, n in total.items():
            mine = sum(p.length for p in windows[w] if p.source == s)
            assert abs(mine - 4096 * n / sum(total.values())) <= 2


def test_mixture_is_deficit_round_robin():
    rng = np.random.default_rng(4)
    for _ in range(30):
        tokens = rng.integers(0, 3000, rng.integers(1, 6))
        shares = rng.random(len(tokens)) + 0.01
        m = Mixture(tokens, shares, 100)
        n = -(-int(tokens.sum()) // 100)
        cuts = m.served(np.arange(n + 1))
        # by hand: one token at a time to the queue that is due first
        got, have = np.zeros(len(tokens), int), []
        for t in range(int(tokens.sum())):
            if t % 100 == 0:
                have.append(got.copy())
            due = np.where(got < tokens, (got + 0.5) / shares, np.inf)
            got[np.argmin(due)] += 1
        assert (cuts[:len(have)] == np.array(have).reshape(-1, len(tokens))).all() and (cuts[-1] == tokens).all()


def test_small_queues_need_no_more_windows_than_tokens(monkeypatch):
    from voxtide.llm import packing

    seen, served = [], Mixture.served
    monkeypatch.setattr(Mixture, "served", lambda self, window: (seen.append(len(window) * len(self.tokens)), served(self, window))[1])
    tokens = np.array([500, 4_000_000_000] + [7] * 18)
    out = [np.concatenate(x) for x in zip(*Mixture(tokens, tokens / tokens.sum(), 4096).pieces(np.array([0, 2]), np.array([0, 0]), np.array([500, 7])))]
    assert [out[3][out[0] == r].sum() for r in (0, 1)] == [500, 7] and sum(seen) < 20 * 5 * 2 * 510

    # against all windows, in slices of any size
    tokens = np.array([40, 9000, 300, 3])
    queue, start, size = np.array([0, 0, 1, 2, 3, 1]), np.array([0, 25, 0, 100, 1, 4000]), np.array([25, 15, 900, 1, 2, 5000])
    for cells in (4, 64, 1 << 20):
        monkeypatch.setattr(packing, "CELLS", cells, raising=False)
        m = Mixture(tokens, tokens / tokens.sum(), 16)
        got = {tuple(map(int, x)) for part in m.pieces(queue, start, size) for x in zip(*part)}
        cuts = served(m, np.arange(-(-int(tokens.sum()) // 16) + 1))
        want = set()
        for w, (before, after) in enumerate(zip(cuts, cuts[1:])):
            for r, (q, s, n) in enumerate(zip(queue, start, size)):
                a, b = max(before[q], s), min(after[q], s + n)
                if b > a:
                    want.add((r, w, int(a), int(b - a), int((after - before)[:q].sum() + a - before[q])))
        assert got == want


def test_named_sources_keep_their_share_among_many(spark, monkeypatch):
    from voxtide.llm import packing

    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    docs = spark.createDataFrame([(i, "a b c d e f g " * 10, None if i % 6 == 5 else f"s{i % 6}") for i in range(120)], "doc_id long, text string, source string")
    out = pack(docs, P.path("word_bpe_49k.json"), length=64, shares={"s3": 1.0, None: 1.0}).collect()
    first = check_packing(docs, out, 64)[0]
    tokens = collections.Counter()
    for p in first:
        tokens[p.source] += p.length
    # 1 : 1 : 4 x 1/6 for the others together
    assert abs(tokens["s3"] - 24) <= 2 and abs(tokens[None] - 24) <= 2


def test_named_shares_and_repeated_rows(edge):
    out = pack(edge, P.path("word_bpe_49k.json"), length=64, shares={"s0": 5.0, None: 1.0}).collect()
    check_packing(edge, out, 64)


# ---- token counts --------------------------------------------------------------

@pytest.mark.parametrize("table", ["edge", "given"])
def test_token_counts(request, table):
    docs = request.getfixturevalue(table)
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = [(r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in prefix_counts(docs, P.path("byte_bpe_50k.json")).collect()]
    same(got, [(r["doc_id"], len((r["text"] or "").encode()), len(r["text"] or ""), len(tk.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows_of(docs)])


def test_every_prefix_is_exact():
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter, rnd = PrefixCounter(P.path("byte_bpe_50k.json")), random.Random(5)
    parts = ["  ", "\n", "\n\n", " ", "a", "the", "'re", "'s", "'ll", "'", "<|endoftext|>", "<|endof", "é", "日本", "\t", "1", "23", "!?", "Ab", "re'll", " ", "　", "ſ", "aaaaaaaa", "🥳"]
    for _ in range(700):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        n, steps = counter.count(text)
        got = [0, *np.cumsum(np.frombuffer(steps, "<i2").astype(int)).tolist()]
        assert got == [len(tk.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)] and n == got[-1]


def test_questions_need_no_encoding(spark, edge):
    counts = prefix_counts(edge, P.path("byte_bpe_50k.json")).where("n_chars > 0").withColumns({
        "head": tokens_at("steps", F.lit(30)), "fit": chars_within("steps", F.lit(20)), "all": tokens_at("steps", "n_chars")})
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] for r in rows_of(edge)}
    for r in counts.collect():
        text = texts[r.doc_id, r.n_chars]
        assert r["all"] == r.n_tokens and size(text[:r.fit]) <= 20
        assert r.fit == len(text) or size(text[:r.fit + 1]) > 20
        if len(text) < 5000:
            assert r.head == size(text[:30])


# ---- decontamination -----------------------------------------------------------

def near_table(spark, n=120):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8)))
    items = [" ".join(word() for _ in range(rnd.randint(12, 60))) for _ in range(25)]
    docs = []
    for i in range(n):
        text = " ".join(word() for _ in range(150))
        if i % 2:
            item = list(items[i % 25])
            for _ in range(rnd.randint(0, len(item) // 25)):
                at = rnd.randrange(len(item))
                item[at: at + rnd.randint(0, 1)] = rnd.choice(["", "x", "qu"[: rnd.randint(1, 1)]])
            text = text[:200] + " " + "".join(item).upper() + ", " + text[200:]
        docs.append((i, text))
    docs += [(None, None), (500, ""), (501, "short one here"), (502, items[0] + " " + items[1]), (None, items[2]), (503, items[0][: len(items[0]) // 2])]
    rows = [(i, t, "clash") for i, t in enumerate(items)] + [(90, "short one", "c"), (91, None, "c"), (92, " .,! ", "c"), (None, items[3], "c"), (93, items[4], "c")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string, doc_id string"), docs, rows


def test_near_items_are_found(spark):
    docs, items, raw, rows = near_table(spark)
    got = {(r.doc_id, r.item_id): r for r in D.find_items(docs, items).collect()}
    want = {}
    for d, t in raw:
        for i, x, _ in rows:
            pattern = D.normal(x)
            if i is not None and pattern and t:
                distance = brute.edits_within(pattern, D.normal(t)) if len(pattern) >= D.SHORT else (0 if b" " + pattern + b" " in b" " + D.normal(t) + b" " else 99)
                if distance <= (int(0.05 * len(pattern)) if len(pattern) >= D.SHORT else 0):
                    want[d, i] = distance
    assert set(got) <= set(want), "only what is within the distance"
    assert all(got[k].distance >= want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got) and {k for k in got if got[k].distance == 0} == exact
    assert len(got) >= 0.9 * len(want)
    kept = [r.doc_id for r in D.drop_contaminated(docs, items).collect()]
    held = {d for d, _ in got}
    assert sorted(d for d in kept if d is not None) == sorted(d for d, _ in raw if d is not None and d not in held)
    assert kept.count(None) == 1  # the null text; the other one without an id holds an item


def test_edit_distance_is_exact():
    rnd = random.Random(9)
    for _ in range(300):
        a, b = (bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(1, 20))) for _ in range(2))
        distance, end = D.edit_distance(a, b)
        assert distance == brute.edits_within(a, b) and brute.edits_within(a, b[:end]) == distance


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items, *_ = near_table(spark, 20)
    whole = {(r.doc_id, r.item_id) for r in D.find_items(docs, items).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in D.find_items(docs, items).collect()} >= {k for k in whole if k[0] is not None and k[0] % 2 == 1 and k[0] > 500 or k[0] == 502}
    assert D.drop_contaminated(docs, items.limit(0)).count() == docs.count() and D.find_items(docs, items.limit(0)).count() == 0


def test_empty_tables(spark, empty):
    labels = labels_of(spark, [])
    assert Q.quality_rules(empty, labels).count() == 0 and Q.keep_good(empty, labels).count() == 0
    assert hilbert_shards(empty).count() == 0 and L.license_scan(empty).count() == 0
    assert pack(empty, P.path("word_bpe_49k.json")).count() == 0 and prefix_counts(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert D.find_items(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def word_texts():
    rnd = random.Random(6)
    odd = ["<|endoftext|>.", "x<|endoftext|>,", "<|ENDOFTEXT|>", "It's,", "DON'T!", "É,", "ÀÉ;:", "a×,", "÷.", "n…,", "e\u0301.", ".\u0301.", "日本,", "x1,", "1.", "...", "A", "ÉTÉ?!)", "(abc)", "\u00a0ab.", "İI,", "ΣΑΣ.", "a<b,"]
    words = odd + ["".join(rnd.choice("abcXYZéÉ.,") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    return ["", " \n", *odd, *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]]


@pytest.mark.parametrize("most", [5, 100, 1000])
def test_words_give_the_ids_of_the_whole_text(most):
    coder = WordEncoder(P.path("word_bpe_49k.json"), most)
    texts = word_texts()
    for part in (texts[:30], texts[30:], texts, texts[::-1]):
        ids, at = coder.encode(pa.array(part), 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x.ids + [2] for x in coder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert len(coder.used) <= most + len({w for t in part for w in brute.words(t)}) * 2


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    from voxtide.llm import units

    monkeypatch.setattr(units.Words, "hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    coder = WordEncoder(P.path("word_bpe_49k.json"))
    texts = word_texts()
    for _ in range(2):
        ids, at = coder.encode(pa.array(texts), 2)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x.ids + [2] for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_vocabularies_that_keep_capitals_are_not_cut():
    from voxtide.llm import units

    assert WordEncoder(P.path("byte_bpe_50k.json")).split is units.words_of
    assert WordEncoder(P.path("word_bpe_49k.json")).split is not units.words_of
