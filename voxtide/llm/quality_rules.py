"""Quality rules whose cutoffs are certified on labelled holdouts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import units as U
from voxtide.session import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
TOGETHER = "*"  # all rules of a stratum at once

#: Rules: the share that is judged, and its cutoffs from lenient to strict. A row
#: fails a rule above the cutoff.
GRID = [0.95 * 0.88 ** i for i in range(32)]
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "bangs": ("n_bangs", "n_words"),
    "upper": ("n_upper_words", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """Every stratum's certified rules together reject at most `reject` of its good
    rows, with confidence 1 - error over all strata and rules at once."""
    reject: float = 0.02
    error: float = 0.05


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    words = U.words_of(texts)
    n = len(words.offsets) - 1
    per_word = np.diff(words.first)
    text_of_word = np.repeat(np.arange(n), per_word)

    def by_text(marks: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(marks, dtype=np.int64))
        return np.diff(sums[words.offsets])

    space = U._SPACE[words.data]
    point = ((words.data & 0xC0) != 0x80) & ~space
    # a word is upper-case if it has two A-Z or more and no a-z
    lower = np.append(0, np.cumsum((words.data >= 97) & (words.data <= 122)))
    upper = np.append(0, np.cumsum((words.data >= 65) & (words.data <= 90)))
    loud = (lower[words.ends] == lower[words.starts]) & (upper[words.ends] - upper[words.starts] >= 2)
    hashes = words.hashes()
    inside = words.inside(3)
    repeat = np.zeros(len(hashes), bool)
    if len(inside):
        at = np.flatnonzero(inside)
        key = U.window_hashes(hashes, 3)[at] ^ U.mix(text_of_word[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeat = U.covered(len(hashes), at[twice], 3)
    lines, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = words.data.tobytes()
    for i in range(n):
        own = [x for x in raw[words.offsets[i]: words.offsets[i + 1] - 1].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[i], copies[i] = len(own), len(own) - len(set(own))
    return {
        "n_words": per_word, "word_chars": by_text(point), "n_symbols": by_text(_SYMBOL[words.data]), "n_dup_lines": copies,
        "n_repeat_words": np.bincount(text_of_word, weights=repeat, minlength=n).astype(np.int64), "n_lines": lines, "n_bangs": by_text(words.data == 33),
        "n_upper_words": np.bincount(text_of_word, weights=loud, minlength=n).astype(np.int64),
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and COUNTS of every row. One pass over the texts, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch):
                counts = count_features(part["text"])
                yield pa.record_batch({"id": part["id"], "stratum": part["stratum"], **{k: pa.array(v.astype(np.int64)) for k, v in counts.items()}})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def _by_bytes(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text."""
    _, offsets = U.text_bytes(batch["text"])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with chance p, exact sum of terms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def certify(table: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, int, int, np.ndarray, np.ndarray]], risk: Risk, parts: int = len(RULES),
            tests: int = 0) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule).

    table: good rows above each cutoff of GRID and bad rows above it (selection
    fold), number of good and bad rows there, then the same good counts in the
    test fold with their number as a one-element array.

    For one rule and stratum the cutoffs are tested from lenient to strict, each
    with the exact binomial test of "it rejects more than reject / parts of the
    good rows", and testing ends at the first that does not pass: a fixed sequence
    needs no correction of its own. Strata and rules share the error by
    Bonferroni, over `tests` entries where the table is a part of more. Among the cutoffs that pass, the selection fold picks the one that
    rejects most bad rows less good rows; ties go to the more lenient.
    """
    level = risk.error / max(1, tests, len(table))
    limit = risk.reject / parts
    out = {}
    for key, (good, bad, n_good, n_bad, test, n_test) in sorted(table.items()):
        best = (0.0, None)
        for i, cutoff in enumerate(GRID):
            n = int(n_test[0])
            if not n or binomial_tail(int(test[i]), n, limit) > level:
                break
            gain = bad[i] / max(1, n_bad) - good[i] / max(1, n_good)
            if gain > best[0] + 1e-12:
                best = (gain, cutoff)
        if best[1] is not None:
            out[key] = best[1]
    return out


def _first() -> dict[str, F.Column]:
    """By rule, the number of the first cutoff of GRID that a row of counts fails."""
    grid = F.array(*[F.lit(c) for c in GRID])

    def first(share: F.Column) -> F.Column:
        return F.size(F.filter(grid, lambda c: share <= c))

    return {rule: first(F.col(a) / F.greatest(F.col(b), F.lit(1))) for rule, (a, b) in RULES.items()}


def candidates(good: dict[str, np.ndarray], bad: dict[str, np.ndarray], n_good: int, n_bad: int, risk: Risk) -> dict[str, int]:
    """By rule, the cutoff that rejects most bad rows less good rows of the selection
    fold, among those that reject at most reject / rules of its good rows; ties go to
    the more lenient. A rule that gains nothing has none."""
    out = {}
    for rule in RULES:
        gain = bad[rule] / max(1, n_bad) - good[rule] / max(1, n_good)
        gain[good[rule] > risk.reject / len(RULES) * n_good] = 0
        best = int(np.argmax(gain))
        if gain[best] > 1e-12:
            out[rule] = best
    return out


def _by_cutoff(part: pd.DataFrame, number: str) -> np.ndarray:
    """Rows by the number of the first cutoff they fail, summed from the most lenient on."""
    return np.cumsum(np.bincount(part[number], weights=part["rows"], minlength=len(GRID) + 1).astype(np.int64))


def _own(part: pd.DataFrame, number: str, good: int, test: int = 0) -> np.ndarray:
    return _by_cutoff(part[(part["good"] == good) & (part["test"] == test)], number)


def thresholds(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """Certified cutoffs: s (the stratum) and by rule cut_<rule>, from all labelled rows.

    Rows with a label of 1 are good, of 0 bad; a null label says nothing, and of
    several labels for an id the smallest counts. A hash of the id halves the
    labelled rows: one fold selects, the other tests. Only rows that pass the base
    rules take part.

    The selection fold gives each rule of a stratum a candidate. What is tested is
    all rules of a stratum together, on its own good rows of the test fold: step i
    has every rule at cutoff i of GRID, or at its candidate if that is more lenient,
    so later steps reject what earlier ones do, and `certify` walks them with `reject`
    as a whole as limit. No stratum takes a cutoff from other rows than its own.

    Every stratum takes part that has so many good labels in the test fold that it
    could pass alone; the others have no cutoff and reject nothing. There may be any
    number of strata: each is settled in a task, from its counts by fold, rule and
    cutoff, and only the number of strata that are tested reaches the driver.
    """
    truth = labels.where(F.col(good_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l")).agg(F.min(good_col).alias("good"))
    rows = counts.where(~base_failed()).join(truth.where("good in (0, 1)"), F.col("id") == F.col("l")).select(
        F.col("stratum").alias("s"), F.col("good").cast("int").alias("good"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("test"), *[c.alias(rule) for rule, c in _first().items()])
    rows = cut_lineage(rows)
    few = math.log(risk.error) / math.log1p(-risk.reject)
    tested = rows.where("test = 1 AND good = 1").groupBy(F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= few)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("first")) for rule in RULES])
    found = rows.where("test = 0").select("s", "test", "good", F.explode(each).alias("f")).groupBy("s", "test", "good", "f.rule", "f.first").agg(F.count(F.lit(1)).alias("rows"))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        good, bad = ({rule: _own(part[part["rule"] == rule], "first", x) for rule in RULES} for x in (1, 0))
        own = candidates({r: x[:-1] for r, x in good.items()}, {r: x[:-1] for r, x in bad.items()}, *[int(x["symbols"][-1]) for x in (good, bad)], risk)
        return pd.DataFrame([(part["s"].iloc[0], *[own.get(rule) for rule in RULES])] if own else [], columns=["t", *[f"last_{rule}" for rule in RULES]])

    last = ", ".join(f"last_{rule} int" for rule in RULES)
    picked = cut_lineage(found.join(tested, F.col("s") == F.col("t"), "left_semi").groupBy("s").applyInPandas(pick, f"t string, {last}"))
    tests = picked.count()
    step = F.least(F.lit(len(GRID)), *[F.when(F.col(rule) <= F.col(f"last_{rule}"), F.col(rule)).otherwise(F.lit(len(GRID))) for rule in RULES])
    lasts = [f"last_{rule}" for rule in RULES]
    steps = rows.join(picked, F.col("s") == F.col("t")).select("s", "good", "test", step.alias("step"), *lasts).groupBy("s", "good", "test", "step").agg(
        F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in lasts])  # the same in all rows of a stratum

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        good, bad, test = (_own(part, "step", *x) for x in ((1, 0), (0, 0), (1, 1)))
        stratum = part["s"].iloc[0]
        table = {(stratum, TOGETHER): (good[:-1], bad[:-1], int(good[-1]), int(bad[-1]), test[:-1], test[-1:])}
        best = {rule: part[f"last_{rule}"].iloc[0] for rule in RULES}
        cuts = [(stratum, *[None if pd.isna(x) else max(cutoff, GRID[int(x)]) for x in best.values()]) for cutoff in certify(table, risk, 1, tests).values()]
        return pd.DataFrame(cuts, columns=["s", *[f"cut_{rule}" for rule in RULES]])

    # written out: its known size lets Spark broadcast it where it is small
    return cut_lineage(steps.groupBy("s").applyInPandas(settle, "s string, " + ", ".join(f"cut_{rule} double" for rule in RULES)))


def verdict() -> F.Column:
    """The first rule that a row of counts with its stratum's cutoffs fails, or null.
    A rule rejects only in strata for which it has a cutoff."""
    out = F.when(base_failed(), F.lit("base"))
    for rule, (a, b) in RULES.items():
        out = out.when(F.col(a) / F.greatest(F.col(b), F.lit(1)) > F.col(f"cut_{rule}"), F.lit(rule))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                  good_col: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """Counts, the rule that rejects a row, and whether it is kept.

    Base rules (fewer than 50 words, or over half the words in repeated 3-word
    windows) always hold. The other rules reject above cutoffs that `thresholds`
    certifies on labelled rows of the same stratum, with exact binomial bounds and a
    correction for the number of strata. Where labels are too few to certify, no
    such rule rejects. The counts are made in one pass over the texts when this
    is called and kept in the shared folder; no text is shuffled.

    A null or empty text has no words and fails the base rules. A null stratum is
    the stratum "". Each row gives one row, whatever its id; no row is joined back,
    so repeated or null ids are judged each by its own text. Columns of any other
    name are not read.

    Returns id, stratum, COUNTS, base_failed, failed_rule, kept.
    """
    counts = cut_lineage(features(docs, id_col, text_col, stratum_col))
    cuts = thresholds(counts, labels, id_col, good_col, risk)
    judged = counts.join(cuts, F.col("stratum") == F.col("s"), "left").select(*counts.columns, base_failed().alias("base_failed"), verdict().alias("failed_rule"))
    return judged.withColumn("kept", F.col("failed_rule").isNull()).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
              good_col: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps. The
    texts are read twice (once to certify the cutoffs, once to apply them) rather
    than shuffled to meet their verdicts: they meet the cutoffs of their stratum, by
    broadcast unless there are more than Spark broadcasts. Cases as in quality_rules."""
    counts = cut_lineage(features(docs, id_col, text_col, stratum_col))
    cuts = thresholds(counts, labels, id_col, good_col, risk)
    columns = docs.columns
    text_at = columns.index(text_col)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], stratum.alias("stratum"))
    rows = named.join(cuts, F.col("stratum") == F.col("s"), "left").drop("stratum", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch.append_column("text", batch.column(text_at).cast(pa.string()))):
                c = count_features(part["text"])
                ok = ~((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"]))
                for rule, (a, b) in RULES.items():
                    cut = part[f"cut_{rule}"].fill_null(math.inf).to_numpy(zero_copy_only=False)
                    ok &= ~(c[a] / np.maximum(c[b], 1) > cut)
                yield part.select([f"c{i}" for i in range(len(columns))]).rename_columns(columns).filter(pa.array(ok))

    return rows.mapInArrow(run, docs.schema)
