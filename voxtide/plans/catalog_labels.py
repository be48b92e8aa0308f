"""Queries: labels, datasets, metrics, agreement and training."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import WORD_BODY
from voxtide.operators import agreement, classifiers, dataset, labels, metrics, relevance, training
from voxtide.operators.votes import argmax, softmax
from voxtide.plans import jobs
from voxtide.plans.catalog_text import D_SCORING, d_top, d_votes
from voxtide.plans.registry import d_list, d_trim, query
from voxtide.schema import FINAL_LABELS, POLARITY_LABELS, SARCASM_LABELS, SUBJECTIVITY_LABELS
from voxtide.session import cut_lineage, shared_dir
from voxtide.sources import tables

SUB, POL = vocab.SUBJECTIVITY_TERMS, vocab.POLARITY_TERMS
SUB_LABELS, POL_LABELS = list(SUB), list(POL)

# ---- spellings and thresholds ------------------------------------------------------

SAR = vocab.SARCASM_TERMS
_PLACES = {"opinionated": (SUB, "ka"), "positive": (POL, "kb"), "sarcastic": (SAR, "kc")}
D_GOLD = """case when quality = 1 then 'opinionated' else 'neutral' end gold,
  case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end gold3,
  case when toxic = 1 then 'sarcastic' else 'non-sarcastic' end sarcastic_gold"""


def labelled_posts(spark, sf):
    return tables.opinions(spark, sf).join(tables.table(spark, sf, "labels"), F.col("ingest_seq") == F.col("doc_id"))


def scored(spark, sf):
    """post_id, gold labels from the label table, and candidate-label scores of the texts."""
    keys = ["post_id", "text", "quality", "toxic"]
    df = labelled_posts(spark, sf).select(*keys)
    for label, (terms, _) in _PLACES.items():
        df = relevance.candidate_scores(df, terms, keys, "text").withColumn(
            f"{label}_score", F.round(F.get("scores", F.lit(list(terms).index(label))), 6)).drop("votes", "scores")
        keys = [*keys, f"{label}_score"]
    return df.selectExpr("post_id", *re.split(r",\s+(?=case)", D_GOLD), *[f"{label}_score" for label in _PLACES])


tables.CTES["scored"] = f"""with src as (select post_id, text, quality, toxic from opinions join labels on doc_id = ingest_seq),
  {', '.join(d_votes(terms, 'src', 'text', name=n) for terms, n in _PLACES.values())}
  select src.post_id, {D_GOLD}, {', '.join(f'round({n}.e{list(terms).index(label)}, 6) {label}_score' for label, (terms, n) in _PLACES.items())}
  from src {' '.join(f'join {n} using (post_id)' for _, n in _PLACES.values())}"""


# How scorers spell their labels: for each language the words for 1 and 0.
MODEL_SPELLINGS = {"en": ("opinionated ", " Neutral"), "de": ("label_1", "LABEL_0"), "es": ("Opinionated", "label_0"), "fr": ("LABEL_1", "neutral")}
SARCASM_SPELLINGS = {"en": ("Sarcastic", "Non_Sarcastic"), "de": ("sarcasm", "not-sarcastic"), "fr": (" SARCASM", "non sarcasm"),
                     "es": tuple(vocab.SARCASM_HYPOTHESES[l] for l in ("sarcastic", "non-sarcastic"))}
EVAL_SPELLINGS = {"en": ("LABEL_1", "LABEL_0"), "de": ("sarcasm", "non_sarcasm"), "es": ("Very_Sarcastic", "not_sarcasm"), "fr": ("sarcastic", "Non-Sarcastic")}


def spelling(column, spellings):
    """The label in a 0/1 column of the label table as the scorer of the text's language spells it."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "case lang " + " ".join(f"when '{l}' then case {column} when 1 then {quote(one)} when 0 then {quote(zero)} end" for l, (one, zero) in spellings.items()) + " end"


def spelled(spark, sf, column, spellings):
    both = tables.documents(spark, sf).join(tables.table(spark, sf, "labels"), "doc_id")
    return both.selectExpr("doc_id", spelling(column, spellings) + " as raw")


def d_spelled(column, spellings):
    return f"(select doc_id, quality, toxic, {spelling(column, spellings)} raw from documents join labels using (doc_id))"


@query("normalize_model_label", f"select doc_id, case quality when 1 then 'opinionated' else 'neutral' end label from {d_spelled('quality', MODEL_SPELLINGS)}")
def normalize_model_label(spark, sf):
    return spelled(spark, sf, "quality", MODEL_SPELLINGS).select("doc_id", labels.normalize_model_label("raw", SUBJECTIVITY_LABELS).alias("label"))


@query("normalize_sarcasm_label", f"select doc_id, case toxic when 1 then 'sarcastic' else 'non-sarcastic' end as label from {d_spelled('toxic', SARCASM_SPELLINGS)}")
def normalize_sarcasm_label(spark, sf):
    return spelled(spark, sf, "toxic", SARCASM_SPELLINGS).select("doc_id", labels.normalize_sarcasm_label("raw").alias("label"))


@query("evaluation_label_map", f"""select doc_id, case raw when 'LABEL_0' then 'non-sarcastic' when 'LABEL_1' then 'sarcastic' when 'non_sarcasm' then 'non-sarcastic'
  when 'sarcasm' then 'sarcastic' when 'not_sarcasm' then 'non-sarcastic' else replace(lower(raw), '_', '-') end as label from {d_spelled('toxic', EVAL_SPELLINGS)}""")
def evaluation_label_map(spark, sf):
    return spelled(spark, sf, "toxic", EVAL_SPELLINGS).select("doc_id", labels.evaluation_label("raw").alias("label"))


@query("apply_threshold", "select post_id, case when opinionated_score >= 0.6 then 'opinionated' else 'neutral' end as label from scored")
def apply_threshold(spark, sf):
    return scored(spark, sf).select("post_id", labels.apply_threshold(
        "opinionated_score", "opinionated", SUBJECTIVITY_LABELS, 0.6).alias("label"))


def stage1_map():
    return labels.score_map(["opinionated", "neutral"], ["opinionated_score", 1 - F.col("opinionated_score")])


def stage2_map():
    return labels.score_map(["positive", "negative"], ["positive_score", 1 - F.col("positive_score")])


@query("binary_label_and_score", """select post_id, case when opinionated_score >= 0.6 then 'opinionated' else 'neutral' end as label,
  round(case when opinionated_score >= 0.6 then opinionated_score else 1 - opinionated_score end, 6) score from scored""")
def binary_label_and_score(spark, sf):
    df = scored(spark, sf).withColumn("scores", stage1_map())
    label, score = labels.binary_label_and_score("scores", "opinionated", SUBJECTIVITY_LABELS, 0.6)
    return df.select("post_id", label.alias("label"), F.round(score, 6).alias("score"))


@query("label_config", """select post_id, case when opinionated_score >= 0.6 then 'opinionated' else 'neutral' end sub,
  case when positive_score >= 0.5 then 'positive' else 'negative' end pol from scored""")
def label_config(spark, sf):
    stages = spark.createDataFrame(
        [("subjectivity", SUBJECTIVITY_LABELS, "opinionated"), ("polarity", POLARITY_LABELS, "positive")],
        "stage string, default_labels array<string>, default_positive string")
    saved = spark.createDataFrame([("subjectivity", None, None, 0.6)],
                                  "stage string, labels array<string>, positive_label string, decision_threshold double")
    config = labels.with_label_config(stages, saved)

    def threshold(stage):
        return config.where(F.col("stage") == stage).select("decision_threshold").scalar()

    return scored(spark, sf).select(
        "post_id",
        labels.apply_threshold("opinionated_score", "opinionated", SUBJECTIVITY_LABELS, threshold("subjectivity")).alias("sub"),
        labels.apply_threshold("positive_score", "positive", POLARITY_LABELS, threshold("polarity")).alias("pol"))


@query("hierarchical_predict", """select post_id, case when opinionated_score >= 0.6 then 'opinionated' else 'neutral' end stage1_label,
  round(case when opinionated_score >= 0.6 then opinionated_score else 1 - opinionated_score end, 6) stage1_score,
  case when opinionated_score >= 0.6 then case when positive_score >= 0.8 then 'positive' else 'negative' end end stage2_label,
  case when opinionated_score >= 0.6 then round(case when positive_score >= 0.8 then positive_score else 1 - positive_score end, 6) end stage2_score,
  case when opinionated_score >= 0.6 then case when positive_score >= 0.8 then 'positive' else 'negative' end else 'neutral' end final_label from scored""")
def hierarchical_predict(spark, sf):
    out = labels.hierarchical_predict(
        scored(spark, sf), lambda d: d.withColumn("scores", stage1_map()),
        lambda d: d.withColumn("scores", stage2_map()), 0.6, 0.8)
    return out.select("post_id", "stage1_label", F.round("stage1_score", 6).alias("stage1_score"), "stage2_label",
                      F.round("stage2_score", 6).alias("stage2_score"), "final_label")


@query("subjectivity_label", f"""with pend as (select * from stored where subjectivity_label is null), {d_votes(SUB, 'pend', D_SCORING)}
  select post_id, {d_top(SUB_LABELS)} subjectivity_label from votes""")
def subjectivity_label(spark, sf):
    from voxtide.operators.state import pending_classification

    pending = pending_classification(tables.stored(spark, sf), "subjectivity")
    return relevance.candidate_scores(pending, SUB, ["post_id"], relevance.scoring_text()).select(
        "post_id", relevance.top_label(SUB_LABELS).alias("subjectivity_label"))


@query("neutral_polarity_fill", """select post_id, subjectivity_label, case when subjectivity_label = 'neutral' and polarity_label is null
  then 'neutral' else polarity_label end polarity_label from stored""")
def neutral_polarity_fill(spark, sf):
    return labels.fill_neutral_polarity(tables.stored(spark, sf)).select("post_id", "subjectivity_label", "polarity_label")


@query("polarity_pos_neg", f"""with pend as (select * from stored where subjectivity_label = 'opinionated' and polarity_label is null),
  {d_votes(POL, 'pend', D_SCORING)} select post_id, case when v1 >= v0 then 'positive' else 'negative' end polarity_label from votes""")
def polarity_pos_neg(spark, sf):
    waiting = labels.polarity_pending(tables.stored(spark, sf))
    votes = relevance.candidate_scores(waiting, POL, ["post_id"], relevance.scoring_text())
    scores = labels.score_map(["negative", "positive"], [F.get("scores", F.lit(0)), F.get("scores", F.lit(1))])
    return votes.select("post_id", labels.polarity_pos_neg(scores).alias("polarity_label"))


@query("label_distribution", """select 'subjectivity' task, subjectivity_label as label, count(*) n from stored where subjectivity_label is not null and platform = 'bluesky' group by 2
  union all select 'polarity', polarity_label, count(*) from stored where polarity_label is not null and platform = 'bluesky' group by 2""")
def label_distribution(spark, sf):
    return labels.label_distribution(tables.stored(spark, sf), "bluesky")


@query("classify_run", f"""with p1 as (select * from stored where subjectivity_label is null), {d_votes(SUB, 'p1', D_SCORING, name='va')},
  s1 as (select * exclude (subjectivity_label), coalesce(subjectivity_label, case when va.post_id is not null then {d_top(SUB_LABELS)} end) subjectivity_label from stored left join va using (post_id)),
  s2 as (select * exclude (polarity_label), case when subjectivity_label = 'neutral' and polarity_label is null then 'neutral' else polarity_label end polarity_label
    from (select * exclude (v0, v1, e0, e1) from s1)),
  p2 as (select * from s2 where subjectivity_label = 'opinionated' and polarity_label is null), {d_votes(POL, 'p2', D_SCORING, name='vb')}
  select s2.post_id, subjectivity_label, coalesce(polarity_label, case when vb.post_id is not null then case when v1 >= v0 then 'positive' else 'negative' end end) polarity_label
  from s2 left join vb using (post_id)""")
def classify_run(spark, sf):
    return jobs.classify_run(tables.stored(spark, sf)).select("post_id", "subjectivity_label", "polarity_label")


@query("sarcasm_label", f"""with {d_votes(SAR, 'stored', D_SCORING)} select post_id, case when v0 >= v1 then 'sarcastic' else 'non-sarcastic' end sarcasm_label,
  round(e0, 6) sarcasm_score from votes""")
def sarcasm_label(spark, sf):
    df = relevance.candidate_scores(tables.stored(spark, sf), SAR, ["post_id"], relevance.scoring_text())
    scores = labels.score_map(list(SAR), [F.get("scores", F.lit(0)), F.get("scores", F.lit(1))])
    label, score = labels.sarcasm_prediction(scores)
    return df.select("post_id", label.alias("sarcasm_label"), F.round(score, 6).alias("sarcasm_score"))


# ---- annotation -----------------------------------------------------------------------

D_ANNOTATE = f"coalesce(nullif({d_trim('cleaned_text')}, ''), {d_trim('text')}, '')"


@query("annotation_text", f"select post_id, {D_ANNOTATE} input from labelled")
def annotation_text(spark, sf):
    return tables.labelled(spark, sf).select("post_id", labels.annotation_text().alias("input"))


# a cell of a record set: blank in two spellings, or a number
CELL = "case when lang = 'fr' then ' NaN ' when n_chars < 400 then '' when lang = 'es' then source else cast(n_chars as string) || '.2500004' end"


@query("missing_value", f"select doc_id, coalesce(lower(trim({CELL})), '') in ('', 'nan', 'none', 'null') missing from documents")
def missing_value(spark, sf):
    return tables.documents(spark, sf).selectExpr("doc_id", f"{CELL} as cell").select("doc_id", labels.missing_value("cell").alias("missing"))


@query("format_score", f"""with c as (select doc_id, {CELL} cell from documents)
  select doc_id, case when isfinite(try_cast(cell as double)) then printf('%.6f', try_cast(cell as double)) else '' end formatted from c""")
def format_score(spark, sf):
    return tables.documents(spark, sf).selectExpr("doc_id", f"{CELL} as cell").select("doc_id", labels.format_score("cell").alias("formatted"))


D_MISSING = "coalesce(lower(trim({c})), '') in ('', 'nan', 'none', 'null')"


@query("annotation_candidates", f"""select post_id, {D_ANNOTATE} as text from labelled
  where ({D_MISSING.format(c='sarcasm_detection')} or {D_MISSING.format(c='polarity_detection')}) and {D_ANNOTATE} <> ''""")
def annotation_candidates(spark, sf):
    return labels.annotation_candidates(tables.labelled(spark, sf), ["sarcasm_detection", "polarity_detection"])


@query("merge_annotations", """with u as (select post_id, case when opinionated_score >= 0.5 then 'opinionated' else 'neutral' end l,
    printf('%.6f', greatest(opinionated_score, 1 - opinionated_score)) s from scored where positive_score >= 0.3)
  select r.post_id, case when u.post_id is not null then u.l else r.subjectivity_detection end subjectivity_detection,
    case when u.post_id is not null then u.s else '' end subjectivity_score from labelled r left join u using (post_id)""")
def merge_annotations(spark, sf):
    label, score = labels.binary_label_and_score("scores", "opinionated", SUBJECTIVITY_LABELS, 0.5)
    updates = scored(spark, sf).where("positive_score >= 0.3").withColumn("scores", stage1_map()).select(
        "post_id", label.alias("subjectivity_detection"), labels.format_score(score).alias("subjectivity_score"))
    rows = tables.labelled(spark, sf).select("post_id", "subjectivity_detection")
    return labels.merge_annotations(rows, updates, ["subjectivity_detection", "subjectivity_score"])


def d_candidates(*targets):
    missing = " or ".join(D_MISSING.format(c=c) for c in targets)
    return f"cand as (select post_id, {D_ANNOTATE} as text from labelled where ({missing}) and {D_ANNOTATE} <> '')"


_OPI, _POS, _SARC = SUB_LABELS.index("opinionated"), POL_LABELS.index("positive"), list(SAR).index("sarcastic")
TARGETS = ["subjectivity_detection", "polarity_detection"]


@query("annotate_hierarchical_run", f"""with {d_candidates(*TARGETS)}, {d_votes(SUB, 'cand', 'text', name='va')}, {d_votes(POL, 'cand', 'text', name='vb')},
  u as (select post_id, va.e{_OPI} >= 0.5 opinionated, vb.e{_POS} >= 0.5 positive, printf('%.6f', case when va.e{_OPI} >= 0.5 then va.e{_OPI} else va.e{1 - _OPI} end) s1,
    printf('%.6f', case when vb.e{_POS} >= 0.5 then vb.e{_POS} else vb.e{1 - _POS} end) s2 from va join vb using (post_id))
  select r.post_id, r.subjectivity_detection, case when u.post_id is null then '' when opinionated then 'opinionated' else 'neutral' end subjectivity_label, coalesce(s1, '') subjectivity_score,
    case when opinionated then case when positive then 'positive' else 'negative' end else '' end polarity_label, case when opinionated then s2 else '' end polarity_score
  from labelled r left join u using (post_id)""")
def annotate_hierarchical_run(spark, sf):
    out, _ = jobs.annotate_hierarchical_run(tables.labelled(spark, sf), TARGETS)
    return out.select("post_id", "subjectivity_detection", "subjectivity_label", "subjectivity_score", "polarity_label", "polarity_score")


@query("annotate_sarcasm_run", f"""with {d_candidates('sarcasm_detection')}, {d_votes(SAR, 'cand', 'text', name='va')},
  u as (select post_id, case when e{_SARC} >= 0.5 then 'sarcastic' else 'non-sarcastic' end l, printf('%.6f', e{_SARC}) s from va)
  select r.post_id, case when u.post_id is null then r.sarcasm_detection else u.l end sarcasm_detection, coalesce(s, '') sarcasm_score from labelled r left join u using (post_id)""")
def annotate_sarcasm_run(spark, sf):
    out, _ = jobs.annotate_sarcasm_run(tables.labelled(spark, sf), "sarcasm_detection")
    return out.select("post_id", "sarcasm_detection", "sarcasm_score")


D_LENGTHS = f"lens as (select length(text) len from opinions where length({d_trim('text')}) > 0)"
D_P95 = "(select list_sort(list(len))[1 + cast(round_even((count(*) - 1) * 0.95::double, 0) as bigint)] from lens)"


@query("annotation_stats", f"""with {D_LENGTHS} select count(*) total_records, cast(ceil(count(*) / 32.0) as bigint) total_batches,
  round(avg(len), 6) avg_characters_per_text, max(len) max_characters_per_text, {D_P95} p95_characters_per_text from lens""")
def annotation_stats(spark, sf):
    out = labels.annotation_stats(tables.opinions(spark, sf))
    return out.withColumn("avg_characters_per_text", F.round("avg_characters_per_text", 6))


@query("p95_nearest_rank", f"with {D_LENGTHS} select {D_P95} p95")
def p95_nearest_rank(spark, sf):
    df = tables.opinions(spark, sf).select(F.char_length("text").cast("bigint").alias("len"))
    return labels.p95_nearest_rank(df, "len")


# ---- datasets ---------------------------------------------------------------------------

D_CLEAN_LABELS = "lab as (select " + ", ".join(
    f"coalesce({d_trim(c)}, '') {c}" for c in tables.LABELLED) + " from labelled)"
D_CHOSEN = "coalesce(nullif(text, ''), cleaned_text)"


def manual(spark, sf):
    return dataset.load_manual_labels(tables.labelled(spark, sf))


@query("load_manual_labels", f"with {D_CLEAN_LABELS} select * from lab")
def load_manual_labels(spark, sf):
    return manual(spark, sf)


@query("choose_text", f"with {D_CLEAN_LABELS} select post_id, {D_CHOSEN} input from lab")
def choose_text(spark, sf):
    return manual(spark, sf).select("post_id", dataset.choose_text().alias("input"))


@query("subjectivity_rows", f"""with {D_CLEAN_LABELS} select post_id, {D_CHOSEN} as text, cast(case subjectivity_detection when 'neutral' then 0 else 1 end as int) as label,
  subjectivity_detection label_name from lab where {D_CHOSEN} <> '' and subjectivity_detection in ('neutral', 'opinionated')""")
def subjectivity_rows(spark, sf):
    return dataset.subjectivity_rows(manual(spark, sf))


@query("polarity_rows", f"""with {D_CLEAN_LABELS} select post_id, {D_CHOSEN} as text, cast(case polarity_detection when 'negative' then 0 else 1 end as int) as label,
  polarity_detection label_name from lab where {D_CHOSEN} <> '' and subjectivity_detection = 'opinionated' and polarity_detection in ('negative', 'positive')""")
def polarity_rows(spark, sf):
    return dataset.polarity_rows(manual(spark, sf))


@query("label_anomalies", f"""with {D_CLEAN_LABELS}, coded as (select case when {D_CHOSEN} = '' then 0 when subjectivity_detection = '' then 1
    when subjectivity_detection = 'opinionated' and polarity_detection = '' then 2 when subjectivity_detection = 'opinionated' and polarity_detection = 'neutral' then 3
    when subjectivity_detection = 'neutral' and polarity_detection in ('negative', 'positive') then 4 end c from lab)
  select {', '.join(f"count(*) filter (c = {i}) {a}" for i, a in enumerate(dataset.ANOMALIES))} from coded""")
def label_anomalies(spark, sf):
    return dataset.label_anomalies(manual(spark, sf))


D_FINAL = f"""{D_CLEAN_LABELS}, finals as (select post_id, {D_CHOSEN} as text, case when subjectivity_detection = 'neutral' then 'neutral' else polarity_detection end label_name
  from lab where {D_CHOSEN} <> '' and ((subjectivity_detection = 'neutral' and polarity_detection not in ('negative', 'positive'))
    or (subjectivity_detection = 'opinionated' and polarity_detection in ('negative', 'positive')))),
  final_rows as (select *, cast(list_position({d_list(FINAL_LABELS)}, label_name) - 1 as int) as label from finals)"""
D_SPLIT = f"""{D_FINAL}, ranked as (select *, row_number() over (partition by label order by md5(post_id || ':42'), post_id) r, count(*) over (partition by label) n from final_rows),
  split_rows as (select post_id, text, label, label_name, case when n > 1 and r <= least(greatest(cast(round_even(n * 0.2::double, 0) as bigint), 1), n - 1) then 'validation' else 'train' end split from ranked)"""
D_STAGES = f"""{D_SPLIT}, stage_rows as (
  select post_id, text, split, 'final_label' stage, label, label_name from split_rows
  union all select post_id, text, split, 'subjectivity', case when label_name = 'neutral' then 0 else 1 end, case when label_name = 'neutral' then 'neutral' else 'opinionated' end from split_rows
  union all select post_id, text, split, 'polarity', case when label_name = 'negative' then 0 else 1 end, label_name from split_rows where label_name <> 'neutral')"""


def finals_split(spark, sf):
    return dataset.stratified_split(dataset.final_label_rows(manual(spark, sf)))


@query("final_label_rows", f"with {D_FINAL} select * from final_rows")
def final_label_rows(spark, sf):
    return dataset.final_label_rows(manual(spark, sf))


@query("stratified_split", f"with {D_SPLIT} select post_id, label, split from split_rows")
def stratified_split(spark, sf):
    return finals_split(spark, sf).select("post_id", "label", "split")


@query("derive_stage_rows", f"with {D_STAGES} select * from stage_rows")
def derive_stage_rows(spark, sf):
    return dataset.derive_stage_rows(finals_split(spark, sf))


@query("stage_counts", f"""with {D_STAGES} select stage, count(*) total, count(*) filter (split = 'train') train,
  count(*) filter (split = 'validation') validation from stage_rows group by stage""")
def stage_counts(spark, sf):
    return dataset.stage_counts(dataset.derive_stage_rows(finals_split(spark, sf)))


@query("save_splits", f"with {D_SPLIT} select post_id, text, label, label_name, split from split_rows")
def save_splits(spark, sf):
    path = shared_dir(spark, "splits")
    dataset.save_splits(finals_split(spark, sf), path)
    return spark.read.parquet(path)


@query("dropna_labels", """select post_id, coalesce(cleaned_text, text) input_text from labelled
  where subjectivity_detection is not null and polarity_detection is not null and sarcasm_detection is not null""")
def dropna_labels(spark, sf):
    return dataset.dropna_labels(tables.labelled(spark, sf)).select("post_id", "input_text")


@query("sarcasm_gold_rows", f"""with {D_CLEAN_LABELS} select post_id, {D_CHOSEN} as text, lower(sarcasm_detection) gold from lab
  where lower(sarcasm_detection) in ('sarcastic', 'non-sarcastic') and {D_CHOSEN} <> ''""")
def sarcasm_gold_rows(spark, sf):
    return dataset.sarcasm_gold_rows(manual(spark, sf))


@query("class_distribution", f"with {D_SPLIT} select split, label_name, count(*) n from split_rows group by 1, 2")
def class_distribution(spark, sf):
    return dataset.class_distribution(finals_split(spark, sf))


# ---- metrics -------------------------------------------------------------------------------


def rounded(df, *skip):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


LOGITS = [0.37, 0.59, 0.71]


def logits(spark, sf):
    """Three logits per scored row, mixed from the scores of its text."""
    return scored(spark, sf).select(
        "post_id", "gold3", F.array(*[F.col("opinionated_score") * a - F.col("positive_score") * (1 - a) for a in LOGITS]).alias("logits"))


D_LOGITS = "lg as (select post_id, gold3, [" + ", ".join(
    f"opinionated_score * {a}::double - positive_score * {1 - a}::double" for a in LOGITS) + "] lo from scored)"


@query("argmax_label", f"with {D_LOGITS} select post_id, cast(list_position(lo, list_max(lo)) - 1 as int) best, {d_list(FINAL_LABELS)}[list_position(lo, list_max(lo))] as label from lg")
def argmax_label(spark, sf):
    names = F.array(*[F.lit(l) for l in FINAL_LABELS])
    best = argmax(F.col("logits"))
    return logits(spark, sf).select("post_id", best.alias("best"), F.element_at(names, best + 1).alias("label"))


@query("softmax_positive", f"with {D_LOGITS} select post_id, round(exp(lo[3]) / (exp(lo[1]) + exp(lo[2]) + exp(lo[3])), 6) p from lg")
def softmax_positive(spark, sf):
    return logits(spark, sf).select("post_id", F.round(F.get(softmax(F.col("logits")), F.lit(2)), 6).alias("p"))


def predicted(spark, sf):
    return scored(spark, sf).withColumn("predicted", labels.apply_threshold(
        "opinionated_score", "opinionated", SUBJECTIVITY_LABELS, 0.5))


D_RATIO = "case when ({b}) = 0 then 0.0::double else ({a})::double / ({b}) end"


def d_ratio(a, b):
    return D_RATIO.format(a=a, b=b)


def d_binary(source: str) -> str:
    """Common table `bm` from `source(t, tp, fp, tn, fn)`."""
    f = lambda p, r: d_ratio(f"2 * {p} * {r}", f"{p} + {r}")
    return f"""b1 as (select *, {d_ratio('tp', 'tp + fp')} p, {d_ratio('tp', 'tp + fn')} r, {d_ratio('tn', 'tn + fn')} np, {d_ratio('tn', 'tn + fp')} nr from {source}),
  b2 as (select *, {f('p', 'r')} f, {f('np', 'nr')} nf from b1),
  bm as (select t, {d_ratio('tp + tn', 'tp + fp + tn + fn')} accuracy, p as "precision", r recall, f f1, (f + nf) / 2 macro_f1, (p + np) / 2 macro_precision, (r + nr) / 2 macro_recall,
    {d_ratio('p * (tp + fn) + np * (fp + tn)', 'tp + fp + tn + fn')} weighted_precision, {d_ratio('r * (tp + fn) + nr * (fp + tn)', 'tp + fp + tn + fn')} weighted_recall,
    {d_ratio('f * (tp + fn) + nf * (fp + tn)', 'tp + fp + tn + fn')} weighted_f1, np negative_precision, nr negative_recall, nf negative_f1,
    tp true_positive, fp false_positive, tn true_negative, fn false_negative, tp + fn positive_support, fp + tn negative_support from b2)"""


def d_counts(gold: str, pred: str, pos: str, source: str) -> str:
    g, p = f"{gold} = '{pos}'", f"({pred})"
    return f"""cf as (select 0 t, count(*) filter (({g}) and {p}) tp, count(*) filter (not ({g}) and {p}) fp,
  count(*) filter (not ({g}) and not {p}) tn, count(*) filter (({g}) and not {p}) fn from {source})"""


M_ALL = ["accuracy", '"precision"', "recall", "f1", "macro_f1", "macro_precision", "macro_recall", "weighted_precision", "weighted_recall",
         "weighted_f1", "negative_precision", "negative_recall", "negative_f1"]


@query("binary_metrics", f"""with {d_counts('gold', 'opinionated_score >= 0.5', 'opinionated', 'scored')}, {d_binary('cf')}
  select {', '.join(f'round({m}, 6) {m}' for m in M_ALL)}, round("precision", 6) micro_precision, round(recall, 6) micro_recall, round(f1, 6) micro_f1,
  true_positive, false_positive, true_negative, false_negative, positive_support, negative_support from bm""")
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(predicted(spark, sf), "opinionated"))


def predicted3(spark, sf):
    names = F.array(*[F.lit(l) for l in FINAL_LABELS])
    return logits(spark, sf).select(F.col("gold3").alias("gold"), F.element_at(names, argmax(F.col("logits")) + 1).alias("predicted"))


def d_multi(source: str) -> str:
    """Common tables `lm` (per label) and `mm` (aggregate) from source(gold, predicted)."""
    return f"""lab_list as (select unnest({d_list(FINAL_LABELS)}) as label),
  lc as (select label, count(*) filter (gold = label and predicted = label) tp, count(*) filter (gold <> label and predicted = label) fp,
    count(*) filter (gold = label and predicted <> label) fn, count(*) total, count(*) filter (gold = predicted) ok from lab_list, {source} group by label),
  lp as (select *, tp + fn support, {d_ratio('tp', 'tp + fp')} p, {d_ratio('tp', 'tp + fn')} r from lc),
  lm as (select *, {d_ratio('2 * p * r', 'p + r')} f from lp),
  mm as (select {d_ratio('max(ok)', 'max(total)')} accuracy, sum(p) / 3 macro_precision, sum(r) / 3 macro_recall, sum(f) / 3 macro_f1,
    {d_ratio('sum(p * support)', 'max(total)')} weighted_precision, {d_ratio('sum(r * support)', 'max(total)')} weighted_recall,
    {d_ratio('sum(f * support)', 'max(total)')} weighted_f1 from lm)"""


D_PRED3 = f"{D_LOGITS}, pr as (select gold3 gold, {d_list(FINAL_LABELS)}[list_position(lo, list_max(lo))] predicted from lg)"
M_MULTI = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@query("multiclass_metrics", f"with {D_PRED3}, {d_multi('pr')} select {', '.join(f'round({m}, 6) {m}' for m in M_MULTI)} from mm")
def multiclass_metrics(spark, sf):
    return rounded(metrics.multiclass_metrics(predicted3(spark, sf), FINAL_LABELS))


@query("classification_report", f"""with {D_PRED3}, {d_multi('pr')} select label, round(p, 3) "precision", round(r, 3) recall, round(f, 3) f1, support,
  round({d_ratio('ok', 'total')}, 3) accuracy from lm""")
def classification_report(spark, sf):
    return metrics.classification_report(predicted3(spark, sf), FINAL_LABELS)


def d_sweep(gold: str, score: str, pos: str, source: str) -> str:
    """Common table `bm` with one row per threshold t, by direct comparison."""
    return f"""grid as (select i / 100.0::double t from range(101) r(i)),
  cf as (select t, count(*) filter ({gold} = '{pos}' and {score} >= t) tp, count(*) filter ({gold} <> '{pos}' and {score} >= t) fp,
    count(*) filter ({gold} <> '{pos}' and not {score} >= t) tn, count(*) filter ({gold} = '{pos}' and not {score} >= t) fn from grid, {source} group by t),
  {d_binary('cf')}"""


@query("tune_threshold", f"""with {d_sweep('gold', 'opinionated_score', 'opinionated', 'scored')} select round(t, 6) threshold, 'macro_f1' metric_name, round(macro_f1, 6) metric_value,
  round(accuracy, 6) accuracy, true_positive, false_positive from bm order by macro_f1 desc, abs(t - 0.5::double), t limit 1""")
def tune_threshold(spark, sf):
    out = metrics.tune_threshold(scored(spark, sf), "opinionated", "macro_f1", score="opinionated_score")
    return rounded(out.select("threshold", "metric_name", "metric_value", "accuracy", "true_positive", "false_positive"))


@query("sarcasm_evaluation", f"""with {d_sweep('sarcastic_gold', 'sarcastic_score', 'sarcastic', 'scored')}, best as (select t, f1 from bm order by f1 desc, abs(t - 0.5::double), t limit 1)
  select positive_support + negative_support samples, 0.5::double threshold, {', '.join(f'round(bm.{m}, 6) {m}' for m in ('accuracy', '"precision"', 'recall', 'f1', 'macro_f1', 'weighted_f1'))},
  round(best.t, 6) best_threshold, 'f1' best_threshold_metric, round(best.f1, 6) best_threshold_metric_value from bm, best where bm.t = 0.5""")
def sarcasm_evaluation(spark, sf):
    return rounded(metrics.sarcasm_evaluation(scored(spark, sf), gold="sarcastic_gold", score="sarcastic_score"))


D_FINALS_VAL = f"{D_SPLIT}, fv as (select * from split_rows where split = 'validation')"


@query("untrained_two_stage", f"""with {D_FINALS_VAL}, {d_votes(SUB, 'fv', 'text', name='va')}, st as (select post_id, {d_top(SUB_LABELS)} s1 from va),
  {d_votes(POL, 'fv', 'text', name='vb')}, sp as (select post_id, {d_top(POL_LABELS)} s2 from vb),
  pr as (select label_name gold, case when s1 = 'neutral' then 'neutral' else s2 end predicted from fv join st using (post_id) join sp using (post_id)),
  {d_multi('pr')} select {', '.join(f'round({m}, 6) {m}' for m in M_MULTI)} from mm""")
def untrained_two_stage(spark, sf):
    rows = finals_split(spark, sf).where("split = 'validation'").select("post_id", "text", "label_name")
    return rounded(metrics.multiclass_metrics(jobs.untrained_two_stage(rows), FINAL_LABELS))


# ---- agreement -------------------------------------------------------------------------------

RATERS = {
    "k": "quality", "p": "case when doc_id % 7 = 0 then 1 - quality else quality end",
    "w": "case when doc_id % 5 = 0 then 1 - quality when doc_id % 23 = 0 then null else quality end",
}
TASKS = ["subjectivity_detection", "polarity_detection"]


def d_rater(expr: str) -> str:
    return (f"select 'doc_' || cast(doc_id as string) as post_id, case {expr} when 1 then 'opinionated' when 0 then 'neutral' end as subjectivity_detection, "
            f"case when toxic = 1 then 'negative' when {expr} = 1 then 'positive' else 'neutral' end as polarity_detection from labels")


def raters(spark, sf):
    out = {}
    for name, expr in RATERS.items():
        body = d_rater(expr).removeprefix("select ").removesuffix(" from labels")
        cols = [c.strip() for c in body.replace(", case when toxic", "\x00case when toxic").replace(", case quality", "\x00case quality").replace(", case case", "\x00case case").split("\x00")]
        out[name] = tables.table(spark, sf, "labels").selectExpr(*cols)
    return out


D_RATERS = ", ".join(f"r{n} as ({d_rater(e)})" for n, e in RATERS.items())
D_MERGED = f"{D_RATERS}, merged as (select post_id, " + ", ".join(
    f"r{n}.{t} {t}_{n}" for t in TASKS for n in RATERS) + " from rk join rp using (post_id) join rw using (post_id))"


@query("annotator_merge", f"with {D_MERGED} select * from merged")
def annotator_merge(spark, sf):
    return agreement.merge_annotators(raters(spark, sf), TASKS)


@query("fleiss_kappa", f"""with {D_MERGED}, votes as ({' union all '.join(
    f"select '{t}' task, post_id, unnest([{t}_k, {t}_p, {t}_w]) cat from merged where {t}_k is not null and {t}_p is not null and {t}_w is not null" for t in TASKS)}),
  cells as (select task, post_id, cat, count(*) c from votes group by all), per_post as (select task, post_id, (sum(c * c) - 3) / 6.0::double p from cells group by all),
  po as (select task, avg(p) o, count(*) n from per_post group by task),
  pe as (select task, sum(s * s) e from (select task, cat, sum(c) / sum(sum(c)) over (partition by task)::double s from cells group by task, cat) group by task)
  select task, round((o - e) / (1 - e), 6) kappa, n, case when (o - e) / (1 - e) <= 0.2 then 'slight' when (o - e) / (1 - e) <= 0.4 then 'fair' when (o - e) / (1 - e) <= 0.6 then 'moderate'
  when (o - e) / (1 - e) <= 0.8 then 'substantial' end band from po join pe using (task)""")
def fleiss_kappa(spark, sf):
    merged = agreement.merge_annotators(raters(spark, sf), TASKS)
    return rounded(agreement.fleiss_kappa(merged, TASKS, list(RATERS)))


# ---- training ---------------------------------------------------------------------------------


def stage_rows(spark, sf):
    return cut_lineage(dataset.derive_stage_rows(finals_split(spark, sf)))


def d_counted(n: str, train: str, rows: str, labels: list[str]) -> str:
    """Common table `n`: the rows of a source with p0.. of the count-based classifier
    that another source trains; `n_words` has its weights."""
    k = range(len(labels))
    term = f"unnest(list_distinct(regexp_extract_all(lower(text), '[{WORD_BODY}]+'))) term"
    return f"""{n}_n as (select {', '.join(f"ln(greatest(count(*) filter (label_name = '{l}'), 1)::double / ({' + '.join(f"greatest(count(*) filter (label_name = '{m}'), 1)" for m in labels)})) q{i}" for i, l in enumerate(labels))} from {train}),
  {n}_c as (select term, {', '.join(f"count(*) filter (label_name = '{l}') c{i}" for i, l in enumerate(labels))} from (select label_name, {term} from {train}) group by term),
  {n}_v as (select count(*) v, {', '.join(f'sum(c{i}) s{i}' for i in k)} from {n}_c),
  {n}_words as (select term, {', '.join(f'ln((c{i} + 1)::double / (s{i} + v)::double) w{i}' for i in k)} from {n}_c, {n}_v),
  {n}_s as (select post_id, {', '.join(f'sum(w{i}) w{i}' for i in k)} from (select post_id, {term} from {rows}) join {n}_words using (term) group by post_id),
  {n}_z as (select r.*, {', '.join(f'q{i} + coalesce(w{i}, 0) z{i}' for i in k)} from {rows} r cross join {n}_n left join {n}_s using (post_id)),
  {n}_e as (select *, {', '.join(f"exp(z{i} - greatest({', '.join(f'z{j}' for j in k)})) e{i}" for i in k)} from {n}_z),
  {n} as (select * exclude ({', '.join(f'z{i}, e{i}' for i in k)}), {', '.join(f"round(e{i} / ({' + '.join(f'e{j}' for j in k)}), 6) p{i}" for i in k)} from {n}_e)"""


def d_stage(stage: str, split: str, name: str, source: str = "stage_rows") -> str:
    return f"{name} as (select post_id, text, label_name from {source} where stage = '{stage}' and split = '{split}')"


def d_tuned(name: str, source: str, pos: str, metric: str = "macro_f1") -> str:
    """Common table `name`: threshold t and metric m, best by the sweep over p1."""
    return f"{name} as (with {d_sweep('label_name', 'p1', pos, source)} select t, {metric} m from bm order by {metric} desc, abs(t - 0.5::double), t limit 1)"


def d_hierarchy(rows: str, source: str = "stage_rows") -> str:
    """Common tables of the stored count-based hierarchy: `sub` and `pol` score `rows`,
    `tsub` and `tpol` hold the thresholds."""
    parts = []
    for s, stage, labels, pos in (("sub", "subjectivity", SUBJECTIVITY_LABELS, "opinionated"), ("pol", "polarity", POLARITY_LABELS, "positive")):
        parts += [d_stage(stage, "train", f"{s}_train", source), d_stage(stage, "validation", f"{s}_val", source),
                  d_counted(f"{s}_check", f"{s}_train", f"{s}_val", labels), d_tuned(f"t{s}", f"{s}_check", pos), d_counted(s, f"{s}_train", rows, labels)]
    return ", ".join(parts)


MAJORITY = {"subjectivity": SUBJECTIVITY_LABELS, "polarity": POLARITY_LABELS}


def d_trained(stage: str) -> str:
    """One row: what is certain of a trained stage."""
    a, b = (f"count(*) filter (split = 'validation' and label_name = '{l}')" for l in MAJORITY[stage])
    return f"""select '{stage}' stage, count(*) filter (split = 'train') train_rows, count(*) filter (split = 'validation') validation_rows,
  round(greatest({a}, {b}) / nullif(count(*) filter (split = 'validation'), 0)::double, 6) majority_accuracy,
  true at_least_majority, true threshold_helps, true reloaded_equal from stage_rows where stage = '{stage}'"""


def checked(spark, rows, trained, path, stage):
    """The trained stage's row next to what its stored model gives when read back."""
    names, positive = training.STAGES[stage]
    model = classifiers.load_model(spark, path)
    again = training.stage_score(model, names, positive, rows.where("split = 'validation'"))
    again = metrics.binary_metrics(again, positive).select(F.col("macro_f1").alias("_again"))
    config = classifiers.read_config(spark, path).select(F.col("decision_threshold").alias("_threshold"))
    both = metrics.side_by_side(metrics.side_by_side(trained, again), config)
    a = F.col("majority_accuracy")
    return both.select(
        "stage", "train_rows", "validation_rows", F.round(a, 6).alias("majority_accuracy"),
        # the label most rows have alone: one F1 of 2a / (1 + a), the other 0
        (F.col("macro_f1") >= a / (1 + a) - 1e-9).alias("at_least_majority"),
        (F.col("threshold_metric_value") >= F.col("macro_f1")).alias("threshold_helps"),
        ((F.abs(F.col("_again") - F.col("macro_f1")) < 1e-9) & (F.col("_threshold") == F.col("selected_threshold"))).alias("reloaded_equal"))


@query("train_stage", f"with {D_STAGES} {d_trained('subjectivity')}")
def train_stage(spark, sf):
    rows = stage_rows(spark, sf).where("stage = 'subjectivity'").drop("stage")
    path = shared_dir(spark, "stage")
    return checked(spark, rows, training.fit_stage(rows, "subjectivity", path), path, "subjectivity")


@query("train_hierarchical", f"with {D_STAGES}, {d_hierarchy('pol_val')} "
       "select 'subjectivity' stage, ['neutral', 'opinionated'] labels, 'opinionated' positive_label, t decision_threshold, round(m, 6) threshold_metric_value, "
       "(select count(*) from stage_rows where stage = 'subjectivity') total, (select count(*) from stage_rows where stage = 'subjectivity' and split = 'train') train from tsub "
       "union all select 'polarity', ['negative', 'positive'], 'positive', t, round(m, 6), (select count(*) from stage_rows where stage = 'polarity'), "
       "(select count(*) from stage_rows where stage = 'polarity' and split = 'train') from tpol")
def train_hierarchical(spark, sf):
    path = shared_dir(spark, "hierarchy")
    training.fit_hierarchy(stage_rows(spark, sf), path, manual(spark, sf), learner="counts")
    config = classifiers.read_config(spark, *[f"{path}/{s}" for s in training.STAGES])
    counts = spark.read.parquet(f"{path}/stage_counts").select("stage", "total", "train")
    return rounded(config.select("stage", "labels", "positive_label", "decision_threshold", "threshold_metric_value").join(F.broadcast(counts), "stage"))


@query("predict_stored", f"""with {D_STAGES}, {d_stage('final_label', 'validation', 'fin')}, {d_hierarchy('fin')}
  select sub.post_id, case when sub.p1 >= tsub.t then 'opinionated' else 'neutral' end stage1_label, round(case when sub.p1 >= tsub.t then sub.p1 else sub.p0 end, 6) stage1_score,
    case when sub.p1 >= tsub.t then case when pol.p1 >= tpol.t then 'positive' else 'negative' end end stage2_label,
    case when sub.p1 >= tsub.t then round(case when pol.p1 >= tpol.t then pol.p1 else pol.p0 end, 6) end stage2_score,
    case when not sub.p1 >= tsub.t then 'neutral' when pol.p1 >= tpol.t then 'positive' else 'negative' end final_label
  from sub join pol using (post_id), tsub, tpol""")
def predict_stored(spark, sf):
    path, rows = shared_dir(spark, "hierarchy"), stage_rows(spark, sf)
    training.fit_hierarchy(rows, path, learner="counts")
    finals = rows.where("stage = 'final_label' and split = 'validation'").select("post_id", "text")
    return rounded(training.predict_stored(finals, path).select("post_id", "stage1_label", "stage1_score", "stage2_label", "stage2_score", "final_label"))


D_FLAT = f"{d_stage('final_label', 'train', 'flat_train')}, {d_stage('final_label', 'validation', 'flat_val')}, {d_counted('flat', 'flat_train', 'flat_val', FINAL_LABELS)}"
D_FLAT_TOP = f"{d_list(FINAL_LABELS)}[list_position([p0, p1, p2], greatest(p0, p1, p2))]"


@query("train_flat", f"""with {D_STAGES}, {D_FLAT}, pr as (select label_name gold, {D_FLAT_TOP} predicted from flat), {d_multi('pr')}
  select {', '.join(f'round({m}, 6) {m}' for m in M_MULTI)} from mm""")
def train_flat(spark, sf):
    finals = stage_rows(spark, sf).where("stage = 'final_label'")
    model = classifiers.fit_counts(finals.where("split = 'train'"), FINAL_LABELS)
    pred = model.scores(finals.where("split = 'validation'").select("post_id", "text", "label_name")).select(
        F.col("label_name").alias("gold"), training.top_label("scores", FINAL_LABELS).alias("predicted"))
    return rounded(metrics.multiclass_metrics(pred, FINAL_LABELS))


@query("train_flat_weights", f"with {D_STAGES}, {D_FLAT} select term, round(w0, 6) w0, round(w1, 6) w1, round(w2, 6) w2 from flat_words")
def train_flat_weights(spark, sf):
    train = stage_rows(spark, sf).where("stage = 'final_label' and split = 'train'")
    return rounded(classifiers.fit_counts(train, FINAL_LABELS).weights)


# Rows that chose neither model nor threshold: the test part of the split.
D_APART = """apart as (select * replace (case when split = 'validation' and ascii(substr(md5(post_id || ':test'), 32, 1)) % 2 = 1 then 'test' else split end as split) from stage_rows)"""


def d_on_test(variant: str, source: str) -> str:
    return f"(with {d_multi(source)} select '{variant}' variant, round(accuracy, 6) accuracy, round(macro_f1, 6) macro_f1, round(weighted_f1, 6) weighted_f1 from mm)"


@query("ablation_compare", f"""with {D_STAGES}, {D_APART}, {d_stage('final_label', 'test', 'fin', 'apart')}, {d_hierarchy('fin', 'apart')},
  {d_stage('final_label', 'train', 'flat_train', 'apart')}, {d_counted('flat', 'flat_train', 'fin', FINAL_LABELS)},
  {d_votes(SUB, 'fin', 'text', name='va')}, {d_votes(POL, 'fin', 'text', name='vb')},
  st as (select post_id, {d_top(SUB_LABELS)} s1 from va), sp as (select post_id, {d_top(POL_LABELS)} s2 from vb),
  pr_two as (select sub.label_name gold, case when not sub.p1 >= tsub.t then 'neutral' when pol.p1 >= tpol.t then 'positive' else 'negative' end predicted from sub join pol using (post_id), tsub, tpol),
  pr_none as (select label_name gold, case when s1 = 'neutral' then 'neutral' else s2 end predicted from fin join st using (post_id) join sp using (post_id)),
  pr_flat as (select label_name gold, {D_FLAT_TOP} predicted from flat)
  {d_on_test('hierarchical_trained', 'pr_two')} union all {d_on_test('no_training', 'pr_none')} union all {d_on_test('no_hierarchy', 'pr_flat')}""")
def ablation_compare(spark, sf):
    return rounded(training.compare_on_test(stage_rows(spark, sf), jobs.untrained_two_stage, shared_dir(spark, "ablation")))


@query("pretrained_vs_trained", f"""with {D_STAGES}, {D_APART}, {d_stage('subjectivity', 'test', 'sv', 'apart')},
  {d_votes(SUB, 'sv', 'text', name='va')}, pre as (select label_name gold, {d_top(SUB_LABELS)} predicted from va join sv using (post_id)),
  {d_stage('subjectivity', 'train', 'sub_train', 'apart')}, {d_stage('subjectivity', 'validation', 'sub_val', 'apart')},
  {d_counted('sub_check', 'sub_train', 'sub_val', SUBJECTIVITY_LABELS)}, {d_tuned('tsub', 'sub_check', 'opinionated')}, {d_counted('sub', 'sub_train', 'sv', SUBJECTIVITY_LABELS)},
  own as (select label_name gold, case when p1 >= t then 'opinionated' else 'neutral' end predicted from sub, tsub),
  a as (with {d_counts('gold', "predicted = 'opinionated'", 'opinionated', 'pre')}, {d_binary('cf')} select * from bm),
  b as (with {d_counts('gold', "predicted = 'opinionated'", 'opinionated', 'own')}, {d_binary('cf')} select * from bm)
  select 'subjectivity' task, round(a.accuracy, 6) accuracy_a, round(a.macro_f1, 6) macro_f1_a, round(b.accuracy, 6) accuracy_b, round(b.macro_f1, 6) macro_f1_b,
  round(b.accuracy - a.accuracy, 6) accuracy_gain, round(b.macro_f1 - a.macro_f1, 6) macro_f1_gain from a, b""")
def pretrained_vs_trained(spark, sf):
    """Label scoring without training against the trained, stored stage, on rows neither has seen."""
    rows = training.held_apart(stage_rows(spark, sf).where("stage = 'subjectivity'").drop("stage"))
    path = shared_dir(spark, "stage")
    training.fit_stage(rows, "subjectivity", path, learner="counts")
    test = rows.where("split = 'test'").select("post_id", "text", "label_name")
    untrained = relevance.candidate_scores(test, SUB, ["post_id", "label_name"], "text").select(
        F.col("label_name").alias("gold"), relevance.top_label(SUB_LABELS).alias("predicted"))
    threshold = classifiers.read_config(spark, path).select("decision_threshold").first()[0]
    own = classifiers.load_model(spark, path).scores(test).select(F.col("label_name").alias("gold"), labels.apply_threshold(
        F.element_at("scores", "opinionated"), "opinionated", SUBJECTIVITY_LABELS, threshold).alias("predicted"))
    sides = [metrics.binary_metrics(d, "opinionated").withColumn("task", F.lit("subjectivity")) for d in (untrained, own)]
    return rounded(metrics.compare_models(*sides))
