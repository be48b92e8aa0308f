"""Queries: cleaning, incremental state, relevance and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import tokens, word_count
from voxtide.operators import cleaning, relevance, scoring, sentiment, state
from voxtide.plans import jobs
from voxtide.plans.catalog_ingest import d_reasons, d_strip, profile_of
from voxtide.plans.registry import D_NWS, WORD_BODY, d_any, d_collapse, d_list, d_trim, d_values, d_words, query
from voxtide.schema import CLEAN_STATUSES
from voxtide.session import cut_lineage
from voxtide.sources import tables

# ---- cleaning --------------------------------------------------------------------


def one_step(step, spark, sf):
    return tables.opinions(spark, sf).select("post_id", step("text").alias("out"))


def d_contract(x: str) -> str:
    # RE2 knows the same patterns; group references are spelled with a backslash
    out = f"replace({x}, '’', '''')"
    for pattern, long_form in vocab.CONTRACTION_RULES:
        out = f"""regexp_replace({out}, '{pattern.replace("'", "''")}', '{long_form.replace('$1', chr(92) + '1')}', 'g')"""
    return out


def d_demojize(x: str) -> str:
    names = "map {" + ", ".join(f"'{e}': '{n}'" for e, n in vocab.EMOJI_NAMES.items()) + "}"
    skins = "map {" + ", ".join(f"'{e}': '_{n}_skin_tone'" for e, n in vocab.SKIN_TONES.items()) + "}"
    bare = f"(substr(e, 1, 1) || regexp_replace(substr(e, 2), '\\x{{FE0F}}|{cleaning.SKIN}', '', 'g'))"
    parts = f"list_transform(string_split({bare}, '\u200d'), lambda s: {names}[s])"
    name = f"""case when regexp_matches(e, '^[\\x{{1F1E6}}-\\x{{1F1FF}}]') then 'flag_' || translate(e, '{cleaning.FLAG_LETTERS}', 'abcdefghijklmnopqrstuvwxyz')
      when regexp_matches(e, '[\\x{{E0020}}-\\x{{E007E}}]') then 'flag_' || translate(e, '{cleaning.FLAG_TAGS}\U0001F3F4\U000E007F', '0123456789abcdefghijklmnopqrstuvwxyz')
      when ends_with(e, '\u20e3') then 'keycap_' || substr(e, 1, 1)
      else coalesce({names}[{bare}], case when len(list_filter({parts}, lambda p: p is null)) = 0 then array_to_string({parts}, '_') end)
        || array_to_string(list_transform(regexp_extract_all(substr(e, 2), '{cleaning.SKIN}'), lambda s: {skins}[s]), '') end"""
    found = f"list_transform(regexp_extract_all({x}, '{cleaning.EMOJI}'), lambda e: coalesce(' ' || ({name}) || ' ', e))"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{cleaning.EMOJI}'), {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def d_lemma(t: str) -> str:
    rules = " ".join(
        f"when {t} like '%{end}' then " + (f"left({t}, length({t}) - {cut}) || '{add}'" if cut else t)
        for end, cut, add in vocab.LEMMA_SUFFIXES
    )
    table = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.IRREGULAR_LEMMAS.items()) + "}"
    return f"""case when {t} like '#%' then {t} when {t} in ({', '.join(f"'{k}'" for k in vocab.IRREGULAR_LEMMAS)}) then {table}[{t}]
      when length({t}) < {vocab.LEMMA_MIN_LENGTH} then {t} {rules} else {t} end"""


def d_steps(source: str) -> str:
    """Common tables s0..s8 and `clean`: the chain over the source's text, step by step."""
    token = cleaning.TOKEN.replace("'", "''")
    return f"""s1 as (select *, {d_strip('text')} x1 from {source}),
  s2 as (select *, {d_contract('x1')} x2 from s1), s3 as (select *, {d_demojize('x2')} x3 from s2),
  s4 as (select *, lower(x3) x4 from s3), s5 as (select *, regexp_replace(x4, 'https?://{D_NWS}+', '', 'g') x5 from s4),
  s6 as (select *, regexp_replace(x5, '\\p{{Nd}}+', '', 'g') x6 from s5), s7 as (select *, {d_collapse('x6')} x7 from s6),
  s8 as (select *, regexp_replace(x7, '[^\\x00-\\x7F]+', ' ', 'g') x8 from s7),
  s9 as (select *, list_transform(regexp_extract_all(x8, '{token}'), lambda t: replace(t, ' ', '')) toks from s8),
  clean as (select *, array_to_string(list_transform(toks, lambda t: {d_lemma('t')}), ' ') cleaned from s9)"""


@query("strip_html", f"select post_id, {d_strip('text')} out from opinions")
def strip_html(spark, sf):
    return one_step(cleaning.strip_html, spark, sf)


@query("expand_contractions", f"select post_id, {d_contract('text')} out from opinions")
def expand_contractions(spark, sf):
    return one_step(cleaning.expand_contractions, spark, sf)


@query("demojize", f"select post_id, {d_demojize('text')} out from opinions")
def demojize(spark, sf):
    return one_step(cleaning.demojize, spark, sf)


@query("lowercase", "select post_id, lower(text) out from opinions")
def lowercase(spark, sf):
    return one_step(cleaning.lowercase, spark, sf)


@query("remove_urls", f"select post_id, regexp_replace(text, 'https?://{D_NWS}+', '', 'g') out from opinions")
def remove_urls(spark, sf):
    return one_step(cleaning.remove_urls, spark, sf)


@query("remove_numbers", "select post_id, regexp_replace(text, '\\p{Nd}+', '', 'g') out from opinions")
def remove_numbers(spark, sf):
    return one_step(cleaning.remove_numbers, spark, sf)


@query("normalize_whitespace", f"select post_id, {d_collapse('text')} out from opinions")
def normalize_whitespace(spark, sf):
    return one_step(cleaning.normalize_whitespace, spark, sf)


@query("remove_non_ascii", "select post_id, regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g') out from opinions")
def remove_non_ascii(spark, sf):
    return one_step(cleaning.remove_non_ascii, spark, sf)


D_TOK = cleaning.TOKEN.replace("'", "''")
D_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g')"


@query("tokenize_text", f"select post_id, array_to_string(regexp_extract_all({D_ASCII}, '{D_TOK}'), '¦') out from opinions")
def tokenize_text(spark, sf):
    return one_step(lambda c: F.array_join(cleaning.tokenize(cleaning.remove_non_ascii(c)), "¦"), spark, sf)


@query("rejoin_hashtags", f"""select post_id, array_to_string(list_transform(regexp_extract_all({D_ASCII}, '{D_TOK}'),
  lambda t: replace(t, ' ', '')), '¦') out from opinions""")
def rejoin_hashtags(spark, sf):
    return one_step(lambda c: F.array_join(cleaning.rejoin_hashtags(cleaning.tokenize(cleaning.remove_non_ascii(c))), "¦"), spark, sf)


@query("lemmatize", f"""select post_id, array_to_string(list_transform(regexp_extract_all(lower({D_ASCII}), '{D_TOK}'),
  lambda t: {d_lemma('t')}), '¦') out from opinions""")
def lemmatize(spark, sf):
    return one_step(lambda c: F.array_join(cleaning.lemmatize(cleaning.tokenize(F.lower(cleaning.remove_non_ascii(c)))), "¦"), spark, sf)


@query("clean_text", f"with {d_steps('opinions')} select post_id, cleaned from clean")
def clean_text(spark, sf):
    return cleaning.with_clean_text(tables.opinions(spark, sf), "text", "cleaned").select("post_id", "cleaned")


D_BOT_PHRASE = d_any("lower(text)", vocab.BOT_PHRASES)
D_BOT_AUTHOR = "regexp_matches(author, '(?i)bot([^\\p{L}\\p{N}_]|$)|\\.bot$|automod')"


@query("bot_phrase", f"select post_id, {D_BOT_PHRASE} is_bot from opinions")
def bot_phrase(spark, sf):
    return tables.opinions(spark, sf).select("post_id", cleaning.bot_phrase("text").alias("is_bot"))


@query("bot_author", f"select post_id, author, {D_BOT_AUTHOR} is_bot from opinions")
def bot_author(spark, sf):
    return tables.opinions(spark, sf).select("post_id", "author", cleaning.bot_author("author").alias("is_bot"))


@query("min_word_count", f"with {d_steps('opinions')} select post_id, {d_words('cleaned')} words, {d_words('cleaned')} < 10 too_short from clean")
def min_word_count(spark, sf):
    df = cleaning.with_clean_text(tables.opinions(spark, sf), "text", "cleaned")
    n = word_count("cleaned")
    return df.select("post_id", n.cast("bigint").alias("words"), (n < vocab.MIN_WORD_COUNT).alias("too_short"))


def d_duplicates(source: str) -> str:
    return f"""dups as (select *, ingest_seq <> min(ingest_seq) over (partition by md5(lower({d_trim('text')}))) is_duplicate from {source})"""


def d_statuses(source: str) -> str:
    return f"""{d_duplicates(source)}, {d_steps('dups')},
  statuses as (select * exclude (cleaned_text, clean_status), case when is_duplicate then 'duplicate' when {D_BOT_PHRASE} or {D_BOT_AUTHOR} then 'bot'
    when {d_words('cleaned')} < 10 then 'too_short' else 'cleaned' end clean_status, cleaned from clean)"""


@query("exact_duplicates", f"with {d_duplicates('opinions')} select post_id, is_duplicate from dups")
def exact_duplicates(spark, sf):
    return cleaning.exact_duplicates(tables.opinions(spark, sf)).select("post_id", "is_duplicate")


@query("clean_status", f"""with {d_statuses('stored')} select post_id, clean_status,
  case when clean_status = 'cleaned' then cleaned end cleaned_text from statuses""")
def clean_status(spark, sf):
    return cleaning.clean_rows(tables.stored(spark, sf)).select("post_id", "clean_status", "cleaned_text")


@query("clean_summary", f"""with {d_statuses('stored')} select s.clean_status, count(t.post_id) n
  from (select unnest({d_list(CLEAN_STATUSES)}) clean_status) s left join statuses t using (clean_status) group by 1""")
def clean_summary(spark, sf):
    return cleaning.clean_summary(cleaning.clean_rows(tables.stored(spark, sf)), CLEAN_STATUSES)


def d_media(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    out = f"regexp_replace({out}, '!\\[[^\\n]*?\\]\\([^\\n]*?\\)', '', 'g')"
    return d_collapse(f"regexp_replace({out}, 'http{D_NWS}+|www{D_NWS}+', '', 'g')")


D_CHAIN = f"""c1 as (select * from comments where {d_words('text')} >= 10),
  c2 as (select * from (select * exclude (text), {d_media('text')} as text from c1) where {d_words('text')} >= 10),
  c3 as (select * from c2 where not contains(lower(text), '{vocab.COMMENT_BOT_SENTENCE}'))"""


@query("csv_min_words", f"""select count(*) records_in, count(*) filter (w >= 10) records_out, count(*) filter (w < 10) records_removed,
  cast(coalesce(sum(w) filter (w >= 10), 0) as bigint) words_kept from (select {d_words('text')} w from comments)""")
def csv_min_words(spark, sf):
    return cleaning.csv_min_words_report(tables.comments(spark, sf))


@query("csv_strip_media", f"select ingest_seq, t as text from (select *, {d_media('text')} t from comments) where {d_words('t')} >= 10")
def csv_strip_media(spark, sf):
    return cleaning.csv_strip_media(tables.comments(spark, sf)).select("ingest_seq", "text")


@query("csv_drop_bot", f"select ingest_seq, text from comments where not contains(lower(text), '{vocab.COMMENT_BOT_SENTENCE}')")
def csv_drop_bot(spark, sf):
    return cleaning.csv_drop_bot(tables.comments(spark, sf)).select("ingest_seq", "text")


@query("csv_chain", f"with {D_CHAIN} select ingest_seq, text from c3")
def csv_chain(spark, sf):
    return cleaning.csv_chain(tables.comments(spark, sf)).select("ingest_seq", "text")


@query("corpus_stats", f"""with {D_CHAIN}, w as (select regexp_extract_all(lower(text), '{D_NWS}+') ws from c3),
  t as (select (select count(*) from w) records, (select cast(sum(len(ws)) as bigint) from w) words,
        (select count(distinct x) from (select unnest(ws) x from w)) unique_words)
  select *, round(cast(words as double) / records, 2) words_per_record from t where records > 0""")
def corpus_stats(spark, sf):
    return cleaning.corpus_stats(cleaning.csv_chain(tables.comments(spark, sf)))


# ---- incremental state ------------------------------------------------------------


@query("pending_sentiment", "select post_id from stored where sentiment_score is null")
def pending_sentiment(spark, sf):
    return state.pending_sentiment(tables.stored(spark, sf)).select("post_id")


@query("pending_clean", "select post_id from stored where clean_status is null")
def pending_clean(spark, sf):
    return state.pending_clean(tables.stored(spark, sf)).select("post_id")


@query("pending_relevance", "select post_id from stored where relevance_label is null")
def pending_relevance(spark, sf):
    return state.pending_relevance(tables.stored(spark, sf)).select("post_id")


@query("pending_classification", """select 'subjectivity' task, post_id from stored where subjectivity_label is null
  union all select 'polarity', post_id from stored where polarity_label is null""")
def pending_classification(spark, sf):
    df = tables.stored(spark, sf)
    parts = [state.pending_classification(df, t).select(F.lit(t).alias("task"), "post_id") for t in state.TASKS]
    return parts[0].unionByName(parts[1])


@query("apply_updates", """with updates as (select 'doc_' || cast(doc_id * 2 as varchar) post_id,
    case when doc_id % 3 = 0 then null else 'new ' || source end cleaned_text, 'cleaned' clean_status from documents)
  select post_id, case when u.post_id is not null then u.cleaned_text else s.cleaned_text end cleaned_text,
    case when u.post_id is not null then u.clean_status else s.clean_status end clean_status, s.likes
  from stored s left join updates u using (post_id)""")
def apply_updates(spark, sf):
    updates = tables.documents(spark, sf).selectExpr(
        "'doc_' || cast(doc_id * 2 as string) as post_id",
        "case when doc_id % 3 = 0 then null else 'new ' || source end as cleaned_text", "'cleaned' as clean_status")
    out = state.apply_updates(tables.stored(spark, sf), updates, ["cleaned_text", "clean_status"])
    return out.select("post_id", "cleaned_text", "clean_status", "likes")


@query("label_store", """with clean as (select 'doc_' || cast(doc_id * 2 as varchar) post_id,
    case when doc_id % 3 = 0 then null else 'new ' || source end cleaned_text, 'cleaned' clean_status from documents where doc_id % 5 > 0
    union all select 'doc_' || cast(doc_id * 2 as varchar), 'second ' || lang, 'duplicate' from documents where doc_id % 5 = 0),
  scores as (select 'doc_' || cast(doc_id as varchar) post_id, n_chars / 7.0::double sentiment_score, 'neutral' sentiment_label from documents where doc_id % 4 = 1)
  select post_id, s.text, case when c.post_id is not null then c.cleaned_text else s.cleaned_text end cleaned_text,
    case when c.post_id is not null then c.clean_status else s.clean_status end clean_status,
    case when x.post_id is not null then x.sentiment_score else s.sentiment_score end sentiment_score,
    case when x.post_id is not null then x.sentiment_label else s.sentiment_label end sentiment_label
  from stored s left join clean c using (post_id) left join scores x using (post_id)""")
def label_store(spark, sf):
    docs = tables.documents(spark, sf)
    even = "'doc_' || cast(doc_id * 2 as string) as post_id"
    clean = docs.selectExpr(even, "case when doc_id % 3 = 0 then null else 'new ' || source end as cleaned_text", "'cleaned' as clean_status")
    again = docs.where("doc_id % 5 = 0").selectExpr(even, "'second ' || lang as cleaned_text", "'duplicate' as clean_status")
    scores = docs.where("doc_id % 4 = 1").selectExpr("'doc_' || cast(doc_id as string) as post_id", "n_chars / double(7.0) as sentiment_score", "'neutral' as sentiment_label")
    store = state.open_store(tables.stored(spark, sf))
    for updates in (clean, again):
        store = state.put_labels(spark, store, updates, ["cleaned_text", "clean_status"])
    store = state.put_labels(spark, store, scores, ["sentiment_score", "sentiment_label"])
    return state.read_store(spark, store).select("post_id", "text", "cleaned_text", "clean_status", "sentiment_score", "sentiment_label")


@query("reset_columns", "select post_id, cast(null as double) sentiment_score, cast(null as varchar) sentiment_label, relevance_label from stored")
def reset_columns(spark, sf):
    out = state.reset_columns(tables.stored(spark, sf), "sentiment")
    return out.select("post_id", "sentiment_score", "sentiment_label", "relevance_label")


@query("count_by_platform", "select platform, count(*) n from stored group by 1")
def count_by_platform(spark, sf):
    return state.count_by_platform(tables.stored(spark, sf))


# ---- relevance -----------------------------------------------------------------------

D_SCORING = "coalesce(nullif(cleaned_text, ''), text)"


@query("scoring_text", f"select post_id, {D_SCORING} input from stored")
def scoring_text(spark, sf):
    return tables.stored(spark, sf).select("post_id", relevance.scoring_text().alias("input"))


def d_votes(weights: dict[str, dict[str, int]], source: str, text: str, key: str = "post_id", name: str = "votes") -> str:
    """Common table: key, v0.. summed weights, e0.. softmax scores."""
    classes = list(weights)
    rows = [(i, t, w) for i, c in enumerate(classes) for t, w in weights[c].items()]
    n = len(classes)
    sums = ", ".join(f"coalesce(sum(w) filter (c = {i}), 0) v{i}" for i in range(n))
    top = f"greatest({', '.join(f'v{i}' for i in range(n))})"
    total = " + ".join(f"exp((v{i} - {top}) / 1000.0::double)" for i in range(n))
    return f"""{name}_t as (select {key}, unnest(regexp_extract_all(lower({text}), '[{WORD_BODY}]+')) term from {source}),
  {name}_w as (select * from {d_values(rows)} t(c, term, w)),
  {name}_s as (select {key}, {sums} from {name}_t join {name}_w using (term) group by {key}),
  {name}_f as (select s.{key}, {', '.join(f'cast(coalesce(v{i}, 0) as bigint) v{i}' for i in range(n))} from {source} s left join {name}_s using ({key})),
  {name} as (select *, {', '.join(f'exp((v{i} - {top}) / 1000.0::double) / ({total}) e{i}' for i in range(n))} from {name}_f)"""


def d_top(labels: list[str]) -> str:
    vs = ", ".join(f"v{i}" for i in range(len(labels)))
    return f"{d_list(labels)}[list_position([{vs}], greatest({vs}))]"


def d_top_score(n: int) -> str:
    return f"greatest({', '.join(f'e{i}' for i in range(n))})"


REL = vocab.RELEVANCE_TERMS
REL_NAMES = [vocab.RELEVANCE_CANDIDATES[c] for c in REL]


@query("candidate_label_scores", f"""with {d_votes(REL, 'stored', D_SCORING)},
  long as (select post_id, unnest({d_list(list(REL))}) as label, unnest([e0, e1, e2]) s from votes)
  select post_id, label, round(s, 6) score, row_number() over (partition by post_id order by round(s, 9) desc, list_position({d_list(list(REL))}, label)) as rank
  from long""")
def candidate_label_scores(spark, sf):
    df = relevance.candidate_scores(tables.stored(spark, sf), REL, ["post_id"], relevance.scoring_text())
    names = F.array(*[F.lit(c) for c in REL])
    # inside the row: order by votes descending, ties in candidate order
    order = F.transform(F.array_sort(F.transform("votes", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"])
    ranked = F.transform(order, lambda i, k: F.struct(
        F.get(names, i).alias("label"), F.round(F.get(F.col("scores"), i), 6).alias("score"), (k + 1).cast("bigint").alias("rank")))
    return df.select("post_id", F.explode_outer(ranked).alias("r")).select("post_id", "r.*")


@query("relevance_label", f"""with {d_votes(REL, 'stored', D_SCORING)}
  select post_id, {d_top(REL_NAMES)} relevance_label, round({d_top_score(3)}, 6) relevance_score from votes""")
def relevance_label(spark, sf):
    out = relevance.relevance_labels(tables.stored(spark, sf), ["post_id"], relevance.scoring_text())
    return out.withColumn("relevance_score", F.round("relevance_score", 6))


def length_scorer():
    """A stand-in for a model: label scores from the text length."""
    labels = list(vocab.RELEVANCE_CANDIDATES)

    def score(texts):
        out = []
        for t in texts:
            k = len(t) % 3
            out.append({l: 0.8 if i == k else 0.1 for i, l in enumerate(labels)})
        return out

    return score


@query("relevance_batches", f"""select post_id, {d_list(REL_NAMES)}[1 + length({D_SCORING}) % 3] relevance_label, 0.8::double relevance_score
  from stored where relevance_label is null""")
def relevance_batches(spark, sf):
    pending = state.pending_relevance(tables.stored(spark, sf)).select("post_id", relevance.scoring_text().alias("input"))
    scored = scoring.score_with(pending, length_scorer, "input", ["post_id"], "length", batch_size=64)
    labels = F.array(*[F.lit(c) for c in vocab.RELEVANCE_CANDIDATES])
    best = F.array_max(F.map_values("scores"))
    top = F.get(F.filter(labels, lambda l: F.element_at("scores", l) == best), F.lit(0))
    score, name = relevance.relevance_from_scores(F.array(top), F.array(best))
    return scored.select("post_id", name.alias("relevance_label"), score.alias("relevance_score"))


@query("score_with", f"""select post_id, {d_list(list(vocab.RELEVANCE_CANDIDATES))}[1 + length({D_SCORING}) % 3] as label, 0.8::double score from stored""")
def score_with(spark, sf):
    rows = tables.stored(spark, sf).select("post_id", relevance.scoring_text().alias("input"))
    scored = scoring.score_with(rows, length_scorer, "input", ["post_id"], "length", batch_size=32)
    best = F.array_max(F.map_values("scores"))
    top = F.map_keys(F.map_filter("scores", lambda _, v: v == best))
    return scored.select("post_id", F.get(top, F.lit(0)).alias("label"), best.alias("score"))


@query("relevance_summary", """select count(*) filter (relevance_label = 'relevant') relevant, count(*) filter (relevance_label = 'spam') spam,
  count(*) filter (relevance_label = 'off_topic') off_topic from stored""")
def relevance_summary(spark, sf):
    return relevance.relevance_summary(tables.stored(spark, sf))


@query("relevant_only", "select post_id, relevance_label from stored where relevance_label is null or relevance_label = 'relevant'")
def relevant_only(spark, sf):
    return relevance.relevant_only(tables.stored(spark, sf)).select("post_id", "relevance_label")


# ---- sentiment -------------------------------------------------------------------------


def d_in(x: str, values: list[str]) -> str:
    return f"{x} in ({', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)})"


def d_sentiment(source: str, table: str | None = None) -> str:
    """Common table `sentiment`: post_id, score; with the lexicon of a table, if given."""
    boost = lambda p: f"case when {d_in(p, vocab.BOOST_WORDS)} then {vocab.BOOST}::double when {d_in(p, vocab.DAMPEN_WORDS)} then {-vocab.BOOST}::double else 0.0::double end"
    neg = lambda p: f"(case when {d_in(p, vocab.NEGATIONS)} then 1 else 0 end)"
    push = " + ".join(f"({boost(p)}) * {d}::double" for p, d in zip(("p1", "p2", "p3"), vocab.BOOST_DECAY))
    lex = table or d_values(sorted(vocab.SENTIMENT_LEXICON.items()))
    known = f"low[pos] in (select term from {table})" if table else d_in("low[pos]", list(vocab.SENTIMENT_LEXICON))
    powers = ", ".join(f"{round(vocab.NEGATE ** k, 6)}::double" for k in range(4))
    return f"""st as (select post_id, text, regexp_extract_all(replace(text, '’', ''''), '[{WORD_BODY}'']+') toks from {source}),
  sl as (select post_id, list_transform(toks, lambda t: lower(t)) low, toks, regexp_matches(text, '\\p{{Ll}}') mixed,
    least(length(text) - length(replace(text, '!', '')), 4) bangs, length(text) - length(replace(text, '?', '')) asks from st),
  se as (select post_id, mixed, coalesce(list_position(low, 'but'), 0) but, unnest(range(1, len(toks) + 1)) pos, low, toks from sl),
  sw as (select post_id, mixed, but, pos, toks[pos] t, low[pos] term, case when pos > 1 then low[pos - 1] else '' end p1,
    case when pos > 2 then low[pos - 2] else '' end p2, case when pos > 3 then low[pos - 3] else '' end p3 from se
    where {known}),
  sh as (select post_id, (valence + sign(valence) * (case when mixed and upper(t) = t and lower(t) <> t then {vocab.CAPS}::double else 0.0::double end + ({push})))
    * ([{powers}])[{neg('p1')} + {neg('p2')} + {neg('p3')} + 1]
    * case when but > 0 and pos < but then 0.5::double when but > 0 and pos > but then 1.5::double else 1.0::double end v
    from sw join (select term, valence::double valence from {lex} l(term, valence)) using (term)),
  ss as (select post_id, sum(cast(round(v * 1e6) as bigint)) micro from sh group by post_id),
  sm as (select post_id, coalesce(micro, 0) micro, bangs * {vocab.EXCLAIM}::double + case when asks <= 1 then 0.0::double when asks <= 3 then asks * {vocab.QUESTION}::double
    else {vocab.QUESTION_MANY}::double end emphasis from sl left join ss using (post_id)),
  sq as (select post_id, micro / 1e6::double + sign(micro) * emphasis total from sm),
  sentiment as (select post_id, round(total / sqrt(total * total + 15.0::double), 4) sentiment_score from sq)"""


D_LABEL = "case when sentiment_score >= 0.05 then 'positive' when sentiment_score <= -0.05 then 'negative' else 'neutral' end"


@query("lexicon_sentiment", f"with {d_sentiment('opinions')} select post_id, sentiment_score from sentiment")
def lexicon_sentiment(spark, sf):
    return sentiment.lexicon_sentiment(tables.opinions(spark, sf), sentiment.lexicon_table(spark), ["post_id"])


# Every word of the posts as a lexicon, its valence from its hash: a table that grows with the input.
D_ALL_WORDS = f"""words as (select distinct unnest(regexp_extract_all(lower(replace(text, '’', '''')), '[{WORD_BODY}'']+')) term from opinions),
  lexicon as (select term, (strpos('0123456789abcdef', substr(md5(term), 1, 1)) - 8)::double / 4 valence from words)"""


@query("table_lexicon_sentiment", f"with {D_ALL_WORDS}, {d_sentiment('opinions', 'lexicon')} select post_id, sentiment_score from sentiment")
def table_lexicon_sentiment(spark, sf):
    posts = tables.opinions(spark, sf)
    words = posts.select(F.explode(tokens(F.lower(F.replace(F.col("text"), F.lit("’"), F.lit("'"))), "'")).alias("term")).distinct()
    valence = (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("term").cast("binary")), 1, 1)) - 8) / 4
    return sentiment.lexicon_sentiment(posts, cut_lineage(words.withColumn("valence", valence)), ["post_id"], max_terms=1000)


@query("sentiment_label", f"with {d_sentiment('opinions')} select post_id, {D_LABEL} sentiment_label from sentiment")
def sentiment_label(spark, sf):
    df = sentiment.lexicon_sentiment(tables.opinions(spark, sf), sentiment.lexicon_table(spark), ["post_id"])
    return df.select("post_id", sentiment.sentiment_label("sentiment_score").alias("sentiment_label"))


D_SUMMARY = """summary as (select count(sentiment_score) total, count(*) filter (sentiment_score is not null and sentiment_label = 'positive') positive,
  count(*) filter (sentiment_score is not null and sentiment_label = 'negative') negative,
  count(*) filter (sentiment_score is not null and sentiment_label = 'neutral') neutral,
  coalesce(round(avg(sentiment_score), 4), 0) avg_score from stored)"""


@query("sentiment_summary", f"with {D_SUMMARY} select * from summary")
def sentiment_summary(spark, sf):
    return sentiment.summarize(tables.stored(spark, sf))


@query("report_platform_counts", "select platform, count(*) n from stored group by platform order by platform")
def report_platform_counts(spark, sf):
    return sentiment.platform_counts(tables.stored(spark, sf))


@query("report_percentages", f"""with {D_SUMMARY} select {', '.join(
    f"round(cast({c} as double) / greatest(total, 1) * 100, 1) {c}_pct" for c in ('positive', 'negative', 'neutral'))} from summary""")
def report_percentages(spark, sf):
    return sentiment.percentages(sentiment.summarize(tables.stored(spark, sf)))


@query("report_samples", """select sentiment_label, platform, author, left(text, 100) as "sample" from (select *, row_number() over
  (partition by sentiment_label order by ingest_seq) rn from stored where sentiment_label in ('positive', 'negative')) where rn <= 3""")
def report_samples(spark, sf):
    return sentiment.samples(tables.stored(spark, sf))


@query("opinion_report", f"""with {d_reasons()}, accepted as (select * from reasons where reason is null),
  {d_duplicates('accepted')}, uniq as (select * from dups where not is_duplicate), {d_sentiment('uniq')},
  labelled_rows as (select *, {D_LABEL} label from uniq join sentiment using (post_id))
  select platform, count(*) n, count(*) filter (label = 'positive') positive, count(*) filter (label = 'negative') negative,
  count(*) filter (label = 'neutral') neutral, round(avg(sentiment_score), 4) avg_score from labelled_rows group by platform""")
def opinion_report(spark, sf):
    return jobs.opinion_report(tables.opinions(spark, sf), sentiment.lexicon_table(spark), profile_of(spark, sf))


# ---- whole runs ------------------------------------------------------------------------


@query("clean_run", f"""with pend as (select * from stored where clean_status is null), {d_statuses('pend')}
  select s.post_id, coalesce(s.clean_status, t.clean_status) clean_status,
    case when t.post_id is null then s.cleaned_text when t.clean_status = 'cleaned' then t.cleaned end cleaned_text
  from stored s left join statuses t using (post_id)""")
def clean_run(spark, sf):
    return jobs.clean_run(tables.stored(spark, sf))[0].select("post_id", "clean_status", "cleaned_text")


@query("sentiment_run", f"""with pend as (select * from stored where sentiment_score is null), {d_sentiment('pend')},
  found as (select post_id, sentiment_score new_score, {D_LABEL} new_label from sentiment)
  select post_id, coalesce(sentiment_score, new_score) sentiment_score, coalesce(sentiment_label, new_label) sentiment_label
  from stored left join found using (post_id)""")
def sentiment_run(spark, sf):
    out = jobs.sentiment_run(tables.stored(spark, sf), sentiment.lexicon_table(spark))
    return out.select("post_id", "sentiment_score", "sentiment_label")


@query("relevance_run", f"""with pend as (select * from stored where relevance_label is null), {d_votes(REL, 'pend', D_SCORING)}
  select post_id, coalesce(relevance_label, {d_top(REL_NAMES)}) relevance_label, round(coalesce(relevance_score, {d_top_score(3)}), 6) relevance_score
  from stored left join votes using (post_id)""")
def relevance_run(spark, sf):
    out = jobs.relevance_run(tables.stored(spark, sf))
    return out.select("post_id", "relevance_label", F.round("relevance_score", 6).alias("relevance_score"))
