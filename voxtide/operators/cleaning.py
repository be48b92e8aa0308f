"""Text normalisation and clean status.

The whole chain is Column functions on one row: no shuffle, no Python. Duplicates
are settled on ids and 16-byte hashes; rows then meet the ids of duplicates, a
join that Spark broadcasts where that table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import NOT_WS, as_col, collapse, contains_any, exact_hash, where_has, word_count
from voxtide.operators.skew import attach_stats
from voxtide.operators.votes import fixed_map, literal_map
from voxtide.session import cut_lineage

MARKUP_BODIES = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
# A tag whose attribute values may hold `>` between quotes; at each place there is one way
# on, so no engine searches back. What has more than 100 attributes is left to TAG.
_VALUE = "[^\\s\"'>][^\\s>]*"
QUOTED_TAG = f"</?[A-Za-z!][^>=]*(?:=\\s*(?:\"[^\"]*\"[^>=]*|'[^']*'[^>=]*|{_VALUE}\\s[^>=]*)){{0,100}}(?:=\\s*(?:{_VALUE})?)?>"
TAG = "</?[A-Za-z!][^>]*>"
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Emoji: flags of two letters or of tags, keycaps, and signs with their variants and joins.
_LETTERS, _TAGS = "\\x{1F1E6}-\\x{1F1FF}", "\\x{E0020}-\\x{E007E}"
_SIGNS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [*vocab.EMOJI_RANGES, *vocab.EMOJI_SIGNS])
SKIN = "[\\x{1F3FB}-\\x{1F3FF}]"
_SIGN = f"(?:{SKIN}|[{_SIGNS}](?:\\x{{FE0F}}|{SKIN})?)"
EMOJI = f"[{_LETTERS}]{{2}}|\\x{{1F3F4}}[{_TAGS}]+\\x{{E007F}}|[0-9#*]\\x{{FE0F}}?\\x{{20E3}}|{_SIGN}(?:\\x{{200D}}{_SIGN})*"
EMOJI_HINT = f"[{_SIGNS}{_LETTERS}\\x{{20E3}}]"
# The same, behind a few ranges that hold all of their first characters: at most places
# of a text these fail, and a class of fifty ranges is not looked at.
_NEAR = "\\xA9\\xAE\\x{203C}-\\x{303D}\\x{3297}\\x{3299}\\x{1F000}-\\x{1FAFF}"
EMOJI_FAST, EMOJI_HINT_FAST = f"(?=[{_NEAR}]|[0-9#*]\\x{{FE0F}}?\\x{{20E3}})(?:{EMOJI})", f"[{_NEAR}&&{EMOJI_HINT}]"
FLAG_LETTERS = "".join(chr(c) for c in range(0x1F1E6, 0x1F200))
FLAG_TAGS = "".join(chr(c) for c in [*range(0xE0030, 0xE003A), *range(0xE0061, 0xE007B)])
TOKEN = "#\\s*(?:\\w+(?:'\\w+)?|[^\\w\\s])|\\w+(?:'\\w+)?|[^\\w\\s]"
# Patterns of bot author names.
BOT_AUTHORS = [r"bot\b", r"\.bot$", r"automod"]


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _replace_all(text: Column, found: Column, value) -> Column:
    """text with each of the found strings replaced by value(string), in order."""
    return F.aggregate(found, text, lambda acc, x: F.replace(acc, x, value(x)))


def decode_entities(text: Column | str) -> Column:
    """Named and numeric entities as the characters they stand for, in one pass:
    what an ampersand's own entity uncovers is not decoded again."""
    text = as_col(text)
    names = fixed_map(vocab.HTML_ENTITIES)

    def char(e: Column) -> Column:
        digits = F.when(e.rlike("^&#[xX]"), F.conv(F.substring(e, 4, 6), 16, 10)).otherwise(F.regexp_extract(e, "[0-9]+", 0))
        code = digits.try_cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(e.startswith("&#"), numeric).otherwise(F.element_at(names, e)), e)

    def last_amp(found: Column) -> Column:
        return F.concat(F.filter(found, lambda e: char(e) != "&"), F.filter(found, lambda e: char(e) == "&"))

    return let(text, lambda t: where_has(t, "&", let(
        F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))), lambda found: _replace_all(t, last_amp(found), char)), t))


def strip_html(text: Column | str) -> Column:
    """Markup out, a space in its place; entities decoded. A `>` between the quotes of
    an attribute's value does not end the tag."""
    text = as_col(text)
    bare = F.regexp_replace(text, MARKUP_BODIES, " ")
    bare = F.regexp_replace(where_has(text, "=", F.regexp_replace(bare, QUOTED_TAG, " "), bare), TAG, " ")
    return decode_entities(where_has(text, "<", bare, text))


def expand_contractions(text: Column | str) -> Column:
    """Long forms; texts without an apostrophe are passed through untouched."""
    text = F.replace(as_col(text), F.lit("’"), F.lit("'"))
    out = text
    for pattern, long_form in vocab.CONTRACTION_RULES:
        out = F.regexp_replace(out, pattern, long_form)
    return where_has(text, "'", out, text)


def emoji_name(e: Column, names: dict[str, str] | None = None) -> Column:
    """Name of one emoji sequence, or null. Variant selectors say nothing; skin tones
    are named at the end; a join without a name of its own is named by its parts."""
    table = fixed_map(names or vocab.EMOJI_NAMES)
    skins = F.transform(F.regexp_extract_all(F.substring(e, 2, 100), F.lit(SKIN), F.lit(0)),
                        lambda s: F.concat(F.lit("_"), F.element_at(literal_map(vocab.SKIN_TONES), s), F.lit("_skin_tone")))
    # the first sign is kept even where it is a skin tone by itself
    bare = F.concat(F.substring(e, 1, 1), F.regexp_replace(F.substring(e, 2, 100), f"\\x{{FE0F}}|{SKIN}", ""))
    parts = F.transform(F.split(bare, "\\x{200D}"), lambda x: F.element_at(table, x))
    joined = F.when(F.forall(parts, lambda x: x.isNotNull()), F.array_join(parts, "_"))
    sign = F.concat(F.coalesce(F.element_at(table, bare), joined), F.array_join(skins, ""))
    return (
        F.when(e.rlike(f"^[{_LETTERS}]"), F.concat(F.lit("flag_"), F.translate(e, FLAG_LETTERS, "abcdefghijklmnopqrstuvwxyz")))
        .when(e.rlike(f"[{_TAGS}]"), F.concat(F.lit("flag_"), F.translate(e, FLAG_TAGS + "\U0001F3F4\U000E007F", "0123456789abcdefghijklmnopqrstuvwxyz")))
        .when(e.endswith("\u20e3"), F.concat(F.lit("keycap_"), F.substring(e, 1, 1)))
        .otherwise(sign)
    )


def demojize(text: Column | str, names: dict[str, str] | None = None) -> Column:
    """Emoji to ` name `, the longest sequence at each place as one; what has no name
    stays. The text is cut at its emoji and put together again in one pass."""
    text = as_col(text)

    def named(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(EMOJI_FAST), F.lit(0)),
                            lambda e: F.coalesce(F.concat(F.lit(" "), emoji_name(e, names), F.lit(" ")), e))
        return F.array_join(F.zip_with(F.split(t, EMOJI_FAST, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # a text of ASCII alone has as many bytes as characters
    return let(text, lambda t: F.when((F.octet_length(t) != F.length(t)) & t.rlike(EMOJI_HINT_FAST), named(t)).otherwise(t))


def lowercase(text: Column | str) -> Column:
    return F.lower(as_col(text))


def remove_urls(text: Column | str) -> Column:
    text = as_col(text)
    return where_has(text, "http", F.regexp_replace(text, f"https?://{NOT_WS}+", ""), text)


def remove_numbers(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), "\\p{Nd}+", "")


def normalize_whitespace(text: Column | str) -> Column:
    return collapse(text)


def remove_non_ascii(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), "[^\\x00-\\x7F]+", " ")


def tokenize(text: Column | str) -> Column:
    """Word and punctuation tokens; a `#` takes the token after it along."""
    return F.regexp_extract_all(as_col(text), F.lit(TOKEN), F.lit(0))


def rejoin_hashtags(tokens: Column) -> Column:
    # only "# tag" still holds a blank
    return F.transform(tokens, lambda t: F.replace(t, F.lit(" ")))


def lemma(token: Column, irregular: dict[str, str] | None = None) -> Column:
    """Noun lemma of one token; hashtags and short words stay as they are.

    The hash-set test runs for every token, the map lookup only on its hits.
    """
    irregular = irregular or vocab.IRREGULAR_LEMMAS
    table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    length = F.length(token)
    out = F.when(token.isin(list(irregular)), F.element_at(table, token))
    out = out.when(~token.endswith("s") | token.startswith("#") | (length < vocab.LEMMA_MIN_LENGTH), token)
    for ending, cut, add in vocab.LEMMA_SUFFIXES:
        stem = F.substring(token, F.lit(1), length - cut) if cut else token
        out = out.when(token.endswith(ending), F.concat(stem, F.lit(add)) if add else stem)
    return out.otherwise(token)


def lemmatize(tokens: Column, irregular: dict[str, str] | None = None) -> Column:
    return F.transform(tokens, lambda t: lemma(t, irregular))


STEPS = (strip_html, expand_contractions, demojize, lowercase, remove_urls,
         remove_numbers, normalize_whitespace, remove_non_ascii)


def with_clean_text(df: DataFrame, text: Column | str = "text", out: str = "cleaned_text") -> DataFrame:
    """df plus the normalised, tokenised and lemmatised text.

    Every step is a projection of its own: a step looks at its input more than
    once, and nested into one expression the inputs would be computed anew for
    every look. Spark still runs all of them in one generated loop.
    """
    df = df.withColumn(out, as_col(text))
    for step in STEPS:
        df = df.withColumn(out, step(out))
    df = df.withColumn(out, tokenize(out))
    return df.withColumn(out, F.array_join(F.transform(out, lambda t: lemma(F.replace(t, F.lit(" ")))), " "))


def bot_phrase(text: Column | str, phrases: list[str] | None = None) -> Column:
    return contains_any(F.lower(as_col(text)), phrases or vocab.BOT_PHRASES)


def bot_author(author: Column | str) -> Column:
    return F.coalesce(as_col(author).rlike("(?iU)" + "|".join(BOT_AUTHORS)), F.lit(False))


def is_bot(text: Column | str, author: Column | str) -> Column:
    return bot_phrase(text) | bot_author(author)


def repeated(df: DataFrame, key: str, order: str = "ingest_seq") -> DataFrame:
    """df plus `is_duplicate`: an earlier row of df has the same key."""
    # written out: the table of repeated keys is read twice, and its known size
    # lets Spark broadcast it where it is small
    firsts = cut_lineage(
        df.groupBy(key)
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    out = attach_stats(df, firsts, [key], ["_first"], "_n", F.col(order))
    return out.select(*df.columns, F.coalesce(F.col("_first") != F.col(order), F.lit(False)).alias("is_duplicate"))


def duplicate_ids(df: DataFrame, text: str = "text", order: str = "ingest_seq") -> DataFrame:
    """order of the rows whose stripped, lower-cased text stands in an earlier row.
    Settled on ids and hashes; kept in the shared folder, so that its size is known."""
    narrow = df.select(order, exact_hash(text).alias("_hash"))
    return cut_lineage(repeated(narrow, "_hash", order).where("is_duplicate").select(F.col(order).alias("_dup")))


def exact_duplicates(df: DataFrame, text: str = "text", order: str = "ingest_seq") -> DataFrame:
    """df plus `is_duplicate`: an earlier row of df has the same stripped,
    lower-cased text. Only the ids of duplicates are joined to df."""
    joined = df.join(duplicate_ids(df, text, order), F.col(order) == F.col("_dup"), "left")
    return joined.withColumn("is_duplicate", F.col("_dup").isNotNull()).drop("_dup")


def clean_rows(df: DataFrame, text: str = "text", author: str = "author", order: str = "ingest_seq") -> DataFrame:
    """df with cleaned_text and clean_status set. Duplicate beats bot beats
    too_short. Rows are cleaned where they lie and then meet the ids of duplicates,
    so a caller that wants statuses alone moves no text."""
    base = df.drop("cleaned_text", "clean_status")
    # bot rows go through the chain as nulls, which costs nothing
    rows = base.withColumn("_bot", is_bot(text, author))
    rows = with_clean_text(rows, F.when(~F.col("_bot"), F.col(text)), "_clean").withColumn("_short", word_count("_clean") < vocab.MIN_WORD_COUNT)
    joined = rows.join(duplicate_ids(base, text, order), F.col(order) == F.col("_dup"), "left")
    status = (
        F.when(F.col("_dup").isNotNull(), "duplicate").when(F.col("_bot"), "bot").when(F.col("_short"), "too_short").otherwise("cleaned")
    )
    return (
        joined.withColumn("clean_status", status)
        .withColumn("cleaned_text", F.when(F.col("clean_status") == "cleaned", F.col("_clean")))
        .select(*base.columns, "cleaned_text", "clean_status")
    )


def clean_summary(df: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows per status, zeros shown: one wide aggregate, then stacked."""
    wide = df.agg(*[F.count_if(F.col("clean_status") == s).alias(s) for s in statuses])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("clean_status"), F.col(s).alias("n")) for s in statuses
    ])).alias("r")).select("r.*")


# ---- CSV cleaning chain of the comment corpus -------------------------------

def csv_min_words(df: DataFrame, text: str = "text", n: int = vocab.MIN_WORD_COUNT) -> DataFrame:
    return df.where(word_count(text) >= n)


def csv_min_words_report(df: DataFrame, text: str = "text", n: int = vocab.MIN_WORD_COUNT) -> DataFrame:
    words = word_count(text)
    keep = words >= n
    return df.agg(
        F.count(F.lit(1)).alias("records_in"),
        F.count_if(keep).alias("records_out"),
        F.count_if(~keep).alias("records_removed"),
        F.coalesce(F.sum(F.when(keep, words)), F.lit(0)).cast("bigint").alias("words_kept"),
    )


def strip_media(text: Column | str) -> Column:
    out = F.regexp_replace(as_col(text), "<[^>]+>", "")
    out = F.regexp_replace(out, "!\\[[^\\n]*?\\]\\([^\\n]*?\\)", "")
    out = F.regexp_replace(out, f"http{NOT_WS}+|www{NOT_WS}+", "")
    return collapse(out)


def csv_strip_media(df: DataFrame, text: str = "text", n: int = vocab.MIN_WORD_COUNT) -> DataFrame:
    return df.withColumn(text, strip_media(text)).where(word_count(text) >= n)


def csv_drop_bot(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~F.lower(F.col(text)).contains(vocab.COMMENT_BOT_SENTENCE))


def csv_chain(df: DataFrame, text: str = "text") -> DataFrame:
    return csv_drop_bot(csv_strip_media(csv_min_words(df, text), text), text)


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """records, words, distinct lower-cased words, words per record; no row for no records.

    A null marker per record is counted along with the words, so one shuffle of
    (word, count) pairs yields all four numbers.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{NOT_WS}+"), F.lit(0))
    per_word = (
        df.select(F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(words, F.array().cast("array<string>")))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    stats = per_word.agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("records"),
        F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("words"),
        F.count("word").alias("unique_words"),
    )
    return stats.where(F.col("records") > 0).withColumn(
        "words_per_record", F.round(F.col("words") / F.col("records"), 2))
