"""Canonical keys, tokens, n-grams and titles as native column expressions.

Word characters are [\\p{L}\\p{N}_] and white space [\\s\\p{Z}\\x1c-\\x1f\\x85], which are Unicode's in every engine."""

from __future__ import annotations

from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
DASHES = r"[\-\x{2010}-\x{2014}\x{2212}]+"
# Last words that look plural and are not.
NOT_PLURAL = ["us", "is", "was", "his", "this", "series", "species", "news", "physics", "mathematics", "economics"]
# Phrases that stand in for an article.
REFUSALS = ["no article content generated", "no article can be generated", "cannot generate an article", "unable to generate an article"]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def canon_key(c: Column) -> Column:
    """Canonical key of a string in compatibility form; ASCII always is. See `with_canon_key` for others. A word of small letters and digits is its own, which
    most are, so they cost one look."""
    made = F.lower(squeeze(c))
    made = F.regexp_replace(F.replace(made, F.lit("_"), F.lit(" ")), DASHES, " ")
    return F.when(c.rlike(r"^[\p{Ll}0-9]+\z"), c).otherwise(squeeze(F.regexp_replace(made, NOT_WORD, "")))


def funnel_key(c: Column) -> Column:
    """The reporting variant: underscores are dashes, no compatibility form."""
    c = F.regexp_replace(F.lower(squeeze(c)), r"[_\-\x{2010}-\x{2014}\x{2212}]+", " ")
    return squeeze(F.regexp_replace(c, NOT_WORD, ""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize("NFKC", x))


def with_canon_key(df: DataFrame, column: str, out: str = "canon_key") -> DataFrame:
    """Adds the canonical key. Only rows beyond ASCII visit Python."""
    ascii_only = F.coalesce(F.col(column), F.lit("")).rlike(r"^\p{ASCII}*$")
    native = df.filter(ascii_only).withColumn(out, canon_key(F.col(column)))
    return native.unionByName(df.filter(~ascii_only).withColumn(out, canon_key(nfkc(F.col(column)))))


def _last(key: Column) -> tuple[Column, Column]:
    words = F.split(key, " ")
    return F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")


def _rejoin(head: Column, last: Column) -> Column:
    return F.when(head == "", last).otherwise(F.concat(head, F.lit(" "), last))


def singular(key: Column) -> Column:
    """The key with its last word in the singular, null if that changes nothing."""
    last, head = _last(key)
    n = F.length(last)
    stem = lambda k: F.substring(last, F.lit(1), n - k)
    made = (
        F.when(last.endswith("ies") & (n > 4), F.concat(stem(3), F.lit("y")))
        .when((n > 4) & last.rlike(r"(ches|shes|[sxz]es)$"), stem(2))
        .when(last.endswith("s") & ~last.endswith("ss"), stem(1))
    )
    return F.when((n > 3) & ~last.isin(NOT_PLURAL), _rejoin(head, made))


def plural(key: Column) -> Column:
    """The key with an s on its last word, null where none is put."""
    last, head = _last(key)
    return F.when((F.length(last) > 3) & ~last.isin(NOT_PLURAL) & ~last.endswith("s"), _rejoin(head, F.concat(last, F.lit("s"))))


def title_and_confidence(c: Column) -> Column:
    """struct(title, confidence) of 'Title (0.97)'."""
    t, rx = F.trim(c), r"^(.*)\((0\.\d+|1(?:\.0+)?)\)\s*$"
    base = F.trim(F.regexp_extract(t, rx, 1))
    return F.struct(F.when(t.rlike(rx) & (base != ""), base).otherwise(t).alias("title"), F.when(t.rlike(rx), F.regexp_extract(t, rx, 2).cast("double")).alias("confidence"))


def is_refusal(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (low == "") | low.rlike("|".join(REFUSALS))


def tokens(c: Column) -> Column:
    """Lower case, punctuation is white space."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")


def index_tokens(c: Column, stop: list[str], least: int = 2) -> Column:
    """ASCII search tokens without stop words, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def ngrams(words: Column, n: int, separator: str = "\u0001") -> Column:
    """Joined n-grams in order; none if there are fewer than n words. Words are laid beside the words after them."""
    count = F.size(words) - (n - 1)
    joined = F.slice(words, F.lit(1), F.greatest(count, F.lit(0)))
    for k in range(1, n):
        joined = F.zip_with(joined, F.slice(words, F.lit(k + 1), F.greatest(count, F.lit(0))), lambda x, y: F.concat(x, F.lit(separator), y))
    return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def slug(c: Column) -> Column:
    """Each space is one underscore, ends are stripped before; a run of other odd characters is one underscore too."""
    return F.regexp_replace(F.replace(strip(c), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_\-.()]+", "_")


def safe_file_name(c: Column, most: int = 120) -> Column:
    """Each odd character is an underscore of its own, dots too; then ends are stripped and spaces become underscores."""
    return F.substring(F.replace(strip(F.regexp_replace(c, r"[^\p{L}\p{N}_\- ]", "_")), F.lit(" "), F.lit("_")), 1, most)


def item_key(subject: Column, hop: Column) -> Column:
    """Short readable head, hop, digest of the full identity."""
    whole = F.concat(subject, F.lit("␞"), hop.cast("string"))
    return F.concat_ws("_", F.substring(F.replace(canon_key(subject), F.lit(" "), F.lit("_")), 1, 60), F.concat(F.lit("h"), hop.cast("string")), F.substring(F.sha1(whole), 1, 12))


def hop_bucket(hop: Column) -> Column:
    return F.when(hop <= 0, "hop0").when(hop >= 5, "hop5plus").otherwise(F.concat(F.lit("hop"), hop.cast("string")))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit("…"))).otherwise(c)


def as_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(default))


def alternates(title: Column) -> Column:
    """A title's other forms: without its parenthesis, and what stands before a comma."""
    bare = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*", " "))
    head = F.trim(F.substring_index(title, ",", 1))
    return F.array_distinct(F.filter(F.array(title, bare, head), lambda x: x != ""))


PARENTHESIS = r"(?s)^(.+?)\s*\((.+?)\)\s*$"


def _subject(title: Column) -> tuple[Column, Column, Column]:
    """The stripped subject, what stands in its closing parenthesis (or null), and both in one line."""
    clean = strip(title)
    inside = F.when(clean.rlike(PARENTHESIS), strip(F.regexp_extract(clean, PARENTHESIS, 2)))
    return clean, inside, F.when(inside.isNull(), clean).otherwise(F.concat(strip(F.regexp_extract(clean, PARENTHESIS, 1)), F.lit(" "), inside))


def search_query(title: Column) -> Column:
    """The single query of the first evidence pipeline."""
    return F.concat(F.lit('"'), _subject(title)[2], F.lit('" history facts encyclopedia'))


def search_queries(title: Column, most: int = 3) -> Column:
    """The queries of the second evidence pipeline."""
    clean, inside, full = _subject(title)
    exact = F.when(inside.isNull(), F.concat(F.lit('"'), clean, F.lit('" biography history overview'))).otherwise(F.concat(F.lit('"'), inside, F.lit('" history overview')))
    return F.slice(F.array(F.concat(full, F.lit(" encyclopedia overview facts")), F.concat(full, F.lit(" wikipedia")), exact), 1, most)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced for the given names alone."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def file_extension(url: Column, default: str = ".jpg") -> Column:
    """Extension of an image's path, in lower case; the default where there is none that is known."""
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1))
    found = F.regexp_extract(path, r"(\.(?:jpg|jpeg|png|gif|svg|webp))$", 1)
    return F.when(found == "", default).otherwise(found)


def first_setting(*settings: Column) -> Column:
    """A stage's setting, else the global one, else the default: the first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in settings))


def wait_seconds(message: Column, now: Column, default: float = 8.0) -> Column:
    """Seconds from `now` until the UTC time at which a provider's message says that its limit resets, and a half; the default where it
    names no time or one that is not within two minutes."""
    told = F.regexp_extract(message, r"Limit resets at:\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    wait = F.unix_timestamp(F.try_to_timestamp(told, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("double") - now.cast("timestamp").cast("double")
    return F.coalesce(F.when((wait > 0) & (wait < 120), wait + 0.5), F.lit(default))


def safe_run_name(path: Column) -> Column:
    """A run's relative path as one name."""
    inner = F.regexp_replace(strip(path), "^/+|/+$", "")
    return F.when(inner == "", "root_run").otherwise(F.replace(inner, F.lit("/"), F.lit("__")))


def first_subject(fields: dict[str, Column]) -> Column:
    """struct(subject, field): the first field that is not blank, and its name."""
    told = F.coalesce(*(F.when(F.coalesce(strip(c), F.lit("")) != "", F.struct(strip(c).alias("subject"), F.lit(k).alias("field"))) for k, c in fields.items()))
    return told
