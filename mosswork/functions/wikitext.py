"""Wikitext and HTML parsing in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of links, categories, headings and scripts.
CATEGORY = r"(?i)\[\[Category:([^|\]]+)(?:\|[^\]]*)?\]\]"
LINK = r"\[\[([^:|\]]+)(?:\|[^\]]*)?\]\]"
RAW_LINK = r"\[\[([^\]]+)\]\]"
HEADING = r"^==\s*(.*?)\s*==\s*$"
SCRIPT = r"(?is)<(script|style|noscript)[^>]*>.*?</\1>"
# Sections of which links do not count.
IGNORED = ["see also", "further reading", "external links", "references", "notes", "bibliography"]


def _tidy(found: Column, most: int | None) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") if most is None else (x != "") & (F.length(x) <= most)))


def categories(text: Column) -> Column:
    return F.filter(_tidy(F.regexp_extract_all(text, F.lit(CATEGORY), 1), 10**6), lambda x: F.size(F.split(x, r"\s+")) <= 6)


def links(text: Column) -> Column:
    """Distinct link targets without a colon, first seen first."""
    return _tidy(F.regexp_extract_all(text, F.lit(LINK), 1), 150)


def links_outside(text: Column, ignored: list[str] = IGNORED, most: int | None = 150) -> Column:
    """As `links`, line by line, leaving out the ignored sections. A deeper heading ends its section, for it matches the same pattern. most: characters of a
    target (the feature's own limit); None keeps them all."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        heading = F.trim(line).rlike(HEADING)
        name = F.lower(F.trim(F.regexp_extract(F.trim(line), HEADING, 1)))
        more = F.when(heading | acc.skip, acc.found).otherwise(F.concat(acc.found, F.regexp_extract_all(line, F.lit(LINK), 1)))
        return F.struct(F.when(heading, name.isin(ignored)).otherwise(acc.skip).alias("skip"), more.alias("found"))

    return _tidy(F.aggregate(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), start, step, lambda acc: acc.found), most)


def raw_links(text: Column) -> Column:
    """struct(n, targets): every bracket, and distinct targets before the bar, colons kept."""
    found = F.regexp_extract_all(text, F.lit(RAW_LINK), 1)
    return F.struct(F.size(found).alias("n"), F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != "")).alias("targets"))


def section_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(HEADING)))


# Patterns of comments, references, links, external links, bold and tags, in their order.
MARKUP = (
    (r"(?s)<!--.*?-->", ""), (r"(?is)<ref[^>/]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), (r"\[https?://\S+\s+([^\]]+)\]", "$1"), (r"\[https?://\S+\]", ""), (r"'{2,}", ""), (r"<[^>]+>", ""),
)


def plain(text: Column) -> Column:
    """Comments, references, links, external links and bold away."""
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Fixed value: a template without braces inside.
TEMPLATE = r"\{\{[^{}]*+\}\}"
# Up to three templates in each other, and what stands between them; what it matches would go innermost first as well.
NESTED = r"\{\{[^{}]*+(?:\{\{[^{}]*+(?:\{\{[^{}]*+\}\}[^{}]*+)*+\}\}[^{}]*+)*+\}\}"


def without_templates(text: Column, passes: int | None = None) -> Column:
    """Innermost templates first, until none is left, or `passes` times. Without a number a pass takes three depths at once, and the first pass that finds
    nothing is the last, however many braces without a partner a text has."""
    if passes is not None:
        return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), text, lambda t, _: F.when(F.instr(t, "{{") > 0, F.regexp_replace(t, TEMPLATE, "")).otherwise(t))
    rounds = F.sequence(F.lit(1), F.greatest(F.floor(F.regexp_count(text, F.lit(r"\}")) / 2).cast("int"), F.lit(1)))  # a template takes two of them
    made = lambda t, more: F.struct(t.alias("t"), more.alias("more"))

    def step(acc: Column, _: Column) -> Column:
        again = F.regexp_replace(acc.t, NESTED, "")
        return F.when(acc.more & (F.instr(acc.t, "{{") > 0), F.get(F.transform(F.array(again), lambda n: made(n, F.length(n) < F.length(acc.t))), F.lit(0))).otherwise(acc)

    return F.aggregate(rounds, made(text, F.lit(True)), step, lambda acc: acc.t)


def excerpt(text: Column, words: int) -> Column:
    """The first words of the text without templates and markup; names of categories stay, as links are unwrapped first."""
    return F.array_join(F.slice(F.split(plain(without_templates(text)), r"\s+"), 1, words), " ")


def clean_for_evaluation(text: Column) -> Column:
    """Piped links become their targets, scores like (0.97) go."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\[([^\]|]+?)(?:\|[^\]]+?)?\]\]", "$1"), r"\(\d+\.\d+\)", ""))


def snippet(text: Column, most: int = 250) -> Column:
    p = plain(without_templates(text))
    return F.when(F.length(p) > most, F.concat(F.substring(p, 1, most), F.lit("..."))).otherwise(p)


def html_text(html: Column) -> Column:
    """Scripts, styles and tags away, six entities read, white space squeezed."""
    t = F.regexp_replace(F.regexp_replace(html, SCRIPT, " "), r"(?s)<[^>]+>", " ")
    for entity, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(by))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), 1))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def contents(html: Column, least: int = 3) -> Column:
    """Headings of levels 2 and 3 as array<struct<level,title>>; empty if there are fewer than `least`."""
    level = F.regexp_extract_all(html, F.lit(r"(?is)<h([23])[^>]*>.*?</h\1>"), 1)
    title = F.regexp_extract_all(html, F.lit(r"(?is)<h([23])[^>]*>(.*?)</h\1>"), 2)
    both = F.transform(F.arrays_zip(level.alias("level"), title.alias("title")), lambda x: F.struct(x.level.cast("int").alias("level"), F.trim(F.regexp_replace(x.title, "<[^>]+>", "")).alias("title")))
    return F.when(F.size(level) >= least, both).otherwise(F.slice(both, 1, 0))


def snippets(text: Column, words: int = 140, stride: int = 100, most: int = 12) -> Column:
    """Sliding word windows, as many as it takes to cover the tail, `most` at most (the feature's own limit)."""
    w = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda x: x != "")
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.size(w) - words) / stride).cast("int") + 1))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * stride + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))


def without_tags(text: Column) -> Column:
    """Tags away and two entities read."""
    return F.replace(F.replace(F.regexp_replace(text, "<[^>]+>", ""), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


# Patterns of the fallback text, in their order.
FALLBACK = (
    (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), (r"\[https?://[^\s\]]+ ([^\]]+)\]", "$1"), (r"(?i)'{2,5}|={2,6}[^=]+=+|<[^>]+>|\[\[File:[^\]]*\]\]|\[\[Image:[^\]]*\]\]", " "), (r"==+\s*[^=\n]+\s*==+", " "),
    (r"\n\*+\s*", "\n"), (r"\n#+\s*", "\n"), (r"\|\s*\w[\w\s]*=\s*[^\|}\n]*", " "), (r"\{\|[^|]*", " "), (r"\|\}", " "), (r"https?://\S+", " "), (r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"),
)


def fallback_text(text: Column) -> Column:
    """Text of a fetched page's source: five rounds of templates, then links, markup, lists, tables and addresses."""
    t = F.aggregate(F.sequence(F.lit(1), F.lit(5)), text, lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", " "))
    for pattern, by in FALLBACK:
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(t, r"^\s+|\s+$", "")
