"""Pairwise text similarity and style as native expressions over token arrays and texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sentences

# Weights of the combined similarities.
WEIGHTS_EVALUATION = {"tfidf_cosine": 0.15, "jaccard": 0.10, "ngram_1_overlap": 0.10, "ngram_2_overlap": 0.10, "ngram_3_overlap": 0.10, "semantic_cosine": 0.45}
WEIGHTS_CAPTURE = {"tfidf_cosine": 0.20, "jaccard": 0.15, "ngram_1_overlap": 0.15, "ngram_2_overlap": 0.25, "ngram_3_overlap": 0.25, "semantic_cosine": 0.45}
WEIGHTS_LEGACY = {"tfidf_cosine": 0.15, "jaccard": 0.10, "ngram_1_overlap": 0.10, "ngram_2_overlap": 0.10, "ngram_3_overlap": 0.10, "semantic_cosine": 0.20, "bertscore_f1": 0.15, "stylistic_similarity": 0.10}
# Function words.
FUNCTION_WORDS = (
    "the a an is was were are be been being have has had do does did will would could should may might shall can of in to for with on at "
    "from by as into through during before after and but or nor not so yet that which who whom this these those it its"
).split()
#: English words that carry no topic; a list of our own, for the usual one belongs to a library.
STOP_WORDS = sorted({*FUNCTION_WORDS, *"i me my we our you your he him his she her they them their what when where why how all any both each few more most other some such no only own same than too very s t just don now here there then once again further about against between above below up down out off over under if because until while am".split()})


def _counts(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct n-gram of two sequences of numbers is in the one and in the other. A gram is the rank of the gram before its last number, and
    that number, so no digits are lost."""
    ids = np.concatenate([a, b]).astype(np.int64)
    rank = np.unique(ids, return_inverse=True)[1]
    word, most = rank, len(ids) + 1
    for k in range(1, n):
        rank = np.unique(rank[: len(word) - k] * most + word[k:], return_inverse=True)[1]
    m = int(rank.max()) + 1 if len(rank) else 0
    return np.bincount(rank[: max(0, len(a) - n + 1)], minlength=m), np.bincount(rank[len(a) :], minlength=m)


def _sides(x: pa.Array, y: pa.Array):
    """The words of both sides of each row as numbers, None where a side is null. Words are numbered once a batch."""
    flat = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy()
    sides, at = [], 0
    for c in (x, y):
        own = []
        for n in c.value_lengths().to_pylist():
            own.append(None if n is None else flat[at : at + n])
            at += n or 0
        sides.append(own)
    return zip(*sides, strict=True)


_SHARED = pa.struct([(f"{k}{n}", pa.int32()) for n in (1, 2, 3) for k in ("a", "b", "both")])


@F.arrow_udf(T.StructType([T.StructField(f.name, T.IntegerType()) for f in _SHARED]))
def shared_grams(x: pa.Array, y: pa.Array) -> pa.Array:
    """Sizes of the sets of 1-, 2- and 3-grams of two token arrays (a, b) and of what they share (both)."""
    rows = []
    for a, b in _sides(x, y):
        row = {}
        if a is not None and b is not None:
            for n in (1, 2, 3):
                p, q = _counts(a, b, n)
                row |= {f"a{n}": np.count_nonzero(p), f"b{n}": np.count_nonzero(q), f"both{n}": np.count_nonzero((p > 0) & (q > 0))}
        rows.append(row or None)
    return pa.array(rows, _SHARED)


@F.arrow_udf(T.DoubleType())
def gram_cosine(x: pa.Array, y: pa.Array) -> pa.Array:
    """Cosine of the weights of the words and pairs of words of two token arrays; 0 if a side has none."""
    rows = []
    for a, b in _sides(x, y):
        d = n = m = 0.0
        for k in (1, 2) if a is not None and b is not None else ():
            p, q = _counts(a, b, k)
            idf = np.where((p > 0) & (q > 0), 1.0, 1 + np.log(1.5))
            p, q = p * idf, q * idf
            d, n, m = d + p @ q, n + p @ p, m + q @ q
        rows.append(float(d / (np.sqrt(n) * np.sqrt(m))) if n and m else 0.0)
    return pa.array(rows, pa.float64())


def lexical(a: Column, b: Column) -> dict[str, Column]:
    """Token and n-gram measures of two token arrays; null where a side has none."""
    return _measures(shared_grams(a, b))


def _measures(told: Column) -> dict[str, Column]:
    of = lambda n: tuple(told[f"{k}{n}"] for k in ("a", "b", "both"))
    there = lambda n, x: F.when((of(n)[0] > 0) & (of(n)[1] > 0), of(n)[2].cast("double") / x)
    union = lambda n: there(n, of(n)[0] + of(n)[1] - of(n)[2])
    return {"jaccard": union(1)} | {k: c for n in (1, 2, 3) for k, c in ((f"ngram_{n}_jaccard", union(n)), (f"ngram_{n}_overlap", there(n, F.least(*of(n)[:2]))))}


def with_shared(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, dict[str, Column]]:
    """pairs with what two token columns share in place of these, and the measures of `lexical` over it: grams are counted once a pair, however many measures
    are asked for."""
    return pairs.withColumn("_shared", shared_grams(F.col(a), F.col(b))).drop(a, b), _measures(F.col("_shared"))


def combined(measures: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the measures that are there; 0 if none is."""
    there = {k: w for k, w in weights.items() if k in measures}
    total = sum((F.when(measures[k].isNotNull(), w).otherwise(0.0) for k, w in there.items()), F.lit(0.0))
    value = sum((F.coalesce(measures[k] * w, F.lit(0.0)) for k, w in there.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(value, total), F.lit(0.0))


def sentence_lengths(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _deviation(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def type_token_ratio(words: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def punctuation_density(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.length(F.regexp_replace(text, r"""[^.,;:!?\-()\[\]{}"'/]""", "")) / F.greatest(words, F.lit(1))


def function_word_cosine(a: Column, b: Column) -> Column:
    """Cosine of function-word frequencies; null if neither text has any."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731 - computed once, however often f names it
    own = lambda w: F.filter(w, lambda x: x.isin(FUNCTION_WORDS))  # noqa: E731 - one look at each word, then at function words alone
    count = lambda w: let(own(w), lambda o: F.transform(F.array(*map(F.lit, FUNCTION_WORDS)), lambda f: F.size(F.filter(o, lambda x: x == f)).cast("double")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = lambda v: total(F.zip_with(v.x, v.y, lambda p, q: p * q))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda e: e * e)))
    return let(F.struct(count(a).alias("x"), count(b).alias("y")), lambda v: F.when(total(v.x) + total(v.y) > 0, F.coalesce(F.try_divide(dot(v), norm(v.x) * norm(v.y)), F.lit(0.0))))


def syllables(word: Column) -> Column:
    runs = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = F.when(word.endswith("e") & (runs > 1), 1).otherwise(0)
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), runs - silent))


def reading_grade(text: Column, words: Column) -> Column:
    """Flesch-Kincaid, at least 0; 0 without sentences or words."""
    spoken = F.aggregate(F.transform(words, syllables), F.lit(0), lambda s, x: s + x)
    grade = F.lit(0.39) * (F.size(words) / F.size(sentences(text))) + F.lit(11.8) * (spoken / F.size(words)) - 15.59
    return F.when((F.size(words) > 0) & (F.size(sentences(text)) > 0), F.greatest(F.lit(0.0), grade)).otherwise(0.0)


def sentence_mean(text: Column, words: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(words).cast("double"), F.size(sentences(text)).cast("double")), F.lit(0.0))


def style_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 less the mean of capped differences over their ranges."""
    ranges = {"grade": 20.0, "diversity": 1.0, "sentence_length": 50.0}
    return 1 - sum(F.least(F.lit(1.0), F.abs(a[k] - b[k]) / r) for k, r in ranges.items()) / len(ranges)


def tfidf_cosine(pairs: DataFrame, key: str, a: str, b: str, stop: list[str] = STOP_WORDS) -> DataFrame:
    """key, cosine of two texts' 1- and 2-gram weights; idf over the two texts is smoothed: 1 for what both have, 1 + ln 1.5 for the rest.

    Grams are counted where the pair is and never move."""
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), lambda w: ~w.isin(stop))
    return pairs.select(key, gram_cosine(words(F.col(a)), words(F.col(b))).alias("cosine"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths and zero vectors."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


def semantic_cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def unit(a: Column) -> Column:
    """Of length one; zero and non-finite vectors stay."""
    n = F.sqrt(dot(a, a))
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def stylistic(text_a: Column, text_b: Column, a: Column, b: Column) -> dict[str, Column]:
    """Style of a candidate (text and words) beside that of a reference; a side without sentences or words counts as 0."""
    lengths = [sentence_lengths(t) for t in (text_a, text_b)]
    means, deviations = ([F.coalesce(f(x), F.lit(0.0)) for x in lengths] for f in (_mean, _deviation))
    ttr, density = [type_token_ratio(w) for w in (a, b)], [punctuation_density(t) for t in (text_a, text_b)]
    return {
        "sent_len_mean_diff": F.abs(means[0] - means[1]), "sent_len_std_diff": F.abs(deviations[0] - deviations[1]), "ttr_candidate": ttr[0], "ttr_reference": ttr[1], "ttr_diff": F.abs(ttr[0] - ttr[1]),
        "funcword_cosine": function_word_cosine(a, b), "punct_density_candidate": density[0], "punct_density_reference": density[1], "punct_density_diff": F.abs(density[0] - density[1]),
    }


def legacy(a: Column, b: Column, **others: Column) -> dict[str, Column]:
    """The legacy measures: as `lexical`, with 0 where a side has nothing, and what else is given; `combined_similarity` weighs what is there."""
    return legacy_of(lexical(a, b), **others)


def legacy_of(measures: dict[str, Column], **others: Column) -> dict[str, Column]:
    """`legacy` over measures that are there."""
    told = {k: F.coalesce(c, F.lit(0.0)) for k, c in measures.items()} | others
    return told | {"combined_similarity": combined(told, WEIGHTS_LEGACY)}
