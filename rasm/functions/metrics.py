"""Distances, rates and scores as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasm.functions.text import let, tokens


def cer(hyp: Column, ref: Column) -> Column:
    """Edits of characters over the reference's length; 1.0 if that is 0."""
    return F.when(F.length(ref) == 0, F.lit(1.0)).otherwise(F.levenshtein(hyp, ref) / F.length(ref))


def _coded(t: Column, words: Column) -> Column:
    """Each word as one character: its place among the pair's words."""
    char = lambda w: F.decode(F.unhex(F.hex(F.array_position(words, w) + 0x4E00)), "UTF-16BE")
    return F.array_join(F.transform(t, char), "")


def token_edits(hyp: Column, ref: Column) -> Column:
    """Levenshtein distance of two arrays of words, up to 20,000 different words in a pair."""
    both = F.struct(hyp.alias("h"), ref.alias("r"), F.array_distinct(F.concat(hyp, ref)).alias("w"))
    return let(both, lambda x: F.levenshtein(_coded(x["h"], x["w"]), _coded(x["r"], x["w"])))


def wer(hyp: Column, ref: Column) -> Column:
    """Edits of words over the number of reference words; 1.0 if that is 0."""
    return F.when(F.size(ref) == 0, F.lit(1.0)).otherwise(token_edits(hyp, ref) / F.size(ref))


def coverage(hyp: Column, ref: Column) -> Column:
    """Share of the reference's words, as a bag, in the hypothesis; 0.0 if either is empty."""
    both = F.struct(hyp.alias("h"), ref.alias("r"), F.array_distinct(F.array_intersect(ref, hyp)).alias("w"))

    def share(x: Column) -> Column:
        count = lambda t, w: F.size(t) - F.size(F.array_remove(t, w))
        shared = F.aggregate(x["w"], F.lit(0), lambda a, w: a + F.least(count(x["h"], w), count(x["r"], w)))
        return F.when((F.size(x["r"]) == 0) | (F.size(x["h"]) == 0), F.lit(0.0)).otherwise(shared / F.size(x["r"]))

    return let(both, share)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def verse_confidence(c: Column, cov: Column) -> Column:
    return clamp(0.65 * (1 - c) + 0.35 * cov)


def verse_alignment(c: Column, w: Column, cov: Column) -> Column:
    return clamp(0.5 * (1 - c) + 0.3 * (1 - w) + 0.2 * cov)


def span_confidence(c: Column, w: Column, cov: Column, n: Column) -> Column:
    return clamp(0.45 * (1 - c) + 0.20 * (1 - w) + 0.30 * cov + F.least(F.lit(0.08), 0.01 * n))


def span_alignment(c: Column, w: Column, cov: Column) -> Column:
    return clamp(0.40 * (1 - c) + 0.30 * (1 - w) + 0.30 * cov)


def threshold(n: Column, level: str) -> Column:
    """Least confidence for a level, by the number of words."""
    a, b, c, d = {"high": (0.40, 0.60, 0.72, 0.82), "medium": (0.25, 0.40, 0.55, 0.65)}[level]
    return F.when(n <= 3, a).when(n <= 6, b).when(n <= 10, c).otherwise(d)


def level(confidence: Column, n: Column) -> Column:
    return F.when(confidence >= threshold(n, "high"), "high").when(confidence >= threshold(n, "medium"), "medium").otherwise("low")


def verdict(confidence_level: Column) -> Column:
    return F.when(confidence_level == "high", "ok").when(confidence_level == "medium", "minor").otherwise("error")


def constrained_words(hyp: Column, ref: Column, most: Column) -> Column:
    """Words, those replaced by the reference's at the same place whose CER is at most `most` and first or last letter equal."""

    def fix(h: Column, r: Column) -> Column:
        near = (cer(h, r) <= most) & ((F.substring(h, 1, 1) == F.substring(r, 1, 1)) | (F.right(h, F.lit(1)) == F.right(r, F.lit(1))))
        return F.when(h.isNull(), None).when(r.isNotNull() & near, r).otherwise(h)

    return F.filter(F.zip_with(hyp, ref, fix), lambda x: x.isNotNull())


def overlap_coefficient(query: Column, other: Column) -> Column:
    """Share of the query's different n-grams that the other has; 0.0 of an empty query."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, other)) / F.size(q))


def close_word(a: Column, b: Column) -> Column:
    """Equal length and at most 0, 1 or 2 edits for words under 3, up to 6 and above 6 letters."""
    n = F.length(a)
    return (n == F.length(b)) & F.when(n < 3, a == b).otherwise(F.levenshtein(a, b) <= F.when(n <= 6, 1).otherwise(2))


def word_rate(hyp: Column, ref: Column) -> Column:
    return wer(tokens(hyp), tokens(ref))
