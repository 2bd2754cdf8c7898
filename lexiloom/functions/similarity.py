"""Similarity of meanings and readings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import MEANING_PUNCTUATION, _col, drop_space, let, nfkc

MIN_SIMILARITY = 0.45


def meaning_key(col: Column | str) -> Column:
    return F.regexp_replace(drop_space(F.lower(nfkc(col))), MEANING_PUNCTUATION, "")


def key_bigrams(key: Column | str) -> Column:
    """Distinct neighbouring character pairs of a meaning key."""
    def pairs(k: Column) -> Column:
        return F.when(
            F.length(k) >= 2,
            let(F.split(k, ""), lambda c: F.array_distinct(F.zip_with(
                F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b)))),
        ).otherwise(F.array().cast("array<string>"))

    return let(_col(key), pairs)


def bigrams(col: Column | str) -> Column:
    return key_bigrams(meaning_key(col))


def key_similarity(left: Column, right: Column, left_grams: Column, right_grams: Column) -> Column:
    """Jaccard similarity of two meaning keys whose bigrams are at hand."""
    shared = F.size(F.array_intersect(left_grams, right_grams))
    total = F.size(left_grams) + F.size(right_grams) - shared
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(left == right, F.lit(1.0))
        .when((F.size(left_grams) == 0) | (F.size(right_grams) == 0), F.lit(0.0))
        .otherwise(shared / total)
    )


def jaccard_bigrams(left: Column | str, right: Column | str) -> Column:
    def both(m: Column) -> Column:
        return let(
            F.struct(m["a"].alias("a"), m["b"].alias("b"), key_bigrams(m["a"]).alias("x"), key_bigrams(m["b"]).alias("y")),
            lambda s: key_similarity(s["a"], s["b"], s["x"], s["y"]))

    return let(F.struct(meaning_key(left).alias("a"), meaning_key(right).alias("b")), both)


def compatible(left: Column | str, right: Column | str) -> Column:
    return jaccard_bigrams(left, right) >= MIN_SIMILARITY


def edit_distance(left: Column | str, right: Column | str, limit: int | None = None) -> Column:
    """Levenshtein distance over code points; -1 above ``limit``."""
    if limit is None:
        return F.levenshtein(_col(left), _col(right))
    return F.levenshtein(_col(left), _col(right), limit)


def deletion_variants(reading: Column | str) -> Column:
    """The reading and every form of it with one character removed.

    Two readings within edit distance 1 always share a variant, so equality of variants
    replaces a comparison of all pairs.
    """
    def variants(r: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(1), F.length(r)),
            lambda i: F.concat(F.substr(r, F.lit(1), i - 1), F.substr(r, i + 1)),
        )
        return F.when(F.length(r) > 0, F.array_distinct(F.concat(F.array(r), cut))).otherwise(F.array(r))

    return let(_col(reading), variants)
