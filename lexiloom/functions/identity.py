"""Identity keys of a word: normalised surface, reading and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import READING_BRACKETS, SPACE_CLASS, drop_space, js_trim, nfkc, to_hiragana

KEY_SEPARATOR = "\u0000"


def reading_key(col: Column | str) -> Column:
    c = drop_space(to_hiragana(nfkc(col)))
    return F.regexp_replace(c, READING_BRACKETS, "")


def norm_surface(col: Column | str) -> Column:
    """Surface with single spaces; null becomes the empty string."""
    c = F.regexp_replace(nfkc(col), rf"[{SPACE_CLASS}]+", " ")
    return F.coalesce(js_trim(c), F.lit(""))


def surface_key(col: Column | str) -> Column:
    return F.coalesce(drop_space(nfkc(col)), F.lit(""))


def join_keys(surface: Column, reading: Column) -> Column:
    """Canonical key from keys that are already normalised."""
    return F.when(
        surface != "", F.concat(F.lit("surface:"), surface, F.lit(KEY_SEPARATOR + "reading:"), reading)
    ).otherwise(F.concat(F.lit("reading:"), reading))


def canonical_key(surface: Column | str, reading: Column | str) -> Column:
    return join_keys(surface_key(surface), reading_key(reading))


def with_identity(df: DataFrame, surface: str = "kanji", reading: str = "kana") -> DataFrame:
    """Add surface_key, reading_key and identity_key, each computed once."""
    return (
        df.withColumns({"surface_key": surface_key(surface), "reading_key": reading_key(reading)})
        .withColumn("identity_key", join_keys(F.col("surface_key"), F.col("reading_key")))
    )
