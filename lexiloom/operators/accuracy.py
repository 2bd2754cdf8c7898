"""Labelled accuracy of matching and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import KEY_SEPARATOR
from ..functions.text import clean_text, detect_lesson, detect_level
from ..sources.files import MAX_BYTES, MAX_PAGES, read_pages
from .matching import decide_keyed, incoming_keys, stored_keys
from .words import Scripts, checked_words


def decide_cases(cases: DataFrame, scripts: Scripts = Scripts()) -> DataFrame:
    """Decision of every labelled case against its own stored rows.

    All cases run as one match: their keys carry the case id, so no case sees another's rows.
    """
    mark = F.concat(F.col("case_id"), F.lit(KEY_SEPARATOR))
    incoming = checked_words(cases.select(F.col("id").alias("case_id"), "incoming.*"), "N5", None, scripts)
    words = incoming_keys(incoming.filter("valid"))
    rows = stored_keys(cases.select(F.col("id").alias("case_id"), F.posexplode("existing").alias("at", "e")).select(
        "case_id", F.col("at").alias("id"), F.col("e.canonicalKey").alias("canonical_key"), "e.kanji", "e.kana",
        F.col("e.burmeseMeaning").alias("burmese_meaning")))

    def scoped(df: DataFrame, *keys: str) -> DataFrame:
        marked = {k: F.concat(mark, F.col(k)) for k in keys}
        marked["surface_key"] = F.when(F.col("surface_key") != "", F.concat(mark, "surface_key")).otherwise(F.lit(""))
        return df.withColumns(marked)

    decided = decide_keyed(
        scoped(words, "identity_key", "reading_key"), scoped(rows, "stored_key", "identity_key", "reading_key"),
        explained=False).select("case_id", "kind", "score")
    return incoming.select("case_id").join(decided, "case_id", "left").withColumn(
        "kind", F.coalesce("kind", F.lit("invalid"))).withColumnRenamed("case_id", "id")


def judge_cases(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pass or fail per case: the expected kind, and for a review at least the minimum score."""
    enough = (F.col("kind") != "review") | (F.col("score") >= F.coalesce("minimum_score", F.lit(0.0)))
    return cases.select("id", "expected_kind", "minimum_score").join(decisions, "id", "left").withColumn(
        "passed", F.coalesce((F.col("kind") == F.col("expected_kind")) & enough, F.lit(False)))


def accuracy_report(judged: DataFrame) -> DataFrame:
    """Passed, failed, total and accuracy; without any case the accuracy is 1."""
    return judged.agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(1.0)).alias("accuracy"))


def extraction_checks(
    pages: DataFrame, specs: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES
) -> DataFrame:
    """Check each document's text against its expectations.

    ``specs``: doc, required_text, minimum_pages, minimum_characters, expected_level,
    expected_lesson, expect_no_text (all but doc may be null).  Documents over the read limits
    are not read and fail, with the limit in ``reason``, which bounds the text assembled per document.
    """
    kept, rejects = read_pages(pages, max_bytes, max_pages)
    cleaned = kept.withColumn("text", clean_text("text"))
    docs = cleaned.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("num", "text"))).alias("p")).select(
        "doc", F.size("p").alias("pages"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    joined = specs.join(docs, "doc", "left").join(rejects.select("doc", "reason"), "doc", "left").withColumns({
        "pages": F.coalesce("pages", F.lit(0)), "text": F.coalesce("text", F.lit("")),
    })
    found = joined.withColumns({
        "characters": F.length("text"), "level": detect_level("text"), "lesson": detect_lesson("text"),
        "missing_text": F.filter(
            F.coalesce("required_text", F.array().cast("array<string>")), lambda s: ~F.contains(F.col("text"), s)),
    })
    count_ok = F.when(F.coalesce("expect_no_text", F.lit(False)), F.col("pages") == 0).otherwise(
        F.col("pages") >= F.coalesce("minimum_pages", F.lit(1)))
    same = lambda want, got: F.col(want).isNull() | F.coalesce(F.col(want) == F.col(got), F.lit(False))
    passed = (
        F.col("reason").isNull() & count_ok & (F.size("missing_text") == 0) & (F.col("characters") >= F.coalesce("minimum_characters", F.lit(0)))
        & same("expected_level", "level") & same("expected_lesson", "lesson")
    )
    return found.select("doc", "pages", "characters", "level", "lesson", "missing_text", passed.alias("passed"), "reason")
