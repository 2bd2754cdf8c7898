"""File listing, page text with limits, JSON columns, labelled manifests and report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..functions.text import SPACE_CLASS

# Limits of one input document.
MAX_BYTES = 25 * 1024 * 1024
MAX_PAGES = 250

MANIFEST_SCHEMA = """
  matchCases array<struct<id string,
    incoming struct<kanji string, kana string, romaji string, burmese_meaning string, jlpt_level string,
      part_of_speech string, lesson string, example_sentence_jp string, example_sentence_mm string>,
    existing array<struct<id string, canonicalKey string, kanji string, kana string,
      burmeseMeaning string, partOfSpeech string>>,
    expectedKind string, minimumScore double>>,
  pdfSamples array<struct<id string, path string, minimumPages int, requiredText array<string>,
    expectedJlpt string, expectedLesson int, expectNoSelectableText boolean,
    ocr struct<languages string, requiredText array<string>, expectedJlpt string,
      expectedLesson int, minimumCharacters int>>>
"""


def list_files(spark: SparkSession, path: str, ext: str = "pdf") -> DataFrame:
    """Files of a folder whose extension matches in any case, sorted; contents are not read.

    A missing folder gives no rows.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long, modification_time timestamp")
    return files.select("path", "length", F.col("modificationTime").alias("modification_time")).orderBy("path")


def read_pages(
    pages: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES
) -> tuple[DataFrame, DataFrame]:
    """Split a page table (doc, num, text) by document limits.

    Returns the non-blank pages of the documents within the limits, and one row per rejected
    document with the reason.  A document over a limit fails whole.
    """
    sizes = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")
    )
    reason = F.when(F.col("bytes") > max_bytes, "bytes").when(F.col("pages") > max_pages, "pages")
    judged = sizes.withColumn("reason", reason)
    rejects = judged.filter("reason is not null")
    kept = (
        pages.filter(F.col("text").rlike(rf"[^{SPACE_CLASS}]"))
        .join(rejects.select("doc"), "doc", "left_anti")
    )
    return kept, rejects


def doc_text(pages: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> DataFrame:
    """Whole text of each document, pages joined by a blank line.

    Documents over the limits are left out first, so a collected group is at most
    ``max_pages`` pages and ``max_bytes`` bytes.
    """
    kept, _ = read_pages(pages, max_bytes, max_pages)
    ordered = F.array_sort(F.collect_list(F.struct("num", "text")))
    return kept.groupBy("doc").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text")
    )


def safe_json(col: Column | str, schema: str, default: Column) -> Column:
    """Parsed JSON text; null, empty or malformed text gives the default."""
    c = F.col(col) if isinstance(col, str) else col
    valid = F.try_parse_json(c).isNotNull()
    return F.coalesce(F.when(valid, F.from_json(c, schema)), default)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labelled match cases, one row per case with its incoming record and stored rows."""
    raw = spark.read.option("multiLine", True).schema(MANIFEST_SCHEMA).json(path)
    return raw.select(F.explode("matchCases").alias("c")).select("c.*")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Document samples of a labelled manifest, one row per sample."""
    raw = spark.read.option("multiLine", True).schema(MANIFEST_SCHEMA).json(path)
    return raw.select(F.explode("pdfSamples").alias("c")).select("c.*")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
