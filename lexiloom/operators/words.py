"""Extracted records to validated words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import reading_key, with_identity
from ..functions.text import (
    BURMESE, KANA, blank_separated, clean_optional, clean_text, contains_script, cut_optional, cut_reading, detect_lesson,
    detect_level, let, parse_lesson, parse_level, simple_romaji, strip_fence,
)
from .ordered import dedupe_first

# Field lengths of a word.
MAX_CHARS = {
    "kanji": 80, "romaji": 120, "burmese_meaning": 300, "part_of_speech": 80,
    "example_sentence_jp": 300, "example_sentence_mm": 300,
}
WORD_FIELDS = (
    "kanji", "kana", "romaji", "burmese_meaning", "jlpt_level", "part_of_speech", "lesson",
    "example_sentence_jp", "example_sentence_mm",
)
# What parts of page text end with.
PART_END = r"[\n;]"


@dataclass(frozen=True)
class Scripts:
    """Character classes a reading and a meaning must contain."""

    reading: str = KANA
    meaning: str = BURMESE


def _is_word(kana: Column, meaning: Column, scripts: Scripts) -> Column:
    return contains_script(kana, scripts.reading) & F.coalesce(contains_script(meaning, scripts.meaning), F.lit(False))


def checked_words(
    raw: DataFrame, level: Column | str = "N5", lesson: Column | None = None, scripts: Scripts = Scripts(), cut: bool = False
) -> DataFrame:
    """Normalise the word fields of every record in place and add ``valid``.

    Missing record fields count as null; other columns pass through.  ``cut``: surface, reading and meaning
    were cut at the blanks of ``blank_separated`` text, so that they need no composing and no trimming.
    """
    one_line, reading = (cut_optional, cut_reading) if cut else (clean_optional, reading_key)
    field = {f: F.col(f) if f in raw.columns else F.lit(None).cast("string") for f in WORD_FIELDS}
    lesson = F.lit(None).cast("int") if lesson is None else lesson
    out = raw.withColumns({
        "kanji": one_line(field["kanji"], MAX_CHARS["kanji"]),
        "kana": reading(F.coalesce(field["kana"], F.lit(""))),
        "romaji": clean_optional(field["romaji"], MAX_CHARS["romaji"]),
        "burmese_meaning": one_line(field["burmese_meaning"], MAX_CHARS["burmese_meaning"]),
        "jlpt_level": parse_level(field["jlpt_level"], level),
        "part_of_speech": clean_optional(field["part_of_speech"], MAX_CHARS["part_of_speech"]),
        "lesson": parse_lesson(field["lesson"], lesson),
        "example_sentence_jp": clean_optional(field["example_sentence_jp"], MAX_CHARS["example_sentence_jp"]),
        "example_sentence_mm": clean_optional(field["example_sentence_mm"], MAX_CHARS["example_sentence_mm"]),
    })
    valid = _is_word(F.col("kana"), F.col("burmese_meaning"), scripts)
    return out.withColumns({"romaji": F.coalesce("romaji", simple_romaji("kana")), "valid": valid})


def normalize_words(
    raw: DataFrame, level: Column | str = "N5", lesson: Column | None = None, scripts: Scripts = Scripts()
) -> tuple[DataFrame, DataFrame]:
    """(words, rejects) of a table of raw records."""
    checked = checked_words(raw, level, lesson, scripts)
    rejected = checked_words(
        raw.withColumn("record", F.struct(*[c for c in raw.columns])), level, lesson, scripts
    ).filter(~F.col("valid"))
    return checked.filter("valid").drop("valid"), rejected.select("record.*")


def _item_fields(item: str) -> dict[str, Column]:
    """Word fields of a variant; only JSON strings count as text, the lesson may be a number."""
    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col(item), f"$.{name}", kind)

    text = {
        f: F.when(F.schema_of_variant(field(f, "variant")) == "STRING", field(f, "string"))
        for f in WORD_FIELDS if f != "lesson"
    }
    return {**text, "lesson": field("lesson", "string")}


def json_fields(df: DataFrame, json: str) -> DataFrame:
    """Replace a JSON text column by the word fields it holds; malformed text gives nulls."""
    parsed = df.withColumn("_item", F.try_parse_json(F.col(json)))
    return parsed.withColumns(_item_fields("_item")).drop("_item", json)


def response_records(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per record of each model answer, with its position.

    An answer is a JSON array or an object with an ``items`` array, perhaps inside a code
    fence; anything else yields no records.  Items that are no objects come out as null.
    """
    parsed = responses.withColumn("_v", F.try_parse_json(strip_fence(response)))
    items = F.coalesce(
        F.try_variant_get("_v", "$", "array<variant>"), F.try_variant_get("_v", "$.items", "array<variant>")
    )
    exploded = parsed.select(
        *[c for c in responses.columns if c != response], F.posexplode(items).alias("position", "_item"))
    return exploded.withColumns(_item_fields("_item")).drop("_item")


def parse_responses(
    responses: DataFrame, chunk_text: str = "chunk_text", by: str = "response_id", scripts: Scripts = Scripts()
) -> DataFrame:
    """Words of model answers, first one per identity within an answer.

    ``responses`` has the answer in ``response`` and its source chunk in ``chunk_text``; the
    chunk's level and lesson stand in for missing ones.
    """
    defaults = responses.withColumns({
        "_level": F.coalesce(detect_level(chunk_text), F.lit("N5")), "_lesson": detect_lesson(chunk_text),
    }).drop(chunk_text)
    checked = checked_words(response_records(defaults), F.col("_level"), F.col("_lesson"), scripts)
    words = with_identity(checked.filter("valid").drop("valid", "_level", "_lesson"))
    return dedupe_first(words, [by, "identity_key"], [F.col("position")])


def _fields(part: Column) -> Column:
    """Surface, reading, meaning and the rest."""
    return F.split(part, " ", 4)


def has_word(text: Column, scripts: Scripts = Scripts()) -> Column:
    """Whether ``parse_lines`` finds a valid word in cleaned page text; nothing is read past the first one."""
    def is_word(part: Column) -> Column:
        def judged(fields: Column) -> Column:
            kana = cut_reading(F.coalesce(F.get(fields, F.lit(1)), F.lit("")))
            return _is_word(kana, cut_optional(F.get(fields, F.lit(2)), MAX_CHARS["burmese_meaning"]), scripts)

        return let(_fields(part), judged)

    # The first part alone decides about most pages, without splitting the rest.
    first = F.substring_index(F.substring_index(text, "\n", 1), ";", 1)
    return is_word(blank_separated(first)) | F.exists(F.split(blank_separated(text), PART_END), is_word)


def line_records(pages: DataFrame, text: str = "text", cleaned: bool = False) -> DataFrame:
    """Records of delimited page text: one per line or ``;`` part, composed fields split by white space.

    A part keeps its leading blank, which makes its first field empty.
    """
    if not cleaned:
        pages = pages.withColumn(text, clean_text(F.coalesce(F.col(text), F.lit(""))))
    parts = F.split(blank_separated(text), PART_END)
    rows = pages.select(*[c for c in pages.columns if c != text], F.posexplode(parts).alias("position", "_part"))
    return rows.withColumn("_fields", _fields(F.col("_part"))).withColumns({
        "kanji": F.get("_fields", F.lit(0)), "kana": F.get("_fields", F.lit(1)),
        "burmese_meaning": F.get("_fields", F.lit(2)), "jlpt_level": F.lit("N5"),
    }).drop("_part", "_fields")


def parse_lines(
    pages: DataFrame, text: str = "text", scripts: Scripts = Scripts(), cleaned: bool = False
) -> DataFrame:
    """Valid words of delimited page text."""
    return checked_words(line_records(pages, text, cleaned), "N5", None, scripts, cut=True).filter("valid").drop("valid")
