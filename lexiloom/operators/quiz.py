"""Procedural multiple-choice quizzes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .library import first_rows

# Pool of oldest words, question limits, distractors and the question texts.
POOL_WORDS, MIN_QUESTIONS, MAX_QUESTIONS, DISTRACTORS = 40, 1, 10, 3
MATERIAL_PER_QUESTION, MIN_MATERIAL = 4, 16
PROMPTS = {
    "jp_to_mm": '"{word}" ၏ အနက်အဓိပ္ပာယ်မှာ အဘယ်နည်း။',
    "mm_to_jp": '"{meaning}" ၏ ဂျပန်စကားလုံးမှာ အဘယ်နည်း။',
    "gap_fill": "ဂျပန်စာကြောင်း၏ နေရာလွတ်တွင် မှန်ကန်သော စကားလုံးကို ရွေးပါ။ ... ________ ...  ({kana})",
}
EXPLANATIONS = {
    "jp_to_mm": '"{word}" ({kana}) သည် "{meaning}" ဖြစ်သည်။',
    "mm_to_jp": '"{meaning}" ၏ ဂျပန်အဓိပ္ပာယ်မှာ "{word}" ({kana}) ဖြစ်သည်။',
    "gap_fill": 'မှန်ကန်သော အဖြေမှာ "{word}" ({kana}) ဖြစ်ပြီး "{meaning}" ဟု အဓိပ္ပာယ်ရသည်။',
}
TYPES = tuple(PROMPTS)

#: Tasks that the learners are dealt over, for each core.
TASKS_PER_CORE = 4


def _drawn(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def _filled(templates: dict[str, str], **values: Column) -> Column:
    """Text of the row's question type with its placeholders filled."""
    def text(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    return F.coalesce(*[F.when(F.col("type") == kind, text(t)) for kind, t in templates.items()])


def _shuffled(words: Column, *salt: Column) -> Column:
    """Array in an order drawn from a digest of the salt and each word."""
    keyed = F.transform(words, lambda w: F.struct(_drawn(*salt, w["id"]).alias("h"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda k: k["w"])


def quiz(vocab: DataFrame, users: DataFrame, n: int = 5, seed: int = 0, level: str | None = None, pool: int = POOL_WORDS) -> DataFrame:
    """``n`` questions per learner from the ``pool`` oldest words.

    The pool is at most ``pool`` words, read once as a scalar; every learner's questions are
    then built inside a row, and the same seed gives the same quiz.  Distractors have another
    reading and never show the answer's text.

    Learners are few bytes and much work each, so they are dealt over the cores.  No filter stands on a drawn array: it
    would be drawn once more for the filter, below the caller's ``distinct`` even for each row that names a learner.
    """
    n = min(max(n, MIN_QUESTIONS), MAX_QUESTIONS)
    cores = users.sparkSession.sparkContext.defaultParallelism
    source = vocab.filter(F.col("jlpt_level") == level) if level in ("N4", "N5") else vocab
    words = F.struct("id", F.coalesce("kanji", "kana").alias("face"), "kana", "burmese_meaning")
    listed = first_rows(source, pool).agg(F.array_sort(F.collect_list(words)).alias("pool")).scalar()
    material = F.slice(_shuffled(F.col("pool"), F.lit(seed), F.col("user_id")), 1, max(n * MATERIAL_PER_QUESTION, MIN_MATERIAL))
    usable = F.filter("material", lambda w: (w["burmese_meaning"] != "") & (w["burmese_meaning"] != w["kana"]))
    asked = (
        users.select("user_id").repartition(TASKS_PER_CORE * cores).withColumn("pool", listed).withColumn("material", material)
        .withColumn("material", usable)
        .withColumn("question", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("target", F.get("material", F.col("question") % F.nullif(F.size("material"), F.lit(0))))
        .withColumn("type", F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("question") % len(TYPES)))
    )
    shows_meaning = F.col("type") == "jp_to_mm"
    face = lambda w: F.when(shows_meaning, w["burmese_meaning"]).otherwise(w["face"])
    asked = asked.withColumn("answer", face(F.col("target")))
    others = F.filter("material", lambda w: (w["kana"] != F.col("target.kana")) & (face(w) != F.col("answer")))
    drawn = _shuffled(others, F.lit(seed), F.col("user_id"), F.col("question"))
    texts = F.slice(F.array_distinct(F.transform(drawn, face)), 1, DISTRACTORS)
    options = F.transform(
        F.array_sort(F.transform(
            F.concat("distractors", F.array("answer")),
            lambda o: F.struct(_drawn(F.lit(seed), F.col("user_id"), F.col("question"), o).alias("h"), o.alias("o")))),
        lambda s: s["o"])
    # without a target there are no distractors either
    complete = F.when(F.size("distractors") == DISTRACTORS, options)
    asked = asked.withColumn("distractors", texts).withColumn("options", F.explode_outer(F.array(complete))).filter("options is not null")
    values = {"word": F.col("target.face"), "kana": F.col("target.kana"), "meaning": F.col("target.burmese_meaning")}
    return asked.select(
        "user_id", F.concat(F.lit("q"), F.col("question").cast("string")).alias("question_id"), "type",
        _filled(PROMPTS, **values).alias("prompt"),
        "options", (F.array_position("options", F.col("answer")) - 1).cast("int").alias("correct_index"),
        _filled(EXPLANATIONS, **values).alias("explanation"), F.col("target.id").alias("vocab_id"),
    )
