"""Learning, library, gloss and quiz queries."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..operators import gloss as glosses
from ..operators import learning, library as libraries, quiz as quizzes
from . import views as v

TODAY = v.NOW[:10]


def sm2_replay(spark, sf):
    return v.plain(learning.replay_sm2(v.ratings(spark, sf)))


def sm2_per_learner(spark, sf):
    """The same replay over each learner's whole history as one long sequence."""
    return v.plain(learning.replay_sm2(v.ratings(spark, sf).withColumn("vocab_id", F.lit(0).cast("long"))).drop("next_review_date"))


def rate_cards(spark, sf):
    """The ratings on stored cards, whatever state they are in; ratings of other cards are refused."""
    cards, _ = learning.rate_cards(v.stored_cards(spark, sf), v.ratings(spark, sf))
    return v.plain(cards)


def rate_learners(spark, sf):
    """The same with one stored card for each learner that takes the learner's whole history; every other learner has none."""
    ratings = v.ratings(spark, sf).withColumn("vocab_id", F.lit(0).cast("long"))
    start = v.stored_cards_of(ratings).filter("vocab_id = 0 and user_id % 2 = 0")
    cards, _ = learning.rate_cards(start, ratings)
    return v.plain(cards.drop("next_review_date"))


def refused_ratings(spark, sf):
    _, refused = learning.rate_cards(v.stored_cards(spark, sf), v.ratings(spark, sf))
    return v.plain(refused.groupBy("user_id", "reason").agg(F.count(F.lit(1)).alias("ratings")))


def rejected_ratings(spark, sf):
    _, bad = learning.valid_ratings(v.ratings(spark, sf))
    return v.plain(bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("rejected")))


def due_queue(spark, sf):
    out = learning.due_queue(v.progress(spark, sf), v.vocab(spark, sf), v.NOW)
    return v.plain(out.select("user_id", "vocab_id", "repetitions", "next_review_date", "kana"))


def due_queue_lesson(spark, sf):
    out = learning.due_queue(v.progress(spark, sf), v.vocab(spark, sf), v.NOW, lesson=7, k=5)
    return v.plain(out.select("user_id", "vocab_id", "repetitions", "lesson"))


def ensure_progress(spark, sf):
    out = learning.ensure_progress(v.vocab(spark, sf), v.word_progress(spark, sf), v.NOW)
    return v.plain(out.select("vocab_id", "status", "repetitions", "ease_factor", "next_review_date"))


def override_status(spark, sf):
    """Requests: one per event, by learner and card, with a status out of the event type."""
    kind = F.col("event_type")
    asked = v.table(spark, sf, "events").select(
        F.col("event_id").alias("position"), "user_id", (F.get_json_object("props", "$.k").cast("long") + F.col("event_id") % 3).alias("vocab_id"),
        F.when(kind == "purchase", "mastered").when(kind == "click", "learning").when(kind == "view", "reviewing").otherwise("done").alias("status"))
    out, bad = learning.override_status(v.progress(spark, sf), asked, v.NOW)
    a = out.select("user_id", "vocab_id", "status", "interval", "repetitions", F.to_date("next_review_date").alias("next_review"))
    b = bad.groupBy("user_id", F.col("reason").alias("status")).agg(F.count(F.lit(1)).cast("int").alias("interval")).select(
        "user_id", F.lit(None).cast("long").alias("vocab_id"), "status", "interval", F.lit(None).cast("int").alias("repetitions"),
        F.lit(None).cast("date").alias("next_review"))
    return v.plain(a.unionByName(b))


def study_log(spark, sf):
    return v.plain(learning.study_log(v.ratings(spark, sf), v.quizzes(spark, sf)))


def streaks(spark, sf):
    return v.plain(learning.streaks(learning.study_log(v.ratings(spark, sf), v.quizzes(spark, sf)), TODAY))


def learner_dashboard(spark, sf):
    log = learning.study_log(v.ratings(spark, sf), v.quizzes(spark, sf))
    return v.plain(learning.learner_dashboard(v.vocab(spark, sf), v.progress(spark, sf), log, v.NOW))


def score_quizzes(spark, sf):
    """Quizzes: orders; a line is answered right when it was not returned."""
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") % 100).alias("quiz_id"), (F.col("l_returnflag") == "N").alias("correct"))
    return v.plain(learning.score_quizzes(lines))


def level_counts(spark, sf):
    return v.plain(learning.level_counts(v.vocab(spark, sf)))


def status_counts(spark, sf):
    return v.plain(learning.status_counts(v.progress(spark, sf)))


def library(spark, sf):
    out = libraries.library(v.vocab(spark, sf), v.word_progress(spark, sf))
    return v.plain(out.select("id", "jlpt_level", "kana", "status", "next_review_date"))


def newest_vocabulary(spark, sf):
    return v.plain(libraries.newest_vocabulary(v.vocab(spark, sf)).select("id", "kana", "created_at"))


def search_vocabulary(spark, sf):
    rows = libraries.with_status(v.vocab(spark, sf), v.word_progress(spark, sf))
    a = libraries.search_vocabulary(rows, " ECO ", level="N5").select(F.lit("text").alias("search"), "id")
    b = libraries.search_vocabulary(rows, "file1", status="reviewing", lesson="unassigned").select(F.lit("unassigned").alias("search"), "id")
    c = libraries.search_vocabulary(rows, lesson=7).select(F.lit("lesson").alias("search"), "id")
    return v.plain(a.unionByName(b).unionByName(c))


def search_many(spark, sf):
    """A search per supplier, all at once: brands, files, pieces over a space, single letters, absent texts and filters alone."""
    k = F.col("s_suppkey")
    said = F.array(F.concat(F.lit(" Brand#"), k % 25), F.concat(F.lit("FILE"), k % 20), F.lit(" "), F.concat(F.lit("d "), F.substring("s_name", 1, 1)),
                   F.lit("e "), F.concat(F.lit("zz"), k), F.lit("promo"))
    asked = v.table(spark, sf, "supplier").select(
        k.alias("search_id"), F.get(said, (k % 7).cast("int")).alias("query"),
        F.when(k % 3 == 0, "N5").when(k % 3 == 1, "N4").otherwise("all").alias("level"),
        F.when(k % 4 == 0, "reviewing").when(k % 4 == 1, "learning").alias("status"),
        F.when(k % 5 == 0, "unassigned").when(k % 5 == 1, (k % 25).cast("string")).otherwise("all").alias("lesson"))
    rows = libraries.with_status(v.vocab(spark, sf), v.word_progress(spark, sf))
    return v.plain(libraries.search_many(asked, rows).select("search_id", "id"))


def lesson_groups(spark, sf):
    rows = libraries.with_status(v.vocab(spark, sf), v.word_progress(spark, sf))
    return v.plain(libraries.lesson_groups(rows))


def lesson_options(spark, sf):
    return v.plain(libraries.lesson_options(v.vocab(spark, sf)))


def _dictionary(spark, sf):
    """Vocabulary whose readings and surfaces are words of the benchmark texts."""
    words = F.filter(F.split(F.lower("text"), r"\P{L}+"), lambda w: w != "")
    b = v.table(spark, sf, "benchmark").select("item_id", F.posexplode(words).alias("n", "w"))
    return b.select(
        (F.col("item_id") * 10000 + F.col("n")).alias("id"), F.when(F.col("n") % 3 == 0, F.concat("w", F.lit("s"))).alias("kanji"), F.col("w").alias("kana"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("R"), "w")).alias("romaji"), F.concat(F.lit("m"), F.col("n")).alias("burmese_meaning"), F.lit("N5").alias("jlpt_level"),
        F.timestamp_seconds(F.col("item_id") * 10000 + F.col("n")).alias("created_at"))


def _tokens(spark, sf):
    """Distinct tokens of all documents; the reading is the token without a plural s."""
    t = glosses.tokens_of(v.documents(spark, sf))
    return t.withColumn("reading", F.when(F.col("surface").endswith("s"), F.regexp_replace("surface", "s$", "")))


def gloss(spark, sf):
    out = glosses.gloss(_tokens(spark, sf), _dictionary(spark, sf))
    return v.plain(out.select("surface", "occurrences", "word_id", "kana", "romaji", "covered"))


def gloss_reader(spark, sf):
    """The reader's dictionary: the 800 oldest words, and the tooltip's choice among equals."""
    out = glosses.gloss(_tokens(spark, sf), _dictionary(spark, sf), keep="last", cap=glosses.READER_ROWS)
    return v.plain(out.groupBy("covered").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("occurrences").alias("occurrences"), F.sum("word_id").alias("ids")))


def token_requests(spark, sf):
    """Add-word requests for every document token, with an ideograph put before each longer one."""
    t = _tokens(spark, sf)
    t = t.withColumn("surface", F.when(F.length("surface") > 6, F.concat(F.lit("字"), "surface")).otherwise(F.col("surface")))
    return v.plain(glosses.token_requests(t).select("surface", "kanji", "kana", "burmese_meaning", "jlpt_level", "part_of_speech"))


def _requests(spark, sf):
    return v.words(spark, sf).select("position", "kanji", "kana", "romaji", "burmese_meaning", "jlpt_level", "part_of_speech")


def add_words(spark, sf):
    out, _ = glosses.add_words(_requests(spark, sf), v.vocab(spark, sf), new_id=F.col("position"))
    return v.plain(out.select("position", "outcome", "existing_id"))


def add_words_vocabulary(spark, sf):
    _, grown = glosses.add_words(_requests(spark, sf), v.vocab(spark, sf), new_id=F.col("position") + (1 << 40))
    return v.plain(grown.select("id", v.visible("canonical_key").alias("canonical_key"), "kanji", "kana", "pdf_source"))


def quiz(spark, sf):
    users = v.table(spark, sf, "events").select("user_id").distinct()
    return v.plain(quizzes.quiz(v.vocab(spark, sf), users, n=6, seed=11))


def quiz_level(spark, sf):
    users = v.table(spark, sf, "events").select("user_id").distinct()
    return v.plain(quizzes.quiz(v.vocab(spark, sf), users, n=4, seed=5, level="N4"))


def lesson_rows(spark, sf):
    """Place of every word in display order."""
    rows = libraries.lesson_rows(v.vocab(spark, sf))
    place = F.row_number().over(Window.partitionBy("lesson").orderBy(F.collate("kana", "ja"), "id"))
    return v.plain(rows.select("id", "lesson", "kana", place.alias("place")))


# --- SQL twins ----------------------------------------------------------------------------


def _filled_sql(templates: dict[str, str], **values: str) -> str:
    """CASE over the question types, each template a concatenation."""
    def text(template: str) -> str:
        parts = re.split(r"\{(\w+)\}", template)
        return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))

    return "CASE type " + " ".join(f"WHEN '{k}' THEN {text(t)}" for k, t in templates.items()) + " END"


def quiz_sql(n: int, seed: int, level: str | None = None) -> str:
    texts = {"word": "face", "kana": "kana", "meaning": "m"}
    return f"""
    pool AS (SELECT id, coalesce(kanji, kana) AS face, kana, burmese_meaning AS m FROM vocab
        {f"WHERE jlpt_level = '{level}'" if level else ""} ORDER BY created_at, id LIMIT 40),
    material AS (SELECT user_id, p.*, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', {seed}, user_id, id))) AS r
        FROM (SELECT DISTINCT user_id FROM events), pool p),
    usable AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS size
        FROM material WHERE r <= {max(4 * n, 16)} AND m <> '' AND m <> kana),
    asked AS (SELECT *, CASE type WHEN 'jp_to_mm' THEN m ELSE face END AS answer FROM (
        SELECT u.*, q, ['jp_to_mm', 'mm_to_jp', 'gap_fill'][q % 3 + 1] AS type FROM range({n}) t(q), usable u WHERE u.i = q % u.size)),
    others AS (SELECT user_id, q, text, min(md5(concat_ws(':', {seed}, user_id, q, oid))) AS h FROM (
        SELECT a.user_id, a.q, a.answer, o.id AS oid, CASE a.type WHEN 'jp_to_mm' THEN o.m ELSE o.face END AS text
        FROM asked a JOIN usable o ON o.user_id = a.user_id AND o.kana <> a.kana) WHERE text <> answer GROUP BY ALL),
    drawn AS (SELECT user_id, q, text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY h) AS d FROM others) WHERE d <= 3),
    shown AS (SELECT user_id, q, list(text ORDER BY md5(concat_ws(':', {seed}, user_id, q, text)), text) AS options FROM (
        SELECT * FROM drawn UNION ALL SELECT user_id, q, answer FROM asked) GROUP BY 1, 2 HAVING count(*) = 4)
    SELECT user_id, 'q' || q AS question_id, type, {_filled_sql(quizzes.PROMPTS, **texts)} AS prompt, array_to_string(options, '|') AS options,
      list_position(options, answer) - 1 AS correct_index, {_filled_sql(quizzes.EXPLANATIONS, **texts)} AS explanation, id AS vocab_id
    FROM asked JOIN shown USING (user_id, q)"""


# Readings here are ASCII; the Japanese order and the plain one agree on them up to upper and lower case.
LESSON_ROWS = """
    SELECT id, lesson, kana, row_number() OVER (PARTITION BY lesson ORDER BY lower(kana), kana, id) AS place FROM vocab"""

# Sequential fold in whole hundredths, one rating per step.
SM2 = """
    rated AS (SELECT user_id, {card} AS vocab_id, ts, grade, row_number() OVER (PARTITION BY user_id, {card} ORDER BY ts, event_id) AS i,
        CASE grade WHEN 0 THEN -80 WHEN 3 THEN -14 WHEN 4 THEN 0 ELSE 10 END AS d FROM ratings WHERE grade IN (0, 3, 4, 5)),
    fold AS (
      SELECT DISTINCT user_id, vocab_id, CAST(0 AS BIGINT) AS i, CAST(250 AS BIGINT) AS ease, CAST(0 AS BIGINT) AS iv, CAST(0 AS BIGINT) AS reps, TIMESTAMP '2000-01-01' AS ts FROM rated
      UNION ALL
      SELECT r.user_id, r.vocab_id, r.i, greatest(130, f.ease + r.d),
        CASE WHEN grade < 3 THEN 0 WHEN f.reps = 0 THEN 1 WHEN f.reps = 1 THEN 6 ELSE least(100000000, (f.iv * f.ease + 50) // 100) END,
        CASE WHEN grade < 3 THEN 0 ELSE f.reps + 1 END, r.ts
      FROM fold f JOIN rated r ON r.user_id = f.user_id AND r.vocab_id = f.vocab_id AND r.i = f.i + 1),
    last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, vocab_id ORDER BY i DESC) = 1)
    SELECT user_id, vocab_id, round(ease / 100, 6) AS ease_factor, iv AS interval, reps AS repetitions,
      CASE WHEN reps = 0 THEN 'learning' WHEN iv >= 21 THEN 'mastered' ELSE 'reviewing' END AS status, i AS ratings{more} FROM last"""

SM2_CARD = SM2.format(card="vocab_id", more=", strftime(ts + to_days(CAST(iv AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS next_review_date")
SM2_LEARNER = SM2.format(card="CAST(0 AS BIGINT)", more="")

# The same fold from stored states; ``slow`` intervals and cards without ratings need no rule of their own here.
RATED = """
    rated AS (SELECT user_id, {card} AS vocab_id, ts, grade, row_number() OVER (PARTITION BY user_id, {card} ORDER BY ts, event_id) AS i,
        CASE grade WHEN 0 THEN -80 WHEN 3 THEN -14 WHEN 4 THEN 0 ELSE 10 END AS d FROM ratings WHERE grade IN (0, 3, 4, 5)),
    begun AS ({start}),
    fold AS (
      SELECT user_id, vocab_id, CAST(0 AS BIGINT) AS i, CAST(ease AS BIGINT) AS ease, CAST(interval AS BIGINT) AS iv, CAST(repetitions AS BIGINT) AS reps,
        status, next_review_date AS due FROM begun
      UNION ALL
      SELECT user_id, vocab_id, i, ease, iv, reps, CASE WHEN reps = 0 THEN 'learning' WHEN iv >= 21 THEN 'mastered' ELSE 'reviewing' END, ts + to_days(CAST(iv AS INTEGER)) FROM (
        SELECT r.user_id, r.vocab_id, r.i, greatest(130, f.ease + r.d) AS ease,
          CASE WHEN grade < 3 THEN 0 WHEN f.reps = 0 THEN 1 WHEN f.reps = 1 THEN 6 ELSE least(100000000, (f.iv * f.ease + 50) // 100) END AS iv,
          CASE WHEN grade < 3 THEN 0 ELSE f.reps + 1 END AS reps, r.ts
        FROM fold f JOIN rated r ON r.user_id = f.user_id AND r.vocab_id = f.vocab_id AND r.i = f.i + 1)),
    last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, vocab_id ORDER BY i DESC) = 1)
    SELECT user_id, vocab_id, round(ease / 100, 6) AS ease_factor, iv AS interval, reps AS repetitions, status, i AS ratings{more} FROM last"""

RATE_CARDS = RATED.format(card="vocab_id", start="SELECT * FROM stored_cards", more=", strftime(due, '%Y-%m-%d %H:%M:%S') AS next_review_date")
RATE_LEARNERS = RATED.format(
    card="CAST(0 AS BIGINT)", more="", start=f"""
      SELECT * FROM (WITH ratings AS (SELECT user_id, CAST(0 AS BIGINT) AS vocab_id FROM (SELECT user_id FROM events)) {v.SQL['stored_cards'].strip()}) WHERE vocab_id = 0 AND user_id % 2 = 0""")

REFUSED = """
    SELECT user_id, CASE WHEN grade NOT IN (0, 3, 4, 5) THEN 'invalid_rating' ELSE 'progress_not_found' END AS reason, count(*) AS ratings
    FROM ratings r WHERE grade NOT IN (0, 3, 4, 5) OR NOT EXISTS (SELECT 1 FROM stored_cards s WHERE s.user_id = r.user_id AND s.vocab_id = r.vocab_id)
    GROUP BY 1, 2"""

REJECTED = "SELECT user_id, count(*) AS rejected FROM ratings WHERE grade NOT IN (0, 3, 4, 5) GROUP BY 1"

DUE = f"""
    SELECT user_id, vocab_id, repetitions, strftime(next_review_date, '%Y-%m-%d %H:%M:%S') AS next_review_date, kana
    FROM progress JOIN vocab ON id = vocab_id WHERE progress.next_review_date <= TIMESTAMP '{v.NOW}' OR repetitions = 0
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY repetitions, progress.next_review_date, vocab_id) <= 24"""

DUE_LESSON = f"""
    SELECT user_id, vocab_id, repetitions, lesson FROM progress JOIN vocab ON id = vocab_id
    WHERE (next_review_date <= TIMESTAMP '{v.NOW}' OR repetitions = 0) AND lesson = 7
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY repetitions, next_review_date, vocab_id) <= 5"""

ENSURE = f"""
    SELECT vocab_id, status, repetitions, CAST(2.5 AS DOUBLE) AS ease_factor, strftime(next_review_date, '%Y-%m-%d %H:%M:%S') AS next_review_date FROM word_progress
    UNION ALL SELECT id, 'learning', 0, CAST(2.5 AS DOUBLE), '{v.NOW}' FROM vocab WHERE id NOT IN (SELECT vocab_id FROM word_progress)"""

OVERRIDE = f"""
    WITH asked AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 3 AS vocab_id,
        CASE event_type WHEN 'purchase' THEN 'mastered' WHEN 'click' THEN 'learning' WHEN 'view' THEN 'reviewing' ELSE 'done' END AS s FROM events),
    wanted AS (SELECT user_id, vocab_id, max_by(s, event_id) AS s FROM asked WHERE s <> 'done' GROUP BY 1, 2),
    bad AS (SELECT user_id, CASE WHEN s = 'done' THEN 'invalid_request' ELSE 'progress_not_found' END AS reason FROM asked a
      WHERE s = 'done' OR NOT EXISTS (SELECT 1 FROM progress p WHERE p.user_id = a.user_id AND p.vocab_id = a.vocab_id))
    SELECT user_id, vocab_id, coalesce(s, status) AS status, CASE WHEN s IS NULL THEN interval WHEN s = 'mastered' THEN 21 ELSE 0 END AS interval,
      CASE WHEN s IS NULL THEN repetitions WHEN s = 'mastered' THEN 3 ELSE 0 END AS repetitions,
      CAST(CAST(CASE WHEN s IS NULL THEN next_review_date WHEN s = 'mastered' THEN TIMESTAMP '{v.NOW}' + INTERVAL 21 DAY ELSE TIMESTAMP '{v.NOW}' END AS DATE) AS VARCHAR) AS next_review
    FROM progress LEFT JOIN wanted USING (user_id, vocab_id)
    UNION ALL SELECT user_id, NULL, reason, count(*), NULL, NULL FROM bad GROUP BY user_id, reason"""

LOG = """
    log AS (SELECT coalesce(r.user_id, q.user_id) AS user_id, coalesce(r.day, q.day) AS day, coalesce(words, 0) AS words_reviewed, coalesce(n, 0) AS quizzes_completed,
        coalesce(total / 100 / n, 0) AS accuracy_score
      FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS words FROM ratings WHERE grade IN (0, 3, 4, 5) GROUP BY 1, 2) r
      FULL JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(percent) AS total FROM quizzes GROUP BY 1, 2) q ON r.user_id = q.user_id AND r.day = q.day)"""

LOG_ROWS = "WITH " + LOG.strip() + " SELECT user_id, CAST(day AS VARCHAR) AS day, words_reviewed, quizzes_completed, round(accuracy_score, 6) AS accuracy_score FROM log"

STREAK = f"""
    walk AS (SELECT user_id, CASE WHEN bool_or(day = DATE '{TODAY}') THEN DATE '{TODAY}' ELSE DATE '{TODAY}' - 1 END AS day, CAST(0 AS BIGINT) AS n FROM log GROUP BY 1
      UNION ALL SELECT w.user_id, w.day - 1, n + 1 FROM walk w JOIN log l ON l.user_id = w.user_id AND l.day = w.day),
    streak AS (SELECT user_id, max(n) AS streak FROM walk GROUP BY 1)"""

STREAKS = "WITH " + LOG.strip() + ",\n" + STREAK.strip() + " SELECT user_id, streak FROM streak"

BOARD = "WITH " + LOG.strip() + ",\n" + STREAK.strip() + f""",
    cards AS (SELECT user_id, count(*) FILTER (next_review_date <= TIMESTAMP '{v.NOW}') AS due_cards, count(*) FILTER (status = 'learning') AS learning,
        count(*) FILTER (status = 'reviewing') AS reviewing, count(*) FILTER (status = 'mastered') AS mastered FROM progress GROUP BY 1),
    levels AS (SELECT count(*) FILTER (jlpt_level = 'N5') AS n5, count(*) FILTER (jlpt_level = 'N4') AS n4 FROM vocab)
    SELECT user_id, n5, n4, n4 + n5 AS total_vocab, coalesce(due_cards, 0) AS due_cards, coalesce(learning, 0) AS learning, coalesce(reviewing, 0) AS reviewing,
      coalesce(mastered, 0) AS mastered, coalesce(streak, 0) AS streak, coalesce(words_reviewed, 0) AS today_words, coalesce(quizzes_completed, 0) AS today_quizzes,
      round(coalesce(accuracy_score, 0), 6) AS today_accuracy, CAST(floor(100 * coalesce(mastered, 0) / (n4 + n5) + 0.5) AS BIGINT) AS mastered_percent,
      CAST(floor(100 * n5 / (n4 + n5) + 0.5) AS BIGINT) AS n5_percent, CAST(floor(100 * n4 / (n4 + n5) + 0.5) AS BIGINT) AS n4_percent
    FROM cards FULL JOIN streak USING (user_id) LEFT JOIN (SELECT * FROM log WHERE day = DATE '{TODAY}') USING (user_id), levels"""

SCORES = """
    SELECT user_id, quiz_id, score, total, round(score / total, 6) AS accuracy, CAST(floor(100 * score / total + 0.5) AS BIGINT) AS percent,
      CASE WHEN floor(100 * score / total + 0.5) >= 80 THEN 'good' WHEN floor(100 * score / total + 0.5) >= 50 THEN 'fair' ELSE 'again' END AS band
    FROM (SELECT l_suppkey AS user_id, l_orderkey % 100 AS quiz_id, count(*) FILTER (l_returnflag = 'N') AS score, count(*) AS total FROM lineitem GROUP BY 1, 2)"""

LIBRARY = """
    WITH first AS (SELECT * FROM vocab ORDER BY jlpt_level, kana, id LIMIT 1000)
    SELECT id, jlpt_level, kana, coalesce(status, 'learning') AS status, strftime(next_review_date, '%Y-%m-%d %H:%M:%S') AS next_review_date
    FROM first LEFT JOIN word_progress ON vocab_id = id"""

NEWEST = "SELECT id, kana, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM vocab ORDER BY vocab.created_at DESC, id DESC LIMIT 500"

SEARCH = """
    WITH rows AS (SELECT v.*, coalesce(status, 'learning') AS status,
        lower(concat_ws(chr(1), kanji, kana, romaji, burmese_meaning, part_of_speech, pdf_source)) AS hay FROM vocab v LEFT JOIN word_progress ON vocab_id = id)
    SELECT 'text' AS search, id FROM rows WHERE jlpt_level = 'N5' AND contains(hay, 'eco')
    UNION ALL SELECT 'unassigned', id FROM rows WHERE status = 'reviewing' AND lesson IS NULL AND contains(hay, 'file1')
    UNION ALL SELECT 'lesson', id FROM rows WHERE lesson = 7"""

SEARCHES = """
    WITH rows AS (SELECT v.*, coalesce(status, 'learning') AS status,
        lower(concat_ws(chr(1), kanji, kana, romaji, burmese_meaning, part_of_speech, pdf_source)) AS hay FROM vocab v LEFT JOIN word_progress ON vocab_id = id),
    asked AS (SELECT s_suppkey AS k, trim(lower([' Brand#' || s_suppkey % 25, 'FILE' || s_suppkey % 20, ' ', 'd ' || s_name[1], 'e ', 'zz' || s_suppkey, 'promo'][s_suppkey % 7 + 1])) AS q FROM supplier)
    SELECT k AS search_id, id FROM asked JOIN rows ON contains(hay, q) AND (k % 3 = 2 OR jlpt_level = CASE k % 3 WHEN 0 THEN 'N5' ELSE 'N4' END)
      AND (k % 4 >= 2 OR status = CASE k % 4 WHEN 0 THEN 'reviewing' ELSE 'learning' END)
      AND CASE k % 5 WHEN 0 THEN lesson IS NULL WHEN 1 THEN coalesce(lesson = k % 25, FALSE) ELSE TRUE END"""

GROUPS = """
    SELECT lesson, count(*) AS words, count(*) FILTER (status = 'mastered') AS mastered FROM vocab LEFT JOIN word_progress ON vocab_id = id GROUP BY 1"""

OPTIONS = """
    SELECT array_to_string(list_sort(list(DISTINCT lesson) FILTER (lesson IS NOT NULL)), '|') AS lessons, CAST(bool_or(lesson IS NULL) AS BIGINT) AS has_unassigned FROM vocab"""

TOKENS = """
    split AS (SELECT unnest(string_split_regex(lower(text), '\\P{L}+')) AS surface FROM documents),
    tokens AS (SELECT surface, count(*) AS occurrences, CASE WHEN surface LIKE '%s' THEN left(surface, length(surface) - 1) END AS reading FROM split WHERE surface <> '' GROUP BY 1),
    texts AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\P{L}+'), lambda w: w <> '') AS w FROM benchmark),
    entries AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS n FROM texts),
    words AS (SELECT item_id * 10000 + n AS id, CASE WHEN n % 3 = 0 THEN w || 's' END AS kanji, w AS kana, CASE WHEN n % 2 = 0 THEN 'R' || w END AS romaji FROM entries)"""

GLOSS = "WITH " + TOKENS.strip() + """,
    keys AS (SELECT kana AS key, * FROM words UNION ALL SELECT kanji, * FROM words WHERE kanji IS NOT NULL),
    dict AS (SELECT * FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)
    SELECT surface, occurrences, coalesce(s.id, r.id) AS word_id, coalesce(s.kana, r.kana, reading, surface) AS kana,
      coalesce(CASE WHEN s.id IS NOT NULL THEN s.romaji ELSE r.romaji END, s.kana, r.kana, reading, surface) AS romaji, CAST(coalesce(s.id, r.id) IS NOT NULL AS BIGINT) AS covered
    FROM tokens LEFT JOIN dict s ON s.key = surface LEFT JOIN dict r ON r.key = reading"""

REQUESTS = "WITH " + TOKENS.strip() + """
    SELECT CASE WHEN length(surface) > 6 THEN '字' || surface ELSE surface END AS surface, CASE WHEN length(surface) > 6 THEN '字' || surface END AS kanji,
      coalesce(reading, CASE WHEN length(surface) > 6 THEN '字' || surface ELSE surface END) AS kana, '（未翻訳）' AS burmese_meaning, 'N5' AS jlpt_level, '不明' AS part_of_speech
    FROM tokens"""

READER = "WITH " + TOKENS.strip() + """,
    first AS (SELECT * FROM words ORDER BY id LIMIT 800),
    keys AS (SELECT kana AS key, * FROM first UNION ALL SELECT kanji, * FROM first WHERE kanji IS NOT NULL),
    dict AS (SELECT key, max(id) AS id FROM keys GROUP BY 1)
    SELECT CAST(coalesce(s.id, r.id) IS NOT NULL AS BIGINT) AS covered, count(*) AS tokens, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(coalesce(s.id, r.id)) AS BIGINT) AS ids
    FROM tokens LEFT JOIN dict s ON s.key = surface LEFT JOIN dict r ON r.key = reading GROUP BY 1"""

# Requests of a reading one by one: the keys held, the rows without a surface, and what each request meets.
ADDING = """
    req AS (SELECT *, row_number() OVER (PARTITION BY kana ORDER BY position) AS i FROM words),
    held AS (SELECT kana, identity_key AS k, id, kanji IS NULL AS bare FROM vocab
        UNION ALL SELECT kana, canonical_key, id, FALSE FROM vocab WHERE canonical_key IS NOT NULL),
    start AS (SELECT kana, list({'k': k, 'id': id}) AS keys, list(id) FILTER (bare) AS bares FROM held GROUP BY 1),
    fold AS (
      SELECT kana, CAST(0 AS BIGINT) AS i, coalesce(keys, []) AS keys, coalesce(bares, []) AS bares, CAST(NULL AS BIGINT) AS position,
        CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS ref FROM (SELECT DISTINCT kana FROM req) LEFT JOIN start USING (kana)
      UNION ALL
      SELECT kana, i + 1,
        CASE o WHEN 'completed' THEN list_append(list_filter(keys, lambda x: x.id <> bares[1]), {'k': k, 'id': bares[1]})
          WHEN 'created' THEN list_append(keys, {'k': k, 'id': made}) ELSE keys END,
        CASE WHEN o = 'completed' AND surfaced THEN [] WHEN o = 'created' AND NOT surfaced THEN list_append(bares, made) ELSE bares END,
        asked, o, CASE o WHEN 'existing' THEN found WHEN 'completed' THEN bares[1] END
      FROM (SELECT *, CASE WHEN found IS NOT NULL THEN 'existing' WHEN len(bares) = 1 THEN 'completed' ELSE 'created' END AS o FROM (
        SELECT f.*, r.position AS asked, r.identity_key AS k, r.kanji IS NOT NULL AS surfaced, r.position + 1099511627776 AS made,
          list_min(list_transform(list_filter(f.keys, lambda x: x.k = r.identity_key), lambda x: x.id)) AS found
        FROM fold f JOIN req r ON r.kana = f.kana AND r.i = f.i + 1))),
    final AS (SELECT w.*, outcome, ref FROM fold JOIN words w USING (position)),
    done AS (SELECT ref AS id, max_by(identity_key, position) AS k, max_by(kanji, position) FILTER (kanji IS NOT NULL) AS s FROM final WHERE outcome = 'completed' GROUP BY 1)"""

ADDED = "WITH " + ADDING.strip() + " SELECT position, outcome, CASE WHEN ref < 1099511627776 THEN ref END AS existing_id FROM final"

ADDED_VOCAB = "WITH " + ADDING.strip() + """
    SELECT v.id, replace(coalesce(k, canonical_key), chr(0), '|') AS canonical_key, coalesce(s, kanji) AS kanji, kana, pdf_source FROM vocab v LEFT JOIN done ON done.id = v.id
    UNION ALL SELECT position + 1099511627776, replace(coalesce(k, identity_key), chr(0), '|'), coalesce(s, kanji), kana, 'reader'
    FROM final LEFT JOIN done ON done.id = position + 1099511627776 WHERE outcome = 'created'"""

QUERIES = {
    "sm2_replay": (sm2_replay, v.with_views("WITH " + SM2_CARD.strip(), "ratings", recursive=True)),
    "sm2_per_learner": (sm2_per_learner, v.with_views("WITH " + SM2_LEARNER.strip(), "ratings", recursive=True)),
    "rate_cards": (rate_cards, v.with_views("WITH " + RATE_CARDS.strip(), "ratings", "stored_cards", recursive=True)),
    "rate_learners": (rate_learners, v.with_views("WITH " + RATE_LEARNERS.strip(), "ratings", recursive=True)),
    "refused_ratings": (refused_ratings, v.with_views(REFUSED, "ratings", "stored_cards")),
    "rejected_ratings": (rejected_ratings, v.with_views(REJECTED, "ratings")),
    "due_queue": (due_queue, v.with_views(DUE, "progress", "vocab")),
    "due_queue_lesson": (due_queue_lesson, v.with_views(DUE_LESSON, "progress", "vocab")),
    "ensure_progress": (ensure_progress, v.with_views(ENSURE, "vocab", "word_progress")),
    "override_status": (override_status, v.with_views(OVERRIDE, "progress")),
    "study_log": (study_log, v.with_views(LOG_ROWS, "ratings", "quizzes")),
    "streaks": (streaks, v.with_views(STREAKS, "ratings", "quizzes", recursive=True)),
    "learner_dashboard": (learner_dashboard, v.with_views(BOARD, "progress", "quizzes", "vocab", recursive=True)),
    "score_quizzes": (score_quizzes, SCORES.strip()),
    "level_counts": (level_counts, v.with_views("SELECT jlpt_level, count(*) AS words FROM vocab GROUP BY 1", "vocab")),
    "status_counts": (status_counts, v.with_views("SELECT status, count(*) AS cards FROM progress GROUP BY 1", "progress")),
    "library": (library, v.with_views(LIBRARY, "vocab", "word_progress")),
    "newest_vocabulary": (newest_vocabulary, v.with_views(NEWEST, "vocab")),
    "search_vocabulary": (search_vocabulary, v.with_views(SEARCH, "vocab", "word_progress")),
    "search_many": (search_many, v.with_views(SEARCHES, "vocab", "word_progress")),
    "lesson_groups": (lesson_groups, v.with_views(GROUPS, "vocab", "word_progress")),
    "lesson_options": (lesson_options, v.with_views(OPTIONS, "vocab")),
    "gloss": (gloss, GLOSS.strip()),
    "gloss_reader": (gloss_reader, READER.strip()),
    "token_requests": (token_requests, REQUESTS.strip()),
    "add_words": (add_words, v.with_views(ADDED, "vocab", "words", recursive=True)),
    "add_words_vocabulary": (add_words_vocabulary, v.with_views(ADDED_VOCAB, "vocab", "words", recursive=True)),
    "quiz": (quiz, f"WITH vocab AS ({v.SQL['vocab']}), " + quiz_sql(6, 11).strip()),
    "quiz_level": (quiz_level, f"WITH vocab AS ({v.SQL['vocab']}), " + quiz_sql(4, 5, "N4").strip()),
    "lesson_rows": (lesson_rows, v.with_views(LESSON_ROWS, "vocab")),
}
