"""Work per row is done once, for the rows and columns that need it."""

import random

from pyspark.sql import functions as F
from test_matching import VOCAB, WORDS, vocab_row, word_row

from lexiloom.functions import text
from lexiloom.operators import chunking, library, matching, pages, quiz, words


def vocabulary(spark, rows):
    given = spark.createDataFrame(rows, "id long, kana string, burmese_meaning string")
    extra = [c for c in spark.createDataFrame([], VOCAB).columns if c not in given.columns]
    return given.select("*", *[F.lit(None).cast("string").alias(c) for c in extra]).withColumns(
        {"created_at": F.timestamp_seconds("id"), "jlpt_level": F.lit("N4")})


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_quiz_is_drawn_once_for_each_learner(spark):
    v = vocabulary(spark, [(i, f"k{i}", f"m{i % 9}") for i in range(30)])
    users = spark.range(4000).select((F.col("id") % 50).alias("user_id")).distinct()
    out = quiz.quiz(v, users, n=4, level="N4")
    below = optimized(out).split("Aggregate [user_id")
    assert len(below) == 2 and "md5" in below[0] and "md5" not in below[1]
    assert not any("Filter" in line and "md5" in line for line in below[0].splitlines())
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 200


def test_a_quiz_without_material_has_no_questions(spark):
    users = spark.range(3).withColumnRenamed("id", "user_id")
    assert quiz.quiz(vocabulary(spark, [(i, f"k{i}", f"k{i}") for i in range(9)]), users).collect() == []
    assert quiz.quiz(vocabulary(spark, [(i, f"k{i}", "") for i in range(9)]), users).collect() == []


def test_cold_blocks_meet_without_bigrams_and_hot_ones_in_lists(spark, monkeypatch):
    """The same candidates whether no block, some blocks or all of them are hot; without hot ones no list of rows is made."""
    rng = random.Random(6)
    texts = lambda n: sorted({(rng.choice("st"), rng.choice(["abcd", "abcx", "abc", "xbcd", "abdc", "aab", "ab"]),
                               "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(n)})
    keys = "surface_key string, reading_key string, meaning_key string"
    given = spark.createDataFrame(texts(200), keys)
    rows = spark.createDataFrame([(*t, 1000 - i) for i, t in enumerate(texts(250))], keys + ", id long")
    lists, asked = matching._met_lists, []
    monkeypatch.setattr(matching, "_met_lists", lambda *given: asked.append(1) or lists(*given))
    found = []
    for chunk in (10**9, 60, 1):
        best = matching.fuzzy_candidates(given, rows, chunk)
        if not asked:
            assert "collect_list" not in optimized(best)
        found.append(sorted((tuple(r) for r in best.collect()), key=str))
    assert found[0] == found[1] == found[2] and len(found[0]) > 50 and len(asked) == 2
    stored = [(r.surface_key, r.reading_key, r.meaning_key, r.id) for r in rows.collect()]
    grams = lambda m: {m[i:i + 2] for i in range(len(m) - 1)}

    def similarity(a, b):
        x, y = grams(a), grams(b)
        return 1.0 if a == b else len(x & y) / len(x | y) if x and y else 0.0

    def near(a, b):
        if a == b or len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for surface, reading, meaning, fuzzy in found[0]:
        score = lambda r: round(0.55 + 0.25 * (r[1] == reading) + 0.2 * similarity(meaning, r[2]) + 1e-9, 3)  # noqa: E731,B023
        near_rows = [r for r in stored if r[0] == surface and near(r[1], reading) and similarity(meaning, r[2]) >= 0.45]
        assert fuzzy.ex_id == min(near_rows, key=lambda r: (-score(r), r[3]))[3]


def test_words_are_looked_up_once(spark, monkeypatch):
    looked, meanings_agree = [], matching.meanings_agree
    monkeypatch.setattr(matching, "meanings_agree", lambda *given: looked.append(1) or meanings_agree(*given))
    v = spark.createDataFrame([vocab_row(i + 1, f"s{i}", f"r{i}", f"meaning {i}") for i in range(20)], VOCAB)
    w = spark.createDataFrame([word_row(i, f"s{i}", f"r{i}x", f"meaning {i}") for i in range(20)], WORDS)
    out = matching.decide(w, v, explained=False)
    assert {r.kind for r in out.collect()} == {"review"}
    assert looked == [1] and "kana" in out.columns and optimized(out).count("regexp_replace") == 0


def test_pages_are_marked_without_parsing_all_their_words(spark):
    p = spark.createDataFrame(
        [(1, "b", "あ はし က;x y z"), (2, "b", "no words"), (3, "b", None), (4, "b", ";\n"), (4, "b", "橋 はし တံတား"), (None, "b", "橋 はし တံတား"), (5, "b", "x y z\n橋 ハシ တံတား N4")],
        "page_id long, batch_id string, raw_text string")
    c = spark.createDataFrame([], "candidate_id string, batch_id string, page_id long, incoming_json string, canonical_key string, decision_kind string, status string, vocabulary_id long, reasons_json string, created_at timestamp")
    out, fresh = pages.reprocess(p, c, spark.createDataFrame([], VOCAB))
    assert "posexplode" not in optimized(out) and "Join" not in optimized(out)
    marked = sorted(((r.page_id or 0), r.status, r.error_category) for r in out.collect())
    bad = ("failed", "no_valid_candidates")
    assert marked == [(0, *bad), (1, "needs_review", None), (2, *bad), (3, *bad), (4, "needs_review", None), (4, "needs_review", None), (5, "needs_review", None)]
    cleaned = out.select("page_id", F.col("normalized_text").alias("text"))
    parsed = {r.page_id for r in words.parse_lines(cleaned, cleaned=True).select("page_id").distinct().collect()}
    assert parsed == {None, 1, 4, 5}


def test_texts_are_searched_for_a_lesson_once(spark):
    p = spark.createDataFrame([("d", 1, "Lesson 4"), ("d", 2, "x"), ("d", 2, "a UNIT 7"), ("d", 9000, "plain"), ("e", 1, "第１２課"), ("f", 1, None)], "doc string, num long, text string")
    out = chunking.fill_lesson(p)
    assert "LogicalRDD" in optimized(out) and "regexp" not in optimized(out).lower()
    assert sorted((r.doc, r.num, r.lesson) for r in out.collect() if r.lesson) == [("d", 1, 4), ("d", 2, 7), ("d", 2, 7), ("d", 9000, 7), ("e", 1, 12)]


def test_lessons_are_found_as_by_the_pattern_alone(spark):
    texts = ["LESSON 3", "ＬＥＳＳＯＮ３", "unİt 4", "unıt 4", "UNIT4", "Chapter　5", "第 6 課", "7課", "leſson 8", "lesson x", "", None, "community 9", "x" * 50 + "cHaPtEr 99"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    header = F.regexp_extract(text.nfkc("t"), text.LESSON_PATTERN, 0)
    number = F.regexp_extract(header, r"\d{1,2}", 0).try_cast("int")
    assert str(text.detect_lesson("t")).count("lesson|unit") == 1
    rows = df.select(text.detect_lesson("t").alias("got"), F.when(number.between(1, 25), number).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.got is not None for r in rows) >= 7


def test_searches_meet_no_word_that_their_filters_refuse(spark):
    v = vocabulary(spark, [(i, f"kana{i % 3}", "m") for i in range(30)]).withColumns(
        {"status": F.lit("all"), "lesson": F.when(F.col("id") % 2 == 0, (F.col("id") % 5).cast("int"))})
    asked = spark.createDataFrame(
        [(1, "kana1", "N4", None, "2"), (2, "kana1", "N5", None, None), (3, "KANA1", None, "all", "unassigned"), (4, "", None, None, "2")],
        "search_id long, query string, level string, status string, lesson string")
    out = library.search_many(asked, v)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any(line.strip(" :+-").startswith("Join Inner") and "_q#" in line and "_level#" in line and " OR " not in line for line in plan.splitlines())
    got = sorted((r.search_id, r.id) for r in out.collect())
    assert got == sorted([(1, i) for i in range(30) if i % 3 == 1 and i % 2 == 0 and i % 5 == 2]
                         + [(3, i) for i in range(30) if i % 3 == 1 and i % 2] + [(4, i) for i in range(30) if i % 2 == 0 and i % 5 == 2])
