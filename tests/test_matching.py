import json
import random

import plain
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import LATIN
from lexiloom.operators import accuracy, ingest, matching, tables, words

VOCAB = (
    "id long, canonical_key string, kanji string, kana string, romaji string, burmese_meaning string, "
    "jlpt_level string, part_of_speech string, example_sentence_jp string, example_sentence_mm string, "
    "pdf_source string, lesson int, created_at timestamp"
)
REVIEWS = (
    "review_key string, incoming_json string, candidate_id long, score double, reasons_json string, "
    "explanation_json string, source string, status string, created_at timestamp"
)
WORDS = (
    "position long, kanji string, kana string, romaji string, burmese_meaning string, jlpt_level string, "
    "part_of_speech string, lesson int, example_sentence_jp string, example_sentence_mm string"
)


def vocab_row(id, kanji, kana, meaning, key=None):
    return (id, key, kanji, kana, None, meaning, "N5", None, None, None, None, None, None)


def word_row(position, kanji, kana, meaning):
    return (position, kanji, kana, None, meaning, "N5", None, None, None, None)


def decide_one(spark, incoming, stored):
    i = spark.createDataFrame([word_row(0, *incoming)], WORDS)
    v = spark.createDataFrame([vocab_row(n, *s) for n, s in enumerate(stored)], VOCAB)
    return matching.decide(i, v).collect()[0]


def test_unit_cases(spark):
    eat = "စားသည်"
    same = ("食べる", "たべる", eat, "surface:食べる\0reading:たべる")
    assert decide_one(spark, ("食べる", "タベル", eat), [same]).kind == "exact"
    assert decide_one(spark, ("食べる", "たべる", eat), [(None, "たべる", eat)]).kind == "enrich"
    r = decide_one(spark, ("食べる", "たべゐる", eat), [same])
    assert (r.kind, r.score, r.explanation.confidence, r.explanation.collision_risk) == ("review", 0.75, "medium", "medium")
    assert r.reasons == ["same normalized kanji surface", "kana edit distance 1", "compatible Burmese meaning (100%)"]
    assert [s.positive for s in r.explanation.signals] == [True, False, True]
    assert decide_one(spark, (None, "はし", "တံတား"), [("橋", "はし", "တံတား"), ("箸", "はし", "တူ")]).kind == "new"
    assert decide_one(spark, ("食べ物", "たべる", eat), [same]).kind == "new"
    stale = ("食べる", "たべる", eat, "reading:たべる")
    r = decide_one(spark, ("食べる", "たべる", eat), [stale])
    assert (r.kind, r.score, r.explanation.confidence) == ("review", 1.0, "high")


def random_rows(rng, n, surfaces, readings, meanings):
    return [(rng.choice(surfaces), rng.choice(readings), rng.choice(meanings)) for _ in range(n)]


POOL = dict(
    surfaces=[None, None, "S", "T", "U U"],
    readings=["ab", "abc", "abcd", "bcd", "xbc", "ax", "x", "xy", "xyz", "abx"],
    meanings=["to eat food", "to eat foods", "eat food", "bridge", "a bridge", "z"],
)


def stored_rows(rng, n):
    rows = []
    for i, (s, r, m) in enumerate(random_rows(rng, n, **POOL)):
        saved = rng.choice([None, plain.key(s, r), f"reading:{r}"])
        rows.append(vocab_row(i + 1, s, r, m, saved))
    return rows


def as_dicts(rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return [dict(zip(names, r)) for r in rows]


@pytest.mark.parametrize("seed,chunk", [(1, 512), (2, 1), (3, 2)])
def test_decide_matches_plain(spark, seed, chunk):
    rng = random.Random(seed)
    stored = stored_rows(rng, 25)
    incoming = [word_row(i, *w) for i, w in enumerate(random_rows(rng, 120, **POOL))]
    got = matching.decide(
        spark.createDataFrame(incoming, WORDS), spark.createDataFrame(stored, VOCAB), chunk).collect()
    assert len(got) == len(incoming)
    rows = as_dicts(stored, VOCAB)
    for r in got:
        want = plain.decide(dict(kanji=r.kanji, kana=r.kana, burmese_meaning=r.burmese_meaning), rows)
        assert (r.kind, r.existing_id, r.score) == want, r


@pytest.mark.parametrize("seed,stored_n", [(1, 0), (2, 3), (3, 12), (4, 0)])
def test_ingest_matches_plain(spark, seed, stored_n):
    rng = random.Random(seed)
    stored = stored_rows(rng, stored_n)
    incoming = [word_row(i, *w) for i, w in enumerate(random_rows(rng, 90, **POOL))]
    vocab = spark.createDataFrame(stored, VOCAB)
    result = ingest.ingest(
        spark.createDataFrame(incoming, WORDS).repartition(3), vocab, spark.createDataFrame([], REVIEWS), "f.pdf")
    got = {r.position: (r.kind, r.existing_id, r.score) for r in result.decisions.collect()}
    want = plain.ingest(as_dicts(incoming, WORDS), as_dicts(stored, VOCAB))
    assert got == want
    new = sum(k == "new" for k, _, _ in want.values())
    assert result.vocabulary.count() == stored_n + new
    totals = result.totals.collect()[0]
    assert totals.inserted == new and totals.reviewed == sum(k == "review" for k, _, _ in want.values())


def test_ingest_chain_of_near_readings(spark):
    """Each reading is one edit from the one before: every other word is inserted."""
    incoming = [word_row(i, "S", "a" * (i + 1), "meaning one") for i in range(12)]
    result = ingest.ingest(
        spark.createDataFrame(incoming, WORDS), spark.createDataFrame([], VOCAB), spark.createDataFrame([], REVIEWS))
    kinds = [r.kind for r in result.decisions.orderBy("position").collect()]
    assert kinds == ["new", "review"] * 6
    assert result.reviews.count() == 6


def test_enrich_fills_only_missing_and_last_wins(spark):
    vocab = spark.createDataFrame([(1, None, None, "ab", None, "m", "N5", "noun", None, None, None, None, None)], VOCAB)
    updates = spark.createDataFrame(
        [(0, "A", "r1", "verb", 3), (1, "B", None, "verb", None)],
        "position long, kanji string, romaji string, part_of_speech string, lesson int",
    ).withColumns({"existing_id": F.lit(1).cast("long"), "identity_key": F.concat(F.lit("k"), "position"),
                   "example_sentence_jp": F.lit(None).cast("string"), "example_sentence_mm": F.lit(None).cast("string")})
    r = matching.enrich(vocab, updates).collect()[0]
    assert (r.canonical_key, r.kanji, r.romaji, r.part_of_speech, r.lesson) == ("k1", "B", "r1", "noun", 3)


def test_block_candidates(spark):
    vocab = spark.createDataFrame([vocab_row(1, "A", "x", "m"), vocab_row(2, "B", "y", "m"), vocab_row(3, None, "z", "m")], VOCAB)
    inc = spark.createDataFrame([word_row(0, "A", "q", "m"), word_row(1, None, "y", "m")], WORDS)
    got = {r.id: (r.by_key, r.by_reading, r.by_surface) for r in matching.block_candidates(inc, vocab).collect()}
    assert got == {1: (False, False, True), 2: (False, True, False)}


def test_normalize_and_parse(spark):
    raw = spark.createDataFrame(
        [("食べる", "タベル", "စားသည်", "N5"), ("x", "hello", "စားသည်", "N5"), ("x", "たべる", "to eat", "N5"), ("x", "たべる", None, "N4")],
        "kanji string, kana string, burmese_meaning string, jlpt_level string")
    good, bad = words.normalize_words(raw)
    r = good.collect()
    assert [(x.kana, x.romaji, x.jlpt_level) for x in r] == [("たべる", "taberu", "N5")] and bad.count() == 3
    item = {"kana": "たべる", "burmese_meaning": "စားသည်", "lesson": 7}
    answers = [
        (1, "```json\n" + json.dumps({"items": [item, {**item, "romaji": "x"}, {"kana": 5, "burmese_meaning": "စ"}]}) + "\n```"),
        (2, json.dumps([{**item, "lesson": "99", "jlpt_level": "n5"}, "text", None])), (3, "{broken"), (4, '{"a": 1}'),
    ]
    df = spark.createDataFrame(answers, "response_id long, response string").withColumn("chunk_text", F.lit("N4 Lesson 3"))
    got = [(x.response_id, x.position, x.lesson, x.jlpt_level) for x in words.parse_responses(df).orderBy("response_id").collect()]
    assert got == [(1, 0, 7, "N4"), (2, 0, 3, "N5")]
    pages = spark.createDataFrame([(1, "学校 がっこう ကျောင်း\nbad line; 先生 せんせい ဆရာ")], "page_id long, text string")
    assert [(x.kanji, x.kana) for x in words.parse_lines(pages).orderBy("position").collect()] == [("学校", "がっこう")]


def test_manifest_cases(spark, tmp_path):
    stored = lambda id, s, r, m: {"id": id, "canonicalKey": None, "kanji": s, "kana": r, "burmeseMeaning": m}
    cases = [
        {"id": "near", "incoming": {"kanji": "食べる", "kana": "たべゐる", "burmese_meaning": "စားသည်"},
         "existing": [stored("a", "食べる", "たべる", "စားသည်")], "expectedKind": "review", "minimumScore": 0.7},
        {"id": "kana", "incoming": {"kanji": "学校", "kana": "ガッコウ", "burmese_meaning": "ကျောင်း"},
         "existing": [stored("b", "学校", "がっこう", "ကျောင်း")], "expectedKind": "exact"},
        {"id": "homograph", "incoming": {"kana": "はし", "burmese_meaning": "တံတား"},
         "existing": [stored("c", "箸", "はし", "တူ"), stored("d", "橋", "はし", "တံတား")], "expectedKind": "new"},
    ]
    path = tmp_path / "m.json"
    samples = [{"id": "s1", "path": "a.pdf", "minimumPages": 1, "requiredText": ["x"], "ocr": {"minimumCharacters": 5}}]
    path.write_text(json.dumps({"matchCases": cases, "pdfSamples": samples}, ensure_ascii=False), encoding="utf8")
    from lexiloom.sources.files import read_manifest, read_samples

    sample = read_samples(spark, str(path)).collect()[0]
    assert (sample.id, sample.requiredText, sample.ocr.minimumCharacters) == ("s1", ["x"], 5)

    manifest = read_manifest(spark, str(path))
    labelled = manifest.select("id", F.col("expectedKind").alias("expected_kind"), F.col("minimumScore").alias("minimum_score"))
    report = accuracy.accuracy_report(accuracy.judge_cases(labelled, accuracy.decide_cases(manifest))).collect()[0]
    assert (report.passed, report.failed, report.total, report.accuracy) == (3, 0, 3, 1.0)
    none = accuracy.accuracy_report(accuracy.judge_cases(labelled.limit(0), accuracy.decide_cases(manifest).limit(0)))
    assert none.collect()[0].accuracy == 1.0


def test_extraction_checks(spark):
    n5 = "N5 Lesson 3\n学校 がっこう 先生 せんせい\n学生 がくせい 本 ほん\n\nJLPT vocabulary practice sample"
    n4 = "N4 Lesson 9\n必要 ひつよう 準備 じゅんび\n説明 せつめい 経験 けいけん\nJLPT vocabulary practice sample"
    pages = spark.createDataFrame([("a", 1, n5), ("b", 1, n4), ("scan", 1, "  ")], "doc string, num long, text string")
    specs = spark.createDataFrame(
        [("a", ["学校", "本"], 1, 60, "N5", 3, False), ("b", ["missing"], 1, 60, "N4", 9, False), ("scan", None, None, None, None, None, True)],
        "doc string, required_text array<string>, minimum_pages int, minimum_characters int, expected_level string, "
        "expected_lesson int, expect_no_text boolean")
    got = {r.doc: (r.passed, r.characters, r.level, r.lesson, r.missing_text) for r in accuracy.extraction_checks(pages, specs).collect()}
    assert got["a"] == (True, 73, "N5", 3, []) and got["b"] == (False, 75, "N4", 9, ["missing"])
    assert got["scan"][0]


def test_table_snapshots(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "z", "z", 0), (3, "c", "q", 2), (3, "d", "q", 1)], "k int, v string, w string, o int")
    got = {r.k: r.v for r in tables.insert_absent(target, new, ["k"], [F.col("o")]).collect()}
    assert got == {1: "a", 2: "b", 3: "d"}
    changes = spark.createDataFrame([(1, "n", "n"), (2, "n", "n"), (9, "n", "n")], "k int, v string, w string")
    got = {r.k: (r.v, r.w) for r in tables.upsert(target, changes, ["k"], keep_old=["w"]).collect()}
    assert got == {1: ("n", "n"), 2: ("n", "x"), 9: ("n", "n")}
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, k int")
    out = tables.delete_where(target, F.col("v") == "a", "k", {"kids": (child, "k")}, {"links": (child, "k")})
    assert out["target"].count() == 1
    assert {r.c for r in out["kids"].collect()} == {11, 12}
    assert {(r.c, r.k) for r in out["links"].collect()} == {(10, None), (11, 2), (12, None)}


def test_scripts_are_parameters(spark):
    raw = spark.createDataFrame([("ab", "cd", "ef")], "kanji string, kana string, burmese_meaning string")
    good, _ = words.normalize_words(raw, scripts=words.Scripts(LATIN, LATIN))
    assert good.count() == 1
