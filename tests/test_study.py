import random
from datetime import date, datetime, timedelta

import plain
import pytest
from pyspark.sql import functions as F
from test_matching import VOCAB

from lexiloom.operators import gloss, learning, library, metrics, ordered, quiz


def ratings(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, vocab_id long, ts string, event_id long, grade int")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def vocab(spark, rows):
    """Rows of (id, kanji, kana, meaning, level, lesson)."""
    full = [(i, None, s, k, None, m, lv, None, None, None, "f.pdf", ls, datetime(2024, 1, 1) + timedelta(hours=i)) for i, s, k, m, lv, ls in rows]
    return spark.createDataFrame(full, VOCAB)


STORED = "user_id long, vocab_id long, ease_factor double, interval int, repetitions int, status string, next_review_date timestamp"


def test_rate_cards_matches_steps_from_any_state(spark):
    """Long and short runs from stored states, among them intervals that stay at one day while the ease is low."""
    rng = random.Random(8)
    start, rows, want, rejected = [], [], {}, {"invalid_rating": 0, "progress_not_found": 0}
    for user in range(60):
        ease, interval, reps = rng.choice([130, 131, 136, 149, 150, 250, 290]), rng.choice([0, 1, 1, 1, 2, 3, 6, 30]), rng.choice([0, 1, 2, 2, 5])
        card = (None if user == 59 else user, 7)
        stored = user % 6 != 5
        if stored:
            start.append((*card, ease / 100, interval, reps, "reviewing", datetime(2023, 12, 24)))
        n = rng.choice([0, 1, 2, 3, 30, 150])
        weights = rng.choice([[0, 3, 6, 1], [0, 1, 40, 1], [0, 1, 1, 1], [1, 30, 1, 1], [1, 1, 1, 1], [0, 0, 1, 0]])
        state, at, last = (ease, interval, reps, "reviewing"), datetime(2024, 1, 1), None
        for i in range(n):
            at += timedelta(hours=rng.choice([0, 1, 30]))
            g = rng.choices([0, 3, 4, 5], weights)[0] if rng.random() < 0.97 else 2
            rows.append((*card, str(at), len(rows), g))
            if g == 2:
                rejected["invalid_rating"] += 1
            elif not stored:
                rejected["progress_not_found"] += 1
            else:
                state, last = learning.sm2_step(g, *state[:3]), at
        if stored:
            took = sum(r[0] == card[0] and r[4] != 2 for r in rows)
            due = last + timedelta(days=state[1]) if took and state[1] <= 10**6 else None if took else datetime(2023, 12, 24)
            want[card] = (state[0] / 100, *state[1:], took, due)
    rng.shuffle(rows)
    cards, rejects = learning.rate_cards(spark.createDataFrame(start, STORED), ratings(spark, rows))
    cards = cards.withColumn("next_review_date", F.when(F.col("interval") <= 10**6, F.col("next_review_date")))
    got = {(r.user_id, r.vocab_id): tuple(r)[2:6] + (r.ratings, r.next_review_date) for r in cards.select(
        "user_id", "vocab_id", "ease_factor", "interval", "repetitions", "status", "next_review_date", "ratings").collect()}
    assert got == want
    assert {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()} == rejected


@pytest.mark.parametrize("grades,state", [
    ([5], (2.6, 1, 1, "reviewing")), ([5, 5], (2.7, 6, 2, "reviewing")), ([5, 5, 5], (2.8, 16, 3, "reviewing")),
    ([4, 4, 4, 4], (2.5, 38, 4, "mastered")), ([0], (1.7, 0, 0, "learning")), ([0, 0], (1.3, 0, 0, "learning"))])
def test_sm2_step(grades, state):
    ease, interval, reps, status = learning.START_EASE, 0, 0, "learning"
    for g in grades:
        ease, interval, reps, status = learning.sm2_step(g, ease, interval, reps)
    assert (ease / 100, interval, reps, status) == state == plain.sm2(grades)


def test_replay_matches_step(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for user in range(40):
        n = rng.choice([1, 2, 3, 5, 20, 200])
        weights = rng.choice([[1, 1, 1, 1], [0, 1, 1, 1], [1, 30, 1, 1], [0, 1, 0, 0], [3, 1, 1, 9]])
        state, at = (learning.START_EASE, 0, 0, "learning"), datetime(2024, 1, 1)
        for i in range(n):
            at += timedelta(hours=rng.choice([0, 1, 30]))
            g = rng.choices([0, 3, 4, 5], weights)[0]
            rows.append((user, 7, str(at), i, g))
            state = learning.sm2_step(g, *state[:3])
        want[user] = (state[0] / 100, state[1], state[2], state[3], n, at + timedelta(days=state[1]) if state[1] < 10**5 else None)
    rows += [(1, 7, "2024-01-01", 999, 2), (1, None, "2024-01-01", 998, 5)]
    rng.shuffle(rows)
    out = learning.replay_sm2(ratings(spark, rows)).withColumn(
        "next_review_date", F.when(F.col("interval") < 10**5, F.col("next_review_date"))).collect()
    got = {r.user_id: (r.ease_factor, r.interval, r.repetitions, r.status, r.ratings, r.next_review_date) for r in out}
    assert got == want


def test_streaks(spark):
    t = date(2024, 3, 10)
    days = {1: [1, 2, 4], 2: [0, 1, 2], 3: [2, 3], 4: [0, 0, 2], 5: [-1, 0]}
    log = spark.createDataFrame([(u, t - timedelta(days=d)) for u, ds in days.items() for d in ds], "user_id int, day date")
    assert {r.user_id: r.streak for r in learning.streaks(log, "2024-03-10").collect()} == {1: 2, 2: 3, 3: 0, 4: 1, 5: 1}


def test_log_and_dashboard(spark):
    r = ratings(spark, [(1, 1, "2024-01-02 01:00:00", 1, 5), (1, 1, "2024-01-02 23:00:00", 2, 0), (1, 2, "2024-01-03 00:00:00", 3, 1)])
    q = spark.createDataFrame([(1, "2024-01-02 05:00:00", 0.5), (1, "2024-01-02 06:00:00", 1.0), (2, "2024-01-01 06:00:00", 0.0)],
                              "user_id long, ts string, accuracy double").withColumn("ts", F.col("ts").cast("timestamp"))
    log = learning.study_log(r, q)
    assert {(x.user_id, str(x.day)): (x.words_reviewed, x.quizzes_completed, x.accuracy_score) for x in log.collect()} == {
        (1, "2024-01-02"): (2, 2, 0.75), (2, "2024-01-01"): (0, 1, 0.0)}
    v = vocab(spark, [(1, None, "a", "m", "N5", 1), (2, None, "b", "m", "N4", 2), (3, None, "c", "m", "N3", None)])
    board = {x.user_id: x for x in learning.learner_dashboard(v, learning.replay_sm2(r), log, "2024-01-02 12:00:00").collect()}
    assert (board[1].total_vocab, board[1].n5_percent, board[1].streak, board[1].today_words, board[1].learning) == (2, 50, 1, 2, 1)
    assert board[2].streak == 1 and board[2].today_words == 0


def test_progress_jobs(spark):
    v = vocab(spark, [(1, None, "a", "m", "N5", 1), (2, None, "b", "m", "N4", 2), (3, None, "c", "m", "N5", 1)])
    schema = "user_id long, vocab_id long, ease_factor double, interval int, repetitions int, status string, next_review_date timestamp"
    day = lambda d: datetime(2024, 1, d)
    p = spark.createDataFrame([(1, 1, 2.5, 6, 2, "reviewing", day(9)), (1, 2, 2.5, 0, 0, "learning", day(30)), (2, 3, 2.5, 1, 1, "reviewing", day(2)),
                               (2, 1, 2.5, 1, 1, "reviewing", day(1)), (1, 9, 2.5, 0, 0, "learning", day(1))], schema)
    rows = learning.due_queue(p, v, "2024-01-05 00:00:00", k=1).collect()
    assert {(r.user_id, r.vocab_id) for r in rows} == {(1, 2), (2, 1)}
    assert {r.vocab_id for r in learning.due_queue(p, v, "2024-01-05 00:00:00", lesson=1).collect()} == {1, 3}
    full = learning.ensure_progress(v, p.filter("user_id = 2"), "2024-01-05 00:00:00")
    assert {r.vocab_id: r.ease_factor for r in full.collect()} == {1: 2.5, 2: 2.5, 3: 2.5}
    asked = spark.createDataFrame([(0, 1, 1, "learning"), (1, 1, 1, "mastered"), (2, 2, 3, "learning"), (3, 2, 3, "done"), (4, 5, 5, "learning")],
                                  "position long, user_id long, vocab_id long, status string")
    out, bad = learning.override_status(p, asked, "2024-01-05 00:00:00")
    got = {(r.user_id, r.vocab_id): (r.status, r.interval, r.repetitions, r.next_review_date) for r in out.collect()}
    assert got[(1, 1)] == ("mastered", 21, 3, day(26)) and got[(2, 3)] == ("learning", 0, 0, day(5)) and got[(2, 1)][0] == "reviewing"
    assert {r.position: r.reason for r in bad.collect()} == {3: "invalid_request", 4: "progress_not_found"}
    answers = spark.createDataFrame([(1, 1, True), (1, 1, True), (1, 1, False), (1, 2, True), (2, 3, None)], "user_id long, quiz_id long, correct boolean")
    assert {(r.quiz_id): (r.score, r.total, r.percent, r.band) for r in learning.score_quizzes(answers).collect()} == {
        1: (2, 3, 67, "fair"), 2: (1, 1, 100, "good"), 3: (0, 1, 0, "again")}


def test_percentiles(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 19, 20, 21, 400):
        data = [rng.choice([rng.randint(0, 10), rng.randint(0, 2**31 - 1)]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "d int")
        r = metrics.rank_percentiles(df, "d").collect()[0]
        s = sorted(data)
        assert (r.median, r.p95) == (s[n // 2], s[min(n - 1, int(n * 0.95))])
    assert tuple(metrics.rank_percentiles(df.filter("d < 0"), "d").collect()[0]) == (0, 0)


BATCH = ("batch_id long, source_name string, status string, created_at string, total_pages int, ocr_pages int, extracted_candidates int, "
         "imported_candidates int, duplicate_count int, review_count int, duration_ms int")


def test_metrics(spark):
    b = spark.createDataFrame([
        (1, "A.pdf", "completed", "2024-01-01 01:00:00", 10, 5, 100, 80, 10, 5, 1000), (2, "b.pdf", "completed", "2024-01-01 02:00:00", 0, 0, 0, 0, 0, 0, 2001),
        (3, "c.pdf", "failed", "2024-01-02 02:00:00", 10, 0, 100, 7, 0, 0, None), (4, "a2.pdf", "needs_review", "2024-01-04 02:00:00", 1, 1, 1, 1, 1, 1, 5)],
        BATCH).withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = [tuple(r)[1:] for r in metrics.batch_trends(b, None, "2024-01-02").collect()]
    assert rows == [(2, 0.5, 0.1, 0.05, 1501), (1, 0.0, 0.0, 0.0, 0)]
    kids = spark.createDataFrame([(1, "needs_review"), (1, "approved"), (4, "needs_review"), (9, "needs_review")], "batch_id long, status string")
    cands = spark.createDataFrame([(1, "pending"), (3, "pending"), (3, "done")], "batch_id long, status string")
    r = metrics.batch_summary(b, kids, cands).collect()[0]
    assert (r.batches, r.completed, r.failed, r.needs_review, r.attention_pages, r.attention_candidates) == (4, 2, 1, 1, 2, 2)
    assert (r.median_duration_ms, r.p95_duration_ms) == (2001, 2001) and abs(r.ocr_accuracy - 80 / 201) < 1e-12
    assert metrics.batch_summary(b.limit(0), kids, cands).collect()[0].batches == 0
    assert [x.batch_id for x in metrics.batch_history(b, source="a").collect()] == [4, 1]
    assert [x.batch_id for x in metrics.batch_history(b, status="completed", limit=1).collect()] == [2]
    assert {x.batch_id: x.pages for x in metrics.relation_counts(b, "batch_id", {"pages": kids}).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}


def test_ordered(spark):
    rows = [("hot", i % 4, i) for i in range(60)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "k string, s int, i int").repartition(3)
    got = {r.i: r["rank"] for r in ordered.split_rank(df, ["k"], [[-F.col("s")], [F.floor(F.col("i") / 10)]], [F.col("s").desc(), F.col("i")]).filter("k = 'hot'").collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((-(i % 4), i) for i in range(60)))}
    assert got == want
    assert {r.k: r.i for r in ordered.dedupe_first(df, ["k"], [F.col("i").desc()]).collect()} == {"hot": 59, "b": 1}


def test_library(spark):
    v = vocab(spark, [(1, "橋", "はし", "bridge", "N5", 2), (2, None, "あさ", "Morning", "N4", 1), (3, "箸", "はし", "chopsticks", "N5", None), (4, None, "かさ", "umbrella", "N3", 2)])
    p = spark.createDataFrame([(1, "mastered", datetime(2024, 1, 1))], "vocab_id long, status string, next_review_date timestamp")
    rows = library.with_status(v, p)
    assert [r.id for r in library.library(v, p, 2).orderBy("id").collect()] == [2, 4]
    assert [r.id for r in library.newest_vocabulary(v, 2).collect()] == [4, 3]
    assert {r.id for r in library.search_vocabulary(rows, " MORN ").collect()} == {2}
    assert {r.id for r in library.search_vocabulary(rows, "はし", level="N5", status="learning").collect()} == {3}
    assert {r.id for r in library.search_vocabulary(rows, lesson="unassigned").collect()} == {3}
    assert {r.id for r in library.search_vocabulary(rows, "f.pdf", lesson=2).collect()} == {1, 4}
    assert [(r.lesson, r.words, r.mastered) for r in library.lesson_groups(rows).collect()] == [(1, 1, 0), (2, 2, 1), (None, 1, 0)]
    assert tuple(library.lesson_options(rows).collect()[0]) == ([1, 2], True)
    assert [r.id for r in library.lesson_rows(rows).collect()] == [2, 4, 1, 3]
    assert {r.jlpt_level: r.words for r in learning.level_counts(v).collect()} == {"N5": 2, "N4": 1, "N3": 1}


def test_gloss(spark):
    v = vocab(spark, [(1, "橋", "はし", "bridge", "N5", 2), (2, "箸", "ハシ", "chopsticks", "N5", 2), (3, None, "きょう", "today", "N4", 1)])
    t = spark.createDataFrame([("箸", "ハシ"), ("x", "ハシ"), ("today", "キョウ"), ("猫", "ネコ"), ("zz", None)], "surface string, reading string")
    got = {r.surface: (r.word_id, r.kana, r.romaji, r.covered) for r in gloss.gloss(t, v).collect()}
    assert got == {"箸": (2, "ハシ", "hashi", True), "x": (1, "はし", "hashi", True), "today": (3, "きょう", "kiyou", True),
                   "猫": (None, "ねこ", "neko", False), "zz": (None, "zz", "zz", False)}
    assert {r.surface: r.word_id for r in gloss.gloss(t, v, keep="last").collect()}["x"] == 2
    assert {r.surface: r.word_id for r in gloss.gloss(t, v, cap=2).collect()}["today"] is None
    asked = gloss.token_requests(t.withColumn("position", F.monotonically_increasing_id()))
    assert {r.surface: (r.kanji, r.kana) for r in asked.collect()}["箸"] == ("箸", "はし")
    req = spark.createDataFrame([(0, "橋", "はし", "b", "N5"), (1, "今日", "きょう", " ", "N4"), (2, None, "", "m", "N5"), (3, None, "ねこ", " ", "N9"), (4, None, "ネコ", "cat", "N5")],
                                "position long, kanji string, kana string, burmese_meaning string, jlpt_level string")
    out, grown = gloss.add_words(req, v, new_id=F.lit(100) + F.col("position"))
    assert {r.position: (r.outcome, r.existing_id) for r in out.collect()} == {
        0: ("existing", 1), 1: ("completed", 3), 2: ("invalid", None), 3: ("created", None), 4: ("existing", None)}
    rows = {r.id: r for r in grown.collect()}
    assert rows[3].kanji == "今日" and (rows[103].burmese_meaning, rows[103].jlpt_level) == ("ねこ", "N5") and len(rows) == 4
    texts = spark.createDataFrame([("A b a",), ("b c",)], "text string")
    assert {r.surface: r.occurrences for r in gloss.tokens_of(texts).collect()} == {"a": 2, "b": 2, "c": 1}


def test_quiz(spark):
    v = vocab(spark, [(i, f"w{i}" if i % 3 else None, f"k{i % 30}", f"m{i % 25}" if i % 7 else f"k{i % 30}", "N5" if i % 2 else "N4", None) for i in range(60)])
    users = spark.createDataFrame([(u,) for u in range(20)], "user_id long")
    rows = quiz.quiz(v, users, n=6, seed=3).collect()
    assert len(rows) == 120 and {r.type for r in rows} == set(quiz.TYPES)
    by_id = {r.id: r for r in v.collect()}
    for r in rows:
        w = by_id[r.vocab_id]
        answer = w.burmese_meaning if r.type == "jp_to_mm" else (w.kanji or w.kana)
        assert len(set(r.options)) == 4 and r.options[r.correct_index] == answer and r.vocab_id < 40
        assert w.burmese_meaning != w.kana and w.kana in r.explanation
    assert sorted(map(str, rows)) == sorted(map(str, quiz.quiz(v, users.repartition(3), n=6, seed=3).collect()))
    assert len({tuple(r.options) for r in rows}) > 60
    assert quiz.quiz(v.limit(3), users).count() == 0
    assert quiz.quiz(v, users, n=99, level="N4").count() == 200


def plain_add(stored, requests):
    """Requests one by one on the rows that stand: outcomes by position, and the rows at the end."""
    rows = [dict(id=i, key=k, kanji=s, kana=r) for i, k, s, r in stored]
    outcomes = {}
    for position, surface, reading in requests:
        if not reading:
            outcomes[position] = ("invalid", None)
            continue
        key = plain.key(surface, reading)
        held = sorted((r["id"] for r in rows if key in (plain.key(r["kanji"], r["kana"]), r["key"])))
        bare = [r for r in rows if r["kana"] == reading and not r["kanji"]]
        if held:
            outcomes[position] = ("existing", held[0] if held[0] < 1000 else None)
        elif len(bare) == 1:
            bare[0].update(key=key, kanji=surface or bare[0]["kanji"])
            outcomes[position] = ("completed", bare[0]["id"] if bare[0]["id"] < 1000 else None)
        else:
            rows.append(dict(id=1000 + position, key=key, kanji=surface, kana=reading))
            outcomes[position] = ("created", None)
    return outcomes, {r["id"]: (r["key"], r["kanji"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_add_words_in_turn(spark, seed):
    rng = random.Random(seed)
    pick = lambda: (rng.choice([None, None, "A", "B", "C"]), rng.choice("xyzw"))
    stored = []
    for i in range(1, 4 + 2 * seed):
        s, r = pick()
        stored.append((i, rng.choice([None, plain.key(s, r)]), s, r))
    requests = [(i, *pick()) for i in range(40)] + [(40, "A", "")]
    v = vocab(spark, [(i, s, r, "m", "N5", 1) for i, _, s, r in stored])
    keys = spark.createDataFrame([(i, k) for i, k, *_ in stored], "id long, k string")
    v = v.join(keys, "id").withColumn("canonical_key", F.col("k")).select(*v.columns)
    asked = spark.createDataFrame(requests, "position long, kanji string, kana string").withColumns(
        {"burmese_meaning": F.lit("m"), "jlpt_level": F.lit("N5")})
    out, grown = gloss.add_words(asked.repartition(3), v, new_id=F.lit(1000) + F.col("position"))
    outcomes, rows = plain_add(stored, requests)
    assert {r.position: (r.outcome, r.existing_id) for r in out.collect()} == outcomes
    got = {r.id: (r.canonical_key, r.kanji) for r in grown.collect()}
    assert {i: k for i, (_, k) in got.items()} == {i: k for i, (_, k) in rows.items()}
    assert {i: k for i, (k, _) in got.items() if i > 1000} == {i: k for i, (k, _) in rows.items() if i > 1000}
    progress = learning.ensure_progress(grown, spark.createDataFrame(
        [], "user_id long, vocab_id long, ease_factor double, interval int, repetitions int, status string, next_review_date timestamp"), "2024-01-05 00:00:00")
    assert progress.count() == len(rows)


@pytest.mark.parametrize("run_size,seed", [(1, 1), (3, 2), (7, 3), (16384, 4)])
def test_add_words_with_a_hot_reading_and_stale_keys(spark, run_size, seed):
    """Half of the requests have one reading, many of them without a surface; saved keys differ from the computed ones."""
    rng = random.Random(seed)
    surface = lambda n: None if rng.random() < 0.45 else f"S{rng.randrange(n)}"
    readings = ["hot", *"abcdefgh"]
    stored = []
    for i in range(1, 16):
        r, s = readings[i % 9], surface(4) if i % 3 else None
        stored.append((i, rng.choice([None, None, plain.key(s, r), plain.key(surface(4), r)]), s, r))
    if seed % 2:
        stored = [x for x in stored if x[3] != "hot"]
    requests = [(i * 3, surface(60), "hot" if rng.random() < 0.5 else rng.choice(readings)) for i in range(160)]
    v = vocab(spark, [(i, s, r, "m", "N5", 1) for i, _, s, r in stored])
    keys = spark.createDataFrame([(i, k) for i, k, *_ in stored], "id long, k string")
    v = v.join(keys, "id").withColumn("canonical_key", F.col("k")).select(*v.columns)
    asked = spark.createDataFrame(requests, "position long, kanji string, kana string").withColumns(
        {"burmese_meaning": F.lit("m"), "jlpt_level": F.lit("N5")})
    out, grown = gloss.add_words(asked.repartition(3), v, new_id=F.lit(1000) + F.col("position"), run_size=run_size)
    outcomes, rows = plain_add(stored, requests)
    assert {r.position: (r.outcome, r.existing_id) for r in out.collect()} == outcomes
    assert {o for o, _ in outcomes.values()} == {"existing", "completed", "created"}
    assert {r.id: r.kanji for r in grown.collect()} == {i: k for i, (_, k) in rows.items()}


def test_many_searches_equal_single_ones(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abAB ć") for _ in range(rng.randint(0, 6)))
    v = vocab(spark, [(i, rng.choice([None, word()]), word(), word(), rng.choice(["N4", "N5"]), rng.choice([None, 1, 2])) for i in range(120)])
    progress = spark.createDataFrame([(i, "mastered", datetime(2024, 1, 1)) for i in range(0, 120, 3)], "vocab_id long, status string, next_review_date timestamp")
    rows = library.with_status(v, progress)
    asked = [(i, rng.choice([word(), " A", "b", "AB ", "zzz", "", None]), rng.choice(["all", "N4", None]), rng.choice(["all", "learning"]), rng.choice(["all", "unassigned", "2"]))
             for i in range(30)]
    df = spark.createDataFrame(asked, "search_id long, query string, level string, status string, lesson string")
    for postings in (None, library.search_postings(rows)):
        got = {}
        for r in library.search_many(df, rows, postings).collect():
            assert r.id not in got.setdefault(r.search_id, set())
            got[r.search_id].add(r.id)
        for i, q, level, status, lesson in asked:
            want = library.search_vocabulary(rows, q or "", level or "all", status, lesson)
            assert got.get(i, set()) == {r.id for r in want.collect()}, (q, level, status, lesson)
