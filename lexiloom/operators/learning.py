"""Spaced repetition, study log, streaks and learner dashboards for many learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.temporal import add_days, day
from ..functions.text import LEVELS, percent
from ..session import cut_lineage
from .ordered import join_same, top_k

# Grades, start state, ease change per grade and floor (in hundredths, so sums are
# exact), first two intervals, and the interval from which a card counts as mastered.
GRADES = (0, 3, 4, 5)
START_EASE, EASE_FLOOR = 250, 130
EASE_STEP = {0: -80, 3: -14, 4: 0, 5: 10}
PASS_GRADE, FIRST_INTERVAL, SECOND_INTERVAL, MASTERED_DAYS = 3, 1, 6, 21
# Calendar limit of an interval.  From the second interval on, every pass multiplies the interval
# by 1.3 at least, so it is reached within 70 passes and later passes cannot change it.
MAX_DAYS, TAIL = 100_000_000, 80
# Ease (in hundredths) from which a pass turns an interval of one day into two.
LEAVES_ONE = 150
# State of a card marked mastered by hand, and the card limit of a session.
OVERRIDE_DAYS, OVERRIDE_REPETITIONS, SESSION_CARDS = 21, 3, 24
STATUSES = ("learning", "reviewing", "mastered")


def valid_ratings(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) ratings: a card and a grade of 0, 3, 4 or 5."""
    good = F.col("vocab_id").isNotNull() & F.coalesce(F.col("grade").isin(*GRADES), F.lit(False))
    return ratings.filter(good), ratings.filter(~good)


def sm2_step(grade: int, ease: int, interval: int, repetitions: int) -> tuple[int, int, int, str]:
    """State after one rating; ``ease`` in hundredths.  The streaming job uses this form."""
    next_ease = max(EASE_FLOOR, ease + EASE_STEP[grade])
    if grade < PASS_GRADE:
        return next_ease, 0, 0, "learning"
    repetitions += 1
    if repetitions == 1:
        interval = FIRST_INTERVAL
    elif repetitions == 2:
        interval = SECOND_INTERVAL
    else:
        interval = min(MAX_DAYS, (interval * ease + 50) // 100)
    return next_ease, interval, repetitions, "mastered" if interval >= MASTERED_DAYS else "reviewing"


def replay_sm2(ratings: DataFrame, bucket: Column | None = None, start: DataFrame | None = None) -> DataFrame:
    """Card state per (user_id, vocab_id) after all its valid ratings in order of (ts, event_id).

    A null learner is a learner of its own, and ratings without a time come first.  Without ``start``
    every rated card begins as a new one.  With it (user_id, vocab_id, ease_factor, interval,
    repetitions, status, next_review_date; one row per card) the cards are those of ``start``, each
    going on from its state; ratings of other cards have no effect.

    Needs no pass over a card's whole history in one task.  With S the running sum of ease
    changes, the ease is S + max(start, floor - min S): sums and minima, taken per time bucket
    and then over the buckets.  Repetitions count the passes after the last fail, and the
    interval follows from the first few of those.
    """
    card = ["user_id", "vocab_id"]
    bucket = F.date_trunc("day", "ts") if bucket is None else bucket
    good, _ = valid_ratings(ratings)
    stored, begun = None, []
    if start is not None:
        hundredths = F.round(F.coalesce("ease_factor", F.lit(START_EASE / 100)) * 100).cast("long")
        stored = start.select(
            *card, hundredths.alias("e0"), F.coalesce(F.col("interval").cast("long"), F.lit(0)).alias("i0"),
            F.coalesce(F.col("repetitions").cast("long"), F.lit(0)).alias("r0"), "status", "next_review_date")
        # a card with an interval of one day and two passes or more stays at one while its ease is low
        good = join_same(good, stored.select(*card, "e0", ((F.col("i0") == 1) & (F.col("r0") >= 2)).alias("slow")), card)
        begun = ["e0", "slow"]
    e0, slow = (F.col("e0"), F.col("slow")) if begun else (F.lit(START_EASE), F.lit(False))
    step = F.coalesce(*[F.when(F.col("grade") == g, F.lit(d)) for g, d in EASE_STEP.items()]).cast("long")
    rows = good.select(*card, *begun, "ts", "event_id", "grade", step.alias("d"), bucket.alias("bucket"),
                       (F.col("grade") < PASS_GRADE).alias("fail"))
    inside = Window.partitionBy(*card, "bucket").orderBy("ts", "event_id")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    future = inside.rowsBetween(1, Window.unboundedFollowing)
    rows = (
        rows.withColumn("s", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"low": F.min("s").over(past), "fail_later": F.max("fail").over(future)})
    )
    rows = cut_lineage(rows)  # narrow, and read by three passes
    buckets = rows.groupBy(*card, "bucket").agg(
        F.sum("d").alias("bs"), F.min("s").alias("bm"), F.max("fail").alias("bf"),
        F.count(F.lit(1)).alias("bn"), F.max("ts").alias("bt"))
    over = Window.partitionBy(*card).orderBy("bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    after = over.rowsBetween(1, Window.unboundedFollowing)
    carried = (
        buckets.withColumn("sb", F.coalesce(F.sum("bs").over(before), F.lit(0)))
        .withColumns({"mb": F.min(F.col("sb") + F.col("bm")).over(before), "later": F.max("bf").over(after),
                      "failed": F.max("bf").over(Window.partitionBy(*card))})
    )
    whole = carried.groupBy(*card).agg(
        F.sum("bs").alias("total"), F.min(F.col("sb") + F.col("bm")).alias("lowest"),
        F.sum("bn").alias("ratings"), F.max("bt").alias("last_rated"), F.max("bf").alias("failed"))

    def ease_at(total: Column, lowest: Column, first: Column) -> Column:
        return total + F.greatest(first, F.lit(EASE_FLOOR) - lowest)

    no = F.lit(False)
    tail = (
        join_same(rows, carried.select(*card, "bucket", "sb", "mb", "later", "failed"), [*card, "bucket"])
        .filter(~F.col("fail") & ~F.coalesce("fail_later", no) & ~F.coalesce("later", no))
        .select(*card, "ts", "event_id", (slow & ~F.col("failed")).alias("slow"),
                ease_at(F.col("sb") + F.col("s") - F.col("d"), F.least("mb", F.col("sb") + F.col("low")), e0).alias("ease_before"))
    )
    passes = tail.groupBy(*card).agg(F.count(F.lit(1)).alias("passes"))
    if begun:
        leaves = tail.filter(F.col("slow") & (F.col("ease_before") >= LEAVES_ONE)).groupBy(*card).agg(
            F.min(F.struct("ts", "event_id")).alias("_moves"))
        tail = join_same(tail, leaves, card, "left").filter(
            ~F.col("slow") | F.coalesce(F.struct("ts", "event_id") >= F.col("_moves"), no))
    heads = top_k(tail, card, [F.col("ts"), F.col("event_id")], TAIL).groupBy(*card).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "ease_before"))).alias("head"))
    state = join_same(join_same(whole, passes, card, "left"), heads, card, "left")
    zero = F.lit(0).cast("long")
    if stored is None:
        state = state.withColumns({"e0": F.lit(START_EASE).cast("long"), "i0": zero, "r0": zero})
    else:
        state = join_same(stored.withColumnsRenamed({"status": "was", "next_review_date": "due"}), state, card, "left")
    anew = F.coalesce("failed", no)
    state = state.withColumns({
        "i0": F.when(anew, zero).otherwise(F.col("i0")), "r0": F.when(anew, zero).otherwise(F.col("r0")),
        "passes": F.coalesce("passes", zero), "ratings": F.coalesce("ratings", zero)}).withColumn("repetitions", F.col("r0") + F.col("passes"))
    # passes that set a fixed interval, then those that multiply
    fixed = F.greatest(zero, 2 - F.col("r0")).cast("int")
    grown = F.aggregate(
        F.slice("head", fixed + 1, F.lit(TAIL)), F.when(F.col("r0") >= 2, F.col("i0")).otherwise(F.lit(SECOND_INTERVAL)).cast("long"),
        lambda acc, x: F.least(F.lit(MAX_DAYS).cast("long"), F.floor((acc * x["ease_before"] + 50) / 100)))
    interval = F.when(F.col("head").isNull(), F.col("i0")).when(F.col("repetitions") == 1, F.lit(FIRST_INTERVAL)).otherwise(grown)
    state = state.withColumn("interval", interval.cast("long"))
    status = (
        F.when(F.col("passes") == 0, "learning").when(F.col("interval") >= MASTERED_DAYS, "mastered")
        .otherwise("reviewing")
    )
    following = add_days("last_rated", F.col("interval"))
    ease = ease_at(F.col("total"), F.col("lowest"), F.col("e0"))
    if stored is not None:  # a card that nobody rated stays as it is
        rated = F.col("ratings") > 0
        status, following = F.when(rated, status).otherwise(F.col("was")), F.when(rated, following).otherwise(F.col("due"))
        ease = F.when(rated, ease).otherwise(F.col("e0"))
    return state.select(
        *card, (ease / 100).alias("ease_factor"), "interval", F.col("repetitions").cast("long").alias("repetitions"),
        status.alias("status"), following.alias("next_review_date"), "ratings",
    )


def rate_cards(progress: DataFrame, ratings: DataFrame, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ratings to the stored progress, one row per (user_id, vocab_id), as if one by one in order of time.

    Returns (progress, rejects).  Every card of ``progress`` is there with its next state and the number of
    ratings it took; a rating is rejected with ``invalid_rating``, or with ``progress_not_found`` where its
    card has no progress row.
    """
    good, bad = valid_ratings(ratings)
    cards = progress.select("user_id", "vocab_id")
    unknown = join_same(good, cards, ["user_id", "vocab_id"], "left_anti").withColumn("reason", F.lit("progress_not_found"))
    return replay_sm2(ratings, bucket, progress), bad.withColumn("reason", F.lit("invalid_rating")).unionByName(unknown)


def ensure_progress(vocab: DataFrame, progress: DataFrame, now: str) -> DataFrame:
    """Progress with a start row for every word that has none (one learner's tables)."""
    fresh = vocab.select(F.col("id").alias("vocab_id")).join(progress.select("vocab_id"), "vocab_id", "left_anti")
    start = {
        "ease_factor": F.lit(START_EASE / 100), "interval": F.lit(0), "repetitions": F.lit(0),
        "status": F.lit("learning"), "next_review_date": F.lit(now).cast("timestamp"),
    }
    rows = fresh.select(*[
        (start[c] if c in start else F.col(c) if c in fresh.columns else F.lit(None))
        .cast(progress.schema[c].dataType).alias(c) for c in progress.columns])
    return progress.unionByName(rows)


def due(progress: DataFrame, now: str) -> DataFrame:
    return progress.filter((F.col("next_review_date") <= F.lit(now).cast("timestamp")) | (F.col("repetitions") == 0))


def due_queue(
    progress: DataFrame, vocab: DataFrame, now: str, lesson: int | None = None, k: int = SESSION_CARDS
) -> DataFrame:
    """The next ``k`` cards of each learner: fewest repetitions first, then the longest overdue.

    Without a lesson the limit is applied before the words are joined.
    """
    cards = due(progress, now)
    words = vocab.withColumnRenamed("id", "vocab_id")
    order = [F.col("repetitions"), F.col("next_review_date"), F.col("vocab_id")]
    if lesson is None:
        return top_k(cards.join(words.select("vocab_id"), "vocab_id", "left_semi"), ["user_id"], order, k).join(words, "vocab_id")
    return top_k(cards.join(words.filter(F.col("lesson") == lesson), "vocab_id"), ["user_id"], order, k)


def override_status(progress: DataFrame, requests: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Set statuses by hand; requests (position, user_id, vocab_id, status).

    Mastered sets 21 days and 3 repetitions, the others start over.  The last valid request of
    a card wins.  Returns (progress, rejects with a reason).
    """
    card = ["user_id", "vocab_id"]
    sound = F.col("vocab_id").isNotNull() & F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    wanted = requests.filter(sound).groupBy(*card).agg(F.max_by("status", "position").alias("_status"))
    at = F.lit(now).cast("timestamp")
    asked, mastered = F.col("_status").isNotNull(), F.col("_status") == "mastered"
    days, reps = F.when(mastered, OVERRIDE_DAYS).otherwise(0), F.when(mastered, OVERRIDE_REPETITIONS).otherwise(0)
    out = progress.join(wanted, card, "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "interval": F.when(asked, days).otherwise(F.col("interval")),
        "repetitions": F.when(asked, reps).otherwise(F.col("repetitions")),
        "next_review_date": F.when(asked, add_days(at, days)).otherwise(F.col("next_review_date")),
    }).select(*progress.columns)
    invalid = requests.filter(~sound).withColumn("reason", F.lit("invalid_request"))
    absent = requests.filter(sound).join(progress.select(*card), card, "left_anti").withColumn(
        "reason", F.lit("progress_not_found"))
    return out, invalid.unionByName(absent.select(*invalid.columns))


def study_log(ratings: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Words reviewed, quizzes completed and mean accuracy per learner and UTC day."""
    good, _ = valid_ratings(ratings)
    events = good.select("user_id", day("ts").alias("day"), F.lit(None).cast("double").alias("accuracy")).unionByName(
        quizzes.select("user_id", day("ts").alias("day"), F.col("accuracy").cast("double").alias("accuracy")))
    return events.groupBy("user_id", "day").agg(
        F.count_if(F.col("accuracy").isNull()).alias("words_reviewed"), F.count("accuracy").alias("quizzes_completed"),
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("accuracy_score"))


def streaks(log: DataFrame, today: str) -> DataFrame:
    """Consecutive study days per learner, ending today or, without study today, yesterday.

    Works on distinct days, so a learner's window holds at most the days of the calendar.
    """
    now = F.lit(today).cast("date")
    days = log.select("user_id", "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.filter(F.col("day") <= now).withColumn("island", island).groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    current = runs.filter(F.col("last") >= F.date_sub(now, 1)).select("user_id", F.col("n").alias("streak"))
    learners = log.select("user_id").distinct()
    return learners.join(current, "user_id", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def level_counts(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("jlpt_level").agg(F.count(F.lit(1)).alias("words"))


def status_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count(F.lit(1)).alias("cards"))


def learner_dashboard(vocab: DataFrame, progress: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """One row per learner: vocabulary totals, card counts, streak and today's study."""
    today = F.lit(now).cast("timestamp").cast("date")
    cards = progress.groupBy("user_id").agg(
        F.count_if(F.col("next_review_date") <= F.lit(now).cast("timestamp")).alias("due_cards"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    todays = log.filter(F.col("day") == today).select("user_id", "words_reviewed", "quizzes_completed", "accuracy_score")
    totals = vocab.agg(*[F.count_if(F.col("jlpt_level") == lv).alias(lv) for lv in LEVELS])
    learners = cards.join(streaks(log, now[:10]), "user_id", "full_outer").join(todays, "user_id", "left")
    n4, n5 = totals.select("N4").scalar(), totals.select("N5").scalar()
    zero = lambda c, z=0: F.coalesce(F.col(c), F.lit(z)).alias(c)
    named = learners.select(
        "user_id", n5.alias("n5"), n4.alias("n4"), *[zero(c) for c in ("due_cards", *STATUSES, "streak")],
        F.coalesce("words_reviewed", F.lit(0)).alias("today_words"),
        F.coalesce("quizzes_completed", F.lit(0)).alias("today_quizzes"),
        F.coalesce("accuracy_score", F.lit(0.0)).alias("today_accuracy"))
    total = F.col("n4") + F.col("n5")
    return named.withColumns({
        "total_vocab": total, "mastered_percent": percent(F.col("mastered"), total),
        "n5_percent": percent(F.col("n5"), total), "n4_percent": percent(F.col("n4"), total),
    })


# Percent bands of a quiz result.
GOOD_PERCENT, FAIR_PERCENT = 80, 50


def score_quizzes(answers: DataFrame) -> DataFrame:
    """Score, accuracy and band per (user_id, quiz_id); an answer without verdict counts as wrong."""
    scored = answers.groupBy("user_id", "quiz_id").agg(
        F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)).alias("score"), F.count(F.lit(1)).alias("total"))
    pct = percent(F.col("score"), F.col("total"))
    return scored.withColumns({
        "accuracy": F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.lit(0.0)), "percent": pct,
        "band": F.when(pct >= GOOD_PERCENT, "good").when(pct >= FAIR_PERCENT, "fair").otherwise("again"),
    })
