"""Match reviews: the queue and its decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.identity import with_identity
from ..session import cut_lineage
from .folds import fold_sorted
from .words import Scripts, checked_words, json_fields


def review_queue(reviews: DataFrame, vocab: DataFrame, k: int = 200) -> DataFrame:
    """Newest ``k`` pending reviews with their candidate row; the limit comes before the join."""
    newest = reviews.filter("status = 'pending'").orderBy(F.col("created_at").desc(), "review_key").limit(k)
    candidate = vocab.select(F.col("id").alias("candidate_id"), F.struct(*vocab.columns).alias("candidate"))
    return newest.join(candidate, "candidate_id", "left")


#: Decisions of a run that is folded at a time.
RUN = 131_072
_FOLDED = pa.schema([("position", pa.int64()), ("review_key", pa.string()), ("row", pa.string()), ("key", pa.string()), ("outcome", pa.string())])


def _fold_run(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Outcomes of one run's decisions in order, then the key of every row that got one.

    Rows (run, position, review_key, row, key, fails, closed): first, without a position, who holds a key before the run; then
    decisions, of which ``fails`` is ``accepted`` where that is known, and ``closed`` says that the review is settled.
    """
    holder, key_of, changed, settled = {}, {}, {}, set()
    for _, position, review, row, key, fails, closed in rows:
        if position is None:
            holder[key], key_of[row] = row, key
            continue
        if fails != "accepted" and (closed or review in settled):
            outcome = "already_decided"
        elif fails is None:
            outcome = "accepted" if holder.get(key, row) == row else "duplicate_identity"
        else:
            outcome = fails
        if outcome == "accepted":
            if key_of.get(row, key) != key:
                del holder[key_of[row]]
            holder[key], key_of[row], changed[row] = row, key, key
        if outcome in ("accepted", "rejected"):
            settled.add(review)
        if fails != "accepted":
            yield position, review, None, None, outcome
    for row, key in changed.items():
        yield None, None, row, key, None


def _settle_in_runs(open_: DataFrame, won: DataFrame, holders: DataFrame) -> DataFrame:
    """position, outcome of the decisions in ``open_``, run by run in order of position.

    ``won`` (position, row, key): accepts that are known; those after the first open decision are replayed among the open
    ones.  A run is folded with the keys that its rows and keys have to do with; who holds which key, and which reviews
    are settled, is carried in tables.
    """
    row = F.col("row").cast("string").alias("row")
    n, start = open_.agg(F.count(F.lit(1)), F.min("position")).first()
    last = won.filter(F.col("position") < start).groupBy("row").agg(F.max_by("key", "position").alias("key"))
    held = cut_lineage(holders.select("row", "key").join(last, "row", "left_anti").unionByName(last).select(row, "key"))
    replayed = won.filter(F.col("position") >= start)
    none = F.lit(None).cast("string")
    events = open_.select("position", "review_key", row, "key", "fails").unionByName(
        replayed.select("position", none.alias("review_key"), row, "key", F.lit("accepted").alias("fails")))
    runs = -(-(n + replayed.count()) // RUN)
    ends = events.agg(F.percentile_approx("position", [i / runs for i in range(1, runs)], 16 * runs)).first()[0] if runs > 1 else []
    events = cut_lineage(events)
    done = closed = None
    for after, upto in zip([None, *ends], [*ends, None]):
        run = events
        if after is not None:
            run = run.filter(F.col("position") > after)
        if upto is not None:
            run = run.filter(F.col("position") <= upto)
        marked = run.withColumn("closed", F.lit(False)) if closed is None else run.join(
            closed.withColumn("closed", F.lit(True)), "review_key", "left")
        near = held.join(run.select("row").distinct(), "row", "left_semi").unionByName(
            held.join(run.select("key").distinct(), "key", "left_semi").select("row", "key")).distinct()
        given = near.select(F.lit(None).cast("long").alias("position"), none.alias("review_key"), "row", "key", none.alias("fails"), F.lit(False).alias("closed"))
        columns = [F.lit(0).cast("long").alias("run"), *given.columns]
        both = given.select(*columns).unionByName(marked.select(*columns))
        folded = cut_lineage(fold_sorted(both, ["run"], [F.col("position").asc_nulls_first()], _fold_run, _FOLDED))
        changed = folded.filter("position is null").select("row", "key")
        held = cut_lineage(held.join(changed, "row", "left_anti").unionByName(changed))
        decided = folded.filter("position is not null")
        settled = decided.filter(F.col("outcome").isin("accepted", "rejected")).select("review_key")
        closed = settled if closed is None else closed.unionByName(settled)
        done = decided if done is None else done.unionByName(decided)
    return done.select("position", "outcome")


def _settle_decisions(asked: DataFrame, holders: DataFrame) -> DataFrame:
    """position, outcome of decisions on pending reviews, as if made one by one.

    ``asked``: position, review_key, row (the candidate), key, fails (the outcome if nothing else forbids it: null for an
    accept that can succeed, ``rejected`` for a reject, else why an accept must fail).  ``holders``: key, row, one
    row per stored key.

    An accept gives its key to its row and frees the key that the row had; it fails while another row holds the key.  Rounds decide
    what is known: with x the row that last got a key, the key is held until x's first accepted or
    undecided accept of another key.  Accepts by other rows before that fail, all at once; if x let go of the key then,
    the first accept after it succeeds, and so do those of x itself while it holds the key.  A review's decisions go in
    order: fails up to the first that takes effect, and nothing after it.  Rounds go on as long as one decides half of what is
    open.  What is left are chains of keys that change hands, in which each decision waits for the one before; they are
    settled in runs by position, so the number of jobs follows the number of decisions over ``RUN``, not the longest chain.
    """
    open_ = cut_lineage(asked.withColumn("held", F.col("fails").isNotNull() & (F.col("fails") != "rejected")))
    won = decided = None
    never = F.lit((1 << 63) - 1)
    left_over = open_.count()
    while True:
        tries = open_.filter("fails is null and not held")
        # the row that last got each key, when, and when it got another one
        first = tries.select("key").distinct().join(holders, "key").select("key", F.col("row").alias("x"), F.lit(-(1 << 62)).alias("since"))
        if won is None:
            last = first.withColumn("left_at", F.lit(None).cast("long"))
        else:
            then = F.lead("position").over(Window.partitionBy("row").orderBy("position"))
            got = won.withColumn("next", then).groupBy("key").agg(
                F.max("position").alias("since"), F.max_by("row", "position").alias("x"), F.max_by("next", "position").alias("left_at"))
            begun = won.groupBy(F.col("row").alias("x")).agg(F.min("position").alias("left_at"))
            stored = first.join(got.select("key"), "key", "left_anti").join(begun, "x", "left")
            last = stored.select("key", "x", "since", "left_at").unionByName(got.select("key", "x", "since", "left_at"))
        # first undecided accept of each row, and its first one of another key than that
        per_key = tries.groupBy("row", "key").agg(F.min("position").alias("at"))
        rank = F.row_number().over(Window.partitionBy("row").orderBy("at"))
        two = per_key.withColumn("r", rank).filter("r <= 2").groupBy(F.col("row").alias("x")).agg(
            F.max(F.when(F.col("r") == 1, F.col("key"))).alias("key1"), F.max(F.when(F.col("r") == 1, F.col("at"))).alias("at1"),
            F.max(F.when(F.col("r") == 2, F.col("at"))).alias("at2"))
        unsure = F.coalesce(F.when(F.col("key1") == F.col("key"), F.col("at2")).otherwise(F.col("at1")), never)
        left = F.coalesce("left_at", never)
        state = last.join(two, "x", "left").select(
            "key", "x", F.least(left, unsure).alias("until"), (left < unsure).alias("freed"))
        known = open_.join(state, "key", "left")
        has, own, within = F.col("x").isNotNull(), F.col("x") == F.col("row"), F.col("position") <= F.col("until")
        accept = F.col("fails").isNull()
        known = known.withColumn("held", F.col("held") | (accept & F.coalesce(has & ~own & within, F.lit(False))))
        waiting = known.filter(accept & ~F.col("held")).groupBy("key").agg(F.min("position").alias("head"))
        known = known.join(waiting, "key", "left")
        free = F.coalesce(own & within, F.lit(False)) | (
            (F.col("position") == F.col("head")) & (~has | F.coalesce(F.col("freed") & ~within, F.lit(False))))
        known = known.withColumn("acts", (F.col("fails") == "rejected") | (accept & ~F.col("held") & free))
        # what a review's first decision that does not fail is
        turn = known.filter(~F.col("held")).groupBy("review_key").agg(
            F.min("position").alias("turn"), F.min_by("acts", "position").alias("settles"))
        at, turn_at, settles = F.col("position"), F.coalesce("turn", never), F.coalesce("settles", F.lit(False))
        outcome = (
            F.when(at < turn_at, F.coalesce(F.col("fails"), F.lit("duplicate_identity")))
            .when((at == turn_at) & settles, F.coalesce(F.col("fails"), F.lit("accepted")))
            .when((at > turn_at) & settles, F.lit("already_decided"))
        )
        judged = cut_lineage(known.join(turn, "review_key", "left").select(
            "position", "review_key", "row", "key", "fails", "held", outcome.alias("outcome")))
        done = judged.filter("outcome is not null")
        decided = done.select("position", "outcome") if decided is None else decided.unionByName(done.select("position", "outcome"))
        taken = done.filter("outcome = 'accepted'").select("position", "row", "key")
        won = taken if won is None else won.unionByName(taken)
        open_ = judged.filter("outcome is null").drop("outcome")
        before, left_over = left_over, open_.count()
        if not left_over:
            return decided
        if left_over * 2 > before:
            return decided.unionByName(_settle_in_runs(open_, won, holders))


def apply_review_decisions(
    reviews: DataFrame, decisions: DataFrame, vocab: DataFrame, scripts: Scripts = Scripts()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply decisions (position, review_key, action) as if one by one in order of their (unique) positions.

    Returns (reviews, vocabulary, outcomes).  A decision on a pending review settles it if it has an effect: a reject, or an
    accept that has its candidate, a valid record and a key that no other row holds at that moment.  An accept frees
    the key that its candidate had, so a later one can take it, and an accept that failed can be tried again.
    """
    known = decisions.join(reviews.select("review_key", "status", "candidate_id", "incoming_json"), "review_key", "left")
    keyed = with_identity(
        checked_words(json_fields(known, "incoming_json"), "N5", None, scripts).withColumnRenamed("status", "was"))
    rows = vocab.select(F.col("id").alias("candidate_id"), F.lit(True).alias("exists"))
    checked = keyed.join(rows, "candidate_id", "left").withColumns({
        "outcome": F.when(~F.coalesce(F.col("action").isin("accept", "reject"), F.lit(False)), "bad_request")
        .when(F.col("was").isNull(), "not_found").when(F.col("was") != "pending", "already_decided"),
        "fails": F.when(F.col("action") == "reject", "rejected").when(F.col("exists").isNull(), "candidate_missing")
        .when(~F.col("valid"), "payload_invalid"),
    })
    asked = checked.filter("outcome is null").select(
        F.col("position").cast("long").alias("position"), "review_key", F.col("candidate_id").alias("row"), F.col("identity_key").alias("key"), "fails")
    holders = vocab.filter(F.col("canonical_key").isNotNull()).groupBy(F.col("canonical_key").alias("key")).agg(F.min("id").alias("row"))
    settled = _settle_decisions(asked, holders).withColumnRenamed("outcome", "_settled")
    final = checked.join(settled, "position", "left").withColumn("outcome", F.coalesce("outcome", "_settled"))
    done = final.filter(F.col("outcome").isin("rejected", "accepted")).select(
        "review_key", F.col("outcome").alias("_status"))
    reviews_out = reviews.join(done, "review_key", "left").withColumn(
        "status", F.coalesce("_status", "status")).select(*reviews.columns)

    accepted = final.filter("outcome = 'accepted'")
    fill = ("romaji", "part_of_speech", "example_sentence_jp", "example_sentence_mm", "lesson")
    changes = accepted.groupBy(F.col("candidate_id").alias("id")).agg(
        F.max_by("identity_key", "position").alias("_key"), F.max_by("reading_key", "position").alias("_kana"),
        F.max_by("kanji", F.when(F.col("kanji").isNotNull(), F.col("position"))).alias("_kanji"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(f"_{c}") for c in fill],
    )
    vocab_out = vocab.join(changes, "id", "left").withColumns({
        "canonical_key": F.coalesce("_key", "canonical_key"), "kana": F.coalesce("_kana", "kana"),
        "kanji": F.coalesce("_kanji", "kanji"), **{c: F.coalesce(c, f"_{c}") for c in fill},
    }).select(*vocab.columns)
    outcomes = final.select("position", "review_key", "action", "outcome")
    return reviews_out, vocab_out, outcomes
