"""Ratings, study log, corrections and ingest as streams.

State processors use the step functions of the batch jobs.  ``stream_sm2`` and ``stream_corrections``
sort the ratings or corrections of one micro-batch and apply those of later batches as they arrive.
``stream_rate_cards`` and ``stream_ordered_corrections`` start from stored tables and apply events in order of
their time: an event waits in the state store until the watermark has passed it.

A call of the state store costs about as much as a hundred rows, so cards are not keys of their own: the key is one of
``CARD_BUCKETS`` hashes, whose cards are packed into one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.temporal import add_days
from ..functions.text import js_trim
from ..operators.ingest import IngestResult, ingest
from ..operators.matching import incoming_keys
from ..operators.learning import START_EASE, sm2_step, valid_ratings
from ..operators.pages import step
from ..session import cut_lineage
from .snapshots import Snapshots


def use_rocksdb(spark) -> None:
    """State store needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups that cards are dealt into by a hash; a task holds the cards and new ratings of one of them at a time.
CARD_BUCKETS = 512
#: Waiting ratings of a bucket are packed by day.
SLOT_MS = 86_400_000
WAITING_CHUNK = 100_000

_CARD = np.dtype([("nobody", "i1"), ("user", "i8"), ("vocab", "i8"), ("ease", "i4"), ("interval", "i8"), ("repetitions", "i8"), ("ratings", "i8")])
_RATING = np.dtype([("nobody", "i1"), ("user", "i8"), ("vocab", "i8"), ("micros", "i8"), ("at", "i8"), ("grade", "i8")])


def _bucket(df: DataFrame) -> DataFrame:
    """Cards by their longs and bucket; ``nobody`` marks the null learner."""
    user, card = F.col("user_id").cast("long"), F.col("vocab_id").cast("long")
    return df.withColumns({
        "bucket": F.pmod(F.xxhash64(user, card), F.lit(CARD_BUCKETS)), "nobody": user.isNull().cast("int"),
        "user": F.coalesce(user, F.lit(0).cast("long")), "vocab": card})


def _unpack(packed: tuple | None) -> dict[tuple, tuple]:
    """(nobody, user, vocab) -> (ease, interval, repetitions, ratings)."""
    return {c[:3]: c[3:] for c in np.frombuffer(packed[0], _CARD).tolist()} if packed else {}


def _pack(cards: dict[tuple, tuple]) -> tuple[bytes]:
    return (np.array([(*k, *c) for k, c in cards.items()], _CARD).tobytes(),)


class _Cards(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cards = handle.getValueState("cards", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        cards = _unpack(self.cards.get())
        # a rating without a time comes first
        given = sorted(((r.nobody, r.user, r.vocab), r.micros is not None, r.micros or 0, r.event_id is not None, r.event_id, r.grade) for r in rows)
        for card, ratings in groupby(given, lambda r: r[0]):
            ease, interval, repetitions, count = cards.get(card, (START_EASE, 0, 0, 0))
            for _, timed, micros, _, _, grade in ratings:
                ease, interval, repetitions, status = sm2_step(grade, ease, interval, repetitions)
                count += 1
            cards[card] = ease, interval, repetitions, count
            yield Row(
                user_id=None if card[0] else card[1], vocab_id=card[2], ease_factor=ease / 100, interval=interval, repetitions=repetitions,
                status=status, rated_micros=micros if timed else None, ratings=count)
        self.cards.update(_pack(cards))

    def close(self) -> None:
        pass


CARD_SCHEMA = (
    "user_id long, vocab_id long, ease_factor double, interval long, repetitions int, status string, "
    "rated_micros long, ratings long"
)


def stream_sm2(ratings: DataFrame) -> DataFrame:
    """State of each rated card after every micro-batch (update mode)."""
    good, _ = valid_ratings(ratings)
    asked = _bucket(good).select("bucket", "nobody", "user", "vocab", F.unix_micros("ts").alias("micros"), "event_id", "grade")
    states = asked.groupBy("bucket").transformWithState(
        statefulProcessor=_Cards(), outputStructType=CARD_SCHEMA, outputMode="Update", timeMode="None")
    rated = states.withColumn("rated_at", F.timestamp_micros("rated_micros"))
    return rated.select(
        "user_id", "vocab_id", "ease_factor", "interval", "repetitions", "status", "rated_at", "ratings",
        add_days("rated_at", F.col("interval")).alias("next_review_date"))


def stream_study_log(ratings: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Words reviewed per learner and UTC day; ratings later than the watermark are dropped."""
    good, _ = valid_ratings(ratings)
    return (
        good.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "user_id")
        .agg(F.count(F.lit(1)).alias("words_reviewed"))
        .select("user_id", F.to_date("window.start").alias("day"), "words_reviewed")
    )


class _Revisions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "revision long")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        state = self.page.get()
        revision = state[0] if state else 0
        for r in sorted(rows, key=lambda r: r.position):
            if r.base_revision is None or r.base_revision < 0 or not r.sound:
                yield Row(page_id=key[0], position=r.position, outcome="invalid", revision=None)
                continue
            accepted, revision = step(revision, r.base_revision)
            outcome = "accepted" if accepted else "stale"
            yield Row(page_id=key[0], position=r.position, outcome=outcome, revision=revision)
        self.page.update((revision,))

    def close(self) -> None:
        pass


def stream_corrections(submissions: DataFrame) -> DataFrame:
    """Outcome and page revision of every submission, pages starting at revision 0."""
    sound = js_trim(F.coalesce("corrected_text", F.lit(""))) != ""
    judged = submissions.select("page_id", "position", "base_revision", sound.alias("sound"))
    return judged.groupBy("page_id").transformWithState(
        statefulProcessor=_Revisions(), outputStructType="page_id long, position long, outcome string, revision long",
        outputMode="Append", timeMode="None")


class _InTimeOrder(StatefulProcessor):
    """Applies the events of a key in order of (micros, at), each when the watermark has passed its grain of time.

    Events wait in the state store by the end of their grain, where a timer is set; timers fire in order of time.  Python
    holds the events of one key and one grain, however many wait.  ``fields`` are the event's columns, longs.
    Subclasses say what an initial row becomes and what events do.
    """

    STATE, fields = "", ("micros", "at")

    def __init__(self, grain_ms: int):
        self.grain = grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getMapState("waiting", "due long", ", ".join(f"{f} array<long>" for f in self.fields))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update(self.begin(initialState))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        while chunk := list(islice(rows, 1000)):
            by_due: dict[int, list[tuple]] = {}
            for r in chunk:
                due = (r.micros // 1000 // self.grain + 1) * self.grain
                by_due.setdefault(due, []).append(tuple(getattr(r, f) for f in self.fields))
            for due, events in by_due.items():
                columns = [list(c) for c in zip(*events)]
                held = self.waiting.getValue((due,)) if self.waiting.containsKey((due,)) else None
                if held is None:
                    self.handle.registerTimer(due)
                else:
                    columns = [[*old, *new] for old, new in zip(held, columns)]
                self.waiting.updateValue((due,), tuple(columns))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted(zip(*self.waiting.getValue((due,))))
        self.waiting.removeKey((due,))
        yield from self.apply(key, self.state.get(), events)

    def close(self) -> None:
        pass


class _StoredCards(StatefulProcessor):
    """Applies the ratings of a bucket's cards in order of (micros, at), each when the watermark has passed its grain of time.

    Ratings wait in the state store, packed by day; a timer is set for the first grain of a day that ends.  When it fires, all
    grains that have ended are applied day by day, and each card they touch gives one row.
    """

    def __init__(self, grain_ms: int):
        self.grain = grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getValueState("cards", "packed binary")
        self.waiting = handle.getMapState("waiting", "slot long", "packed binary")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.cards.update(_pack({tuple(c[:3]): (*c[3:], 0) for c in initialState.cards}))

    def _due(self, micros):
        return (micros // 1000 // self.grain + 1) * self.grain

    def _hold(self, slot: int, ratings: np.ndarray) -> None:
        held = self.waiting.getValue((slot,))
        first = int(self._due(ratings["micros"].min()))
        if held is None:
            self.handle.registerTimer(first)
            self.waiting.updateValue((slot,), (ratings.tobytes(),))
        else:
            if first < self._due(np.frombuffer(held[0], _RATING)["micros"].min()):
                self.handle.registerTimer(first)
            self.waiting.updateValue((slot,), (bytes(held[0]) + ratings.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        while chunk := list(islice(rows, WAITING_CHUNK)):
            ratings = np.array([(r.nobody, r.user, r.vocab, r.micros, r.at, r.grade) for r in chunk], _RATING)
            slots = ratings["micros"] // (SLOT_MS * 1000)
            for slot in np.unique(slots).tolist():
                self._hold(slot, ratings[slots == slot])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        slots = sorted(s for (s,) in self.waiting.keys() if s * SLOT_MS <= now)
        if not slots:  # an earlier timer has seen to them
            return
        cards, touched, refused = _unpack(self.cards.get()), {}, {}
        for slot in slots:
            held = np.frombuffer(self.waiting.getValue((slot,))[0], _RATING)
            ended = self._due(held["micros"]) <= now
            if not ended.any():
                continue
            self.waiting.removeKey((slot,))
            if not ended.all():
                self._hold(slot, held[~ended])
            ready = held[ended]
            for nobody, user, vocab, micros, _, grade in ready[np.lexsort((ready["grade"], ready["at"], ready["micros"]))].tolist():
                card = nobody, user, vocab
                if card not in cards:
                    refused[card] = refused.get(card, (0,))[0] + 1, micros
                    continue
                ease, interval, repetitions, count = cards[card]
                ease, interval, repetitions, status = sm2_step(grade, ease, interval, repetitions)
                cards[card] = ease, interval, repetitions, count + 1
                touched[card] = status, micros
        if touched:
            self.cards.update(_pack(cards))
        for card, (status, micros) in touched.items():
            ease, interval, repetitions, count = cards[card]
            yield Row(user_id=None if card[0] else card[1], vocab_id=card[2], ease_factor=ease / 100, interval=interval,
                      repetitions=repetitions, status=status, rated_micros=micros, ratings=count, refused=0)
        for card, (count, micros) in refused.items():
            yield Row(user_id=None if card[0] else card[1], vocab_id=card[2], ease_factor=None, interval=None,
                      repetitions=None, status=None, rated_micros=micros, ratings=None, refused=count)

    def close(self) -> None:
        pass


class _StoredPages(_InTimeOrder):
    STATE = "revision long"
    fields = ("micros", "at", "base_revision")

    def begin(self, row: Row) -> tuple:
        return (row.revision,)

    def apply(self, key, state, events) -> Iterator[Row]:
        revision = state[0] if state else None
        for _, at, base in events:
            if base < 0:  # stands for an unsound submission
                outcome, after = "invalid", None
            elif revision is None:
                outcome, after = "page_not_found", None
            else:
                accepted, revision = step(revision, base)
                outcome, after = "accepted" if accepted else "stale", revision
            yield Row(page_id=key[0], position=at, outcome=outcome, revision=after)
        if revision is not None:
            self.state.update((revision,))


def stream_rate_cards(ratings: DataFrame, progress: DataFrame, watermark: str = "1 day", grain: int = 60_000) -> DataFrame:
    """Stored cards after the ratings that the watermark has passed, in order of (ts, event_id), by whole ``grain`` milliseconds.

    ``progress``: user_id, vocab_id, ease_factor, interval, repetitions, one row per card; the stream starts from it and a
    rating of another card only counts as ``refused``.  Ratings come in any order within the watermark, in whatever
    micro-batches; later ones, and those without a time, are dropped.  A card's newest state is the row with most ``ratings``.
    Invalid ratings are left out (``learning.valid_ratings`` has them).
    """
    timed = ratings.withWatermark("ts", watermark)
    good, _ = valid_ratings(timed)
    asked = _bucket(good.filter("ts is not null")).select(
        "bucket", "nobody", "user", "vocab", "ts", F.unix_micros("ts").alias("micros"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.col("grade").cast("long").alias("grade"))
    stored = _bucket(progress.filter("vocab_id is not null")).groupBy("bucket").agg(F.collect_list(F.array(*[F.col(c).cast("long") for c in (
        "nobody", "user", "vocab")], F.round(F.coalesce("ease_factor", F.lit(START_EASE / 100)) * 100).cast("long"),
        F.coalesce(F.col("interval").cast("long"), F.lit(0)), F.coalesce(F.col("repetitions").cast("long"), F.lit(0)))).alias("cards"))
    states = asked.groupBy("bucket").transformWithState(
        statefulProcessor=_StoredCards(grain), outputMode="Update", timeMode="EventTime", initialState=stored.groupBy("bucket"),
        outputStructType="user_id long, vocab_id long, ease_factor double, interval long, repetitions int, status string, rated_micros long, ratings long, refused long")
    rated = F.timestamp_micros("rated_micros")
    return states.withColumn("next_review_date", add_days(rated, F.col("interval"))).drop("rated_micros")


def stream_ordered_corrections(submissions: DataFrame, pages: DataFrame, watermark: str = "1 day", grain: int = 60_000) -> DataFrame:
    """Outcome and page revision of every submission, in order of (submitted_at, position) whatever the order of arrival.

    ``pages``: page_id, revision, one row per page, where the stream starts; others are ``page_not_found``.  Submissions later
    than the watermark, and those without a time, are dropped.
    """
    timed = submissions.withWatermark("submitted_at", watermark)
    sound = (js_trim(F.coalesce("corrected_text", F.lit(""))) != "") & F.coalesce(F.col("base_revision") >= 0, F.lit(False))
    judged = timed.filter("submitted_at is not null").select(
        "page_id", "submitted_at", F.unix_micros("submitted_at").alias("micros"), F.col("position").cast("long").alias("at"),
        F.when(sound, F.col("base_revision").cast("long")).otherwise(-1).alias("base_revision"))
    stored = pages.select("page_id", F.coalesce(F.col("revision").cast("long"), F.lit(0)).alias("revision"))
    return judged.groupBy("page_id").transformWithState(
        statefulProcessor=_StoredPages(grain), outputStructType="page_id long, position long, outcome string, revision long",
        outputMode="Append", timeMode="EventTime", initialState=stored.groupBy("page_id"))


@contextmanager
def _as_batch(words: DataFrame):
    """The micro-batch computed once, and adaptive execution for what is done with it; a stream's session has it off."""
    conf, name = words.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    given = cut_lineage(words)
    conf.set(name, "true")
    try:
        yield given
    finally:
        conf.set(name, before)


def ingest_batches(
    read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[IngestResult, int], None], **options
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that ingests each micro-batch of words.

    ``read`` returns the current (vocabulary, reviews); ``write`` stores the result, keyed by
    the batch number so that a repeated batch can be recognised.
    """
    def run(words: DataFrame, batch_id: int) -> None:
        with _as_batch(words) as given:
            write(ingest(given, *read(), **options), batch_id)

    return run


def stream_ingest(words: DataFrame, read, write, checkpoint: str, **options):
    """Start the ingest stream over everything available."""
    return (
        words.writeStream.foreachBatch(ingest_batches(read, write, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_once(store: Snapshots, stream: str, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that ingests each micro-batch of words into ``store``, once however often it is run.

    ``stream`` names the stream whose batch numbers count; the store holds vocabulary and reviews.  A micro-batch without
    words, as the watermark causes at the end of a run, makes no version.
    """
    def run(words: DataFrame, batch_id: int) -> None:
        with _as_batch(words) as given:
            if given.isEmpty():
                return

            def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
                result = ingest(given, tables["vocabulary"], tables["reviews"], **options)
                return {"vocabulary": result.vocabulary, "reviews": result.reviews}

            store.apply(stream, batch_id, change)

    return run


def stream_ingest_once(words: DataFrame, store: Snapshots, stream: str, checkpoint: str, watermark: str = "1 day", **options):
    """Start the ingest of words (with ``arrived_at``) over everything available.

    A word that is delivered again within the watermark (same position and identity, hence the same review key) is
    dropped; a micro-batch that is run again finds its commit record.
    """
    columns = words.columns
    fresh = incoming_keys(words).withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["position", "identity_key"])
    given = fresh.select(*[c for c in columns if c != "arrived_at"])
    return (
        given.writeStream.foreachBatch(ingest_once(store, stream, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
