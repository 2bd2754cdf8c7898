"""Rows that share an identity: finding, ranking and merging them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.identity import reading_key, with_identity
from ..session import cut_lineage
from .ordered import split_rank

# Limits of one merge request.
MAX_GROUPS, MAX_ROWS = 100, 500

ID_RANGE = 65536


def _filled(c: str):
    return F.coalesce(F.col(c) != "", F.lit(False)).cast("int")


def collision_groups(vocab: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows of every identity held by more than one row, best survivor first.

    Adds identity_key, group_size, score (surface + example + progress) and rank.  Sizes come
    from a plain aggregate, and ranks split a group by score and minute, then by time and id.
    """
    keyed = with_identity(vocab)
    sizes = keyed.groupBy("identity_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    studied = progress.select(F.col("vocab_id").alias("id"), F.lit(1).alias("_studied")).distinct()
    rows = (
        keyed.join(sizes, "identity_key").join(studied, "id", "left")
        .withColumn("score", _filled("kanji") + _filled("example_sentence_jp") + F.coalesce("_studied", F.lit(0)))
        .drop("_studied", "surface_key", "reading_key")
    )
    text_id = isinstance(vocab.schema["id"].dataType, T.StringType)
    id_range = F.substring("id", 1, 3) if text_id else F.floor(F.col("id") / ID_RANGE)
    return split_rank(
        rows, ["identity_key"],
        [[-F.col("score"), F.date_trunc("minute", "created_at")], [F.col("created_at"), id_range]],
        [F.col("score").desc(), F.col("created_at"), F.col("id")],
    )


def rows_to_remove(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of collision groups other than the kept one; ``targets`` has identity_key, target_id."""
    return groups.join(targets, "identity_key").filter(F.col("id") != F.col("target_id"))


@dataclass
class MergeResult:
    vocabulary: DataFrame
    progress: DataFrame
    reviews: DataFrame
    outcomes: DataFrame


def judge_pairs(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Outcome per (position, source_id, target_id): ok or the error a merge in order would meet.

    In one identity only the holder of the saved key, or else the target of the first sound
    pair, can receive rows; so no row is merged twice and order matters through minima only.
    """
    keys = with_identity(vocab).select("id", "identity_key")
    holders = vocab.filter(F.col("canonical_key") != "").groupBy(F.col("canonical_key").alias("identity_key")).agg(
        F.min("id").alias("holder"))
    source = keys.select(F.col("id").alias("source_id"), F.col("identity_key").alias("source_key"))
    target = keys.select(F.col("id").alias("target_id"), "identity_key")
    named = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    base = (
        pairs.select("position", "source_id", "target_id")
        .join(source, "source_id", "left").join(target, "target_id", "left")
        .join(holders, "identity_key", "left")
        .withColumn("error", F.when(~named("source_id") | ~named("target_id") | (F.col("source_id") == F.col("target_id")),
                                    "invalid_rows")
                    .when(F.col("source_key").isNull() | F.col("identity_key").isNull(), "row_not_found")
                    .when(F.col("source_key") != F.col("identity_key"), "keys_differ"))
    )
    sound = base.filter("error is null")
    receivers = sound.filter("holder is null").groupBy("identity_key").agg(
        F.min_by("target_id", "position").alias("first_target"))
    directed = base.join(receivers, "identity_key", "left").withColumn("receiver", F.coalesce("holder", "first_target"))
    taken = (
        directed.filter(F.col("error").isNull() & (F.col("target_id") == F.col("receiver")))
        .groupBy("source_id").agg(F.min("position").alias("taken_at"))
    )
    gone_target = taken.select(F.col("source_id").alias("target_id"), F.col("taken_at").alias("target_gone_at"))
    before = lambda c: F.coalesce(F.col(c) < F.col("position"), F.lit(False))
    outcome = (
        F.when(F.col("error").isin("invalid_rows", "row_not_found"), F.col("error"))
        .when(before("taken_at") | before("target_gone_at"), "row_not_found")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("target_id") != F.col("receiver"), "key_occupied")
        .otherwise("ok")
    )
    return (
        directed.join(taken, "source_id", "left").join(gone_target, "target_id", "left")
        .select("position", "source_id", "target_id", "identity_key", outcome.alias("outcome"))
    )


# How a target field takes a source's value.
FILL_NULL = ("kanji", "romaji", "part_of_speech", "example_sentence_jp", "example_sentence_mm", "lesson")
FILL_EMPTY = ("burmese_meaning", "jlpt_level")


def apply_merges(outcomes: DataFrame, vocab: DataFrame, progress: DataFrame, reviews: DataFrame) -> MergeResult:
    """Carry the ``ok`` pairs out: fold sources into targets and follow the references."""
    ok = outcomes.filter("outcome = 'ok'").select("position", "source_id", "target_id", "identity_key")
    donors = ok.join(vocab.withColumnRenamed("id", "source_id"), "source_id")
    offers = donors.groupBy(F.col("target_id").alias("id")).agg(
        F.first("identity_key").alias("_key"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(f"_{c}") for c in FILL_NULL],
        *[F.min_by(c, F.when(F.col(c) != "", F.col("position"))).alias(f"_{c}") for c in FILL_EMPTY],
    )
    merged = F.col("_key").isNotNull()
    changes = {c: F.when(merged, F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in FILL_NULL}
    changes |= {
        c: F.when(merged, F.coalesce(F.nullif(c, F.lit("")), F.col(f"_{c}"), F.col(c))).otherwise(F.col(c))
        for c in FILL_EMPTY
    }
    changes["canonical_key"] = F.when(merged, F.col("_key")).otherwise(F.col("canonical_key"))
    changes["kana"] = F.when(merged, reading_key("kana")).otherwise(F.col("kana"))
    removed = ok.select(F.col("source_id").alias("id"))
    vocab_out = (
        vocab.join(removed, "id", "left_anti").join(offers, "id", "left").withColumns(changes).select(*vocab.columns)
    )
    links = ok.select(F.col("source_id").alias("vocab_id"), "target_id", "position")
    moving = progress.join(links, "vocab_id")
    first_move = moving.groupBy("target_id").agg(F.min("position").alias("position"))
    moved = (
        moving.join(first_move, ["target_id", "position"])
        .join(progress.select(F.col("vocab_id").alias("target_id")), "target_id", "left_anti")
        .withColumn("vocab_id", F.col("target_id")).select(*progress.columns)
    )
    progress_out = progress.join(links, "vocab_id", "left_anti").unionByName(moved)
    to = ok.select(F.col("source_id").alias("candidate_id"), F.col("target_id").alias("_to"))
    reviews_out = reviews.join(to, "candidate_id", "left").withColumn(
        "candidate_id", F.coalesce("_to", "candidate_id")).select(*reviews.columns)
    return MergeResult(vocab_out, progress_out, reviews_out, outcomes)


def merge_collisions(pairs: DataFrame, vocab: DataFrame, progress: DataFrame, reviews: DataFrame) -> MergeResult:
    """Merge pairs (position, source_id, target_id) in order; a failing pair changes nothing.

    The outcomes feed all three tables, so they are computed once, into the checkpoint folder.
    """
    return apply_merges(cut_lineage(judge_pairs(pairs, vocab)), vocab, progress, reviews)


def merge_collision_batch(
    groups: DataFrame, vocab: DataFrame, progress: DataFrame, reviews: DataFrame,
    max_groups: int = MAX_GROUPS, max_rows: int = MAX_ROWS,
) -> MergeResult:
    """All-or-nothing merge of groups (group_no, target_id, source_ids).

    The request fails as a whole when it is empty or over a limit, or when any pair fails.
    """
    valid = groups.filter(F.col("target_id").isNotNull() & F.forall(
        "source_ids", lambda s: s.isNotNull() & (s.cast("string") != "")))
    size = valid.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("source_ids") + 1), F.lit(0)).alias("rows"))
    fits = size.select((F.col("n").between(1, max_groups) & (F.col("rows") <= max_rows)).alias("fits")).scalar()
    pairs = valid.select("group_no", "target_id", F.posexplode("source_ids").alias("_at", "source_id")).filter(
        F.col("source_id") != F.col("target_id")
    ).select(
        (F.col("group_no").cast("long") * F.lit(1 << 32) + F.col("_at")).alias("position"), "source_id", "target_id")
    judged = judge_pairs(pairs, vocab)
    clean = judged.agg((F.count_if(F.col("outcome") != "ok") == 0).alias("clean")).scalar()
    final = judged.withColumn(
        "outcome", F.when(~fits, "request_over_limit").when(~clean & (F.col("outcome") == "ok"), "rolled_back")
        .otherwise(F.col("outcome")))
    return apply_merges(cut_lineage(final), vocab, progress, reviews)


def backfill_keys(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary with computed keys, collisions); unchanged when any identity has two rows."""
    keyed = with_identity(vocab)
    sizes = keyed.groupBy("identity_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    blocked = sizes.agg((F.count(F.lit(1)) > 0).alias("blocked")).scalar()
    filled = keyed.withColumn(
        "canonical_key", F.when(blocked, F.col("canonical_key")).otherwise(F.col("identity_key")))
    collisions = keyed.join(sizes, "identity_key").select("identity_key", "group_size", "id", "kanji", "kana")
    return filled.select(*vocab.columns), collisions
