"""Ingest of a word batch: every decision sees the words inserted before it.

A word depends on earlier words of its batch in two ways only.  It becomes a review when an
earlier *inserted* word has the same surface, a reading one edit away and a compatible meaning
(an edge, computed once).  And its reading group counts stored plus inserted rows: while the
count is one, a word may enrich that single row.  Both are settled by rounds over narrow rows;
a round decides every word whose earlier neighbours are decided, whatever the size of its
group, so the number of rounds follows the longest chain of near-duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.identity import KEY_SEPARATOR
from ..session import cut_lineage
from .matching import (
    CHUNK, enrich, explain, fuzzy_candidates, fuzzy_pairs, incoming_keys, lookups, meanings_agree,
    review_score, stored_keys,
)
from .ordered import dedupe_first
from .tables import insert_absent
from .words import WORD_FIELDS

TRIPLE = ["surface_key", "reading_key", "meaning_key"]


@dataclass
class IngestResult:
    vocabulary: DataFrame
    reviews: DataFrame
    decisions: DataFrame
    totals: DataFrame


def _settle(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Status (new, review, enrich) of every word, and the inserted row an enrich refers to.

    ``words``: pos, reading_key, surface_key, meaning_key, store_n, agrees_store, near_store.
    ``edges``: pos, other (both positions, other < pos).
    """
    open_, new = F.col("status") == "open", F.col("status") == "new"
    keys = words.columns
    active, settled = words.withColumn("status", F.lit("open")), None
    while True:
        others = active.select(F.col("pos").alias("other"), "status")
        seen = edges.join(others, "other").groupBy("pos").agg(
            F.bool_or(new).alias("beside_new"), F.bool_or(open_).alias("beside_open"))
        near = F.col("near_store") | F.coalesce("beside_new", F.lit(False))
        known = active.join(seen, "pos", "left").withColumn(
            "apart",
            F.when(near, "review").when(F.coalesce("beside_open", F.lit(False)), "unknown").otherwise("new"))
        # The row a reading group may enrich: its only stored row, or its first insert.
        lead = F.when(new | (open_ & (F.col("apart") != "review")), F.col("pos"))
        first = known.filter("store_n = 0").groupBy("reading_key").agg(
            F.min(lead).alias("first_pos"),
            F.min_by("status", lead).alias("first_status"),
            F.min_by("apart", lead).alias("first_apart"),
            F.min_by("surface_key", lead).alias("x_surface"),
            F.min_by("meaning_key", lead).alias("x_meaning"),
        )
        sure = (F.col("first_status") == "new") | (F.col("first_apart") == "new")
        grouped = known.join(first, "reading_key", "left").withColumns({
            "has_x": (F.col("store_n") == 1) | ((F.col("store_n") == 0) & sure & (F.col("pos") > F.col("first_pos"))),
            "is_lead": (F.col("store_n") == 0)
            & (F.col("first_pos").isNull() | (F.col("pos") <= F.col("first_pos"))),
        }).withColumns({"has_x": F.coalesce("has_x", F.lit(False)), "is_lead": F.coalesce("is_lead", F.lit(False))})
        one_bare = (F.col("surface_key") == "") | (F.col("x_surface") == "")
        fits = F.when(F.col("store_n") == 1, F.col("agrees_store")).otherwise(
            F.coalesce(one_bare & meanings_agree("meaning_key", "x_meaning"), F.lit(False)))
        judged = grouped.withColumn("fits", F.col("has_x") & fits)
        # Later inserts of a group end its enrichments.
        other_insert = F.col("has_x") & (new | (open_ & ~F.col("fits") & (F.col("apart") == "new")))
        maybe_insert = F.col("has_x") & open_ & ~F.col("fits") & (F.col("apart") == "unknown")
        later = judged.groupBy("reading_key").agg(
            F.min(F.when(other_insert, F.col("pos"))).alias("second_pos"),
            F.min(F.when(maybe_insert, F.col("pos"))).alias("maybe_pos"),
        )
        free = (F.col("store_n") >= 2) | F.col("is_lead") | (F.col("has_x") & ~F.col("fits"))
        closed = F.coalesce(F.col("second_pos") < F.col("pos"), F.lit(False))
        waits = F.coalesce(F.col("maybe_pos") < F.col("pos"), F.lit(False))
        apart = F.when(F.col("apart") == "unknown", "open").otherwise(F.col("apart"))
        decided = (
            F.when(~open_, F.col("status"))
            .when(free | (F.col("has_x") & closed), apart)
            .when(F.col("has_x") & F.col("fits") & ~waits, "enrich")
            .otherwise("open")
        )
        result = cut_lineage(judged.join(later, "reading_key", "left").select(
            *keys, decided.alias("status"), (open_ & (decided != "open")).alias("newly")))
        done = result.filter("newly").select("pos", "status")
        settled = done if settled is None else settled.unionByName(done)
        rest = result.filter(open_)
        if rest.isEmpty():
            return settled
        # The next round needs the open words, their reading groups and their edge neighbours.
        groups = rest.select("reading_key").distinct()
        beside = edges.join(rest.select("pos"), "pos", "left_semi").select(F.col("other").alias("pos"))
        needed = result.join(groups, "reading_key", "left_semi").select("pos").unionByName(beside).distinct()
        active = result.join(needed, "pos", "left_semi").select(*keys, "status")


def ingest(
    words: DataFrame, vocab: DataFrame, reviews: DataFrame, source: Column | str = "",
    now: str = "2024-01-01 00:00:00", chunk: int = CHUNK,
) -> IngestResult:
    """Apply a batch of validated words (with a unique ``position``) to vocabulary and reviews.

    Exact and enrich fill empty fields of a stored row, review adds a pending review unless
    one with its key exists, new inserts the word.
    """
    # Keys are computed once per side; everything below reads these two.
    batch = cut_lineage(dedupe_first(incoming_keys(words), ["identity_key"], [F.col("position")]))
    rows = cut_lineage(stored_keys(vocab).select("id", "stored_key", *TRIPLE))
    by_key, by_reading = lookups(rows)
    counts = rows.groupBy("reading_key").agg(F.count(F.lit(1)).alias("store_n"))
    keyed = (
        batch.select(F.col("position").alias("pos"), "identity_key", *TRIPLE)
        .join(by_key, F.col("identity_key") == F.col("stored_key"), "left").drop("stored_key")
        .join(counts, "reading_key", "left").join(by_reading, "reading_key", "left")
        .withColumn("store_n", F.coalesce("store_n", F.lit(0)))
    )
    one_bare = (F.col("surface_key") == "") | (F.col("only_surface") == "")
    keyed = cut_lineage(keyed.withColumn(
        "agrees_store", F.coalesce(one_bare & meanings_agree("meaning_key", "only_meaning"), F.lit(False))
    ).drop("only_surface", "only_meaning"))
    rest = keyed.filter(F.col("exact_id").isNull())
    near_store = fuzzy_candidates(rest, rows, chunk)
    open_words = cut_lineage(
        rest.join(near_store, TRIPLE, "left").withColumn("near_store", F.col("fuzzy").isNotNull()))
    members = open_words.filter((F.col("surface_key") != "") & (F.col("meaning_key") != "")).select(*TRIPLE, "pos")
    edges = cut_lineage(
        fuzzy_pairs(members, members.withColumnRenamed("pos", "ex_id"), chunk).filter(F.col("ex_id") < F.col("pos"))
        .select("pos", F.col("ex_id").alias("other"), "ex_reading", "distance", "similarity")
    )
    state = _settle(
        open_words.select("pos", *TRIPLE, "store_n", "agrees_store", "near_store"), edges.select("pos", "other"))

    new_id = _new_id(vocab)
    inserted = state.filter("status = 'new'").select("pos")
    id_of = inserted.join(batch.select(F.col("position").alias("pos"), "position", "identity_key", "reading_key"), "pos").select(
        "pos", "reading_key", new_id.alias("new_id"))
    first_insert = id_of.groupBy("reading_key").agg(F.min_by("new_id", "pos").alias("first_new_id"))
    fuzzy = lambda c: F.col(f"fuzzy.{c}").alias(c)
    stored_side = open_words.filter("near_store").select(
        "pos", F.lit(0).alias("tier"), F.col("fuzzy.ex_id").alias("ex_id"), F.lit(0).cast("long").alias("at"),
        fuzzy("ex_reading"), fuzzy("distance"), fuzzy("similarity"))
    batch_side = edges.join(id_of.select(F.col("pos").alias("other"), "new_id"), "other").select(
        "pos", F.lit(1).alias("tier"), F.col("new_id").alias("ex_id"), F.col("other").cast("long").alias("at"),
        "ex_reading", "distance", "similarity")
    scored = stored_side.unionByName(batch_side).withColumn("score", review_score(F.col("distance"), F.col("similarity")))
    best = scored.groupBy("pos").agg(F.min_by(
        F.struct("ex_id", "ex_reading", "distance", "similarity", "score"),
        F.struct(-F.col("score"), "tier", "at")).alias("best"))

    kind = F.when(F.col("exact_id").isNotNull(), "exact").otherwise(F.col("status"))
    review = F.col("kind") == "review"
    facts = (
        keyed.select("pos", "exact_id", "only_id", "store_n")
        .join(state, "pos", "left").join(best, "pos", "left").withColumn("kind", kind)
    )
    decided = (
        batch.join(facts.withColumnRenamed("pos", "position"), "position")
        .join(first_insert, "reading_key", "left")
        .withColumn("existing_id", F.when(F.col("kind") == "exact", F.col("exact_id"))
                    .when(review, F.col("best.ex_id"))
                    .when(F.col("kind") == "enrich",
                          F.when(F.col("store_n") == 1, F.col("only_id")).otherwise(F.col("first_new_id"))))
        .withColumns({c: F.when(review, F.col(f"best.{c}")) for c in ("score", "distance", "similarity", "ex_reading")})
    )
    decisions = explain(decided).drop(
        "ex_reading", "best", "exact_id", "only_id", "store_n", "status", "first_new_id")
    decisions = cut_lineage(decisions)

    source = F.lit(source) if isinstance(source, str) else source
    created = F.lit(now).cast("timestamp")
    fresh = decisions.filter("kind = 'new'").withColumns({
        "id": new_id, "canonical_key": F.col("identity_key"), "kana": F.col("reading_key"),
        "pdf_source": source, "created_at": created,
    })
    missing = [c for c in vocab.columns if c not in fresh.columns]
    fresh = fresh.withColumns({c: F.lit(None).cast(vocab.schema[c].dataType) for c in missing})
    fresh = fresh.select(*[F.col(c).cast(vocab.schema[c].dataType).alias(c) for c in vocab.columns])
    grown = enrich(vocab.unionByName(fresh), decisions.filter(F.col("kind").isin("exact", "enrich")))

    pending = decisions.filter(review).select(
        F.concat(F.col("existing_id").cast("string"), F.lit(KEY_SEPARATOR), "identity_key").alias("review_key"),
        F.to_json(F.struct(*WORD_FIELDS)).alias("incoming_json"), F.col("existing_id").alias("candidate_id"),
        "score", F.to_json("reasons").alias("reasons_json"), F.to_json("explanation").alias("explanation_json"),
        source.alias("source"), F.lit("pending").alias("status"), created.alias("created_at"), "position",
    )
    grown_reviews = insert_absent(reviews, pending, ["review_key"], [F.col("position")])
    return IngestResult(grown, grown_reviews, decisions, ingest_totals(decisions))


def _new_id(vocab: DataFrame) -> Column:
    """Repeatable id of an inserted word: a digest for text ids, the next numbers otherwise."""
    if isinstance(vocab.schema["id"].dataType, T.StringType):
        return F.sha2("identity_key", 256)
    top = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return top + 1 + F.col("position")


def ingest_totals(decisions: DataFrame) -> DataFrame:
    """Inserted, reviewed, filled and exact words of a run."""
    return decisions.agg(
        F.count_if(F.col("kind") == "new").alias("inserted"),
        F.count_if(F.col("kind") == "review").alias("reviewed"),
        F.count_if(F.col("kind") == "enrich").alias("enriched"),
        F.count_if(F.col("kind") == "exact").alias("exact"),
    )


def failed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that gave no chunk, the ones an ingest run reports as failed."""
    return files.select("doc").distinct().join(chunks.select("doc").distinct(), "doc", "left_anti")
