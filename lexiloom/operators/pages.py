"""Page workflow: corrections, reprocessing, preview, approval and rejection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from ..functions.identity import join_keys, surface_key
from ..functions.text import clean_text, js_trim
from .ordered import top_k
from .folds import fold_sorted
from .tables import upsert
from .words import WORD_FIELDS, Scripts, checked_words, has_word, json_fields, parse_lines

# Texts of the workflow.
EXACT_REASON, NEW_REASON = "canonical key already exists", "no exact canonical match"
MANUAL_REASON = "manual OCR review required"
REVIEW_KEY_PREFIX, PAGE_SOURCE_PREFIX = "ingestion:", "ingestion-page:"
NO_WORDS_CATEGORY, REJECTED_CATEGORY = "no_valid_candidates", "operator_rejected"
REASON_CHARS, ACTOR_CHARS, DEFAULT_ACTOR = 500, 120, "local-user"

RUN_SUBMISSIONS = 16384


def attention_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("status = 'needs_review'")


# --- corrections --------------------------------------------------------------------------


def step(revision: int, base: int) -> tuple[bool, int]:
    """One submission against the current revision: accepted only on the current one."""
    return (True, revision + 1) if base == revision else (False, revision)


_RUN = pa.schema([("page_id", pa.int64()), ("run", pa.int64()),
                  ("entries", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
_ENTRY = pa.schema([("page_id", pa.int64()), ("run", pa.int64()), ("entry", pa.int64())])
_DONE = pa.schema([("page_id", pa.int64()), ("position", pa.int64()), ("accepted", pa.bool_()), ("revision", pa.int64())])


def _summarise_runs(rows):
    """For every revision a run can be entered with, the revision it is left with."""
    key, at, begun, top = None, {}, set(), None

    def finish():
        pairs = sorted((e, state) for state, group in at.items() for e in group if e <= top)
        return (*key, [p[0] for p in pairs], [p[1] for p in pairs])

    for page_id, run, _, base, bound in rows:
        if (page_id, run) != key:
            if key is not None:
                yield finish()
            key, at, begun, top = (page_id, run), {}, set(), bound
        movers = at.pop(base, [])
        if base not in begun:
            begun.add(base)
            movers.append(base)
        waiting = at.get(base + 1, [])
        if len(waiting) > len(movers):
            waiting, movers = movers, waiting
        movers.extend(waiting)
        at[base + 1] = movers
    if key is not None:
        yield finish()


def _enter_runs(rows):
    key, revision = None, None
    for page_id, run, start, entries, exits in rows:
        if page_id != key:
            key, revision = page_id, start
        yield (page_id, run, revision)
        revision = dict(zip(entries, exits)).get(revision, revision)


def _replay_runs(rows):
    key, revision = None, None
    for page_id, run, position, base, entry in rows:
        if (page_id, run) != key:
            key, revision = (page_id, run), entry
        accepted, revision = step(revision, base)
        yield (page_id, position, accepted, revision)


def apply_corrections(pages: DataFrame, submissions: DataFrame, run_size: int = RUN_SUBMISSIONS) -> DataFrame:
    """Outcome of every correction in order of ``position`` per page.

    ``pages``: page_id, revision, raw_text.  ``submissions``: page_id, position, base_revision,
    corrected_text and optional reason and actor.  A submission is accepted when its base is
    the page's current revision, which then rises by one; others are stale.  The chain of a
    page is cut into runs: each is first summarised on its own, as a map from the revision it
    is entered with to the one it is left with, so a page with very many submissions is replayed
    by many tasks.  Adds outcome, revision (after the submission) and original_text.
    """
    optional = {c: F.col(c) if c in submissions.columns else F.lit(None).cast("string") for c in ("reason", "actor")}
    known = submissions.withColumns({
        "corrected_text": js_trim(F.coalesce("corrected_text", F.lit(""))),
        "reason": F.substring(optional["reason"], 1, REASON_CHARS),
        "actor": F.coalesce(F.substring(optional["actor"], 1, ACTOR_CHARS), F.lit(DEFAULT_ACTOR)),
    }).join(pages.select("page_id", F.col("revision").cast("long").alias("start")), "page_id", "left")
    sound = (F.col("corrected_text") != "") & F.coalesce(F.col("base_revision") >= 0, F.lit(False))
    refused = F.when(~sound, "invalid").when(F.col("start").isNull(), "page_not_found")
    judged = known.withColumn("refused", refused)

    # Narrow rows that every pass below starts from, and the passes' result: both are computed once.
    chain = cut_lineage(judged.filter("refused is null").select(
        F.col("page_id").cast("long").alias("page_id"), F.floor(F.col("position") / run_size).alias("run"),
        F.col("position").cast("long").alias("position"), F.col("base_revision").cast("long").alias("base"), "start"))
    # Before a run the revision is at most one above every earlier base: other entries cannot occur.
    reach = chain.groupBy("page_id", "run").agg(F.max("base").alias("top"), F.max("start").alias("start"))
    earlier = Window.partitionBy("page_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bounds = reach.select(
        "page_id", "run", "start",
        F.greatest(F.col("start"), F.coalesce(F.max("top").over(earlier) + 1, F.lit(0))).alias("bound"))
    runs = fold_sorted(
        chain.drop("start").join(bounds.drop("start"), ["page_id", "run"]).select("page_id", "run", "position", "base", "bound"),
        ["page_id", "run"], ["position"], _summarise_runs, _RUN)
    entries = fold_sorted(
        runs.join(bounds, ["page_id", "run"]).select("page_id", "run", "start", "entries", "exits"),
        ["page_id"], ["run"], _enter_runs, _ENTRY)
    done = cut_lineage(fold_sorted(
        chain.join(entries, ["page_id", "run"]).select("page_id", "run", "position", "base", "entry"),
        ["page_id", "run"], ["position"], _replay_runs, _DONE))
    out = (
        judged.drop("start").join(done, ["page_id", "position"], "left")
        .withColumn("outcome", F.coalesce("refused", F.when(F.col("accepted"), "accepted").otherwise("stale")))
        .drop("accepted", "refused")
    )
    # The text a correction replaces is the one of the revision before it.
    replaced = out.filter("outcome = 'accepted'").select(
        "page_id", (F.col("revision") + 1).alias("revision"), F.col("corrected_text").alias("_before"))
    raw = pages.select("page_id", F.coalesce("raw_text", F.lit("")).alias("_raw"))
    return (
        out.join(replaced, ["page_id", "revision"], "left").join(raw, "page_id", "left")
        .withColumn("original_text", F.when(F.col("outcome") == "accepted", F.coalesce("_before", "_raw")))
        .drop("_before", "_raw")
    )


def current_text(pages: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pages with the text and revision of their last accepted correction."""
    latest = corrections.filter("outcome = 'accepted'").groupBy("page_id").agg(
        F.max("revision").alias("_revision"), F.max_by("corrected_text", "revision").alias("_text"))
    return pages.join(latest, "page_id", "left").withColumns({
        "revision": F.coalesce("_revision", "revision"), "raw_text": F.coalesce("_text", "raw_text"),
        "status": F.when(F.col("_text").isNotNull(), "corrected").otherwise(F.col("status")),
    }).drop("_revision", "_text")


# --- detail and listing -------------------------------------------------------------------


def page_detail(pages: DataFrame, batches: DataFrame, candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per page and per item of it, in display order within (page_id, item).

    Items are candidates, oldest first, and corrections, newest revision first; ``sort_key``
    gives that order.  Kept long rather than nested, so no page is gathered into one row.
    """
    head = pages.join(batches.select("batch_id", "source_name", F.col("status").alias("batch_status")), "batch_id", "left")
    head = head.select("page_id", "batch_id", "source_name", "batch_status", "page_number", "status", "revision")
    parts = candidates.select(
        "page_id", F.lit("candidate").alias("item"), F.unix_micros("created_at").alias("sort_key"),
        F.col("candidate_id").cast("string").alias("item_id"), F.col("incoming_json").alias("payload"),
    ).unionByName(corrections.select(
        "page_id", F.lit("correction").alias("item"), (-F.col("revision")).cast("long").alias("sort_key"),
        F.col("revision").cast("string").alias("item_id"), F.col("corrected_text").alias("payload")))
    return head.join(parts, "page_id", "left")


def page_candidates(pages: DataFrame, candidates: DataFrame, corrections: DataFrame, k: int = 20) -> DataFrame:
    """Pages with their ``k`` oldest candidates and the number of corrections."""
    shown = top_k(candidates, ["page_id"], [F.col("created_at"), F.col("candidate_id")], k)
    nested = shown.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(
        "created_at", "candidate_id", "decision_kind", "status", "score", "incoming_json", "reasons_json"
    ))).alias("candidates"))
    fixes = corrections.groupBy("page_id").agg(F.count(F.lit(1)).alias("corrections"))
    return pages.join(nested, "page_id", "left").join(fixes, "page_id", "left").withColumn(
        "corrections", F.coalesce("corrections", F.lit(0)))


# --- candidates ---------------------------------------------------------------------------


def saved_keys(vocab: DataFrame) -> DataFrame:
    """Row that holds each saved canonical key."""
    return vocab.filter(F.col("canonical_key").isNotNull()).groupBy("canonical_key").agg(F.min("id").alias("existing_id"))


def match_exact(candidates: DataFrame, vocab: DataFrame) -> DataFrame:
    """Candidates with the row that holds their ``canonical_key``, or null."""
    return candidates.join(saved_keys(vocab), "canonical_key", "left")


def word_key(cut: bool = False) -> Column:
    """Canonical key of a checked word; its reading is normalised already, and its surface too if it was cut from a page."""
    return join_keys(F.coalesce("kanji", F.lit("")) if cut else surface_key("kanji"), F.col("kana"))


def _reason(existing: Column) -> Column:
    return F.when(existing.isNotNull(), EXACT_REASON).otherwise(NEW_REASON)


def _cleaned(pages: DataFrame) -> DataFrame:
    return pages.withColumn("normalized_text", clean_text(F.coalesce("raw_text", F.lit(""))))


def reprocess_pages(pages: DataFrame, scripts: Scripts = Scripts()) -> DataFrame:
    """Pages with their cleaned text; one without a valid word fails."""
    # A page without an id has no words of its own; rows of one page share what any of them has.  Their
    # texts meet only where the ids say that some page has several rows.
    some = F.col("page_id").isNotNull() & has_word(F.col("normalized_text"), scripts)
    repeated = pages.filter("page_id is not null").groupBy("page_id").count().filter("count > 1")
    if not repeated.isEmpty():
        some = F.max(some).over(Window.partitionBy("page_id"))
    return _cleaned(pages).withColumn("_some", some).withColumns({
        "status": F.when(F.col("_some"), "needs_review").otherwise("failed"),
        "error_category": F.when(~F.col("_some"), NO_WORDS_CATEGORY),
    }).drop("_some")


def reprocess_candidates(
    pages: DataFrame, candidates: DataFrame, vocab: DataFrame, now: str = "2024-01-01 00:00:00",
    scripts: Scripts = Scripts(),
) -> DataFrame:
    """Candidates where the pending ones of the pages give way to new ones, marked exact or new."""
    texts = _cleaned(pages).select("page_id", "batch_id", F.col("normalized_text").alias("text"))
    words = parse_lines(texts, "text", scripts, cleaned=True)
    found = match_exact(words.withColumn("canonical_key", word_key(cut=True)), vocab)
    fresh = found.select(
        F.concat_ws("-", "page_id", "position").alias("candidate_id"), "batch_id", "page_id",
        F.to_json(F.struct(*WORD_FIELDS)).alias("incoming_json"), "canonical_key",
        F.when(F.col("existing_id").isNotNull(), "exact").otherwise("new").alias("decision_kind"),
        F.lit("pending").alias("status"), F.col("existing_id").alias("vocabulary_id"),
        F.to_json(F.array(_reason(F.col("existing_id")))).alias("reasons_json"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )
    pending = pages.select("page_id", F.lit("pending").alias("status"))
    kept = candidates.join(pending, ["page_id", "status"], "left_anti")
    for c in candidates.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(candidates.schema[c].dataType))
    return kept.select(*candidates.columns).unionByName(fresh.select(*candidates.columns))


def reprocess(
    pages: DataFrame, candidates: DataFrame, vocab: DataFrame, now: str = "2024-01-01 00:00:00",
    scripts: Scripts = Scripts(),
) -> tuple[DataFrame, DataFrame]:
    """Read the words of every page's current text again.

    Pending candidates of the pages give way to new ones, marked exact or new.  A page without
    a valid word fails.  Returns (pages, candidates).
    """
    return reprocess_pages(pages, scripts), reprocess_candidates(pages, candidates, vocab, now, scripts)


def pending_words(candidates: DataFrame, scripts: Scripts = Scripts()) -> DataFrame:
    """Pending candidates with the fields, validity and key of their record."""
    rows = candidates.filter("status = 'pending'").drop("canonical_key").withColumn("_json", F.col("incoming_json"))
    return checked_words(json_fields(rows, "_json"), "N5", None, scripts).withColumn("canonical_key", word_key())


def preview(candidates: DataFrame, vocab: DataFrame, scripts: Scripts = Scripts()) -> DataFrame:
    """What an approval would do with each valid pending candidate."""
    found = match_exact(pending_words(candidates, scripts).filter("valid"), vocab)
    exists = F.col("existing_id").isNotNull()
    return found.select(
        "page_id", "candidate_id", *WORD_FIELDS, "canonical_key",
        F.when(exists, "exact").otherwise("new").alias("decision"), "existing_id",
        F.array(_reason(F.col("existing_id"))).alias("reasons"),
        F.when(exists, "low").otherwise("unknown").alias("collision_risk"),
    )


def approve(
    pages: DataFrame, candidates: DataFrame, vocab: DataFrame, reviews: DataFrame,
    new_id: Column | None = None, now: str = "2024-01-01 00:00:00", scripts: Scripts = Scripts(),
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Approve the pages: settle all their pending candidates, oldest first.

    Returns (pages, candidates, vocabulary, reviews).  ``new_id`` gives the id of an inserted
    word from the candidate's columns; the default is a digest of the key.
    """
    order = F.struct("created_at", "candidate_id")
    mine = candidates.join(pages.select("page_id"), "page_id", "left_semi")
    words = match_exact(pending_words(mine, scripts), vocab).withColumn("order", order).withColumn(
        "new_id", new_id if new_id is not None else F.sha2("canonical_key", 256))
    inserts = F.col("valid") & (F.col("decision_kind") != "review") & F.col("existing_id").isNull()
    owners = words.filter(inserts).groupBy("canonical_key").agg(
        F.min("order").alias("owner_order"), F.min_by("new_id", "order").alias("owner_id"))
    linked = words.join(owners, "canonical_key", "left").withColumn(
        "target_id", F.coalesce("existing_id", F.when(F.col("owner_order") < F.col("order"), F.col("owner_id"))))
    action = (
        F.when(~F.col("valid"), "invalid").when(F.col("decision_kind") == "review", "review")
        .when(F.col("target_id").isNotNull(), "link").otherwise("insert")
    )
    settled = linked.withColumn("action", action)

    fresh = settled.filter("action = 'insert'").withColumns({
        "id": F.col("new_id"), "burmese_meaning": F.col("burmese_meaning"), "created_at": F.lit(now).cast("timestamp"),
        "pdf_source": F.concat(F.lit(PAGE_SOURCE_PREFIX), F.col("page_id").cast("string")),
    })
    fresh = fresh.select(*[
        (F.col(c) if c in fresh.columns else F.lit(None)).cast(vocab.schema[c].dataType).alias(c) for c in vocab.columns])
    to_review = settled.filter("action = 'review'").select(
        F.concat(F.lit(REVIEW_KEY_PREFIX), F.col("candidate_id").cast("string")).alias("review_key"),
        F.to_json(F.struct(*WORD_FIELDS)).alias("incoming_json"), F.col("target_id").alias("candidate_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("reasons_json", F.to_json(F.array(F.lit(MANUAL_REASON)))).alias("reasons_json"),
        F.lit(None).cast("string").alias("explanation_json"),
        F.concat(F.lit(PAGE_SOURCE_PREFIX), F.col("page_id").cast("string")).alias("source"),
        F.lit("pending").alias("status"), F.lit(now).cast("timestamp").alias("created_at"),
    )
    reviews_out = upsert(
        reviews, to_review, ["review_key"], keep_old=["score", "reasons_json", "explanation_json", "source", "created_at"])
    changes = settled.select(
        "candidate_id",
        F.when(F.col("action") == "invalid", "rejected").when(F.col("action") == "review", "review")
        .otherwise("approved").alias("_status"),
        F.when(F.col("action") == "invalid", "invalid").otherwise(F.col("decision_kind")).alias("_kind"),
        F.when(F.col("action") == "insert", F.col("new_id")).otherwise(F.col("target_id")).alias("_vocabulary"),
        F.when(F.col("action").isin("link", "insert"), F.col("canonical_key")).alias("_key"),
    )
    touched = F.col("_status").isNotNull()
    relink = touched & (F.col("_status") != "rejected")
    candidates_out = candidates.join(changes, "candidate_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "decision_kind": F.coalesce("_kind", "decision_kind"),
        "vocabulary_id": F.when(relink, F.col("_vocabulary")).otherwise(F.col("vocabulary_id")),
        "canonical_key": F.coalesce("_key", "canonical_key"),
    }).select(*candidates.columns)
    with_reviews = settled.filter("action = 'review'").select("page_id", F.lit(True).alias("_review")).distinct()
    pages_out = pages.join(with_reviews, "page_id", "left").withColumn(
        "status", F.when(F.col("_review"), "needs_review").otherwise("approved")).drop("_review")
    return pages_out, candidates_out, vocab.unionByName(fresh), reviews_out


def reject(pages: DataFrame, candidates: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reject pages: ``requests`` has page_id, position and reason; the last one of a page counts.

    Returns (pages, candidates).
    """
    asked = requests.groupBy("page_id").agg(F.substring(F.max_by("reason", "position"), 1, REASON_CHARS).alias("_reason"))
    asked = asked.withColumn("_asked", F.lit(True))
    hit = F.col("_asked").isNotNull()
    pages_out = pages.join(asked, "page_id", "left").withColumns({
        "status": F.when(hit, "rejected").otherwise(F.col("status")),
        "error_category": F.when(hit, REJECTED_CATEGORY).otherwise(F.col("error_category")),
        "error_message": F.when(hit, F.col("_reason")).otherwise(F.col("error_message")),
    }).select(*pages.columns)
    candidates_out = candidates.join(asked, "page_id", "left").withColumn(
        "status", F.when(hit & (F.col("status") == "pending"), "rejected").otherwise(F.col("status"))
    ).select(*candidates.columns)
    return pages_out, candidates_out
