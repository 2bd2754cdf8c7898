"""Matching, ingest, collision and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import with_identity
from ..operators import collisions, ingest, matching, tables
from . import views as v


def block_candidates(spark, sf):
    return v.plain(matching.block_candidates(v.words(spark, sf), v.vocab(spark, sf)))


def fuzzy_candidates(spark, sf):
    best = matching.fuzzy_candidates(
        matching.incoming_keys(v.words(spark, sf)), matching.stored_keys(v.vocab(spark, sf)))
    return v.plain(best.select("surface_key", "reading_key", "meaning_key", "fuzzy.ex_id", "fuzzy.distance", "fuzzy.score"))


def match_decisions(spark, sf):
    out = matching.decide(v.words(spark, sf), v.vocab(spark, sf), explained=False)
    return v.plain(out.select("position", "kind", "existing_id", "score"))


def match_explanations(spark, sf):
    out = matching.decide(v.words(spark, sf), v.vocab(spark, sf)).filter("kind = 'review'")
    return v.plain(out.select(
        "position", "existing_id", "reasons", "explanation.confidence", "explanation.collision_risk",
        F.col("explanation.normalized_candidate.reading").alias("candidate_reading"),
        F.transform("explanation.signals", lambda s: s["value"]).alias("signals")))


def enrich(spark, sf):
    vocab = v.vocab(spark, sf)
    decided = matching.decide(v.words(spark, sf), vocab, explained=False)
    out = matching.enrich(vocab, decided.filter(F.col("kind").isin("exact", "enrich")))
    return v.plain(out.select(
        "id", v.visible("canonical_key").alias("canonical_key"), "kanji", "part_of_speech", "example_sentence_jp", "lesson"))


def ingest_decisions(spark, sf):
    """The whole word table as one batch: later words see the words inserted before them."""
    empty = v.reviews(spark, sf).limit(0)
    return v.plain(ingest.ingest(v.words(spark, sf), v.vocab(spark, sf), empty).decisions.select("position", "kind", "existing_id", "score"))


def ingest_counts(spark, sf):
    empty = v.reviews(spark, sf).limit(0)
    return v.plain(ingest.ingest(v.words(spark, sf), v.vocab(spark, sf), empty).totals)


def _by_supplier(spark, sf):
    """Words keyed by reading alone, as the stored side of the snapshot queries."""
    stored = v.vocab(spark, sf).select("id", "kana", "romaji", "lesson").filter("romaji IS NOT NULL")
    new = v.words(spark, sf).select(F.col("position").alias("id"), "kana", F.lit("new").alias("romaji"), "lesson")
    return stored, new


def insert_absent(spark, sf):
    stored, new = _by_supplier(spark, sf)
    return v.plain(tables.insert_absent(stored, new, ["kana"], [F.col("id")]))


def upsert(spark, sf):
    stored, new = _by_supplier(spark, sf)
    return v.plain(tables.upsert(stored, new, ["id"], keep_old=["lesson"]))


def delete_cascade(spark, sf):
    """Delete the learning words; progress follows, reviews lose their link."""
    target = v.vocab(spark, sf).select("id", "pdf_source")
    out = tables.delete_where(
        target, F.col("pdf_source").startswith("File1"), "id",
        {"progress": (v.word_progress(spark, sf).select("vocab_id"), "vocab_id")},
        {"reviews": (v.reviews(spark, sf).select("review_key", "candidate_id"), "candidate_id")})
    kept = out["target"].select(F.lit("word").alias("kind"), F.col("id").cast("string").alias("key"), F.col("id").alias("ref"))
    progress = out["progress"].select(F.lit("progress"), F.col("vocab_id").cast("string"), "vocab_id")
    links = out["reviews"].select(F.lit("review"), "review_key", "candidate_id")
    return v.plain(kept.union(progress).union(links))


def collision_groups(spark, sf):
    out = collisions.collision_groups(v.vocab(spark, sf), v.word_progress(spark, sf))
    return v.plain(out.select("id", v.visible("identity_key").alias("identity_key"), "group_size", "score", F.col("rank").alias("place")))


def rows_to_remove(spark, sf):
    groups = collisions.collision_groups(v.vocab(spark, sf), v.word_progress(spark, sf))
    best = groups.filter("rank = 1").select("identity_key", F.col("id").alias("target_id"))
    return v.plain(collisions.rows_to_remove(groups, best).select("id", "target_id"))


def _pairs(spark, sf):
    """Merge requests: every word into the next lower one of its identity, or into a neighbour."""
    keyed = with_identity(v.vocab(spark, sf))
    low = keyed.groupBy("identity_key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    k = F.col("id")
    return keyed.join(low, "identity_key").select(
        k.alias("position"),
        F.when(k % 50 == 7, F.lit(None)).otherwise(k).alias("source_id"),
        F.when(k % 3 == 0, F.col("high")).when(k % 10 == 1, k + 1).when(k % 40 == 9, -k).otherwise(F.col("low")).alias("target_id"))


def _merged(spark, sf):
    return collisions.merge_collisions(_pairs(spark, sf), v.vocab(spark, sf), v.word_progress(spark, sf), v.reviews(spark, sf))


def merge_outcomes(spark, sf):
    return v.plain(_merged(spark, sf).outcomes.select("position", "source_id", "target_id", "outcome"))


def merge_collisions(spark, sf):
    """Vocabulary after the merges, with the learning state and the reviews that follow it."""
    out = _merged(spark, sf)
    p = out.progress.select(F.col("vocab_id").alias("id"), F.col("status").alias("progress_status"))
    r = out.reviews.groupBy(F.col("candidate_id").alias("id")).agg(F.count(F.lit(1)).alias("reviews"))
    rows = out.vocabulary.join(p, "id", "left").join(r, "id", "left")
    return v.plain(rows.select(
        "id", v.visible("canonical_key").alias("canonical_key"), "kanji", "kana", "romaji", "burmese_meaning", "jlpt_level",
        "part_of_speech", "example_sentence_jp", "lesson", "progress_status", F.coalesce("reviews", F.lit(0)).alias("reviews")))


def _group_merge(spark, sf):
    """One request that merges all words sharing a reading-only or unkeyed identity."""
    vocab = v.vocab(spark, sf).withColumn("canonical_key", F.lit(None).cast("string"))
    groups = with_identity(vocab).groupBy("identity_key").agg(
        F.min("id").alias("target_id"), F.array_sort(F.collect_list("id")).alias("source_ids"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 1").select(F.col("target_id").alias("group_no"), "target_id", "source_ids")
    return vocab, groups


def merge_collision_batch(spark, sf):
    """The request with its limits lifted, so that it carries every group of the table."""
    vocab, groups = _group_merge(spark, sf)
    out = collisions.merge_collision_batch(
        groups, vocab, v.word_progress(spark, sf), v.reviews(spark, sf), max_groups=1 << 40, max_rows=1 << 50)
    return v.plain(out.vocabulary.select("id", v.visible("canonical_key").alias("canonical_key"), "romaji", "lesson"))


def merge_batch_over_limit(spark, sf):
    """The same request under limits that it breaks: every pair is refused."""
    vocab, groups = _group_merge(spark, sf)
    out = collisions.merge_collision_batch(
        groups, vocab, v.word_progress(spark, sf), v.reviews(spark, sf), max_groups=0)
    return v.plain(out.outcomes.select("source_id", "target_id", "outcome"))


def backfill_keys(spark, sf):
    """Collisions that block the backfill, and the keys it leaves alone."""
    filled, found = collisions.backfill_keys(v.vocab(spark, sf))
    kept = filled.select("id", v.visible("canonical_key").alias("canonical_key"))
    return v.plain(kept.join(found.select("id", "group_size"), "id", "left"))


def backfill_unique(spark, sf):
    """Backfill of a vocabulary whose identities are unique."""
    vocab = v.vocab(spark, sf).withColumn("kana", F.concat_ws("-", "kana", "id"))
    filled, _ = collisions.backfill_keys(vocab)
    return v.plain(filled.select("id", v.visible("canonical_key").alias("canonical_key")))


# --- SQL twins ----------------------------------------------------------------------------

# Keys of both sides; meanings of the part table are lower case without punctuation.
MATCH = """
    stored AS (SELECT id, kana, surface_key, coalesce(canonical_key, identity_key) AS stored_key, replace(burmese_meaning, ' ', '') AS m FROM vocab),
    incoming AS (SELECT position, kana, surface_key, identity_key, replace(burmese_meaning, ' ', '') AS m FROM words),
    exact AS (SELECT stored_key, min(id) AS exact_id FROM stored GROUP BY 1),
    single AS (SELECT kana, min(id) AS only_id, min(surface_key) AS only_surface, min(m) AS only_m FROM stored GROUP BY 1 HAVING count(*) = 1),
    grams_s AS (SELECT m, list_distinct(list_transform(range(1, length(m)), lambda i: substr(m, i, 2))) AS g FROM (SELECT DISTINCT m FROM stored)),
    grams_i AS (SELECT m, list_distinct(list_transform(range(1, length(m)), lambda i: substr(m, i, 2))) AS g FROM (SELECT DISTINCT m FROM incoming)),
    sims AS (SELECT a.m AS im, b.m AS sm, CASE WHEN a.m = b.m THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END AS s
             FROM (SELECT i.m AS im, e.m AS sm FROM (SELECT DISTINCT surface_key, m FROM incoming WHERE surface_key <> '') i
                     JOIN (SELECT DISTINCT surface_key, m FROM stored) e USING (surface_key)
                   UNION SELECT i.m, only_m FROM incoming i JOIN single USING (kana)) met
             JOIN grams_i a ON a.m = im JOIN grams_s b ON b.m = sm),
    pairs AS (SELECT i.surface_key, i.kana, i.m, e.id AS ex_id, e.kana AS ex_kana, levenshtein(i.kana, e.kana) AS distance, s,
        floor((0.55 + CASE WHEN i.kana = e.kana THEN 0.25 ELSE 0 END + 0.2 * s) * 1000 + 0.5000001) / 1000 AS score
      FROM (SELECT DISTINCT surface_key, kana, m FROM incoming WHERE surface_key <> '') i JOIN stored e ON e.surface_key = i.surface_key
        JOIN sims ON im = i.m AND sm = e.m
      WHERE levenshtein(i.kana, e.kana) <= 1 AND s >= 0.45),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY surface_key, kana, m ORDER BY score DESC, ex_id) = 1),
    decided AS (
      SELECT i.*, exact_id, only_id, b.*  EXCLUDE (surface_key, kana, m),
        CASE WHEN exact_id IS NOT NULL THEN 'exact'
             WHEN only_id IS NOT NULL AND (i.surface_key = '' OR only_surface = '') AND sims.s >= 0.45 THEN 'enrich'
             WHEN ex_id IS NOT NULL THEN 'review' ELSE 'new' END AS kind
      FROM incoming i LEFT JOIN exact ON stored_key = identity_key LEFT JOIN single o ON o.kana = i.kana
        LEFT JOIN sims ON im = i.m AND sm = only_m LEFT JOIN best b ON b.surface_key = i.surface_key AND b.kana = i.kana AND b.m = i.m)"""


def _match(select: str) -> str:
    return v.with_views("WITH " + MATCH.strip() + "\n" + select.strip(), "vocab", "words")


# The sequential rule, one word per step: a step sees the words that earlier steps inserted.
INGEST = """
    , sized AS (SELECT kana, count(*) AS n FROM stored GROUP BY 1),
    batch AS (SELECT d.*, coalesce(n, 0) AS store_n, list_distinct(list_transform(range(1, length(d.m)), lambda i: substr(d.m, i, 2))) AS g
      FROM decided d LEFT JOIN sized USING (kana) QUALIFY row_number() OVER (PARTITION BY identity_key ORDER BY position) = 1),
    met AS (SELECT a.position AS pos, b.position AS other, a.kana = b.kana AS same, a.surface_key = '' OR b.surface_key = '' AS bare,
        a.surface_key = b.surface_key AND a.surface_key <> '' AND levenshtein(a.kana, b.kana) <= 1 AS near,
        CASE WHEN a.m = b.m THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END AS s
      FROM batch a JOIN batch b ON b.position < a.position AND (a.kana = b.kana OR a.surface_key = b.surface_key)),
    before AS (SELECT pos, list({'pos': other, 'agrees': bare AND s >= 0.45} ORDER BY other) FILTER (same) AS same,
        list({'pos': other, 'score': floor((0.55 + CASE WHEN same THEN 0.25 ELSE 0 END + 0.2 * s) * 1000 + 0.5000001) / 1000}) FILTER (near AND s >= 0.45) AS near
      FROM met GROUP BY 1),
    steps AS MATERIALIZED (SELECT row_number() OVER (ORDER BY position) AS i, position, exact_id, only_id, ex_id, score AS ex_score, store_n,
        kind = 'enrich' AS agrees, coalesce(same, []) AS same, coalesce(near, []) AS near FROM batch LEFT JOIN before ON pos = position),
    fold AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS position, '' AS kind, CAST(NULL AS BIGINT) AS existing_id, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS ins
      UNION ALL
      SELECT i, position, k,
        CASE k WHEN 'exact' THEN exact_id WHEN 'enrich' THEN CASE store_n WHEN 1 THEN only_id ELSE top + si[1].pos END
          WHEN 'review' THEN CASE WHEN coalesce(ex_score, 0) >= coalesce(ni.score, 0) THEN ex_id ELSE top + ni.pos END END,
        CASE WHEN k = 'review' THEN greatest(coalesce(ex_score, 0), coalesce(ni.score, 0)) END,
        CASE WHEN k = 'new' THEN list_append(ins, position) ELSE ins END
      FROM (SELECT *, CASE WHEN exact_id IS NOT NULL THEN 'exact'
          WHEN store_n + len(si) = 1 AND CASE store_n WHEN 1 THEN agrees ELSE si[1].agrees END THEN 'enrich'
          WHEN ex_id IS NOT NULL OR ni IS NOT NULL THEN 'review' ELSE 'new' END AS k
        FROM (SELECT s.*, f.ins, (SELECT max(id) + 1 FROM stored) AS top, list_filter(s.same, lambda x: list_contains(f.ins, x.pos)) AS si,
            list_sort(list_transform(list_filter(s.near, lambda x: list_contains(f.ins, x.pos)), lambda x: {'low': -x.score, 'pos': x.pos, 'score': x.score}))[1] AS ni
          FROM fold f JOIN steps s ON s.i = f.i + 1))),
    result AS (SELECT position, kind, existing_id, score FROM fold WHERE position IS NOT NULL)"""


def _ingest(select: str) -> str:
    return v.with_views("WITH " + MATCH.strip() + INGEST + "\n" + select.strip(), "vocab", "words", recursive=True)


GROWN = """
    SELECT r.id, replace(coalesce(canonical_key, k), chr(0), '|') AS canonical_key, coalesce(kanji, s) AS kanji, kana, coalesce(lesson, l) AS lesson
    FROM (SELECT id, canonical_key, kanji, kana, lesson FROM vocab
      UNION ALL SELECT (SELECT max(id) + 1 FROM stored) + position, identity_key, kanji, kana, lesson FROM result JOIN words USING (position) WHERE kind = 'new') r
    LEFT JOIN (SELECT existing_id AS id, max_by(identity_key, position) AS k, max_by(kanji, position) FILTER (kanji IS NOT NULL) AS s,
        max_by(lesson, position) FILTER (lesson IS NOT NULL) AS l
      FROM result JOIN words USING (position) WHERE kind IN ('exact', 'enrich') GROUP BY 1) u ON u.id = r.id"""

BLOCKS = """
    SELECT * FROM (SELECT id, CAST(coalesce(canonical_key, identity_key) IN (SELECT identity_key FROM words) AS BIGINT) AS by_key,
      CAST(kana IN (SELECT kana FROM words) AS BIGINT) AS by_reading,
      CAST(surface_key <> '' AND surface_key IN (SELECT surface_key FROM words) AS BIGINT) AS by_surface FROM vocab)
    WHERE by_key + by_reading + by_surface > 0"""

FUZZY = "SELECT surface_key, kana AS reading_key, m AS meaning_key, ex_id, distance, score FROM best"

DECISIONS = """
    SELECT position, kind, CASE kind WHEN 'exact' THEN exact_id WHEN 'enrich' THEN only_id WHEN 'review' THEN ex_id END AS existing_id,
      CASE WHEN kind = 'review' THEN score END AS score FROM decided"""

EXPLAINED = """
    SELECT position, ex_id AS existing_id, ex_kana AS candidate_reading,
      'same normalized kanji surface|kana edit distance ' || distance || '|compatible Burmese meaning (' || p || '%)' AS reasons,
      CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN distance = 0 AND s < 0.75 THEN 'high' ELSE 'medium' END AS collision_risk,
      'exact normalized match|edit distance ' || distance || '|' || p || '% character-bigram similarity' AS signals
    FROM (SELECT *, CAST(floor(s * 100 + 0.5) AS BIGINT) AS p FROM decided WHERE kind = 'review')"""

ENRICHED = """
    , updates AS (SELECT d.position, CASE kind WHEN 'exact' THEN exact_id ELSE only_id END AS id, d.identity_key, w.kanji, w.part_of_speech, w.example_sentence_jp, w.lesson
      FROM decided d JOIN words w USING (position) WHERE kind IN ('exact', 'enrich')),
    filled AS (SELECT id, max_by(identity_key, position) AS k, max_by(kanji, position) FILTER (kanji IS NOT NULL) AS s,
      max_by(part_of_speech, position) AS p, max_by(example_sentence_jp, position) AS e, max_by(lesson, position) FILTER (lesson IS NOT NULL) AS l FROM updates GROUP BY 1)
    SELECT vocab.id AS id, replace(coalesce(canonical_key, k), chr(0), '|') AS canonical_key, coalesce(kanji, s) AS kanji, coalesce(part_of_speech, p) AS part_of_speech,
      coalesce(example_sentence_jp, e) AS example_sentence_jp, coalesce(lesson, l) AS lesson FROM vocab LEFT JOIN filled ON filled.id = vocab.id"""

ABSENT = """
    WITH s AS (SELECT id, kana, romaji, lesson FROM vocab WHERE romaji IS NOT NULL)
    SELECT * FROM s UNION ALL
    SELECT position AS id, kana, 'new' AS romaji, lesson FROM words WHERE kana NOT IN (SELECT kana FROM s)
    QUALIFY row_number() OVER (PARTITION BY kana ORDER BY position) = 1"""

UPSERT = """
    SELECT w.position AS id, w.kana, 'new' AS romaji, coalesce(s.lesson, w.lesson) AS lesson
    FROM words w LEFT JOIN (SELECT * FROM vocab WHERE romaji IS NOT NULL) s ON s.id = w.position"""

DELETE = """
    WITH gone AS (SELECT id FROM vocab WHERE pdf_source LIKE 'File1%')
    SELECT 'word' AS kind, CAST(id AS VARCHAR) AS key, id AS ref FROM vocab WHERE pdf_source NOT LIKE 'File1%'
    UNION ALL SELECT 'progress', CAST(vocab_id AS VARCHAR), vocab_id FROM word_progress WHERE vocab_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'review', review_key, CASE WHEN candidate_id NOT IN (SELECT id FROM gone) THEN candidate_id END FROM reviews"""

GROUPED = """
    grouped AS (SELECT *, count(*) OVER (PARTITION BY identity_key) AS group_size,
      CAST(kanji IS NOT NULL AS BIGINT) + CAST(example_sentence_jp IS NOT NULL AS BIGINT) + CAST(id IN (SELECT vocab_id FROM word_progress) AS BIGINT) AS score FROM vocab),
    placed AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY score DESC, created_at, id) AS place FROM grouped WHERE group_size > 1)"""

GROUPS = "WITH " + GROUPED.strip() + " SELECT id, replace(identity_key, chr(0), '|') AS identity_key, group_size, score, place FROM placed"

REMOVED = "WITH " + GROUPED.strip() + " SELECT p.id, t.id AS target_id FROM placed p JOIN placed t ON t.identity_key = p.identity_key AND t.place = 1 WHERE p.id <> t.id"

# The receiver of an identity is the holder of its key, or the target of the first sound pair.
PAIRS = """
    low AS (SELECT identity_key, min(id) AS low, max(id) AS high FROM vocab GROUP BY 1),
    pairs AS (SELECT id AS position, CASE WHEN id % 50 = 7 THEN NULL ELSE id END AS source_id,
        CASE WHEN id % 3 = 0 THEN high WHEN id % 10 = 1 THEN id + 1 WHEN id % 40 = 9 THEN -id ELSE low END AS target_id FROM vocab JOIN low USING (identity_key)),
    looked AS (SELECT p.*, s.identity_key AS sk, t.identity_key AS tk,
        (SELECT min(h.id) FROM vocab h WHERE h.canonical_key = t.identity_key) AS holder
      FROM pairs p LEFT JOIN vocab s ON s.id = source_id LEFT JOIN vocab t ON t.id = target_id),
    judged AS (SELECT *, CASE WHEN source_id IS NULL OR target_id IS NULL OR source_id = target_id THEN 'invalid_rows'
        WHEN sk IS NULL OR tk IS NULL THEN 'row_not_found' WHEN sk <> tk THEN 'keys_differ' END AS error FROM looked),
    receivers AS (SELECT tk, min_by(target_id, position) AS first_target FROM judged WHERE error IS NULL GROUP BY 1),
    aimed AS (SELECT j.*, coalesce(holder, first_target) AS receiver FROM judged j LEFT JOIN receivers USING (tk)),
    taken AS (SELECT source_id AS gone, min(position) AS taken_at FROM aimed WHERE error IS NULL AND target_id = receiver GROUP BY 1),
    outcomes AS (SELECT position, source_id, target_id, tk, CASE WHEN error IN ('invalid_rows', 'row_not_found') THEN error
        WHEN EXISTS (SELECT 1 FROM taken WHERE gone IN (source_id, target_id) AND taken_at < position) THEN 'row_not_found'
        WHEN error IS NOT NULL THEN error WHEN target_id <> receiver THEN 'key_occupied' ELSE 'ok' END AS outcome FROM aimed)"""

OUTCOMES = "WITH " + PAIRS.strip() + " SELECT position, source_id, target_id, outcome FROM outcomes"

MERGED = "WITH " + PAIRS.strip() + """,
    ok AS (SELECT * FROM outcomes WHERE outcome = 'ok'),
    offers AS (SELECT target_id, any_value(tk) AS k, min_by(kanji, position) FILTER (kanji IS NOT NULL) AS a, min_by(romaji, position) FILTER (romaji IS NOT NULL) AS b,
        min_by(part_of_speech, position) FILTER (part_of_speech IS NOT NULL) AS c, min_by(example_sentence_jp, position) FILTER (example_sentence_jp IS NOT NULL) AS d,
        min_by(lesson, position) FILTER (lesson IS NOT NULL) AS e FROM ok JOIN vocab v ON v.id = source_id GROUP BY 1),
    study AS (SELECT coalesce(target_id, vocab_id) AS id, status, target_id IS NULL AS own, position FROM word_progress LEFT JOIN ok ON source_id = vocab_id),
    kept AS (SELECT id, status FROM study QUALIFY row_number() OVER (PARTITION BY id ORDER BY own DESC, position) = 1),
    linked AS (SELECT coalesce(target_id, candidate_id) AS id, count(*) AS n FROM reviews LEFT JOIN ok ON source_id = candidate_id GROUP BY 1)
    SELECT v.id, replace(coalesce(k, canonical_key), chr(0), '|') AS canonical_key, coalesce(kanji, a) AS kanji, kana, coalesce(romaji, b) AS romaji, burmese_meaning, jlpt_level,
      coalesce(part_of_speech, c) AS part_of_speech, coalesce(example_sentence_jp, d) AS example_sentence_jp, coalesce(lesson, e) AS lesson,
      kept.status AS progress_status, coalesce(n, 0) AS reviews
    FROM vocab v LEFT JOIN offers ON target_id = v.id LEFT JOIN kept ON kept.id = v.id LEFT JOIN linked ON linked.id = v.id
    WHERE v.id NOT IN (SELECT source_id FROM ok)"""

BATCH_MERGED = """
    WITH t AS (SELECT *, min(id) OVER (PARTITION BY identity_key) AS target, count(*) OVER (PARTITION BY identity_key) AS n FROM vocab),
    o AS (SELECT target, min_by(romaji, id) FILTER (romaji IS NOT NULL) AS r, min_by(lesson, id) FILTER (lesson IS NOT NULL) AS l FROM t WHERE id <> target GROUP BY 1)
    SELECT id, CASE WHEN n > 1 THEN replace(identity_key, chr(0), '|') END AS canonical_key, coalesce(romaji, r) AS romaji, coalesce(lesson, l) AS lesson
    FROM t LEFT JOIN o USING (target) WHERE id = target"""

OVER_LIMIT = """
    SELECT id AS source_id, target AS target_id, 'request_over_limit' AS outcome
    FROM (SELECT id, min(id) OVER (PARTITION BY identity_key) AS target FROM vocab) WHERE id <> target"""

BACKFILL = """
    SELECT id, CASE WHEN max(n) OVER () > 1 THEN replace(canonical_key, chr(0), '|') ELSE replace(identity_key, chr(0), '|') END AS canonical_key,
      CASE WHEN n > 1 THEN n END AS group_size FROM (SELECT *, count(*) OVER (PARTITION BY identity_key) AS n FROM vocab)"""

BACKFILL_UNIQUE = "SELECT id, replace(identity_key, chr(0), '|') || '-' || id AS canonical_key FROM vocab"

QUERIES = {
    "block_candidates": (block_candidates, v.with_views(BLOCKS, "vocab", "words")),
    "fuzzy_candidates": (fuzzy_candidates, _match(FUZZY)),
    "match_decisions": (match_decisions, _match(DECISIONS)),
    "match_explanations": (match_explanations, _match(EXPLAINED)),
    "enrich": (enrich, _match(ENRICHED)),
    "ingest_decisions": (ingest_decisions, _ingest("SELECT * FROM result")),
    "ingest_counts": (ingest_counts, _ingest("""SELECT count(*) FILTER (kind = 'new') AS inserted, count(*) FILTER (kind = 'review') AS reviewed,
        count(*) FILTER (kind = 'enrich') AS enriched, count(*) FILTER (kind = 'exact') AS exact FROM result""")),
    "insert_absent": (insert_absent, v.with_views(ABSENT, "vocab", "words")),
    "upsert": (upsert, v.with_views(UPSERT, "vocab", "words")),
    "delete_cascade": (delete_cascade, v.with_views(DELETE, "vocab", "word_progress", "reviews")),
    "collision_groups": (collision_groups, v.with_views(GROUPS, "vocab", "word_progress")),
    "rows_to_remove": (rows_to_remove, v.with_views(REMOVED, "vocab", "word_progress")),
    "merge_outcomes": (merge_outcomes, v.with_views(OUTCOMES, "vocab")),
    "merge_collisions": (merge_collisions, v.with_views(MERGED, "vocab", "word_progress", "reviews")),
    "merge_collision_batch": (merge_collision_batch, v.with_views(BATCH_MERGED, "vocab")),
    "merge_batch_over_limit": (merge_batch_over_limit, v.with_views(OVER_LIMIT, "vocab")),
    "backfill_keys": (backfill_keys, v.with_views(BACKFILL, "vocab")),
    "backfill_unique": (backfill_unique, v.with_views(BACKFILL_UNIQUE, "vocab")),
}
