"""Entity resolution of incoming words against a stored vocabulary.

No step pairs all members of a large group.  Exact and enrich look at most one stored row up per
word, from aggregates keyed by identity and by reading.  Review compares words only with rows
that share the surface and a deletion variant of the reading, in hot blocks list by list, and keeps the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import with_identity
from ..functions.similarity import (
    MIN_SIMILARITY, deletion_variants, key_bigrams, key_similarity, meaning_key,
)
from ..functions.text import let
from ..session import cut_lineage

# Weights of a review score, its bands, and the explanation texts.
SURFACE_WEIGHT, READING_WEIGHT, MEANING_WEIGHT = 0.55, 0.25, 0.2
HIGH_SCORE, MEDIUM_SCORE, RISKY_SIMILARITY = 0.85, 0.7, 0.75
ENRICH_REASON = "same normalized reading and one record lacks a kanji surface"
SAME_READING_SUMMARY = (
    "The Japanese surface and reading agree; confirm whether the translation represents the same learner entry."
)
NEAR_READING_SUMMARY = (
    "The Japanese surface agrees and the reading differs by one character, "
    "which is consistent with a possible OCR error."
)
SIGNAL_LABELS = ("Kanji surface", "Kana reading", "Burmese meaning")
SURFACE_SIGNAL, READING_SIGNAL, MEANING_SIGNAL = "exact normalized match", "edit distance ", "% character-bigram similarity"
REVIEW_REASONS = ("same normalized kanji surface", "kana edit distance ", "compatible Burmese meaning (", "%)")

#: Stored rows of a list that a word is compared with in one row.
CHUNK = 256


def stored_keys(vocab: DataFrame) -> DataFrame:
    """Vocabulary with its keys; ``stored_key`` is the saved key, else the computed one."""
    keyed = with_identity(vocab)
    return keyed.withColumns({
        "stored_key": F.coalesce(F.nullif("canonical_key", F.lit("")), F.col("identity_key")),
        "meaning_key": meaning_key("burmese_meaning"),
    })


def incoming_keys(incoming: DataFrame) -> DataFrame:
    return with_identity(incoming).withColumn("meaning_key", meaning_key("burmese_meaning"))


def block_candidates(incoming: DataFrame, vocab: DataFrame) -> DataFrame:
    """Stored rows that share the stored key, the reading or the surface with an incoming word.

    Three semi-joins on distinct keys, never one join with OR; linear in both inputs.
    Columns: id, by_key, by_reading, by_surface.
    """
    words = incoming_keys(incoming).select("identity_key", "surface_key", "reading_key")
    rows = stored_keys(vocab).select("id", "stored_key", "surface_key", "reading_key")

    def hits(stored: str, word: str, flag: str) -> DataFrame:
        keys = words.filter(F.col(word) != "").select(F.col(word).alias(stored)).distinct()
        return rows.join(keys, stored, "left_semi").select("id", F.lit(flag).alias("flag"))

    found = (
        hits("stored_key", "identity_key", "key")
        .unionByName(hits("reading_key", "reading_key", "reading"))
        .unionByName(hits("surface_key", "surface_key", "surface"))
    )
    flags = [F.bool_or(F.col("flag") == f).alias(f"by_{f}") for f in ("key", "reading", "surface")]
    return found.groupBy("id").agg(*flags)


def _variants(df: DataFrame) -> DataFrame:
    return df.withColumn("variants", deletion_variants("reading_key")).withColumn("variant", F.explode("variants"))


def _rare_tokens(df: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the prefix tokens of each meaning.

    With tokens in one global order, rarest first, two sets of Jaccard similarity >= t share a
    token among the first size - ceil(t * size) + 1 of each; the whole key stands in for it
    when two meanings are equal.
    """
    tokens = df.select(*keys, F.explode("grams").alias("gram"))
    ranked = tokens.join(frequency, "gram", "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("sorted"))
    size = F.size("sorted")
    keep = size - F.ceil(size * F.lit(MIN_SIMILARITY) - F.lit(1e-9)).cast("int") + 1
    prefix = F.transform(F.slice("sorted", F.lit(1), keep), lambda t: t["gram"])
    out = df.join(ranked, keys, "left").withColumn("tokens", F.concat(
        F.coalesce(prefix, F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "meaning_key"))))
    return out.drop("sorted")


def _listed(side: DataFrame, hot: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``token``: empty in a block that is not hot; in a hot one a row for each rare token, with all of them as ``tokens``."""
    block = ["surface_key", "variant"]
    inside = side.join(hot, block, "left_semi")
    tokens = _rare_tokens(inside.select(*keys, "grams").distinct(), frequency, keys).select(*keys, "tokens")
    cold = side.join(hot, block, "left_anti").withColumns({"token": F.lit(""), "tokens": F.lit(None).cast("array<string>")})
    return cold.unionByName(inside.join(tokens, keys).withColumn("token", F.explode("tokens")))


def fuzzy_pairs(words: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Compatible pairs with equal surface and reading distance <= 1, each once.

    Both sides are distinct (surface_key, reading_key, meaning_key) triples; ``rows`` also has
    ``ex_id``.  Members of a block (surface and deletion variant) meet there, in one of more than ``chunk`` rows only
    at a shared rare token of their meanings, and a pair counts only where it first does.
    Columns: those of ``words``, ex_id, ex_reading, distance, similarity.
    """
    keys, block = ["surface_key", "reading_key", "meaning_key"], ["surface_key", "variant"]
    words, rows = (_variants(df.withColumn("grams", key_bigrams("meaning_key"))).drop("variants") for df in (words, rows))
    given = [c for c in words.columns if c not in ("grams", "variant")]
    hot = cut_lineage(rows.groupBy(*block).count().filter(F.col("count") > chunk).select(*block))
    frequency = (
        rows.join(hot, block, "left_semi").select(*keys, F.explode("grams").alias("gram")).distinct()
        .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    words, rows = (_listed(df, hot, frequency, keys) for df in (words, rows))
    stored = rows.select(
        *block, "token", "ex_id", F.col("reading_key").alias("ex_reading"), F.col("meaning_key").alias("ex_meaning"),
        F.col("grams").alias("ex_grams"), F.col("tokens").alias("ex_tokens"))
    similarity = key_similarity(F.col("meaning_key"), F.col("ex_meaning"), F.col("grams"), F.col("ex_grams"))
    first = lambda x, y: F.array_min(F.array_intersect(x, y))
    met_first = (F.col("variant") == first(deletion_variants("reading_key"), deletion_variants("ex_reading"))) & (
        (F.col("token") == "") | (F.col("token") == first("tokens", "ex_tokens")))
    return (
        words.join(stored, [*block, "token"])
        .filter(F.levenshtein("reading_key", "ex_reading", 1) >= 0)
        .withColumn("similarity", similarity)
        .filter((F.col("similarity") >= MIN_SIMILARITY) & met_first)
        .select(*given, "ex_id", "ex_reading", F.levenshtein("reading_key", "ex_reading", 1).alias("distance"), "similarity")
    )


def review_score(distance: Column, similarity: Column) -> Column:
    agree = F.when(distance == 0, F.lit(READING_WEIGHT)).otherwise(F.lit(0.0))
    return F.round(F.lit(SURFACE_WEIGHT) + agree + F.lit(MEANING_WEIGHT) * similarity, 3)


def _triples(incoming: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct triples of the words, and of the rows with the lowest id of each (``ex_id``)."""
    keys = ["surface_key", "reading_key", "meaning_key"]
    whole = (F.col("surface_key") != "") & (F.col("meaning_key") != "")
    return incoming.filter(whole).select(*keys).distinct(), vocab.filter(whole).groupBy(*keys).agg(F.min("id").alias("ex_id"))


def _block(variant: str) -> Column:
    """A block, surface and deletion variant, as eight bytes; blocks of one hash are told apart by whoever joins them."""
    return F.xxhash64("surface_key", variant).alias("_block")


def _met_lists(incoming: DataFrame, vocab: DataFrame, chunk: int, within: DataFrame | None = None) -> DataFrame:
    """Words (triple, grams) with each list of stored rows (``held``) that may have a row near them.

    A block is a surface and a deletion variant of the reading.  The rows of a block of at most ``chunk`` are one list.  In a
    larger one only rows that share a rare token of the meaning can reach the least similarity (``_rare_tokens``),
    so there a row is in the list of each of its rare tokens, a word meets the lists of its own ones, and all others are
    skipped.  Lists are dealt into parts of about ``chunk`` by a hash, so a hot block is spread over many tasks.
    ``within``: the blocks to look at (``_block``), all by default.
    """
    keys, block = ["surface_key", "reading_key", "meaning_key"], ["surface_key", "variant"]

    def members(df: DataFrame) -> DataFrame:
        each = _variants(df).drop("variants")
        inside = each if within is None else each.withColumn("_block", _block("variant")).join(within, "_block", "left_semi").drop("_block")
        return cut_lineage(inside.withColumn("grams", key_bigrams("meaning_key")))

    asked, held = (members(df) for df in _triples(incoming, vocab))
    hot = cut_lineage(held.groupBy(*block).count().filter(F.col("count") > chunk).select(*block))
    frequency = (
        held.join(hot, block, "left_semi").select(*keys, F.explode("grams").alias("gram")).distinct()
        .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    asked, held = (_listed(df, hot, frequency, keys).drop("tokens") for df in (asked, held))
    by = [*block, "token"]
    sizes = held.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_lists"))
    lists = (
        held.join(sizes, by).groupBy(*by, F.expr("pmod(xxhash64(ex_id), _lists)").alias("_list"))
        .agg(F.collect_list(F.struct("ex_id", F.col("reading_key").alias("r"), F.col("meaning_key").alias("m"), "grams")).alias("held"))
    )
    return asked.join(lists, by).select(*keys, "grams", "held")


def _nearest_in_lists(met: DataFrame) -> DataFrame:
    """Best row (``best``) of each list that a word meets.

    Within a list a row whose reading is further off, or whose meaning is too short or too long, is passed over unmeasured.
    """
    def judged(x: Column) -> Column:
        distance = F.levenshtein("reading_key", x["r"], 1)
        mine, its = F.size("grams"), F.size(x["grams"])
        possible = (F.least(mine, its) >= F.greatest(mine, its) * F.lit(MIN_SIMILARITY) - F.lit(1e-9)) | (F.col("meaning_key") == x["m"])

        def scored(d: Column) -> Column:
            near = let(key_similarity(F.col("meaning_key"), x["m"], F.col("grams"), x["grams"]), lambda n: _ranked(x["ex_id"], x["r"], d, n))
            return F.when((d >= 0) & possible, near)

        return let(distance, scored)

    return met.select("surface_key", "reading_key", "meaning_key", F.array_min(F.transform("held", judged)).alias("best"))


def _ranked(ex_id: Column, ex_reading: Column, distance: Column, similarity: Column) -> Column:
    """Candidate whose least value is the best one; null below the least similarity."""
    score = review_score(distance, similarity)
    return F.when(similarity >= MIN_SIMILARITY, F.struct(
        (-score).alias("order"), ex_id.alias("ex_id"), ex_reading.alias("ex_reading"),
        distance.alias("distance"), similarity.alias("similarity"), score.alias("score")))


def _near_pairs(words: DataFrame, rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Words with each row (ex_id, ex_reading, ex_meaning) of their blocks, but of ``hot`` ones, whose reading is within one edit.

    What is shuffled for a block is its hash and the row's texts, no bigrams.  Equal readings share all their variants and
    count at the reading itself only; others may meet twice.
    """
    def members(df: DataFrame) -> DataFrame:
        each = df.withColumn("_variant", F.explode(deletion_variants("reading_key")))
        return each.withColumns({"_block": _block("_variant"), "_own": F.col("_variant") == F.col("reading_key")}).drop("_variant")

    held = members(rows).select(
        "_block", "ex_id", F.col("surface_key").alias("_surface"), F.col("reading_key").alias("ex_reading"), F.col("meaning_key").alias("ex_meaning"))
    once = F.col("_own") | (F.col("reading_key") != F.col("ex_reading"))
    asked = members(words)
    if hot is not None:
        asked = asked.join(hot, "_block", "left_anti")
    met = asked.join(held, "_block").filter((F.col("surface_key") == F.col("_surface")) & once)
    return met.filter(F.levenshtein("reading_key", "ex_reading", 1) >= 0).drop("_block", "_own", "_surface")


def fuzzy_candidates(incoming: DataFrame, vocab: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Best review candidate of each distinct word triple: highest score, then lowest id.

    In a block of at most ``chunk`` rows a word meets them one by one.  In a larger one it meets lists of rows that share a rare
    token and keeps its best of each, so what is joined there grows with words and lists and not with pairs.
    """
    keys = ["surface_key", "reading_key", "meaning_key"]
    words, rows = (cut_lineage(df) for df in _triples(incoming, vocab))
    variants = rows.select("surface_key", F.explode(deletion_variants("reading_key")).alias("variant"))
    hot = cut_lineage(variants.select(_block("variant")).groupBy("_block").count().filter(F.col("count") > chunk).select("_block"))

    def similar(distance: Column) -> Column:
        grams = F.struct(key_bigrams("meaning_key").alias("x"), key_bigrams("ex_meaning").alias("y"))
        measured = let(grams, lambda g: key_similarity(F.col("meaning_key"), F.col("ex_meaning"), g["x"], g["y"]))
        similarity = F.when(F.col("meaning_key") == F.col("ex_meaning"), F.lit(1.0)).otherwise(measured)
        return let(similarity, lambda n: _ranked(F.col("ex_id"), F.col("ex_reading"), distance, n))

    some_hot = not hot.isEmpty()
    pairs = _near_pairs(words, rows, hot if some_hot else None)
    best = pairs.select(*keys, similar(F.levenshtein("reading_key", "ex_reading", 1)).alias("best"))
    if some_hot:
        best = best.unionByName(_nearest_in_lists(_met_lists(words, rows.withColumnRenamed("ex_id", "id"), chunk, hot)))
    top = best.groupBy(*keys).agg(F.min("best").alias("best")).filter("best is not null")
    return top.select(*keys, F.struct(*[f"best.{c}" for c in ("ex_id", "ex_reading", "distance", "similarity", "score")]).alias("fuzzy"))


def explain(df: DataFrame) -> DataFrame:
    """Add reasons and explanation to review decisions."""
    pct = F.round(F.col("similarity") * 100).cast("int").cast("string")
    distance = F.col("distance").cast("string")
    signal = lambda label, value, weight, positive: F.struct(
        F.lit(label).alias("label"), value.alias("value"), F.lit(weight).alias("weight"), positive.alias("positive"))
    same = F.col("distance") == 0
    review = F.col("kind") == "review"
    explanation = F.struct(
        F.when(same, SAME_READING_SUMMARY).otherwise(NEAR_READING_SUMMARY).alias("summary"),
        F.when(F.col("score") >= HIGH_SCORE, "high").when(F.col("score") >= MEDIUM_SCORE, "medium")
        .otherwise("low").alias("confidence"),
        F.array(
            signal(SIGNAL_LABELS[0], F.lit(SURFACE_SIGNAL), SURFACE_WEIGHT, F.lit(True)),
            signal(SIGNAL_LABELS[1], F.concat(F.lit(READING_SIGNAL), distance), READING_WEIGHT, same),
            signal(SIGNAL_LABELS[2], F.concat(pct, F.lit(MEANING_SIGNAL)), MEANING_WEIGHT, F.lit(True)),
        ).alias("signals"),
        F.struct(F.col("surface_key").alias("surface"), F.col("reading_key").alias("reading")).alias("normalized_incoming"),
        F.struct(F.col("surface_key").alias("surface"), F.col("ex_reading").alias("reading")).alias("normalized_candidate"),
        F.when(same & (F.col("similarity") < RISKY_SIMILARITY), "high").otherwise("medium").alias("collision_risk"),
    )
    reasons = F.array(
        F.lit(REVIEW_REASONS[0]), F.concat(F.lit(REVIEW_REASONS[1]), distance),
        F.concat(F.lit(REVIEW_REASONS[2]), pct, F.lit(REVIEW_REASONS[3])),
    )
    return df.withColumns({
        "reasons": F.when(review, reasons).when(F.col("kind") == "enrich", F.array(F.lit(ENRICH_REASON))),
        "explanation": F.when(review, explanation),
    })


def lookups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row per stored key, and the only row of every reading that has just one."""
    by_key = rows.groupBy("stored_key").agg(F.min("id").alias("exact_id"))
    by_reading = (
        rows.groupBy("reading_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("only_id"),
             F.min("surface_key").alias("only_surface"), F.min("meaning_key").alias("only_meaning"))
        .filter(F.col("_n") == 1).drop("_n")
    )
    return by_key, by_reading


def meanings_agree(left: str, right: str) -> Column:
    """Compatible meaning keys."""
    grams = F.struct(key_bigrams(left).alias("x"), key_bigrams(right).alias("y"))
    return let(grams, lambda g: key_similarity(F.col(left), F.col(right), g["x"], g["y"])) >= MIN_SIMILARITY


def decide(incoming: DataFrame, vocab: DataFrame, chunk: int = CHUNK, explained: bool = True) -> DataFrame:
    """Decision per incoming word: exact, enrich, review or new.

    ``vocab`` has id, canonical_key, kanji, kana and burmese_meaning.  Adds kind, existing_id,
    score, distance, similarity and, unless told otherwise, reasons and explanation.
    """
    # Four aggregates read the stored keys; they are computed once, into the checkpoint folder.
    rows = cut_lineage(stored_keys(vocab).select("id", "stored_key", "surface_key", "reading_key", "meaning_key"))
    return decide_keyed(incoming_keys(incoming), rows, chunk, explained)


def decide_keyed(words: DataFrame, rows: DataFrame, chunk: int = CHUNK, explained: bool = True) -> DataFrame:
    """``decide`` for words and rows that carry their keys."""
    by_key, by_reading = lookups(rows)
    one_bare = (F.col("surface_key") == "") | (F.col("only_surface") == "")
    # Both the review of the open words and the decisions start from here.
    looked_up = cut_lineage(
        words.join(by_key, F.col("identity_key") == F.col("stored_key"), "left").drop("stored_key")
        .join(by_reading, "reading_key", "left")
        .withColumn("enriches", F.coalesce(one_bare & meanings_agree("meaning_key", "only_meaning"), F.lit(False)))
    )
    open_words = looked_up.filter(F.col("exact_id").isNull() & ~F.col("enriches"))
    fuzzy = fuzzy_candidates(open_words, rows, chunk)
    joined = looked_up.join(fuzzy, ["surface_key", "reading_key", "meaning_key"], "left")
    kind = (
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("enriches"), "enrich")
        .when(F.col("fuzzy").isNotNull(), "review").otherwise("new")
    )
    decided = joined.withColumn("kind", kind).withColumns({
        "existing_id": F.when(F.col("kind") == "exact", F.col("exact_id"))
        .when(F.col("kind") == "enrich", F.col("only_id")).when(F.col("kind") == "review", F.col("fuzzy.ex_id")),
        **{c: F.when(F.col("kind") == "review", F.col(f"fuzzy.{c}"))
           for c in ("score", "distance", "similarity", "ex_reading")},
    }).drop("exact_id", "only_id", "only_surface", "only_meaning", "enriches", "fuzzy")
    return (explain(decided) if explained else decided).drop("ex_reading")


# The fields an enrichment may fill.
ENRICH_FIELDS = (
    "canonical_key", "kanji", "romaji", "part_of_speech", "example_sentence_jp", "example_sentence_mm", "lesson",
)


def enrich(vocab: DataFrame, updates: DataFrame) -> DataFrame:
    """Fill the empty fields of stored rows.

    ``updates`` holds existing_id, position, identity_key and word fields; when several fill
    one field, the last by position wins.
    """
    def usable(c: str) -> Column:
        value = F.col("identity_key" if c == "canonical_key" else c)
        return value != (0 if c == "lesson" else "")

    filled = updates.groupBy(F.col("existing_id").alias("id")).agg(*[
        F.max_by("identity_key" if c == "canonical_key" else c, F.when(usable(c), F.col("position"))).alias(f"_{c}")
        for c in ENRICH_FIELDS
    ])
    joined = vocab.join(filled, "id", "left")
    empty = {c: (F.col(c).isNull() | (F.col(c) == (0 if c == "lesson" else ""))) for c in ENRICH_FIELDS}
    return joined.withColumns({
        c: F.when(empty[c], F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in ENRICH_FIELDS
    }).select(*vocab.columns)
