"""Dictionary lookups for text tokens, and words added from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.identity import join_keys, norm_surface, reading_key, surface_key, with_identity
from ..functions.text import CJK, contains_script, fold_kana, js_trim, simple_romaji
from ..session import cut_lineage
from .library import first_rows

# Dictionary rows of the reader, and what an unknown token becomes.
READER_ROWS = 800
UNTRANSLATED, UNKNOWN_POS, READER_SOURCE = "（未翻訳）", "不明", "reader"


def tokens_of(texts: DataFrame, text: str = "text", pattern: str = r"\P{L}+") -> DataFrame:
    """Distinct tokens of all texts with their number of occurrences.

    Counted before any lookup, so a frequent token is one row.
    """
    words = texts.select(F.explode(F.split(F.lower(text), pattern)).alias("surface")).filter("surface != ''")
    return words.groupBy("surface").agg(F.count(F.lit(1)).alias("occurrences"))


def dictionary(vocab: DataFrame, keep: str = "first") -> DataFrame:
    """One word per lookup key; keys are the folded reading and the surface.

    When several words share a key, the ``first`` (reader) or ``last`` (tooltip) by creation wins.
    """
    keys = F.array(fold_kana("kana"), F.when(F.col("kanji") != "", F.col("kanji")))
    entries = vocab.select(
        F.explode(keys).alias("key"),
        F.struct("created_at", "id").alias("at"),
        F.struct("id", "kanji", "kana", "romaji", "burmese_meaning", "jlpt_level").alias("word"),
    ).filter(F.col("key").isNotNull())
    pick = F.min_by if keep == "first" else F.max_by
    return entries.groupBy("key").agg(pick("word", "at").alias("word"))


def gloss(tokens: DataFrame, vocab: DataFrame, keep: str = "first", cap: int | None = None) -> DataFrame:
    """Word of each token (surface, optional reading): by surface first, else by folded reading.

    Unmatched tokens stay.  Adds kana, romaji, meaning, level, word_id and covered.  ``cap``
    takes the oldest rows as the dictionary, which the reader does with 800.
    """
    words = dictionary(vocab if cap is None else first_rows(vocab, cap), keep)
    if "reading" not in tokens.columns:
        tokens = tokens.withColumn("reading", F.lit(None).cast("string"))
    tokens = tokens.withColumn("reading", fold_kana("reading"))
    by_surface = words.select(F.col("key").alias("surface"), F.col("word").alias("_s"))
    by_reading = words.select(F.col("key").alias("reading"), F.col("word").alias("_r"))
    joined = tokens.join(by_surface, "surface", "left").join(by_reading, "reading", "left")
    word = F.coalesce("_s", "_r")
    kana = F.coalesce(word["kana"], F.col("reading"), F.col("surface"))
    return joined.withColumns({"_w": word, "kana": kana}).select(
        *tokens.columns, F.col("_w.id").alias("word_id"), "kana",
        F.coalesce("_w.romaji", simple_romaji("kana")).alias("romaji"),
        F.col("_w.burmese_meaning").alias("burmese_meaning"), F.col("_w.jlpt_level").alias("jlpt_level"),
        F.col("_w").isNotNull().alias("covered"),
    )


def token_requests(tokens: DataFrame) -> DataFrame:
    """Add-word requests for tokens: the surface only when it has an ideograph."""
    reading = fold_kana("reading") if "reading" in tokens.columns else F.lit(None).cast("string")
    pos = F.col("part_of_speech") if "part_of_speech" in tokens.columns else F.lit(None).cast("string")
    return tokens.withColumns({
        "kanji": F.when(contains_script("surface", CJK), F.col("surface")),
        "kana": F.coalesce(reading, F.col("surface")), "burmese_meaning": F.lit(UNTRANSLATED),
        "jlpt_level": F.lit("N5"), "part_of_speech": F.coalesce(pos, F.lit(UNKNOWN_POS)),
    })


#: Request positions that are judged together; a reading's requests are cut into runs of as many.
RUN_REQUESTS = 16384


def _key_holders(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who holds which key before the requests.

    Returns (readings, holders).  ``readings``: reading_key, bare (rows without a surface), x (the only such row, if there is
    one), b_all, b_other.  ``holders``: reading_key, identity_key, first, other.  Both give the first holder of a key (``b_``: of the
    key of the bare reading) and the first one besides x.  A row holds its computed key and its saved one; a saved key may
    name another reading, of which the row is a holder too.
    """
    stored = with_identity(vocab).withColumn("saved", F.nullif("canonical_key", F.lit("")))
    bare = stored.filter("surface_key = ''").groupBy("reading_key").agg(F.count(F.lit(1)).alias("bare"), F.min("id").alias("x"))
    bare = bare.withColumn("x", F.when(F.col("bare") == 1, F.col("x")))
    own = stored.select("reading_key", "id", F.explode(F.array_distinct(F.array("identity_key", F.coalesce("saved", "identity_key")))).alias("identity_key"))
    named = F.regexp_extract("saved", r"(?s)reading:(.*)$", 1)
    strays = stored.filter(F.col("saved").isNotNull() & (named != F.col("reading_key"))).select(
        named.alias("reading_key"), "id", F.col("saved").alias("identity_key"))
    held = own.unionByName(strays).join(bare, "reading_key", "left")
    besides = F.when(F.coalesce(F.col("id") != F.col("x"), F.lit(True)), F.col("id"))
    holders = held.groupBy("reading_key", "identity_key").agg(F.min("id").alias("first"), F.min(besides).alias("other"))
    plain = holders.filter(F.col("identity_key") == F.concat(F.lit("reading:"), "reading_key")).select(
        "reading_key", F.col("first").alias("b_all"), F.col("other").alias("b_other"))
    return bare.join(plain, "reading_key", "full_outer"), holders


def _standing(events: DataFrame, run_size: int) -> DataFrame:
    """For each event (reading_key, position, miss): whether the reading had a miss before, and the first bare request since the last one.

    A miss is a request with a surface that no row holds.  What a run of requests does to the row that the next miss completes
    is a small map: with a miss in it, the first bare request after its last miss; without one, what was there
    before, or else its first bare request.  So runs are summarised on their own, carried over, and completed inside.
    """
    miss, at = F.col("miss"), F.col("position")
    run = ["reading_key", "run"]
    rows = events.withColumn("run", F.floor(at / run_size)).withColumn("part", F.count(F.when(miss, 1)).over(
        Window.partitionBy(*run).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("since", F.min(F.when(~miss, at)).over(
        Window.partitionBy(*run, "part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)))
    # the first bare request of a run's last part is what the run leaves, if that part comes after its last miss
    ends = rows.groupBy(*run).agg(
        F.count_if(miss).alias("misses"), F.max(F.when(~miss, F.struct("part", (-at).alias("back")))).alias("bare"))
    left = ends.select(*run, "misses", F.when(F.col("bare.part") == F.col("misses"), -F.col("bare.back")).alias("left"))
    runs = Window.partitionBy("reading_key").orderBy("run")
    upto = (Window.unboundedPreceding, 0)
    carried = left.withColumn("stretch", F.count_if(F.col("misses") > 0).over(runs.rowsBetween(*upto)))
    carried = carried.withColumn("open", F.min("left").over(Window.partitionBy("reading_key", "stretch").orderBy("run").rowsBetween(*upto)))
    entries = carried.select(
        *run, F.lag("open").over(runs).alias("_open"), (F.coalesce(F.lag("stretch").over(runs), F.lit(0)) > 0).alias("_missed"))
    fresh = F.col("part") == 0
    return rows.join(entries, run).select(
        "position", (~fresh | F.col("_missed")).alias("missed"),
        F.when(fresh, F.coalesce("_open", "since")).otherwise(F.col("since")).alias("since"))


def _judge_requests(turns: DataFrame, vocab: DataFrame, run_size: int) -> DataFrame:
    """position, outcome, existing (id of the row found), made (position of the request that made it).

    ``turns``: position, reading_key, identity_key, surfaced; of requests with a surface, the first of each key.  Such a request
    finds a stored row, or it is a miss.  A reading with several rows without a surface, or with other holders of its bare key, answers alike
    all the time.  Otherwise a bare request leaves one row that the next miss completes: the row's stored one (x) up to the
    first miss, then what ``_standing`` says.
    """
    readings, holders = _key_holders(vocab)
    known = turns.join(readings, "reading_key", "left").join(holders, ["reading_key", "identity_key"], "left")
    surfaced, one = F.col("surfaced"), F.col("x").isNotNull()
    first_miss = known.filter(surfaced & one & F.col("first").isNull()).groupBy("reading_key").agg(F.min("position").alias("p0"))
    known = known.join(first_miss, "reading_key", "left")
    freed = one & F.coalesce(F.col("position") > F.col("p0"), F.lit(False))  # x has its surface, and its old keys are free
    holder = F.when(freed, F.col("other")).otherwise(F.col("first"))
    many = F.coalesce(F.col("bare") >= 2, F.lit(False))
    steady = many | (~one & F.col("b_all").isNotNull()) | (freed & F.col("b_other").isNotNull())
    known = cut_lineage(known.select(
        "position", "reading_key", "surfaced", "x", holder.alias("holder"), steady.alias("steady"),
        (F.col("position") == F.col("p0")).alias("takes_x"), (surfaced & holder.isNull()).alias("miss")))
    alternating = known.filter(~F.col("steady") & (F.col("miss") | ~F.col("surfaced"))).select("reading_key", "position", "miss")
    judged = known.join(_standing(alternating, run_size), "position", "left")
    stored_one = F.col("x").isNotNull() & ~F.coalesce("missed", F.lit(False))
    standing = stored_one | F.col("since").isNotNull()
    held = F.col("holder").isNotNull()
    outcome = (
        F.when(F.col("reading_key") == "", "invalid")
        .when(held & (F.col("surfaced") | F.col("steady") | stored_one), "existing")
        .when(F.coalesce("takes_x", F.lit(False)), "completed").when(F.col("steady"), "created")
        .when(standing, F.when(F.col("miss"), "completed").otherwise("existing")).otherwise("created")
    )
    none = F.lit(None)
    judged = judged.withColumn("outcome", outcome)
    by_made = F.col("outcome").isin("existing", "completed") & ~F.col("steady") & F.col("since").isNotNull() & ~stored_one & (F.col("miss") | ~F.col("surfaced"))
    id_ = F.when(by_made, none).when(F.col("outcome") == "existing", F.col("holder")).when(F.col("outcome") == "completed", F.col("x"))
    return judged.select("position", "outcome", id_.alias("existing"), F.when(by_made, F.col("since")).alias("made"))


def add_words(
    requests: DataFrame, vocab: DataFrame, now: str = "2024-01-01 00:00:00", new_id: Column | None = None,
    run_size: int = RUN_REQUESTS,
) -> tuple[DataFrame, DataFrame]:
    """Outcome of each request against the words that stand when its turn comes, and the next vocabulary.

    ``requests``: position (unique) and word fields.  A request is ``existing`` when its identity
    is held, ``completed`` when exactly one row has its reading and no surface (that row takes the
    key and surface, be it stored or made by an earlier request), ``created`` otherwise and
    ``invalid`` without a reading.  ``existing_id`` is null for rows made by these requests.  A
    created word gets its start row of progress from ``learning.ensure_progress``.

    Requests of a reading depend on each other only; of requests with one surface only the first of a key is
    asked, the others follow from it.  A reading's requests are judged in runs of ``run_size`` positions by many tasks.
    """
    asked = requests.withColumns({
        "reading_key": reading_key(F.coalesce("kana", F.lit(""))), "surface": norm_surface("kanji"),
        "surface_key": surface_key("kanji"),
    }).withColumn("identity_key", join_keys(F.col("surface_key"), F.col("reading_key")))
    surfaced = F.col("surface_key") != ""
    first = asked.groupBy("identity_key").agg(F.min("position").alias("_first"))
    leading = asked.join(first, "identity_key").filter(~surfaced | (F.col("position") == F.col("_first")))
    turns = leading.select(F.col("position").cast("long").alias("position"), "reading_key", "identity_key", surfaced.alias("surfaced"))
    outcomes = cut_lineage(_judge_requests(turns, vocab, run_size))
    # what a later request of a surfaced key finds is the row that the first one found or made
    led = outcomes.withColumnsRenamed({"position": "_first", "outcome": "_outcome"})
    judged = asked.join(first, "identity_key").withColumn(
        "_at", F.when(surfaced, F.col("_first")).otherwise(F.col("position"))).drop("_first")
    judged = judged.join(led, judged["_at"] == led["_first"]).withColumns({
        "outcome": F.when((F.col("position") != F.col("_at")) & (F.col("_outcome") != "invalid"), "existing").otherwise(F.col("_outcome")),
        "existing_id": F.col("existing").cast(vocab.schema["id"].dataType),
    }).drop("_at", "_first", "_outcome", "existing")
    completed = judged.filter("outcome = 'completed'")
    done = completed.filter("existing_id is not null").groupBy(F.col("existing_id").alias("id")).agg(
        F.max_by("identity_key", "position").alias("_key"),
        F.max_by("surface", F.when(F.col("surface") != "", F.col("position"))).alias("_surface"))
    filled = vocab.join(done, "id", "left").withColumns({
        "canonical_key": F.coalesce("_key", "canonical_key"), "kanji": F.coalesce("_surface", "kanji"),
    }).select(*vocab.columns)
    remade = completed.filter("made is not null").groupBy(F.col("made").alias("position")).agg(
        F.max_by("identity_key", "position").alias("_key"),
        F.max_by("surface", F.when(F.col("surface") != "", F.col("position"))).alias("_surface"))
    judged = judged.drop("made")
    meaning = js_trim(F.coalesce("burmese_meaning", F.lit("")))
    fresh = judged.filter("outcome = 'created'").join(remade, "position", "left").withColumns({
        "id": new_id if new_id is not None else F.sha2(F.concat_ws(":", "identity_key", "position"), 256),
        "canonical_key": F.coalesce("_key", "identity_key"),
        "kanji": F.coalesce("_surface", F.nullif("surface", F.lit(""))), "kana": F.col("reading_key"),
        "burmese_meaning": F.coalesce(F.nullif(meaning, F.lit("")), F.col("reading_key")),
        "jlpt_level": F.when(F.col("jlpt_level") == "N4", "N4").otherwise("N5"),
        **{c: F.nullif(c, F.lit("")) for c in ("romaji", "part_of_speech") if c in judged.columns},
        "pdf_source": F.lit(READER_SOURCE), "created_at": F.lit(now).cast("timestamp"),
    })
    fresh = fresh.select(*[
        (F.col(c) if c in fresh.columns else F.lit(None)).cast(vocab.schema[c].dataType).alias(c) for c in vocab.columns])
    return judged, filled.unionByName(fresh)
