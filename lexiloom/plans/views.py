"""Domain tables derived from the given star-schema and text tables.

Each function has a SQL twin of the same name in ``SQL``; formulas inject the cases (stale keys,
missing surfaces, lesson headers, ...) the plain data lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.identity import join_keys, surface_key
from ..session import spread

NOW = "2024-01-20 12:00:00"
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def plain(df: DataFrame) -> DataFrame:
    """Result in types both engines print alike: longs, rounded doubles and strings."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def visible(key: Column | str) -> Column:
    """Key with its separator shown as ``|``."""
    return F.translate(key, "\0", "|")


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size",
        F.concat_ws("-", "p_brand", F.col("p_size") % 10, F.expr("p_partkey div 1000")).alias("kana"),
    ).withColumn("kanji", F.when(F.col("p_size") % 7 != 0, F.col("p_name")))
    key = join_keys(surface_key("kanji"), F.col("kana"))
    m = F.col("id")
    return p.select(
        "id",
        F.when(m % 5 == 1, key).when(m % 5 == 3, F.concat(F.lit("reading:"), "kana")).alias("canonical_key"),
        "kanji", "kana", F.when(m % 4 != 0, F.lower("p_brand")).alias("romaji"),
        F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("burmese_meaning"),
        F.when(m % 3 == 0, "N5").when(m % 3 == 1, "N4").otherwise("N3").alias("jlpt_level"),
        F.when(m % 3 != 0, F.col("p_type")).alias("part_of_speech"),
        F.when(m % 2 == 1, F.concat(F.lit("ex "), "p_name")).alias("example_sentence_jp"),
        F.lit(None).cast("string").alias("example_sentence_mm"),
        F.concat(F.lit("File"), m % 20, F.lit(".pdf")).alias("pdf_source"),
        F.when(F.col("p_size").between(1, 25), F.col("p_size")).alias("lesson"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + m * 60).alias("created_at"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    return words_of(spread(table(spark, sf, "part")))


def words_of(p: DataFrame) -> DataFrame:
    """Incoming words: every part row with its identity kept, shifted or replaced."""
    v = F.col("p_partkey") % 5
    block = F.expr("p_partkey div 1000")
    kana = F.concat_ws("-", "p_brand", F.col("p_size") % 10, block)
    return p.select(
        F.col("p_partkey").alias("position"),
        F.when(v == 2, F.lit(None)).when(v == 4, F.concat(F.lit("new "), "p_name"))
        .when((v == 3) | (F.col("p_size") % 7 != 0), F.col("p_name")).alias("kanji"),
        F.when(v == 1, F.concat(kana, F.lit("x")))
        .when(v == 3, F.concat_ws("-", "p_brand", (F.col("p_size") + 1) % 10, block))
        .when(v == 4, F.concat_ws("-", "p_brand", F.col("p_partkey") % 50)).otherwise(kana).alias("kana"),
        F.lit(None).cast("string").alias("romaji"),
        F.when(v == 3, F.lower("p_name")).otherwise(F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("burmese_meaning"),
        F.lit("N5").alias("jlpt_level"), F.lit("noun").alias("part_of_speech"),
        F.when(F.col("p_size").between(1, 25), F.col("p_size")).alias("lesson"),
        F.concat(F.lit("in "), "p_name").alias("example_sentence_jp"), F.lit(None).cast("string").alias("example_sentence_mm"),
    )


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestion batches: one per order, sized by its lines."""
    qty = F.col("l_quantity")
    part = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, qty))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(F.col("l_linestatus") == "F").alias("ocr_pages"),
        F.sum(qty).alias("extracted_candidates"), part("N").alias("imported_candidates"),
        part("R").alias("duplicate_count"), part("A").alias("review_count"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("Customer "), "o_custkey", F.lit(".pdf")).alias("source_name"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "needs_review")
        .otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice")).cast("long").alias("duration_ms"))
    joined = orders.join(lines, "batch_id", "left")
    return joined.withColumns({
        c: F.coalesce(c, F.lit(0)).cast("long") for c in lines.columns if c != "batch_id"})


def batch_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("page_number"),
        F.when(F.col("l_returnflag") == "R", "needs_review").when(F.col("l_returnflag") == "N", "approved")
        .otherwise("queued").alias("status"))


def batch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise("approved").alias("status"))


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of files, with a lesson header on every seventh."""
    d = F.col("doc_id")
    head = F.when(d % 7 == 0, F.concat(F.lit("Lesson "), d % 31, F.lit("\n"))).otherwise(F.lit(""))
    return documents(spark, sf).select(
        F.concat_ws("/", "source", F.expr("doc_id div 2000")).alias("doc"), d.alias("num"),
        F.concat(head, "text").alias("text"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return ratings_of(table(spark, sf, "events"))


def ratings_of(events: DataFrame) -> DataFrame:
    """Ratings: events of a learner on a card; sign-ups are invalid ones."""
    kind = F.col("event_type")
    return events.select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("vocab_id"), "ts", "event_id",
        F.when(kind == "error", 0).when(kind == "view", 3).when(kind == "click", 4).when(kind == "purchase", 5)
        .otherwise(1).alias("grade"))


def quizzes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'signup'").select(
        "user_id", "ts", F.least(F.lit(100), F.floor("value")).cast("int").alias("percent")
    ).withColumn("accuracy", F.col("percent") / 100)


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Simple card states per learner and card, from the events."""
    per = ratings(spark, sf).groupBy("user_id", "vocab_id").agg(
        F.count_if(F.col("grade") >= 3).alias("repetitions"), F.sum("grade").alias("interval"), F.max("ts").alias("last"))
    status = F.when(F.col("repetitions") == 0, "learning").when(F.col("interval") >= 8, "mastered").otherwise("reviewing")
    return per.select(
        "user_id", "vocab_id", F.lit(2.5).alias("ease_factor"), F.col("interval").cast("int").alias("interval"),
        F.col("repetitions").cast("int").alias("repetitions"), status.alias("status"),
        F.date_add(F.to_date("last"), F.col("interval").cast("int")).cast("timestamp").alias("next_review_date"))


def stored_cards(spark: SparkSession, sf: str) -> DataFrame:
    return stored_cards_of(ratings(spark, sf))


def stored_cards_of(given: DataFrame) -> DataFrame:
    """Progress stored before the ratings: three of four rated cards, with every kind of state, and a card nobody rated for each learner."""
    seen = given.select("user_id", "vocab_id").unionByName(given.select("user_id", F.lit(-1).cast("long").alias("vocab_id"))).distinct()
    mix = F.col("user_id") * 31 + F.col("vocab_id") * 17
    interval = F.when(mix % 3 == 0, 1).otherwise(mix % 40).cast("int")
    return seen.filter("(user_id * 7 + vocab_id) % 4 <> 0 or vocab_id < 0").select(
        "user_id", "vocab_id", ((130 + mix % 170) / 100).alias("ease_factor"), interval.alias("interval"),
        (mix % 6).cast("int").alias("repetitions"), F.when(mix % 6 == 0, "learning").otherwise("reviewing").alias("status"),
        F.lit(EPOCH).cast("timestamp").alias("next_review_date"))


def word_progress(spark: SparkSession, sf: str) -> DataFrame:
    """One learner's progress per word, from its order lines; words never sold in full lots have none."""
    per = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("vocab_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("repetitions"), F.max("l_shipdate").alias("next_review_date"),
        F.max("l_quantity").alias("largest"))
    status = F.when(F.col("repetitions") == 0, "learning").when(F.col("repetitions") >= 10, "mastered").otherwise("reviewing")
    return per.filter("largest >= 50").drop("largest").withColumns({
        "status": status, "repetitions": F.col("repetitions").cast("int"), "ease_factor": F.lit(2.5),
        "interval": F.lit(0)})


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Match reviews: one per customer, on a word of the vocabulary; some point nowhere."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    record = F.struct(
        F.concat(F.lit("s"), k % 400).alias("kanji"), F.concat(F.lit("r"), k % 300).alias("kana"),
        F.concat(F.lit("m "), k % 10).alias("burmese_meaning"), F.lit("ro").alias("romaji"), (k % 30).alias("lesson"))
    return c.select(
        F.concat(F.lit("k"), k).alias("review_key"),
        F.when(k % 13 == 0, F.lit("{broken")).otherwise(F.to_json(record)).alias("incoming_json"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(k - k % 2).alias("candidate_id"),
        F.lit(0.75).alias("score"), F.lit("[]").alias("reasons_json"), F.lit(None).cast("string").alias("explanation_json"),
        F.lit("f").alias("source"), F.when(k % 5 == 0, "accepted").otherwise("pending").alias("status"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + k * 60).alias("created_at"))


def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestion pages: one per document."""
    d = F.col("doc_id")
    return documents(spark, sf).select(
        d.alias("page_id"), F.col("source").alias("batch_id"), d.alias("page_number"), F.col("text").alias("raw_text"),
        F.when(d % 3 == 0, "needs_review").otherwise("corrected").alias("status"), F.lit(0).cast("long").alias("revision"),
        F.lit(None).cast("string").alias("error_category"), F.lit(None).cast("string").alias("error_message"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted candidates: two per page, from the incoming words; some are broken or settled."""
    w, m = words(spark, sf), F.col("position")
    record = F.struct("kanji", "kana", "burmese_meaning", "jlpt_level", "lesson")
    return w.select(
        m.cast("string").alias("candidate_id"), F.lit("b").alias("batch_id"), F.expr("position div 2").alias("page_id"),
        F.when(m % 9 == 0, F.lit("{}")).otherwise(F.to_json(record)).alias("incoming_json"),
        F.lit(None).cast("string").alias("canonical_key"),
        F.when(m % 6 == 0, "review").otherwise("new").alias("decision_kind"),
        F.when(m % 4 == 3, "approved").otherwise("pending").alias("status"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reasons_json"),
        F.lit(None).cast("long").alias("vocabulary_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + m).alias("created_at"))


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    return submissions_of(table(spark, sf, "conversations"))


def submissions_of(conversations: DataFrame) -> DataFrame:
    """Corrections of pages: every turn of a conversation, some on an old or future revision."""
    t = F.col("turn")
    off = (F.col("conv_id") + t * 3) % 5
    return conversations.select(
        F.col("conv_id").alias("page_id"), t.alias("position"),
        (F.expr("turn * 3 div 4") - F.when(off == 1, 1).when(off == 2, -1).otherwise(0)).cast("long").alias("base_revision"),
        F.col("text").alias("corrected_text"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers: one per incoming word with two records; fenced, bare, cut off or odd."""
    w, m = words(spark, sf), F.col("position")
    first = F.struct("kanji", "kana", "burmese_meaning", F.col("lesson").cast("string").alias("lesson"),
                     F.when(m % 2 == 0, "n4").otherwise("N9").alias("jlpt_level"))
    second = F.struct("kanji", F.concat("kana", F.when(m % 3 == 0, F.lit("")).otherwise(F.lit("z"))).alias("kana"),
                      "burmese_meaning", F.lit("99").alias("lesson"), F.lit(None).cast("string").alias("jlpt_level"))
    items = F.to_json(F.array(first, second))
    wrapped = F.concat(F.lit('{"items":'), items, F.lit("}"))
    return w.select(
        m.alias("response_id"),
        F.when(m % 6 == 0, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(m % 6 == 1, items)
        .when(m % 6 == 2, F.concat(F.lit("Here it is: "), wrapped)).when(m % 6 == 3, F.substring(wrapped, 1, 40))
        .when(m % 6 == 4, F.lit('{"items": 5}')).otherwise(wrapped).alias("response"),
        F.when(m % 2 == 0, F.concat(F.lit("N4 Lesson "), m % 30)).otherwise(F.lit("plain")).alias("chunk_text"))


# --- the same tables in SQL ---------------------------------------------------------------

KEY = "CASE WHEN {s} IS NULL OR {s} = '' THEN 'reading:' || {r} ELSE 'surface:' || replace({s}, ' ', '') || chr(0) || 'reading:' || {r} END"


def key_sql(surface: str, reading: str) -> str:
    return KEY.format(s=surface, r=reading)


SQL = {
    "vocab": f"""
        SELECT id, CASE WHEN id % 5 = 1 THEN {key_sql('kanji', 'kana')} WHEN id % 5 = 3 THEN 'reading:' || kana END AS canonical_key,
          kanji, kana, CASE WHEN id % 4 <> 0 THEN lower(p_brand) END AS romaji, lower(p_type || ' ' || p_name) AS burmese_meaning,
          CASE id % 3 WHEN 0 THEN 'N5' WHEN 1 THEN 'N4' ELSE 'N3' END AS jlpt_level,
          CASE WHEN id % 3 <> 0 THEN p_type END AS part_of_speech,
          CASE WHEN id % 2 = 1 THEN 'ex ' || p_name END AS example_sentence_jp, CAST(NULL AS VARCHAR) AS example_sentence_mm,
          'File' || (id % 20) || '.pdf' AS pdf_source, CASE WHEN p_size BETWEEN 1 AND 25 THEN CAST(p_size AS BIGINT) END AS lesson,
          TIMESTAMP '{EPOCH}' + to_minutes(id) AS created_at,
          replace(coalesce(kanji, ''), ' ', '') AS surface_key, {key_sql('kanji', 'kana')} AS identity_key
        FROM (SELECT *, p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_name END AS kanji,
                p_brand || '-' || (p_size % 10) || '-' || (p_partkey // 1000) AS kana FROM part)""",
    "words": f"""
        SELECT *, replace(coalesce(kanji, ''), ' ', '') AS surface_key, {key_sql('kanji', 'kana')} AS identity_key FROM (
        SELECT p_partkey AS position,
          CASE WHEN p_partkey % 5 = 2 THEN NULL WHEN p_partkey % 5 = 4 THEN 'new ' || p_name
               WHEN p_partkey % 5 = 3 OR p_size % 7 <> 0 THEN p_name END AS kanji,
          CASE p_partkey % 5 WHEN 1 THEN p_brand || '-' || (p_size % 10) || '-' || (p_partkey // 1000) || 'x'
               WHEN 3 THEN p_brand || '-' || ((p_size + 1) % 10) || '-' || (p_partkey // 1000)
               WHEN 4 THEN p_brand || '-' || (p_partkey % 50)
               ELSE p_brand || '-' || (p_size % 10) || '-' || (p_partkey // 1000) END AS kana,
          CASE WHEN p_partkey % 5 = 3 THEN lower(p_name) ELSE lower(p_type || ' ' || p_name) END AS burmese_meaning,
          'N5' AS jlpt_level, 'noun' AS part_of_speech, CASE WHEN p_size BETWEEN 1 AND 25 THEN CAST(p_size AS BIGINT) END AS lesson,
          'in ' || p_name AS example_sentence_jp FROM part)""",
    "batches": """
        SELECT o_orderkey AS batch_id, 'Customer ' || o_custkey || '.pdf' AS source_name,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'needs_review' ELSE 'queued' END AS status,
          o_orderdate AS created_at, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms,
          coalesce(total_pages, 0) AS total_pages, coalesce(ocr_pages, 0) AS ocr_pages,
          coalesce(extracted_candidates, 0) AS extracted_candidates, coalesce(imported_candidates, 0) AS imported_candidates,
          coalesce(duplicate_count, 0) AS duplicate_count, coalesce(review_count, 0) AS review_count
        FROM orders LEFT JOIN (
          SELECT l_orderkey, count(*) AS total_pages, count(*) FILTER (l_linestatus = 'F') AS ocr_pages,
            CAST(sum(l_quantity) AS BIGINT) AS extracted_candidates,
            CAST(sum(l_quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS imported_candidates,
            CAST(sum(l_quantity) FILTER (l_returnflag = 'R') AS BIGINT) AS duplicate_count,
            CAST(sum(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS review_count
          FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "batch_pages": """
        SELECT l_orderkey AS batch_id, CASE l_returnflag WHEN 'R' THEN 'needs_review' WHEN 'N' THEN 'approved' ELSE 'queued' END AS status,
          l_linenumber AS page_number FROM lineitem""",
    "batch_candidates": """
        SELECT l_orderkey AS batch_id, CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'approved' END AS status FROM lineitem""",
    "doc_pages": """
        SELECT source || '/' || (doc_id // 2000) AS doc, doc_id AS num,
          CASE WHEN doc_id % 7 = 0 THEN 'Lesson ' || (doc_id % 31) || chr(10) ELSE '' END || text AS text FROM documents""",
    "ratings": """
        SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS vocab_id, ts, event_id,
          CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 ELSE 1 END AS grade
        FROM events""",
    "quizzes": """
        SELECT user_id, ts, CAST(least(100, floor(value)) AS BIGINT) AS percent FROM events WHERE event_type = 'signup'""",
    "progress": """
        SELECT user_id, vocab_id, n AS repetitions, s AS interval,
          CASE WHEN n = 0 THEN 'learning' WHEN s >= 8 THEN 'mastered' ELSE 'reviewing' END AS status,
          CAST(CAST(last AS DATE) + CAST(s AS INTEGER) AS TIMESTAMP) AS next_review_date
        FROM (SELECT user_id, vocab_id, count(*) FILTER (grade >= 3) AS n, CAST(sum(grade) AS BIGINT) AS s, max(ts) AS last
              FROM ratings GROUP BY 1, 2)""",
    "stored_cards": f"""
        SELECT user_id, vocab_id, 130 + mix % 170 AS ease, CASE WHEN mix % 3 = 0 THEN 1 ELSE mix % 40 END AS interval, mix % 6 AS repetitions,
          CASE WHEN mix % 6 = 0 THEN 'learning' ELSE 'reviewing' END AS status, TIMESTAMP '{EPOCH}' AS next_review_date
        FROM (SELECT DISTINCT *, user_id * 31 + vocab_id * 17 AS mix FROM (
          SELECT user_id, vocab_id FROM ratings UNION ALL SELECT user_id, -1 FROM ratings))
        WHERE (user_id * 7 + vocab_id) % 4 <> 0 OR vocab_id < 0""",
    "word_progress": """
        SELECT vocab_id, n AS repetitions, next_review_date,
          CASE WHEN n = 0 THEN 'learning' WHEN n >= 10 THEN 'mastered' ELSE 'reviewing' END AS status
        FROM (SELECT l_partkey AS vocab_id, count(*) FILTER (l_returnflag = 'A') AS n, max(l_shipdate) AS next_review_date
              FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 50)""",
    "reviews": f"""
        SELECT 'k' || c_custkey AS review_key, c_custkey % 13 <> 0 AS readable, 's' || (c_custkey % 400) AS kanji,
          'r' || (c_custkey % 300) AS kana, CASE WHEN c_custkey % 30 BETWEEN 1 AND 25 THEN c_custkey % 30 END AS lesson,
          CASE WHEN c_custkey % 17 <> 0 THEN c_custkey - c_custkey % 2 END AS candidate_id,
          CASE WHEN c_custkey % 5 = 0 THEN 'accepted' ELSE 'pending' END AS status,
          TIMESTAMP '{EPOCH}' + to_minutes(c_custkey) AS created_at, c_custkey AS position FROM customer""",
    "candidates": """
        SELECT position, CAST(position AS VARCHAR) AS candidate_id, position // 2 AS page_id, position % 9 <> 0 AS readable,
          kanji, kana, burmese_meaning, lesson, identity_key, CASE WHEN position % 6 = 0 THEN 'review' ELSE 'new' END AS decision_kind,
          CASE WHEN position % 4 = 3 THEN 'approved' ELSE 'pending' END AS status FROM words""",
    "submissions": """
        SELECT conv_id AS page_id, turn AS position, text AS corrected_text,
          turn * 3 // 4 - CASE (conv_id + turn * 3) % 5 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS base_revision FROM conversations""",
}
NEEDS = {"candidates": ["words"], "progress": ["ratings"], "stored_cards": ["ratings"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL text with the named views in front of it."""
    ordered: list[str] = []
    for n in names:
        for d in [*NEEDS.get(n, []), n]:
            if d not in ordered:
                ordered.append(d)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    body = sql.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if not head:
        return f"{word} {body}" if recursive else body
    if body.upper().startswith("WITH "):
        return f"{word} {head},\n{body[5:]}"
    return f"{word} {head}\n{body}"
