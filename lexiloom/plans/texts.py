"""Text, scalar, chunking and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, similarity, text
from ..functions.text import LATIN
from ..operators import accuracy, chunking, words
from ..sources import files
from . import views as v

ASCII = words.Scripts(LATIN, LATIN)


def _parts(spark, sf):
    return v.table(spark, sf, "part")


def clean_text(spark, sf):
    """Documents with injected carriage returns, soft hyphens, tabs and blank runs."""
    t = F.regexp_replace("text", r"\n", "\t \r\n\n\n\n ​")
    dirty = F.concat(F.lit(" 　"), F.regexp_replace(t, " ", "  ­"))
    cleaned = v.documents(spark, sf).select("doc_id", text.clean_text(dirty).alias("t"))
    return v.plain(cleaned.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("chars")))


WIDE = {c: chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz"}


def nfkc(spark, sf):
    """Documents typed in full-width letters, normalised back."""
    wide = F.translate("text", "".join(WIDE), "".join(WIDE.values()))
    t = v.documents(spark, sf).select("doc_id", text.nfkc(wide).alias("t"))
    return v.plain(t.select("doc_id", F.md5("t").alias("digest")))


def keys(spark, sf):
    """Reading, surface and canonical keys of names with kana, full-width blanks and brackets."""
    p = _parts(spark, sf).select(
        "p_partkey", F.concat(F.lit(" 「"), "p_name", F.lit("カッコー」 [x]　")).alias("raw"))
    return v.plain(p.select(
        "p_partkey", identity.reading_key("raw").alias("reading_key"), identity.norm_surface("raw").alias("surface"),
        identity.surface_key("raw").alias("surface_key"),
        v.visible(identity.canonical_key(F.when(F.col("p_partkey") % 3 != 0, F.col("raw")), "raw")).alias("canonical_key")))


WORDS = ["きょう", "がっこう", "かんぱ", "かんび", "たべる", "コーヒー", "しゃっきん", "ぁっ", "んま", "abcゃ"]
ROMAJI = ["kiyou", "gakkou", "kampa", "kanbi", "taberu", "koーhiー", "shiyakkin", "a", "mma", "abya"]
FOLDED = ["きよう", "がつこう", "かんぱ", "かんび", "たべる", "こーひー", "しやつきん", "あつ", "んま", "abcや"]


def kana(spark, sf):
    """Lookup form and romaji of a kana word per part."""
    pick = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("p_partkey") % len(WORDS)).cast("int"))
    p = _parts(spark, sf).select("p_partkey", pick.alias("w"))
    return v.plain(p.select(
        "p_partkey", "w", text.fold_kana("w").alias("folded"), text.simple_romaji("w").alias("romaji"),
        text.contains_script("w", text.KANA).alias("kana"), text.contains_script("w", text.CJK).alias("cjk")))


def headers(spark, sf):
    """Lesson and level announced by each document, with injected headers."""
    d = F.col("doc_id")
    head = (F.when(d % 4 == 0, F.concat(F.lit("第 "), d % 40, F.lit("課 N5\n"))).when(d % 4 == 1, F.concat(F.lit("UNIT"), d % 300, F.lit(" n4,")))
            .when(d % 4 == 2, F.concat(F.lit("xN4 N45 "), d % 9, F.lit(" lessons\n"))).otherwise(F.lit("")))
    t = v.documents(spark, sf).select("doc_id", F.concat(head, "text").alias("t"))
    return v.plain(t.select("doc_id", text.detect_lesson("t").alias("lesson"), text.detect_level("t").alias("level")))


def clean_fields(spark, sf):
    """One-line fields, levels and lessons out of loose values."""
    k = F.col("p_partkey")
    loose = F.concat(F.lit("  "), "p_type", F.lit("\r\n\t"), "p_name", F.lit("  "))
    lesson = F.concat(F.lit(" "), k % 40, F.when(k % 3 == 0, F.lit(".0")).when(k % 3 == 1, F.lit("")).otherwise(F.lit(".5")))
    level = F.concat(F.when(k % 2 == 0, F.lit("n")).otherwise(F.lit("N")), k % 6)
    return v.plain(_parts(spark, sf).select(
        "p_partkey", text.clean_optional(loose, 12).alias("field"), text.clean_optional(F.lit(" 　 "), 5).alias("empty"),
        text.parse_lesson(lesson, F.lit(7)).alias("lesson"), text.parse_level(level, "N5").alias("level"),
        text.clamp_percent(text.percent(F.col("p_size") * 3, F.lit(100))).alias("share")))


def meaning_keys(spark, sf):
    c = v.table(spark, sf, "conversations").withColumn("key", similarity.meaning_key("text"))
    return v.plain(c.select("conv_id", "turn", F.md5("key").alias("digest"), F.size(similarity.key_bigrams("key")).alias("bigrams")))


def similarities(spark, sf):
    """Meaning similarity and edit distance of each part's name and type against neighbours by formula."""
    p = _parts(spark, sf).select(
        "p_partkey", "p_brand", F.concat_ws(" ", "p_type", "p_name").alias("a"),
        F.concat(F.lower("p_name"), F.lit(", "), "p_type", F.lit("!")).alias("b"),
        F.concat("p_brand", (F.col("p_partkey") % 7).cast("string")).alias("c"))
    sim = similarity.jaccard_bigrams("a", "b")
    return v.plain(p.select(
        "p_partkey", sim.alias("similarity"), similarity.compatible("a", "b").alias("compatible"),
        similarity.edit_distance("p_brand", "c", 1).alias("near"), similarity.edit_distance("a", "c").alias("distance")))


def _checked(spark, sf):
    """Records of the part table, some without a usable reading or meaning."""
    k = F.col("p_partkey")
    raw = _parts(spark, sf).select(
        "p_partkey", F.concat(F.lit(" "), "p_name").alias("kanji"),
        F.when(k % 10 == 3, F.lit("123")).otherwise(F.concat("p_brand", F.lit(" [x]"))).alias("kana"),
        F.when(k % 10 == 5, F.lit(" ")).when(k % 10 == 6, F.lit(None)).otherwise(F.col("p_type")).alias("burmese_meaning"),
        F.when(k % 2 == 0, "n4").otherwise("N1").alias("jlpt_level"), (k % 40).cast("string").alias("lesson"),
        F.when(k % 4 == 0, F.col("p_name")).alias("romaji"))
    return words.normalize_words(raw, "N5", F.lit(9), ASCII)


def normalize_words(spark, sf):
    good, _ = _checked(spark, sf)
    return v.plain(good.select("p_partkey", "kanji", "kana", "romaji", "burmese_meaning", "jlpt_level", "lesson"))


def word_rejects(spark, sf):
    _, bad = _checked(spark, sf)
    return v.plain(bad.select("p_partkey", "kanji", "kana", "burmese_meaning"))


def parse_responses(spark, sf):
    out = words.parse_responses(v.responses(spark, sf), scripts=ASCII)
    return v.plain(out.select(
        "response_id", "position", v.visible("identity_key").alias("identity_key"), "burmese_meaning", "jlpt_level", "lesson"))


def parse_lines(spark, sf):
    t = v.documents(spark, sf).select("doc_id", F.translate("text", ",", ";").alias("text"))
    return v.plain(words.parse_lines(t, "text", ASCII).select("doc_id", "position", "kanji", "kana", "burmese_meaning"))


def fill_lesson(spark, sf):
    return v.plain(chunking.fill_lesson(v.doc_pages(spark, sf)).select("doc", "num", "page_lesson", "lesson"))


def split_long_lines(spark, sf):
    t = v.documents(spark, sf).select("doc_id", F.translate(F.regexp_replace("text", r"\n", " "), ",", ";").alias("line"))
    t = t.select("doc_id", text.js_trim(F.regexp_replace("line", " +", " ")).alias("line"))
    out = chunking.split_long_lines(t, "line", 500)
    return v.plain(out.select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("digest")))


def chunk_pages(spark, sf):
    out = chunking.pages_to_chunks(v.doc_pages(spark, sf))
    return v.plain(out.select(
        "doc", "page_start", "piece_start", "page_end", "lesson", F.length("text").alias("chars"), F.md5("text").alias("digest")))


def doc_text(spark, sf):
    out = files.doc_text(v.doc_pages(spark, sf))
    return v.plain(out.select("doc", F.length("text").alias("chars"), F.md5("text").alias("digest")))


def read_pages_limits(spark, sf):
    """Files per source, of which the larger ones break a page or byte limit."""
    pages = v.documents(spark, sf).select(
        F.concat_ws("/", "lang", "source", F.expr("doc_id div 2000")).alias("doc"), F.col("doc_id").alias("num"), "text")
    kept, rejects = files.read_pages(pages, max_bytes=60_000, max_pages=30)
    ok = kept.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("text")).alias("bytes"), F.lit("kept").alias("reason"))
    return v.plain(ok.unionByName(rejects.select("doc", "pages", "bytes", "reason")))


def accuracy_report(spark, sf):
    """Label every document by length and compare with its quality label."""
    labels = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "exact").otherwise("review").alias("expected_kind"),
        F.lit(0.7).alias("minimum_score"))
    n = F.col("n_chars")
    decided = v.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.when(n >= 1000, "exact").when(n >= 100, "review").otherwise("new").alias("kind"),
        F.when(n % 2 == 0, 0.75).otherwise(0.64).alias("score"))
    return v.plain(accuracy.accuracy_report(accuracy.judge_cases(labels, decided)))


def extraction_checks(spark, sf):
    pages = v.doc_pages(spark, sf)
    specs = pages.select("doc").distinct().withColumns({
        "required_text": F.array(F.lit("the"), F.lit("zzzz"), F.lit("ation")), "minimum_pages": F.lit(90),
        "minimum_characters": F.lit(1000), "expected_level": F.lit(None).cast("string"), "expected_lesson": F.lit(7),
        "expect_no_text": F.lit(False)})
    return v.plain(accuracy.extraction_checks(pages, specs).drop("reason"))


# --- SQL twins ----------------------------------------------------------------------------

CLEAN = """
    SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (
      SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{1,}', chr(10) || chr(10), 'g'),
        ' ' || chr(10)) AS t FROM documents)"""

KEYS = f"""
    WITH r AS (SELECT p_partkey, replace(p_name, ' ', '') AS n, p_name FROM part),
    k AS (SELECT *, n || 'かっこーx' AS reading_key, '「' || p_name || 'カッコー」 [x]' AS surface, '「' || n || 'カッコー」[x]' AS surface_key FROM r)
    SELECT p_partkey, reading_key, surface, surface_key,
      CASE WHEN p_partkey % 3 <> 0 THEN 'surface:' || surface_key || '|reading:' || reading_key ELSE 'reading:' || reading_key END AS canonical_key
    FROM k"""


def _values(*columns):
    return ", ".join("(" + ", ".join([str(i), *[f"'{c[i]}'" for c in columns]]) + ")" for i in range(len(columns[0])))


KANA = f"""
    WITH w(i, w, folded, romaji) AS (VALUES {_values(WORDS, FOLDED, ROMAJI)})
    SELECT p_partkey, w, folded, romaji, CAST(1 AS BIGINT) AS kana, CAST(0 AS BIGINT) AS cjk FROM part JOIN w ON p_partkey % {len(WORDS)} = i"""

HEADERS = """
    WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '第 ' || (doc_id % 40) || '課 N5' || chr(10) WHEN 1 THEN 'UNIT' || (doc_id % 300) || ' n4,'
        WHEN 2 THEN 'xN4 N45 ' || (doc_id % 9) || ' lessons' || chr(10) ELSE '' END || text AS t FROM documents),
    m AS (SELECT doc_id, regexp_extract(t, '(?i)(?:第\\s*)?(\\d{1,2})\\s*課|(?:lesson|unit|chapter)\\s*(\\d{1,2})') AS h,
        upper(regexp_extract(t, '(?i)\\b(N[45])\\b', 1)) AS l FROM t),
    n AS (SELECT doc_id, TRY_CAST(regexp_extract(h, '\\d{1,2}') AS BIGINT) AS n, l FROM m)
    SELECT doc_id, CASE WHEN n BETWEEN 1 AND 25 THEN n END AS lesson, nullif(l, '') AS level FROM n"""

FIELDS = """
    SELECT p_partkey, substr(p_type || ' ' || p_name, 1, 12) AS field, CAST(NULL AS VARCHAR) AS empty,
      CASE WHEN p_partkey % 3 < 2 AND p_partkey % 40 BETWEEN 1 AND 25 THEN p_partkey % 40 ELSE 7 END AS lesson,
      CASE WHEN p_partkey % 6 IN (4, 5) THEN 'N' || (p_partkey % 6) ELSE 'N5' END AS level, CAST(least(100, p_size * 3) AS BIGINT) AS share FROM part"""

MEANING = """
    WITH k AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '\\s+', '', 'g'), '[၊။!?！？。、,.]', '', 'g') AS k FROM conversations)
    SELECT conv_id, turn, md5(k) AS digest,
      CASE WHEN length(k) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i, 2)))) END AS bigrams FROM k"""

SIMILAR = """
    WITH t AS (SELECT p_partkey, p_brand, p_type || ' ' || p_name AS a, p_brand || (p_partkey % 7) AS c,
        lower(replace(p_type || p_name, ' ', '')) AS x, lower(replace(p_name || p_type, ' ', '')) AS y FROM part),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS gx,
        list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS gy FROM t),
    s AS (SELECT *, CASE WHEN x = y THEN 1.0 ELSE len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))) END AS s FROM g)
    SELECT p_partkey, round(s, 6) AS similarity, CAST(s >= 0.45 AS BIGINT) AS compatible,
      CASE WHEN levenshtein(p_brand, c) <= 1 THEN levenshtein(p_brand, c) ELSE -1 END AS near, levenshtein(a, c) AS distance FROM s"""

RAW = """raw AS (SELECT p_partkey, p_name AS kanji, CASE WHEN p_partkey % 10 = 3 THEN '123' ELSE p_brand || 'x' END AS kana,
        CASE WHEN p_partkey % 10 NOT IN (5, 6) THEN p_type END AS burmese_meaning, p_partkey % 40 AS l,
        CASE WHEN p_partkey % 2 = 0 THEN 'N4' ELSE 'N5' END AS jlpt_level, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand || 'x' END AS romaji FROM part)"""

NORMALIZED = f"""
    WITH {RAW} SELECT p_partkey, kanji, kana, CASE WHEN kana = '123' AND p_partkey % 4 <> 0 THEN '123' ELSE romaji END AS romaji, burmese_meaning, jlpt_level,
      CASE WHEN l BETWEEN 1 AND 25 THEN l ELSE 9 END AS lesson FROM raw WHERE kana <> '123' AND burmese_meaning IS NOT NULL"""

REJECTS = """
    SELECT p_partkey, ' ' || p_name AS kanji, CASE WHEN p_partkey % 10 = 3 THEN '123' ELSE p_brand || ' [x]' END AS kana,
      CASE p_partkey % 10 WHEN 5 THEN ' ' WHEN 6 THEN NULL ELSE p_type END AS burmese_meaning
    FROM part WHERE p_partkey % 10 IN (3, 5, 6)"""

RESPONSES = f"""
    WITH items AS (
      SELECT position AS response_id, CAST(0 AS BIGINT) AS position, kanji, kana, burmese_meaning, lesson AS l,
        CASE WHEN position % 2 = 0 THEN 'N4' END AS level FROM words
      UNION ALL SELECT position, 1, kanji, kana || CASE WHEN position % 3 = 0 THEN '' ELSE 'z' END, burmese_meaning, NULL, NULL FROM words),
    valid AS (SELECT *, {v.key_sql('kanji', 'kana')} AS k FROM items WHERE response_id % 6 NOT IN (3, 4))
    SELECT response_id, position, replace(k, chr(0), '|') AS identity_key, burmese_meaning,
      coalesce(level, CASE WHEN response_id % 2 = 0 THEN 'N4' ELSE 'N5' END) AS jlpt_level,
      coalesce(l, CASE WHEN response_id % 2 = 0 AND response_id % 30 BETWEEN 1 AND 25 THEN response_id % 30 END) AS lesson
    FROM valid QUALIFY row_number() OVER (PARTITION BY response_id, k ORDER BY position) = 1"""

LINES = """
    WITH parts AS (SELECT doc_id, string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ',', ';'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'),
        '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '[\\n;]') AS p FROM documents),
    rows AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS position FROM parts),
    f AS (SELECT doc_id, position, string_split_regex(line, '\\s+') AS f FROM rows),
    g AS (SELECT doc_id, position, nullif(substr(f[1], 1, 80), '') AS kanji, regexp_replace(coalesce(f[2], ''), '[「」『』【】（）()［］\\[\\]〈〉<>]', '', 'g') AS kana,
        substr(f[3], 1, 300) AS burmese_meaning FROM f)
    SELECT doc_id, position, kanji, kana, burmese_meaning FROM g WHERE kana SIMILAR TO '.*[A-Za-z].*' AND burmese_meaning SIMILAR TO '.*[A-Za-z].*'"""

LESSON_OF = """regexp_extract(text, '(?i)(?:第\\s*)?(\\d{1,2})\\s*課|(?:lesson|unit|chapter)\\s*(\\d{1,2})')"""

LESSON = f"""
    WITH n AS (SELECT doc, num, TRY_CAST(regexp_extract({LESSON_OF}, '\\d{{1,2}}') AS BIGINT) AS n FROM doc_pages),
    p AS (SELECT doc, num, CASE WHEN n BETWEEN 1 AND 25 THEN n END AS page_lesson FROM n)
    SELECT doc, num, page_lesson, last_value(page_lesson IGNORE NULLS) OVER (PARTITION BY doc ORDER BY num ROWS UNBOUNDED PRECEDING) AS lesson FROM p"""

# One step cuts the next piece off; the last sentence mark of the window is the longest match.
CUT = """CASE WHEN length(rest) <= {n} THEN length(rest)
      WHEN length(regexp_extract(left(rest, {n}), '(?s)^.*[。！？!?、；;:：]')) > {least} THEN length(regexp_extract(left(rest, {n}), '(?s)^.*[。！？!?、；;:：]'))
      ELSE {n} END"""

SPLIT = f"""
    cut AS (
      SELECT doc_id, CAST(-1 AS BIGINT) AS piece_no, '' AS piece, trim(regexp_replace(replace(replace(text, chr(10), ' '), ',', ';'), ' +', ' ', 'g')) AS rest FROM documents
      UNION ALL
      SELECT doc_id, piece_no + 1, trim(left(rest, n)), ltrim(substr(rest, n + 1))
      FROM (SELECT *, {CUT.format(n=500, least=225)} AS n FROM cut WHERE rest <> ''))
    SELECT doc_id, piece_no, length(piece) AS chars, md5(piece) AS digest FROM cut WHERE piece_no >= 0"""

CHUNKS = f"""
    cleaned AS (SELECT doc, num, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
        ' ' || chr(10)) AS text FROM doc_pages),
    found AS (SELECT doc, num, text, TRY_CAST(regexp_extract({LESSON_OF}, '\\d{{1,2}}') AS BIGINT) AS n FROM cleaned WHERE text <> ''),
    lessons AS (SELECT doc, num, text, last_value(CASE WHEN n BETWEEN 1 AND 25 THEN n END IGNORE NULLS)
        OVER (PARTITION BY doc ORDER BY num ROWS UNBOUNDED PRECEDING) AS lesson FROM found),
    lines AS (SELECT doc, num, lesson, l.line AS line, l.i AS i FROM lessons,
        LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) l WHERE l.line <> ''),
    cut AS (
      SELECT doc, num, lesson, i, -1 AS piece_no, '' AS piece, line AS rest FROM lines
      UNION ALL
      SELECT doc, num, lesson, i, piece_no + 1, trim(left(rest, n)), ltrim(substr(rest, n + 1))
      FROM (SELECT *, {CUT.format(n=4200, least=1890)} AS n FROM cut WHERE rest <> '')),
    pieces AS (SELECT doc, num, lesson, piece, row_number() OVER (PARTITION BY doc ORDER BY num, i, piece_no) AS k,
        row_number() OVER (PARTITION BY doc, num ORDER BY i, piece_no) - 1 AS on_page FROM cut WHERE piece_no >= 0),
    packed AS (
      SELECT doc, num, lesson, piece, k, length(piece) + 1 AS used, num AS page_start, on_page AS piece_start, lesson AS first_lesson FROM pieces WHERE k = 1
      UNION ALL
      SELECT p.doc, p.num, p.lesson, p.piece, p.k,
        CASE WHEN c.used + length(p.piece) + 1 > 4200 THEN length(p.piece) + 1 ELSE c.used + length(p.piece) + 1 END,
        CASE WHEN c.used + length(p.piece) + 1 > 4200 THEN p.num ELSE c.page_start END,
        CASE WHEN c.used + length(p.piece) + 1 > 4200 THEN p.on_page ELSE c.piece_start END,
        CASE WHEN c.used + length(p.piece) + 1 > 4200 THEN p.lesson ELSE c.first_lesson END
      FROM packed c JOIN pieces p ON p.doc = c.doc AND p.k = c.k + 1),
    chunks AS (SELECT doc, page_start, piece_start, max(num) AS page_end, any_value(first_lesson) AS lesson,
        string_agg(piece, chr(10) ORDER BY k) AS body FROM packed GROUP BY 1, 2, 3),
    headed AS (SELECT *, 'PDF_PAGE: ' || page_start || CASE WHEN page_end <> page_start THEN '-' || page_end ELSE '' END
        || coalesce(chr(10) || 'LESSON_CONTEXT: ' || lesson, '') || chr(10) || chr(10) || body AS text FROM chunks)
    SELECT doc, page_start, piece_start, page_end, lesson, length(text) AS chars, md5(text) AS digest FROM headed"""

DOC_TEXT = """
    SELECT doc, length(t) AS chars, md5(t) AS digest FROM (
      SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY num) FILTER (text ~ '(?s).*\\S.*') AS t FROM doc_pages GROUP BY 1
      HAVING count(*) <= 250 AND sum(strlen(text)) <= 26214400) WHERE t IS NOT NULL"""

LIMITS = """
    WITH d AS (SELECT lang || '/' || source || '/' || (doc_id // 2000) AS doc, text FROM documents),
    s AS (SELECT doc, count(*) AS pages, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (text ~ '(?s).*\\S.*') AS shown,
        CAST(sum(strlen(text)) FILTER (text ~ '(?s).*\\S.*') AS BIGINT) AS shown_bytes FROM d GROUP BY 1)
    SELECT doc, CASE WHEN bytes > 60000 OR pages > 30 THEN pages ELSE shown END AS pages,
      CASE WHEN bytes > 60000 OR pages > 30 THEN bytes ELSE shown_bytes END AS bytes,
      CASE WHEN bytes > 60000 THEN 'bytes' WHEN pages > 30 THEN 'pages' ELSE 'kept' END AS reason FROM s WHERE shown > 0 OR bytes > 60000 OR pages > 30"""

ACCURACY = """
    WITH j AS (SELECT CASE WHEN quality = 1 THEN n_chars >= 1000 ELSE n_chars >= 100 AND n_chars < 1000 AND n_chars % 2 = 0 END AS p
               FROM labels LEFT JOIN documents USING (doc_id))
    SELECT count(*) FILTER (p) AS passed, count(*) FILTER (p IS NOT TRUE) AS failed, count(*) AS total,
      round(count(*) FILTER (p) / count(*), 6) AS accuracy FROM j"""

CHECKS = f"""
    WITH cleaned AS (SELECT doc, num, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
        ' ' || chr(10)) AS t FROM doc_pages),
    d AS (SELECT doc, count(*) AS pages, string_agg(t, chr(10) ORDER BY num) AS text FROM cleaned WHERE t <> '' GROUP BY 1),
    n AS (SELECT *, TRY_CAST(regexp_extract({LESSON_OF}, '\\d{{1,2}}') AS BIGINT) AS n, upper(regexp_extract(text, '(?i)\\b(N[45])\\b', 1)) AS l FROM d),
    m AS (SELECT doc, pages, length(text) AS characters, nullif(l, '') AS level, CASE WHEN n BETWEEN 1 AND 25 THEN n END AS lesson,
        list_filter(['the', 'zzzz', 'ation'], lambda s: NOT contains(text, s)) AS missing FROM n)
    SELECT doc, pages, characters, level, lesson, array_to_string(missing, '|') AS missing_text,
      CAST(pages >= 90 AND characters >= 1000 AND len(missing) = 0 AND coalesce(lesson = 7, FALSE) AS BIGINT) AS passed FROM m"""

QUERIES = {
    "nfkc": (nfkc, "SELECT doc_id, md5(text) AS digest FROM documents"),
    "clean_text": (clean_text, CLEAN.strip()),
    "identity_keys": (keys, KEYS.strip()),
    "kana_forms": (kana, KANA.strip()),
    "detect_headers": (headers, HEADERS.strip()),
    "clean_fields": (clean_fields, FIELDS.strip()),
    "meaning_keys": (meaning_keys, MEANING.strip()),
    "similarities": (similarities, SIMILAR.strip()),
    "normalize_words": (normalize_words, NORMALIZED.strip()),
    "word_rejects": (word_rejects, REJECTS.strip()),
    "parse_responses": (parse_responses, v.with_views(RESPONSES, "words")),
    "parse_lines": (parse_lines, LINES.strip()),
    "fill_lesson": (fill_lesson, v.with_views(LESSON, "doc_pages")),
    "split_long_lines": (split_long_lines, "WITH RECURSIVE " + SPLIT.strip()),
    "chunk_pages": (chunk_pages, f"WITH RECURSIVE doc_pages AS ({v.SQL['doc_pages']}), " + CHUNKS.strip()),
    "doc_text": (doc_text, v.with_views(DOC_TEXT, "doc_pages")),
    "read_pages_limits": (read_pages_limits, LIMITS.strip()),
    "accuracy_report": (accuracy_report, ACCURACY.strip()),
    "extraction_checks": (extraction_checks, v.with_views(CHECKS, "doc_pages")),
}
