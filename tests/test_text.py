from pyspark.sql import functions as F

from lexiloom.functions import identity, similarity, temporal, text


def values(spark, expr, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    dirty = "第１課\r\n​ すし   を   食べます \r\n\r\n\r\n"
    assert values(spark, text.clean_text("t"), dirty, "a­b\rc", "x\n\n\n\n\ny", "　a\t\tb　", None) == [
        "第1課\nすし を 食べます", "ab\nc", "x\n\ny", "a b", None]


def test_keys(spark):
    assert values(spark, identity.reading_key("t"), "スーパー", "  たべます  ", "（ガッコウ）", "「か」 き") == [
        "すーぱー", "たべます", "がっこう", "かき"]
    assert values(spark, identity.norm_surface("t"), " 食べ　 物 ", None) == ["食べ 物", ""]
    df = spark.createDataFrame([("食べる", "たべる"), ("食べる", "タベル"), (None, "タベル")], "s string, r string")
    keys = [r.k for r in df.select(identity.canonical_key("s", "r").alias("k")).collect()]
    assert keys == ["surface:食べる\0reading:たべる"] * 2 + ["reading:たべる"]


def test_headers(spark):
    assert values(spark, text.detect_lesson("t"), "みんなの日本語 第１２課", "Lesson 4 vocabulary", "Lesson 123", "lesson 40 unit 3",
                  "none", "UNIT7") == [12, 4, 12, None, None, 7]
    assert values(spark, text.detect_level("t"), "JLPT N4 reading", "beginner list", "日本n5語", "xN5", "N45") == [
        "N4", None, "N5", None, None]


def test_kana(spark):
    assert values(spark, text.fold_kana("t"), "キャッチ", "ファ") == ["きやつち", "ふあ"]
    assert values(spark, text.simple_romaji("t"), "きょう", "がっこう", "かんぱ", "かんび", "たべる", "xゃ", "ーゃ", "っ", "あっーい", "") == [
        "kiyou", "gakkou", "kampa", "kanbi", "taberu", "ya", "ya", "", "a?ーi", ""]


def test_parsing(spark):
    assert values(spark, text.parse_lesson("t", 9), "5", " 5.0 ", "26", "x", "", None, "1e1", "5d") == [5, 5, 9, 9, 9, 9, 10, 9]
    assert values(spark, text.parse_level("t", "N5"), "n4", "N3", " N4", None) == ["N4", "N5", "N5", "N5"]
    assert values(spark, text.clean_optional("t", 4), " a\r\nb  cdef", "   ", None) == ["a b ", None, None]
    assert values(spark, text.strip_fence("t"), '```json\n{"a":[1]}\n```', 'say [1,2] ok', "none", "}{", "```\n[]```") == [
        '{"a":[1]}', "[1,2]", "none", "}{", "[]"]


def test_similarity(spark):
    df = spark.createDataFrame([("စားသည်", "စားသည်"), ("စားသည်", "စားနေသည်"), ("", "a"), ("a", "b"), ("A!", "a")], "a string, b string")
    got = [r.v for r in df.select(similarity.jaccard_bigrams("a", "b").alias("v")).collect()]
    assert got[0] == 1 and 0 < got[1] < 1 and got[2:] == [0, 0, 1]
    assert values(spark, similarity.edit_distance("t", F.lit("たべゐる")), "たべる", "たべゐる") == [1, 0]
    assert sorted(values(spark, similarity.deletion_variants("t"), "aab")[0]) == ["aa", "aab", "ab"]


def test_time(spark):
    ts = F.col("t").cast("timestamp")
    assert values(spark, temporal.iso(ts), "2024-01-31 10:00:00", None) == ["2024-01-31T10:00:00.000Z", None]
    assert values(spark, temporal.iso(temporal.add_days(ts, 21)), "2024-01-31 10:00:00") == ["2024-02-21T10:00:00.000Z"]
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 23:59:59.999",), ("2024-01-03 00:00:00",)], "t string")
    df = df.select(F.col("t").cast("timestamp").alias("t"))
    assert temporal.in_range(df, "t", "2024-01-01", "2024-01-02").count() == 2
    assert temporal.in_range(df, "t", None, "2024-01-01").count() == 1
