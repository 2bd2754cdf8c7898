"""Pages are cleaned only where they need it, and words cut from them are not cleaned again."""

import random
import re
import unicodedata

from pyspark.sql import functions as F
from test_matching import VOCAB
from test_scale_r06 import optimized

from lexiloom.functions import text
from lexiloom.operators import pages, words

CANDIDATES = (
    "candidate_id string, batch_id string, page_id long, incoming_json string, canonical_key string, decision_kind string, "
    "status string, vocabulary_id long, reasons_json string, created_at timestamp")
MARKS = "\u00ad\u200b\u200c\u200d\ufeff"
PIECES = [
    "a", "bc", "é", "e", "\u0301", "は", "バ", "か", "\u3099", "\u103a", "က", "橋", "ﾊ", "ﾞ", "\U00020000", "ﬁ", "¨",
    ";", "；", ";", "\n", "\n\n", "\n\n\n", " ", "  ", " \n", "\n ", "\t", "\f", "\x0b", "\r", "\r\n", *text.SPACES, *MARKS,
    "「", "）", "[", "<", "x" * 79, "က" * 299, "≯", "\u0338", "\u0323"]
SOME = [" は", " ば\u200d", " は\u00ad\u3099", "\u2028は", " バ「", "\u1680က", " က", " က\u200b\u103a", " 橋", "\n橋", ";橋", "\n", ";\u2029 ", "x"]


def made_texts():
    rng = random.Random(7)
    given = [None, "", " ", "\n", "plain", "a b c", " a b\nc ", "a\n\nb", "a\n\n\nb", "a \nb", "e\u200d\u0301 は\u00ad\u3099 က\u200b\u103a"]
    return given + ["".join(rng.choice(p) for _ in range(rng.randint(1, 14))) for p in [PIECES, SOME] for _ in range(400)]


def cleaned_by_steps(t):
    if t is None:
        return None
    t = re.sub(f"[{MARKS}]", "", unicodedata.normalize("NFKC", t))
    t = re.sub("[ \t\f\x0b]+", " ", re.sub("\r\n?", "\n", t))
    return re.sub("\n{3,}", "\n\n", "\n".join(line.strip(text.SPACES) for line in t.split("\n"))).strip(text.SPACES)


def words_by_steps(t):
    """Every field of every part composed and cleaned by itself."""
    found = []
    for position, part in enumerate(re.split("[\n;]", t)):
        fields = [unicodedata.normalize("NFKC", f) for f in re.split(f"[{text.SPACES}]+", part)] + ["", ""]
        surface, reading, meaning = fields[0][:80], re.sub("[「」『』【】（）()［］\\[\\]〈〉<>]", "", fields[1]), fields[2][:300]
        reading = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in reading)
        if re.search("[ぁ-ゖァ-ヺー]", reading) and re.search("[က-႟ꩠ-ꩿ]", meaning):
            found.append((position, surface or None, reading, meaning))
    return found


def test_clean_text_equals_its_steps(spark):
    given = made_texts()
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.clean_text("t").alias("c")).collect()}
    assert [got[i] for i in range(len(given))] == [cleaned_by_steps(t) for t in given]
    assert any(t is not None and cleaned_by_steps(t) != t.strip(text.SPACES) for t in given)


def test_words_are_cut_as_if_every_field_were_cleaned(spark):
    given = [t or "" for t in made_texts()]
    df = spark.createDataFrame(list(enumerate(given)), "page_id int, text string")
    want = {(i, *w) for i, t in enumerate(given) for w in words_by_steps(cleaned_by_steps(t))}
    got = [tuple(r) for r in words.parse_lines(df).select("page_id", "position", "kanji", "kana", "burmese_meaning").collect()]
    assert set(got) == want and len(got) == len(want) > 50
    held = df.select("page_id", text.clean_text("text").alias("t")).withColumn("has", words.has_word(F.col("t")))
    assert {r.page_id for r in held.filter("has").collect()} == {w[0] for w in want}


def reprocessed(spark, rows):
    p = spark.createDataFrame(rows, "page_id long, batch_id string, raw_text string")
    return pages.reprocess(p, spark.createDataFrame([], CANDIDATES), spark.createDataFrame([], VOCAB))


def test_texts_of_pages_with_one_row_each_stay_where_they_are(spark):
    rows = [(1, "b", "橋 はし တံတား"), (2, "b", "x"), (None, "b", "橋 はし တံတား"), (None, "b", "x"), (3, "b", "x y\n橋 はし တံတား")]
    out, _ = reprocessed(spark, rows)
    plan = optimized(out)
    assert "Window" not in plan and "Join" not in plan
    assert sorted((r.page_id or 0, r.status) for r in out.collect()) == [
        (0, "failed"), (0, "failed"), (1, "needs_review"), (2, "failed"), (3, "needs_review")]
    out, _ = reprocessed(spark, [*rows, (2, "b", "橋 はし တံတား")])
    assert sorted((r.page_id or 0, r.status) for r in out.collect())[3:5] == [(2, "needs_review"), (2, "needs_review")]


def test_words_cut_from_a_page_are_not_composed_again(spark):
    _, fresh = reprocessed(spark, [(1, "b", "\u200d橋 [バ\u00adシ] တံတား;は\u200d\u3099 は\u200d\u3099 က")])
    plan = optimized(fresh.select("candidate_id", "canonical_key"))
    above = plan.split("Generate posexplode")[0]
    assert "Generate posexplode" in plan and "java_method" not in above and "regexp_replace" not in above
    rows = [(r.candidate_id, r.canonical_key, r.decision_kind) for r in fresh.orderBy("candidate_id").collect()]
    assert rows == [("1-0", "surface:橋\0reading:ばし", "new"), ("1-1", "surface:ば\0reading:ば", "new")]
