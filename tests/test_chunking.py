import random
import re

import pytest

from lexiloom.operators import chunking
from lexiloom.sources import files

MARKS = "。！？!?、；;:："


def split_line(line, limit):
    parts = []
    while len(line) > limit:
        at = max((i for i, c in enumerate(line[:limit]) if c in MARKS), default=-1)
        cut = at + 1 if at >= 0 and at >= int(limit * 0.45) else limit
        parts.append(line[:cut].strip())
        line = line[cut:].lstrip()
    return parts + ([line] if line else [])


def pack(pages, limit):
    """Plain sequential packing of one document."""
    chunks, lines, used, lesson = [], [], 0, None
    for num, text in pages:
        text = re.sub(r"[ \t]+", " ", text).strip()
        m = re.search(r"Lesson (\d{1,2})", text)
        if m and 1 <= int(m[1]) <= 25:
            lesson = int(m[1])
        for line in text.split("\n"):
            for piece in split_line(line.strip(), limit) if line.strip() else []:
                if lines and used + len(piece) + 1 > limit:
                    chunks.append((start, end, first_lesson, lines))
                    lines, used = [], 0
                if not lines:
                    start, first_lesson = num, lesson
                lines.append(piece)
                used += len(piece) + 1
                end = num
    if lines:
        chunks.append((start, end, first_lesson, lines))
    out = []
    for start, end, lesson, lines in chunks:
        head = f"PDF_PAGE: {start}" + (f"-{end}" if end != start else "")
        if lesson:
            head += f"\nLESSON_CONTEXT: {lesson}"
        out.append((start, end, lesson, head + "\n\n" + "\n".join(lines)))
    return out


def test_fixture_chunks(spark):
    pages = spark.createDataFrame(
        [("d", 1, "第1課\nすし\nこれは長い文です。次の文です。"), ("d", 2, "食べます\nおいしいです。")], "doc string, num long, text string")
    rows = chunking.pages_to_chunks(pages, 18).orderBy("page_start", "piece_start").collect()
    assert len(rows) >= 2
    assert "PDF_PAGE: 1" in rows[0].text and "LESSON_CONTEXT: 1" in rows[0].text
    assert all("PDF_PAGE" in r.text for r in rows)


@pytest.mark.parametrize("limit,run_pages,fan", [(30, 3, 64), (80, 1, 2), (500, 7, 3), (25, 16384, 64), (60, 1, 3)])
def test_chunks_match_sequential_packing(spark, limit, run_pages, fan):
    rng = random.Random(limit)
    rows, expected = [], []
    for doc, n in (("hot", 60), ("b", 9), ("c", 1), ("empty", 2)):
        pages = []
        for num in range(n):
            lines = ["".join(rng.choice("abc d。;é") for _ in range(rng.choice([0, 1, 5, 20, 70]))) for _ in range(rng.randint(0, 5))]
            if rng.random() < 0.2:
                lines.insert(0, f"Lesson {rng.randint(1, 30)}")
            pages.append((num * 2, "" if doc == "empty" else "\n".join(lines)))
        rows += [(doc, *p) for p in pages]
        expected += [(doc, *c) for c in pack(pages, limit)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, num long, text string").repartition(4)
    got = chunking.pages_to_chunks(df, limit, run_pages, fan).orderBy("doc", "page_start", "piece_start").collect()
    assert [(r.doc, r.page_start, r.page_end, r.lesson, r.text) for r in got] == sorted(expected, key=lambda e: e[0])


def test_split_long_lines(spark):
    lines = ["あ" * 10 + "。" + "い" * 30, "x" * 95, "a" * 3 + "!" + "b" * 60, "short", "p; " * 40]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {}
    for r in chunking.split_long_lines(df, "line", 20).orderBy("i", "piece_no").collect():
        got.setdefault(r.i, []).append(r.piece)
    assert got == {i: split_line(line.strip(), 20) for i, line in enumerate(lines)}


def test_fill_lesson(spark):
    texts = {0: "intro", 5: "Lesson 3", 6: "x", 9: "Lesson 77", 12: "第4課", 30: "y", 31: "z"}
    df = spark.createDataFrame([("d", n, t) for n, t in texts.items()] + [("e", 1, "x")], "doc string, num long, text string")
    for span in (1, 4, 4096):
        rows = chunking.fill_lesson(df, span).orderBy("doc", "num").collect()
        assert [r.lesson for r in rows] == [None, 3, 3, 3, 4, 4, 4, None]


def test_read_pages_and_doc_text(spark):
    df = spark.createDataFrame(
        [("a", 2, "two"), ("a", 1, "one"), ("a", 3, " 　\n"), ("b", 1, "x" * 50), ("c", 1, "1"), ("c", 2, "2"), ("c", 3, "3"), ("c", 4, "4")],
        "doc string, num long, text string")
    kept, rejects = files.read_pages(df, max_bytes=40, max_pages=3)
    assert {(r.doc, r.reason) for r in rejects.collect()} == {("b", "bytes"), ("c", "pages")}
    assert {(r.doc, r.num) for r in kept.collect()} == {("a", 1), ("a", 2)}
    assert [(r.doc, r.text) for r in files.doc_text(df, 40, 3).collect()] == [("a", "one\n\ntwo")]


def test_list_files(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"abc")
    rows = files.list_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.pdf", "b.PDF"]
    assert files.list_files(spark, str(tmp_path / "missing")).count() == 0


def test_report_and_failed_files(spark, tmp_path):
    from lexiloom.operators.ingest import failed_files

    df = spark.createDataFrame([("a", 1), ("b", 2)], "doc string, n long")
    files.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert [r.doc for r in failed_files(df, df.filter("n = 1")).collect()] == ["b"]


def test_safe_json(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, '{"k": 1}'), (1, "{bad"), (2, ""), (3, None)], "i int, t string")
    out = df.select("i", files.safe_json("t", "struct<k: int>", F.struct(F.lit(0).alias("k"))).alias("v")).orderBy("i").collect()
    assert [r.v.k for r in out] == [1, 0, 0, 0]
