"""Page text to lesson-tagged chunks of bounded size.

Packing lines greedily into chunks looks sequential: where a chunk starts depends on all
earlier lines of the document.  It is still a prefix computation.  For a page, the state after
it depends on the state before it only through *which line starts the first new chunk*, so a
page is a short step function of the characters already used.  Step functions compose, hence
a document of any length is packed by three passes over narrow rows (lengths only, no text):
compose the pages of each run, carry the state over the runs, replay the pages of each run.  The
runs of a very long document are joined in a tree, so no task walks all of them.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import LESSON_PATTERN, LESSON_MAX, SPACE_CLASS, clean_text, detect_lesson, js_trim
from ..session import cut_lineage
from .folds import fold_sorted
from .ordered import fill_forward, join_same

# Default chunk size, sentence marks, and the share of a line a cut must keep.
CHUNK_CHARS = 4200
SENTENCE_MARKS = "[。！？!?、；;:：]"
KEEP_SHARE = 0.45

#: Pages of a run, runs that are joined at a time, and bits for pages that repeat a number.
RUN_PAGES, RUN_FAN, PLACE_BITS = 16384, 64, 20


def line_pieces(line: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """Pieces of a trimmed line, each at most ``max_chars`` long.

    A piece ends after the last sentence mark past 45 % of the limit, or at the limit.
    """
    least = int(max_chars * KEEP_SHARE)
    pattern = (
        rf"(?s)[{SPACE_CLASS}]*+(.{{1,{max_chars}}}\z"
        rf"|.{{{least},{max_chars - 1}}}{SENTENCE_MARKS}|.{{{max_chars}}})"
    )
    return F.when(F.length(line) <= max_chars, F.array(line)).otherwise(
        F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), js_trim)
    )


def split_long_lines(df: DataFrame, col: str, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per piece of each line in ``col``, with its position."""
    pieces = F.posexplode(line_pieces(F.col(col), max_chars)).alias("piece_no", "piece")
    return df.select(*[c for c in df.columns if c != col], pieces)


def page_pieces(text: Column, max_chars: int) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: line_pieces(x, max_chars)))


def fill_lesson(pages: DataFrame, span: int = 4096) -> DataFrame:
    """Lesson in force on every page (doc, num, text): the last one announced so far."""
    # The lessons are carried and filled in from the same rows, so texts are searched once.
    found = cut_lineage(pages.withColumn("page_lesson", detect_lesson("text")))
    return fill_forward(found, ["doc"], "num", "page_lesson", "lesson", span, ties=["text"])


# --- step functions -----------------------------------------------------------------------
# A state is (used, page, piece, lesson): characters used in the open chunk, where that chunk
# started, and the lesson in force.  "used" of limit+1 means that nothing is open, so any next
# piece starts a chunk.  A step function is (limits, exits, total): with descending limits, the
# first branch whose limit is below the used characters tells the exit; without one the open
# chunk just grows by total.


def page_steps(costs: list[int], limit: int) -> tuple[list[int], list[tuple[int, int]], int]:
    """Branches of one page: limits, exits (used, piece that starts the last chunk), total."""
    n = len(costs)
    sums = [0] * (n + 1)
    for i, c in enumerate(costs):
        sums[i + 1] = sums[i] + c
    exits: list[tuple[int, int]] = [(0, 0)] * n
    end = n
    for i in range(n - 1, -1, -1):
        while end > i + 1 and sums[end] - sums[i] > limit:
            end -= 1
        exits[i] = (sums[n] - sums[i], i) if end == n else exits[end]
    limits, kept = [], []
    for j in range(n):
        limits.append(limit - sums[j + 1])
        kept.append(exits[j])
        if limits[-1] < 1:
            break
    return limits, kept, sums[n]


def branch(limits: list[int], used: int) -> int:
    """Index of the first limit below ``used`` in a descending list, or its length."""
    return bisect_left(limits, True, key=lambda x: x < used)


def page_starts(costs: list[int], limit: int, used: int) -> tuple[list[int], int]:
    """Pieces of a page that start a chunk, given the used characters; and the new used."""
    starts = []
    for i, c in enumerate(costs):
        if used + c > limit:
            starts.append(i)
            used = 0
        used += c
    return starts, used


_RUN = pa.schema([
    ("doc", pa.string()), ("run", pa.int64()), ("limits", pa.list_(pa.int32())), ("used", pa.list_(pa.int32())),
    ("page", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("total", pa.int64()), ("lesson", pa.int32()),
])
_ENTRY = pa.schema([
    ("doc", pa.string()), ("run", pa.int64()), ("used", pa.int32()), ("page", pa.int64()), ("piece", pa.int32()),
    ("lesson", pa.int32()),
])
_CUTS = pa.schema([
    ("doc", pa.string()), ("num", pa.int64()), ("open_page", pa.int64()), ("open_piece", pa.int32()),
    ("starts", pa.list_(pa.int32())), ("lesson", pa.int32()),
])


def compose(limits: list, exits: list, total: int, r_limits: list, r_exits: list, r_total: int) -> tuple[list, list, int]:
    """One step function after another; exits are (used, page, piece)."""
    moved = []
    for used, page, piece in exits:
        b = branch(r_limits, used)
        moved.append(r_exits[b] if b < len(r_limits) else (used + r_total, page, piece))
    new_limits, new_exits = [], []

    def add(lim, state):
        if new_exits and new_exits[-1] == state:
            new_limits[-1] = lim
        else:
            new_limits.append(lim)
            new_exits.append(state)

    for lim, state in zip(limits, moved):
        add(lim, state)
    if not limits or limits[-1] >= 1:
        for lim, state in zip(r_limits, r_exits):
            add(lim - total, state)
            if lim - total < 1:
                break
    return new_limits, new_exits, total + r_total


def _compose_runs(limit: int):
    """Fold the pages of each run, streamed in order, into one step function."""

    def steps(rows):
        for doc, run, num, costs, page_lesson in rows:
            limits, exits, total = page_steps(costs, limit)
            yield doc, run, limits, [(used, num, piece) for used, piece in exits], total, page_lesson

    return lambda rows: _fold_steps(steps(rows))


def _compose_groups(rows):
    """Fold the runs of each group, streamed in order, into one step function."""
    return _fold_steps(
        (doc, group, limits, list(zip(used, page, piece)), total, lesson)
        for doc, group, _, limits, used, page, piece, total, lesson in rows)


def _fold_steps(steps):
    key, step, lesson = None, ([], [], 0), None

    def done():
        limits, exits, total = step
        return (*key, limits, *([e[k] for e in exits] for k in range(3)), total, lesson)

    for doc, run, limits, exits, total, own_lesson in steps:
        if (doc, run) != key:
            if key is not None:
                yield done()
            key, step, lesson = (doc, run), ([], [], 0), None
        step = compose(*step, limits, exits, total)
        lesson = own_lesson if own_lesson is not None else lesson
    if key is not None:
        yield done()


def _enter_runs(limit: int):
    """Carry the state of each group over its runs, streamed in order; a document's first group starts with nothing open."""

    def fold(rows):
        key, state, lesson = None, (limit + 1, None, None), None
        for doc, group, run, limits, used, page, piece, total, run_lesson, e_used, e_page, e_piece, e_lesson in rows:
            if (doc, group) != key:
                key, lesson = (doc, group), e_lesson
                state = (limit + 1 if e_used is None else e_used, e_page, e_piece)
            yield (doc, run, *state, lesson)
            b = branch(limits, state[0])
            state = (used[b], page[b], piece[b]) if b < len(limits) else (state[0] + total, state[1], state[2])
            lesson = run_lesson if run_lesson is not None else lesson

    return fold


def _entries(runs: DataFrame, deepest: int, limit: int, fan: int) -> DataFrame:
    """State in which every run is entered.

    A tree over the runs of a document: ``fan`` of them make a group with one step function, and so on until the document has no more
    than ``fan``; states are then carried down from group to group.  A task folds ``fan`` step functions at a time,
    however long the document is.
    """
    group = lambda df: df.select("doc", F.floor(F.col("run") / fan).alias("group"), *[c for c in df.columns if c != "doc"])
    levels = [runs]
    while deepest > fan:
        levels[-1] = cut_lineage(levels[-1])
        made = fold_sorted(group(levels[-1]), ["doc", "group"], ["run"], _compose_groups, _RUN)
        levels.append(made)
        deepest = -(-(deepest - 1) // fan) + 1  # groups that a stretch of runs may touch
    state = {"used": "int", "page": "long", "piece": "int", "lesson": "int"}
    entry = None
    for level in reversed(levels):
        if entry is None:
            given = level.select("doc", F.lit(0).cast("long").alias("group"), *[c for c in level.columns if c != "doc"])
            given = given.select("*", *[F.lit(None).cast(t).alias(f"e_{c}") for c, t in state.items()])
        else:
            given = join_same(group(level), entry.withColumnsRenamed({"run": "group", **{c: f"e_{c}" for c in state}}), ["doc", "group"])
        columns = ["doc", "group", "run", "limits", "used", "page", "piece", "total", "lesson", *[f"e_{c}" for c in state]]
        entry = fold_sorted(given.select(*columns), ["doc", "group"], ["run"], _enter_runs(limit), _ENTRY)
    return entry


def _cut_pages(limit: int):
    """Replay the pages of each run from its entry state and list where chunks start."""

    def fold(rows):
        key = used = page = piece = lesson = None
        for doc, run, num, costs, page_lesson, e_used, e_page, e_piece, e_lesson in rows:
            if (doc, run) != key:
                key, used, page, piece, lesson = (doc, run), e_used, e_page, e_piece, e_lesson
            lesson = page_lesson if page_lesson is not None else lesson
            starts, used = page_starts(costs, limit, used)
            yield (doc, num, page, piece, starts, lesson)
            if starts:
                page, piece = num, starts[-1]

    return fold


def pages_to_chunks(pages: DataFrame, max_chars: int = CHUNK_CHARS, run_pages: int = RUN_PAGES, fan: int = RUN_FAN) -> DataFrame:
    """Chunks of at most ``max_chars`` characters per document of a page table (doc, num, text).

    Pages that repeat a number follow each other by their text; a page without a number counts as
    page 0, and pages without a document belong together.
    A document is cut into runs of ``run_pages`` pages, ``fan`` of which are joined at a time.
    Columns: doc, page_start, piece_start (position on the first page), page_end, lesson, text.
    Each text opens with its page range and lesson.
    """
    # A page's place: its number, and its rank among pages of that number in the last 20 bits.
    again = F.row_number().over(Window.partitionBy("doc", "num").orderBy("text")) - 1
    clean = cut_lineage(
        pages.select(F.col("doc").cast("string").alias("doc"), F.coalesce(F.col("num").cast("long"), F.lit(0)).alias("num"),
                     clean_text("text").alias("text"))
        .filter(F.col("text") != "")
        .withColumn("num", F.shiftleft("num", PLACE_BITS) + again)
        .select("doc", "num", page_pieces(F.col("text"), max_chars).alias("pieces"),
                _lesson_of_clean(F.col("text")).alias("lesson"))
    )
    lengths = clean.select(
        "doc", F.floor(F.shiftright("num", PLACE_BITS) / run_pages).alias("run"), "num",
        F.transform("pieces", lambda p: F.length(p) + 1).alias("costs"), "lesson",
    )
    runs = fold_sorted(lengths, ["doc", "run"], ["num"], _compose_runs(max_chars), _RUN)
    stretch = lengths.groupBy("doc").agg((F.max("run") - F.min("run") + 1).alias("n")).agg(F.max("n")).first()[0]
    entries = _entries(runs, stretch or 0, max_chars, fan).withColumnsRenamed(
        {"used": "e_used", "page": "e_page", "piece": "e_piece", "lesson": "e_lesson"})
    cuts = fold_sorted(
        join_same(lengths, entries, ["doc", "run"]).select(*lengths.columns, "e_used", "e_page", "e_piece", "e_lesson"),
        ["doc", "run"], ["num"], _cut_pages(max_chars), _CUTS,
    )
    joined = join_same(clean.drop("lesson"), cuts, ["doc", "num"])
    opens_at = F.when(F.get("starts", F.lit(0)) == 0, F.col("starts")).otherwise(F.concat(F.array(F.lit(0)), "starts"))
    parts = joined.withColumn("opens", opens_at).select(
        "doc", "num", "lesson", "pieces", "opens", "starts", "open_page", "open_piece",
        F.posexplode("opens").alias("at", "first"),
    ).select(
        "doc", "num",
        F.when(F.array_contains("starts", F.col("first")), F.col("num")).otherwise(F.col("open_page")).alias("page_start"),
        F.when(F.array_contains("starts", F.col("first")), F.col("first")).otherwise(F.col("open_piece")).alias("piece_start"),
        "lesson",
        F.array_join(
            F.slice("pieces", F.col("first") + 1,
                    F.coalesce(F.get("opens", F.col("at") + 1), F.size("pieces")) - F.col("first")), "\n",
        ).alias("part"),
    )
    # A chunk holds at most max_chars characters, so the groups collected here are small.
    merged = parts.groupBy("doc", "page_start", "piece_start").agg(
        F.max("num").alias("page_end"),
        F.array_sort(F.collect_list(F.struct("num", "part", "lesson"))).alias("parts"),
    )
    lesson = F.get("parts", F.lit(0))["lesson"]
    merged = merged.withColumns({c: F.shiftright(c, PLACE_BITS) for c in ("page_start", "page_end")})
    span = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(
        F.concat_ws("-", "page_start", "page_end"))
    header = F.concat(F.lit("PDF_PAGE: "), span, F.coalesce(F.concat(F.lit("\nLESSON_CONTEXT: "), lesson), F.lit("")))
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    return merged.select(
        "doc", "page_start", "piece_start", "page_end", lesson.alias("lesson"),
        F.concat(header, F.lit("\n\n"), body).alias("text"),
    )


def _lesson_of_clean(text: Column) -> Column:
    """Lesson of text that is already normalised."""
    number = F.regexp_extract(F.regexp_extract(text, LESSON_PATTERN, 0), r"\d{1,2}", 0).try_cast("int")
    return F.when(number.between(1, LESSON_MAX), number)
