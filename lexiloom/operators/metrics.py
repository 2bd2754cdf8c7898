"""Ingestion quality: trends, summary, percentiles, history and counts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import day, in_range
from ..session import cut_lineage
from .ordered import top_k

# Newest batches a summary looks at, default and largest history page.
SUMMARY_BATCHES, HISTORY_DEFAULT, HISTORY_MAX = 500, 25, 100


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def batch_trends(batches: DataFrame, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """Batches, OCR share, duplicate and review rates and mean duration per UTC day."""
    sums = in_range(batches, "created_at", from_day, to_day).groupBy(day("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.sum(c).alias(c) for c in ("total_pages", "ocr_pages", "extracted_candidates", "duplicate_count", "review_count")],
        F.avg("duration_ms").alias("duration"),
    )
    candidates = F.col("extracted_candidates")
    return sums.select(
        "day", "batches",
        ratio(F.col("ocr_pages"), F.col("total_pages")).alias("ocr_page_rate"),
        ratio(F.col("duplicate_count"), candidates).alias("duplicate_rate"),
        ratio(F.col("review_count"), candidates).alias("fuzzy_review_rate"),
        F.coalesce(F.round("duration"), F.lit(0.0)).cast("long").alias("average_duration_ms"),
    ).orderBy("day")


def batch_summary(
    batches: DataFrame, pages: DataFrame, candidates: DataFrame, from_day: str | None = None,
    to_day: str | None = None, cap: int = SUMMARY_BATCHES,
) -> DataFrame:
    """One row: totals and quality of the newest ``cap`` batches in range, attention over all.

    The top ``cap`` batches are found by a partial top-k per task; only they reach the exact
    percentiles.
    """
    ranged = in_range(batches, "created_at", from_day, to_day)
    newest = ranged.orderBy(F.col("created_at").desc(), F.col("batch_id").desc()).limit(cap)
    done = F.col("status") == "completed"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    # The ascending element at floor(share * n) is the discrete percentile 1 - share of the
    # descending order; at these shares the two agree for every n.
    durations = F.when(done, F.col("duration_ms"))
    sums = newest.withColumn("_duration", durations).agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        total("extracted_candidates").alias("c"), total("duplicate_count").alias("d"), total("review_count").alias("r"),
        total("ocr_pages").alias("o"), total("total_pages").alias("p"),
        F.coalesce(F.sum(F.when(done, F.col("imported_candidates"))), F.lit(0)).alias("i"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _duration DESC)").alias("m"),
        F.expr("percentile_disc(0.05) WITHIN GROUP (ORDER BY _duration DESC)").alias("q"),
    )
    keys = ranged.select("batch_id")

    def attention(df: DataFrame, status: str) -> Column:
        return df.filter(F.col("status") == status).join(keys, "batch_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()

    c = F.col("c")
    return sums.select(
        "batches", "completed", "failed", "needs_review",
        ratio(c - F.col("d"), c).alias("selectable_accuracy"),
        F.when(F.col("o") > 0, F.col("i") / F.greatest(F.lit(1), c)).otherwise(F.lit(0.0)).alias("ocr_accuracy"),
        ratio(F.col("o"), F.col("p")).alias("ocr_page_rate"), ratio(F.col("d"), c).alias("duplicate_rate"),
        ratio(F.col("r"), c).alias("fuzzy_review_rate"),
        F.coalesce("m", F.lit(0)).cast("long").alias("median_duration_ms"),
        F.coalesce("q", F.lit(0)).cast("long").alias("p95_duration_ms"),
        attention(pages, "needs_review").alias("attention_pages"),
        attention(candidates, "pending").alias("attention_candidates"),
    )


#: Bits of a number that one histogram tells apart, at most.
DIGIT_BITS = 16


def rank_percentiles(df: DataFrame, col: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Elements of the ascending order at floor(share * n), one column per share, over all rows.

    For whole numbers of up to 64 bits.  Bits that the smallest and the largest number share are the same in all of them; the
    others are found up to 16 at a time, by histograms of at most 65,536 counts each, in place of a sort of the whole
    column.  The column alone is written once and read by these passes.  Other types are refused.
    """
    if df.schema[col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{col} does not hold whole numbers")
    shares = shares or {"median": 0.5, "p95": 0.95}
    sign = F.lit(-(2**63))
    value = F.col(col).cast("long").bitwiseXOR(sign)  # orders like an unsigned number
    values = cut_lineage(df.filter(F.col(col).isNotNull()).select(value.alias("v")))
    ends = values.agg(F.min(F.col("v").bitwiseXOR(sign)).alias("low"), F.max(F.col("v").bitwiseXOR(sign)).alias("high")).first()
    low, high = ((x or 0) + 2**63 for x in ends)
    differ = (low ^ high).bit_length()
    passes = max(1, -(-differ // DIGIT_BITS))
    width = max(1, -(-differ // passes))
    offsets = [width * k for k in reversed(range(passes))]
    names = [f"d{i}" for i in range(passes)]
    values = values.select(*[
        F.shiftrightunsigned("v", bits).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias(n) for n, bits in zip(names, offsets)])
    index = lambda s: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(s)).cast("long"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), index(s).alias("rest")) for n, s in shares.items()])
    ladder = values.groupBy("d0").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("d0", "n"))).alias("steps"), F.sum("n").alias("total"))
    targets = (
        ladder.filter("total > 0").select("steps", F.inline(wanted)).withColumn("hit", _step_at("steps", "d0", "rest"))
        .select("name", F.col("hit.rest").alias("rest"), F.col("hit.key").cast("int").alias("d0"))
    )
    for i, digit in list(enumerate(names))[1:]:
        within = values.join(F.broadcast(targets), names[:i])  # one row per share
        counts = within.groupBy("name", "rest", *names[: i + 1]).agg(F.count(F.lit(1)).alias("n"))
        steps = counts.groupBy("name", "rest", *names[:i]).agg(
            F.array_sort(F.collect_list(F.struct(digit, "n"))).alias("steps"))  # at most 65,536
        targets = steps.withColumn("hit", _step_at("steps", digit, "rest")).select(
            "name", F.col("hit.rest").alias("rest"), *names[:i], F.col("hit.key").cast("int").alias(digit))
    known = width * passes
    shared = (low >> known) << known
    exact = F.lit(shared - 2**64 if shared >= 2**63 else shared).cast("long")
    for digit, bits in zip(names, offsets):
        exact = exact.bitwiseOR(F.shiftleft(F.col(digit).cast("long"), bits))
    exact = targets.select("name", exact.bitwiseXOR(sign).alias("value"))
    return exact.agg(*[
        F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0)).alias(n) for n in shares])


def _step_at(steps: str, key: str, index: str) -> Column:
    """Bucket holding the element at ``index``, and the index inside it."""
    start = F.struct(F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("rest"))

    def walk(acc: Column, s: Column) -> Column:
        here = acc["key"].isNull() & (acc["seen"] + s["n"] > F.col(index))
        return F.struct(
            F.when(here, s[key]).otherwise(acc["key"]).alias("key"), (acc["seen"] + s["n"]).alias("seen"),
            F.when(here, F.col(index) - acc["seen"]).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(F.col(steps), start, walk)


def batch_history(
    batches: DataFrame, status: str | None = None, source: str | None = None, from_day: str | None = None,
    to_day: str | None = None, limit: int | None = HISTORY_DEFAULT,
) -> DataFrame:
    """Newest batches; the source filter ignores ASCII case."""
    df = in_range(batches, "created_at", from_day, to_day)
    if status:
        df = df.filter(F.col("status") == status)
    if source:
        folded = F.translate("source_name", ascii_uppercase, ascii_lowercase)
        df = df.filter(F.contains(folded, F.lit(source.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))))
    k = min(limit, HISTORY_MAX) if limit and limit > 0 else HISTORY_DEFAULT
    return df.orderBy(F.col("created_at").desc(), F.col("batch_id").desc()).limit(k)


def relation_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Number of child rows per parent, 0 where there are none."""
    out = parents.select(key)
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(
            name, F.coalesce(name, F.lit(0)))
    return out


def newest_metrics(metrics: DataFrame, k: int = 100) -> DataFrame:
    """Newest ``k`` metrics of every batch."""
    return top_k(metrics, ["batch_id"], [F.col("created_at").desc(), F.col("metric_id").desc()], k)
