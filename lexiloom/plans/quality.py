"""Ingestion quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import chunking, ingest, metrics, ordered, pages
from ..session import shared_folder
from ..sources import files, report
from . import views as v


def batch_trends(spark, sf):
    return v.plain(metrics.batch_trends(v.batches(spark, sf)))


def batch_summary(spark, sf):
    return v.plain(metrics.batch_summary(
        v.batches(spark, sf), v.batch_pages(spark, sf), v.batch_candidates(spark, sf), "1996-01-01", "2000-12-31"))


def rank_percentiles(spark, sf):
    done = v.batches(spark, sf).filter("status = 'completed'")
    return v.plain(metrics.rank_percentiles(done, "duration_ms"))


def rank_percentiles_wide(spark, sf):
    """Numbers of both signs that need all 64 bits: order keys and prices far apart."""
    o = v.table(spark, sf, "orders").select(
        ((F.col("o_orderkey") % 1000 - 300) * 9_000_000_000_000_000 + F.floor(F.col("o_totalprice"))).alias("wide"))
    return v.plain(metrics.rank_percentiles(o, "wide"))


def report_sink(spark, sf):
    """Orders by status and month, published as a report in two steps and read back."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    months = v.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.floor("o_totalprice")).alias("price"), F.max("o_orderpriority").alias("priority"))
    report.publish_report(months.filter("status = 'F'"), path)
    report.publish_report(months.filter("status <> 'F'"), path, append=True)
    return v.plain(report.read_report(spark, path, "status string, month string, orders long, price long, priority string"))


def failed_files(spark, sf):
    """Files of ten documents each; every seventh has blank pages only and gives no chunk."""
    d = F.expr("doc_id div 10")
    given = v.documents(spark, sf).select(
        d.alias("doc"), F.col("doc_id").alias("num"), F.when(d % 7 == 3, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    return v.plain(ingest.failed_files(given, chunking.pages_to_chunks(given)))


def batch_history(spark, sf):
    rows = metrics.batch_history(v.batches(spark, sf), status="completed", source="customer 1", to_day="2000-06-30", limit=60)
    return v.plain(rows.select("batch_id", "source_name", "status", "created_at", "total_pages", "duration_ms"))


def relation_counts(spark, sf):
    b = v.batches(spark, sf)
    return v.plain(metrics.relation_counts(
        b, "batch_id", {"pages": v.batch_pages(spark, sf), "candidates": v.batch_candidates(spark, sf).filter("status = 'pending'")}))


def top_k_per_group(spark, sf):
    events = v.table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return v.plain(ordered.top_k(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20))


def newest_metrics(spark, sf):
    """Metrics: order lines by supplier, the 100 newest of each."""
    m = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"), F.col("l_shipdate").alias("created_at"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("metric_id"), F.col("l_quantity").alias("value"))
    return v.plain(metrics.newest_metrics(m.groupBy("batch_id", "created_at", "metric_id").agg(F.max("value").alias("value"))))


def batch_times(spark, sf):
    """Serialised batches: ISO start, next review day by interval, and UTC day."""
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 40).alias("days"))
    return v.plain(o.select(
        "o_orderkey", temporal.iso("o_orderdate").alias("started"), temporal.iso(temporal.add_days("o_orderdate", F.col("days"))).alias("next"),
        temporal.day("o_orderdate").alias("day")))


def metric_dimensions(spark, sf):
    """JSON dimensions of every event; every third is cut off and falls back to the default."""
    e = v.table(spark, sf, "events")
    cut = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 3 == 1, F.col("props"))
    parsed = files.safe_json(cut, "struct<k: bigint>", F.struct(F.lit(-1).cast("long").alias("k")))
    return v.plain(e.select("event_id", parsed["k"].alias("k")))


def attention_pages(spark, sf):
    rows = pages.attention_pages(v.batch_pages(spark, sf))
    return v.plain(rows.groupBy("page_number").agg(F.count(F.lit(1)).alias("pages")))


def _rate(num, den):
    return f"round(CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0 END, 6)"


TRENDS = f"""
    SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS batches,
      {_rate('sum(ocr_pages)', 'sum(total_pages)')} AS ocr_page_rate,
      {_rate('sum(duplicate_count)', 'sum(extracted_candidates)')} AS duplicate_rate,
      {_rate('sum(review_count)', 'sum(extracted_candidates)')} AS fuzzy_review_rate,
      coalesce(CAST(floor(avg(duration_ms) + 0.5) AS BIGINT), 0) AS average_duration_ms
    FROM batches GROUP BY CAST(created_at AS DATE)"""

SUMMARY = f"""
    WITH ranged AS (SELECT * FROM batches WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2001-01-01'),
    newest AS (SELECT *, CASE WHEN status = 'completed' THEN duration_ms END AS d FROM ranged ORDER BY created_at DESC, batch_id DESC LIMIT 500),
    durations AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM newest WHERE d IS NOT NULL)
    SELECT count(*) AS batches, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'needs_review') AS needs_review,
      {_rate('(sum(extracted_candidates) - sum(duplicate_count))', 'sum(extracted_candidates)')} AS selectable_accuracy,
      round(CASE WHEN sum(ocr_pages) > 0 THEN sum(imported_candidates) FILTER (status = 'completed') / greatest(1, sum(extracted_candidates))
        ELSE 0 END, 6) AS ocr_accuracy,
      {_rate('sum(ocr_pages)', 'sum(total_pages)')} AS ocr_page_rate,
      {_rate('sum(duplicate_count)', 'sum(extracted_candidates)')} AS duplicate_rate,
      {_rate('sum(review_count)', 'sum(extracted_candidates)')} AS fuzzy_review_rate,
      coalesce((SELECT d FROM durations WHERE i = n // 2), 0) AS median_duration_ms,
      coalesce((SELECT d FROM durations WHERE i = least(n - 1, n * 95 // 100)), 0) AS p95_duration_ms,
      (SELECT count(*) FROM batch_pages WHERE status = 'needs_review' AND batch_id IN (SELECT batch_id FROM ranged)) AS attention_pages,
      (SELECT count(*) FROM batch_candidates WHERE status = 'pending' AND batch_id IN (SELECT batch_id FROM ranged)) AS attention_candidates
    FROM newest"""

PERCENTILES = """
    WITH s AS (SELECT duration_ms AS d, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n
               FROM batches WHERE status = 'completed' AND duration_ms IS NOT NULL)
    SELECT max(d) FILTER (i = n // 2) AS median, max(d) FILTER (i = least(n - 1, n * 95 // 100)) AS p95 FROM s"""

WIDE = """
    WITH o AS (SELECT (o_orderkey % 1000 - 300) * 9000000000000000 + CAST(floor(o_totalprice) AS BIGINT) AS d FROM orders),
    s AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM o)
    SELECT max(d) FILTER (i = n // 2) AS median, max(d) FILTER (i = least(n - 1, n * 95 // 100)) AS p95 FROM s"""

HISTORY = """
    SELECT batch_id, source_name, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, total_pages, duration_ms
    FROM batches WHERE status = 'completed' AND source_name ILIKE '%customer 1%' AND created_at < TIMESTAMP '2000-07-01'
    ORDER BY batches.created_at DESC, batch_id DESC LIMIT 60"""

COUNTS = """
    SELECT batch_id, (SELECT count(*) FROM batch_pages p WHERE p.batch_id = b.batch_id) AS pages,
      (SELECT count(*) FROM batch_candidates c WHERE c.batch_id = b.batch_id AND c.status = 'pending') AS candidates
    FROM batches b"""

TOP_K = """
    SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) <= 20"""

ATTENTION = """
    SELECT CAST(page_number AS BIGINT) AS page_number, count(*) AS pages FROM batch_pages WHERE status = 'needs_review' GROUP BY 1"""

METRICS = """
    SELECT l_suppkey AS batch_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS created_at, metric_id, max(l_quantity) AS value
    FROM (SELECT *, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS metric_id FROM lineitem) GROUP BY l_suppkey, l_shipdate, metric_id
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, metric_id DESC) <= 100"""

TIMES = """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS started,
      strftime(o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS next, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"""

DIMENSIONS = """
    SELECT event_id, CASE WHEN event_id % 3 = 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events"""

REPORT = """
    SELECT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, CAST(sum(floor(o_totalprice)) AS BIGINT) AS price, max(o_orderpriority) AS priority
    FROM orders GROUP BY ALL"""

FAILED = "SELECT DISTINCT doc_id // 10 AS doc FROM documents WHERE doc_id // 10 % 7 = 3"

QUERIES = {
    "report_sink": (report_sink, REPORT.strip()),
    "failed_files": (failed_files, FAILED),
    "newest_metrics": (newest_metrics, METRICS.strip()),
    "batch_times": (batch_times, TIMES.strip()),
    "metric_dimensions": (metric_dimensions, DIMENSIONS.strip()),
    "batch_trends": (batch_trends, v.with_views(TRENDS, "batches")),
    "batch_summary": (batch_summary, v.with_views(SUMMARY, "batches", "batch_pages", "batch_candidates")),
    "rank_percentiles": (rank_percentiles, v.with_views(PERCENTILES, "batches")),
    "rank_percentiles_wide": (rank_percentiles_wide, WIDE.strip()),
    "batch_history": (batch_history, v.with_views(HISTORY, "batches")),
    "relation_counts": (relation_counts, v.with_views(COUNTS, "batches", "batch_pages", "batch_candidates")),
    "top_k_per_group": (top_k_per_group, TOP_K.strip()),
    "attention_pages": (attention_pages, v.with_views(ATTENTION, "batch_pages")),
}
