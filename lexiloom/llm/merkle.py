"""Merkle manifest of a data set: one root over all rows, and for every row the proof that it belongs there.

Rows are leaves, in order within their source; every ``FAN`` consecutive nodes become one of the next level, up to
the source's subroot, and the subroots likewise become the root.  Built levels are stored as node rows that name
their parent: a node row holds the digests of its children, in order, and its own place among its parent's.  A
recursive query then climbs from every leaf at once: each step joins the node above, appends the siblings found there and
folds what the climb carries into the node's digest.  A leaf that was tampered with arrives at another root.

A node is named by its level and the position of its first leaf in the order of all rows (that of the first source for the
levels above the subroots), so parents are found by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ordered import join_same
from .common import materialize

FAN = 3
#: Levels of a source lie below TOP (a source has at most 3 ** 31 rows), those over the subroots from TOP on.
TOP, LEVEL_BITS = 32, 48
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """Digest of fields: '-' for a null, else its UTF-8 byte count, ':' and the value."""
    told = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (f.cast("string") for f in fields)]
    return digest(F.concat(*[F.coalesce(t, F.lit("-")) for t in told]))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hex_of(digests: Column) -> Column:
    """Digests, one after the other, as lower-case text."""
    return F.lower(F.hex(digests))


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """Rows with their place (from 0) in the order of all, written in ranges of it.

    Only the number of rows in each range passes a window, so no task sees more than its range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    sizes = local.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # one row a range
    return local.join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def node(level: int, first: Column) -> Column:
    return F.lit(level << LEVEL_BITS).cast("long") + first


def levels(leaves: DataFrame, base: int, root: Column) -> list[DataFrame]:
    """Node rows (node, parent, place, children, digest, start, size, no) over leaves (pos, digest, start, size, no), level by level.

    Leaves of one ``start`` are a tree of ``size`` leaves at positions from ``start`` on; ``root`` says where the
    node on top goes: a struct (parent, place), null if nowhere.
    """
    made, now, level = [], leaves.select("pos", "digest", "start", "size", "no"), 0
    tallest = leaves.agg(F.max("size")).first()[0] or 0
    while FAN**level < tallest:
        width, level = FAN**level, level + 1
        # a node that stands alone on its level is its tree's top and goes no further
        grouped = now.filter(F.col("size") > width).withColumn("first", F.col("pos") - F.pmod(F.col("pos") - F.col("start"), F.lit(width * FAN)))
        above = grouped.groupBy("first", "start", "size", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("c"))
        children = F.aggregate(F.transform("c", lambda x: x["digest"]), F.lit(b""), lambda a, x: F.concat(a, x))
        named = above.select("first", "start", "size", "no", children.alias("children")).withColumn("digest", digest(hex_of(F.col("children"))))
        rows = materialize(named.select(
            node(base + level, F.col("first")).alias("node"),
            *above_of(F.col("first"), F.col("start"), F.col("size"), base + level, width * FAN, root),
            "children", "digest", F.col("first").alias("pos"), "start", "size", "no"), f"level-{base + level}")
        made.append(rows)
        now = rows.select("pos", "digest", "start", "size", "no")
    return made


def above_of(pos: Column, start: Column, size: Column, level: int, width: int, root: Column) -> list[Column]:
    """Parent and place among its children of the node at ``pos`` on ``level``, whose nodes span ``width`` leaves each."""
    first = pos - F.pmod(pos - start, F.lit(width * FAN))
    own = F.struct(node(level + 1, first).alias("parent"), (F.floor((pos - first) / width)).cast("int").alias("place"))
    chosen = F.when(size > width, own).otherwise(root)
    return [chosen["parent"].alias("parent"), chosen["place"].alias("place")]


#: The climb: ``node`` is where a leaf goes next, ``folded`` what it brings, ``beside`` the siblings met last.
CLIMB = """
WITH RECURSIVE climb (pos, node, place, folded, beside) AS (
  SELECT pos, parent, place, coalesce(tampered, digest), X'' FROM {leaves}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.pos, n.parent, n.place,
         unhex(sha2(lower(concat(hex(substring(n.children, 1, 32 * c.place)), hex(c.folded), hex(substring(n.children, 32 * c.place + 33)))), 256)),
         concat(substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33))
  FROM climb c JOIN {nodes} n ON c.node = n.node
)
SELECT pos, node, folded, beside FROM climb
"""


def climb(spark: SparkSession, leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """pos, folded (digest on top), proof (siblings from the leaf up) of every leaf (pos, digest, tampered, parent, place)."""
    limit = "spark.sql.cteRecursionRowLimit"
    given = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # a row for each leaf and level, however many
    try:
        steps = spark.sql(CLIMB, leaves=leaves, nodes=nodes)
        last = F.lit((1 << 63) - 1)
        path = F.array_sort(F.collect_list(F.struct(F.coalesce("node", last).alias("node"), "folded", "beside")))
        ordered = steps.groupBy("pos").agg(path.alias("path"))
        joined = F.aggregate(F.transform("path", lambda x: x["beside"]), F.lit(b""), lambda a, x: F.concat(a, x))
        return materialize(ordered.select("pos", F.element_at("path", -1)["folded"].alias("folded"), joined.alias("proof")), "climb")
    finally:
        spark.conf.set(limit, given)


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    Leaves are digests of doc_id, source, lang, n_chars and text; within a source they stand by doc_id (null first), rows of
    one doc_id by their digests, so that equal rows change nothing; sources stand by their bytes, null first.
    Only ``folded_root`` and ``verified`` know of ``tampered_text``: by default the text without line feeds where
    the crc32 of the decimal doc_id is even (never for a null doc_id; a null text stays null).  An empty text is a value; a
    proof without siblings is the digest of nothing; other columns are ignored; an empty table gives no rows.
    Rows that are equal in all fields are sorted in one task.
    """
    spark = docs.sparkSession
    if tampered_text is None:
        even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
        tampered_text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    hashed = docs.select("doc_id", "source", leaf(*fields).alias("digest"), F.when(
        ~tampered_text.eqNullSafe(F.col("text")), leaf(*fields[:-1], tampered_text)).alias("tampered"))
    hashed = materialize(hashed, "hashed")  # texts are read once, not also for the bounds of the ranges
    first_null = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = numbered(hashed, first_null, "pos", "leaves")
    sizes = rows.groupBy("source").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("size"))
    sources = numbered(sizes, [F.col("start")], "no", "sources")
    several = sources.count()
    # where a subroot goes: its place over the sources, unless it is the root
    on_top = above_of(F.col("no"), F.lit(0), F.lit(several), TOP, 1, F.lit(None).cast("struct<parent:long,place:int>"))
    root = F.struct(*on_top)
    leaves = materialize(join_same(rows, sources, ["source"]).withColumns(dict(zip(
        ("parent", "place"), above_of(F.col("pos"), F.col("start"), F.col("size"), 0, 1, root)))), "leaves")
    low = levels(leaves, 0, root)
    own = leaves.select("no", "digest", "size", F.lit(1).alias("width"))
    for k, made in enumerate(low):
        own = own.unionByName(made.select("no", "digest", "size", F.lit(FAN ** (k + 1)).alias("width")))
    # the lowest level with a single node has the subroot
    top_of = F.col("size") <= F.col("width")
    under = (F.col("size") > F.col("width") / FAN) | (F.col("width") == 1)
    subroots = materialize(own.filter(top_of & under).select("no", F.col("digest")), "subroots")
    none = F.lit(None).cast("struct<parent:long,place:int>")
    high = levels(subroots.select(F.col("no").alias("pos"), "digest", F.lit(0).cast("long").alias("start"),
                                  F.lit(several).cast("long").alias("size"), F.lit(0).cast("long").alias("no")), TOP, none)
    found = (high[-1] if high else subroots).select("digest").first()
    top = hex_of(F.lit(bytes(found[0]) if found else b""))
    nodes = None
    for made in low + high:
        row = made.select("node", "parent", "place", "children")
        nodes = row if nodes is None else nodes.unionByName(row)
    if nodes is None:
        nodes = spark.createDataFrame([], "node long, parent long, place int, children binary")
    nodes = materialize(nodes, "nodes")
    paths = climb(spark, leaves.select("pos", "digest", "tampered", "parent", "place"), nodes)
    known = leaves.select("pos", "doc_id", "no", "digest").join(paths, "pos").join(
        subroots.select("no", F.col("digest").alias("sub")), "no")
    folded = hex_of(F.col("folded"))
    return known.select(
        "doc_id", hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("sub")).alias("subroot"), top.alias("root"),
        F.sha2(hex_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == top).alias("verified"))


#: The same in DuckDB's SQL, which has no crc32: eight shifts for each byte.
SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND (list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))) & 1) = 1
              THEN replace(text, chr(10), '') ELSE text END AS altered
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(rest || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(rest || coalesce(strlen(altered) || ':' || altered, '-')) AS tampered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS rest
        FROM told)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM hashed),
low AS (
  SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM low WHERE n > 1
  GROUP BY tree, level, i // 3),
high AS (
  SELECT 0 AS tree, 0 AS level, tree - 1 AS i, h, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT 0, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM high WHERE n > 1
  GROUP BY level, i // 3),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
links AS (
  SELECT tree, level, i, tree AS to_tree, level + 1 AS to_level, i // 3 AS to_i, true AS hash,
         coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '' ORDER BY i) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, i // 3 ORDER BY i)
  UNION ALL SELECT tree, level, i, 0, 0, tree - 1, false, '', '' FROM low WHERE n = 1),
climb AS (
  SELECT tree AS own, i AS leaf_i, tree, 0 AS level, i, tampered AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.own, c.leaf_i, k.to_tree, k.to_level, k.to_i,
         CASE WHEN k.hash THEN sha256(k.before || c.folded || k.after) ELSE c.folded END, c.proof || k.before || k.after
  FROM climb c JOIN links k ON k.tree = c.tree AND k.level = c.level AND k.i = c.i),
done AS (SELECT c.* FROM climb c JOIN high t ON c.tree = 0 AND c.level = t.level AND t.n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = t.h AS verified
FROM leaves l JOIN low s ON s.tree = l.tree AND s.n = 1 JOIN done d ON d.own = l.tree AND d.leaf_i = l.i
JOIN high t ON t.n = 1
"""
