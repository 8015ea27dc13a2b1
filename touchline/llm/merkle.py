"""Operator 13: a Merkle manifest of a table, by lag and lead windows.

Every row is a leaf; the leaves of a language make a tree of runs of eight, and the languages' roots make one above. Nodes get their place by
a range sort and are cut into spans of 8 ** LEVELS. In a span each level takes its siblings by lag and lead at fixed offsets, masked by the
slot in the run and the run's length; the first child of a run hashes the parent. One sort serves all levels of a span. The tops of spans
are the nodes of the next round, so rounds grow with the logarithm of the rows and no task holds more than a span of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import partitions, written

FAN = 8
LEVELS = 3  # levels of a span, 512 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts written one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds `idx`, the place of a row in its `group` in ascending order of `by` (nulls first), and `total`, the rows of the group.

    Rows are sorted by ranges and written; only the counts of ranges pass through a window. Rows that are equal in `by` keep an order by
    `tie`, so a value that a third of the rows share is spread over several ranges.
    """
    order = ["group", *by, "tie"]
    ranged = rows.repartitionByRange(max(partitions(rows.sparkSession), 1), *order).sortWithinPartitions(*order)
    held = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("at", 33))
    spans = held.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("group")
    before = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("group", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    return held.join(spans, ["group", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift", "tie")


def climb(nodes: DataFrame) -> DataFrame:
    """Adds `span`, `up` (the siblings left and right of a node and of its ancestors in the span, level by level, each side as one text) and,
    at the first row of a span, `top`. A level counts only while its tree has several nodes there.
    """
    idx, total = F.col("idx"), F.col("total")
    w = Window.partitionBy("group", "span").orderBy("idx")
    out = nodes.withColumns({"span": F.floor(idx / FAN**LEVELS), "top": F.col("node")})
    for level in range(LEVELS):
        step = FAN**level
        nodes_here = F.ceil(total / step)
        slot = F.floor(idx / step) % FAN
        run = F.least(F.lit(FAN), nodes_here - (F.floor(idx / step) - slot))
        taken = (idx % step == 0) & (nodes_here > 1)
        left = F.concat_ws("", *[F.when(taken & (slot >= d), F.lag("top", d * step).over(w)) for d in range(FAN - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(taken & (slot + d < run), F.lead("top", d * step).over(w)) for d in range(1, FAN)])
        out = out.withColumn("__sides", F.when(taken, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(taken, digest(F.col("top"), F.col("__sides.right"))).otherwise(F.col("top"))
        # an ancestor stands in the first row of its descendants
        sides = F.last("__sides", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if level else F.col("__sides")
        out = out.withColumns({f"__up{level}": sides, "top": F.when(idx % (step * FAN) == 0, parent)}).drop("__sides")
    ups = [f"__up{level}" for level in range(LEVELS)]
    return out.withColumn("up", F.filter(F.array(*ups), lambda x: x.isNotNull())).drop(*ups)


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`nodes` (group, idx, total, node and others) with `path`, the siblings up to the group's root; and (group, top) with that root."""
    width = FAN**LEVELS
    most = nodes.agg(F.max("total")).first()[0] or 0
    rounds = [climb(nodes)]
    while most > width:
        tops = rounds[-1].where(F.col("top").isNotNull()).select("group", F.col("span").alias("idx"), F.ceil(F.col("total") / width).alias("total"), F.col("top").alias("node"))
        rounds.append(climb(written(tops, "spans")))
        most = -(-most // width)
    tops = rounds[-1].where("idx = 0").select("group", "top")
    above: DataFrame | None = None
    for climbed in reversed(rounds):
        path = climbed.withColumnRenamed("up", "path")
        if above is not None:
            path = climbed.join(above, ["group", "span"]).withColumn("path", F.concat("up", "__above")).drop("up", "__above")
        above = path.select("group", F.col("idx").alias("span"), F.col("path").alias("__above"))
    return path.drop("span", "top"), tops


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, sides: digest(sides["left"], node, sides["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda sides: F.concat(sides["left"], sides["right"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path and `held`, the leaf of the row as it is found; one row per row.

    `path` has (left, right) siblings as texts of digests, level by level from the leaf to the root. `held` equals the leaf but where
    `tampered` is true; there the text has its A-Z lower-cased. A null field is `-`; rows with null language make a group of their own,
    the first one. Within a language rows ascend by doc_id, nulls first, rows of one id by leaf; equal rows may change places, which changes
    no digest above them. Other columns are ignored; an empty table gives no rows.
    """
    fields = {c: field(F.col(c)) for c in FIELDS}
    lowered = field(F.translate(F.col("text").cast("string"), UPPER, LOWER))
    leaf = digest(*fields.values())
    held = F.when(tampered, digest(*[fields[c] for c in FIELDS[:-1]], lowered)).otherwise(leaf) if tampered is not None else leaf
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null before all languages
    rows = written(docs.select(group.alias("group"), "doc_id", leaf.alias("node"), held.alias("held"), F.monotonically_increasing_id().alias("tie")), "leaves")
    leaves, subroots = tree(numbered(rows, ["doc_id", "node"]))
    roots = written(subroots, "subroots").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("node"), F.lit(0).alias("tie"))
    named, root = tree(numbered(roots, ["name"]))
    above = named.join(root, "group").select(F.col("name").alias("group"), F.col("node").alias("subroot"), F.col("path").alias("__above"), F.col("top").alias("root"))
    return leaves.join(above, "group").select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "__above").alias("path"), "held")


def verified(docs: DataFrame) -> DataFrame:
    """The manifest with proofs as digests, checked against rows of which a third (by crc32 of the id) is lower-cased."""
    found = manifest(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.col("held"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
