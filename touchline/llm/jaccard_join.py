"""Operator 10: near-duplicate classes by an exact Jaccard join of word-shingle sets with signature trees.

1. Each document becomes a shingle set (hashes), a fingerprint, a token bitmap and the prefix that any partner must share a token
   with. Copies with equal sets are represented by their smallest doc_id.
2. Representatives that share one of a few smallest tokens and stand side by side are compared by bitmap; this only gives labels early.
3. Prefix tokens that still join different labels form units; in each unit a signature tree is traversed against itself, and pairs whose
   bitmaps and sizes allow the threshold connect candidate classes. Only a spanning forest of them is kept, never all pairs.
4. In each candidate class the sets themselves are compared, again through signature trees, until all that link are connected.

Frequent tokens (judged on a bounded sample) come last in the prefix order. Any one order gives the same result; this one keeps units
small. Larger units are cut into blocks, and members that are not of the main label visit every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, lists, partitions, run_bounds, small, whole_runs, written
from touchline.llm.components import components
from touchline.llm.shingles import shingle_sets
from touchline.llm.signature_tree import bitmap, links

ORDER_SAMPLE = 50_000  # documents from which frequent tokens are listed
FREQUENT = 3  # documents of that sample that hold a frequent token, at least
LISTED = 1_000_000  # frequent tokens, at most
BROADCAST = 1_000_000  # rows of ids that are sent to all executors, at most; beyond, joins shuffle
BLOCK = 1024  # members of a unit
CENTRES = 32
FIRST = 4  # smallest tokens in step 2
NEIGHBOURS = 3

_SKETCH = "id long, n int, print string, first array<long>, prefix array<long>, bits binary"


def _frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens of FREQUENT or more of the sampled distinct texts, the LISTED most frequent. They only set an order; no result hangs on them."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([pa.array(s)], names=["token"])

    sample = bounded_sample(docs, "id", ORDER_SAMPLE).select("text").distinct()
    counts = sample.mapInArrow(tokens, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    return np.sort(counts.orderBy(F.desc("count"), "token").limit(LISTED).select("token").toArrow().column("token").to_numpy())


def _sketches(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = held.value
        for batch in batches:
            n, prints, first, prefix, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(late) and len(s):
                    at = np.searchsorted(late, s)
                    at[at == len(late)] = 0
                    hot = late[at] == s
                    prefix.append(np.concatenate([s[~hot], s[hot]])[:keep])
                else:
                    prefix.append(s[:keep])
                n.append(len(s))
                prints.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                first.append(s[:FIRST])
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(prints, pa.string()), lists(first, pa.int64()), lists(prefix, pa.int64()), pa.array(bits, pa.binary())],
                names=["id", "n", "print", "first", "prefix", "bits"],
            )

    return docs.mapInArrow(sketch, _SKETCH)


def _early_pairs(reps: DataFrame) -> DataFrame:
    """Side by side in the order of their smallest tokens within one of these tokens: (a, b), a linear number of pairs."""
    rows = reps.select("id", "n", F.col("first").alias("all_first"), F.explode("first").alias("token"))
    w = Window.partitionBy("token").orderBy("all_first", "n", "id")
    near = rows.select("id", F.array(*[F.lag("id", d).over(w) for d in range(1, NEIGHBOURS + 1)]).alias("near"))
    return near.select(F.col("id").alias("a"), F.explode(F.array_compact("near")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _connects(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column("n").to_numpy(), batch.column("n2").to_numpy()], axis=1).astype(np.int64)
            maps = list(zip(batch.column("bits").to_pylist(), batch.column("bits2").to_pylist(), strict=True))
            ok = pa.array([bool(links(n[i], list(maps[i]), np.arange(2), percent)) for i in range(len(maps))], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    return check


def _units(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, id, label, size) -> rows with `unit`: within a key, any two members of different labels meet in one unit.

    A key with more members than a block is cut. Members of its main label stay in their own block; the others also visit all blocks,
    a block of visitors at a time.
    """
    small = rows.where(F.col("size") <= block).withColumn("unit", F.xxhash64(*keys, F.lit(0), F.lit(0)))
    big = rows.where(F.col("size") > block)
    per = big.groupBy(*keys, "label").agg(F.count("*").alias("c"))
    main = per.groupBy(*keys).agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("minor"), F.sum("c").alias("total"))
    big = big.join(main, keys)
    blocks, visits = F.ceil(F.col("total") / block).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("minor") / block).cast("int"))
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), n.cast("long")).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stay = big.withColumn("r", own(blocks, 1)).withColumn("v", span(visits))
    visit = big.where("label <> main").withColumn("v", own(visits, 2)).withColumn("r", span(blocks))
    cut = stay.unionByName(visit).withColumn("unit", F.xxhash64(*keys, "r", "v")).dropDuplicates([*keys, "unit", "id"])
    return small.select("unit", "id", "label").unionByName(cut.select("unit", "id", "label"))


def _in_units(percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            ids, labels, n = (table.column(c).to_numpy() for c in ("id", "label", "n"))
            maps, n, bounds = table.column("bits").to_pylist(), n.astype(np.int64), run_bounds(table.column("unit").to_numpy())
            a, b = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i, j in links(n[s:e], maps[s:e], labels[s:e], percent):
                    a.append(ids[s + i])
                    b.append(ids[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return search


def _exact(k: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            bounds = run_bounds(table.column("unit").to_numpy())
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(s, e - s)
                sets = list(shingle_sets(part.column("text"), k))
                ids = part.column("id").to_numpy()
                found = links(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], part.column("label").to_numpy(), percent, sets)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

    return search


def _compare(docs: DataFrame, units: DataFrame, k: int, percent: int) -> DataFrame:
    """Links inside units by the sets themselves; only the texts of their members are moved, unless these are too many to be listed."""
    spark = docs.sparkSession
    rows = docs.join(small(written(units, "units"), BROADCAST), "id").select("unit", "id", "label", "text")
    rows = rows.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "id")
    return rows.mapInArrow(_exact(k, percent), "a long, b long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: `doc_id`, `n_shingles` (set size) and `component_id`, the smallest id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles (A-Z lower-cased; words are runs
    of anything but ASCII white space; fewer than k words count as one shingle). A null or empty text has an empty set, links with
    nothing and is its own class. Rows with a null id have a null class. Repeated rows of one id share the class of that id, whatever
    texts they have. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.where("id is not null")
    sketch = written(_sketches(docs, k, percent, _frequent_tokens(known, k)), "sketches")

    full = sketch.where("id is not null and print is not null")
    twins = full.groupBy("print").agg(F.min("id").alias("rep"))
    repeated = full.groupBy("id").count().where("count > 1").select("id")
    if repeated.isEmpty():
        copies = full.select("id", "print").join(twins, "print").where("id <> rep").select("id")
        reps, several = full.join(small(written(copies, "copies"), BROADCAST), "id", "left_anti"), None
    else:
        columns = ["id", "n", "first", "prefix", "bits"]
        reps = written(full.groupBy("print").agg(F.min_by(F.struct(*columns), "id").alias("x")).select("x.*"), "representatives")
        several = full.join(repeated, "id", "left_semi").join(twins, "print").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    sigs = reps.select("id", "n", "bits")

    pairs = _early_pairs(reps.select("id", "n", "first"))
    pairs = pairs.join(sigs.withColumnsRenamed({"id": "a"}), "a").join(sigs.withColumnsRenamed({"id": "b", "n": "n2", "bits": "bits2"}), "b")
    early = written(pairs.select("a", "b", "n", "n2", "bits", "bits2").mapInArrow(_connects(percent), "a long, b long"), "early")
    labels = components(early)

    posts = reps.select("id", F.explode("prefix").alias("token")).join(labels.withColumnsRenamed({"root": "label"}), "id", "left").withColumn("label", F.coalesce("label", "id"))
    w = Window.partitionBy("token")
    posts = posts.withColumns({"low": F.min("label").over(w), "high": F.max("label").over(w), "size": F.count("*").over(w)}).where("low <> high")
    units = _units(written(posts.select("token", "id", "label", "size"), "posts"), ["token"], BLOCK)
    rows = units.join(sigs, "id").select("unit", "id", "label", "n", "bits").repartition(partitions(spark), "unit").sortWithinPartitions("unit", "n", "id")
    late = rows.mapInArrow(_in_units(percent), "a long, b long").distinct()
    classes = components(early.union(late)).withColumnRenamed("root", "class")

    size = classes.groupBy("class").agg(F.count("*").alias("size"))
    members = written(classes.join(size, "class"), "classes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), F.col("id")), blocks.cast("long")).cast("int")
    cut = members.where(F.col("size") > BLOCK)
    centre = Window.partitionBy("class").orderBy(F.xxhash64(F.lit(3), F.col("id")))
    centres = cut.withColumn("place", F.row_number().over(centre)).where(F.col("place") <= CENTRES).drop("place").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first = members.withColumn("block", own).unionByName(centres).select(F.xxhash64("class", "block").alias("unit"), "id", F.col("id").alias("label")).distinct()
    edges = written(_compare(known, first, k, percent), "links")
    if not cut.isEmpty():
        found = components(edges).withColumnRenamed("root", "label")
        rest = cut.join(found, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_classes = rest.groupBy("class").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("class")
        edges = edges.union(written(_compare(known, _units(written(rest.join(open_classes, "class", "left_semi"), "rest"), ["class"], BLOCK), k, percent), "links"))
    roots = components(edges if several is None else edges.union(several))
    found = twins.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("root", "rep").alias("component_id"))
    return sketch.join(found, "print", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the smallest id of each class; rows with a null id stay, and one row of a repeated id."""
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(small(written(gone, "gone"), BROADCAST), docs[id_col].cast("long") == F.col("__gone"), "left_anti")
    ids = classes.where("doc_id is not null").select("doc_id").groupBy("doc_id").count().where("count > 1")
    return kept if ids.isEmpty() else kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
