"""Dataset versions and deltas, feature values and lineage."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.clean import row_hash
from touchline.sources.shared import cut_lineage

# ---------------------------------------------------------------- deltas


def compute_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted, updated and deleted rows by key, with the key's fingerprint.

    Rows of both sides are joined on the key; an update differs in the hash of the other columns.
    """
    others = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*others).alias("_old"), row_hash(old, others).alias("_oh"))
    n = new.select(*keys, F.struct(*others).alias("_new"), row_hash(new, others).alias("_nh"))
    both = o.join(n, keys, "full_outer")
    change = F.when(F.col("_oh").isNull(), "inserted").when(F.col("_nh").isNull(), "deleted").when(F.col("_oh") != F.col("_nh"), "updated")
    out = both.withColumn("change_type", change).filter("change_type IS NOT NULL")
    row = F.coalesce("_new", "_old")
    return out.select(
        *keys, *[row[c].alias(c) for c in others], "change_type", row_hash(out, keys).alias("fingerprint"),
        F.array_compact(F.array(*[F.when((F.col("change_type") == "updated") & ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), c) for c in others])).alias("changed"),
    )


def changed_columns(delta: DataFrame) -> DataFrame:
    """Columns that differ in updated rows, with how many rows each."""
    return delta.filter("change_type = 'updated'").select(F.explode("changed").alias("column")).groupBy("column").agg(F.count("*").alias("rows"))


def compare_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of inserted, updated, deleted and unchanged rows."""
    d = compute_delta(old, new, keys)
    counts = d.agg(*[F.count_if(F.col("change_type") == c).alias(f"n_{c}") for c in ("inserted", "updated", "deleted")])
    n_old = old.agg(F.count("*")).scalar()
    return counts.withColumn("n_unchanged", n_old - F.col("n_deleted") - F.col("n_updated"))


def compare_metadata(old: dict[str, object], new: dict[str, object]) -> dict[str, tuple[object, object]]:
    """Fields of two version descriptions that differ."""
    fields = ["source", "league", "season", "n_rows", "n_columns"]
    return {f: (old.get(f), new.get(f)) for f in fields if old.get(f) != new.get(f)}


# ---------------------------------------------------------------- version folders

_MANIFEST = "seq long, version string, path string, n_rows long, n_columns int, checksum string, action string"


def checksum(df: DataFrame) -> str:
    """Order-independent checksum: sum of row hashes."""
    total = df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).alias("c")).first()[0]
    return str(total or 0)


class VersionStore:
    """Immutable parquet folders under one root with an append-only manifest; the last entry is current."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _entries(self) -> list:
        try:
            return self.manifest().orderBy("seq").collect()
        except Exception as e:  # noqa: BLE001 - no manifest yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def create(self, df: DataFrame) -> str:
        entries = self._entries()
        made = sum(1 for e in entries if e["action"] == "create")
        name = f"v{made + 1:03d}"
        path = f"{self.root}/version={name}"
        df.write.parquet(path)
        stored = self.spark.read.parquet(path)
        self._append((len(entries) + 1, name, path, stored.count(), len(df.columns), checksum(stored), "create"))
        return name

    def _find(self, version: str | None) -> object:
        entries = self._entries()
        return entries[-1] if version is None else next(e for e in entries if e["version"] == version)

    def load(self, version: str | None = None) -> DataFrame:
        """A version, or the current one."""
        return self.spark.read.parquet(self._find(version)["path"])

    def rollback(self, version: str) -> None:
        """Make an earlier version current; nothing is removed."""
        e = self._find(version)
        self._append((len(self._entries()) + 1, e["version"], e["path"], e["n_rows"], e["n_columns"], e["checksum"], "rollback"))

    def verify(self, version: str) -> bool:
        """Whether the stored rows still have the recorded checksum."""
        e = self._find(version)
        return checksum(self.load(version)) == e["checksum"]


# ---------------------------------------------------------------- feature values


def stale_entities(entities: DataFrame, values: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """Entities without a value or with one older than the limit."""
    newest = values.groupBy("entity_id").agg(F.max("computed_at").alias("_at"))
    limit = now - F.make_interval(mins=F.lit(int(max_age_hours * 60)))
    return entities.join(newest, "entity_id", "left").filter(F.col("_at").isNull() | (F.col("_at") < limit)).drop("_at")


def assemble_vectors(values: DataFrame, fixtures: DataFrame, match_features: list[str], team_features: list[str]) -> DataFrame:
    """Long feature values (feature, entity_type, entity_id, value) to one wide row per fixture.

    Fixtures hold match_id, home_id and away_id; team features appear once per side.
    """
    roles = F.array(
        F.struct(F.lit("match").alias("entity_type"), F.col("match_id").alias("entity_id"), F.lit("").alias("role")),
        F.struct(F.lit("team").alias("entity_type"), F.col("home_id").alias("entity_id"), F.lit("home_").alias("role")),
        F.struct(F.lit("team").alias("entity_type"), F.col("away_id").alias("entity_id"), F.lit("away_").alias("role")),
    )
    asked = fixtures.select("match_id", F.explode(roles).alias("r")).select("match_id", "r.*")
    named = asked.join(values, ["entity_type", "entity_id"]).withColumn("name", F.concat("role", "feature"))
    names = [*match_features, *[f"{s}_{f}" for s in ("home", "away") for f in team_features]]
    return named.groupBy("match_id").pivot("name", names).agg(F.max("value"))


def run_incremental(entities: DataFrame, values: DataFrame, now: Column, max_age_hours: float, compute) -> DataFrame:  # noqa: ANN001
    """Recompute stale entities only and merge them with the values that are still fresh."""
    from touchline.sources.sinks import upsert

    fresh = compute(stale_entities(entities, values, now, max_age_hours))
    return upsert(fresh, values, ["entity_id"], "computed_at")


def values_for(values: DataFrame, entities: DataFrame, features: list[str]) -> DataFrame:
    """Values of the wanted entities and features."""
    return values.filter(F.col("feature").isin(features)).join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def feature_value_rules(values: DataFrame, lowest: float, highest: float, min_distinct: int) -> DataFrame:
    """Per feature: values out of range, nulls, cardinality, and entities with conflicting values."""
    per_entity = values.groupBy("feature", "entity_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if((F.col("value") < lowest) | (F.col("value") > highest)).alias("out"),
        (F.min("value") != F.max("value")).alias("conflict"),
    )
    distinct = values.groupBy("feature").agg(F.countDistinct("value").alias("distinct"))
    out = per_entity.groupBy("feature").agg(F.sum("out").alias("out_of_range"), F.sum("nulls").alias("nulls"), F.count_if("conflict").alias("conflicts"))
    return out.join(distinct, "feature").withColumn("too_few_values", F.col("distinct") < min_distinct)


def new_definition_version(definitions: DataFrame, name: str, changelog: str) -> DataFrame:
    """Definition history (name, version, changelog) with the next version of `name` appended."""
    nxt = definitions.filter(F.col("name") == name).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return definitions.unionByName(nxt.select(F.lit(name).alias("name"), "version", F.lit(changelog).alias("changelog")))


def source_summary(edges: DataFrame) -> DataFrame:
    """Features per source."""
    return edges.groupBy("parent").agg(F.countDistinct("child").alias("features"))


def reachable(edges: DataFrame, start: DataFrame, upstream: bool = False) -> DataFrame:
    """Nodes reached from every start node over parent -> child edges, with the smallest depth.

    Each round joins the nodes found last with the edges and keeps new ones, until there are none; the
    found set is checkpointed every round so the plan does not grow.
    """
    frm, to = ("child", "parent") if upstream else ("parent", "child")
    steps = edges.select(F.col(frm).alias("node"), F.col(to).alias("next")).distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    parts = []
    for d in count(1):
        found = frontier.select("start", "node").join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        fresh = cut_lineage(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        seen = seen.unionByName(fresh)
        frontier = fresh
    empty = seen.filter("depth > 0")
    return reduce(DataFrame.unionByName, parts) if parts else empty
