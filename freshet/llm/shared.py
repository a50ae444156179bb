"""Small helpers of the training-data operators: columns, staged tables, components."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship a module's functions with their tasks, so that workers need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session may set its own."""
    import tempfile

    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Stage:
    """Written tables in the shared folder: they cut lineage and survive lost executors.

    keep() writes a table and reads it back; drop() deletes those that are no longer read.
    A table that a returned DataFrame reads stays: the folder's owner clears it. With lean,
    tables are packed tighter, and Spark frees the shuffle files behind a table once it is written.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def path(self, label: str = "table") -> str:
        self.n += 1
        return f"{self.folder}/{self.n}-{label}"

    def keep(self, df: DataFrame, label: str = "table", settings: dict[str, str] | None = None) -> DataFrame:
        path = self.path(label)
        if self.lean:
            self._write_lean(df, path, settings or {})
        else:
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        kept._stage_path = path
        return kept

    def _write_lean(self, df: DataFrame, path: str, settings: dict[str, str]) -> None:
        settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **settings}
        before = {name: self.spark.conf.get(name, None) for name in settings}
        for name, value in settings.items():
            self.spark.conf.set(name, value)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
            path.getFileSystem(conf).delete(path, True)


def runtime_filter(items: int) -> dict[str, str]:
    """Settings that let Spark rule rows out by a Bloom filter of `items` keys before it shuffles them for a join."""
    items = min(max(items, 1000), 4_000_000)
    name = "spark.sql.optimizer.runtime.bloomFilter"
    return {
        f"{name}.enabled": "true", f"{name}.applicationSideScanSizeThreshold": "0", f"{name}.creationSideThreshold": "1g",
        f"{name}.expectedNumItems": str(items), f"{name}.numBits": str(min(12 * items, 1 << 26)),
    }


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): node, component (its smallest node).

    Distributed union-find by alternating stars: the number of rounds grows with the
    logarithm of the number of nodes. Minima combine before the shuffle, and the joins are
    of two plain tables that Spark may split, so one huge component is no hot task. Only
    nodes that have a link appear; rows with a null end are no links.
    """
    edges = stage.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    while True:
        # Larger neighbours of a node meet its smallest neighbour ...
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # ... then its smaller neighbours and itself meet the smallest.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        near = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage.keep(near.union(low).filter("u <> v").distinct(), "stars")
        stage.drop(edges)
        edges = small
        # Done when every larger node has one parent and no parent is itself a child.
        ends = small.selectExpr("u as x", "1 as child", "0 as parent").union(small.selectExpr("v", "0", "1"))
        state = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if not state.filter("child > 1 or child = 1 and parent = 1").limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def merge_buckets(
    stage: Stage, met: DataFrame, carry: list[str], near: str, verify, left_rows: int, turns: int = 6, hubs: bool = False
) -> DataFrame | None:
    """Components (node, component) of the verified links inside buckets; None without any.

    met(id, keys, carry columns): each row is in the buckets `keys`. near is an SQL condition on
    carry columns of a pair (names end in _a and _b) that no link fails; verify(pairs of a, b)
    gives the pairs that are links. Each turn compares one leader of a bucket with the members
    of other components, and its links merge components, so a large group of copies costs one
    pair a member. Turns go on while each halves the comparisons left (with hubs, leaves a third); beyond that, or once
    left_rows are left, members outside a bucket's largest component are compared with all
    members of others. With hubs the leader is the member that meets most rows in all its buckets: the
    middle of a family of copies links more of them than any copy does. Every two members of a bucket end in one component or are compared.
    """
    links = labels = None
    before = 0
    # A pair is compared in the first bucket that it shares: 32 bits of each key tell which.
    marked = met.withColumn("marks", F.transform("keys", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    first = "array_position(zip_with(marks_a, marks_b, (x, y) -> x = y), true) = band_a + 1"
    carry, also = [*carry, "marks"], carry
    for turn in range(turns + 1):
        now = marked.withColumn("label", F.col("id"))
        if labels is not None:
            now = marked.join(labels.withColumnRenamed("node", "id"), "id", "left")
            now = now.withColumn("label", F.coalesce("component", "id")).drop("component")
        # With hubs a row of a bucket is slim; what goes with it joins when it is asked for.
        entry = now.select(F.posexplode("keys").alias("band", "key"), "id", "label", *([] if hubs else carry))
        mixed = entry.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        mixed = stage.keep(mixed.select("key"), "mixed")
        open_ = stage.keep(entry.join(mixed, "key", "left_semi"), "open")
        by_label = open_.groupBy("key", "label").agg(F.count("*").alias("c"))
        by_key = stage.keep(
            by_label.groupBy("key").agg(
                F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "label")).alias("top")
            ),
            "by_key",
        )
        left = by_key.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()[0] or 0
        if not left:
            stage.drop(mixed, open_, by_key)
            break
        last = turn == turns or (turn > 0 and (left <= left_rows or (3 if hubs else 2) * left > before))
        before = left
        side_a, side_b = (
            ["key", f"band as band_{x}", f"id as {x}", f"label as label_{x}", *[f"{c} as {c}_{x}" for c in carry]] for x in "ab"
        )
        if last:
            if hubs:
                whole = stage.keep(open_.join(marked.select("id", *carry), "id"), "whole")
                stage.drop(open_)
                open_ = whole
            top = by_key.selectExpr("key", "top.label as top")
            side = stage.keep(open_.join(top, "key").filter("label <> top").selectExpr(*side_a), "outside")
        elif hubs:
            meets = open_.join(by_key.select("key", "all"), "key").groupBy("id").agg(F.sum("all").alias("meets"))
            # Of members that meet as many, another one leads in each bucket and turn.
            choice = open_.join(meets, "id").withColumn("draw", F.xxhash64(F.lit(turn), "key", "id"))
            choice = choice.groupBy("key").agg(F.max(F.struct("meets", "draw", "id", "label")).alias("x"))
            side = stage.keep(choice.selectExpr("key", "x.id as a", "x.label as label_a"), "leaders")
        else:
            # Another leader each turn: the least id under another exclusive-or.
            code = F.lit((0x5DEECE66D * turn * turn) & 0x7FFFFFFF)
            leader = open_.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(code)).alias("x"))
            leader = leader.select("key", F.col("x").bitwiseXOR(code).alias("id"))
            side = stage.keep(open_.join(leader, ["key", "id"]).selectExpr(*side_a), "leaders")
        if hubs and not last:
            pairs = side.join(open_.selectExpr("key", "id as b", "label as label_b"), "key").filter("label_a <> label_b")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            for x in "ab":
                pairs = pairs.join(met.selectExpr(f"id as {x}", *[f"{c} as {c}_{x}" for c in also]), x)
            pairs = pairs.filter(near).select("a", "b")
        else:
            pairs = side.join(open_.selectExpr(*side_b), "key").filter(f"label_a <> label_b and {near} and {first}")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = stage.keep(verify(pairs), "links")
        links = found if links is None else links.union(found)
        labels = stage.keep(components(stage, links), "labels")
        stage.drop(mixed, open_, by_key, side)
        if last:
            break
    return labels


by_value(__name__)
