"""What several of these operators share: durable intermediate tables, joins with a checked small side, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, shared_folder

#: Rows of a side that may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 16
#: Rows and bytes of one Arrow batch sent to Python; texts can be long.
ARROW_ROWS, ARROW_BYTES = 400, 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Makes sure of a shared folder; keeps Arrow batches of texts small, for all of the session, unless they are smaller."""
    shared_folder(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later readers survive lost executors."""
    prepare(df.sparkSession)
    return durable(df)


def same(left: Column, right: Column) -> Column:
    """Equality in which two nulls are equal."""
    return left.eqNullSafe(right)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Joins on keys that may be null and of which one may hold most of `big`.

    `small` has one row for each key, `rows` of them, or is stored already and is counted. Up to BROADCAST_ROWS rows
    it is broadcast, beyond that each of its rows is dealt out to SALTS salts, so that a hot key of `big` is spread.
    """
    names = {k: f"__k_{i}" for i, k in enumerate(on)}
    few = small.select(*[F.col(k).alias(names[k]) for k in on], *[c for c in small.columns if c not in on])
    match = None
    for k in on:
        one = same(F.col(k), F.col(names[k]))
        match = one if match is None else match & one
    if (small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(few), match, how).drop(*names.values())
    few = few.withColumn("__salt_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # By the row itself: a task that runs again must deal its rows as before.
    plain = [f.name for f in big.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    many = big.withColumn("__salt_b", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    return many.join(few, match & (F.col("__salt_b") == F.col("__salt_s")), how).drop(*names.values(), "__salt_b", "__salt_s")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected `links`; root is the component's smallest node.

    Parents hook to the smallest grandparent among the neighbours and then shortcut; rounds grow with the
    logarithm of a component's diameter. Only slim pairs move; each round's parents are stored.
    """
    both = stored(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    parents = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("p")))
    nodes = parents.count()
    while True:
        # A root is the parent of many nodes, and a hub the neighbour of many: neither join deals by such a key.
        up = join_small(parents, parents.select(F.col("node").alias("p"), F.col("p").alias("g")), ["p"], "inner", nodes)
        near = join_small(both, up.select(F.col("node").alias("v"), "g"), ["v"], "inner", nodes).groupBy("u").agg(F.min("g").alias("m"))
        seen = up.join(near, up.node == near.u).select("node", "p", "g", "m")
        wishes = seen.select("node", F.least("p", "g", "m").alias("w")).union(seen.select("p", "m"))
        after = stored(wishes.groupBy("node").agg(F.min("w").alias("p")))
        moved = after.alias("x").join(parents.alias("y"), "node").filter("x.p <> y.p").limit(1).count()
        parents = after
        if not moved:
            return parents.select("node", F.col("p").alias("root"))
