"""Connected components as a DataFrame loop; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.shipping import in_arrow


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder that the session names.

    Where it names none, a local session gets a folder of its own; on a cluster, whose executors could
    not read that, it is an error.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and without the constraints that Spark infers of its plan: over the unions of a loop's turns they multiply until planning does not end."""
    spark, done = df.sparkSession, checkpointed(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def quoted(name: str) -> str:
    """A column's name for ``col``, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


#: A key is hot if over one in so many rows has it; fewer than so many can be.
HOT = 1000


SALTS = 32


def salted(rows: DataFrame, key: str, least: dict[str, Column]) -> DataFrame:
    """(key, minima ``least``, n rows) of each key. Every task has a partial row of a hot key: those meet in SALTS tasks before they meet in one."""
    parted = rows.groupBy(key, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(*[c.alias(a) for a, c in least.items()], F.count(F.lit(1)).alias("n"))
    return parted.groupBy(key).agg(*[F.min(a).alias(a) for a in least], F.sum("n").alias("n"))


def by_count(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts`` (key, n, ...), one a key, ``n`` the number of rows that have it.

    Rows of hot keys meet a broadcast of fewer than HOT facts and stay where they are; only the
    others' rows move, so no key is one task's burden.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(facts.where(F.col("n") * HOT > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("n") * HOT <= total), key)
    return rows.join(hot, key).unionByName(rest)


def _component_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) that one task gets."""
    batches = list(it)
    a, b = (np.concatenate([x.column(k).to_numpy() for x in batches] or [np.empty(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while len(a):
        # the larger root of each edge points to the smaller one; then all point to their roots
        np.minimum.at(low, np.maximum(low[a], low[b]), np.minimum(low[a], low[b]))
        while (low[low] != low).any():
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges`` (a, b), undirected.

    Up to ``at_once`` edges (16 bytes each) are one task's, without a shuffle.

    Nodes that no edge touches are not returned. Each round draws a new random order of the nodes,
    points every node to the first of itself and its neighbours, follows that node's own pointer,
    and moves the edges to these representatives, until none joins two. The random order makes
    long chains contract by a constant factor a round. Minima pre-aggregate before the shuffle and
    joins on a hot representative can be split, so a large component is no one task's burden.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    if at_once and edges.count() <= at_once:
        return checkpointed(in_arrow(edges.coalesce(1), _component_rows, "node long, component long"))
    steps: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break

        def ranked(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select("a", F.least(ranked("a"), "m")["n"].alias("p"))
        hop = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = checkpointed(near.join(hop, "p").select(F.col("a").alias("node"), F.col("q").alias("rep")))
        steps.append(parent)
        of_a, of_b = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        edges = checkpointed(edges.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return edges.toDF("node", "component")
    # representatives of one round are nodes of the next: compose from the last round back
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.toDF("rep", "last")
        out = step.join(later, "rep", "left").select("node", F.coalesce("last", "rep").alias("rep"))
    least = salted(out, "rep", {"component": F.min("node")})
    return by_count(out, checkpointed(least), "rep").select("node", "component")
