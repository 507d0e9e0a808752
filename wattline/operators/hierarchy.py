"""Hierarchies as edge tables, closure, summation matrix, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import stable


def from_config(spark: SparkSession, national: str, subsystems: Mapping[str, Sequence[str]], losses: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a national / subsystem / area tree; loss nodes are calculated."""
    edges = [(national, s, 1.0) for s in subsystems] + [(s, a, 1.0) for s, areas in subsystems.items() for a in areas]
    e = spark.createDataFrame(edges, "parent string, child string, weight double")
    n = hierarchy(e)
    if losses:
        extra = spark.createDataFrame([(x, None, "calculated") for x in losses], "node string, level int, node_type string")
        n = n.unionByName(extra)
    return n, e


def closure(edges: DataFrame) -> DataFrame:
    """(node, descendant, w, depth, path) for every node and all below it, itself included.

    One join per level; each level is written once, so the plan does not grow with depth.
    """
    edges = stable(edges.select("parent", "child", "weight"))
    ids = edges.select(F.col("parent").alias("n")).union(edges.select("child")).distinct()
    out = ids.select(F.col("n").alias("node"), F.col("n").alias("descendant"), F.lit(1.0).alias("w"), F.lit(0).alias("depth"), F.array("n").alias("path"))
    front = edges.select(
        F.col("parent").alias("node"), F.col("child").alias("descendant"), F.col("weight").alias("w"), F.lit(1).alias("depth"), F.array("parent", "child").alias("path"))
    while True:  # a cycle ends where its path would repeat
        out = out.unionByName(front)
        nxt = front.join(edges, F.col("descendant") == F.col("parent")).where(~F.array_contains("path", F.col("child"))).select(
            "node", F.col("child").alias("descendant"), (F.col("w") * F.col("weight")).alias("w"), (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("child")).alias("path"))
        if nxt.isEmpty():
            return out
        front = stable(nxt)


def levels(c: DataFrame) -> DataFrame:
    """(node, level) from a closure: the longest way down to a node starts at its root."""
    return c.groupBy(F.col("descendant").alias("node")).agg(F.max("depth").alias("level"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """nodes(node, level, node_type) derived from parent/child rows."""
    parents = edges.select(F.col("parent").alias("node")).distinct().withColumn("__p", F.lit(True))
    return levels(closure(edges)).join(parents, "node", "left").select("node", "level", F.when(F.col("__p"), "aggregate").otherwise("bottom").alias("node_type"))


def add_node(nodes: DataFrame, edges: DataFrame, node: str, parent: str | None, node_type: str = "bottom", weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    spark = nodes.sparkSession
    if nodes.where(F.col("node") == node).head():
        raise ValueError(f"node {node!r} exists")
    level = None
    if parent is not None:
        p = nodes.where(F.col("node") == parent).head()
        if p is None:
            raise ValueError(f"parent {parent!r} unknown")
        level = None if p["level"] is None else p["level"] + 1
        edges = edges.unionByName(spark.createDataFrame([(parent, node, weight)], "parent string, child string, weight double"))
        nodes = nodes.withColumn("node_type", F.when((F.col("node") == parent) & (F.col("node_type") == "bottom"), "aggregate").otherwise(F.col("node_type")))
    return nodes.unionByName(spark.createDataFrame([(node, level, node_type)], "node string, level int, node_type string")), edges


def summation_matrix(edges: DataFrame) -> DataFrame:
    """S(node, leaf, w)."""
    return leaf_weights(closure(edges), edges)


def leaf_weights(c: DataFrame, edges: DataFrame) -> DataFrame:
    parents = edges.select(F.col("parent").alias("descendant")).distinct()
    return c.join(parents, "descendant", "left_anti").groupBy("node", F.col("descendant").alias("leaf")).agg(F.sum("w").alias("w"))


def children(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("parent") == node).select("child", "weight")


def paths(edges: DataFrame) -> DataFrame:
    """Each node with its parent, level and path to the root."""
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    c = closure(edges).join(roots, "node", "left_semi")
    path = F.reverse("path")
    return c.select(F.col("descendant").alias("node"), F.get(path, F.lit(1)).alias("parent"), F.col("depth").alias("level"), F.concat_ws("/", path).alias("path"))


def path(edges: DataFrame, node: str) -> DataFrame:
    return paths(edges).where(F.col("node") == node)


def validate_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per check: (check, problems, ok)."""
    c = stable(closure(edges))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    back = c.join(edges, (F.col("descendant") == F.col("parent")) & (F.col("node") == F.col("child")))
    tree = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    orphan = nodes.where("node_type <> 'calculated'").select("node").join(tree, "node", "left_anti")
    unknown = tree.join(nodes.select("node"), "node", "left_anti")
    many = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = F.count(F.lit(1))
    incomplete = nodes.where("node is null or node_type is null or (level is null and node_type <> 'calculated')")
    no_leaf = nodes.where("node_type <> 'calculated'").select("node").join(leaf_weights(c, edges).where("w <> 0").select("node").distinct(), "node", "left_anti")
    parts = [
        ("one_root", roots, F.abs(n - 1)), ("no_cycle", back, n), ("no_orphan", orphan, n), ("known_nodes", unknown, n),
        ("single_parent", many, n), ("complete_attributes", incomplete, n), ("summation_rows", no_leaf, n),
    ]
    out = None
    for name, d, e in parts:
        row = d.agg(e.alias("problems")).select(F.lit(name).alias("check"), F.col("problems").cast("long").alias("problems"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("problems") == 0)


def validate_node_fc(fc: DataFrame, nodes: DataFrame, edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(check, problems): absent nodes, non-finite values, negatives, sums that do not hold."""
    from wattline.operators.reconcile import child_sums

    missing = nodes.where("node_type <> 'calculated'").select("node").join(fc.select("node").distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("missing_nodes"))
    y = F.col("yhat")
    bad = y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    vals = fc.agg(F.count_if(bad).alias("not_finite"), F.count_if(F.coalesce(y < 0, F.lit(False))).alias("negative"))
    s = child_sums(fc, edges)
    off = s.agg(F.count_if(F.abs(F.col("yhat") - F.col("expected")) > tol * F.greatest(F.lit(1.0), F.abs("yhat"))).alias("incoherent"))
    row = missing.join(vals).join(off)  # three frames of one row
    return row.unpivot([], ["missing_nodes", "not_finite", "negative", "incoherent"], "check", "problems").withColumn("ok", F.col("problems") == 0)
