"""Helpers shared by the operators: tables cut off from their lineage, free column names, components of a link table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back: the cut survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate values that clash with none of ``df``'s (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """Column of ``df`` by its literal name, dots and blanks included."""
    return df["`" + name.replace("`", "``") + "`"]


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII text takes the faster ``lower``, which agrees there."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links ``a[i] - b[i]`` and, for each, the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        li, lj = label[i], label[j]
        low = np.minimum(li, lj)
        new = label.copy()
        np.minimum.at(new, li, low)
        np.minimum.at(new, lj, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the link table; root is the smallest node of its component.

    Alternating large-star / small-star rounds. The minimum of each node is an aggregate (combined map-side) and is
    written before it is joined, so that a node with very many links is split by the skew join and never gathered.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = store(links.select(lo.alias("lo"), hi.alias("hi")).where("lo < hi").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.selectExpr("hi as u", "lo as v").union(edges.selectExpr("lo as u", "hi as v"))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m"), "star")
        large = store(both.where("v > u").join(least, "u").selectExpr("m as lo", "v as hi").distinct(), "large")
        least = store(large.groupBy("hi").agg(F.min("lo").alias("m")), "star")
        moved = large.join(least, "hi").where("lo <> m").selectExpr("m as lo", "lo as hi")
        edges = store(moved.union(least.selectExpr("m as lo", "hi")).distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.selectExpr("hi as node", "lo as root").union(edges.selectExpr("lo as node", "lo as root").distinct())
