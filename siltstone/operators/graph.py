"""Graphs as two tables: nodes (id, type, raw) and edges (src, dst, relationship_type)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def split_documents(docs: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON documents; those of type `relationship` are edges."""
    doc = docs.withColumn("v", F.parse_json(F.col(raw)))
    get = lambda path: F.variant_get("v", f"$.{path}", "string")
    typed = doc.withColumn("type", get("type"))
    nodes = typed.where("type <> 'relationship'").select(get("id").alias("id"), "type", F.col(raw).alias("raw"))
    edges = typed.where("type = 'relationship'").select(
        get("source_ref").alias("src"), get("target_ref").alias("dst"), get("relationship_type").alias("relationship_type"), get("created").try_cast("timestamp").alias("edge_timestamp"), F.col(raw).alias("raw")
    )
    return nodes, edges


def node_types(nodes: DataFrame) -> list[str]:
    return sorted(r[0] for r in nodes.select("type").distinct().collect())


def node_metadata(nodes: DataFrame, node_id: object) -> DataFrame:
    """id, type and raw (as text) of one node; no row if there is none."""
    return nodes.where(F.col("id") == F.lit(node_id)).select("id", "type", F.col("raw").cast("string").alias("raw")).limit(1)


def relationship_types(edges: DataFrame) -> list[str]:
    return sorted(r[0] for r in edges.select("relationship_type").distinct().collect())


def degrees(nodes: DataFrame, edges: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """id, type, in_degree, out_degree, degree of the nodes (of some types)."""
    chosen = nodes.where(F.col("type").isin(list(types))) if types else nodes
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    joined = chosen.join(counted, "id", "left")
    i, o = F.coalesce("i", F.lit(0)).cast("long"), F.coalesce("o", F.lit(0)).cast("long")
    return joined.select("id", "type", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def top_connected(nodes: DataFrame, edges: DataFrame, n: int = 10, types: Sequence[str] | None = None) -> DataFrame:
    """The n nodes (of some types) of the largest degree, ties by id."""
    top = degrees(nodes, edges, types).orderBy(F.desc("degree"), "id").limit(n)
    # n rows, so the rank needs no more than one task
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("long"))


def simple_paths(nodes: DataFrame, edges: DataFrame, start: object, most_steps: int = 3, types: Sequence[str] | None = None) -> DataFrame:
    """All simple paths from `start` over edges in either direction: node, level, path (ids joined by ", ").

    One join a level; nodes of a path are not visited again. The number of paths can grow with the degree to the power of
    the level, so keep most_steps small. `types` filters the end nodes only.
    """
    hops = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = nodes.where(F.col("id") == F.lit(start)).select(F.col("id").alias("node"), F.array(F.col("id")).alias("path"))
    levels = []
    for level in range(1, most_steps + 1):
        front = front.join(hops, front["node"] == hops["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        levels.append(front.withColumn("level", F.lit(level)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    ends = nodes.where(F.col("type").isin(list(types))) if types else nodes
    return out.join(ends.select(F.col("id").alias("node"), "type"), "node").select("node", "type", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ", ").alias("path"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, types: Sequence[str] | None = None, write_every: int = 5) -> DataFrame:
    """id, type, score: 1/N on each (chosen) node, pushed along all edges `rounds` times; at the last round reached the
    inbound weight plus the teleport share (1 - d^k)(1 - d)/(N (1 - d)). Weight at nodes without edges is lost.

    Weights of a node are summed each round, so the work is rounds x edges. The edges with their shares are written once
    into the shared folder, the weights every few rounds (written, not checkpointed: a checkpoint computes its rows twice);
    the loop ends when no weight is left to push, which is only looked at then.
    """
    chosen = nodes.where(F.col("type").isin(list(types))) if types else nodes
    n = chosen.count()
    if not n:
        return chosen.select("id", "type", F.lit(0.0).alias("score"))
    out_degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    hops = written(edges.select("src", "dst").join(out_degree, "src").withColumn("share", F.lit(damping) / F.col("out")).select("src", "dst", "share"), "hops")
    weight = chosen.select("id", (F.lit(1.0) / n).alias("w"))
    reached, last, since = 0, weight, []
    for k in range(1, rounds + 1):
        weight = weight.join(hops, weight["id"] == hops["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("share")).alias("w"))
        since.append((k, weight))
        if k % write_every and k != rounds:
            continue
        weight = written(weight, "weights")
        if not weight.isEmpty():
            reached, last, since = k, weight, []
            continue
        # the last of these rounds that still had weight, in one job
        each = [w.agg(F.count("*").alias("n")).select(F.lit(i).alias("k"), "n") for i, w in since[:-1]]
        found = [r["k"] for r in reduce(DataFrame.unionByName, each).where("n > 0").collect()] if each else []
        if found:
            reached, last = next((i, w) for i, w in since if i == max(found))
        break
    base = (1 - damping) / n * (1 - damping**reached) / (1 - damping)
    scores = chosen.join(last, "id", "left") if reached else chosen.withColumn("w", F.lit(0.0))
    return scores.select("id", "type", (F.coalesce("w", F.lit(0.0)) + F.lit(base)).alias("score"))


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among ids (column id): two equi-joins instead of one join on an OR."""
    a = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    b = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return a.unionByName(b).distinct()


def read_only(statement: str) -> bool:
    """May a tool run this statement? Only those that read."""
    words = statement.strip().lower().split(None, 1)
    return bool(words) and words[0].rstrip("(") in ("select", "with", "call") and ";" not in statement.strip().rstrip(";")


def bounded(value: int, low: int = 1, high: int = 10) -> int:
    return max(low, min(high, int(value)))
