"""Connected components by alternating large-star and small-star, and groups of rows that share keys.

Each step is a grouped minimum (combined before the shuffle) and a join back on the node, so a node of very many links is
no group in one task. The number of rounds grows with the logarithm of the nodes, not with the length of chains. Every
round is written to the workspace, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainframe.sources.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them. Edges go from the larger node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``(node, component)`` of all nodes with a link: the component is its smallest node. ``links`` has ``a`` and ``b``.

    Links of a node with itself and links without both ends join nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen, round_ = None, 0
    while True:
        edges = work.save(edges if seen is None else _small_star(_large_star(edges)), f"{name}-{round_}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if round_ > 1:
            work.drop(f"{name}-{round_ - 2}")
        if not now[0] or now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        seen, round_ = now, round_ + 1


def independent_groups(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """``row_id, component``: rows that share any key, directly or through others, under their least id. Null keys join nothing.

    Each row links to the least row of each of its keys, so a hot key makes no more links than it has rows.
    """
    work = Workspace(rows.sparkSession, "groups")
    named = [F.when(k.isNotNull(), F.struct(F.lit(n).alias("kind"), k.cast("string").alias("value"))) for n, k in keys.items()]
    held = work.save(rows.select(F.col(row_id).alias("id_"), F.array_compact(F.array(*named)).alias("keys_")), "rows")
    by_row = held.select("id_", F.explode("keys_").alias("key_")).distinct()
    links = by_row.join(by_row.groupBy("key_").agg(F.min("id_").alias("least_")), "key_").select(F.col("id_").alias("a"), F.col("least_").alias("b"))
    found = connected_components(links, work)
    ids = held.select("id_").distinct()
    return ids.join(found.withColumnRenamed("node", "id_"), "id_", "left").select(F.col("id_").alias(row_id), F.coalesce("component", "id_").alias("component"))


def group_digests(members: DataFrame, group: str, member: str) -> DataFrame:
    """``group, members, digest``: SHA-256 of the sorted members' canonical JSON array, the identity of a group.

    The members of one group are put together; a group of a study is small. Groups of rows at large go by their least id.
    """
    listed = F.array_sort(F.collect_set(F.col(member).cast("string")))
    return members.groupBy(group).agg(F.count("*").alias("members"), F.sha2(F.to_json(listed), 256).alias("digest"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node``: what is reachable along edges (``source, target``) from each start (``start``), itself included.

    While each node has one edge at most (chains), paths are doubled: a round of jumps twice as long reaches twice as far. Where
    edges branch, a round is one join on the frontier alone. Rounds end when nothing new is reached.
    """
    work = Workspace(edges.sparkSession, "closure")
    links = work.save(edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").select("source", "target").distinct(), "edges")
    frontier = work.save(starts.where("start IS NOT NULL").select("start", F.col("start").alias("node")).distinct(), "front-0")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frontier.schema.fields)
    work.append(frontier, "seen")
    if links.groupBy("source").count().where("count > 1").isEmpty():
        jumps, step = links, 0
        while True:
            seen = work.save(work.read("seen", schema) if step == 0 else seen, f"seen-{step}")
            fresh = seen.join(jumps, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"))
            fresh = work.save(fresh.join(seen, ["start", "node"], "left_anti").distinct(), f"fresh-{step}")
            if fresh.isEmpty():
                return seen
            seen, step = seen.union(fresh), step + 1
            far = jumps.select("source", F.col("target").alias("via"))
            jumps = work.save(far.join(jumps.withColumnRenamed("source", "via"), "via").select("source", "target"), f"jumps-{step}")
    step = 0
    while True:
        step += 1
        seen = work.read("seen", schema)
        fresh = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        frontier = work.save(fresh.join(seen, ["start", "node"], "left_anti"), f"front-{step}")
        if frontier.isEmpty():
            return seen
        work.append(frontier, "seen")
