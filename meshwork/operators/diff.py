"""Revision-ordered graph diffs: lanes, validation, batch application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dealing import tasks_for
from .validate import union, violations


def lane_conflicts(changes: DataFrame, revision: str = "revision") -> DataFrame:
    """Ids that stand more than once in one revision, in one lane or in several."""
    return changes.groupBy(revision, "id").agg(F.count("*").alias("n")).where("n > 1")


def lane_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def stale(revisions: DataFrame, order: str, block: str | None = None) -> DataFrame:
    """Revisions that are not newer than all before them in arrival order; those are rejected, never merged."""
    window = Window.partitionBy(*([block] if block else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return revisions.withColumn("current", F.max("revision").over(window)).where(F.col("revision") <= F.col("current"))


def last_writer(changes: DataFrame) -> DataFrame:
    """Live rows after a valid log: per id the newest change, gone when that removes. One aggregate, no sort."""
    columns = [c for c in changes.columns if c not in ("id", "revision")]
    newest = changes.groupBy("id").agg(F.max_by(F.struct("revision", *columns), "revision").alias("c"))
    return newest.where("c.op <> 'remove'").select("id", "c.revision", *(f"c.{c}" for c in columns if c != "op"))


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after one validated revision: what is removed or rewritten goes, what is added or updated comes."""
    kept = state.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.where("op <> 'remove'").select(*state.columns))


def exists_after(resident: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids that exist once the diff is applied: resident without removed, with added."""
    removed = changes.where("op = 'remove'").select("id")
    return resident.select("id").join(removed, "id", "left_anti").unionByName(changes.where("op = 'add'").select("id"))


def incident_edges(edges: DataFrame, removed_nodes: DataFrame, edge_changes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Resident edges that a removed node would leave dangling: neither removed nor rewritten by the same diff.

    Joins run in ``tasks`` tasks, by default as many as Spark chooses.
    """
    dealt = lambda df, key: df.repartition(tasks, key) if tasks else df
    escaped = edge_changes.where("op in ('remove', 'update')").select("id")
    left = dealt(edges, "id").join(dealt(escaped, "id"), "id", "left_anti")
    gone = removed_nodes.select(F.col("id").alias("node"))
    ends = left.select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return dealt(ends, "node").join(dealt(gone, "node"), "node", "left_semi").select("id", "node")


def diff_violations(nodes: DataFrame, edges: DataFrame, node_changes: DataFrame, edge_changes: DataFrame, current: int) -> DataFrame:
    """All rules of one diff in the order in which they are checked. Changes carry revision, op, ord, id (edges: source, target).

    Rows are counted first, so that a task of a join gets a bounded number of them.
    """
    frames = []
    tasks = {name: tasks_for(rows.count() + resident.count()) for name, rows, resident in (("Node", node_changes, nodes), ("Edge", edge_changes, edges))}
    stale_rows = node_changes.select("revision", "id").unionByName(edge_changes.select("revision", "id"))
    frames.append(violations(stale_rows, "StaleRevision", F.col("revision") <= current, "revision", F.lit(0), 0, F.lit(current)))
    for phase, rows, resident, name in ((1, node_changes, nodes, "Node"), (2, edge_changes, edges, "Edge")):
        rows = rows.repartition(tasks[name], "id")
        again = rows.join(rows.groupBy("id").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1"), "id")
        frames.append(violations(again, f"Conflicting{name}Mutation", F.col("ord") > F.col("first"), "id", F.col("ord"), phase))
        known = resident.select("id").repartition(tasks[name], "id")
        frames.append(violations(rows.where("op = 'add'").join(known, "id", "left_semi"), f"{name}AlreadyExists", F.lit(True), "id", F.col("ord"), phase))
        frames.append(violations(rows.where("op <> 'add'").join(known, "id", "left_anti"), f"{name}NotFound", F.lit(True), "id", F.col("ord"), phase))
    after = exists_after(nodes, node_changes)
    written = edge_changes.where("op <> 'remove'")
    for end, rule in (("source", "MissingSourceNode"), ("target", "MissingTargetNode")):
        lost = written.repartition(tasks["Edge"], end).join(after.select(F.col("id").alias(end)).repartition(tasks["Edge"], end), end, "left_anti")
        frames.append(violations(lost, rule, F.lit(True), "id", F.col("ord"), 2, F.col(end)))
    dangling = incident_edges(edges, node_changes.where("op = 'remove'"), edge_changes, tasks["Edge"])
    frames.append(violations(dangling, "IncidentEdgeNotRemoved", F.lit(True), "node", F.col("id"), 3, F.col("id")))
    return union(frames)
