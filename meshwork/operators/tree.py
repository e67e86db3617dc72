"""Folder and note trees as adjacency lists, climbed by pointer doubling.

Each entry keeps a link to an ancestor. In a round, all links are replaced by
their ancestor's own links, so they reach twice as far: a tree takes as many rounds
as its depth has binary digits, each a join and a write to the shared folder.
Entries whose link has reached a top take no part in later rounds, so no
round sends many rows to one top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from meshwork.functions.text import ascii_lower, name_error, trim_white
from meshwork.sources.shared import new_path
from meshwork.types import LIMITS

from .dealing import sized_join, tasks_for
from .slots import assign_slots
from .validate import union, violations

ROOT_ID = 1


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "folder", 0).otherwise(1)


def climb(links: DataFrame, tops: DataFrame, **carried: Column) -> DataFrame:
    """(id, top, steps, carried) of each entry from which parents lead to one of ``tops``, up to the nearest one.

    ``links`` has id and parent. ``carried`` names what is gathered along the way, as arrays
    from the top down to the entry. Entries whose parents end elsewhere, or
    go round in a cycle, are left out: while any other is left, each round
    settles some, so a round that settles none is the last.
    """
    spark, names = links.sparkSession, list(carried)
    rows = links.where("id is not null").select("id", "parent", *(F.array(c).alias(n) for n, c in carried.items()))
    tops = tops.select("id").distinct()
    at_top = rows.join(tops, "id", "left_semi")
    joined = lambda here: [F.concat(f"above_{n}", n).alias(n) if here is None else F.when(here, F.concat(f"above_{n}", n)).otherwise(F.col(n)).alias(n) for n in names]
    above = lambda df: df.select(F.col("id").alias("above_id"), *(F.col(c).alias(f"above_{c}") for c in df.columns if c != "id"))

    def stored(df: DataFrame) -> DataFrame:
        path = new_path(spark, "climb")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    begun = at_top.select("id", F.col("id").alias("up"), F.lit(0).cast("bigint").alias("steps"), F.lit(True).alias("reached"), *names)
    met = F.col("above_id").isNotNull()
    tasks = tasks_for(rows.count())
    others = sized_join(rows.join(tops, "id", "left_anti"), above(at_top.select("id", *names)), "parent", "above_id", tasks, "left")
    others = others.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps"), met.alias("reached"), *joined(met))
    parts, active, left = [], stored(begun.unionByName(others)), None
    while True:
        parts.append(active.where("reached"))
        active = active.where("not reached")
        unsettled = active.count()
        if unsettled in (0, left):
            return union(parts).select("id", F.col("up").alias("top"), "steps", *names)
        left = unsettled
        far = sized_join(active, above(union([*parts, active])), "up", "above_id", tasks)
        active = stored(far.select("id", F.col("above_up").alias("up"), (F.col("steps") + F.col("above_steps")).alias("steps"), F.col("above_reached").alias("reached"), *joined(None)))


def walk(entries: DataFrame, start: DataFrame, expand: Column | None = None) -> DataFrame:
    """Rows reachable from ``start`` ids downwards: id, kind, depth, path (names) and key (a sortable path).

    ``expand`` tells whose children to enter.
    """
    rows = entries.select("id", "parent", "kind", "name")
    if expand is not None:
        # an entry below a closed one has no way up
        entered = entries.where(expand).select(F.col("id").alias("parent"))
        rows = rows.join(entered, "parent", "left_semi").unionByName(rows.join(start.select("id"), "id", "left_semi")).distinct()
    step = F.struct(kind_rank(F.col("kind")).alias("rank"), F.lower("name").alias("name"))
    climbed = climb(rows, start, path=F.col("name"), key=step, kinds=F.col("kind"))
    return climbed.select("id", F.element_at("kinds", -1).alias("kind"), F.col("steps").cast("int").alias("depth"), "path", "key")


def root(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("id") == ROOT_ID).select("id")


def paths(entries: DataFrame) -> DataFrame:
    """(id, path): names from the root joined by " / "."""
    return walk(entries, root(entries)).select("id", F.array_join("path", " / ").alias("path"))


def visible_rows(entries: DataFrame, expanded: Column) -> DataFrame:
    """Rows shown when some folders are expanded, with depth and pre-order place: folders first, then by lower-case name."""
    shown = walk(entries, root(entries), expanded & (F.col("kind") == "folder"))
    placed = assign_slots(shown.select("id", "depth", F.struct("key", "id").alias("key")), "key", "place")
    return placed.select("id", "depth", (F.col("place") + 1).alias("place"))


def closure(entries: DataFrame, start: DataFrame) -> DataFrame:
    """Ids of the given entries and all below them."""
    tasks = tasks_for(entries.count())
    distinct = entries.select("id", "parent").repartition(tasks, "id").distinct()
    return climb(distinct, start).select("id").repartition(tasks, "id").distinct()


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The tree without the given entries and what is below them. The root cannot be deleted."""
    if not ids.where(F.col("id") == ROOT_ID).isEmpty():
        raise ValueError("RootIsImmutable")
    lost = ids.select("id").join(entries, "id", "left_anti").agg(F.min("id").alias("id")).first().id
    if lost is not None:
        raise ValueError(f"MissingEntry({lost})")
    return entries.join(closure(entries, ids), "id", "left_anti")


def unrooted(entries: DataFrame) -> DataFrame:
    """Ids from which no chain of parents leads to the root: cycles and lost branches."""
    return entries.join(closure(entries, root(entries)), "id", "left_anti").select("id")


def counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.col("kind") == "folder").alias("folders"), F.count_if(F.col("kind") == "note").alias("notes"))


def first_note(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'note'").agg(F.min("id").alias("id"))


def name_taken(entries: DataFrame, parent: int, name: str, besides: int = 0) -> bool:
    """Whether a sibling has the name, ignoring ASCII case."""
    same = ascii_lower(F.col("name")) == ascii_lower(F.lit(name))
    return not entries.where((F.col("parent") == parent) & same & (F.col("id") != besides)).isEmpty()


def create(entries: DataFrame, parent: int, kind: str, name: str, next_id: int, limit: int | None = LIMITS["entries"]) -> DataFrame:
    """The tree with a new entry. ``limit`` bounds a workspace's entries; trees over tables of any size have none."""
    spark = entries.sparkSession
    if limit is not None and entries.count() >= limit:
        raise ValueError("EntryLimit")
    folder = entries.where((F.col("id") == parent) & (F.col("kind") == "folder"))
    if folder.isEmpty():
        raise ValueError("ParentIsNotAFolder")
    checked = spark.range(1).select(trim_white(F.lit(name)).alias("name"), name_error(F.lit(name)).alias("error")).first()
    if checked.error:
        raise ValueError(checked.error)
    if name_taken(entries, parent, checked.name):
        raise ValueError("DuplicateName")
    return entries.unionByName(spark.createDataFrame([(next_id, parent, kind, checked.name)], "id bigint, parent bigint, kind string, name string"))


def rename(entries: DataFrame, wanted: int, name: str) -> DataFrame:
    if wanted == ROOT_ID:
        raise ValueError("RootIsImmutable")
    row = entries.where(F.col("id") == wanted).first()
    if row is None:
        raise ValueError(f"MissingEntry({wanted})")
    checked = entries.sparkSession.range(1).select(trim_white(F.lit(name)).alias("name"), name_error(F.lit(name)).alias("error")).first()
    if checked.error:
        raise ValueError(checked.error)
    if name_taken(entries, row.parent, checked.name, wanted):
        raise ValueError("DuplicateName")
    return entries.withColumn("name", F.when(F.col("id") == wanted, F.lit(checked.name)).otherwise(F.col("name")))


def entry(entries: DataFrame, wanted: int) -> Row:
    """One entry by its id."""
    row = entries.where(F.col("id") == wanted).first()
    if row is None:
        raise ValueError(f"MissingEntry({wanted})")
    return row


def require_note(entries: DataFrame, wanted: int) -> Row:
    row = entry(entries, wanted)
    if row.kind != "note":
        raise ValueError(f"NotNote({wanted})")
    return row


def find_entries(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, id) with the entry that each names, and what it is good for.

    ``error`` says why there is no such entry, ``note_error`` also why it is no note. ``home`` is the folder
    in which something new goes when the entry is selected: itself, or a note's folder.
    """
    rows = entries.select("id", "kind", "name", "parent")
    found = requests.join(rows, "id", "left")
    missing = F.when(F.col("kind").isNull(), "MissingEntry")
    home = F.when(F.col("kind") == "folder", F.col("id")).otherwise(F.col("parent"))
    return found.withColumns({"error": missing, "note_error": F.coalesce(missing, F.when(F.col("kind") != "note", "NotNote")), "home": home})


def names_taken(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requests (request, parent, name, besides) whose name a sibling other than ``besides`` has, ignoring ASCII case."""
    held = entries.select(F.col("parent").alias("_parent"), ascii_lower(F.col("name")).alias("_name"), F.col("id").alias("_id"))
    same = (F.col("parent") == F.col("_parent")) & (ascii_lower(F.col("name")) == F.col("_name"))
    return wanted.join(held, same & (F.col("_id") != F.coalesce("besides", F.lit(0))), "left_semi")


def first_notes(entries: DataFrame) -> DataFrame:
    """(parent, id): the first note of each folder in stored order."""
    return entries.where("kind = 'note'").groupBy("parent").agg(F.min("id").alias("id"))


def active_document(entries: DataFrame) -> DataFrame:
    """(id, document): the document that selecting an entry makes active; none for a folder."""
    return entries.select("id", F.when(F.col("kind") == "note", F.col("id")).alias("document"))


def parent_for_create(entries: DataFrame, selected: int) -> DataFrame:
    entry(entries, selected)
    return entries.where(F.col("id") == selected).select(F.when(F.col("kind") == "folder", F.col("id")).otherwise(F.col("parent")).alias("id"))


def tree_violations(entries: DataFrame) -> DataFrame:
    """Rules of a stored tree. Sibling names are compared in Unicode lower case here, unlike on creation."""
    rows = entries.withColumn("ord", F.col("id"))
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    siblings = rows.groupBy("parent", F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1")
    folders = rows.where("kind = 'folder'").select(F.col("id").alias("parent"))
    lost = rows.where(F.col("id") != ROOT_ID).join(folders, "parent", "left_anti")
    return union(
        [
            violations(again, "DuplicateEntry", F.lit(True), "id", F.col("id"), 0),
            violations(rows, "InvalidName", name_error(F.col("name")).isNotNull() | (F.col("name") != trim_white(F.col("name"))), "id", F.col("ord"), 1),
            violations(lost, "MissingParent", F.lit(True), "id", F.col("ord"), 2),
            violations(siblings, "DuplicateName", F.lit(True), "id", F.col("id"), 3),
            violations(unrooted(entries), "InvalidManifest", F.lit(True), "id", F.col("id"), 4),
        ]
    )
