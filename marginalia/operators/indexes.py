"""Indexes over notes as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def link_index(notes: DataFrame) -> DataFrame:
    """title and path; the greatest path stands for a title that occurs twice."""
    return notes.groupBy("title").agg(F.max("path").alias("path"))


def duplicate_titles(notes: DataFrame) -> DataFrame:
    return notes.groupBy("title").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths")).where("n > 1")


def link_rows(notes: DataFrame) -> DataFrame:
    """path, title, place, target: a row for each link."""
    return notes.select("path", "title", F.posexplode("links").alias("place", "target"))


#: Values in one row of an index.
CHUNK = 4096


def listed(rows: DataFrame, key: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """key, part and the sorted values of that part: keys of more than ``chunk`` values are
    divided by hash into parts of about so many, so no row and no task grows with a key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    h = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")
    part = F.coalesce(F.pmod(h, F.ceil(F.col("n") / F.lit(chunk))), F.lit(0)).cast("int")
    return rows.join(counts, key, "left").groupBy(key, part.alias("part")).agg(F.sort_array(F.collect_list(value)).alias(name))


def backlinks(notes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Raw target, part and the sorted titles that link to it, repeats kept."""
    return listed(link_rows(notes), "target", "title", "sources", chunk)


def tag_rows(notes: DataFrame) -> DataFrame:
    return notes.select("path", "title", F.explode("tags").alias("tag"))


def tag_index(notes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return listed(tag_rows(notes), "tag", "title", "titles", chunk)


def tag_counts(notes: DataFrame) -> DataFrame:
    return tag_rows(notes).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def notes_for_tag(notes: DataFrame, tag: str) -> DataFrame:
    """title and path of a tag's notes."""
    titles = notes.where(F.array_contains("tags", tag)).select("title").distinct()
    return titles.join(link_index(notes), "title").orderBy("title")


def folder_tree(notes: DataFrame) -> DataFrame:
    """Depth-first rows: node, name, depth, whether a note, and its order.

    A folder comes before what is beneath it, and its notes and folders come by path."""
    parts = F.split("path", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")
    rows = notes.select("path", "title", parts.alias("parts"), level)
    node = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    rows = rows.select(node.alias("node"), "path", "title", (F.col("depth") - 1).alias("depth"), (F.col("depth") == F.size("parts")).alias("is_note"))
    nodes = rows.groupBy("node", "depth", "is_note").agg(F.min("path").alias("first"), F.max("title").alias("title"))
    name = F.when(F.col("is_note"), F.col("title")).otherwise(F.regexp_extract("node", r"([^/]+)$", 1))
    return nodes.select("node", name.alias("name"), "depth", "is_note", F.struct("first", "depth").alias("sort_key"))


def ordered_tree(notes: DataFrame) -> DataFrame:
    """The folder tree with its order over everything, numbered by range."""
    tree = folder_tree(notes)
    return numbered(tree, F.col("sort_key.first"), F.col("sort_key.depth")).select("node", "name", "depth", "is_note", F.col("n").cast("int").alias("n"))


def merged_index(notes: DataFrame, changes: DataFrame, parsed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Backlinks after a change set: contributions of changed notes are replaced. ``sources.index``
    keeps link rows on disk and replaces only what changed there."""
    kept = link_rows(notes).join(changes.select("path").distinct(), "path", "left_anti")
    rows = kept.unionByName(link_rows(parsed))
    return listed(rows, "target", "title", "sources", chunk)
