"""Selections over notes (path, title, folder, mtime, tags, links)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import neighbours


def _words(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs)).cast("array<string>")


def any_tag(notes: DataFrame, tags: str) -> DataFrame:
    """Notes with one of a comma list of tags."""
    wanted = [t.strip() for t in tags.split(",") if t.strip()]
    return notes.where(F.arrays_overlap("tags", _words(wanted))) if wanted else notes


def all_tags(notes: DataFrame, tags: list[str], folder: str = "", limit: int | None = None) -> DataFrame:
    """Notes with every tag and the path prefix, in any case; the first by path."""
    lower = F.transform("tags", F.lower)
    kept = notes.where(F.size(F.array_intersect(lower, _words([t.lower() for t in tags]))) == len({t.lower() for t in tags})) if tags else notes
    kept = kept.where(F.lower("path").startswith(folder.lower())) if folder else kept
    return kept.orderBy("path").limit(limit) if limit is not None else kept


def in_folder(notes: DataFrame, folder: str) -> DataFrame:
    return notes.where(F.col("folder") == folder)


def mtime_between(notes: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Inclusive at both ends; either may be open."""
    notes = notes.where(F.col("mtime") >= F.lit(since).cast("timestamp_ntz")) if since else notes
    return notes.where(F.col("mtime") <= F.lit(until).cast("timestamp_ntz")) if until else notes


def recent(notes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Notes changed within 1 to 365 days before ``as_of``, newest first."""
    days = min(max(days, 1), 365)
    return notes.where(F.col("mtime") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")).orderBy(F.desc("mtime"), "path")


def random_note(notes: DataFrame, seed: int) -> DataFrame:
    return notes.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "path")), "path").limit(1)


def resolve(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each distinct ref with the path it stands for: exact path, title, or ref + .md."""
    paths = notes.select("path").distinct()
    titles = notes.groupBy("title").agg(F.max("path").alias("by_title"))
    refs = refs.select("ref").distinct()
    told = refs.join(paths.withColumnRenamed("path", "by_path"), F.col("ref") == F.col("by_path"), "left").join(titles, F.col("ref") == F.col("title"), "left")
    told = told.join(paths.withColumnRenamed("path", "by_file"), F.concat("ref", F.lit(".md")) == F.col("by_file"), "left")
    return told.select("ref", F.coalesce("by_path", "by_title", "by_file").alias("path"))


#: Names of a home note, best first.
HOME = ["README.md", "Readme.md", "readme.md", "index.md", "Index.md"]


def home_note(notes: DataFrame) -> DataFrame:
    """The first home name that exists at the root, else the first path."""
    rank = F.coalesce(F.nullif(F.array_position(_words(HOME), F.col("path")), F.lit(0)), F.lit(len(HOME) + 1))
    return notes.agg(F.min_by("path", F.struct(rank.alias("rank"), "path")).alias("path"))


def graph_filter(nodes: DataFrame, edges: DataFrame, tag: str = "", folder: str = "", hide_isolated: bool = False, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes by tag and folder substring and by time; edges with both ends kept."""
    if tag:
        nodes = nodes.where(F.exists("tags", lambda t: F.lower(t).contains(tag.lower())))
    if folder:
        nodes = nodes.where(F.lower("path").contains(folder.lower()))
    nodes = mtime_between(nodes, since, until)
    ids = nodes.select("path")
    kept = edges.join(ids.withColumnRenamed("path", "src"), "src", "left_semi").join(ids.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    if hide_isolated:
        ends = kept.select(F.col("src").alias("path")).union(kept.select(F.col("dst").alias("path"))).distinct()
        nodes = nodes.join(ends, "path", "left_semi")
    return nodes, kept


def adjacent_notes(notes: DataFrame) -> DataFrame:
    """Each note's neighbours in the order of all paths, across folders."""
    return neighbours(notes.select("folder", "path"), "path", F.col("path")).select("folder", "path", "previous", "next")
