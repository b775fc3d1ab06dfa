"""Corpus reports over notes (path, title, folder, mtime, body, links, tags, toc, visible_chars)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .graph import edges
from .indexes import link_index, link_rows, tag_counts, tag_rows


def totals(notes: DataFrame) -> DataFrame:
    tags = notes.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("n_tags"))
    return notes.agg(F.count("*").alias("n_notes"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("n_links")).join(tags, F.lit(True)).select("n_notes", "n_tags", "n_links")


def corpus_stats(notes: DataFrame, as_of: str) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 7 days")
    tags = notes.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("n_tags"))
    told = notes.agg(F.count("*").alias("n_notes"), F.count_if(F.col("mtime") > since).alias("n_recent"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
    return told.join(tags, F.lit(True))


def orphans_by_title(notes: DataFrame) -> DataFrame:
    """No links out, and the title is no raw target."""
    targets = link_rows(notes).select(F.col("target").alias("title")).distinct()
    return notes.where(F.size("links") == 0).join(targets, "title", "left_anti").select("title", "path").orderBy("title", "path")


def orphans_by_path(notes: DataFrame) -> DataFrame:
    """No links out, and no link resolves to the path."""
    hit = edges(notes).select(F.col("dst").alias("path")).distinct()
    return notes.where(F.size("links") == 0).join(hit, "path", "left_anti").select("title", "path").orderBy("path")


def broken_links(notes: DataFrame) -> DataFrame:
    """path, target of links that are no title, no path, and no path without .md."""
    rows = link_rows(notes).select("path", "target")
    known = notes.select(F.col("title").alias("target")).union(notes.select("path")).union(notes.select(F.regexp_replace("path", r"\.md$", ""))).distinct()
    return rows.join(known, "target", "left_anti").select("path", "target")


def large_notes(notes: DataFrame, chars: int = 5000) -> DataFrame:
    return notes.where((F.size("toc") == 0) & (F.col("visible_chars") > chars)).select("path", "visible_chars")


def untagged(notes: DataFrame) -> DataFrame:
    none = F.when(F.size("tags") == 0, 1.0).otherwise(0.0)
    return notes.agg(F.sum(none).cast("long").alias("n_untagged"), F.round(F.coalesce(F.avg(none), F.lit(0.0)), 6).alias("ratio"))


def tag_cloud(notes: DataFrame, limit: int = 200) -> DataFrame:
    return tag_counts(notes).limit(limit)


def _trailing(notes: DataFrame, as_of: str, unit: str, n: int, value: Column, name: str) -> DataFrame:
    """Sums by calendar period, zero-filled over the last n periods to ``as_of``."""
    form = "yyyy-MM" if unit == "month" else "yyyy-MM-dd"
    spark = notes.sparkSession
    last = F.date_trunc(unit, F.lit(as_of).cast("timestamp_ntz"))
    back = F.expr(f"interval {n - 1} {unit}s")
    periods = spark.range(1).select(F.explode(F.sequence((last - back).cast("date"), last.cast("date"), F.expr(f"interval 1 {unit}"))).alias("d")).select(F.date_format("d", form).alias("period"))
    dated = notes.where(F.col("mtime") > F.lit("1970-01-01").cast("timestamp_ntz")).groupBy(F.date_format("mtime", form).alias("period")).agg(F.sum(value).cast("long").alias(name))
    return periods.join(dated, "period", "left").select("period", F.coalesce(name, F.lit(0)).alias(name)).orderBy("period")


def monthly_notes(notes: DataFrame, as_of: str, n: int = 24) -> DataFrame:
    return _trailing(notes, as_of, "month", n, F.lit(1), "n_notes")


def daily_notes(notes: DataFrame, as_of: str, n: int = 30) -> DataFrame:
    return _trailing(notes, as_of, "day", n, F.lit(1), "n_notes")


def monthly_links(notes: DataFrame, as_of: str, n: int = 24) -> DataFrame:
    return _trailing(notes, as_of, "month", n, F.size("links"), "n_links")


def monthly_chars(notes: DataFrame, as_of: str, n: int = 24) -> DataFrame:
    return _trailing(notes, as_of, "month", n, F.col("visible_chars"), "n_chars")


def most_linked(notes: DataFrame, limit: int = 10) -> DataFrame:
    """title, path, in_degree by raw title; the top, without zeros."""
    counted = link_rows(notes).groupBy(F.col("target").alias("title")).agg(F.count("*").alias("in_degree"))
    return counted.join(link_index(notes), "title").select("title", "path", "in_degree").orderBy(F.desc("in_degree"), "path").limit(limit)


def tag_cooccurrence(notes: DataFrame, top: int = 15) -> DataFrame:
    """a, b, n: pairs within a note among the most frequent tags."""
    names = F.broadcast(tag_counts(notes).limit(top).select("tag"))
    rows = tag_rows(notes).join(names, "tag").groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    a = rows.select("path", "t", F.explode("t").alias("a"))
    pairs = a.select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b")


def tag_matrix(notes: DataFrame, top: int = 15) -> DataFrame:
    """a, b, n: the same as a symmetric matrix in rows, zeros filled."""
    names = tag_counts(notes).limit(top).select("tag")
    pairs = tag_cooccurrence(notes, top)
    both = pairs.union(pairs.select("b", "a", "n"))
    listed = names.agg(F.collect_list("tag").alias("t"))  # one row of top names
    cells = listed.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b"))
    return cells.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def connectivity(notes: DataFrame, limit: int = 10) -> DataFrame:
    """title, path, score: (2 in + out) over ln(n + 1), divided by the largest."""
    incoming = link_rows(notes).groupBy(F.col("target").alias("title")).agg(F.count("*").alias("i"))
    raw = notes.select("title", "path", F.size("links").alias("o")).join(incoming, "title", "left").select("title", "path", (2 * F.coalesce("i", F.lit(0)) + F.col("o")).alias("raw"))
    top = raw.agg(F.max("raw").alias("top"))
    told = raw.where("raw > 0").join(F.broadcast(top), F.lit(True)).select("title", "path", F.round(F.col("raw") / F.col("top"), 6).alias("score"))
    return told.orderBy(F.desc("score"), "path").limit(limit)


def timeline(notes: DataFrame) -> DataFrame:
    day = dates.note_date(F.col("frontmatter"), F.col("mtime"))
    return notes.select(day.alias("day"), "title", "path", F.array_join("tags", ",").alias("tags"), "mtime").orderBy(F.desc("day"), "path")


def timeline_groups(notes: DataFrame, by: str = "month", title: str = "", tag: str = "") -> DataFrame:
    """Notes by month or year of their day, after a title part and a tag."""
    kept = notes.where(F.lower("title").contains(title.lower())) if title else notes
    kept = kept.where(F.array_contains("tags", tag)) if tag else kept
    day = dates.note_date(F.col("frontmatter"), F.col("mtime"))
    return kept.groupBy(F.substring(day, 1, 4 if by == "year" else 7).alias("period")).agg(F.count("*").alias("n")).orderBy(F.desc("period"))


def timeline_rollup(notes: DataFrame) -> DataFrame:
    """year, month, n with subtotals (null month) and the total (null year)."""
    day = dates.note_date(F.col("frontmatter"), F.col("mtime"))
    parts = notes.select(F.substring(day, 1, 4).alias("year"), F.substring(day, 6, 2).alias("month"))
    return parts.rollup("year", "month").agg(F.count("*").alias("n"))


def tag_evolution(notes: DataFrame, top: int = 8, n: int = 24) -> DataFrame:
    """period, tag, n, stacked over the last months present, in the tags' order."""
    ranked = tag_counts(notes).limit(top).select("tag", F.row_number().over(Window.orderBy(F.desc("n"), "tag")).alias("place"))
    dated = notes.select(dates.year_month(F.col("mtime")).alias("period"), "tags")
    months = dated.select("period").distinct().orderBy(F.desc("period")).limit(n)
    listed = ranked.agg(F.collect_list(F.struct("tag", "place")).alias("t"))  # one row of top names
    cells = months.join(F.broadcast(listed), F.lit(True)).select("period", F.inline("t"))
    counted = dated.select("period", F.explode("tags").alias("tag")).groupBy("period", "tag").agg(F.count("*").alias("n"))
    told = cells.join(counted, ["period", "tag"], "left").select("period", "tag", "place", F.coalesce("n", F.lit(0)).alias("n"))
    return told.select("period", "tag", "n", F.sum("n").over(Window.partitionBy("period").orderBy("place")).alias("stacked"))


def writing_speed(notes: DataFrame, as_of: str, n: int = 24) -> DataFrame:
    """Monthly notes and characters with the largest of each."""
    both = monthly_notes(notes, as_of, n).join(monthly_chars(notes, as_of, n), "period")
    w = Window.partitionBy()  # n rows
    return both.select("period", "n_notes", "n_chars", F.max("n_notes").over(w).alias("max_notes"), F.max("n_chars").over(w).alias("max_chars"))
