"""Exports of notes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators.ordering import numbered
from ..session import shared_folder

#: Links on a page of the site's index.
INDEX_LINKS = 1000


def shared_path(spark: SparkSession) -> str:
    """A new path in the session's shared folder; the warehouse is shared too."""
    return f"{shared_folder(spark)}/marginalia-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Each row's content as a file of its own at its path below ``root``. The tasks write through the file system
    that ``root`` names; one that they cannot reach is an error, never a local folder in its place."""

    def write(batch: Iterator[Row]) -> None:
        fs, base = FileSystem.from_uri(re.sub("^s3a:", "s3:", root if re.match("[a-z0-9]+:", root) else f"file://{os.path.abspath(root)}"))
        made: set[str] = set()
        for r in batch:
            at = f"{base.rstrip('/')}/{r[path]}"
            folder = at.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder)
                made.add(folder)
            with fs.open_output_stream(at) as f:
                f.write(r[content].encode())

    rows.select(path, content).foreachPartition(write)


def write_notes(notes: DataFrame, root: str) -> None:
    """Each note as a text file at its path below ``root``."""
    write_files(notes, root, content="raw")


def search_dump(notes: DataFrame) -> DataFrame:
    """title, path, tags, the first 300 characters, mtime in seconds."""
    return notes.select("title", "path", F.array_join("tags", "|").alias("tags"), F.substring(T.strip_html(F.col("body")), 1, 300).alias("content"), F.unix_seconds(F.col("mtime").cast("timestamp")).alias("mtime"))


def feed(notes: DataFrame, tag: str = "", folder: str = "", limit: int = 50) -> DataFrame:
    """The newest notes of a tag and of a folder with what is below it."""
    kept = notes.where(F.array_contains("tags", tag)) if tag else notes
    kept = kept.where((F.col("folder") == folder) | F.col("folder").startswith(folder + "/")) if folder else kept
    return kept.orderBy(F.desc("mtime"), "path").limit(limit).select("title", "path", dates.rfc3339(F.col("mtime")).alias("updated"))


def atom(entries: DataFrame) -> DataFrame:
    """Each feed row as an Atom entry."""
    e = T.escape_html
    return entries.select(F.concat(F.lit("<entry><title>"), e(F.col("title")), F.lit("</title><id>"), e(F.col("path")), F.lit("</id><updated>"), "updated", F.lit("</updated></entry>")).alias("entry"))


def pages(notes: DataFrame) -> DataFrame:
    """folder, html_path and html: a page for each note, its title above its escaped source."""
    html = F.concat(F.lit("<h1>"), T.escape_html(F.col("title")), F.lit("</h1><pre>"), T.escape_html(F.col("body")), F.lit("</pre>"))
    return notes.select("folder", F.regexp_replace("path", r"\.md$", ".html").alias("html_path"), html.alias("html"))


def export_site(notes: DataFrame, root: str) -> None:
    """A page file for each note, and an index of pages sorted by path: a page for every range of
    paths, with links, below ``index``."""
    write_files(pages(notes), f"{root}/pages", "html_path", "html")
    rows = numbered(notes.select("path", "title"), F.col("path")).withColumn("part", F.floor((F.col("n") - 1) / INDEX_LINKS))
    link = F.concat(F.lit('<li><a href="/'), T.escape_html(F.regexp_replace("path", r"\.md$", ".html")), F.lit('">'), T.escape_html(F.col("title")), F.lit("</a></li>"))
    parts = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("n", link.alias("link")))).alias("links"))
    html = F.concat(F.lit("<ul>"), F.array_join(F.transform("links", lambda x: x["link"]), ""), F.lit("</ul>"))
    write_files(parts.select(F.concat("part", F.lit(".html")).alias("path"), html.alias("content")), f"{root}/index")


def title_catalog(notes: DataFrame) -> DataFrame:
    """All titles with their paths, and all tags."""
    titles = notes.select(F.lit("title").alias("kind"), F.col("title").alias("name"), "path")
    return titles.union(notes.select(F.explode("tags").alias("t")).distinct().select(F.lit("tag"), "t", F.lit("")))
