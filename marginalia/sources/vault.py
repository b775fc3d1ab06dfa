"""Notes: scanned from files, or derived from the documents table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from . import frontmatter

#: The derived vault in SQL that both engines run; mt and nl are each engine's own.
DERIVED = """
select case when doc_id % 50 = 49 then 'Doc ' || (doc_id - 1) when doc_id % 50 = 24 then 'Solo ' || doc_id else 'Doc ' || doc_id end as title,
  case when doc_id % 50 = 49 then 'dup' else source || '/' || lang end as folder,
  case when doc_id % 50 = 49 then 'dup/Doc ' || (doc_id - 1) || '.md' else source || '/' || lang || case when doc_id % 50 = 24 then '/Solo ' else '/Doc ' end || doc_id || '.md' end as path,
  {mt} as mtime,
  case when doc_id % 9 = 0 then '' else '---' || {nl} || 'title: Doc ' || doc_id || {nl} || 'tags: [' || lang || ', ' || source || ']' || {nl}
    || case when doc_id % 6 = 1 then 'date: 2023/0' || (doc_id % 9 + 1) || '/1' || (doc_id % 10) || {nl} else '' end || '---' || {nl} end
   || '# Doc ' || doc_id || {nl} || text || {nl}
   || case when doc_id % 5 <> 0 and doc_id % 50 <> 24 then '[[Doc ' || ((doc_id * 7 + 1) % n) || ']] and [[Doc ' || ((doc_id * 13 + 5) % n) || '|alias]] ' else '' end
   || case when doc_id % 11 = 0 and doc_id % 50 <> 24 then '[[Missing ' || (doc_id % 23) || ']] ' else '' end
   || case when doc_id % 7 = 3 then '![[pic' || (doc_id % 5) || '.png|Picture]] ![[Doc ' || ((doc_id * 3 + 2) % n) || '#Part]] ![[plan' || (doc_id % 3) || '.pdf]] ' else '' end
   || case when doc_id % 8 = 1 then {nl} || '```python' || {nl} || 'print(1)' || {nl} || '```' || {nl} else '' end
   || case when doc_id % 10 = 2 then {nl} || '## Part ' || (doc_id % 4) || {nl} || 'so ==marked== and $x+y$ and $$a=b$$ ![one](img/p' || (doc_id % 6) || '.png) see [two](files/f' || (doc_id % 4) || '.pdf)' || {nl} else '' end
   || case when doc_id % 4 = 0 then '' else '#t' || (doc_id % 17) || ' ' end as raw
from (select *, (select count(*) from documents) as n from documents) d
"""


def derived_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, folder, path, mtime, raw: Markdown notes made from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mtime = "timestampadd(MINUTE, cast(-(doc_id * 677 % 1051200) as int), timestamp_ntz'2024-06-30 12:00:00')"
    return spark.sql(DERIVED.replace("from documents", "from {documents}").format(mt=mtime, nl="'\\n'", documents="{documents}"), documents=docs)


def notes(vault: DataFrame) -> DataFrame:
    """The extracted columns of every note beside its raw text."""
    raw = F.col("raw")
    told = vault.withColumn("frontmatter", M.frontmatter(raw)).withColumn("body", M.body(raw))
    text = F.col("body")
    return told.withColumns({
        "links": M.links(text), "embeds": M.embeds(text), "tags": F.array_distinct(F.concat(frontmatter.tags(F.col("frontmatter")), M.hashtags(text))), "toc": M.toc(text), "visible_chars": T.visible_chars(text),
    })


def scan_vault(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """Notes read from Markdown files below ``root``; files without extension pass too. Files are chosen
    by their paths in the listing, so nothing of an asset or of an ignored file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = "^.*?" + re.escape(re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/")) + "/"
    listed = F.regexp_replace(T.percent_decode(F.col("_metadata.file_path")), below, "")
    files = files.where(listed.rlike(r"\.md$|(^|/)[^./]+$") & ~ignored(listed, patterns or []))
    kept = files.select(F.regexp_replace("path", below, "").alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "content")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "")
    return kept.select(stem.alias("title"), F.regexp_replace("path", r"/?[^/]+$", "").alias("folder"), "path", "mtime", F.decode("content", "utf-8").alias("raw"))


def glob_regex(pattern: str) -> str:
    """* and ? stay within a folder, ** does not; everything else is literal."""
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", pattern):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([\\.^$+{}\[\]()|])", r"\\\1", part)
    return f"(?i)^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Hidden components, components equal to a plain pattern, paths that match a glob."""
    drop = path.rlike(r"(^|/)\.")
    plain = [p.lower() for p in patterns if not re.search(r"[*?\[]", p)]
    if plain:
        drop = drop | F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(p) for p in plain)))
    for p in patterns:
        if re.search(r"[*?\[]", p):
            drop = drop | path.rlike(glob_regex(p))
    return drop


def asset_index(files: DataFrame) -> DataFrame:
    """filename and path of what is not a note; the greatest path wins."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~F.col("path").endswith(".md")).groupBy(name.alias("filename")).agg(F.max("path").alias("path"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and op, upsert or delete, from two snapshots with path and version."""
    a, b = old.select("path", F.col("version").alias("was")), new.select("path", F.col("version").alias("now"))
    both = a.join(b, "path", "full_outer")
    op = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "upsert")
    return both.select("path", op.alias("op")).where("op is not null")


def needs_update(old: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are new or newer than their note."""
    known = old.select("path", F.col("mtime").alias("known"))
    return files.join(known, "path", "left").where("known is null or mtime > known").drop("known")


def apply_changes(current: DataFrame, changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Upsert and delete by path, keep the rest."""
    return current.join(changes.select("path").distinct(), "path", "left_anti").unionByName(parsed.join(changes.where("op = 'upsert'").select("path").distinct(), "path", "left_semi"))


def save_snapshot(frame: DataFrame, path: str, fingerprint: dict[str, str]) -> None:
    """The rows as a new generation, then one row of metadata that names it. While a mark is
    replaced there is none, so a mark never stands for rows that are not whole."""
    rows = f"rows-{uuid.uuid4().hex}"
    frame.write.parquet(f"{path}/{rows}")
    frame.sparkSession.createDataFrame([fingerprint | {"generation": rows}]).coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")


def load_snapshot(spark: SparkSession, path: str, fingerprint: dict[str, str]) -> DataFrame | None:
    """The rows if the saved metadata is the same, else None."""
    try:
        mark = spark.read.parquet(f"{path}/mark").first()
    except Exception as e:  # a snapshot that was never finished has no mark
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    rows = mark.asDict().pop("generation") if mark else ""
    return spark.read.parquet(f"{path}/{rows}") if mark and mark.asDict() == fingerprint | {"generation": rows} else None


def multi_vault_union(vaults: dict[str, DataFrame]) -> DataFrame:
    """Independent vaults in one frame, told apart by ``vault``."""
    frames = [df.withColumn("vault", F.lit(name)) for name, df in vaults.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """hash, hash_short, author, date, subject of ``hash|email|date|subject`` lines."""
    p = F.split("value", r"\|", 4)
    return lines.where(F.size(p) == 4).select(p[0].alias("hash"), F.substring(p[0], 1, 8).alias("hash_short"), p[1].alias("author"), p[2].alias("date"), p[3].alias("subject"))


def classify_diff(diffs: DataFrame) -> DataFrame:
    """path, n, kind, text for each line of ``diff`` but its file heads."""
    lines = diffs.select("path", F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    x = F.col("line")
    kind = F.when(x.startswith("@@ "), "hunk").when(x.startswith("+"), "add").when(x.startswith("-"), "del").otherwise("ctx")
    text = F.when(x.startswith("@@ "), x).when(x.rlike("^[-+ ]"), F.expr("substring(line, 2)")).otherwise(x)
    return lines.where(~x.rlike(r"^(--- |\+\+\+ |diff )")).select("path", "n", kind.alias("kind"), text.alias("text"))


def note_as_of(versions: DataFrame, when: Column) -> DataFrame:
    """Each path's content as it stood at a time."""
    return versions.where(F.col("commit_ts") <= when).groupBy("path").agg(F.max_by("content", "commit_ts").alias("content"), F.max("commit_ts").alias("commit_ts"))
