"""A search index on disk that takes changes: immutable segments, delete sets and commit marks.

A segment holds what one change set brought: its extracted notes and, in folders by the hash of
their key, the postings of its words with their positions, its n-grams, its links and what titles are found by. A note that is changed or
deleted is named in the delete set of that commit, which hides it in the segments before. A commit is
one file that names segments and delete sets; a reader opens the greatest, in whatever session, and
what is not named is not there. So a change set costs what it brings: nothing else is read but
the paths of the notes before.

A table is written when it is first asked for: ``with_tables`` adds it to segments that were committed
without it, from the texts of their live notes. What changes later brings rows of the tables that are there.

Segments of about the same size are merged when there are ``FAN`` of them: their live rows are
written together, without their texts being read again. Folders that no commit names any more go
with ``vacuum``.

One writer at a time; of two at once the later commit stands. The rows of a bucket are dealt
by the size of what they take, so a frequent token fills several files and a rare one shares one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import indexes, search

#: Columns of extracted notes; text stays where it came from. ``words`` counts those of title and body.
COLUMNS = ["path", "title", "folder", "mtime", "frontmatter", "links", "embeds", "tags", "toc", "visible_chars"]
#: Text for which a segment has one bucket, and the buckets that it has at least and at most.
BUCKET_BYTES, FEWEST, MOST = 64 << 20, 8, 4096
#: Segments of one size, as powers of it, before they are merged.
FAN = 8
#: Deleted paths that are broadcast; more are joined by a shuffle.
BROADCAST_PATHS = 500_000
#: The key of each table in folders.
KEYS = {"postings": "token", "grams": "token", "links": "target", "titles": "key"}
FORMAT = 2


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def version(vault: DataFrame) -> DataFrame:
    """path and version: a number that changes with any of a note's rows."""
    return vault.groupBy("path").agg(F.bit_xor(F.xxhash64("title", "folder", "mtime", "raw")).alias("version"))


class Table:
    """The live rows of one of the index's tables in folders; ``of`` reads the folders of some keys only."""

    def __init__(self, index: Index, name: str):
        self.index, self.name = index, name

    def of(self, keys: list[str]) -> DataFrame:
        return self._told(self.index.rows(self.name, keys))

    def all(self) -> DataFrame:
        return self._told(self.index.rows(self.name))

    def _told(self, rows: DataFrame) -> DataFrame:
        if self.name != "postings":
            return rows
        totals = self.index.mark["totals"]
        mean = lambda field: F.lit(totals[field] / max(totals["docs"], 1))
        return rows.withColumns({"avg_length": F.when(F.col("field") == "title", mean("title")).otherwise(mean("body")), "n_docs": F.lit(totals["docs"]).cast("long")})


class Index:
    def __init__(self, spark: SparkSession, root: str, mark: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.mark = mark or {"commit": 0, "state": "", "segments": [], "deletes": [], "totals": {"docs": 0, "title": 0, "body": 0}, "schemas": {}}

    # reading
    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        """The index as its last commit left it; an empty one where there is none."""
        try:
            marks = spark.read.schema("commit long, mark string").parquet(f"{root.rstrip('/')}/commits")
            last = marks.agg(F.max_by("mark", F.struct("commit", "mark"))).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return cls(spark, root, json.loads(last) if last else None)

    @property
    def postings(self) -> Table:
        return Table(self, "postings")

    @property
    def grams(self) -> Table:
        return Table(self, "grams")

    @property
    def links(self) -> Table:
        return Table(self, "links")

    @property
    def titles(self) -> Table:
        return Table(self, "titles")

    @property
    def notes(self) -> DataFrame:
        return self.rows("notes").drop("words", "bytes", "version")

    @property
    def held(self) -> list[str]:
        """The tables in folders that all segments have."""
        return [name for name in KEYS if all(name in s["has"] for s in self.mark["segments"])]

    def rows(self, name: str, keys: list[str] | None = None, segments: list[dict] | None = None) -> DataFrame:
        """Live rows of a table in all segments, or in some; with ``keys``, of these keys."""
        held = [self._live(self._read(s, name, keys), s["seq"]) for s in (self.mark["segments"] if segments is None else segments)]
        held = [df for df in held if df is not None]
        if not held:
            return self.spark.createDataFrame([], self.mark["schemas"].get(name) or _empty(self.spark)[name])
        out = held[0]
        for df in held[1:]:
            out = out.unionByName(df)
        return out

    def _read(self, segment: dict, name: str, keys: list[str] | None) -> DataFrame | None:
        at, schema = f"{segment['path']}/{name}", self.mark["schemas"][name]
        if name == "notes":
            return self.spark.read.schema(schema).parquet(at)
        there = [b for b in range(segment["buckets"]) if int(segment["has"][name], 16) >> b & 1]
        if keys is not None:
            wanted = self.spark.range(1).select(F.array(*(bucket_of(F.lit(k), segment["buckets"]) for k in keys))).first()[0] if keys else []
            there = sorted({*wanted} & {*there})
        if not there:
            return None
        folders = f"{at}/bucket={{{','.join(map(str, there))}}}" if keys is not None else at
        rows = self.spark.read.schema(schema).option("basePath", at).parquet(folders).drop("bucket")
        return rows.where(F.col(KEYS[name]).isin(keys)) if keys is not None else rows

    def _live(self, rows: DataFrame | None, seq: int) -> DataFrame | None:
        """Without what later commits deleted."""
        later = [d for d in self.mark["deletes"] if d["seq"] > seq]
        if rows is None or not later:
            return rows
        gone = self.spark.read.schema("path string").parquet(*(d["path"] for d in later))
        return rows.join(F.broadcast(gone) if sum(d["rows"] for d in later) <= BROADCAST_PATHS else gone, "path", "left_anti").select(rows.columns)

    # writing
    def _segment(self, tables: dict[str, DataFrame], seq: int, names: list[str]) -> dict:
        """Writes a segment with some of the tables; its number of buckets follows the bytes of its text."""
        path = f"{self.root}/segment-{seq}-{uuid.uuid4().hex}"
        tables["notes"].write.option("compression", "zstd").parquet(f"{path}/notes")
        self.mark["schemas"]["notes"] = _ddl(tables["notes"])
        notes = self.spark.read.schema(self.mark["schemas"]["notes"]).parquet(f"{path}/notes")
        count, size, title, body = notes.agg(F.count("*"), F.sum("bytes"), F.sum("words.title"), F.sum("words.body")).first()
        buckets = min(max(-(-(size or 0) // BUCKET_BYTES), FEWEST), MOST)
        segment = {"path": path, "seq": seq, "rows": count, "bytes": size or 0, "buckets": buckets, "has": {}, "totals": {"docs": count, "title": title or 0, "body": body or 0}}
        return self._filled(segment, tables, names)

    def _filled(self, segment: dict, tables: dict[str, DataFrame], names: list[str]) -> dict:
        """The segment with these tables written into its folders. A try that no commit named may have left some."""
        segment = segment | {"has": dict(segment["has"])}
        for name in names:
            key, at = KEYS[name], f"{segment['path']}/{name}"
            self.mark["schemas"][name] = _ddl(tables[name])
            dealt = tables[name].withColumn("bucket", bucket_of(F.col(key), segment["buckets"])).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", key).write.option("compression", "zstd").mode("overwrite").partitionBy("bucket").parquet(at)
            there = self.spark.read.schema("bucket int").parquet(at).distinct().collect()  # a row a folder
            segment["has"][name] = hex(sum(1 << r[0] for r in there))
        return segment

    def with_tables(self, names: list[str], vault: DataFrame, extract) -> Index:
        """The index with these tables, of a vault that is in the state of the last commit. A segment that lacks
        some gets the rows of its live notes."""
        missing = [name for name in names if name not in self.held]
        if not missing:
            return self
        self.mark = json.loads(json.dumps(self.mark))
        segments = []
        for s in self.mark["segments"]:
            lacking = [name for name in missing if name not in s["has"]]
            alone = len(self.mark["segments"]) == 1 and not self.mark["deletes"]
            texts = vault if alone or not lacking else vault.join(self.rows("notes", segments=[s]).select("path"), "path", "left_semi")
            segments.append(self._filled(s, tables(extract(texts), self.rows("notes", segments=[s])), lacking))
        return self._committed(segments=segments)

    def _committed(self, **told) -> Index:
        """Writes the mark, one file; the index as it is then."""
        mark = self.mark | told | {"commit": self.mark["commit"] + 1}
        self.spark.createDataFrame([(mark["commit"], json.dumps(mark))], "commit long, mark string").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return Index(self.spark, self.root, mark)

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, state: str = "", first: list[str] | None = None) -> Index:
        """The index after a change set: extracted notes (with raw and body) that are new or changed, and
        paths of those that are gone. Only these notes are tokenised. The tables are those of the
        segments before; a first segment gets all of them, or those of ``first``."""
        self.mark = json.loads(json.dumps(self.mark))
        seq, segments, sets, totals = self.mark["commit"] + 1, list(self.mark["segments"]), list(self.mark["deletes"]), dict(self.mark["totals"])
        if upserts is not None:
            segments.append(self._segment(tables(upserts), seq, self.held if segments or first is None else first))
            totals = {k: totals[k] + segments[-1]["totals"][k] for k in totals}
        if self.mark["segments"]:
            # paths of the new segment are read back, not computed again
            fresh = self.spark.read.schema("path string").parquet(f"{segments[-1]['path']}/notes") if upserts is not None else None
            gone = deletes.select("path") if deletes is not None else None
            gone = (fresh if gone is None else gone if fresh is None else gone.union(fresh)).distinct()
            removed = self.rows("notes").select("path", "words").join(gone, "path", "left_semi")
            at = f"{self.root}/deletes-{seq}-{uuid.uuid4().hex}"
            removed.write.parquet(at)
            removed = self.spark.read.schema("path string, words struct<title: bigint, body: bigint>").parquet(at)
            count, title, body = removed.agg(F.count("*"), F.sum("words.title"), F.sum("words.body")).first()
            if count:
                sets.append({"path": at, "seq": seq, "rows": count})
                totals = {"docs": totals["docs"] - count, "title": totals["title"] - title, "body": totals["body"] - body}
        return self._committed(segments=segments, deletes=sets, totals=totals, state=state)

    def synced(self, vault: DataFrame, extract, state: str, first: list[str] | None = None) -> Index:
        """The index of a vault (path, title, folder, mtime, raw) in its present state: notes whose version
        differs from the stored one are extracted and committed. ``first`` as in ``commit``."""
        if self.mark["commit"] and self.mark["state"] == state:
            return self
        if not self.mark["segments"]:
            return self.commit(extract(vault), state=state, first=first)
        known = self.rows("notes").groupBy("path").agg(F.bit_xor("version").alias("was"))
        both = version(vault).join(known, "path", "full_outer")
        changed = both.where("version is not null and (was is null or version != was)").select("path")
        gone = both.where("version is null").select("path")
        return self.commit(extract(vault.join(changed, "path", "left_semi")), gone, state).merged()

    def forked(self, root: str) -> Index:
        """An index of its own at ``root`` that begins with these segments; they are immutable, so they are shared."""
        return Index(self.spark, root, json.loads(json.dumps(self.mark)))._committed()

    def merged(self, fan: int = FAN) -> Index:
        """The index with every ``fan`` segments of about one size in one. What is read is what is merged."""
        tiers: dict[int, list[dict]] = {}
        for s in self.mark["segments"]:
            tiers.setdefault((max(s["bytes"], 1).bit_length() + 2) // 3, []).append(s)
        full = [s for tier in tiers.values() if len(tier) >= fan for s in tier]
        if not full:
            return self
        seq = self.mark["commit"] + 1
        whole = self._segment({name: self.rows(name, segments=full) for name in ("notes", *self.held)}, seq, self.held)
        segments = [s for s in self.mark["segments"] if s not in full] + [whole]
        oldest = min(s["seq"] for s in segments)
        return self._committed(segments=segments, deletes=[d for d in self.mark["deletes"] if d["seq"] > oldest]).merged(fan)

    def vacuum(self) -> None:
        """Removes the folders below the root that the last commit does not name. Readers of an
        earlier commit must be done, and forks need segments that stand elsewhere."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        named = {x["path"].rsplit("/", 1)[-1] for x in self.mark["segments"] + self.mark["deletes"]}
        for f in fs.listStatus(path):
            name = f.getPath().getName()
            if name.startswith(("segment-", "deletes-")) and name not in named:
                fs.delete(f.getPath(), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def tables(notes: DataFrame, named: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a segment holds of extracted notes with their text. Where the same notes are stored without
    text, ``named`` are these, and what needs no text is read from there."""
    count = lambda c: T.n_words(F.col(c)).cast("long")
    words = F.struct(count("title").alias("title"), count("body").alias("body"))
    return {
        "notes": notes.select(*COLUMNS, words.alias("words"), F.octet_length("raw").cast("long").alias("bytes"), F.xxhash64("title", "folder", "mtime", "raw").alias("version")),
        "postings": search.posting_rows(notes),
        "grams": search.inverted_index(notes, named),
        "links": indexes.link_rows(notes if named is None else named),
        "titles": search.title_rows(notes if named is None else named),
    }


def _empty(spark: SparkSession) -> dict[str, str]:
    """The schemas of the tables, of no rows."""
    columns = "path string, title string, folder string, mtime timestamp_ntz, frontmatter string, links array<string>, embeds array<struct<target:string,section:string,kind:string>>, tags array<string>, toc array<struct<level:int,text:string,id:string>>, visible_chars long, raw string, body string"
    return {name: _ddl(df) for name, df in tables(spark.createDataFrame([], columns)).items()}
