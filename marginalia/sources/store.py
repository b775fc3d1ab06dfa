"""The stored index of an input: built once, opened by every session after, and brought up to date
where the input's files have changed. It stands in the session's shared folder."""

from __future__ import annotations

import hashlib
import threading
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .index import FORMAT, Index, Table
from .vault import DERIVED, derived_vault, notes

_writing = threading.RLock()


def state(spark: SparkSession, path: str) -> str:
    """What tells one state of the files at ``path`` from another, by their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return "|".join(map(str, files.agg(F.count("*"), F.sum("length"), F.max("at"), F.bit_xor(F.xxhash64("path", "length", "at"))).first()))


class Corpus:
    """The notes of an input, and the stored index over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def root(self) -> str:
        """One folder for each input and way of making notes of it."""
        return f"{shared_folder(self.spark)}/marginalia-index-{FORMAT}-{hashlib.md5((self.sf_dir + DERIVED).encode()).hexdigest()}"

    @cached_property
    def index(self) -> Index:
        now = state(self.spark, f"{self.sf_dir}/documents.parquet")
        with _writing:
            index = Index.open(self.spark, self.root)
            try:
                if index.mark["segments"]:
                    _ = index.notes  # raises where a segment's folder was cleared since
                return index.synced(derived_vault(self.spark, self.sf_dir), notes, now, first=[])
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            fresh = Index(self.spark, self.root)
            fresh.mark["commit"] = index.mark["commit"]
            return fresh.commit(self.whole, state=now, first=[])

    def having(self, *names: str) -> Index:
        """The index with these tables, which are written when they are first asked for."""
        with _writing:
            self.index = self.index.with_tables(list(names), derived_vault(self.spark, self.sf_dir), notes)
        return self.index

    @cached_property
    def whole(self) -> DataFrame:
        """Notes with raw text and body, extracted as they are read."""
        return notes(derived_vault(self.spark, self.sf_dir))

    @property
    def notes(self) -> DataFrame:
        """Extracted notes, without text."""
        return self.index.notes

    @property
    def postings(self) -> Table:
        """Words of titles and bodies, with their positions."""
        return self.having("postings").postings

    @property
    def grams(self) -> Table:
        """n-gram tokens of titles, tags and bodies."""
        return self.having("grams").grams

    @property
    def titles(self) -> Table:
        """What titles are found by."""
        return self.having("titles").titles
