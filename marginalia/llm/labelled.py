"""Bounded labelled windows for the byte networks, and scoring by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytecnn import WINDOW, ByteCNN, starts_of
from .common import small_batches


def id_remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def _cut(batches: Iterator[pa.RecordBatch], per_doc: int) -> Iterator[pa.RecordBatch]:
    """Up to ``per_doc`` windows of a text, spread evenly over all of it."""
    for batch in batches:
        labels, windows = [], []
        for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
            b = (text or "").encode()
            at = starts_of(len(b))
            for k in np.unique(np.linspace(0, len(at) - 1, min(per_doc, len(at))).astype(int)) if len(at) else []:
                labels.append(label)
                windows.append(b[at[k] : at[k] + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(windows, pa.binary())], ["label", "window"])


def sample_ids(ids: DataFrame, per_label: int) -> DataFrame:
    """doc_id and label of at most ``per_label`` rows of each label, those with the smallest
    hash of their id. A cut by hash leaves about twice that many before they are ranked."""
    ids = ids.where("label is not null and doc_id is not null").distinct()
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}  # a row a label
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    rate = F.lit(1.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, min(1.0, (2 * per_label + 100) / n)).otherwise(rate)
    order = Window.partitionBy("label").orderBy(u, "doc_id")
    return ids.where(u <= rate).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).select("doc_id", "label")


def train(docs: DataFrame, ids: DataFrame, per_label: int = 1200, per_doc: int = 4) -> ByteCNN | None:
    """A network fitted to a bounded sample: ``per_label`` documents of each label and
    ``per_doc`` windows of each. None without labels. ``docs`` has doc_id and text; ``ids``
    has doc_id and label, and only rows that may be learned from."""
    chosen = sample_ids(ids.select("doc_id", F.col("label").cast("string").alias("label")), per_label)
    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most per_label rows a label
    rows = sorted(sample.mapInArrow(lambda it: _cut(it, per_doc), "label string, window binary").collect(), key=lambda r: (r["label"], bytes(r["window"])))
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return None
    return ByteCNN(labels).fit([bytes(r["window"]) for r in rows], [labels.index(r["label"]) for r in rows])


def score(docs: DataFrame, model: ByteCNN, name: str = "probabilities") -> DataFrame:
    """The same rows with the label probabilities of the whole text, in place of a column of that name."""
    docs = docs.drop(name)
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.documents((t or "").encode() for t in batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tolist() for p in found], pa.list_(pa.float64()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{kinds}, {name} array<double>")
