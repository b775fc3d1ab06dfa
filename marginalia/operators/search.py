"""Ranked text search over notes (path, title, folder, mtime, tags, body).

An index (``sources.index``) stores the rows of ``postings`` and ``inverted_index``; its tables are
passed to the searches, and a query reads the folders of its own tokens only. Without an index
a search makes the rows it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def tokens(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()))


def ngram_tokens(text: str) -> list[str]:
    """The query side of ``functions.text.ngrams``."""
    import re

    words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split() if len(w.encode()) >= 2]
    runs = re.findall(T.CJK + "+", text)
    return list(dict.fromkeys([*words, *(c for r in runs for c in r), *(r[i : i + 2] for r in runs for i in range(len(r) - 1))]))


#: Notes whose words are sorted at once.
NOTES_AT_ONCE = 256


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of notes as postings: a number for each note and word is sorted, and runs of equal ones are told."""
    for whole in batches:
        for k in range(0, whole.num_rows, NOTES_AT_ONCE):
            batch, before = whole.slice(k, NOTES_AT_ONCE), np.zeros(1, np.int64)
            for field in ("title", "body"):
                words, sizes = batch[field].flatten().dictionary_encode(), batch[field].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(words):
                    note = np.repeat(np.arange(len(sizes)), sizes)
                    place = np.arange(len(words)) + np.repeat(before - (np.cumsum(sizes) - sizes), sizes)
                    key = note * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(key, kind="stable")
                    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                    first, ends = order[starts], np.append(starts, len(key)).astype(np.int32)
                    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
                    columns = [words.dictionary.take(words.indices.take(pa.array(first))), batch["path"].take(pa.array(note[first])), pa.repeat(field, len(first)), pa.array(np.diff(ends).astype(np.int64)), pa.array(sizes[note[first]]), positions]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "path", "field", "tf", "length", "positions"])
                before = sizes


def posting_rows(notes: DataFrame) -> DataFrame:
    """token, path, field, tf, length, positions: one row a token, note and field. Positions count
    from 0 over the words of the title and then the body. All within the note, so nothing is shuffled."""
    words = notes.select("path", T.words(F.col("title")).alias("title"), T.words(F.col("body")).alias("body"))
    return words.mapInArrow(_placed, "token string, path string, field string, tf long, length long, positions array<int>")


def field_means(rows: DataFrame, n_docs: int) -> DataFrame:
    """field, avg_length, n_docs: a row a field."""
    return rows.groupBy("field").agg((F.sum("tf") / F.lit(max(n_docs, 1))).alias("avg_length"), F.lit(n_docs).cast("long").alias("n_docs"))


def postings(notes: DataFrame) -> DataFrame:
    """The rows of ``posting_rows`` with avg_length and n_docs of their field."""
    rows = posting_rows(notes)
    return rows.join(F.broadcast(field_means(rows, notes.count())), "field")


def posting_stats(notes: DataFrame) -> DataFrame:
    """Per field: documents, mean length, distinct tokens."""
    return stats(postings(notes))


def stats(index: DataFrame) -> DataFrame:
    return index.groupBy("field").agg(F.max("n_docs").alias("n_docs"), F.round(F.max("avg_length"), 6).alias("avg_length"), F.countDistinct("token").alias("n_tokens"))


def inverted_index(notes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """path, field and n-gram token, one row each. Where the same notes are stored without text, ``named``
    are these: titles and tags are read from there, not extracted from the text again."""
    f = lambda name, col: F.struct(F.lit(name).alias("field"), F.array_distinct(col).alias("w"))
    rows = lambda df, *fields: df.select("path", F.inline(F.array(*fields))).select("path", "field", F.explode("w").alias("token"))
    names, content = [f("title", T.ngrams(F.col("title"))), f("tag", F.transform("tags", F.lower))], f("content", T.ngrams(F.col("body")))
    return rows(notes, *names, content) if named is None else rows(named, *names).unionByName(rows(notes, content))


def of_tokens(index, wanted: list[str]) -> DataFrame:
    """The rows of these tokens; of a stored index only their folders are read."""
    return index.of(wanted) if hasattr(index, "of") else index.where(F.col("token").isin(wanted))


def bm25(index: DataFrame, query: str) -> DataFrame:
    """path and score of every note that has a query token; fields are added."""
    hits = of_tokens(index, tokens(query))
    seen = hits.groupBy("token", "field").agg(F.count("*").alias("df"))  # a row for each query token and field
    hits = hits.join(F.broadcast(seen), ["token", "field"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return hits.groupBy("path").agg(F.sum(part).alias("score"))


def bm25_search(notes: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    best = bm25(index if index is not None else postings(notes), query).withColumn("score", F.round("score", 6))
    return best.orderBy(F.desc("score"), "path").limit(limit)


def search_filtered(notes: DataFrame, query: str, kept: DataFrame, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Search with the notes that a filter kept; an empty query matches all of them."""
    if not tokens(query):
        return kept.select("path", F.lit(0.0).alias("score")).orderBy("path").limit(limit)
    found = bm25(index if index is not None else postings(notes), query).join(kept.select("path"), "path", "left_semi")
    return found.select("path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def phrase_words(text: str) -> list[str]:
    """All words in order, repeats kept."""
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def search_bool(notes: DataFrame, must: list[str] = (), should: list[str] = (), must_not: list[str] = (), phrase: str = "", index=None) -> DataFrame:
    """Paths that satisfy token conditions on title and body; ``phrase`` stands in order.

    Read from postings alone. Clauses are sets of paths: a note's postings of the query's tokens meet
    in one row. A phrase stands where the positions of its words, each moved back by its place
    in the phrase, have one in common. Only where every clause is a negative one, notes are
    read, for their paths."""
    must, should, must_not = ([t.lower() for t in ts] for ts in (must, should, must_not))
    words = phrase_words(phrase)
    wanted = list(dict.fromkeys([*must, *should, *must_not, *words]))
    if not wanted:
        return notes.select("path")
    rows = of_tokens(index if index is not None else posting_rows(notes), wanted)
    has = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}
    held = {t: F.col(f"p{i}") for i, t in enumerate(dict.fromkeys(words))}
    flags = [F.bool_or(F.col("token") == t).alias(f"t{i}") for i, t in enumerate(wanted)]
    lists = [F.flatten(F.collect_list(F.when(F.col("token") == t, F.col("positions")))).alias(f"p{i}") for i, t in enumerate(held)]
    found = rows.groupBy("path").agg(*flags, *lists)
    for t in [*must, *words]:
        found = found.where(has[t])
    for t in must_not:
        found = found.where(~has[t])
    if should:
        any_of = F.lit(False)
        for t in should:
            any_of = any_of | has[t]
        found = found.where(any_of)
    if len(words) > 1:
        moved = lambda positions, k: F.transform(positions, lambda p: p - k)
        starts = held[words[0]]
        for k, t in enumerate(words[1:], 1):
            starts = F.array_intersect(starts, moved(held[t], k))
        found = found.where(F.size(starts) > 0)
    if must or should or words:
        return found.select("path")
    return notes.select("path").join(rows.select("path"), "path", "left_anti")


def search_page(notes: DataFrame, query: str, page: int = 1, per_page: int = 20, sort: str = "relevance", index: DataFrame | None = None) -> DataFrame:
    """One page of results with total and total_pages on each row. Hits are scored once: the
    count and the page read the same shuffle. Times are looked up for the best alone."""
    per_page, page = min(max(per_page, 1), 100), min(max(page, 1), 10_000)
    lo = (page - 1) * per_page
    found = bm25(index if index is not None else postings(notes), query).withColumn("score", F.round("score", 6))
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy(F.desc("score"), "path").limit(max(lo + per_page, 5000) if sort == "modified" else lo + per_page)
    top = top.join(notes.select("path", "mtime"), "path") if sort == "modified" else top
    order = [F.desc("mtime"), F.col("path")] if sort == "modified" else [F.desc("score"), F.col("path")]
    n = F.row_number().over(Window.orderBy(*order))  # over the limited rows alone
    paged = top.withColumn("n", n).where((F.col("n") > lo) & (F.col("n") <= lo + per_page))
    total = total.withColumn("total_pages", F.ceil(F.col("total") / per_page))
    return paged.join(F.broadcast(total), F.lit(True)).select("n", "path", "score", "total", "total_pages")


def search_sorted_modified(notes: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    best = bm25_search(notes, query, limit, index)
    return best.join(notes.select("path", "mtime"), "path").orderBy(F.desc("mtime"), "path")


def search_snippets(notes: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """The best notes with snippets, cut only for those that are returned."""
    best = bm25_search(notes, query, limit, index)
    return best.join(notes.select("path", "body"), "path").select("path", "score", T.snippet(F.col("body"), query).alias("snippet"))


#: Characters of a title's parts that are stored.
PART = 32


def _without_one(word: str) -> list[str]:
    """A word and what is left of it without one character."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def title_rows(notes: DataFrame) -> DataFrame:
    """key, value, place, path, title: what titles are found by. Under ``n:`` stand a token and its shorter
    forms by one character (words within one edit share one), under ``p:`` and its first character
    every end of the title, so that a part of a title is the beginning of an end."""
    title = F.lower("title")
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    near = lambda t: F.transform(F.array_union(F.array(t), shorter(t)), lambda k: F.struct(F.concat(F.lit("n:"), k).alias("key"), t.alias("value"), F.lit(-1).alias("place")))
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(title), F.lit(1))), lambda i: i <= F.length(title)), lambda i: F.struct(F.concat(F.lit("p:"), F.substring(title, i, F.lit(1))).alias("key"), F.substring(title, i, F.lit(PART)).alias("value"), (i - 1).alias("place")))
    return notes.select("path", "title", F.inline(F.concat(F.flatten(F.transform(F.array_distinct(T.words(F.col("title"))), near)), ends))).select("key", "value", "place", "path", "title")


def _of_keys(index, notes: DataFrame, keys: list[str]) -> DataFrame:
    return index.of(keys) if index is not None else title_rows(notes).where(F.col("key").isin(keys))


def _containing(notes: DataFrame, query: str, index) -> DataFrame:
    """path, title and place of the query, in lower case, in titles that have it."""
    found = _of_keys(index, notes, [f"p:{query[0]}"]).where(F.col("value").startswith(query[:PART]) & F.lower("title").contains(query))
    return found.groupBy("path", "title").agg(F.min("place").alias("place"))


def fuzzy_suggest(notes: DataFrame, query: str, limit: int = 10, index=None) -> DataFrame:
    """Titles with a token within one edit (a swap of neighbours counts as one) of a query word. The
    tokens that share a form with a query word are read, and verified by distance."""
    keys = [f"n:{k}" for w in tokens(query) for k in _without_one(w)]
    rows = _of_keys(index, notes, keys).select("path", "title", F.col("value").alias("token")).distinct()
    near = F.lit(0)
    for w in tokens(query):
        swaps = sorted({w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)} - {w})
        hit = F.levenshtein(F.col("token"), F.lit(w)) <= 1
        hit = hit | F.col("token").isin(swaps) if swaps else hit
        near = near + F.when(F.col("token") == w, 2).when(hit, 1).otherwise(0)
    found = rows.withColumn("score", near).where("score > 0").groupBy("path", "title").agg(F.sum("score").cast("long").alias("score"))
    return found.orderBy(F.desc("score"), "title", "path").limit(limit)


def suggest(notes: DataFrame, query: str, limit: int = 10, index=None) -> DataFrame:
    """Title prefix, then title part, then fuzzy; one row a path. An empty query begins every title."""
    q = query.lower()
    titled = _containing(notes, q, index) if q else notes.select("path", "title", F.lit(0).alias("place"))
    titled = titled.select("path", "title", F.when(F.col("place") == 0, 1).otherwise(2).alias("tier"))
    near = fuzzy_suggest(notes, query, 20, index).select("path", "title", F.lit(3).alias("tier"))
    return titled.unionByName(near).groupBy("path", "title").agg(F.min("tier").alias("tier")).orderBy("tier", "title", "path").limit(min(limit, 20))


def ngram_search(notes: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """The eight rarest query tokens; title 10 (a pair of ideographs 15), tag 5, content 1."""
    wanted = ngram_tokens(query)
    hits = of_tokens(index if index is not None else inverted_index(notes), wanted)
    rare = hits.groupBy("token").agg(F.count("*").alias("n")).orderBy("n", "token").limit(8)
    pair = F.col("token").rlike(f"^{T.CJK}{T.CJK}$")
    worth = F.when(F.col("field") == "title", F.when(pair, 15).otherwise(10)).when(F.col("field") == "tag", 5).otherwise(1)
    found = hits.join(F.broadcast(rare.select("token")), "token", "left_semi").groupBy("path").agg(F.sum(worth).cast("long").alias("score"))
    return found.join(notes.select("path", "mtime"), "path").orderBy(F.desc("score"), F.desc("mtime"), "path").limit(limit)


def complete(notes: DataFrame, query: str, index=None) -> DataFrame:
    """Titles and tags that contain the query; prefix hits first. Tags are read from the notes."""
    q = query.lower().lstrip("#")
    by = lambda c: [F.when(F.lower(c).startswith(q), 0).otherwise(1), F.col(c)]
    titles = _containing(notes, q, index).select("title") if q else notes.select("title")
    titles = titles.distinct().orderBy(*by("title")).limit(5)
    tags = notes.select(F.explode("tags").alias("tag")).distinct().where(F.lower("tag").contains(q)).orderBy(*by("tag")).limit(4 if query.startswith("#") else 3)
    return titles.select(F.lit("title").alias("kind"), F.col("title").alias("name")).union(tags.select(F.lit("tag"), "tag"))
