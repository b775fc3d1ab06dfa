"""Operator 13: audit of how the sources of a language differ in their terms.

Terms are shuffled under a 64-bit digest, not under their text. The text is read once for the counts:
a task counts its own terms in a bounded table, and rows of (lang, source, digest,
count, documents), all of fixed width but the two names, are summed over the corpus, then
gathered by (lang, digest), a list of sources for each; those in ``min_docs`` documents of a language or more may be kept. It is read
again for the texts of these digests alone: each digest's smallest and greatest term. Where they
differ, several terms share the digest; these digests are split, counted once more under the terms
themselves. All other digests stand for one term, and its text is joined only to
the rows of the report that name it.

Pairs of sources are compared term by term over all kept terms, also those a source lacks. The
kept terms of a language are dealt into blocks; a block meets the list of the language's sources,
and numpy sums the block's divergences of every two sources, so rows are terms with their sources and sums
of pairs, never pairs for each term. A language's whole report has a row for every two sources by
contract. The best terms of a group are found in two steps: the value at the last rank first, then
texts for the terms at or above it, so ties are told apart by text without joining all texts.

Null text, lang and source count as empty. Groups without a kept term have all shares equal.
Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are
ignored. Shares are exact: what could pass 64 bits is computed as decimals or Python integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only_a_z_lower, split_words, table, written

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms in a block that numpy compares at once.
BLOCK_TERMS = 1000
#: Digests that are broadcast to the second reading; more are joined by a shuffle.
BROADCAST_DIGESTS = 2_000_000
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on bytes: letters in lower case, bytes of other characters as they are, blanks for the rest.
TO_TERMS = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it tells their counts.
HELD = 400_000
RESULT = "lang string, source string, part string, item string, value long, rank int"


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text, none of them null."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def digest(term: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 64 - bits) if bits < 64 else F.xxhash64(term)


def _digests(words: list[bytes], bits: int) -> pa.Array:
    """What ``digest`` gives."""
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    return pa.array((h >> np.uint64(64 - bits) if bits < 64 else h).view(np.int64))


def _words(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(TO_TERMS).split()


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """lang, source and text, a few at a time."""
    for batch in batches:
        for k in range(0, len(batch), 64):
            part = batch.slice(k, 64)
            yield from zip(*(part[c].to_pylist() for c in ("lang", "source", "text")), strict=True)


def counted(docs: DataFrame, bits: int) -> DataFrame:
    """lang, source, key, n and df: a task counts its texts in a table of ``HELD`` terms at most, told
    and emptied when it is full; then the counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                n = np.array([v >> 32 for v in found.values()], np.int64)
                df = np.array([v & 0xFFFFFFFF for v in found.values()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), _digests(list(found), bits), pa.array(n), pa.array(df)], ["lang", "source", "key", "n", "df"])
            held.clear()

        size = 0
        for lang, source, text in _text_rows(batches):
            found = held.setdefault((lang, source), {})
            size -= len(found)
            get = found.get
            for word, n in Counter(_words(text)).items():
                found[word] = get(word, 0) + (n << 32) + 1
            size += len(found)
            if size > HELD:
                yield from told()
                size = 0
        yield from told()

    return docs.mapInArrow(run, "lang string, source string, key long, n long, df long").groupBy("lang", "source", "key").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def spoken(docs: DataFrame, bits: int) -> DataFrame:
    """key and t: the digest and text of every term, once for every ``HELD`` that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([_digests(part, bits), pa.array(part, pa.binary()).cast(pa.string())], ["key", "t"])
            held.clear()

        for _, _, text in _text_rows(batches):
            held.update(_words(text))
            if len(held) > HELD:
                yield from told()
        yield from told()

    return docs.mapInArrow(run, "key long, t string")


def gathered(counts: DataFrame, name: str, min_docs: int) -> DataFrame:
    """lang, ``name``, n in the language, and by: the count of each source, for what is in enough documents."""
    whole = counts.groupBy("lang", name).agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("by"))
    return whole.where(F.col("df") >= min_docs).drop("df")


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The kept terms, (lang, key, term, n, by), where term is null if the digest ``key`` alone tells it;
    and the texts of those, (key, text)."""
    docs = named(docs)
    kept = written(gathered(counted(docs, bits), "key", min_docs))
    wanted = kept.select("key").distinct()
    wanted = F.broadcast(wanted) if kept.count() <= BROADCAST_DIGESTS else wanted
    texts = written(spoken(docs, bits).join(wanted, "key", "left_semi").groupBy("key").agg(F.min("t").alias("text"), F.max("t").alias("other")))
    shared = texts.where("text != other").select("key")
    alone = kept.join(shared, "key", "left_anti").select("lang", "key", F.lit(None).cast("string").alias("term"), "n", "by")
    if not shared.isEmpty():
        said = docs.select("lang", "source", split_words(only_a_z_lower(F.col("text")), NOT_LETTERS).alias("w"))
        again = said.select("lang", "source", F.explode("w").alias("term")).withColumn("key", digest(F.col("term"), bits)).join(shared, "key", "left_semi")
        again = gathered(again.groupBy("lang", "source", "term").agg(F.count("*").alias("n")).withColumn("df", F.lit(0).cast("long")), "term", 0)
        found = said.select("lang", F.explode(F.array_distinct("w")).alias("term")).withColumn("key", digest(F.col("term"), bits)).join(shared, "key", "left_semi")
        often = found.groupBy("lang", "term").agg(F.count("*").alias("df"), F.first("key").alias("key")).where(F.col("df") >= min_docs).drop("df")
        alone = written(alone.unionByName(again.join(often, ["lang", "term"]).select("lang", "key", "term", "n", "by")))
    return alone, texts.where("text = other").select("key", "text")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + F.when(n < 4_000_000_000, div((n + 2) * SCALE, total + 2 * v)).otherwise(div(wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * v)))


def _shares(n: np.ndarray, total: int, v: int) -> np.ndarray:
    n = n if n.size == 0 or int(n.max()) < 4_000_000_000 else n.astype(object)
    return (1 + (n + 2) * SCALE // (total + 2 * v)).astype(np.int64)


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the divergence of every two sources of a language (a < b), summed over
    all kept terms. ``groups``: lang, source, total, v, of every source."""
    blocks = F.greatest(F.ceil(F.col("v") / BLOCK_TERMS), F.lit(1)).cast("int")
    sizes = groups.groupBy("lang").agg(F.first("v").alias("v")).select("lang", blocks.alias("blocks"))
    h = F.xxhash64("key", "term")
    dealt = kept.join(sizes, "lang").select("lang", F.pmod(h, F.col("blocks")).cast("int").alias("block"), "by")
    listed = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def compare(terms: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        names = groups["source"].to_pylist()
        totals, v = groups["total"].to_pylist(), groups["v"][0].as_py() if len(names) else 0
        place = {s: k for k, s in enumerate(names)}
        by = terms["by"].combine_chunks()
        row = np.repeat(np.arange(len(terms)), by.value_lengths().to_numpy(zero_copy_only=False))
        held = by.flatten()
        counts = np.zeros((len(names), len(terms)), np.int64)
        counts[np.array([place[s] for s in held.field("source").to_pylist()], np.int64), row] = held.field("n").to_numpy(zero_copy_only=False)
        p = np.stack([_shares(counts[k], totals[k], v) for k in range(len(names))]) if names else np.zeros((0, 0), np.int64)
        left, right, value = [], [], []
        for k in range(len(names) - 1):
            d, s = p[k + 1 :] - p[k], p[k + 1 :] + p[k]
            value.append((d * d // s).sum(axis=1))
            left.append(np.full(len(names) - 1 - k, k))
            right.append(np.arange(k + 1, len(names)))
        take = lambda at: pa.array(names, pa.string()).take(pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)))
        lang = groups["lang"][0].as_py() if len(names) else None
        value = pa.array(np.concatenate([*value, np.zeros(0, np.int64)]).astype(np.int64))
        return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "a": take(left), "b": take(right), "value": value})

    keys = ["lang", "block"]
    parts = dealt.groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInArrow(compare, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows tell how far every other source of the
    language is, ``term`` rows the source's ``top`` terms above the language's share."""
    kept, texts = vocabulary(docs, min_docs, bits)
    groups = named(docs).select("lang", "source").distinct()
    each = kept.select("lang", "key", "term", F.col("n").alias("in_lang"), F.inline("by"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = written(groups)

    pairs = pair_sums(kept, groups)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    scored = each.join(groups, ["lang", "source"]).select("lang", "source", "key", "term", p.alias("p"), q.alias("q")).where("p > q")
    scored = scored.select("lang", "source", "key", "term", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    some = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    cut = scored.withColumn("at", F.row_number().over(some)).where(F.col("at") <= top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    told = scored.join(cut, ["lang", "source"]).where("value >= least").join(texts, "key", "left").withColumn("item", F.coalesce("term", "text"))
    told = told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(told)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def oracle() -> str:
    p = lambda n, total: f"(1 + ({SCALE}::hugeint * ({n} + 2)) // ({total} + 2 * v))"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
    with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
    w as (select r, lang, source, unnest(ws) as term from d),
    kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= {MIN_DOCS}),
    sizes as (select l.lang, count(term) as v, coalesce(sum(n), 0) as lang_total from (select distinct lang from d) l left join kept using (lang) group by l.lang),
    grid as (select g.lang, g.source, k.term, k.n as in_lang, coalesce(c.n, 0) as n from (select distinct lang, source from d) g join kept k using (lang)
      left join (select lang, source, term, count(*) as n from w group by all) c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    totals as (select lang, source, sum(n) as total from grid group by all),
    shares as (select lang, source, term, n, {p('n', 'total')} as p, {p('in_lang', 'lang_total')} as q from grid join totals using (lang, source) join sizes using (lang)),
    sums as (select lang, a.source, b.source as item, sum({f.replace('p', 'a.p').replace('q', 'b.p')}) as value from shares a join shares b using (lang, term) where a.source <> b.source group by all),
    groups as (select distinct lang, source from d),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    best as (select lang, source, 'term' as part, term as item, ({f})::bigint as value from shares where n > 0 and p > q)
    select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
    union all select * from (select *, (row_number() over (partition by lang, source order by value desc, item))::int as rank from best) where rank <= {TOP}
    """
