"""Queries of ranked text search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, search
from ..sources.vault import derived_vault, notes
from .base import Queries, over_notes

Q = Queries()
QUERY = "the print doc part"
SCORED = lambda df: df.select("path", "score")
WORDS = "list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
POSTINGS = f"""
field_words as (select path, 'title' as field, {WORDS.format(t='title')} as w from notes union all select path, 'body', {WORDS.format(t='body')} from notes),
means as (select field, avg(len(w)) as avg_length, count(*) as n_docs from field_words group by field),
postings as (select token, path, field, length, count(*) as tf from (select path, field, len(w) as length, unnest(w) as token from field_words) group by all)"""


def _bm25(query: str) -> str:
    wanted = ", ".join(f"'{t}'" for t in search.tokens(query))
    return f"""{POSTINGS},
seen as (select token, field, count(*) as df from postings where token in ({wanted}) group by all),
scored as (select path, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * ({search.K1} + 1) / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / avg_length))) as raw
  from postings join seen using (token, field) join means using (field) group by path),
found as (select path, round(raw, 6) as score from scored)"""


BM25 = _bm25(QUERY)
BEST = "best as (select * from found order by score desc, path limit 10)"

Q.on_corpus("complete_titles", lambda c: search.complete(c.notes, "Solo", index=c.titles), "select * from (select 'title' as kind, title as name from (select distinct title from notes) where contains(lower(title), 'solo') order by case when starts_with(lower(title), 'solo') then 0 else 1 end, title limit 5) union all select * from (select 'tag', tag from (select distinct tag from tag_rows) where contains(lower(tag), 'solo') order by case when starts_with(lower(tag), 'solo') then 0 else 1 end, tag limit 3)")

# the stored index after change sets: some notes get words, some go
CHANGED = "select * exclude (raw), case when length(raw) % 50 < 3 then raw || ' fresh zebra text' else raw end as raw from was where length(raw) % 50 <> 3"


def _changed(c):
    """The index of the corpus after three small change sets."""
    index, length = c.having("postings").forked(f"{c.root}-{uuid.uuid4().hex}"), F.length("raw") % 50
    vault = derived_vault(c.spark, c.sf_dir)
    for k in range(3):
        grown = vault.where(length == k).withColumn("raw", F.concat("raw", F.lit(" fresh zebra text")))
        index = index.commit(notes(grown), vault.where(length == 3).select("path") if k == 1 else None)
    return index


def _counts(index):
    told = index.postings.all().groupBy("field").agg(F.max("n_docs").alias("n_docs"), F.round(F.max("avg_length"), 6).alias("avg_length"), F.countDistinct("token").alias("n_tokens"), F.count("*").alias("n"), F.sum("tf").alias("words"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("places"))
    return told


Q.on_corpus("index_search_after_changes", lambda c: search.bm25_search(c.notes, "fresh zebra doc", index=_changed(c).postings))
Q.oracles["index_search_after_changes"] = over_notes("select path, score from best", _bm25("fresh zebra doc"), BEST, vault=CHANGED)
Q.on_corpus("index_merge", lambda c: _counts(_changed(c).merged(2)))
Q.oracles["index_merge"] = over_notes(
    f"""select field, max(n_docs) as n_docs, round(max(avg_length), 6) as avg_length, count(distinct token) as n_tokens, count(*) as n, sum(tf)::bigint as words, max(places)::bigint as places from postings join means using (field)
    join (select field, sum(len(w) * (len(w) - 1) // 2 + case field when 'body' then n * len(w) else 0 end) as places from (select *, len({WORDS.format(t='title')}) as n from (select path, title, field, w from field_words join notes using (path))) group by field) using (field) group by field""",
    POSTINGS, vault=CHANGED,
)
Q.on_notes("tokenize_simple", lambda n: n.select("path", F.size(T.words(F.col("body"))).alias("n"), F.md5(F.array_join(T.words(F.col("body")), " ")).alias("tokens")), f"select path, len(w)::int as n, md5(array_to_string(w, ' ')) as tokens from (select path, {WORDS.format(t='body')} as w from notes)")
Q.on_notes("tokenize_ngram", lambda n: n.select("path", F.md5(F.array_join(T.ngrams(F.col("body")), " ")).alias("tokens")), f"select path, md5(array_to_string(list_filter({WORDS.format(t='body')}, lambda x: strlen(x) >= 2), ' ')) as tokens from notes")
NGRAMS = f"""grams as (select distinct path, 'title' as field, unnest(list_filter({WORDS.format(t='title')}, lambda x: strlen(x) >= 2)) as token from notes union all
  select distinct path, 'tag', lower(tag) from tag_rows union all select distinct path, 'content', unnest(list_filter({WORDS.format(t='body')}, lambda x: strlen(x) >= 2)) from notes)"""
Q.on_corpus("inverted_index", lambda c: c.grams.all().groupBy("token", "field").agg(F.count("*").alias("n")), "select token, field, count(*) as n from grams group by all", NGRAMS)
Q.on_corpus("posting_stats", lambda c: search.stats(c.postings.all()), "select field, n_docs, round(avg_length, 6) as avg_length, (select count(distinct token) from postings p where p.field = means.field) as n_tokens from means", POSTINGS)
Q.on_corpus("bm25_search", lambda c: search.bm25_search(c.notes, QUERY, index=c.postings), "select path, score from best", BM25, BEST)
FILTER = "list_has_any(tags, ['en']) and starts_with(folder, 'src') and mtime >= timestamp '2023-01-01'"


def _filtered(c):
    kept = filters.mtime_between(filters.any_tag(c.notes, "en"), "2023-01-01 00:00:00").where(F.col("folder").startswith("src"))
    return search.search_filtered(c.notes, QUERY, kept, index=c.postings)


Q.on_corpus("search_filtered", _filtered, f"select path, score from found where path in (select path from notes where {FILTER}) order by score desc, path limit 10", BM25)
TEXT = f"(select path, {WORDS.format(t='(title || chr(32) || body)')} as w from notes)"
SPOKEN = f"(select path, ' ' || array_to_string(w, ' ') || ' ' as w from {TEXT})"
Q.on_corpus(
    "search_bool", lambda c: search.search_bool(c.notes, must=["the"], should=["marked", "print"], must_not=["mit"], phrase="doc", index=c.postings),
    f"select path from {TEXT} where list_contains(w, 'the') and list_has_any(w, ['marked', 'print']) and not list_contains(w, 'mit') and list_contains(w, 'doc')",
)
Q.on_corpus("search_bool_not", lambda c: search.search_bool(c.notes, must_not=["the", "der"], index=c.postings), f"select path from {TEXT} where not list_has_any(w, ['the', 'der'])")
Q.on_corpus("search_phrase", lambda c: search.search_bool(c.notes, phrase="so marked and", index=c.postings), f"select path from {SPOKEN} where contains(w, ' so marked and ')")
Q.on_corpus("search_phrase_repeats", lambda c: search.search_bool(c.notes, must_not=["t3"], phrase="doc 12 doc 12", index=c.postings), f"select path from {SPOKEN} where contains(w, ' doc 12 doc 12 ') and not contains(w, ' t3 ')")
PAGE = "select n::int as n, path, score, (select count(*) from found) as total, ceil((select count(*) from found) / 15)::bigint as total_pages from ({}) where n > 15 and n <= 30"
Q.on_corpus("search_page", lambda c: search.search_page(c.notes, QUERY, 2, 15, index=c.postings), PAGE.format("select *, row_number() over (order by score desc, path) as n from found"), BM25)
Q.on_corpus("search_page_modified", lambda c: search.search_page(c.notes, QUERY, 2, 15, "modified", c.postings), PAGE.format("select path, score, row_number() over (order by mtime desc, path) as n from (select * from found order by score desc, path limit 5000) join (select path, mtime from notes) using (path)"), BM25)
Q.on_corpus("search_sorted_modified", lambda c: search.search_sorted_modified(c.notes, QUERY, index=c.postings), "select path, score, mtime from best join (select path, mtime from notes) using (path)", BM25, BEST)
FLAT = "trim(regexp_replace(body, '\\s+', ' ', 'g'))"
SNIPPET = f"""select path, case when p > 0 then regexp_replace(case when s > 1 then '...' else '' end || substr(f, s, e - s + 1) || case when e < length(f) then '...' else '' end, '(?i)(so ==marked)', '<mark>\\1</mark>', 'g')
  else substr(f, 1, 150) || case when length(f) > 150 then '...' else '' end end as snippet
  from (select path, f, p, greatest(p - 50, 1) as s, least(p + 10 + 100, length(f)) as e from (select path, {FLAT} as f, strpos(lower({FLAT}), 'so ==marked') as p from notes))"""
Q.on_notes("snippet", lambda n: n.select("path", T.snippet(F.col("body"), "so ==marked").alias("snippet")), SNIPPET)
Q.on_corpus("search_snippets", lambda c: search.search_snippets(c.whole, "print", index=c.postings), f"select path, score, snippet from best join ({SNIPPET.replace('so ==marked', 'print').replace('p + 10 + 100', 'p + 4 + 100')}) using (path)", _bm25("print"), BEST)
Q.on_notes("highlight", lambda n: n.select("path", F.md5(T.highlight(F.col("body"), "The")).alias("marked")), "select path, md5(regexp_replace(body, '(?i)(The)', '<mark>\\1</mark>', 'g')) as marked from notes")
TITLE_TOKENS = f"tt as (select distinct path, title, unnest({WORDS.format(t='title')}) as token from notes)"
Q.on_corpus("fuzzy_suggest", lambda c: search.fuzzy_suggest(c.notes, "dco 12", index=c.titles), "select path, title, sum(s)::bigint as score from (select path, title, case when token = 'dco' then 2 when damerau_levenshtein(token, 'dco') <= 1 then 1 else 0 end + case when token = '12' then 2 when damerau_levenshtein(token, '12') <= 1 then 1 else 0 end as s from tt) where s > 0 group by 1, 2 order by score desc, title, path limit 10", TITLE_TOKENS)
Q.on_corpus(
    "suggest", lambda c: search.suggest(c.notes, "Doc 11", index=c.titles),
    "select path, title, min(tier)::int as tier from (select path, title, case when starts_with(lower(title), 'doc 11') then 1 else 2 end as tier from notes where contains(lower(title), 'doc 11') union all select path, title, 3 from (select path, title, sum(s) as score from (select path, title, case when token = 'doc' then 2 when damerau_levenshtein(token, 'doc') <= 1 then 1 else 0 end + case when token = '11' then 2 when damerau_levenshtein(token, '11') <= 1 then 1 else 0 end as s from tt) where s > 0 group by 1, 2 order by score desc, title, path limit 20)) group by 1, 2 order by tier, title, path limit 10",
    TITLE_TOKENS,
)
NQ = ", ".join(f"'{t}'" for t in search.ngram_tokens(QUERY + " en 12"))
Q.on_corpus(
    "ngram_search", lambda c: search.ngram_search(c.notes, QUERY + " en 12", index=c.grams).select("path", "score"),
    f"select path, score from (select path, sum(case field when 'title' then 10 when 'tag' then 5 else 1 end)::bigint as score from grams where token in (select token from rare) group by path) join (select path, mtime from notes) using (path) order by score desc, mtime desc, path limit 10",
    NGRAMS, f"rare as (select token, count(*) as n from grams where token in ({NQ}) group by token order by n, token limit 8)",
)
Q.on_notes("ngram_snippet", lambda n: n.select("path", T.ngram_snippet(F.col("body"), ["part", "marked"]).alias("snippet")), "select path, case when s > 1 then '...' else '' end || substr(body, s, 150) || case when s + 149 < length(body) then '...' else '' end as snippet from (select path, body, greatest(coalesce(least(nullif(strpos(lower(body), 'part'), 0), nullif(strpos(lower(body), 'marked'), 0)), 1) - 30, 1) as s from notes)")
Q.on_corpus("complete", lambda c: search.complete(c.notes, "#t1", index=c.titles), "select * from (select 'title' as kind, title as name from (select distinct title from notes) where contains(lower(title), 't1') order by case when starts_with(lower(title), 't1') then 0 else 1 end, title limit 5) union all select * from (select 'tag', tag from (select distinct tag from tag_rows) where contains(lower(tag), 't1') order by case when starts_with(lower(tag), 't1') then 0 else 1 end, tag limit 4)")
