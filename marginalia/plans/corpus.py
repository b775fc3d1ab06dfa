"""Queries of filters, indexes, joins and reports over notes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters, indexes, insights
from .base import AS_OF, Queries, over_notes

Q = Queries()
PATH = lambda df: df.select("path")

# filters
Q.on_stored("filter_any_tag", lambda n: PATH(filters.any_tag(n, "en, t3,t5")), "select path from notes where list_has_any(tags, ['en', 't3', 't5'])")
Q.on_stored("filter_all_tags", lambda n: PATH(filters.all_tags(n, ["EN", "t3"], "src", 20)), "select path from notes where list_has_all(list_transform(tags, lambda x: lower(x)), ['en', 't3']) and starts_with(lower(path), 'src') order by path limit 20")
Q.on_stored("filter_folder", lambda n: PATH(filters.in_folder(n, "src3/en")), "select path from notes where folder = 'src3/en'")
Q.on_stored("filter_mtime", lambda n: PATH(filters.mtime_between(n, "2023-01-01 00:00:00", "2023-12-31 23:59:59")), "select path from notes where mtime between timestamp '2023-01-01 00:00:00' and timestamp '2023-12-31 23:59:59'")
Q.on_stored("recent", lambda n: filters.recent(n, AS_OF, 60).select("path", "mtime"), f"select path, mtime from notes where mtime > timestamp '{AS_OF}' - interval 60 day")
Q.on_stored("random_note", lambda n: PATH(filters.random_note(n, 7)), "select path from notes order by md5('7|' || path), path limit 1")
REFS = "refs as (select path as ref from notes where length(raw) % 3 = 0 union select title from notes where length(raw) % 3 = 1 union select regexp_replace(path, '\\.md$', '') from notes where length(raw) % 3 = 2 union select 'none ' || (length(raw) % 10) from notes)"


def _refs(n):
    by = lambda k: n.where(F.length("raw") % 3 == k)
    return by(0).select(F.col("path").alias("ref")).union(by(1).select("title")).union(by(2).select(F.regexp_replace("path", r"\.md$", ""))).union(n.select(F.concat(F.lit("none "), (F.length("raw") % 10).cast("string"))))


Q.on_notes("resolve", lambda n: filters.resolve(_refs(n), n), "select ref, coalesce(p.path, x.path, m.path) as path from refs left join notes p on p.path = ref left join link_index x on x.title = ref left join notes m on m.path = ref || '.md'", REFS)
Q.on_stored("home_note", filters.home_note, "select min(path) as path from notes")


def _filtered(n):
    from ..operators import graph

    nodes, kept = filters.graph_filter(n, graph.weighted_edges(n), tag="t1", folder="src1", hide_isolated=True)
    return kept.select("src", "dst", "weight")


ONE = "one as (select distinct src, dst from edges), weighted as (select a.src, a.dst, case when b.src is null then 1 else 2 end as weight from one a left join one b on a.src = b.dst and a.dst = b.src)"
Q.on_stored("graph_filter", _filtered, "select src, dst, weight from weighted where src in (select path from kept) and dst in (select path from kept)", ONE, "kept as (select path from notes where contains(lower(path), 'src1') and len(list_filter(tags, lambda x: contains(lower(x), 't1'))) > 0)")
Q.on_stored("adjacent_notes", filters.adjacent_notes, "select folder, path, lag(path) over w as previous, lead(path) over w as next from notes window w as (order by path)")

# indexes; parts of about a hundred titles, so that small tables have some
PARTED = """select {key}, part, {names} from (select {key}, title, case when n > 100 then ('0x' || substr(md5(title), 1, 8))::bigint % ceil(n / 100)::bigint else 0 end::int as part
  from (select {key}, title, count(*) over (partition by {key}) as n from {rows})) group by 1, 2"""
Q.on_stored("link_index", indexes.link_index, "select title, path from link_index")
Q.on_stored("duplicate_titles", lambda n: indexes.duplicate_titles(n).select("title", "n", F.array_join("paths", "|").alias("paths")), "select title, count(*) as n, string_agg(path, '|' order by path) as paths from notes group by title having count(*) > 1")
Q.on_stored("backlinks", lambda n: indexes.backlinks(n, 100).select("target", "part", F.array_join("sources", "|").alias("sources")), PARTED.format(key="target", rows="link_rows", names="string_agg(title, '|' order by title) as sources"))
Q.on_stored("tag_index", lambda n: indexes.tag_index(n, 100).select("tag", "part", F.size("titles").alias("n"), F.md5(F.array_join("titles", "|")).alias("titles")), PARTED.format(key="tag", rows="tag_rows", names="count(*)::int as n, md5(string_agg(title, '|' order by title)) as titles"))
Q.on_stored("tag_counts", indexes.tag_counts, "select tag, n from tag_counts order by n desc, tag")
Q.on_stored("notes_for_tag", lambda n: indexes.notes_for_tag(n, "t5"), "select distinct t.title, x.path from tag_rows t join link_index x using (title) where tag = 't5' order by 1")
TREE = """parts_of as (select path, title, string_split(path, '/') as p from notes), levels as (select *, unnest(generate_series(1, len(p))) as k from parts_of),
nodes as (select array_to_string(p[1 : k], '/') as node, k - 1 as depth, k = len(p) as is_note, min(path) as first, max(title) as title from levels group by 1, 2, 3)"""
Q.on_stored("folder_tree", lambda n: indexes.ordered_tree(n), "select node, case when is_note then title else regexp_extract(node, '([^/]+)$', 1) end as name, depth::int as depth, is_note, row_number() over (order by first, depth)::int as n from nodes", TREE)


def _merged(c):
    """The stored index takes the change set as a segment; its link rows are then listed."""
    changed = c.whole.where(F.length("raw") % 10 == 0)
    parsed = changed.where(F.length("raw") % 20 == 0).withColumn("links", F.array(F.lit("New")))
    index = c.having("links").forked(f"{c.root}-{uuid.uuid4().hex}").commit(parsed, changed.select("path"))
    return indexes.listed(index.links.all(), "target", "title", "sources", 100).select("target", "part", F.array_join("sources", "|").alias("sources"))


Q.on_corpus("incremental_index_merge", _merged, PARTED.format(key="target", rows="(select l.target, l.title from link_rows l join notes n using (path) where length(raw) % 10 <> 0 union all select 'New', title from notes where length(raw) % 20 = 0)", names="string_agg(title, '|' order by title) as sources"))

# joins by kind
Q.on_stored("join_inner_links", lambda n: indexes.link_rows(n).select("path", "target").join(indexes.link_index(n).select(F.col("title").alias("target"), F.col("path").alias("to")), "target").groupBy("to").agg(F.count("*").alias("n")), 'select dst as "to", count(*) as n from edges group by dst')
Q.on_stored("join_semi_linked", lambda n: n.join(indexes.link_rows(n).select(F.col("target").alias("title")), "title", "left_semi").select("path"), "select path from notes where title in (select target from link_rows)")
Q.on_stored("join_anti_unlinked", lambda n: n.join(indexes.link_rows(n).select(F.col("target").alias("title")), "title", "left_anti").select("path"), "select path from notes where title not in (select target from link_rows)")
Q.on_stored("join_self_reciprocal", lambda n: _both_ways(n), "select a.src, a.dst from one a join one b on a.src = b.dst and a.dst = b.src where a.src < a.dst", ONE)


def _both_ways(n):
    from ..operators import graph

    return graph.weighted_edges(n).where("weight = 2 and src < dst").select("src", "dst")


# reports
Q.on_stored("totals", insights.totals, "select count(*) as n_notes, (select count(distinct tag) from tag_rows) as n_tags, sum(len(links))::bigint as n_links from notes")
Q.on_stored("corpus_stats", lambda n: insights.corpus_stats(n, AS_OF), f"select count(*) as n_notes, count(*) filter (where mtime > timestamp '{AS_OF}' - interval 7 day) as n_recent, min(mtime) as oldest, max(mtime) as newest, (select count(distinct tag) from tag_rows) as n_tags from notes")
Q.on_stored("orphans_by_title", insights.orphans_by_title, "select title, path from notes where len(links) = 0 and title not in (select target from link_rows)")
Q.on_stored("orphans_by_path", insights.orphans_by_path, "select title, path from notes where len(links) = 0 and path not in (select dst from edges)")
Q.on_stored("broken_links", insights.broken_links, "select path, target from link_rows where target not in (select title from notes) and target not in (select path from notes) and target || '.md' not in (select path from notes)")
Q.on_stored("large_notes", lambda n: insights.large_notes(n.withColumn("toc", F.slice("toc", 2, 9)), 5000), "select path, visible_chars from notes where len(headings) <= 1 and visible_chars > 5000")
Q.on_stored("untagged", insights.untagged, "select count(*) filter (where len(tags) = 0) as n_untagged, round(avg(case when len(tags) = 0 then 1.0 else 0.0 end), 6) as ratio from notes")
Q.on_stored("tag_cloud", lambda n: insights.tag_cloud(n, 20), "select tag, n from tag_counts order by n desc, tag limit 20")


def _series(unit: str, n: int, value: str, name: str) -> str:
    form = "%Y-%m" if unit == "month" else "%Y-%m-%d"
    periods = f"periods as (select strftime(unnest(generate_series(date_trunc('{unit}', timestamp '{AS_OF}') - interval {n - 1} {unit}, date_trunc('{unit}', timestamp '{AS_OF}'), interval 1 {unit})), '{form}') as period)"
    return over_notes(f"select period, coalesce(v, 0)::bigint as {name} from periods left join (select strftime(mtime, '{form}') as period, sum({value}) as v from notes group by 1) using (period)", periods)


for _name, _run, _sql in (
    ("monthly_notes", insights.monthly_notes, _series("month", 24, "1", "n_notes")), ("daily_notes", insights.daily_notes, _series("day", 30, "1", "n_notes")),
    ("monthly_links", insights.monthly_links, _series("month", 24, "len(links)", "n_links")), ("monthly_chars", insights.monthly_chars, _series("month", 24, "visible_chars", "n_chars")),
):
    Q.on_stored(_name, lambda n, run=_run: run(n, AS_OF))
    Q.oracles[_name] = _sql
Q.on_stored("most_linked", insights.most_linked, "select title, path, n as in_degree from (select target as title, count(*) as n from link_rows group by 1) join link_index using (title) order by n desc, path limit 10")
TOP = "top15 as (select tag from tag_counts order by n desc, tag limit 15), pairs as (select a.tag as a, b.tag as b, count(*) as n from tag_rows a join tag_rows b on a.path = b.path and a.tag < b.tag where a.tag in (select tag from top15) and b.tag in (select tag from top15) group by 1, 2)"
Q.on_stored("tag_cooccurrence", insights.tag_cooccurrence, "select a, b, n from pairs", TOP)
Q.on_stored("tag_matrix", insights.tag_matrix, "select x.tag as a, y.tag as b, coalesce(n, 0) as n from top15 x cross join top15 y left join (select a, b, n from pairs union all select b, a, n from pairs) p on p.a = x.tag and p.b = y.tag", TOP)
Q.on_stored("connectivity", insights.connectivity, "select title, path, round(v / max(v) over (), 6) as score from (select n.title, n.path, 2 * coalesce(i, 0) + len(links) as v from notes n left join (select target, count(*) as i from link_rows group by 1) x on x.target = n.title) order by v desc, path limit 10")
DAY = "dated as (select *, coalesce(case when length(d) >= 7 then replace(substr(d, 1, 10), '/', '-') end, strftime(mtime, '%Y-%m-%d')) as day from (select *, regexp_extract(frontmatter, '(?m)^date:[ \\t]*(.*)$', 1) as d from notes))"
Q.on_stored("timeline", insights.timeline, "select day, title, path, array_to_string(tags, ',') as tags, mtime from dated", DAY)
Q.on_stored("timeline_groups", lambda n: insights.timeline_groups(n, "month", "doc 1", "en"), "select substr(day, 1, 7) as period, count(*) as n from dated where contains(lower(title), 'doc 1') and list_contains(tags, 'en') group by 1", DAY)
Q.on_stored("timeline_rollup", insights.timeline_rollup, "select substr(day, 1, 4) as year, substr(day, 6, 2) as month, count(*) as n from dated group by rollup (1, 2)", DAY)
Q.on_stored("tag_evolution", insights.tag_evolution, "select period, tag, n, sum(n) over (partition by period order by place)::bigint as stacked from (select m.period, r.tag, r.place, coalesce(c.n, 0) as n from months m cross join ranked r left join counted c on c.period = m.period and c.tag = r.tag)", "ranked as (select tag, row_number() over (order by n desc, tag) as place from tag_counts order by n desc, tag limit 8)", "months as (select distinct strftime(mtime, '%Y-%m') as period from notes order by 1 desc limit 24)", "counted as (select strftime(mtime, '%Y-%m') as period, unnest(tags) as tag, count(*) as n from notes group by 1, 2)")
Q.on_stored("writing_speed", lambda n: insights.writing_speed(n, AS_OF))
Q.oracles["writing_speed"] = f"select a.period, n_notes, n_chars, max(n_notes) over () as max_notes, max(n_chars) over () as max_chars from ({_series('month', 24, '1', 'n_notes')}) a join ({_series('month', 24, 'visible_chars', 'n_chars')}) b on a.period = b.period"
