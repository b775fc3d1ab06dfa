"""Queries of link-graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .base import Queries

Q = Queries()
ONE = "one as (select distinct src, dst from edges), weighted as (select a.src, a.dst, case when b.src is null then 1 else 2 end as weight from one a left join one b on a.src = b.dst and a.dst = b.src)"
RANKS = ["outs as (select src, count(*) as o from edges group by src)", "r0 as (select path, 1.0::double / (select count(*) from notes) as rank from notes)"]
for _k in range(1, 21):
    RANKS.append(f"r{_k} as materialized (select n.path, 0.15 / (select count(*) from notes) + 0.85 * coalesce(got, 0) as rank from notes n left join (select dst, sum(rank / o) as got from edges join outs using (src) join r{_k - 1} on path = src group by dst) on dst = path)")
RANKED = "select path, round(rank / max(rank) over (), 6) as rank from r20"

Q.on_stored("edges", graph.edges, "select src, dst, place::int as place from edges")
Q.on_stored("global_graph", lambda n: graph.global_graph(n)[1], "select src, dst, weight from weighted", ONE)
Q.on_stored("global_graph_nodes", lambda n: graph.global_graph(n, hide_isolated=True)[0].select("path"), "select src as path from one union select dst from one", ONE)
Q.on_stored("pagerank", graph.pagerank, RANKED, *RANKS)
REACH = """centre as (select path from link_index where title = 'Doc 10'), d1 as (select distinct dst as path from edges where src in (select path from centre) and dst not in (select path from centre)),
d2 as (select distinct dst as path from edges where src in (select path from d1) and dst not in (select path from centre) and dst not in (select path from d1)),
reached as (select path, 0 as depth from centre union all select path, 1 from d1 union all select path, 2 from d2)"""
Q.on_stored("local_graph", lambda n: graph.local_graph(n, "Doc 10", 2), "select path, depth from reached union all select path, 1 from (select distinct path from link_rows where target = 'Doc 10') where path not in (select path from reached)", REACH)
Q.on_stored(
    "shortest_path", lambda n: graph.shortest_path(n, "Doc 1", "Doc 400").select("hop", "path"),
    """select (unnest(generate_series(1, len(way))) - 1)::int as hop, unnest(way) as path from (select way from (with recursive w(node, way, turn) as (select path, [path], []::int[] from link_index where title = 'Doc 1'
    union all select dst, list_append(way, dst), list_append(turn, place) from w join turns on src = node where len(turn) < 6 and not list_contains(way, dst)) select way, turn from w join link_index on path = node where title = 'Doc 400') order by len(way), turn limit 1)""",
    "turns as (select src, dst, min(place)::int as place from edges group by src, dst)",
)
Q.on_stored("degrees", graph.degrees, "select n.path, coalesce(i, 0) as in_degree, len(links) as out_degree, 10 + least(3 * coalesce(i, 0), 25) as display_size from notes n left join (select target, count(*) as i from link_rows group by 1) on target = title")
EMBEDDED = """note_embeds as (select path as holder, split_part(t, '#', 1) as target from (select path, unnest(list_transform(regexp_extract_all(body, '!\\[\\[(.*?)(?:\\|(.*?))?\\]\\]', 1), lambda x: trim(x))) as t from notes) where not contains(t, '.')),
resolved as (select holder, target, x.path as dest from note_embeds left join link_index x on x.title = target)"""
Q.on_stored(
    "transclusion", graph.transclusion,
    """select holder as root, 1 as level, target, case when dest is null then 'missing' else 'ok' end as status from resolved
    union all select a.holder, 2, b.target, case when b.dest is null then 'missing' else 'ok' end from resolved a join resolved b on b.holder = a.dest
    union all select a.holder, 3, c.target, 'depth_limit' from resolved a join resolved b on b.holder = a.dest join resolved c on c.holder = b.dest""",
    EMBEDDED,
)
Q.on_stored("color_groups", graph.color_groups, "select path, tags[1] as tag, case when len(tags) > 0 then dense_rank() over (order by tags[1] nulls last)::int else 0 end as grp from notes")
CLASSES = """sets as (select path, list_sort(tags) as t from notes where len(tags) > 0), classes as (select t, min(path) as c, count(*) as n from sets group by t),
sims as (select a.c as a, b.c as b, a.n as n_a, b.n as n_b, len(list_intersect(a.t, b.t)) as shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as jaccard from classes a join classes b on list_has_any(a.t, b.t) and (a.c < b.c or a.c = b.c and a.n > 1))"""
Q.on_stored("tag_jaccard", graph.tag_jaccard, "select a, b, n_a, n_b, shared, jaccard from sims", CLASSES)
Q.on_stored(
    "top_similar", graph.top_similar,
    "select distinct least(p, q) as a, greatest(p, q) as b, jaccard from (select x.path as p, y.path as q, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) as jaccard from sets x join sets y on x.path <> y.path and list_has_any(x.t, y.t) qualify row_number() over (partition by x.path order by jaccard desc, y.path) <= 3)",
    CLASSES,
)
TOP = "top12 as (select tag, row_number() over (order by n desc, tag) - 1 as cluster from tag_counts order by n desc, tag limit 12)"
Q.on_stored("tag_clusters", graph.tag_clusters, "select path, coalesce(cluster, -1)::int as cluster from notes left join (select path, arg_min(cluster, i) as cluster from (select path, unnest(tags) as tag, unnest(generate_series(1, len(tags))) as i from notes) join top12 using (tag) group by path) using (path)", TOP)
Q.on_stored("knowledge_map_rows", lambda n: graph.knowledge_map_rows(n, graph.pagerank(n)), f"select path, title, array_to_string(tags, ',') as tags, rank from notes join ({RANKED}) using (path)", *RANKS)
K, ROUNDS = 8, 5
MEANS = [
    "pts as materialized (select vec_id as id, embedding::double[] as f from embeddings)",
    f"c0 as materialized (select (row_number() over (order by place) - 1)::int as i, f from (select f, row_number() over (order by id) - 1 as place from pts) where place in (select i * (select count(*) from pts) // {K} from range({K}) r(i)))",
]
for _k in range(1, ROUNDS + 1):
    MEANS.append(f"a{_k} as materialized (select id, pts.f as f, arg_min(i, (list_distance(pts.f, c.f), i)) as i from pts, c{_k - 1} c group by all)")
    MEANS.append(f"m{_k} as (select i, list(v order by j) as f from (select i, j, avg(x) as v from (select i, unnest(f) as x, unnest(generate_series(1, len(f))) as j from a{_k}) group by i, j) group by i)")
    MEANS.append(f"c{_k} as materialized (select i, coalesce(m.f, c.f) as f from c{_k - 1} c left join m{_k} m using (i))")
Q.plain(
    "kmeans", lambda spark, sf_dir: graph.kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), K, ROUNDS).select("id", "cluster"),
    f"with {', '.join(MEANS)} select id, arg_min(i, (list_distance(pts.f, c.f), i))::int as cluster from pts, c{ROUNDS} c group by id",
)
