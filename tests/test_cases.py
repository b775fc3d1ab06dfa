"""Small cases with known results."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions import text as T
from marginalia.operators import activity, filters, graph, indexes, insights, search
from marginalia.sources import frontmatter, vault

NOTE = "title string, path string, folder string, mtime timestamp_ntz, links array<string>, tags array<string>, body string, visible_chars long, frontmatter string, toc array<struct<level:int,text:string,id:string>>, embeds array<struct<target:string,section:string,kind:string>>"


def notes(spark, linked: dict[str, list[str]], tags: dict[str, list[str]] | None = None, bodies: dict[str, str] | None = None):
    rows = [(t, f"{t}.md", "", None, ls, (tags or {}).get(t, []), (bodies or {}).get(t, ""), 0, None, [], []) for t, ls in linked.items()]
    return spark.createDataFrame(rows, NOTE)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def paths(df) -> set[str]:
    return {r["path"] for r in df.collect()}


def test_depth(spark):
    n = notes(spark, {"A": ["B"], "B": ["C"], "C": []})
    assert paths(graph.local_graph(n, "A", 1)) == {"A.md", "B.md"}
    assert paths(graph.local_graph(n, "A", 2)) == {"A.md", "B.md", "C.md"}
    assert paths(graph.local_graph(n, "none", 2)) == set()


def test_backlink_in_local_graph(spark):
    assert paths(graph.local_graph(notes(spark, {"A": [], "D": ["A"]}), "A", 1)) == {"A.md", "D.md"}


def test_hide_isolated(spark):
    assert paths(graph.global_graph(notes(spark, {"A": ["B"], "B": [], "Solo": []}), hide_isolated=True)[0]) == {"A.md", "B.md"}


def test_weights(spark):
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.weighted_edges(notes(spark, {"A": ["B"], "B": ["A", "C"], "C": ["C"]})).collect()}
    assert edges == {("A.md", "B.md"): 2, ("B.md", "A.md"): 2, ("B.md", "C.md"): 1, ("C.md", "C.md"): 2}


def test_shortest_path(spark):
    n = notes(spark, {"A": ["B"], "B": ["C"], "C": ["D"], "D": []})
    way = lambda *a: [r["path"] for r in graph.shortest_path(n, *a).orderBy("hop").collect()]
    assert way("A", "C") == ["A.md", "B.md", "C.md"]
    assert way("A", "A") == ["A.md"]
    assert way("C", "A") == way("A", "none") == way("A", "D", 2) == []


def test_pagerank_hub(spark):
    ranks = {r["path"]: r["rank"] for r in graph.pagerank(notes(spark, {"A": ["H"], "B": ["H"], "H": []})).collect()}
    assert ranks["H.md"] == 1.0 > ranks["A.md"]


def test_pagerank_has_one_exchange_a_round(spark, monkeypatch):
    n = notes(spark, {f"n{k}": [f"n{k * 7 % 40}", "n5"] for k in range(40)})
    seen, settled = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), settled(df))[1])
    ranks = graph.pagerank(n, rounds=8, every=4)
    assert seen[2:] == [4, 4] and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert ranks.where("path = 'n5.md'").first()["rank"] == 1.0


def test_incremental_backlinks(spark):
    n = notes(spark, {"A": ["B"], "B": ["C"], "C": []})
    parsed = notes(spark, {"A": ["C"]})
    told = {r["target"]: r["sources"] for r in indexes.merged_index(n, parsed.select("path"), parsed).collect()}
    assert told == {"C": ["A", "B"]}


def test_cooccurrence(spark):
    n = notes(spark, {"1": [], "2": []}, {"1": ["rust", "async"], "2": ["rust", "web"]})
    assert {(r["a"], r["b"], r["n"]) for r in insights.tag_cooccurrence(n).collect()} == {("async", "rust", 1), ("rust", "web", 1)}


def test_connectivity(spark):
    first = insights.connectivity(notes(spark, {"A": ["B"], "B": [], "C": ["B"]})).first()
    assert (first["title"], first["score"]) == ("B", 1.0)


def test_untagged(spark):
    r = insights.untagged(notes(spark, {"A": [], "B": []}, {"A": ["x"]})).first()
    assert (r["n_untagged"], r["ratio"]) == (1, 0.5)


@pytest.mark.parametrize(("html", "n"), [("<p>hello</p>", 5), ("<b>你好</b>", 2), ("no tags", 7), ("a<b", 1), ("a>b", 2)])
def test_visible_chars(spark, html, n):
    assert one(spark, T.visible_chars, html) == n


@pytest.mark.parametrize(
    ("meta", "tags"),
    [
        (None, []), ("title: x", []), ("tags: [duplicate]", ["duplicate"]), ("tags:\n  - one\n  - two\ntag: three", ["one", "two", "three"]), ("tags: [a, b] # note", ["a", "b"]), ("tags: [a,\n  b]", ["a", "b"]), ('tags: ["x, y", z]', ["x, y", "z"]),
        ("tags: one two\ntag: [three]", ["one two", "three"]), ("tags: [a, 12, 1.5, true, null, 2023-01-01, '7']", ["a", "2023-01-01", "7"]), ("tags: [a, 12, true]", ["a"]), ("tags: [a,, b]", []), ("title: a: b\ntags: [c]", []), ("tag: x\ntags: [y]", ["y", "x"]), ("tags: {a: b}", []), ("tags: [[a], b]", ["b"]), ("tags: []", []), ("- tags", []), ("tags:\r\n- a\r\n- b", ["a", "b"]), ("tags: 'quoted' ", ["quoted"]),
    ],
)
def test_metadata_tags(spark, meta, tags):
    assert one(spark, frontmatter.tags, meta) == tags


def test_many_metadata_tags(spark):
    assert len(one(spark, frontmatter.tags, "tags:\n" + "".join(f"- t{i}\n" for i in range(20_000)))) == 20_000
    assert len(one(spark, frontmatter.tags, "tags: [" + ", ".join(f"t{i}" for i in range(20_000)) + "]")) == 20_000


def test_hashtags(spark):
    assert one(spark, M.hashtags, "## h\nand #tag #café") == ["tag", "café"]
    n = vault.notes(spark.createDataFrame([("---\ntags: [duplicate, two]\n---\n#duplicate #x",)], "raw string"))
    assert n.select("tags").first()["tags"] == ["duplicate", "two", "x"]


def test_math_and_highlights_stay_on_a_line(spark):
    assert one(spark, M.inline_math, "$a$ $ b$ $c\rd$ $x y$") == ["a", "x y"]
    assert one(spark, M.highlights, "==a==\n==b\rc==\n====") == ["a"]
    assert one(spark, M.block_math, "$$$$ $$a\nb$$") == ["", "a\nb"]


def test_hot_keys_are_divided(spark):
    n = notes(spark, {f"n{i:03}": ["H"] for i in range(300)} | {"H": ["n001"]})
    rows = indexes.backlinks(n, 50).collect()
    assert {r["part"] for r in rows if r["target"] == "H"} == set(range(6)) and max(len(r["sources"]) for r in rows) < 100
    assert sorted(t for r in rows if r["target"] == "H" for t in r["sources"]) == [f"n{i:03}" for i in range(300)]
    assert [(r["part"], r["sources"]) for r in rows if r["target"] == "n001"] == [(0, ["H"])]


def test_tables_are_stored_once_for_a_state_of_the_input(spark, tmp_path):
    from marginalia.sources.store import Corpus

    docs = spark.range(20).selectExpr("id as doc_id", "concat('word', id) as text", "'en' as lang", "'s' as source", "5L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = Corpus(spark, str(tmp_path))
    assert first.postings.of(["word7"]).count() == 1
    assert Corpus(spark, str(tmp_path)).notes.inputFiles() == first.notes.inputFiles()
    shutil.rmtree(first.notes.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert Corpus(spark, str(tmp_path)).notes.count() == 20
    # two notes more: the input grew, so links of the others changed too, but not the first segment
    docs.limit(3).selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    grown = Corpus(spark, str(tmp_path))
    assert grown.notes.count() == 23 and len(grown.index.mark["segments"]) == 2


def test_home_names_in_order(spark):
    names = ["README.md", "Readme.md", "readme.md", "index.md", "Index.md", "A.md"]
    for k in range(len(names)):
        n = spark.createDataFrame([(p,) for p in reversed(names[k:])], "path string")
        assert filters.home_note(n).first()["path"] == names[k]


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_across_folders_and_ranges(spark, uncoalesced):
    from marginalia.operators import ordering

    rows = spark.range(500).selectExpr("concat(id * 7919 % 13, '/', lpad(id * 31 % 500, 3, '0')) as path", "concat('f', id % 13) as folder").repartition(7)
    want = sorted(r["path"] for r in rows.collect())
    told = {r["path"]: (r["previous"], r["next"]) for r in filters.adjacent_notes(rows).collect()}
    assert told == {p: (want[k - 1] if k else None, want[k + 1] if k + 1 < len(want) else None) for k, p in enumerate(want)}
    assert [r["n"] for r in ordering.numbered(rows, F.col("path")).orderBy("path").collect()] == list(range(1, 501))
    assert ordering.ranged(rows, F.col("path")).select(ordering.RANGE).distinct().count() > 1
    assert filters.adjacent_notes(rows.limit(0)).count() == 0


def test_frontmatter(spark):
    text = "---\r\ntitle: x\r\n---\r\nbody"
    assert one(spark, M.frontmatter, text) == "title: x"
    assert one(spark, M.body, text) == "body"
    assert one(spark, M.body, "no block") == "no block"
    told = frontmatter.parse(spark.createDataFrame([("a: [",), (None,), ("a: 1",)], "frontmatter string")).collect()
    assert [r["meta"] for r in told] == [None, None, '{"a": "1"}']


def test_links(spark):
    assert one(spark, M.links, "[[A]] [[B|b]] ![[C]] [[x.png]] [[A]]") == ["A", "B", "A"]
    told = one(spark, M.embeds, "![[p.PNG]] ![[N#S|alt]] ![[f.zip]]")
    assert [(e["target"], e["section"], e["kind"]) for e in told] == [("p.PNG", None, "image"), ("N", "S", "note"), ("f.zip", None, "file")]


def test_toc(spark):
    told = one(spark, M.toc, "# One two\n```\n# not\n```\n### `code` x ##\n")
    assert [(h["level"], h["text"], h["id"]) for h in told] == [(1, "One two", "One-two-1"), (3, "x", "x-2")]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.tmp", "dir/file.tmp", False), ("*.tmp", "file.TMP", True), ("**/*.tmp", "dir/file.tmp", True), ("Drafts", "a/drafts/x.md", True), ("a[1].md", "a[1].md", True), ("none", ".git/x", True), ("none", "a.md", False)])
def test_ignored(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "path string").select(vault.ignored(F.col("path"), [pattern]).alias("x")).first()["x"] is hit


def test_ngrams(spark):
    assert one(spark, T.ngrams, "ab 你好吗 c") == ["ab", "你好吗", "你", "好", "吗", "你好", "好吗"]
    assert search.ngram_tokens("你好") == ["你好", "你", "好"]


def test_paging(spark):
    n = notes(spark, {f"n{i:02}": [] for i in range(25)}, bodies={f"n{i:02}": "rust code" for i in range(25)})
    pages = [[r["path"] for r in search.search_page(n, "rust", p, 10).orderBy("n").collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert sorted(sum(pages, [])) == sorted(paths(n))


def test_fuzzy(spark):
    n = notes(spark, {"rust guide": [], "other": []})
    assert [r["path"] for r in search.fuzzy_suggest(n, "rsut").collect()] == ["rust guide.md"]


def test_jaccard_is_symmetric_and_bounded(spark, data):
    from marginalia.plans.base import notes as derived

    for r in graph.tag_jaccard(derived(spark, data)).collect():
        assert 0 < r["jaccard"] <= 1 and r["a"] <= r["b"]


def test_resolve(spark):
    n = notes(spark, {"A": [], "B": []})
    refs = spark.createDataFrame([("A.md",), ("B",), ("zzz",)], "ref string")
    assert {r["ref"]: r["path"] for r in filters.resolve(refs, n).collect()} == {"A.md": "A.md", "B": "B.md", "zzz": None}


def test_snapshot_needs_the_same_mark(spark, tmp_path):
    df = spark.range(3)
    vault.save_snapshot(df, str(tmp_path / "s"), {"v": "1"})
    assert vault.load_snapshot(spark, str(tmp_path / "s"), {"v": "1"}).count() == 3
    assert vault.load_snapshot(spark, str(tmp_path / "s"), {"v": "2"}) is None
    assert vault.load_snapshot(spark, str(tmp_path / "none"), {"v": "1"}) is None


def test_share_visits_stop_at_the_budget(spark):
    links = spark.sql("select 's' as token, 'p' as path, timestamp_ntz'2024-01-01 00:00:00' as created_at, timestamp_ntz'2024-01-03 00:00:00' as expires_at, 2 as max_visits")
    hits = spark.sql("select 'p' as path, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) as ts, id as event_id from range(5)")
    assert activity.share_visits(links, hits).first()["visits"] == 2


def test_kmeans_against_plain_python(spark):
    import random

    rng = random.Random(3)
    data = [(i, [rng.gauss(5 * (i % 3), 1), rng.gauss(-5 * (i % 3), 1)]) for i in range(90)]
    centres = [data[i * 90 // 3][1] for i in range(3)]
    near = lambda f: min(range(3), key=lambda c: (sum((a - b) ** 2 for a, b in zip(f, centres[c], strict=True)), c))
    for _ in range(10):
        held = [[f for _, f in data if near(f) == c] for c in range(3)]
        centres = [[sum(x) / len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centres, strict=True)]
    told = {r["id"]: r["cluster"] for r in graph.kmeans(spark.createDataFrame(data, "id long, features array<double>"), 3, 10).collect()}
    assert told == {i: near(f) for i, f in data}


@pytest.mark.parametrize("name", ["scan_vault", "stream_notes"])
def test_every_note_is_written_and_read_back(spark, data, name):
    from marginalia import catalog

    told = {tuple(r) for r in catalog.QUERIES[name](spark, data).select("path", "chars").collect()}
    assert told == {(r["path"], len(r["raw"])) for r in vault.derived_vault(spark, data).collect()}


def test_only_notes_are_read(spark, tmp_path):
    """Assets and ignored files are left out by their paths, whatever characters these have."""
    for name in ("a b/x+1%.md", "a b/pic.png", "README", "drafts/y.md", ".git/z.md", "é/ü#?.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    notes = vault.scan_vault(spark, str(tmp_path), ["drafts"])
    assert {(r["path"], r["title"], r["folder"], r["raw"]) for r in notes.collect()} == {("a b/x+1%.md", "x+1%", "a b", "a b/x+1%.md"), ("README", "README", "", "README"), ("é/ü#?.md", "ü#?", "é", "é/ü#?.md")}
    plan = notes._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().get("numFiles").get().value() == 3


def test_files_go_where_their_root_says(spark, tmp_path):
    from marginalia.sources import sinks

    rows = spark.createDataFrame([("a/b.html", "é"), ("c.html", "")], "path string, content string")
    sinks.write_files(rows, f"file:{tmp_path}/x")
    assert (tmp_path / "x/a/b.html").read_text() == "é" and (tmp_path / "x/c.html").read_text() == ""
    with pytest.raises(Exception, match="scheme|filesystem"):
        sinks.write_files(rows, "nowhere://x/y")


def _shares(spark):
    """Two hot notes, many accesses at one moment, links of every kind; and what all pairs say."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(5), datetime(2024, 1, 1)
    hits = [(rng.choice(["p", "q", None]), start + timedelta(minutes=20 * rng.randrange(300)) if i % 17 else None, i) for i in range(900)]
    links = []
    for i in range(120):
        made = start + timedelta(minutes=20 * rng.randrange(300))
        links.append((f"s{i}", rng.choice(["p", "q", "none", None]), made if i % 13 else None, made + timedelta(minutes=20 * rng.randrange(-3, 90)) if i % 2 else None, i % 7 if i % 3 == 0 else None))
    want = {}
    for token, path, made, end, most in links:
        n = sum(1 for p, t, _ in hits if None not in (p, t, path, made) and p == path and t >= made and (end is None or t <= end))
        want[token] = n if most is None else min(n, most)
    frame = spark.createDataFrame(links, "token string, path string, created_at timestamp_ntz, expires_at timestamp_ntz, max_visits int")
    return frame, spark.createDataFrame(hits, "path string, ts timestamp_ntz, event_id long"), want


def test_share_visits_against_all_pairs(spark):
    links, hits, want = _shares(spark)
    assert {r["token"]: r["visits"] for r in activity.share_visits(links, hits).collect()} == want


def test_share_visits_pair_no_accesses(spark):
    """A link meets two rows of running counts, not every access of its note."""
    hits = spark.sql("select 'p' as path, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 86400) as ts, id as event_id from range(3000)")
    links = spark.sql("select 's' || id as token, 'p' as path, timestamp_ntz'2024-01-01 00:00:00' as created_at, cast(null as timestamp_ntz) as expires_at, cast(null as int) as max_visits from range(300)")
    told = activity.share_visits(links, hits)
    assert {r["visits"] for r in told.collect()} == {3000}
    plan, most, todo = told._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    while todo:
        node = todo.pop()
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        below = [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        todo.extend(below)
    assert 0 < most <= 3600


def test_streams_are_drained_without_the_driver(spark, tmp_path):
    """Batches are upserted by key, in whatever number they come."""
    from marginalia.plans import streaming
    from marginalia.streaming import activity as S

    for i in range(3):
        spark.createDataFrame([(k, i * 10 + j) for j, k in enumerate(["a", "b", None])][: 3 - i], "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = streaming.drained(stream().groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n")), "update", ["k"])
    assert {r["k"]: (r["v"], r["n"]) for r in told.collect()} == {"a": (30, 3), "b": (12, 2), None: (2, 1)}
    assert all(f.startswith("file:") for f in told.inputFiles()) and told.inputFiles()
    assert streaming.drained(stream(), "append").count() == 6
    accesses = "token string, ts timestamp, n long, expires_at timestamp, max_visits double"
    rows = [("s", "2024-01-01", 5, "2024-01-02", None), ("z", "2024-01-09", 1, None, None), ("s", "2024-01-10", 7, "2024-01-02", None), ("z", "2024-01-11", 9, None, 4.0)]
    for t, at, n, end, most in rows:
        one = spark.createDataFrame([(t, at, n, end, most)], "token string, ts string, n long, expires_at string, max_visits double")
        one.selectExpr("token", "cast(ts as timestamp) ts", "n", "cast(expires_at as timestamp) expires_at", "max_visits").coalesce(1).write.mode("append").parquet(str(tmp_path / "acc"))
    told = streaming.drained(S.share_budget(spark.readStream.schema(accesses).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "acc"))), "update", ["token"])
    assert {r["token"]: r["visits"] for r in told.collect()} == {"s": 5, "z": 4}


@pytest.mark.parametrize("name", ["scan_vault", "export_site"])
def test_files_of_notes_are_read_by_few_tasks(spark, data, monkeypatch, name):
    from marginalia.plans import extraction
    from marginalia.session import setting

    tasks, settled = [], extraction.settled
    monkeypatch.setattr(extraction, "settled", lambda df: (tasks.append(df.rdd.getNumPartitions()), settled(df))[1])
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(4 << 20)):
        assert extraction.Q.queries[name](spark, data).count() == 200
    assert len(tasks) == 1 and tasks[0] < 20  # 200 with a file a task
