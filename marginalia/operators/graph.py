"""Link-graph analytics. Nodes are paths; edges come from links resolved by title."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import planned_ahead, settled
from .indexes import link_index, link_rows


def edges(notes: DataFrame) -> DataFrame:
    """src, dst, place for each link that names a note; parallel edges stay."""
    titles = link_index(notes).select(F.col("title").alias("target"), F.col("path").alias("dst"))
    return link_rows(notes).select(F.col("path").alias("src"), "place", "target").join(titles, "target").select("src", "dst", "place")


def weighted_edges(notes: DataFrame) -> DataFrame:
    """src, dst, weight: 2 if the reverse edge is there, else 1."""
    one = edges(notes).select("src", "dst").distinct()
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    return one.join(back, ["src", "dst"], "left").select("src", "dst", (1 + F.coalesce("back", F.lit(0))).alias("weight"))


def global_graph(notes: DataFrame, hide_isolated: bool = False, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted edges; isolated nodes go if asked, or beyond ``most`` notes."""
    linked = weighted_edges(notes)
    if hide_isolated or notes.select("path").limit(most + 1).count() > most:
        ends = linked.select(F.col("src").alias("path")).union(linked.select(F.col("dst").alias("path"))).distinct()
        return notes.join(ends, "path", "left_semi").select("path", "title"), linked
    return notes.select("path", "title"), linked


def pagerank(notes: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 10) -> DataFrame:
    """path and rank, divided by the largest; parallel edges count, dangling rank is lost.

    Links are dealt by source and nodes by path, once. A round's ranks come out of the sum by target
    dealt as the next round needs them, so a round has one exchange: that of partial sums."""
    spark = notes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = edges(notes).select("src", "dst")
    with planned_ahead(spark):
        links = settled(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src").repartition(parts, "src"))
        nodes = settled(notes.select(F.col("path").alias("node")).distinct().repartition(parts, "node"))
        n = nodes.count()
        ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
        for k in range(1, rounds + 1):
            given = links.join(ranks.hint("shuffle_hash"), links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
            ranks = nodes.join(given.hint("shuffle_hash"), nodes["node"] == given["dst"], "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
            ranks = settled(ranks) if k % every == 0 or k == rounds else ranks
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top), F.lit(True)).select(F.col("node").alias("path"), F.round(F.col("rank") / F.col("top"), 6).alias("rank"))


def local_graph(notes: DataFrame, title: str, depth: int = 1) -> DataFrame:
    """path and depth: along links up to ``depth`` (1 to 3), then the notes that link to the centre."""
    depth = min(max(depth, 1), 3)
    links = edges(notes).select("src", "dst").distinct()
    centre = link_index(notes).where(F.col("title") == title).select("path")
    seen = centre.withColumn("depth", F.lit(0))
    front = seen
    for k in range(1, depth + 1):
        step = links.join(front.select(F.col("path").alias("src")), "src").select(F.col("dst").alias("path")).distinct()
        front = settled(step.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front)
    back = link_rows(notes).where(F.col("target") == title).select("path").distinct().join(seen.select("path"), "path", "left_anti")
    back = back.join(centre.select(F.lit(1).alias("x")), F.lit(True), "left_semi")
    return seen.unionByName(back.withColumn("depth", F.lit(1)))


def shortest_path(notes: DataFrame, start: str, goal: str, hops: int = 6) -> DataFrame:
    """hop, path along one shortest way between titles or paths; no row if there is none."""
    spark = notes.sparkSession
    known = {r["title"]: r["path"] for r in link_index(notes).where(F.col("title").isin(start, goal)).collect()}
    known |= {r["path"]: r["path"] for r in notes.where(F.col("path").isin(start, goal)).select("path").collect()}
    a, b = known.get(start), known.get(goal)
    schema = "hop int, path string"
    if a is None or b is None:
        return spark.createDataFrame([], schema)
    if a == b:
        return spark.createDataFrame([(0, a)], schema)
    links = settled(edges(notes).groupBy("src", "dst").agg(F.min("place").alias("place")))
    front = spark.createDataFrame([(a, [a], [])], "node string, way array<string>, turn array<int>")
    seen = front.select("node")
    for _ in range(hops):
        # the first way in queue order: by the places of the links along it
        step = links.join(front, links["src"] == front["node"]).join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        first = step.groupBy("dst").agg(F.min(F.struct(F.concat("turn", F.array("place")).alias("turn"), "way")).alias("via"))
        front = settled(first.select(F.col("dst").alias("node"), F.concat("via.way", F.array("dst")).alias("way"), F.col("via.turn").alias("turn")))
        found = front.where(F.col("node") == b)
        if not found.isEmpty():
            return found.select(F.posexplode("way").alias("hop", "path"))
        if front.isEmpty():
            break
        seen = seen.union(front.select("node"))
    return spark.createDataFrame([], schema)


def degrees(notes: DataFrame) -> DataFrame:
    """path, in-links by raw title, out-links, display size."""
    incoming = link_rows(notes).groupBy(F.col("target").alias("title")).agg(F.count("*").alias("in_degree"))
    told = notes.select("path", "title", F.size("links").cast("long").alias("out_degree")).join(incoming, "title", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return told.select("path", "in_degree", "out_degree", (10 + F.least(3 * F.col("in_degree"), F.lit(25))).alias("display_size"))


def transclusion(notes: DataFrame, depth: int = 2) -> DataFrame:
    """root, level, target, status of note embeds, expanded ``depth`` levels deep."""
    titles = link_index(notes)
    wanted = notes.select("path", F.explode("embeds").alias("e")).where("e.kind = 'note'").select(F.col("path").alias("holder"), F.col("e.target").alias("target"))
    names = titles.select(F.col("title").alias("name"), F.col("path").alias("by_title"))
    paths = notes.select(F.col("path").alias("by_path")).distinct()
    files = paths.withColumnRenamed("by_path", "by_file")
    found = wanted.join(names, F.regexp_replace("target", r"\.md$", "") == F.col("name"), "left").join(paths, F.col("target") == F.col("by_path"), "left").join(files, F.concat("target", F.lit(".md")) == F.col("by_file"), "left")
    found = settled(found.select("holder", "target", F.coalesce("by_title", "by_path", "by_file").alias("to")))
    level = found.select(F.col("holder").alias("root"), F.lit(1).alias("level"), "target", "to")
    out = level.select("root", "level", "target", F.when(F.col("to").isNull(), "missing").otherwise("ok").alias("status"))
    for k in range(2, depth + 2):
        inner = found.select(F.col("holder").alias("to"), F.col("target").alias("inner"), F.col("to").alias("next"))
        level = level.where("to is not null").select("root", "to").join(inner, "to").select("root", F.lit(k).alias("level"), F.col("inner").alias("target"), F.col("next").alias("to"))
        status = F.lit("depth_limit") if k > depth else F.when(F.col("to").isNull(), "missing").otherwise("ok")
        out = out.unionByName(level.select("root", "level", "target", status.alias("status")))
    return out


def color_groups(notes: DataFrame) -> DataFrame:
    """path, its first tag, and the number of that tag's group by name (0 without tags)."""
    first = F.get("tags", F.lit(0))
    groups = notes.select(first.alias("tag"), F.substring(first, 1, 2).alias("start")).where("tag is not null").distinct()
    # tags are numbered among those of the same two first characters, behind all that come before
    starts = groups.groupBy("start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = groups.join(starts, "start").select("tag", (F.col("before") + F.row_number().over(Window.partitionBy("start").orderBy("tag"))).cast("int").alias("grp"))
    return notes.select("path", first.alias("tag")).join(numbered, "tag", "left").select("path", "tag", F.coalesce("grp", F.lit(0)).alias("grp"))


def tag_classes(notes: DataFrame) -> DataFrame:
    """One row a distinct set of tags: tags, class (its smallest path), n notes."""
    return notes.select("path", F.array_sort("tags").alias("tags")).where(F.size("tags") > 0).groupBy("tags").agg(F.min("path").alias("class"), F.count("*").alias("n"))


def ranked_classes(notes: DataFrame) -> DataFrame:
    """Tag classes with ``ranked``, their tags from the rarest to the most frequent."""
    classes = tag_classes(notes)
    rows = classes.select("class", F.explode("tags").alias("tag"))
    often = rows.groupBy("tag").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "tag").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "tag"))), lambda x: x["tag"]).alias("ranked"))
    return settled(classes.join(ranked, "class"))


def near_pairs(probes: DataFrame, classes: DataFrame, least: float, overlap: int = 1) -> DataFrame:
    """a, b: classes that may reach ``least`` and share ``overlap`` tags or more. Two such sets share
    one of their rarest tags, so many of each that fewer than needed are left out, and neither is
    too large for the other."""

    def prefix(df: DataFrame, name: str) -> DataFrame:
        n = F.size("ranked")
        needed = F.greatest(F.lit(overlap), F.ceil(n * F.lit(least) - 1e-9)).cast("int")
        return df.where(n >= needed).select(F.col("class").alias(name), n.alias(f"size_{name}"), F.explode(F.slice("ranked", F.lit(1), n - needed + 1)).alias("tag"))

    met = prefix(probes, "a").join(prefix(classes, "b"), "tag").where("a <> b")
    return met.where((F.col("size_a") * F.lit(least) <= F.col("size_b") + 1e-9) & (F.col("size_b") * F.lit(least) <= F.col("size_a") + 1e-9)).select("a", "b").distinct()


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with both numbers of notes, shared tags and their exact similarity."""
    a, b = (classes.select(F.col("class").alias(x), F.col("tags").alias(f"t{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", shared.cast("long").alias("shared"), F.round(shared / F.size(F.array_union("ta", "tb")), 6).alias("jaccard"))


def tag_jaccard(notes: DataFrame, least: float = 0.0) -> DataFrame:
    """a, b, n_a, n_b, shared, jaccard for tag sets that share a tag and reach ``least``. With 0
    that is every pair that shares a tag; above, sets meet by their rarest tags only.

    Notes with equal tags are one class, named by its smallest path; a class of two or
    more is also paired with itself. Notes are not expanded into pairs."""
    classes = ranked_classes(notes)
    pairs = near_pairs(classes, classes, least).where("a < b").union(classes.where("n > 1").select("class", "class"))
    return _compared(pairs, classes).where(F.col("jaccard") >= least)


def candidate_pairs(classes: DataFrame, k: int, levels: tuple[float, ...] = (0.5, 0.0)) -> DataFrame:
    """a, b, n_a, n_b, shared, jaccard: pairs that hold every class's nearest, enough for the k nearest of its notes.

    Pairs that share one tag only: the fewer tags the other has, the nearer it is, so a tag's
    k + 2 classes of fewest tags (then smallest paths) stand before all its others. Pairs that
    share more meet by their rarest tags, never by the last one of both. This is done for similarities from
    each level up; a class that has found k notes there needs no more, as all that is nearer is found too."""
    size = F.size("ranked")
    postings = classes.select(F.explode("ranked").alias("tag"), "class", size.alias("size"))
    first = Window.partitionBy("tag").orderBy("size", "class")
    heads = postings.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 2)
    found = postings.select("tag", F.col("class").alias("a")).join(heads.select("tag", F.col("class").alias("b")), "tag").where("a <> b").select("a", "b").distinct()
    found = settled(_compared(found, classes))
    left = classes
    for level in levels:
        found = settled(found.union(_compared(near_pairs(left, classes, level, 2), classes)).distinct())
        mates = F.least(F.col("n") - 1, F.lit(k))
        near = found.where(F.col("jaccard") >= level).groupBy(F.col("a").alias("class")).agg(F.sum("n_b").alias("near"))
        left = settled(left.join(near, "class", "left").where(F.coalesce("near", F.lit(0)) + mates < k).select(classes.columns))
    return found


def top_similar(notes: DataFrame, k: int = 3) -> DataFrame:
    """Undirected pairs of notes in which one is among the other's k nearest by tags
    (ties by path). A class offers its k + 1 smallest paths, which is all that any note needs."""
    classes = ranked_classes(notes)
    both = candidate_pairs(classes, k).select("a", "b", "jaccard").union(classes.where("n > 1").select("class", "class", F.lit(1.0)))
    member = notes.select("path", F.array_sort("tags").alias("tags")).join(classes, "tags").select("class", "path")
    offered = member.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("path"))).where(F.col("n") <= k + 1).select("class", F.col("path").alias("near"))
    order = Window.partitionBy("a").orderBy(F.desc("jaccard"), "near")
    lists = both.join(offered, F.col("b") == F.col("class")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("a", "near", "jaccard")
    order = Window.partitionBy("path").orderBy(F.desc("jaccard"), "near")
    best = member.join(lists, F.col("class") == F.col("a")).where("path <> near").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return best.select(F.least("path", "near").alias("a"), F.greatest("path", "near").alias("b"), "jaccard").distinct()


def tag_clusters(notes: DataFrame, k: int = 12) -> DataFrame:
    """path and cluster: the place of its first tag that is among the k most frequent, else -1."""
    top = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)
    ranked = top.select("tag", (F.row_number().over(Window.orderBy(F.desc("n"), "tag")) - 1).alias("cluster"))
    rows = notes.select("path", F.posexplode("tags").alias("place", "tag")).join(F.broadcast(ranked), "tag")
    first = rows.groupBy("path").agg(F.min_by("cluster", "place").alias("cluster"))
    return notes.select("path").join(first, "path", "left").select("path", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def evenly_spaced(points: DataFrame, k: int, n: int, ranges: int = 64) -> list:
    """The features at k evenly spaced places by id, without sorting all rows in one task:
    ids fall into ranges, counts tell which range holds a place, and rows are numbered there."""
    bounds = F.array(*map(F.lit, points.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.01))).cast("array<double>")
    ranged = points.withColumn("range", F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    wanted, before = [], 0
    places = [i * n // k for i in range(k)]
    for r in sorted(ranged.groupBy("range").count().collect()):  # a row a range
        wanted += [(r["range"], p - before + 1) for p in places if before <= p < before + r["count"]]
        before += r["count"]
    numbered = ranged.where(F.col("range").isin([r for r, _ in wanted])).withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("id")))
    hit = F.struct("range", "n").isin([F.struct(F.lit(r), F.lit(p)) for r, p in wanted])
    return [list(r["f"]) for r in numbered.where(hit).orderBy("range", "n").collect()]  # k rows


def kmeans(points: DataFrame, k: int, rounds: int = 30) -> DataFrame:
    """id, cluster for rows (id, features array<float>): seeds evenly spaced by id, the
    nearest centre (the first of equals), an empty cluster keeps its centre."""
    points = settled(points.select("id", F.transform("features", lambda x: x.cast("double")).alias("f")))
    n = points.count()
    k = min(k, n)
    if not k:
        return points.sparkSession.createDataFrame([], "id long, cluster int")
    centres = evenly_spaced(points, k, n)

    def nearest() -> F.Column:
        held = F.from_json(F.lit(json.dumps(centres)), "array<array<double>>")  # one literal, however many centres
        far = F.transform(held, lambda c, i: F.struct(F.aggregate(F.zip_with("f", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("i")))
        return F.array_min(far)["i"]

    for _ in range(rounds):
        told = points.select(nearest().alias("cluster"), "f")
        dims = len(centres[0])
        means = told.groupBy("cluster").agg(*(F.avg(F.col("f")[d]).alias(f"m{d}") for d in range(dims))).collect()
        fresh = list(centres)
        for r in means:
            fresh[r["cluster"]] = [r[f"m{d}"] for d in range(dims)]
        if fresh == centres:
            break
        centres = fresh
    return points.select("id", nearest().alias("cluster"))


def knowledge_map_rows(notes: DataFrame, ranks: DataFrame) -> DataFrame:
    return notes.select("path", "title", F.array_join("tags", ",").alias("tags")).join(ranks, "path", "left").select("path", "title", "tags", F.coalesce("rank", F.lit(0.0)).alias("rank"))
