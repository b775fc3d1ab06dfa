"""Queries of per-note extraction, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import markdown as M
from ..functions import text as T
from ..session import settled, small_files
from ..sources import frontmatter, sinks, vault
from .base import AS_OF, Queries, notes, over_notes

Q = Queries()
PATTERNS = ["dup", "src1/**", "*.tmp", "src?/fr/Doc 1*"]
DROPPED = """regexp_matches(path, '(^|/)\\.') or list_contains(string_split(lower(path), '/'), 'dup') or regexp_matches(path, '(?i)^src1/.*$') or regexp_matches(path, '(?i)^src[^/]/fr/Doc 1[^/]*$')"""
JOINED = lambda c: F.array_join(c, "|")

# sources and change detection
Q.on_notes("ignore_filter", lambda n: n.where(~vault.ignored(F.col("path"), PATTERNS)).select("path"), f"select path from notes where not ({DROPPED})")
FILES = "select path from vault union all select 'assets/' || regexp_extract(path, '^[^/]*', 0) || '/pic' || (length(raw) % 40) || '.png' from vault"


def _files(n):
    extra = F.concat(F.lit("assets/"), F.regexp_extract("path", "^[^/]*", 0), F.lit("/pic"), (F.length("raw") % 40).cast("string"), F.lit(".png"))
    return n.select("path").union(n.select(extra))


Q.on_notes("asset_index", lambda n: vault.asset_index(_files(n)), "select regexp_extract(path, '([^/]+)$', 1) as filename, max(path) as path from (" + FILES + ") where not ends_with(path, '.md') group by 1")


def _snapshots(n):
    old = n.where(F.length("raw") % 13 != 0).select("path", F.when(F.length("raw") % 7 == 0, F.lit("old")).otherwise(F.md5("raw")).alias("version"))
    return old, n.where(F.length("raw") % 17 != 0).select("path", F.md5("raw").alias("version"))


SNAPSHOTS = "old as (select path, case when length(raw) % 7 = 0 then 'old' else md5(raw) end as version from notes where length(raw) % 13 <> 0), new as (select path, md5(raw) as version from notes where length(raw) % 17 <> 0)"
CHANGES = "select path, case when new.version is null then 'delete' else 'upsert' end as op from old full outer join new using (path) where new.version is null or old.version is null or old.version <> new.version"
Q.on_notes("detect_changes", lambda n: vault.detect_changes(*_snapshots(n)), CHANGES, SNAPSHOTS)
Q.on_notes(
    "needs_update",
    lambda n: vault.needs_update(n.where(F.length("raw") % 5 != 0).select("path", "mtime"), n.select("path", F.when(F.length("raw") % 3 == 0, F.col("mtime") + F.expr("interval 1 hour")).otherwise(F.col("mtime")).alias("mtime"))).select("path"),
    "select path from notes where length(raw) % 5 = 0 or length(raw) % 3 = 0",
)


def _applied(n):
    changes = vault.detect_changes(*_snapshots(n))
    old = n.where(F.length("raw") % 13 != 0).select("path", F.lit("old").alias("state"))
    return vault.apply_changes(old, changes, n.select("path", F.lit("new").alias("state")))


Q.on_notes("apply_changes", _applied, f"select path, 'old' as state from old where path not in (select path from ({CHANGES})) union all select path, 'new' from ({CHANGES}) where op = 'upsert'", SNAPSHOTS)


def _snapshot(n):
    path, mark = sinks.shared_path(n.sparkSession), {"version": "1", "commit": "c0", "patterns": ""}
    vault.save_snapshot(n.select("path", "title", F.md5("raw").alias("version")), path, mark)
    return vault.load_snapshot(n.sparkSession, path, mark)


Q.on_notes("save_load_snapshot", _snapshot, "select path, title, md5(raw) as version from notes")


def _two(spark, sf_dir):
    n = notes(spark, sf_dir)
    both = vault.multi_vault_union({"a": n.select("path"), "b": n.where("folder = 'dup'").select("path")})
    return both.groupBy("vault").agg(F.count("*").alias("n"))


Q.plain("multi_vault_union", _two, over_notes("select 'a' as vault, count(*) as n from notes union all select 'b', count(*) from notes where folder = 'dup' having count(*) > 0"))


def _commits(n):
    line = F.when(F.length("raw") % 10 == 0, F.lit("short|line")).otherwise(F.concat_ws("|", F.md5("raw"), F.concat("folder", F.lit("@x.example")), F.date_format("mtime", "yyyy-MM-dd"), F.concat(F.lit("edit | "), "title")))
    return vault.parse_commit_log(n.select(line.alias("value")))


Q.on_notes("parse_commit_log", _commits, "select md5(raw) as hash, substr(md5(raw), 1, 8) as hash_short, folder || '@x.example' as author, strftime(mtime, '%Y-%m-%d') as date, 'edit | ' || title as subject from notes where length(raw) % 10 <> 0")


def _diffs(n):
    diff = F.concat(F.lit("diff a b\n--- a\n+++ b\n@@ -1 +1 @@\n-"), "title", F.lit("\n+"), "path", F.lit("\n same\nend"))
    told = vault.classify_diff(n.select("path", diff.alias("diff")))
    return told.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


Q.on_notes("classify_diff", _diffs, "select kind, count(*) as n, sum(chars)::bigint as chars from (select 'hunk' as kind, 11 as chars from notes union all select 'del', length(title) from notes union all select 'add', length(path) from notes union all select 'ctx', 4 from notes union all select 'ctx', 3 from notes) group by kind")


def _versions(n):
    ages = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("age")
    rows = n.select("path", "mtime", ages).select("path", F.concat(F.lit("v"), F.col("age").cast("string")).alias("content"), F.expr("mtime + make_dt_interval(100 * age)").alias("commit_ts"))
    return vault.note_as_of(rows, F.lit(AS_OF).cast("timestamp_ntz"))


Q.on_notes("note_as_of", _versions, f"select path, 'v' || max(age) as content, max(mtime + to_days((100 * age)::int)) as commit_ts from notes, (values (0), (1), (2), (3)) v(age) where mtime + to_days((100 * age)::int) <= timestamp '{AS_OF}' group by path")


def _scanned(n):
    """Writes all notes as files and reads them back."""
    root = sinks.shared_path(n.sparkSession)
    sinks.write_notes(n, root)
    with small_files(n.sparkSession):
        return settled(vault.scan_vault(n.sparkSession, root).select("path", "title", F.length("raw").alias("chars")))


Q.on_notes("scan_vault", _scanned, "select path, title, length(raw) as chars from notes")

# sinks
Q.on_notes("search_dump", sinks.search_dump, "select title, path, array_to_string(tags, '|') as tags, substr(trim(regexp_replace(replace(regexp_replace(body, '<[^>]*(>|\\z)', ' ', 'g'), '>', ' '), '\\s+', ' ', 'g')), 1, 300) as content, epoch(mtime)::bigint as mtime from notes")
Q.on_stored("feed", lambda n: sinks.feed(n, tag="en", folder="src1"), "select title, path, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') as updated from notes where list_contains(tags, 'en') and (folder = 'src1' or starts_with(folder || '/', 'src1/')) order by mtime desc, path limit 50")
Q.on_stored("feed_atom", lambda n: sinks.atom(sinks.feed(n, tag="en")), "select '<entry><title>' || title || '</title><id>' || path || '</id><updated>' || strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') || '</updated></entry>' as entry from (select * from notes where list_contains(tags, 'en') order by mtime desc, path limit 50)")


def _site(n):
    """Writes the page files and reads them back, with their places in the index pages."""
    root = sinks.shared_path(n.sparkSession)
    sinks.export_site(n, root)
    files = lambda kind: n.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{kind}").select(F.regexp_extract("path", f"/{root.rsplit('/', 1)[-1]}/{kind}/(.*)$", 1).alias("at"), F.decode("content", "utf-8").alias("html"))
    link = r'<li><a href="/([^"]*)">([^<]*)</a></li>'
    found = lambda k: F.regexp_extract_all("html", F.lit(link), F.lit(k))
    index = files("index").select(F.regexp_extract("at", r"^\d+", 0).cast("long").alias("part"), F.posexplode(F.arrays_zip(found(1).alias("at"), found(2).alias("title"))).alias("k", "x"))
    index = index.select("x.at", "x.title", (F.col("part") * sinks.INDEX_LINKS + F.col("k") + 1).alias("n"))
    with small_files(n.sparkSession):
        pages = settled(files("pages").select("at", F.md5("html").alias("html")))
    return pages.join(index, "at").select(F.col("at").alias("html_path"), "title", "n", "html")


Q.on_notes("export_site", _site, "select regexp_replace(path, '\\.md$', '.html') as html_path, title, row_number() over (order by path) as n, md5('<h1>' || title || '</h1><pre>' || replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</pre>') as html from notes")
Q.on_stored("title_catalog", sinks.title_catalog, "select 'title' as kind, title as name, path from notes union all select distinct 'tag', tag, '' from tag_rows")

# extraction
Q.on_notes("split_frontmatter", lambda n: n.select("path", "frontmatter", F.length("body").alias("body_chars")), "select path, frontmatter, length(body) as body_chars from notes")
Q.on_notes("parse_frontmatter", lambda n: frontmatter.parse(n).select("path", F.get_json_object("meta", "$.title").alias("meta_title"), F.get_json_object("meta", "$.date").alias("meta_date")), "select path, nullif(regexp_extract(frontmatter, '(?m)^title:[ \\t]*(.*)$', 1), '') as meta_title, nullif(regexp_extract(frontmatter, '(?m)^date:[ \\t]*(.*)$', 1), '') as meta_date from notes")
Q.on_notes("extract_links", lambda n: n.select("path", JOINED("links").alias("links"), F.size("links").alias("n")), "select path, array_to_string(links, '|') as links, len(links)::int as n from notes")
Q.on_notes(
    "extract_embeds", lambda n: n.select("path", F.inline("embeds")),
    f"select path, case when kind = 'note' and contains(t, '#') then split_part(t, '#', 1) else t end as target, case when kind = 'note' and contains(t, '#') then regexp_extract(t, '#(.*)$', 1) end as section, kind from (select *, case when regexp_matches(t, '{M.IMAGE_FILE}') then 'image' when ends_with(split_part(t, '#', 1), '.md') or not contains(t, '.') then 'note' else 'file' end as kind from (select path, unnest(list_transform(regexp_extract_all(body, '{M.EMBED}', 1), lambda x: trim(x))) as t from notes))",
)
Q.on_notes("extract_asset_refs", lambda n: n.select("path", F.explode(M.asset_refs(F.col("body"))).alias("asset")), f"select path, asset from (select path, unnest(list_concat(regexp_extract_all(body, '{M.IMAGE_REF}', 2), regexp_extract_all(body, '{M.FILE_REF}', 2))) as asset from notes) where not regexp_matches(asset, '^(?:https?:|data:|/|#)')")
Q.on_notes("extract_tags", lambda n: n.select("path", JOINED("tags").alias("tags")), "select path, array_to_string(tags, '|') as tags from notes")
TOC = """select path, i::int as place, length(regexp_extract(h, '^(#+)', 1))::int as level, trim(regexp_replace(regexp_replace(regexp_replace(h, '^#+\\s+', ''), '\\s+#+\\s*$', ''), '`[^`]*`', '', 'g')) as text from (select path, unnest(headings) as h, unnest(generate_series(1, len(headings))) as i from notes)"""
Q.on_notes("extract_toc", lambda n: n.select("path", F.posexplode("toc").alias("place", "h")).select("path", (F.col("place") + 1).alias("place"), "h.level", "h.text"), TOC)
Q.on_notes("heading_id", lambda n: n.select("path", F.explode("toc").alias("h")).select("path", "h.id"), f"select path, case when s = '' then 'heading-' || place else s || '-' || place end as id from (select *, regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '^-+|-+$', '', 'g') as s from ({TOC}))")
Q.on_notes("math_spans", lambda n: n.select("path", F.size(M.block_math(F.col("body"))).alias("n_block"), F.size(M.inline_math(F.col("body"))).alias("n_inline")), f"select path, len(regexp_extract_all(body, '{M.BLOCK_MATH}', 1))::int as n_block, len(regexp_extract_all(regexp_replace(body, '{M.BLOCK_MATH}', '', 'g'), '{M.INLINE_MATH}', 1))::int as n_inline from notes")
Q.on_notes("highlight_spans", lambda n: n.select("path", F.explode(M.highlights(F.col("body"))).alias("span")), f"select path, unnest(regexp_extract_all(body, '{M.HIGHLIGHT}', 1)) as span from notes")
Q.on_notes("code_block_census", lambda n: n.select(F.explode(M.code_languages(F.col("body"))).alias("language")).groupBy("language").agg(F.count("*").alias("n")), f"select trim(l) as language, count(*) as n from (select unnest(regexp_extract_all(body, '{M.FENCE}', 1)) as l from notes) group by 1")
Q.on_stored("note_date", lambda n: n.select("path", dates.note_date(F.col("frontmatter"), F.col("mtime")).alias("day")), "select path, coalesce(case when length(d) >= 7 then replace(substr(d, 1, 10), '/', '-') end, strftime(mtime, '%Y-%m-%d')) as day from (select *, regexp_extract(frontmatter, '(?m)^date:[ \\t]*(.*)$', 1) as d from notes)")
Q.on_stored("breadcrumbs", lambda n: n.select("path", F.concat_ws(" > ", F.lit("Home"), F.concat_ws(" > ", F.filter(F.split("folder", "/"), lambda x: x != "")), "title").alias("crumbs")), "select path, 'Home > ' || replace(folder, '/', ' > ') || ' > ' || title as crumbs from notes")
Q.on_notes("escape_html", lambda n: n.select("path", F.md5(T.escape_html(F.col("body"))).alias("escaped")), "select path, md5(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as escaped from notes")
Q.on_notes("percent_encode", lambda n: n.select("path", T.percent_encode(F.col("path")).alias("encoded"), T.percent_decode(T.percent_encode(F.col("path"))).alias("decoded")), "select path, replace(replace(replace(replace(url_encode(path), '.', '%2E'), '-', '%2D'), '_', '%5F'), '~', '%7E') as encoded, path as decoded from notes")
Q.on_notes("rfc3339", lambda n: n.select("path", dates.rfc3339(F.col("mtime")).alias("stamp"), dates.ymd(F.col("mtime")).alias("ymd"), dates.year_month(F.col("mtime")).alias("ym")), "select path, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') as stamp, strftime(mtime, '%Y-%m-%d') as ymd, strftime(mtime, '%Y-%m') as ym from notes")
Q.on_notes("word_stats", lambda n: n.select("path", T.word_count(F.col("body")).alias("words"), F.length("body").alias("chars"), F.size(F.split("body", "\n")).alias("lines")), f"select path, len(regexp_extract_all(body, '{T.CJK}')) + len(regexp_extract_all(body, '[A-Za-z]+')) as words, length(body) as chars, len(string_split(body, chr(10)))::int as lines from notes")


# HTML, over the pages table
def _pages(make):
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/pages.parquet"))


STRIPPED = "trim(regexp_replace(replace(regexp_replace(html, '<[^>]*(>|\\z)', ' ', 'g'), '>', ' '), '\\s+', ' ', 'g'))"
Q.plain("visible_chars", _pages(lambda p: p.select("page_id", T.visible_chars(F.col("html")).alias("visible_chars"))), "select page_id, length(replace(regexp_replace(html, '<[^>]*(>|\\z)', '', 'g'), '>', '')) as visible_chars from pages")
Q.plain("strip_html", _pages(lambda p: p.select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text"))), f"select page_id, md5({STRIPPED}) as text from pages")
Q.plain("preview", _pages(lambda p: p.select("page_id", T.preview(F.col("html"), 200).alias("preview"))), f"select page_id, case when length(t) > 200 then substr(t, 1, 200) || '...' else t end as preview from (select page_id, {STRIPPED} as t from pages)")
HEADS = "select page_id, unnest(regexp_extract_all(html, '{p}', 1)) as level, unnest(regexp_extract_all(html, '{p}', {k})) as text from pages"
Q.plain("html_headings", _pages(lambda p: p.select("page_id", F.inline(T.html_headings(F.col("html"))))), "select page_id, level::int as level, trim(regexp_replace(text, '<[^>]*>', '', 'g')) as text from (" + HEADS.format(p="(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>", k=2) + ")")
TAGGED = "regexp_replace(html, '<h([1-6])>', '<h\\1 id=\"s\\1\">', 'g')"
Q.plain("toc_from_html", _pages(lambda p: p.select("page_id", F.inline(T.toc_from_html(F.regexp_replace("html", "<h([1-6])>", '<h$1 id="s$1">'))))), f"select page_id, level::int as level, 's' || level as id, text from (select page_id, level, trim(regexp_replace(text, '<[^>]*>', '', 'g')) as text from (" + HEADS.format(p='(?is)<h([1-6])[^>]*id="[^"]*"[^>]*>(.*?)</h[1-6]>', k=2).replace("from pages", f"from (select page_id, {TAGGED} as html from pages)") + ")) where text <> ''")
