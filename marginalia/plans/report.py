"""All reports over the notes, which are extracted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import insights
from . import corpus
from .base import AS_OF, Queries, over_notes

Q = Queries()


def insights_report(notes: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """metric, key, value of every report; ``notes`` are read by each, so give them from a table."""
    totals = insights.totals(notes)
    parts = {
        "totals": totals.select(F.inline(F.array(*(F.struct(F.lit(x).alias("key"), F.col(f"n_{x}").alias("value")) for x in ("notes", "links", "tags"))))),
        "untagged": insights.untagged(notes).select(F.lit("untagged").alias("key"), F.col("n_untagged").alias("value")),
        "broken_links": insights.broken_links(notes).groupBy(F.col("target").alias("key")).agg(F.count("*").alias("value")),
        "tag_cloud": insights.tag_cloud(notes).select(F.col("tag").alias("key"), F.col("n").alias("value")),
        "monthly_notes": insights.monthly_notes(notes, as_of).select(F.col("period").alias("key"), F.col("n_notes").alias("value")),
        "daily_notes": insights.daily_notes(notes, as_of).select(F.col("period").alias("key"), F.col("n_notes").alias("value")),
        "monthly_links": insights.monthly_links(notes, as_of).select(F.col("period").alias("key"), F.col("n_links").alias("value")),
        "monthly_chars": insights.monthly_chars(notes, as_of).select(F.col("period").alias("key"), F.col("n_chars").alias("value")),
        "most_linked": insights.most_linked(notes).select(F.col("title").alias("key"), F.col("in_degree").alias("value")),
        "orphans": insights.orphans_by_path(notes).select(F.col("path").alias("key"), F.lit(1).alias("value")),
        "large_notes": insights.large_notes(notes).select(F.col("path").alias("key"), F.col("visible_chars").alias("value")),
        "tag_cooccurrence": insights.tag_cooccurrence(notes).select(F.concat_ws("|", "a", "b").alias("key"), F.col("n").alias("value")),
        "connectivity": insights.connectivity(notes).select(F.col("path").alias("key"), F.col("score").alias("value")),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("metric"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


def _oracle() -> str:
    known = corpus.Q.oracles
    parts = [
        ("totals", "unnest(['notes', 'links', 'tags'])", "unnest([n_notes, n_links, n_tags])", known["totals"]),
        ("untagged", "'untagged'", "n_untagged", known["untagged"]),
        ("broken_links", "target", "n", f"select target, count(*) as n from ({known['broken_links']}) group by target"),
        ("tag_cloud", "tag", "n", over_notes("select tag, n from tag_counts order by n desc, tag limit 200")),
        *((name, "period", column, known[name]) for name, column in (("monthly_notes", "n_notes"), ("daily_notes", "n_notes"), ("monthly_links", "n_links"), ("monthly_chars", "n_chars"))),
        ("most_linked", "title", "in_degree", known["most_linked"]),
        ("orphans", "path", "1", known["orphans_by_path"]),
        ("large_notes", "path", "visible_chars", over_notes("select path, visible_chars from notes where len(headings) = 0 and visible_chars > 5000")),
        ("tag_cooccurrence", "a || '|' || b", "n", known["tag_cooccurrence"]),
        ("connectivity", "path", "score", known["connectivity"]),
    ]
    return " union all ".join(f"select '{name}' as metric, {key} as key, ({value})::double as value from ({sql})" for name, key, value, sql in parts)


Q.on_stored("insights_report", insights_report)
Q.oracles["insights_report"] = _oracle()
