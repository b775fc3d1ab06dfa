"""What the registered queries share: the derived notes in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import markdown as M
from ..sources.store import Corpus
from ..sources.vault import DERIVED

AS_OF = "2024-06-30 12:00:00"

VAULT = DERIVED.format(mt="timestamp '2024-06-30 12:00:00' - to_minutes(cast(doc_id * 677 % 1051200 as int))", nl="chr(10)")
_ONCE = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
NOTES = f"""
vault as ({VAULT}),
parts as (select *, case when regexp_matches(raw, '{M.FRONTMATTER}') then regexp_extract(raw, '{M.FRONTMATTER}', 1) end as frontmatter,
  case when regexp_matches(raw, '{M.FRONTMATTER}') then regexp_extract(raw, '{M.FRONTMATTER}', 2) else raw end as body from vault),
listed as (select *,
  list_filter(list_transform(regexp_extract_all(regexp_replace(body, '{M.EMBED}', '', 'g'), '{M.LINK}', 1), lambda x: trim(x)), lambda x: not regexp_matches(x, '{M.LINKED_FILE}')) as links,
  list_concat(list_filter(list_transform(string_split(coalesce(regexp_extract(frontmatter, '(?m)^tags:[ \\t]*\\[(.*?)\\][ \\t]*$', 1), ''), ','), lambda x: trim(x)), lambda x: x <> ''),
    regexp_extract_all(body, '{M.TAG}', 1)) as all_tags,
  length(replace(regexp_replace(body, '<[^>]*(>|\\z)', '', 'g'), '>', '')) as visible_chars,
  regexp_extract_all(regexp_replace(body, '(?s)(?:^|\\n)```.*?\\n```', chr(10), 'g'), '{M.HEADING}', 0) as headings from parts),
notes as (select * exclude (all_tags), {_ONCE.format(l='all_tags')} as tags from listed),
link_rows as (select path, title, i - 1 as place, links[i] as target from (select path, title, links, unnest(generate_series(1, len(links))) as i from notes)),
tag_rows as (select path, title, unnest(tags) as tag from notes),
link_index as (select title, max(path) as path from notes group by title),
tag_counts as (select tag, count(*) as n from tag_rows group by tag),
edges as (select l.path as src, x.path as dst, place from link_rows l join link_index x on l.target = x.title)
"""


def over_notes(sql: str, *ctes: str, vault: str = "") -> str:
    """SQL over the derived notes; ``vault`` changes them first, from the vault as it was."""
    told = NOTES.replace("vault as (", "was as (", 1).replace("parts as (", f"vault as ({vault}), parts as (", 1) if vault else NOTES
    return f"with recursive {', '.join([told.strip(), *ctes])}\n{sql.strip()}"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).whole


class Queries:
    """Queries by name, and the SQL of those that SQL can tell."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def on_notes(self, name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, *ctes: str) -> None:
        """A query over the derived notes with their text."""
        self.plain(name, lambda spark, sf_dir: run(notes(spark, sf_dir)), sql and over_notes(sql, *ctes))

    def on_stored(self, name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, *ctes: str) -> None:
        """A query over the extracted notes, which are written once."""
        self.on_corpus(name, lambda c: run(c.notes), sql, *ctes)

    def on_corpus(self, name: str, run: Callable[[Corpus], DataFrame], sql: str | None = None, *ctes: str) -> None:
        """A query over any of the stored tables."""
        self.plain(name, lambda spark, sf_dir: run(Corpus(spark, sf_dir)), sql and over_notes(sql, *ctes))

    def plain(self, name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = run
        if sql:
            self.oracles[name] = sql
