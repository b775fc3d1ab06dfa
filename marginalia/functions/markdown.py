"""Column functions over Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import headings

#: The notation of notes.
FRONTMATTER = r"(?s)^---\s*\r?\n(.*?)\r?\n---\s*\r?\n(.*)$"
EMBED = r"!\[\[(.*?)(?:\|(.*?))?\]\]"
LINK = r"\[\[(.*?)(?:\|(.*?))?\]\]"
IMAGE_REF = r"!\[([^\]]*)\]\(([^)]+)\)"
FILE_REF = r"(?:^|[^!])\[([^\]]*)\]\(([^)]+\.(?:pdf|PDF|doc|docx|zip|rar))\)"
TAG = r"(?:^|[^#\w])#([\w一-龥_-]+)"
BLOCK_MATH = r"\$\$([\s\S]*?)\$\$"
INLINE_MATH = r"\$([^\s\$\n\r][^\$\n\r]*[^\s\$\n\r]|[^\s\$\n\r])\$"
HIGHLIGHT = r"==([^=\n\r]+)=="
FENCE = r"(?s)(?:^|\n)```([^\n`]*)\n(.*?)\n```"
HEADING = r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
LINKED_FILE = r"\.(pdf|PDF|png|jpg|jpeg|gif|svg|webp)$"
IMAGE_FILE = r"(?i)\.(png|jpg|jpeg|gif|svg|webp)$"


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def frontmatter(raw: Column) -> Column:
    """The leading metadata block, null if there is none."""
    return F.when(raw.rlike(FRONTMATTER), F.regexp_extract(raw, FRONTMATTER, 1))


def body(raw: Column) -> Column:
    """The text after the metadata block."""
    return F.when(raw.rlike(FRONTMATTER), F.regexp_extract(raw, FRONTMATTER, 2)).otherwise(raw)


def links(text: Column) -> Column:
    """Link targets in order, repeats kept; embeds and linked files are left out."""
    targets = F.transform(all_of(F.regexp_replace(text, EMBED, ""), LINK), lambda x: F.trim(x))
    return F.filter(targets, lambda t: ~t.rlike(LINKED_FILE))


def embeds(text: Column) -> Column:
    """array<struct<target, section, kind>>: images, notes and other files."""

    def told(whole: Column) -> Column:
        t = F.trim(whole)
        note = ~t.rlike(IMAGE_FILE) & (F.element_at(F.split(t, "#"), 1).endswith(".md") | ~t.contains("."))
        kind = F.when(t.rlike(IMAGE_FILE), "image").when(note, "note").otherwise("file")
        cut = note & t.contains("#")
        target = F.when(cut, F.substring_index(t, "#", 1)).otherwise(t)
        section = F.when(cut, F.regexp_extract(t, r"#(.*)$", 1))
        return F.struct(target.alias("target"), section.alias("section"), kind.alias("kind"))

    return F.transform(all_of(text, EMBED), told)


def metadata_tags(meta: Column) -> Column:
    """Tags of a metadata block of plain lines: ``tags`` then ``tag``, each a list or one value."""

    def named(key: str) -> Column:
        listed = F.split(F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*\[(.*?)\][ \t]*$", 1), ",")
        return F.concat(listed, F.array(F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*([^\[\s].*)$", 1)))

    return F.filter(F.transform(F.concat(named("tags"), named("tag")), lambda t: F.trim(F.replace(t, F.lit("\t"), F.lit(" ")))), lambda t: t != "")


def hashtags(text: Column) -> Column:
    return all_of(text, "(?U)" + TAG)


def asset_refs(text: Column) -> Column:
    """Relative image and file references."""
    both = F.concat(all_of(text, IMAGE_REF, 2), all_of(text, FILE_REF, 2))
    return F.filter(F.transform(both, lambda x: F.trim(x)), lambda t: ~t.rlike(r"^(?:https?:|data:|/|#)"))


def heading_id(text: Column, n: Column) -> Column:
    """An anchor: other characters become dashes, numbered from one."""
    slug = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.concat(F.lit("heading-"), n.cast("string"))).otherwise(F.concat(slug, F.lit("-"), n.cast("string")))


def toc(text: Column) -> Column:
    """array<struct<level, text, id>> of headings. Plain hash headings outside fenced code are read in
    place; bodies with underlined headings, boxes, HTML or inline marks go through the block parser."""
    clean = F.regexp_replace(text, r"(?s)(?:^|\n)```.*?\n```", "\n")
    lines = all_of(clean, HEADING, 0)

    def told(line: Column, i: Column) -> Column:
        level = F.length(F.regexp_extract(line, "^(#+)", 1))
        words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^#+\s+", ""), r"\s+#+\s*$", ""), "`[^`]*`", ""))
        return F.struct(level.alias("level"), words.alias("text"), heading_id(words, i + 1).alias("id"))

    odd = headings.odd(text)
    read = F.transform(headings.parsed(F.when(odd, text)), lambda h, i: F.struct(h["level"].alias("level"), h["text"].alias("text"), heading_id(h["text"], i + 1).alias("id")))
    return F.when(odd, read).otherwise(F.transform(lines, told))


def code_languages(text: Column) -> Column:
    """The language word of each fenced block, empty if it has none."""
    return F.transform(all_of(text, FENCE), lambda x: F.trim(x))


def block_math(text: Column) -> Column:
    return all_of(text, BLOCK_MATH)


def inline_math(text: Column) -> Column:
    return all_of(F.regexp_replace(text, BLOCK_MATH, ""), INLINE_MATH)


def highlights(text: Column) -> Column:
    return all_of(text, HIGHLIGHT)
