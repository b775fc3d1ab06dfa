"""Headings of Markdown that is not plain: a block parser by lines, and the text of inline marks.

Blocks are quotes, list items, fenced and indented code, HTML, paragraphs, rules, hash and underlined headings. What is
told of a heading is its text alone: code spans and HTML go, links, images and emphasis leave their words.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

HASH = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(?:#+|(.*?)(?:[ \t]+#+)?))?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?=[ \t]|$)")
HTML_BLOCK = re.compile(r" {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|(!--)|(\?)|(![A-Za-z])|/?(?:address|article|aside|blockquote|body|br|center|dd|details|div|dl|dt|figure|footer|form|h[1-6]|header|hr|html|iframe|li|main|nav|ol|p|section|summary|table|tbody|td|th|thead|tr|ul)(?=[\s/>]|$))", re.I)
ENDS = ("</{}>", "-->", "?>", ">")
#: What tells a body that the parser has to read: see ``odd``.
ODD = r"(?m)^[ \t>]*(?:(?:[-+*]|\d+[.)])[ \t]+){0,4}(?:=+|-+)[ \t]*\r?$|^(?:[ \t]+|[ \t]*(?:>|[-+*]|\d+[.)]).*)#{1,6}(?:[ \t]|$)|^ {0,3}(?:~~~|````|<[!?/A-Za-z])|^ {0,3}#{1,6}[ \t].*(?:[\\*_\[<&~!]|``)|^ {0,3}#{1,6}\r?$|^[ \t]+```"


def inline_text(line: str) -> str:
    """The words of a heading's source."""
    held: list[str] = []

    def keep(text: str) -> str:
        held.append(text)
        return f"\x00{len(held) - 1}\x00"

    line = line.replace("\x00", "\ufffd")
    line = re.sub(r"\\([!-/:-@\[-`{-~])|(?<!`)(`+)(?!`)(.*?)(?<!`)\2(?!`)", lambda m: keep(m[1]) if m[1] else keep(""), line)
    line = re.sub(r"!\[\[.*?\]\]", "", line)
    line = re.sub(r"\[\[(.*?)(?:\|(.*?))?\]\]", lambda m: keep((m[2] or m[1]).strip()), line)
    line = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>", lambda m: keep(m[1]), line)
    line = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", "", line)
    line = re.sub(r"\[\^[^\]\s]+\]", "", line)
    for _ in range(8):  # links around images, and the like
        fresh = re.sub(r"!?\[([^\[\]]*)\]\((?:<[^<>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)", r"\1", line)
        if fresh == line:
            break
        line = fresh
    line = html.unescape(line)
    for _ in range(4):
        fresh = re.sub(r"(\*{1,3}|~~)(?=\S)((?:(?!\1).)+?)(?<=\S)\1", r"\2", line)
        fresh = re.sub(r"(?<!\w)(_{1,3})(?=\S)((?:(?!\1).)+?)(?<=\S)\1(?!\w)", r"\2", fresh)
        if fresh == line:
            break
        line = fresh
    for _ in held:
        line = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], line)
    return line.strip()


class _Blocks:
    """Reads lines; ``found`` are (level, source lines) of headings."""

    def __init__(self) -> None:
        self.found: list[tuple[int, list[str]]] = []
        self.open: list[int | str] = []  # ">" or the width of a list item's indent
        self.paragraph: list[str] | None = None
        self.code: tuple[str, int] | None = None  # the fence
        self.html: str | None = None  # what ends it; "" is a blank line

    def line(self, line: str) -> None:
        line, kept = line.expandtabs(4), 0
        for box in self.open:
            if box == ">":
                m = re.match(r" {0,3}> ?", line)
                if not m:
                    break
                line = line[m.end() :]
            elif line[:box].strip() and line.strip():
                break
            else:
                line = line[box:]
            kept += 1
        if kept < len(self.open):
            if self.paragraph is not None and not self.code and self.lazy(line):
                self.paragraph.append(line.strip())
                return
            self.open, self.paragraph, self.code, self.html = self.open[:kept], None, None, None
        self.inner(line)

    def lazy(self, line: str) -> bool:
        """Whether a line outside its box goes on with the paragraph inside."""
        return bool(line.strip()) and not (re.match(" {0,3}>", line) or HASH.match(line) or RULE.match(line) or FENCE.match(line) or ITEM.match(line) or HTML_BLOCK.match(line))

    def inner(self, line: str) -> None:
        if self.code:
            m = re.match(r" {0,3}(`+|~+)[ \t]*$", line)
            if m and m[1][0] == self.code[0] and len(m[1]) >= self.code[1]:
                self.code = None
            return
        if self.html is not None:
            if self.html.lower() in line.lower() if self.html else not line.strip():
                self.html = None
            return
        if not line.strip():
            self.paragraph = None
            return
        if self.paragraph is None and line.startswith("    "):
            return  # indented code
        if m := re.match(r" {0,3}> ?", line):
            self.open.append(">")
            self.paragraph = None
            self.inner(line[m.end() :])
        elif m := HASH.match(line):
            self.found.append((len(m[1]), [(m[2] or "").strip()]))
            self.paragraph = None
        elif self.paragraph and (m := UNDERLINE.match(line)):
            self.found.append((1 if m[1][0] == "=" else 2, self.paragraph))
            self.paragraph = None
        elif RULE.match(line):
            self.paragraph = None
        elif m := FENCE.match(line):
            self.code, self.paragraph = (m[1][0], len(m[1])), None
        elif (m := ITEM.match(line)) and (self.paragraph is None or line[m.end() :].strip() and (not line.lstrip()[0].isdigit() or re.match(r" {0,3}1[.)]", line))):
            rest = line[m.end() :]
            pad = len(rest) - len(rest.lstrip())
            pad = pad if rest.strip() and pad <= 4 else 1
            self.open.append(m.end() + pad)
            self.paragraph = None
            self.inner(rest[pad:])
        elif m := HTML_BLOCK.match(line):
            kind = next((k for k in range(4) if m[k + 1]), None)
            end = "" if kind is None else ENDS[kind].format(m[1])
            self.html, self.paragraph = (None if end and end.lower() in line[m.end() :].lower() else end), None
        elif self.paragraph is None:
            self.paragraph = [line.strip()]
        else:
            self.paragraph.append(line.strip())


def headings(text: str) -> list[tuple[int, str]]:
    """(level, text) of each heading, in order."""
    blocks = _Blocks()
    for line in re.split(r"\r\n|\n|\r", text):
        blocks.line(line)
    return [(level, "".join(map(inline_text, lines))) for level, lines in blocks.found]  # a line break is no text


@F.pandas_udf(ArrayType(StructType([StructField("level", IntegerType()), StructField("text", StringType())])))
def parsed(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"level": n, "text": t} for n, t in headings(b)], na_action="ignore").astype(object)


def odd(body: Column) -> Column:
    """Whether a body may hold more than plain hash headings and fences."""
    return body.rlike(ODD) | (F.size(F.regexp_extract_all(body, F.lit("(?m)^```"), F.lit(0))) % 2 == 1)
