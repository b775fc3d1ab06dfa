"""Column functions over plain and HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideograph blocks that are searched by character.
CJK = r"[㐀-䶿一-鿿぀-ゟ゠-ヿ가-힯]"


def visible_chars(html: Column) -> Column:
    """Characters outside tags; an unclosed tag swallows the rest."""
    return F.length(F.replace(F.regexp_replace(html, r"<[^>]*(>|\z)", ""), F.lit(">"))).cast("long")


def strip_html(html: Column) -> Column:
    """Tags and stray ends of tags become spaces; white space is collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(html, r"<[^>]*(>|\z)", " "), F.lit(">"), F.lit(" ")), r"\s+", " "))


def preview(html: Column, n: int = 500) -> Column:
    text = strip_html(html)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def toc_from_html(html: Column) -> Column:
    """array<struct<level, id, text>> of headings that have an id."""
    whole = r"(?is)<h([1-6])[^>]*\bid=\"([^\"]*)\"[^>]*>(.*?)</h[1-6]>"
    part = lambda k: F.regexp_extract_all(html, F.lit(whole), F.lit(k))
    rows = F.arrays_zip(part(1).alias("level"), part(2).alias("id"), part(3).alias("text"))
    told = F.transform(rows, lambda r: F.struct(r["level"].cast("int").alias("level"), r["id"].alias("id"), F.trim(F.regexp_replace(r["text"], "<[^>]*>", "")).alias("text")))
    return F.filter(told, lambda r: r["text"] != "")


def html_headings(html: Column) -> Column:
    """array<struct<level, text>> of all headings."""
    whole = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    part = lambda k: F.regexp_extract_all(html, F.lit(whole), F.lit(k))
    rows = F.arrays_zip(part(1).alias("level"), part(2).alias("text"))
    return F.transform(rows, lambda r: F.struct(r["level"].cast("int").alias("level"), F.trim(F.regexp_replace(r["text"], "<[^>]*>", "")).alias("text")))


def escape_html(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def percent_encode(text: Column) -> Column:
    """Every byte that is not an ASCII letter or digit as %XX."""
    out = F.url_encode(text)
    for c, code in (("+", "%20"), (".", "%2E"), ("-", "%2D"), ("_", "%5F"), ("*", "%2A")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def percent_decode(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of ``words``, without a list of them."""
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def ngrams(text: Column) -> Column:
    """Words of two bytes or more, then single ideographs and adjacent pairs of them."""
    long_words = F.filter(words(text), lambda w: F.octet_length(w) >= 2)
    runs = F.regexp_extract_all(text, F.lit(CJK + "+"), F.lit(0))
    parts = lambda r, n: F.transform(F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: i + n - 1 <= F.length(r)), lambda i: F.substring(r, i, F.lit(n)))
    both = lambda rs: F.concat(F.flatten(F.transform(rs, lambda r: parts(r, 1))), F.flatten(F.transform(rs, lambda r: parts(r, 2))))
    return F.concat(long_words, F.flatten(F.transform(F.array(runs), both)))  # the text is searched for runs once


def word_count(text: Column) -> Column:
    """Ideographs plus runs of Latin letters."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return (count(CJK) + count("[A-Za-z]+")).cast("long")


def _quoted(term: str) -> str:
    return "(?i)" + "".join(f"\\{c}" if not c.isalnum() and c != " " and ord(c) < 128 else c for c in term)


def highlight(text: Column, term: str) -> Column:
    """Every occurrence of the term in any case between marks."""
    return F.regexp_replace(text, f"({_quoted(term)})", "<mark>$1</mark>") if term else text


def snippet(text: Column, query: str, before: int = 50, after: int = 100, none: int = 150) -> Column:
    """Around the first occurrence of the whole query, marked; else the beginning."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.locate(query.lower(), F.lower(flat)) if query else F.lit(0)
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + len(query) - 1 + after, F.length(flat))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(flat, start, end - start + 1), F.when(end < F.length(flat), "...").otherwise(""))
    plain = F.concat(F.substring(flat, 1, none), F.when(F.length(flat) > none, "...").otherwise(""))
    return F.when(at > 0, highlight(cut, query)).otherwise(plain)


def ngram_snippet(text: Column, tokens: list[str], before: int = 30, window: int = 150) -> Column:
    """A window that starts a little before the earliest token."""
    places = F.filter(F.array(*(F.locate(t, F.lower(text)) for t in tokens)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1))
    cut = F.substring(text, start, F.lit(window))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + window - 1 < F.length(text), "...").otherwise(""))
