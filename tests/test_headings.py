"""The block parser of headings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.functions import headings as H
from marginalia.functions import markdown as M

CASES = [
    ("# One\n## Two ##\n####### seven", [(1, "One"), (2, "Two")]),
    ("Title\n===\ntext\n\nSub\n---", [(1, "Title"), (2, "Sub")]),
    ("two\nlines\n===", [(1, "twolines")]),
    ("---\n# a\n***", [(1, "a")]),
    ("text\n\n---\n\nmore", []),
    ("a\n=b=\n", []),
    ("```\n# no\n===\n```\n# yes", [(1, "yes")]),
    ("~~~ x\n# no\n~~~\n# yes", [(1, "yes")]),
    ("````\n```\n# no\n````\n# yes", [(1, "yes")]),
    ("```\n# never closed", []),
    ("    # code\n\n   # three blanks", [(1, "three blanks")]),
    ("text\n    # goes on\n===", [(1, "text# goes on")]),
    ("> # quoted\n> text\n> ---\n# after", [(1, "quoted"), (2, "text"), (1, "after")]),
    ("- # item\n- text\n---\n1. ## n", [(1, "item"), (2, "n")]),
    ("- a\n  ===\n", [(1, "a")]),
    ("> lazy\ngoes on\n===", []),
    ("<div>\n# no\n\n# yes\n</div>", [(1, "yes")]),
    ("<!-- a\n# no\n\n-->\n# yes", [(1, "yes")]),
    ("<script>\n# no\n\n# no\n</script>\n# yes", [(1, "yes")]),
    ("# *a* **b** _c_ ~~d~~ snake_case_x", [(1, "a b c d snake_case_x")]),
    ("# `code` and ``a ` b`` text", [(1, "and  text")]),
    ("# [link](http://x (y)) ![img](p.png) <b>html</b> <http://u.v>", [(1, "[link](http://x (y)) img html http://u.v")]),
    ("# [a](b) [[Note]] [[Note|label]] ![[pic.png]]", [(1, "a Note label")]),
    ("# \\*not\\* \\# &amp; &lt;", [(1, "*not* # & <")]),
    ("# [![x](i.png)](u) [^1] [plain]", [(1, "x  [plain]")]),
    ("#\n#tag\n# #", [(1, ""), (1, "")]),
    ("# a\r\nb\r\n===\r\n", [(1, "a"), (1, "b")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_blocks_and_marks(text, want):
    assert H.headings(text) == want


def test_columns(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)] + [(-1, None), (-2, "# plain one\ntext\n```\n# no\n```\n## `x` two\n"), (-3, "- " * 20_000 + "x\n" + "> " * 9_000)], "k long, t string")
    told = {r["k"]: r["toc"] for r in docs.select("k", M.toc(F.col("t")).alias("toc")).collect()}
    for k, (_, want) in enumerate(CASES):
        assert [(h["level"], h["text"]) for h in told[k]] == want, CASES[k]
    assert [(h["level"], h["text"], h["id"]) for h in told[-2]] == [(1, "plain one", "plain-one-1"), (2, "two", "two-2")]
    assert told[-1] is None and told[-3] == []


def test_the_parser_agrees_on_plain_headings(spark, data):
    from marginalia.sources.vault import derived_vault

    bodies = derived_vault(spark, data).select(M.body(F.col("raw")).alias("b"))
    for r in bodies.select("b", M.toc(F.col("b")).alias("toc")).collect():
        assert [(h["level"], h["text"]) for h in r["toc"]] == H.headings(r["b"])
