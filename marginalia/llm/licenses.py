"""Operator 2: license scan as an exact set-similarity join.

Templates are token sets; text blocks are windows of ``BLOCK`` words that start every
``STEP`` words. A block matches if it holds at least ``CONTAINMENT`` of a template's
distinct tokens. Tokens are ordered by how many documents hold them, over all
documents, rarest first. A template's prefix is its first
``n - ceil(CONTAINMENT * n) + 1`` tokens: a matching block must hold one of them.

- prefix filter: only windows around a prefix token become blocks;
- length filter: a block needs as many distinct tokens as the match does;
- positional filter: the template's tokens from the first shared prefix token on,
  must still be enough;
- then the overlap is counted exactly;
- last, the block must hold at least ``ADJACENT`` of the template's pairs of neighbouring
  words as neighbours, so that its words do not match in any other order; of an identifier
  (``SPDX-License-Identifier: MIT``), all of them.

The template list is fixed, so its tables are bounded and broadcast. A word is a run
of digits, letters a-z after A-Z are lower-cased, and characters beyond ASCII.

Null or empty text has no words. Rows are told apart by id and text: rows that share an id,
or have none, get the labels of their own text alone. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, split_words, table

BLOCK, STEP = 64, 32
CONTAINMENT = 0.9
ADJACENT = 0.7

#: Identifiers of licenses in file heads, by the label they get.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0"], "apache": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "bsl": ["BSL-1.0"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "epl": ["EPL-2.0"],
    "gfdl": ["GFDL-1.3"], "gpl": ["GPL-2.0", "GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}
#: Sentences and names that well-known licenses are declared by.
TEMPLATES = [
    *((label, "spdx license identifier " + " ".join(name.lower().replace("-", " ").replace(".", " ").split())) for label, names in IDENTIFIERS.items() for name in names),
    ("cc-by", "creative commons attribution 4 0"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "the mit licence"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by", "licensed under a creative commons attribution international license"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
#: The phrases of the base rule.
PHRASES = {"apache": ["apache", "license"], "gpl": ["general", "public", "license"], "mit": ["mit", "license"]}


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"), split_words(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), NON_WORD).alias("w"))


def _needed(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def token_order(words: DataFrame) -> dict[str, int]:
    """Rank of every template token by the number of documents that hold it, then by name."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in text.split()})
    held = words.select(F.explode(F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary)))).alias("t"))
    counts = {r["t"]: r["count"] for r in held.groupBy("t").count().collect()}  # at most a row for each template token
    return {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def _pairs(words: Column) -> Column:
    """Distinct neighbours, joined by a space."""
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _places(hits: Column, phrase: list[str]) -> Column:
    """Starts of a phrase among ``w``'s positions in ``hits``, which hold its last word."""
    w, last = F.col("w"), len(phrase) - 1

    def spelled(i: Column) -> Column:
        found = i >= last
        for k, word in enumerate(phrase):
            found = found & (F.get(w, i - last + k) == word)
        return found

    return F.transform(F.filter(hits, spelled), lambda i: i - last)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases, labels of both, best containment."""
    spark = docs.sparkSession
    words = _words(docs)
    order = token_order(words)
    rows, prefix_tokens = [], set()
    for k, (label, text) in enumerate(TEMPLATES):
        tokens = sorted(set(text.split()), key=order.get)
        n, need = len(tokens), _needed(len(set(text.split())))
        for p, t in enumerate(tokens[: n - need + 1]):
            prefix_tokens.add(t)
            if n - p >= need:  # the positional filter of the first shared token
                said = text.split()
                pairs = sorted({f"{a} {b}" for a, b in zip(said, said[1:])})
                rows.append((t, k, label, tokens, p, n, need, pairs, len(pairs) if said[0] == "spdx" else math.ceil(ADJACENT * len(pairs) - 1e-9)))
    prefixes = spark.createDataFrame(rows, "token string, template int, label string, tokens array<string>, place int, n int, need int, pairs array<string>, ordered int")

    w = F.col("w")
    wanted = sorted(prefix_tokens | {p[-1] for p in PHRASES.values()})
    positions = F.filter(F.transform(w, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    told = words.withColumn("hits", positions).withColumn("n_words", F.size("w").cast("long"))
    starts = {label: _places(F.col("hits"), phrase) for label, phrase in PHRASES.items()}
    all_starts = F.concat(*starts.values())
    base = [F.when(F.size(starts[x]) > 0, F.lit(x)) for x in sorted(starts)]
    told = told.select(
        "doc_id", "key", "n_words", F.when(F.size("hits") > 0, F.size(all_starts)).otherwise(0).cast("long").alias("n_base"),
        F.when(F.size("hits") > 0, F.array_min(all_starts)).cast("long").alias("first_word"), F.when(F.size("hits") > 0, F.array_max(all_starts)).cast("long").alias("last_word"),
        F.when(F.size("hits") > 0, F.array_compact(F.array(*base))).otherwise(F.array().cast("array<string>")).alias("base"),
    )

    # windows that hold a prefix token: those that start at most BLOCK words before it
    hits = words.withColumn("hits", F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(prefix_tokens)), i)), lambda i: i.isNotNull())).where(F.size("hits") > 0)
    last = F.greatest(F.ceil((F.size(w) - BLOCK) / F.lit(STEP)), F.lit(0)).cast("int")
    around = lambda i: F.sequence(F.least(F.greatest(F.ceil((i - BLOCK + 1) / F.lit(STEP)), F.lit(0)).cast("int"), last), F.least(F.floor(i / F.lit(STEP)).cast("int"), last))
    windows = F.array_distinct(F.flatten(F.transform("hits", around)))
    block = lambda b: F.slice(w, b * STEP + 1, F.lit(BLOCK))
    blocks = hits.select("doc_id", "key", F.explode(F.transform(windows, block)).alias("said")).withColumn("b", F.array_distinct("said"))
    tokens = blocks.select("doc_id", "key", "said", "b", F.explode(F.filter("b", lambda x: x.isin(sorted(prefix_tokens)))).alias("token"))
    pairs = tokens.join(F.broadcast(prefixes), "token").where(F.size("b") >= F.col("need"))
    earlier = F.size(F.array_intersect(F.slice("tokens", F.lit(1), F.col("place")), F.col("b")))
    firsts = pairs.where(earlier == 0)  # each pair once, from its first shared token
    overlap = F.size(F.array_intersect("tokens", "b"))
    ordered = F.size(F.array_intersect("pairs", _pairs(F.col("said")))) >= F.col("ordered")
    matched = firsts.withColumn("share", overlap / F.col("n")).where(overlap >= F.col("need")).where(ordered)
    best = matched.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    return (
        told.join(best.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "of"), F.expr("doc_id <=> id and key = of"), "left")
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
            F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)), 6).alias("score"),
        )
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    values = ", ".join(f"({k}, '{label}', string_split('{text}', ' '))" for k, (label, text) in enumerate(TEMPLATES))
    places = " union all ".join("select doc_id, '{}' as label, i - 1 as p from x where {}".format(label, " and ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(phrase))) for label, phrase in PHRASES.items())
    return f"""
    with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    x as (select doc_id, w, unnest(generate_series(1, len(w))) as i from t),
    places as ({places}),
    b as (select doc_id, count(*) as n, min(p) as lo, max(p) as hi, list(distinct label) as base from places group by doc_id),
    blocks as (select doc_id, list_distinct(s) as b, list_transform(generate_series(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1]) as p
      from (select doc_id, w[k * {STEP} + 1 : k * {STEP} + {BLOCK}] as s from (select doc_id, w, unnest(generate_series(0, greatest(ceil((len(w) - {BLOCK}) / {STEP}), 0)::bigint)) as k from t))),
    tpl as (select k, label, list_distinct(w) as tok, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as pairs from (values {values}) v(k, label, w)),
    hit as (select doc_id, label, len(list_intersect(tok, b)) / len(tok) as share from blocks, tpl where len(list_intersect(tok, b)) >= ceil({CONTAINMENT} * len(tok) - 1e-9) and len(list_intersect(pairs, p)) >= case when list_contains(tok, 'spdx') then len(pairs) else ceil({ADJACENT} * len(pairs) - 1e-9) end),
    m as (select doc_id, list(distinct label) as more, max(share) as share from hit group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word, coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') as labels, round(greatest(coalesce(share, 0.0), case when n > 0 then 1.0 else 0.0 end)::double, 6) as score
    from t left join b using (doc_id) left join m using (doc_id)
    """
