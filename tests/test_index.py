"""The stored index: deltas, deletes, merges, other sessions; phrases by positions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators import search
from marginalia.sources import index as ix
from marginalia.sources import vault
from marginalia.sources.index import Index

SCHEMA = "title string, folder string, path string, mtime timestamp_ntz, raw string"
WORDS = "alpha beta gamma delta omega the of".split()


def rows(spark, texts: dict[str, str]):
    return spark.createDataFrame([(p, "f", f"f/{p}.md", None, t) for p, t in texts.items()], SCHEMA)


def texts(n: int, seed: int = 1) -> dict[str, str]:
    rng = random.Random(seed)
    return {f"n{k}": " ".join(rng.choices(WORDS, k=rng.randrange(12))) + (f" [[n{k + 1}]]" if k % 3 == 0 else "") for k in range(n)}


def content(index: Index) -> dict[str, list]:
    """Everything that the index tells, in one order of columns."""
    out = {name: sorted(map(str, getattr(index, name).all().select(*sorted(getattr(index, name).all().columns)).collect())) for name in ix.KEYS}
    return out | {"notes": sorted(map(str, index.notes.collect())), "totals": index.mark["totals"]}


def full(spark, at, held: dict[str, str]) -> Index:
    return Index(spark, str(at)).commit(vault.notes(rows(spark, held)))


def test_change_sets_and_merges_tell_what_a_full_build_tells(spark, tmp_path, monkeypatch):
    held = texts(40)
    index = full(spark, tmp_path / "a", held)
    for k, (changed, gone) in enumerate([({"n3": "zebra the", "new1": "of the [[n3]]"}, ["n5", "none"]), ({"n3": "again", "n5": "back omega"}, ["new1"]), ({}, ["n3", "n9"]), ({"n9": "the the"}, [])]):
        index = index.commit(vault.notes(rows(spark, changed)) if changed else None, rows(spark, dict.fromkeys(gone, "")).select("path") if gone else None)
        held = {p: t for p, t in held.items() if p not in gone} | changed
        assert content(index) == content(full(spark, tmp_path / f"full{k}", held))
    assert [s["rows"] for s in index.mark["segments"]] == [40, 2, 2, 1]
    merged = index.merged(2)
    assert len(merged.mark["segments"]) < 4 and content(merged) == content(index)
    merged.vacuum()
    assert content(Index.open(spark, str(tmp_path / "a"))) == content(full(spark, tmp_path / "last", held))
    left = {p.name for p in (tmp_path / "a").iterdir() if p.name.startswith(("segment", "deletes"))}
    assert left == {x["path"].rsplit("/", 1)[-1] for x in merged.mark["segments"] + merged.mark["deletes"]}


def test_another_session_opens_what_was_committed(spark, tmp_path):
    held = texts(12)
    full(spark, tmp_path / "i", held)
    other = Index.open(spark.newSession(), str(tmp_path / "i"))
    assert other.mark["commit"] == 1 and content(other)["totals"]["docs"] == 12
    assert search.bm25_search(other.notes, "alpha beta", index=other.postings).count() == min(10, sum(bool({"alpha", "beta"} & set(t.split())) for t in held.values()))
    assert Index.open(spark, str(tmp_path / "none")).notes.count() == 0
    (tmp_path / "i" / "segment-9-unfinished").mkdir()  # what no commit names is not there
    assert content(Index.open(spark, str(tmp_path / "i"))) == content(other)


def test_only_changed_notes_are_synced(spark, tmp_path):
    held = texts(30)
    seen = []
    extract = lambda v: vault.notes(v).transform(lambda n: seen.append(n.count()) or n)
    index = Index(spark, str(tmp_path / "s")).synced(rows(spark, held), extract, "one")
    assert index.synced(rows(spark, held), extract, "one") is index
    changed = {p: t for p, t in held.items() if p != "n7"} | {"n1": "other words", "n50": "more"}
    index = index.synced(rows(spark, changed), extract, "two")
    assert seen == [30, 2] and content(index) == content(full(spark, tmp_path / "t", changed))
    same = index.synced(rows(spark, changed), extract, "three")
    assert same.mark["state"] == "three" and content(same) == content(index)


def test_forks_share_segments_and_nothing_else(spark, tmp_path):
    base = full(spark, tmp_path / "b", texts(8))
    before = content(base)
    fork = base.forked(str(tmp_path / "f")).commit(None, rows(spark, {"n1": ""}).select("path"))
    assert fork.mark["totals"]["docs"] == 7 and content(Index.open(spark, str(tmp_path / "b"))) == before
    assert Index.open(spark, str(tmp_path / "f")).mark["segments"][0]["path"] == base.mark["segments"][0]["path"]


def test_a_query_reads_the_folders_of_its_tokens(spark, tmp_path):
    index = full(spark, tmp_path / "q", texts(60))
    read, whole = index.postings.of(["alpha"]).inputFiles(), index.postings.all().inputFiles()
    assert len({f.split("/bucket=")[1].split("/")[0] for f in read}) == 1 < len({f.split("/bucket=")[1].split("/")[0] for f in whole})
    assert index.postings.of([]).count() == 0 and index.postings.of(["nowhere"]).count() == 0


def test_a_commit_without_notes(spark, tmp_path):
    index = full(spark, tmp_path / "e", {})
    assert index.mark["totals"]["docs"] == 0 and index.postings.all().count() == 0
    index = index.commit(vault.notes(rows(spark, {"a": "one"})))
    assert [r["token"] for r in index.postings.of(["one"]).collect()] == ["one"]


@pytest.mark.parametrize("query", [{"phrase": "the of"}, {"phrase": "the the"}, {"phrase": "the of the"}, {"phrase": "alpha"}, {"must": ["alpha", "BETA"]}, {"should": ["alpha", "zebra"], "must_not": ["of"]}, {"must_not": ["the", "of"]}, {"must": ["alpha"], "phrase": "beta gamma", "must_not": ["omega"]}, {"phrase": "n1 alpha"}, {"phrase": "!"}, {"must": ["zebra"]}, {}])
@pytest.mark.parametrize("stored", [False, True])
def test_clauses_and_phrases_against_plain_python(spark, tmp_path, query, stored):
    held = texts(80, 5)
    n = vault.notes(rows(spark, held))
    index = full(spark, tmp_path / "p", held).postings if stored else None
    want = set()
    for p, t in held.items():
        w = re.findall(r"\w+", f"{p} {t}".lower())
        ok = all(x.lower() in w for x in query.get("must", ())) and not any(x in w for x in query.get("must_not", ())) and (not query.get("should") or any(x in w for x in query["should"]))
        f = re.findall(r"\w+", query.get("phrase", ""))
        if ok and (not f or any(w[i : i + len(f)] == f for i in range(len(w)))):
            want.add(f"f/{p}.md")
    assert {r["path"] for r in search.search_bool(n, **query, index=index).collect()} == want


def test_positions_count_over_title_and_body(spark):
    told = search.posting_rows(vault.notes(rows(spark, {"The end": "end of the end"})).withColumn("title", F.lit("The end"))).collect()
    assert {(r["field"], r["token"]): (r["tf"], r["length"], r["positions"]) for r in told} == {("title", "the"): (1, 2, [0]), ("title", "end"): (1, 2, [1]), ("body", "end"): (2, 4, [2, 5]), ("body", "of"): (1, 4, [3]), ("body", "the"): (1, 4, [4])}


def damerau(a: str, b: str) -> bool:
    """Within one edit."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("stored", [False, True])
def test_titles_by_edits_and_parts(spark, tmp_path, stored):
    rng = random.Random(9)
    titles = ["".join(rng.choices("abc ", k=rng.randrange(1, 9))).strip() or "a" for _ in range(60)] + ["A long title of more than thirty two characters, with an end", "Über Größe"]
    frame = spark.createDataFrame([(t, "f", f"f/{k}.md", None, "x") for k, t in enumerate(titles)], SCHEMA)
    n = vault.notes(frame)
    index = Index(spark, str(tmp_path / "t")).commit(n).titles if stored else None
    for q in ("ab", "abc ba", "acb", "cc c"):
        want = {f"f/{k}.md": s for k, t in enumerate(titles) if (s := sum(max((2 if w == v else 1) if damerau(w, v) else 0 for w in [v2]) for v in dict.fromkeys(q.split()) for v2 in dict.fromkeys(t.lower().split())))}
        assert {r["path"]: r["score"] for r in search.fuzzy_suggest(n, q, 1000, index).collect()} == want
    for q in ("b", "ab", "of more than thirty two characters, with", "über", "zzz"):
        want = {(f"f/{k}.md", 1 if t.lower().startswith(q) else 2) for k, t in enumerate(titles) if q in t.lower()}
        assert {(r["path"], r["tier"]) for r in search.suggest(n, q, 20, index).collect() if r["tier"] < 3} <= want
        assert {r["path"] for r in search._containing(n, q, index).collect()} == {p for p, _ in want}
        assert [r["name"] for r in search.complete(n, q, index).collect()] == sorted({t for t in titles if q in t.lower()}, key=lambda t: (not t.lower().startswith(q), t))[:5]


def test_tables_are_written_when_they_are_asked_for(spark, tmp_path):
    from marginalia.sources.store import Corpus

    docs = spark.range(30).selectExpr("id as doc_id", "concat('word', id, ' the') as text", "'en' as lang", "'s' as source", "5L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpus = Corpus(spark, str(tmp_path))
    assert corpus.notes.count() == 30 and corpus.index.held == []
    assert {r["n"] for r in corpus.postings.of(["word7"]).groupBy("path").agg(F.count("*").alias("n")).collect()} == {1} and corpus.index.held == ["postings"]
    assert Corpus(spark, str(tmp_path)).index.held == ["postings"]  # and they stay
    # a changed input brings rows of what is held; what is asked for later is written for both segments
    docs.limit(2).selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    grown = Corpus(spark, str(tmp_path))
    assert len(grown.index.mark["segments"]) == 2 and grown.index.held == ["postings"] and grown.index.mark["deletes"]
    told = content(grown.having(*ix.KEYS))
    assert told == content(Index(spark, str(tmp_path / "full")).commit(grown.whole)) and told["totals"]["docs"] == 32
    assert content(grown.index.merged(2)) == told


def test_postings_of_more_notes_than_are_sorted_at_once(spark, monkeypatch):
    """Runs end with the note, and positions with null and empty texts are those of plain Python."""
    held = texts(70, 3) | {"é": "Straße straße ß 12", "none": ""}
    frame = vault.notes(rows(spark, held)).select("path", "title", "body").union(spark.createDataFrame([("x", None, "a a"), ("y", "b", None)], "path string, title string, body string")).coalesce(1)
    want = set()
    for r in frame.collect():
        title, body = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (r["title"], r["body"]))
        for field, words, first in (("title", title, 0), ("body", body, len(title))):
            want |= {(w, r["path"], field, words.count(w), len(words), tuple(first + i for i, x in enumerate(words) if x == w)) for w in words}
    batches = frame.select("path", search.T.words(F.col("title")).alias("title"), search.T.words(F.col("body")).alias("body")).toArrow().to_batches()
    monkeypatch.setattr(search, "NOTES_AT_ONCE", 7)
    cut = [(*(d[c] for c in ("token", "path", "field", "tf", "length")), tuple(d["positions"])) for b in search._placed(iter(batches)) for d in b.to_pylist()]
    told = [(r["token"], r["path"], r["field"], r["tf"], r["length"], tuple(r["positions"])) for r in search.posting_rows(frame).collect()]
    assert len(cut) == len(told) == len(want) and set(cut) == set(told) == want
    assert [r["n"] for r in spark.createDataFrame([("a  b_c İx",), ("",), (None,), ("..",)], "t string").select(search.T.n_words(F.col("t")).alias("n")).collect()] == [len(re.findall(r"[^\W_]+", "a b c i x")), 0, None, 0]


def test_grams_of_stored_notes_take_tags_from_there_and_search_a_text_for_ideographs_once(spark, tmp_path):
    held = texts(20, 5) | {"cjk": "one 日本語 b 語 x漢 #tag", "none": ""}
    index = Index(spark, str(tmp_path)).commit(vault.notes(rows(spark, held)), first=[])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    told, alone = ix.tables(vault.notes(rows(spark, held)), index.rows("notes")), ix.tables(vault.notes(rows(spark, held)))
    assert "PythonUDF" in plan(alone["grams"]) or "EvalPython" in plan(alone["grams"])
    for name in ("grams", "links", "titles"):
        assert "PythonUDF" not in plan(told[name]) and "EvalPython" not in plan(told[name])
        assert sorted(map(str, told[name].collect())) == sorted(map(str, alone[name].collect()))
    text = spark.createDataFrame([("one 日本語 b 語 x漢",), (None,), ("",)], "t string")
    grams = text.select(search.T.ngrams(F.col("t")).alias("g"))
    assert grams._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [r["g"] for r in grams.collect()] == [["one", "日本語", "語", "x漢", "日", "本", "語", "語", "漢", "日本", "本語"], None, []]
