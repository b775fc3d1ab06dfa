"""Chat formatting: what comes back, and against a plain parser."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from marginalia.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]"]
PAIRS = {"[INST]": ("[/INST]", "user"), "<s>": ("</s>", "assistant"), "<<SYS>>": ("<</SYS>>", "system")}


def plain_parse(s: str):
    """A hand-written parser: at each place exactly one opening mark must stand."""
    clean = lambda t: re.sub(r"([<\[])(\\*)\\(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|/?TEXT\])", r"\1\2\3", t)
    out, at, spans = [], 0, []
    while at < len(s):
        role = None
        if s.startswith("[ROLE]", at):
            end = s.index("[/ROLE]", at)
            role, at = clean(s[at + 6 : end]), end + 7
            opens, closes = "[TEXT]", "[/TEXT]"
        else:
            opens = next(m for m in PAIRS if s.startswith(m, at))
            closes, role = PAIRS[opens]
        assert s.startswith(opens, at)
        end = s.index(closes, at)
        body = s[at + len(opens) : end]
        assert not any(m in body for m in MARKS)
        if opens == "<s>":
            spans.append((at + len(opens), len(body)))
        out.append((role, clean(body)))
        at = end + len(closes)
    return out, spans


def convs(n: int):
    rng = random.Random(4)
    bits = [*MARKS, "\\", "<", "[", "/", ">", "]", "<\\s>", "[\\\\INST]", "hello", " ", "\n", "é", "😀", "INST]", "$1", ""]
    return [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "[ROLE]", "", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(9)))])) for c in range(n) for t in range(rng.randrange(1, 6))]


def expected(rows):
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (turns, (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return out


@pytest.mark.parametrize("rows", [convs(150), [(1, 0, "user", "word " * 40_000), (1, 1, "assistant", "</s> \\ " * 9_000)], [(1, 0, "assistant", "a")] * 3 + [(None, None, None, None), (None, 2, "user", "x"), (None, None, "user", "b")], [(5, t, "assistant", f"t{t}") for t in range(1200)]], ids=["marks", "long", "repeats", "many turns"])
def test_turns_and_loss_come_back(spark, rows):
    chats = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    want = expected(rows)
    seen = {r["conv_id"]: r for r in chats.collect()}
    assert seen.keys() == want.keys()
    for c, r in seen.items():
        turns, spans = plain_parse(r["formatted"])
        assert turns == want[c][0] and spans == [tuple(s) for s in r["loss"]]
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chats).collect()} == {c: w[1] for c, w in want.items()}


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain [x] <b> \\ text"), (1, 1, "assistant", "ends with <"), (2, 0, "user", "has </s>"), (2, 1, "assistant", "and [\\INST]"), (3, 0, "tool", "ok"), (3, 1, "a[/ROLE]b", "ok")]
    told = {r["conv_id"]: (r["formatted"], r["n_escaped"]) for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert told == {1: ("[INST]plain [x] <b> \\ text[/INST]<s>ends with <</s>", 0), 2: ("[INST]has <\\/s>[/INST]<s>and [\\\\INST]</s>", 2), 3: ("[ROLE]tool[/ROLE][TEXT]ok[/TEXT][ROLE]a[\\/ROLE]b[/ROLE][TEXT]ok[/TEXT]", 1)}


@pytest.mark.parametrize("bad", ["[INST]a", "a[INST]b[/INST]", "[INST]a[/INST]b", "[INST]a</s>", "[/INST]a[INST]", "[TEXT]a[/TEXT]", "[ROLE]a[/ROLE]", "[ROLE]r[/ROLE][INST]a[/INST]", "[INST]a[TEXT]b[/TEXT][/INST]", "[INST][INST]a[/INST][/INST]"])
def test_what_breaks_the_grammar_has_no_turns(spark, bad):
    assert chat.parsed(spark.createDataFrame([(bad,)], "formatted string")).first()["turns"] is None


def test_a_mask_beside_the_texts_stops_the_job(spark):
    chats = chat.format_chat(spark.createDataFrame([(1, 0, "assistant", "abc")], SCHEMA))
    moved = chats.selectExpr("conv_id", "formatted", "transform(loss, s -> named_struct('start', s.start + 1, 'length', s.length)) as loss")
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(moved).collect()


def test_empty_and_clashing_columns(spark):
    assert chat.digests(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = spark.createDataFrame(convs(20), SCHEMA)
    same = lambda df: sorted(map(tuple, chat.digests(chat.format_chat(df)).collect()), key=str)
    assert same(rows.selectExpr("*", "'x' as frame", "1 as start", "2 as escaped", "'y' as __plain", "'z' as formatted", "3 as rows")) == same(rows)
