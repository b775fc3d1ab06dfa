"""References of any number of languages."""

from __future__ import annotations

import random

from marginalia.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string"


def text(rng, letters: str) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(60)) + " the of und la"


def told(spark, rows):
    return sorted(map(tuple, quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_no_language_is_left_out(spark):
    rng = random.Random(1)
    rows = [(3 * k + j, text(rng, "abcdefgh") if j < 2 else text(rng, "01?!;"), f"x{k:03}") for k in range(90) for j in range(3)]
    verdicts = {r[0]: (r[7], r[8]) for r in told(spark, rows)}
    assert len(verdicts) == 270 and all(d is not None for _, d in verdicts.values())


def test_blocks_do_not_change_the_nearest(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, text(rng, "abcdefghij"[k % 5 :]), rng.choice(["a", "b", "c", "d", "once", None])) for k in range(80)] + [(7, None, "a"), (7, "", "b"), (None, text(rng, "abc"), "c"), (None, text(rng, "abc"), "c")]
    key = lambda rs: sorted(rs, key=str)
    frame = spark.createDataFrame(rows, SCHEMA)
    run = lambda: key(map(tuple, quality_rules.quality_rules(frame).collect()))
    whole = run()
    monkeypatch.setattr(quality_rules, "BLOCK", 1)
    monkeypatch.setattr(quality_rules, "BROADCAST_REFERENCES", 0)
    assert run() == whole
