"""Operator 12: chat formatting with a grammar round trip.

A turn is a frame, a mark that opens it, its text and the mark that closes it; the marks tell
the role. A role without marks of its own is spoken as two frames, its name and its text:

    conversation := turn*
    turn         := [INST] text [/INST]        (user)
                  | <s> text </s>              (assistant)
                  | <<SYS>> text <</SYS>>      (system)
                  | [ROLE] name [/ROLE][TEXT] text [/TEXT]

``parsed`` is the deterministic parser of this grammar: it cuts the text at every mark and
requires open and close to alternate and to belong together, and nothing between frames.
What would read as a mark inside a text is escaped by a backslash after its first character;
such a sequence in the text that has backslashes already gets one more, and the parser takes
one away, so escaping loses nothing. Each turn is rendered as it is and parsed; only where
what comes back differs from the source is its text escaped. The whole conversation is parsed again
once it is put together and compared with its source turns; a difference stops the job.

``loss`` lists the spans (start from 0, length, in code points) of the formatted text that belong to
assistants; ``read_back`` holds them against the places where the parser found these texts.

Rows are ordered by turn, then role and text; null turns come first. Null text and null roles
count as empty. A null conv_id is a conversation of its own. Repeated rows are repeated turns.
An empty table gives an empty result; extra columns are ignored. A conversation is one record, so its
formatted text must fit a string; offsets are counted by a window before its turns are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT = ("[ROLE]", "[/ROLE]"), ("[TEXT]", "[/TEXT]")
FRAMES = [*MARKS.values(), ROLE, TEXT]
#: What follows the first character of a mark.
REST = "(/?s>|</?SYS>>|/?INST\\]|/?ROLE\\]|/?TEXT\\])"
CONTROL = "[<\\[]" + REST
ESCAPABLE, ESCAPED = "([<\\[])(\\\\*)" + REST, "([<\\[])(\\\\*)\\\\" + REST
TURN = "struct<role: string, text: string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, "$1$2\\\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def rendered(role: Column, text: Column) -> Column:
    """The frames of one turn; role and text are escaped already, if they have to be."""
    out = F.concat(F.lit(ROLE[0]), role, F.lit(ROLE[1] + TEXT[0]), text, F.lit(TEXT[1]))
    for name, (opens, closes) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(opens), text, F.lit(closes))).otherwise(out)
    return out


def with_frames(df: DataFrame, formatted: str, out: str) -> DataFrame:
    """Adds the frames of a formatted text, (opens, text as it stands), or null if it does not
    follow the grammar."""
    marks, pieces = F.col("__marks"), F.col("__pieces")
    df = df.withColumns({"__marks": F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)), "__pieces": F.split(formatted, CONTROL, -1)})
    n = F.size(marks)
    pairs = F.array(*(F.lit(a + b) for a, b in FRAMES))
    even = F.filter(pieces, lambda _, i: i % 2 == 0)
    frames = F.transform(F.filter(marks, lambda _, i: i % 2 == 0), lambda m, i: F.struct(m.alias("opens"), F.get(marks, 2 * i + 1).alias("closes"), F.get(pieces, 2 * i + 1).alias("text")))
    frames = F.when((n % 2 == 0) & ~F.exists(even, lambda x: x != ""), frames)
    df = df.withColumn(out, frames).drop("__marks", "__pieces")
    f = F.col(out)
    paired = F.forall(f, lambda x: F.array_contains(pairs, F.concat(x["opens"], x["closes"])))
    spoken = ~F.exists(F.transform(f, lambda x, i: (x["opens"] == ROLE[0]) != (F.coalesce(F.get(f, i + 1)["opens"], F.lit("")) == TEXT[0])), lambda odd: odd)
    first = F.coalesce(F.get(f, 0)["opens"] != TEXT[0], F.lit(True))
    return df.withColumn(out, F.when(paired & spoken & first, f))


def turns_of(frames: Column) -> Column:
    """The turns (role, text) of parsed frames."""
    named = lambda x, i: F.when(x["opens"] == TEXT[0], unescape(F.get(frames, i - 1)["text"])).otherwise(_role(x["opens"]))
    told = F.transform(frames, lambda x, i: F.struct(x["opens"].alias("opens"), named(x, i).alias("role"), unescape(x["text"]).alias("text")))
    return F.transform(F.filter(told, lambda x: x["opens"] != ROLE[0]), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))


def _role(opens: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (mark, _) in MARKS.items():
        out = F.when(opens == mark, name).otherwise(out)
    return out


def parsed(df: DataFrame, formatted: str = "formatted", turns: str = "turns") -> DataFrame:
    """Adds ``turns``, array<struct<role, text>>, read back from a formatted text: null if it does
    not follow the grammar."""
    return with_frames(df, formatted, "__frames").withColumn(turns, turns_of(F.col("__frames"))).drop("__frames")


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (the spans that are learned), and n_escaped, turns that were."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    source = F.array(F.struct("role", "text"))
    plain = parsed(rows.withColumn("__plain", rendered(F.col("role"), F.col("text"))), "__plain", "__back")
    told = plain.withColumn("escaped", ~F.coalesce(F.col("__back") == source, F.lit(False))).drop("__plain", "__back")
    frame = rendered(*(F.when(F.col("escaped"), escape(F.col(c))).otherwise(F.col(c)) for c in ("role", "text")))
    told = told.withColumn("frame", frame)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("start", F.coalesce(F.sum(F.length("frame")).over(before), F.lit(0).cast("long")))
    opens, closes = MARKS["assistant"]
    span = F.when(F.col("role") == "assistant", F.struct((F.col("start") + len(opens)).alias("start"), (F.length("frame") - len(opens + closes)).cast("long").alias("length")))
    row = F.struct("start", "turn", "role", "text", "escaped", "frame", span.alias("span"))  # by start: the order of the window
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    whole = whole.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["frame"]), "").alias("formatted"), F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.size(F.filter("rows", lambda r: r["escaped"])).alias("n_escaped"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("__source"),
    )
    whole = parsed(whole, "formatted", "__turns")
    same = F.coalesce(F.col("__turns") == F.col("__source"), F.lit(False))
    return whole.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its format"))).alias("formatted"), "loss", "n_escaped")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and loss_text, all of the text under the loss mask, from formatted text and
    mask alone. The mask must lie where the parser finds the assistants' texts: both are folded
    into a number, in one pass over each."""
    df = with_frames(chats, "formatted", "__frames")
    frames = F.col("__frames")
    closing = F.create_map(*(F.lit(x) for a, b in FRAMES for x in (a, len(a + b))))
    opens = MARKS["assistant"][0]
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("h"))
    found = F.aggregate(
        frames, zero,
        lambda s, x: F.struct((s["at"] + F.element_at(closing, x["opens"]) + F.length(x["text"])).cast("long").alias("at"), F.when(x["opens"] == opens, F.xxhash64(s["h"], s["at"] + len(opens), F.length(x["text"]).cast("long"))).otherwise(s["h"]).alias("h")),
        lambda s: s["h"],
    )
    masked = F.aggregate("loss", F.lit(0).cast("long"), lambda h, s: F.xxhash64(h, s["start"].cast("long"), s["length"].cast("long")))
    learned = F.array_join(F.transform(F.filter(frames, lambda x: x["opens"] == opens), lambda x: unescape(x["text"])), "")
    text = F.when(found == masked, learned).otherwise(F.raise_error(F.lit("the loss mask does not lie on the assistants' texts")))
    return df.withColumns({"turns": turns_of(frames), "loss_text": text}).select("conv_id", "formatted", "turns", "loss_text")


def digests(chats: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold marks.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select cast(c as long) as conv_id, cast(t as long) as turn, role, text from values {', '.join(map(str, PROBE))} as v(c, t, role, text)")
    return digests(format_chat(given.unionByName(probe)))


def oracle() -> str:
    """What must come back, from the source rows."""
    esc = lambda c: f"regexp_replace({c}, '{ESCAPABLE}', '\\1\\2\\\\\\3', 'g')"
    more = " ".join(f"when '{name}' then {len(a + b)}" for name, (a, b) in MARKS.items())
    other = sum(map(len, ROLE + TEXT))
    return f"""
    with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations
        union all select * from (values {', '.join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in PROBE)}) v)),
    f as (select *, case role {more} else {other} + length({esc('role')}) end + length({esc('text')}) as n from c)
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
    from f group by conv_id
    """
