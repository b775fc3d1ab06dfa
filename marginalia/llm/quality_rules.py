"""Operator 1: rules on length and repetition, and divergence from language references.

A document's histograms of character classes and of common words, in any case, are
compared with the same histograms summed over each language's documents by Jensen-Shannon
distance (base 2, 0 to 1). A document's own counts are taken out of its language's
reference first, so none is measured against itself. A document passes if the nearest
reference is within both thresholds; documents under ``min_words`` words are not compared
(the base rules reject them). Every language of two such documents or more has a reference. Where
a document's language has none (it is null, or held by no other document), only the base rules
count, whatever other languages are near. One pass reads the text; its counts, a few hundred bytes
a row, are checkpointed, so that the references cover all documents.

A document holds the counts of the common words that it has, by place in the list, and meets the
references in arrays of ``BLOCK`` at most: one row for up to so many languages, and as many comparisons
as there are languages beyond, of which the nearest is kept. The plan is the same for any number.

Everything stays within the row but the sum by language. Repeated windows are found
by sorting the row's own window hashes with their positions in the low bits; windows
whose high bits meet are then compared word by word.

Null or empty text has no words and fails the base rules. Extra columns are ignored;
repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, space_words, table, word_hashes

#: Frequent words of each language.
COMMON = {
    "de": "das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von war werden zu".split(),
    "en": "a and are as at be by for from he his in is it not of on or that the this to was with".split(),
    "es": "a al como con de del el en es está la las lo los más no para por que se son su un una y".split(),
    "fr": "au ce dans de des du elle en est et il la le les ne pas plus pour que qui sur un une".split(),
    "it": "alla che con da dei del della di e gli il in la le nel non per più sono un una".split(),
    "nl": "aan als de dat die een en er het in is met niet op te van voor was zijn".split(),
    "pl": "a ale do i jak jest na nie o od po się to w z za że".split(),
    "pt": "as com como da do dos e em foi mais na não o os para por que se um uma".split(),
    "sv": "att av den det en ett för har i inte med och om på som till var är".split(),
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words})
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: Within both lie 99.9 % of the documents of quality 1 in the learning folds (crc32(doc_id) mod 5
#: is not 0) of the sf0.1 tables.
MAX_CHAR_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.31
#: References in a row, and those that are broadcast; more are joined without.
BLOCK, BROADCAST_REFERENCES = 64, 4096

POSITION_BITS = 28


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words lie in 3-word windows that occur twice or more in ``words``."""
    low = (1 << POSITION_BITS) - 1
    high = lambda x: F.shiftright(x, POSITION_BITS)
    packed, cands, keyed, starts = (F.col(f"__{x}") for x in ("packed", "cands", "keyed", "starts"))
    w = F.col(words)
    df = df.withColumn("__packed", F.sort_array(F.transform(word_hashes(w, 3), lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))))
    meets = lambda x, k: F.coalesce(high(x) == high(F.get(packed, k)), F.lit(False))
    near = F.filter(packed, lambda x, k: meets(x, k - 1) | meets(x, k + 1))
    df = df.withColumn("__cands", F.transform(near, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    window = lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"))
    df = df.withColumn("__keyed", F.array_sort(F.transform(cands, lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    same = lambda x, k: F.coalesce(x["w"] == F.get(keyed, k)["w"], F.lit(False))
    df = df.withColumn("__starts", F.sort_array(F.transform(F.filter(keyed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.transform(starts, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - i, F.lit(3))))
    return df.withColumn(out, F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("__packed", "__cands", "__keyed", "__starts")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules and both histograms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("__text"), space_words(text).alias("__w"))
    df = repeat_words(df, "__w", "n_repeat_words")
    text, w, n = F.col("__text"), F.col("__w"), F.length("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id", "lang", F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (n - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"), lines.alias("__lines"), "n_repeat_words",
        n.cast("long").alias("n_chars"), (n - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("__upper"), (n - F.length(_without(text, "0123456789"))).alias("__digits"),
        (n - F.length(_without(text, "!?"))).alias("__marks"), (n - F.length(_without(text, ".,;:"))).alias("__stops"), (F.octet_length(text) - n).alias("__beyond"),
        F.sort_array(F.filter(F.transform(w, F.lower), lambda x: x.isin(COMMON_WORDS))).alias("__common"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    known = [space, *(F.col(c) for c in ("n_symbols", "__upper", "__digits", "__marks", "__stops", "__beyond"))]
    rest = F.greatest(F.col("n_chars") - sum(known[1:], known[0]), F.lit(0))
    c, ends = F.col("__common"), F.col("__ends")
    df = df.withColumn("__ends", F.filter(F.sequence(F.lit(0), F.size(c)), lambda i: F.coalesce(F.get(c, i) != F.coalesce(F.get(c, i + 1), F.lit("")), F.lit(False))))
    place = lambda w: F.array_position(F.array(*map(F.lit, COMMON_WORDS)), w).cast("int")
    common = F.transform("__ends", lambda i, k: F.struct(place(F.get(c, i)).alias("at"), (i - F.coalesce(F.get(ends, k - 1), F.lit(-1))).cast("long").alias("n")))
    other = F.array(F.struct(F.lit(len(COMMON_WORDS) + 1).alias("at"), (F.col("n_words") - F.size(c)).alias("n")))
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.array(*(c.cast("long") for c in [*known, rest])).alias("chars"), F.concat(common, other).alias("words"), F.monotonically_increasing_id().alias("row"),
    )


def references(counts: DataFrame, min_words: int) -> DataFrame:
    """lang, chars and words (counts by place), and their totals, of every language of two documents or more."""
    held = counts.where(F.col("lang").isNotNull() & (F.col("n_words") >= min_words))
    chars = held.groupBy("lang").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("chars")[k]) for k in range(8))).alias("chars")).where("n > 1")
    words = held.select("lang", F.inline("words")).groupBy("lang", "at").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("found"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON_WORDS) + 1)), lambda k: F.coalesce(F.try_element_at("found", k), F.lit(0).cast("long")))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    told = chars.join(words, "lang").select("lang", "chars", dense.alias("words"))
    return told.select("lang", "chars", "words", total("chars").alias("all_chars"), total("words").alias("all_words"))


def _part(a: Column, b: Column) -> Column:
    """What shares a and b at one place add to twice the squared distance."""
    one = lambda x: F.when(x > 0, x * F.log2(x / ((a + b) / 2))).otherwise(0.0)
    return one(a) + one(b)


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def distances(r: Column) -> Column:
    """The row's distances from one reference, without the row's own counts if it is of that language."""
    own = F.coalesce(F.col("lang") == r["lang"], F.lit(False)).cast("long")
    rest = lambda whole, mine: F.greatest(whole - own * mine, F.lit(1))
    zero = F.lit(0.0)
    n_chars, n_words = F.col("__chars"), F.col("__words")
    all_chars, all_words = rest(r["all_chars"], n_chars), rest(r["all_words"], n_words)
    by_char = F.aggregate(F.zip_with("chars", r["chars"], lambda v, a: _part(v / F.greatest(n_chars, F.lit(1)), (a - own * v) / all_chars)), zero, lambda s, x: s + x)
    share = lambda w: (F.get(r["words"], w["at"] - 1) - own * w["n"]) / all_words
    by_word = F.aggregate("words", zero, lambda s, w: s + _part(w["n"] / F.greatest(n_words, F.lit(1)), share(w)))
    # at places that the row lacks, the reference's share counts whole
    seen = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.get(r["words"], w["at"] - 1) - own * w["n"])
    lacking = (r["all_words"] - own * n_words - seen) / all_words
    return F.struct(_root(by_char).alias("chars"), _root(by_word + lacking).alias("words"))


def judge(counts: DataFrame, min_words: int, max_chars: float, max_words: float) -> DataFrame:
    """Adds the nearest reference's distances and the verdicts to checkpointed features."""
    told = durable(references(counts, min_words))
    n = told.count()
    blocks = -(-n // BLOCK)
    block = F.pmod(F.xxhash64("lang"), F.lit(max(blocks, 1)))
    held = told.groupBy(block.alias("block")).agg(F.collect_list(F.struct("lang", "chars", "words", "all_chars", "all_words")).alias("references")).select("references")
    counts = counts.withColumns({"__chars": F.aggregate("chars", F.lit(0).cast("long"), lambda s, v: s + v), "__words": F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["n"])})
    met = counts.join(F.broadcast(held) if n <= BROADCAST_REFERENCES else held, F.lit(True), "left")
    summed = lambda p: F.struct((p["chars"] + p["words"]).alias("sum"), p["chars"].alias("chars"), p["words"].alias("words"))
    long = F.col("n_words") >= min_words
    met = met.withColumn("__known", F.exists("references", lambda r: F.coalesce(r["lang"] == F.col("lang"), F.lit(False))))
    met = met.withColumn("__near", F.when(long, F.array_min(F.transform(F.transform("references", distances), summed)))).drop("references")
    if blocks > 1:
        others = [c for c in met.columns if c not in ("row", "__known", "__near")]
        met = met.groupBy("row").agg(*(F.first(c).alias(c) for c in others), F.bool_or("__known").alias("__known"), F.min("__near").alias("__near"))
    met = met.withColumn("__near", F.when(F.col("__known"), F.col("__near")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    close = (F.coalesce("__near.chars", F.lit(0.0)) <= max_chars) & (F.coalesce("__near.words", F.lit(0.0)) <= max_words)
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & close).alias("kept"),
        F.round("__near.chars", 6).alias("char_distance"), F.round("__near.words", 6).alias("word_distance"),
    )


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_chars: float = MAX_CHAR_DISTANCE, max_words: float = MAX_WORD_DISTANCE) -> DataFrame:
    return judge(durable(features(docs)), min_words, max_chars, max_words)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def oracle() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    stripped = lambda cs: "length(text) - length(" + "replace(" * len(cs) + "text" + "".join(f", '{c}', '')" for c in cs) + ")"
    part = "list_sum(list_transform(generate_series(1, len({p})), lambda k: case when {p}[k] > 0 then {p}[k] * log2({p}[k] / (({p}[k] + {q}[k]) / 2)) else 0.0 end))"
    js = lambda p, q: f"sqrt(greatest(({part.format(p=p, q=q)} + {part.format(p=q, q=p)}) / 2, 0.0))"
    share = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1))"
    return f"""
    with t as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
    grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from t where len(w) > 2)),
    twice as (select doc_id, i from grams qualify count(*) over (partition by doc_id, g) > 1),
    reps as (select doc_id, count(distinct i + o) as n from twice, (values (0), (1), (2)) v(o) group by doc_id),
    f as (select t.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, ({stripped(SYMBOLS)})::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(reps.n, 0)::bigint as n_repeat_words, length(text) as n_chars,
        length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) as up, {stripped('0123456789')} as digits, {stripped('!?')} as marks, {stripped('.,;:')} as stops, strlen(text) - length(text) as beyond,
        list_transform({listed(COMMON_WORDS)}, lambda c: len(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x = c))) as cw from t left join reps using (doc_id)),
    h as (select *, [n_chars - word_chars, n_symbols, up, digits, marks, stops, beyond, greatest(n_chars - (n_chars - word_chars) - n_symbols - up - digits - marks - stops - beyond, 0)] as ch,
        list_concat(cw, [n_words - coalesce(list_sum(cw), 0)::bigint]) as wh from f),
    s as (select lang, k, sum(ch[k])::bigint as c, sum(wh[k])::bigint as w, count(*) as n from (select lang, ch, wh, unnest(generate_series(1, len(wh))) as k from h where lang is not null and n_words >= {MIN_WORDS}) group by all),
    r as (select lang as rl, max(n) as rn, list(coalesce(c, 0) order by k) filter (where k <= 8) as rc, list(w order by k) as rw from s group by lang having max(n) > 1),
    o as (select doc_id, ch, wh, case when lang = rl then list_transform(generate_series(1, len(rc)), lambda k: rc[k] - ch[k]) else rc end as rc, case when lang = rl then list_transform(generate_series(1, len(rw)), lambda k: rw[k] - wh[k]) else rw end as rw
        from h, r where n_words >= {MIN_WORDS} and lang in (select rl from r)),
    d as (select doc_id, {js('pc', 'qc')} as cd, {js('pw', 'qw')} as wd from (select doc_id, {share('ch')} as pc, {share('wh')} as pw, {share('rc')} as qc, {share('rw')} as qw from o)),
    b as (select doc_id, arg_min(cd, cd + wd) as cd, arg_min(wd, cd + wd) as wd from d group by doc_id),
    v as (select h.*, cd, wd, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from h left join b using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and coalesce(cd, 0) <= {MAX_CHAR_DISTANCE} and coalesce(wd, 0) <= {MAX_WORD_DISTANCE} as kept, round(cd, 6) as char_distance, round(wd, 6) as word_distance from v
    """
