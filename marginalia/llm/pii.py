"""Operator 4: format-preserving pseudonyms by keyed Feistel permutations.

Mail addresses, phone numbers with separators or a country code, card and account numbers,
IPv4 addresses, identity numbers, dates in digits, and two kinds of secrets (cloud keys that begin
with AKIA; 12 hex digits or more after password, passwd, secret, token or api_key and = or :)
are found by pattern and validated (checksums, octet ranges, calendar, number ranges). Other
secrets, IPv6 addresses and dates in words are not looked for. A value is permuted within its own format by a Feistel
network whose round function is keyed SHA-256: equal values get equal pseudonyms in
every document, different values of a format get different ones. A card keeps its
length, first digit, separators and a right checksum; an account number its country
and right check digits; a phone number its country code; an address its shape and last
label; a date stays a date, and one that can only be day-first stays one.

The key is the caller's. ``session_key`` reads it from ``spark.marginalia.pii.key``; where
that is unset it draws one for the session, so that values stay linked within the
session and nobody can turn them back. The key is a literal of the plan: event logs and
plans are as secret as the key.

Everything is a column expression over the row: no shuffle, no Python. Patterns repeat
only characters, or groups a bounded number of times, so that no text, however long,
deepens the stack.

Null text stays null; text without personal data is returned as it is. All columns
are kept; ``pii_found`` counts validated values, also those that the permutation maps to
themselves (an input column of that name is replaced). Matches that fail validation
are left alone.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

KEY_SETTING = "spark.marginalia.pii.key"
ROUNDS = 8

#: How each kind is written.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
#: Country codes of telephone numbers: none is the beginning of another.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PHONE = rf"(?<![\w+(])(?:(?:\+1[ .-]?)?(?:\(\d{{3}}\)[ .-]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}|{COUNTRY}(?:[ .-]?\(\d{{1,4}}\)|[ .-]?\d{{2,4}})(?:[ .-]?\d{{2,4}}){{1,5}})(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
#: Cards as they are issued, and the longest other run; neither runs into what begins a value of its own.
ISSUED = r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)"
_NEXT = rf"[ -](?!{DATE}|{IPV4}|{SSN}|{PHONE}|{ISSUED})"
CARD = rf"(?<![\w-])(?:\d{{4}}(?:[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}}|[ -]\d{{6}}[ -]\d{{5}})(?!\w)(?:{_NEXT}\d{{1,4}}(?!\w))?|\d(?:\d|{_NEXT}\d){{12,18}}(?!\w))"
CLOUD_KEY = r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
NAMED = r"(?i:password|passwd|secret|token|api_key) {0,2}[=:] {0,2}[\"']?"
SECRET = rf"(?<!\w){NAMED}[0-9A-Fa-f]{{12,}}+(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "date": DATE, "ipv4": IPV4, "ssn": SSN, "phone": PHONE, "cloud_key": CLOUD_KEY, "iban": IBAN, "card": CARD, "secret": SECRET}
PATTERN = "|".join(KINDS.values())

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _number(key: str, tweak: str, *parts: Column) -> Column:
    """The keyed round function: 52 bits of SHA-256 as a long."""
    said = F.concat_ws("|", F.lit(key), F.lit(tweak), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A keyed permutation of {0..a-1} x {0..b-1} as struct(l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(at: Column, k: Column) -> Column:
        l, r = at["l"], at["r"]  # noqa: E741
        return F.struct(
            F.when(k % 2 == 1, F.pmod(l + _number(key, tweak, k, r), F.lit(a))).otherwise(l).alias("l"),
            F.when(k % 2 == 0, F.pmod(r + _number(key, tweak, k, l), F.lit(b))).otherwise(r).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_text(text: Column, alphabets: list[str], key: str, tweak: str) -> Column:
    """A keyed permutation of strings in which every character stays in its alphabet
    and characters outside all of them stay as they are."""

    def shifted(half: Column, other: Column, k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = c
            for x in alphabets:
                at = F.pmod(F.position(c, F.lit(x)) - 1 + _number(key, tweak, k, other, i), F.lit(len(x)))
                out = F.when(F.position(c, F.lit(x)) > 0, F.substring(F.lit(x), at.cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def round_of(half: Column, other: Column, k: Column) -> Column:
        """A long half counts by its hash, so that the work follows the length."""
        return _let(F.when(F.length(other) > 64, F.sha2(other, 256)).otherwise(other), lambda x: shifted(half, x, k))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))

    def turn(at: Column, k: Column) -> Column:
        l, r = at["l"], at["r"]  # noqa: E741
        return F.struct(F.when(k % 2 == 1, round_of(l, r, k)).otherwise(l).alias("l"), F.when(k % 2 == 0, round_of(r, l, k)).otherwise(r).alias("r"))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda p: F.concat(p["l"], p["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _laid_out(shape: Column, written: Column, kind: str = "0-9") -> Column:
    """``written`` over the characters of a kind in ``shape``, the others kept."""
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{kind}]", ""))
    one = lambda i: F.substring(shape, i, F.lit(1))
    return _let(written, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(one(i).rlike(f"[{kind}]"), F.substring(d, place(i), F.lit(1))).otherwise(one(i))), ""))


def _checksum(digits: Column) -> Column:
    """Sum of the card checksum with the last digit at weight one."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    """The card in a run of digits: as issued, the whole run, a shorter run from its start, or
    the last four groups of four; what is beside it stays."""
    size = F.length(m)
    issued = F.length(F.regexp_extract(m, f"^{ISSUED}", 0))
    ends = F.filter(F.sequence(size, F.lit(13), F.lit(-1)), lambda i: (i == size) | F.substring(m, i + 1, F.lit(1)).isin(" ", "-"))
    last = F.length(F.regexp_extract(m, r"(?<=[ -])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}$", 0))
    span = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"))
    spans = F.concat(F.array(span(F.lit(1), issued)), F.transform(ends, lambda i: span(F.lit(1), i)), F.array(span(size - last + 1, last)))

    def valid(s: Column) -> Column:
        d = _digits(F.substring(m, s["at"], s["n"]))
        return F.length(d).between(13, 19) & (_checksum(d) % 10 == 0) & d.rlike("[1-9]")

    def written(s: Column) -> Column:
        shape = F.substring(m, s["at"], s["n"])
        d = _digits(shape)
        front = F.concat(F.substring(d, F.lit(1), F.lit(1)), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), [DIGITS], key, "card"))
        check = lambda x: F.pmod(10 - F.pmod(_checksum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.concat(F.substring(m, F.lit(1), s["at"] - 1), _laid_out(shape, _let(front, lambda x: F.concat(x, check(x)))), F.substring(m, s["at"] + s["n"], size))

    return F.get(F.transform(F.slice(F.filter(spans, valid), 1, 1), written), F.lit(0))


def _hex(secret: Column, key: str) -> Column:
    """Hex digits of one case are permuted as a number, so both cases of it link; in mixed
    case each character stays in its class, so that different values stay different."""
    one = _let(permute_text(F.lower(secret), [HEX], key, "secret"), lambda x: F.when(secret.rlike("[A-F]"), F.upper(x)).otherwise(x))
    mixed = permute_text(secret, [DIGITS, HEX[10:], HEX[10:].upper()], key, "secret")
    return F.when(secret.rlike("[a-f]") & secret.rlike("[A-F]"), mixed).otherwise(one)


def _ipv4(m: Column, key: str) -> Column:
    octet = lambda k: F.split(m, r"\.")[k].cast("int")
    valid = (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256)
    to = permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ipv4")
    half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.when(valid, _let(to, lambda p: F.concat_ws(".", half(p["l"]), half(p["r"]))))


def _ssn(m: Column, key: str) -> Column:
    part = lambda k: F.split(m, "-")[k].cast("long")
    area, group, serial = part(0), part(1), part(2)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    to = permute_pair(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def written(p: Column) -> Column:
        a = p["l"] + 1
        a = a + F.when(a > 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(to, written))


#: The days of 400 years, 146,097 of them, as a product of near equal factors.
CYCLE, CYCLE_A, CYCLE_B = 146_097, 189, 773
WALK = 32


def _date(m: Column, key: str) -> Column:
    """The permuted date in the same layout. Slashes are month-first where that is a date,
    else day-first; then the permutation is walked on until the day is beyond 12 again, so
    the layouts stay apart and different values stay different."""
    first, second, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    slashed, turned = m.substr(3, 1) == "/", (m.substr(3, 1) == "/") & (first > "12")
    iso = F.when(m.rlike(r"^\d{4}"), F.translate(m, "/", "-")).when(slashed & ~turned, F.concat_ws("-", year, first, second)).otherwise(F.concat_ws("-", year, second, first))
    origin = F.lit("1700-01-01").cast("date")
    number = F.datediff(iso.try_cast("date"), origin)
    on = lambda n: _let(permute_pair(F.floor(n / CYCLE_B), n % CYCLE_B, CYCLE_A, CYCLE_B, key, "date"), lambda p: (p["l"] * CYCLE_B + p["r"]).cast("int"))
    day = lambda n: F.dayofmonth(F.date_add(origin, n))
    # two days in five are early ones: a walk of WALK steps fails to leave them once in 10^12 values
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), on(number), lambda n, _: F.when(turned & (day(n) <= 12), on(n)).otherwise(n))

    def written(n: Column) -> Column:
        d = F.date_format(F.date_add(origin, n), "yyyy-MM-dd")
        y, mo, da = F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2)
        return F.when(turned, F.concat_ws("/", da, mo, y)).when(slashed, F.concat_ws("/", mo, da, y)).when(m.contains("."), F.concat_ws(".", da, mo, y)).when(m.contains("/"), F.concat_ws("/", y, mo, da)).otherwise(d)

    return F.when(number.between(0, CYCLE - 1), _let(walked, written))


def _mod97(account: Column) -> Column:
    """The remainder by which account numbers are checked: the first four characters come last, letters count from ten."""
    chars = F.filter(F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(F.ascii(c) < 58, (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """The account number at the start of the match, as a whole or up to a space; what follows stays."""
    size = F.length(m)
    ends = F.filter(F.sequence(size, F.lit(15), F.lit(-1)), lambda i: (i == size) | (F.substring(m, i + 1, F.lit(1)) == " "))
    bare = lambda i: F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit(""))
    valid = lambda i: F.length(bare(i)).between(15, 34) & (_mod97(bare(i)) == 1)

    def written(i: Column) -> Column:
        country = F.substring(m, 1, 2)
        new = permute_text(F.substring(bare(i), F.lit(5), size), [DIGITS, UPPER], key, "iban")
        check = lambda x: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0")
        whole = _let(new, lambda x: F.concat(country, check(x), x))
        return F.concat(_laid_out(F.substring(m, F.lit(1), i), whole, "0-9A-Z"), F.substring(m, i + 1, size))

    return F.get(F.transform(F.slice(F.filter(ends, valid), 1, 1), written), F.lit(0))


def _email(m: Column, key: str) -> Column:
    """Local part and host are permuted apart, so that hosts stay linked; the last label stays.
    No host is longer than 253 characters."""
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    last = F.substring_index(host, ".", -1)
    named = F.substring(host, F.lit(1), F.length(host) - F.length(last) - 1)
    return F.when(F.length(host) <= 253, F.concat(permute_text(local, [DIGITS, LOWER, UPPER], key, "email"), F.lit("@"), permute_text(named, [DIGITS, LOWER, UPPER], key, "host"), F.lit("."), last))


def _phone(m: Column, key: str) -> Column:
    country, national = _after(m, COUNTRY)
    digits = _digits(national)
    return F.when(F.length(digits).between(6, 14), F.concat(country, _laid_out(national, permute_text(digits, [DIGITS], key, "phone"))))


def _after(m: Column, pattern: str) -> tuple[Column, Column]:
    """A match cut at the end of a leading pattern."""
    head = F.regexp_extract(m, f"^(?:{pattern})", 0)
    return head, F.substring(m, F.length(head) + 1, F.length(m))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN; null if it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    named, secret = _after(m, NAMED)
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"), _date(m, key))
        .when(whole(r"\d+\.\d+\.\d+\.\d+"), _ipv4(m, key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key))
        .when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_text(F.substring(m, 5, 16), [DIGITS, UPPER], key, "cloud")))
        .when(named != "", F.concat(named, _hex(secret, key)))
        .when(m.rlike("^[A-Z]{2}"), _iban(m, key))
        .when(~m.startswith("+") & (F.length(_digits(m)) >= 13), _card(m, key))
        .otherwise(_phone(m, key))
    )


def session_key(spark: SparkSession) -> str:
    """The key of ``spark.marginalia.pii.key``; where it is unset, one is drawn for the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """The same rows with personal data in ``text`` replaced, and ``pii_found``; without a key, the session's."""
    key = key or session_key(docs.sparkSession)
    found = spare(docs, "found")
    new = spare(docs, "new")
    said = docs.withColumn(found, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    told = said.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    placed = F.zip_with(F.col(new), F.col(found), lambda n, m: F.coalesce(n, m))
    pieces = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(placed, F.array(F.lit(""))), lambda p, q: F.concat(p, q)), "")
    known = F.size(F.filter(new, lambda n: n.isNotNull()))
    return told.withColumns({text: F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)), "pii_found": F.when(F.col(new).isNotNull(), known).otherwise(0).cast("int")}).drop(found, new)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
