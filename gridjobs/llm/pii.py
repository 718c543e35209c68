"""Format-preserving Feistel pseudonyms of personal data, with DataFrame functions only (operator 5).

A value that passes its format's check (check digit, calendar, ranges) is mapped by a keyed Feistel permutation to another
value of that format. It is a permutation, so different values stay different and equal values get equal pseudonyms in
every document. Halves stay in their places and are changed in turn, so each digit stays a digit and each letter a letter.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.llm.tables import table

ROUNDS = 8
#: Where the key is found in a session.
KEY_SETTING = "spark.gridjobs.pii.key"
# Formats (fixed values).
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
ISO_DATE, DAY_FIRST = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
#: Numbers of ten digits in the North American plan, with or without a country code; with a country code and perhaps a trunk zero in
#: brackets; and as written within France (five pairs), Germany (area and number) and Spain (nine digits).
AMERICAN = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
ABROAD = r"\+[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?[0-9]{2,4}){2,5}|\+[0-9]{1,3}(?:[ .-]?\(0\))?[ .-]?[1-9](?:[ .-]?[0-9]{2}){4}|\+[0-9]{1,3}(?:[ .-]?\(0\))?[ .-]?[0-9]{2,4}[ ./-]?[0-9]{4,9}"
FRENCH, GERMAN, SPANISH = r"0[1-9](?:[ .-][0-9]{2}){4}", r"\(?0[1-9][0-9]{1,4}(?:\) ?| ?/ ?|[ -])[0-9]{5,8}(?:-[0-9]{1,3})?", r"[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}"
PHONE = rf"{AMERICAN}|{ABROAD}|{FRENCH}|{GERMAN}|{SPANISH}"
#: Country codes of one and of two digits; all others have three.
ONE, TWO = r"^\+[17]", r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"
_NUMBERS = rf"{IP}(?!\.?[0-9])|{ISO_DATE}|{DAY_FIRST}|{SSN}|{PHONE}|{IBAN}|{CARD}"
#: A value stands free of letters and digits on both sides; texts without an at sign are searched for numbers only.
ANY = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{_NUMBERS})(?![A-Za-z0-9])"
NUMBERS = rf"(?<![A-Za-z0-9])(?=[0-9+(]|[A-Z]{{2}}[0-9])(?:{_NUMBERS})(?![A-Za-z0-9])"
#: What any text with a value has.
HINT = r"@|[0-9][-0-9. ()/+]{5,}[0-9]|[A-Z]{2}[0-9]{2}"
#: Area, group and serial numbers that a social security number can have: 898 areas (001 to 899 but 666), 99 groups, 9,999 serials.
AREAS, SERIALS = 898, 9_999
#: Days from 1900-01-01 on that dates are permuted among: 2^16 of them, up to 2079-06-06.
FIRST_DAY, DAYS = "1900-01-01", 65_536


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named (a lambda would compute it for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(key: str, what: Column, *more: Column) -> Column:
    """A keyed 32-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *more, what), 256), 1, 8), 16, 10).cast("long")


def _shift(key: str, half: Column, other: Column, kind: str, turn: Column, sign: int) -> Column:
    """``half`` with each digit and letter moved within its class by numbers that ``other`` gives."""

    def moved(i: Column) -> Column:
        c = half.substr(i, F.lit(1))
        by = _number(key, other, F.lit(kind), turn, i) * sign
        turned = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(n)))
        return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), lambda i: i <= F.length(half))
    return F.array_join(F.transform(places, moved), "")


def permuted(value: Column, key: str, kind: str, back: bool = False) -> Column:
    """Feistel permutation of ASCII strings that keeps length and the class of every character; ``back`` inverts it."""
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def start(v: Column) -> Column:
        middle = F.floor(F.length(v) / 2).cast("int")
        return F.struct(v.substr(F.lit(1), middle).alias("l"), v.substr(middle + 1, F.length(v)).alias("r"))

    sign = -1 if back else 1
    step = lambda s, t: F.when(t % 2 == 0, F.struct(s["l"].alias("l"), _shift(key, s["r"], s["l"], kind, t, sign).alias("r"))).otherwise(F.struct(_shift(key, s["l"], s["r"], kind, t, sign).alias("l"), s["r"].alias("r")))
    return F.aggregate(turns, let(value, start), step, lambda s: F.concat(s["l"], s["r"]))


def permuted_bits(value: Column, bits: int, key: str, kind: str, back: bool = False) -> Column:
    """Feistel permutation of the integers below 2^bits, for an even number of bits."""
    half = 1 << bits // 2
    start = let(value, lambda v: F.struct(F.floor(v / half).cast("long").alias("l"), (v % half).cast("long").alias("r")))
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    mix = lambda a, b, t: a.bitwiseXOR(_number(key, b.cast("string"), F.lit(kind), t) % half)
    step = lambda s, t: F.when(t % 2 == 0, F.struct(s["l"].alias("l"), mix(s["r"], s["l"], t).alias("r"))).otherwise(F.struct(mix(s["l"], s["r"], t).alias("l"), s["r"].alias("r")))
    return F.aggregate(turns, start, step, lambda s: s["l"] * half + s["r"])


def permuted_pair(left: Column, right: Column, n_left: int, n_right: int, key: str, kind: str) -> Column:
    """Feistel permutation of pairs of integers below ``n_left`` and ``n_right``, as a struct of l and r."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    mix = lambda a, n, b, t: F.pmod(a + _number(key, b.cast("string"), F.lit(kind), t), F.lit(n))
    step = lambda s, t: F.when(t % 2 == 0, F.struct(s["l"].alias("l"), mix(s["r"], n_right, s["l"], t).alias("r"))).otherwise(F.struct(mix(s["l"], n_left, s["r"], t).alias("l"), s["r"].alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""

    def fill(given: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("n"))
        step = lambda a, c: F.when(c.between("0", "9"), F.struct(F.concat(a["s"], given.substr(a["n"], F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))
        return F.aggregate(F.split(value, ""), start, step, lambda a: a["s"])

    return let(digits, fill)


def luhn(digits: Column) -> Column:
    """Sum of the check-digit scheme, from the right, counting the last digit singly."""

    def total(v: Column) -> Column:
        def worth(i: Column) -> Column:
            d = v.substr(F.length(v) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(worth(i), F.lit(0)))

    return let(digits, total)


def mod97(value: Column) -> Column:
    """Remainder of an account number in its checked order (country and check digits moved behind)."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def whole(value: Column, regex: str) -> Column:
    return value.rlike(f"^(?:{regex})$")


def date_of(value: Column) -> Column:
    """Date of either format, or null if the calendar has none; day first, with dots or slashes."""
    digits = digits_of(value)
    iso = F.when(whole(value, ISO_DATE), digits).otherwise(F.concat(digits.substr(F.lit(5), F.lit(4)), digits.substr(F.lit(3), F.lit(2)), digits.substr(F.lit(1), F.lit(2))))
    part = lambda a, n: iso.substr(F.lit(a), F.lit(n))
    return F.try_to_timestamp(F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)), F.lit("yyyy-MM-dd")).cast("date")


def kind_of(value: Column) -> Column:
    """email, ip, date, ssn, card, iban or phone for a valid value, null for anything else."""
    d = digits_of(value)
    day = F.datediff(date_of(value), F.lit(FIRST_DAY).cast("date"))
    return (
        F.when(value.contains("@"), "email")
        .when(whole(value, IP), "ip")
        .when(whole(value, ISO_DATE) | whole(value, DAY_FIRST), F.when((day >= 0) & (day < DAYS), "date"))
        .when(whole(value, SSN), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(value, IBAN), F.when((mod97(value) == 1) & value.substr(F.lit(3), F.lit(2)).between("02", "98"), "iban"))
        .when(whole(value, PHONE) & F.length(d).between(8, 15), "phone")
        .when(whole(value, CARD), F.when((luhn(d) % 10 == 0) & d.rlike("[1-9]"), "card"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The permuted value in the format of the given one; values without a kind stay."""
    d = digits_of(value)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    name = domain.substr(F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(permuted(local, key, "email"), F.lit("@"), permuted(name, key, "domain"), top)
    octets = F.split(value, r"\.")
    number = reduce(lambda a, n: a * 256 + F.get(octets, F.lit(n)).cast("long"), range(4), F.lit(0).cast("long"))
    ip = let(permuted_bits(number, 32, key, "ip"), lambda b: F.concat_ws(".", *((F.shiftright(b, 8 * n) % 256).cast("string") for n in (3, 2, 1, 0))))
    day = permuted_bits(F.datediff(date_of(value), F.lit(FIRST_DAY).cast("date")).cast("long"), 16, key, "date")
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    date = refilled(value, let(moved, lambda new: F.when(whole(value, ISO_DATE), F.date_format(new, "yyyyMMdd")).otherwise(F.date_format(new, "ddMMyyyy"))))
    # no card is all zeros: the one body that would become it goes on to what zeros become
    body = let(permuted(d.substr(F.lit(1), F.length(d) - 1), key, "card"), lambda b: F.when(b.rlike("[1-9]"), b).otherwise(permuted(b, key, "card")))
    card = refilled(value, let(body, lambda b: F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))
    # the country code stays, with a trunk zero and the next digit, which may not become one; so do the zero and the digit of numbers
    # as they are written within a country
    code = F.when(value.rlike(ONE), 1).when(value.rlike(TWO), 2).otherwise(3)
    abroad = code + F.when(value.contains("(0)"), 2).when(value.rlike(ONE), 0).otherwise(1)
    lead = F.when(value.startswith("+"), abroad).when(value.rlike(r"^\(?0"), 2).when(whole(value, SPANISH), 1).otherwise(0)
    phone = refilled(value, F.concat(d.substr(F.lit(1), lead), permuted(d.substr(lead + 1, F.length(d)), key, "phone")))
    part = lambda at, n: d.substr(F.lit(at), F.lit(n)).cast("int")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    fill = lambda n, width: F.lpad(n.cast("string"), width, "0")
    numbers = lambda p: F.concat(fill(p["l"] + F.when(p["l"] < 665, 1).otherwise(2), 3), fill(F.floor(p["r"] / SERIALS) + 1, 2), fill(p["r"] % SERIALS + 1, 4))
    ssn = refilled(value, let(permuted_pair(area, (part(4, 2) - 1) * SERIALS + part(6, 4) - 1, AREAS, 99 * SERIALS, key, "ssn"), numbers))
    plain = F.regexp_replace(value, " ", "")
    account = permuted(plain.substr(F.lit(5), F.length(plain)), key, "iban")
    check = lambda a: F.lpad((98 - mod97(F.concat(plain.substr(F.lit(1), F.lit(2)), F.lit("00"), a))).cast("string"), 2, "0")
    bare = let(account, lambda a: F.concat(plain.substr(F.lit(1), F.lit(2)), check(a), a))
    iban = let(bare, lambda b: F.when(value.contains(" "), F.trim(F.regexp_replace(b, "(.{4})", "$1 "))).otherwise(b))
    cases = {"email": email, "ip": ip, "date": date, "card": card, "phone": phone, "ssn": ssn, "iban": iban}
    out = F.when(F.lit(False), value)
    for k, v in cases.items():
        out = out.when(kind == k, v)
    return out.otherwise(value)


def pseudonymized(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the whole text with every valid personal value replaced by its pseudonym, n_pii (how many), kinds (their
    kinds in order) and n_left (how many look like such a value but fail its check).

    Values are e-mail and IPv4 addresses, dates of 1900-01-01 to 2079-06-06, phone numbers (with a country code, which stays, or as
    written in North America, France, Germany and Spain), card, account and social security numbers; what fails its format's check stays as it is and is counted. A null text stays null and counts none. Repeated rows give repeated
    rows, empty texts and tables empty ones; other columns are not read. It is a projection: no shuffle, no state.

    An empty key is refused. The key stands in the query's plan: where plans are logged, let ``spark.sql.redaction.string.regex``
    match it.
    """
    if not key:
        raise ValueError("a key is needed")
    d = docs.select(*keep, F.col(text).alias("_text"))
    mail = F.contains("_text", F.lit("@"))
    every = lambda p: F.regexp_extract_all("_text", F.lit(p), F.lit(0))
    found = F.when(F.col("_text").rlike(HINT), F.when(mail, every(ANY)).otherwise(every(NUMBERS))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_hits", F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))))
    some = F.exists("_hits", lambda h: h["k"].isNotNull())
    pieces = F.when(mail, F.split("_text", ANY, -1)).otherwise(F.split("_text", NUMBERS, -1))
    glued = F.zip_with(pieces, F.transform("_hits", lambda h: pseudonym(h["v"], h["k"], key)), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    kinds = F.filter(F.transform("_hits", lambda h: h["k"]), lambda k: k.isNotNull())
    return d.select(*keep, F.when(some, F.array_join(glued, "")).otherwise(F.col("_text")).alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_pii"), F.array_join(kinds, ",").alias("kinds"), F.coalesce(F.size("_hits") - F.size(kinds), F.lit(0)).cast("long").alias("n_left"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, under the session's key; where it has none, under one drawn for this run: values stay linked across all
    documents, but not with those of other runs."""
    return pseudonymized(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))
