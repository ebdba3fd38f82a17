"""Format-preserving pseudonyms for personal data, made of DataFrame functions alone.

A value is found by its pattern, validated (check digits, octets, calendar), and
permuted by a keyed Feistel network over its own characters: every digit stays a
digit and every letter a letter of its case, separators and fixed parts stay where
they are, check digits are computed anew and dates stay dates.  The permutation is a
function of key, kind and value, so equal values get equal pseudonyms in all
documents and different values different ones, without a table of either.

The network works on a list of symbols with a base each (1 for what must stay): in
turn each half is shifted, symbol by symbol modulo its base, by a keyed hash of the
other half.

Account, card and phone numbers are permuted as bare digits and letters and laid back
between their separators, so all spellings of a number have one pseudonym; country
codes of phones stay.  A phone of a country other than +1 that is followed by another
number, one blank on, is taken together with it (15 digits at most); numbers of
unlisted countries' accounts are found unbroken only, phones without + in the 3-3-4
shape only, and a trunk (0) counts as a digit.  Social security numbers are permuted
among those that are valid.  A date with slashes is taken day first, and month first
where it is none otherwise; different dates have different pseudonyms within a form.

Defined results: a null text stays null; texts without personal data stay as they
are, and so do numbers that fail validation; repeated rows are treated alike; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

#: What may stand between groups of an account or card number, and between digits of an international phone number.
_SEP, _LOOSE = r"[ \u00A0-]", r"[ \u00A0.()/-]{0,3}"
#: Lengths of account numbers: so many characters are taken, however they are grouped.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{v.replace(' ', '|')})\d{{2}}(?:{_SEP}?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, v in _LENGTHS.items())
#: Country codes of phone numbers: no code begins another.
_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Kinds of values, in order of precedence where they begin at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Fa-f]{16,128}(?![A-Za-z0-9])",
    "phone": rf"(?<![A-Za-z0-9+])(?:\+1(?:{_LOOSE}\d){{10}}(?![A-Za-z0-9])|\+(?:{_LOOSE}\d){{8,15}}|(?:\(\d{{3}}\) ?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}})(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{_IBANS}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![A-Za-z0-9/-])",
    "ip": r"(?<![A-Za-z0-9.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "card": rf"(?<![A-Za-z0-9])(?:\d{{13,19}}|\d{{4}}(?:{_SEP}\d{{4}}){{3}}(?:{_SEP}\d{{3}})?|\d{{4}}{_SEP}\d{{6}}{_SEP}\d{{4,5}}|\d{{4}}(?:{_SEP}\d{{4}}){{2}}{_SEP}?\d)(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DOUBLE_ROUNDS = 4
#: A cycle of the calendar in days, as two bases.
CYCLE = (189, 773)
_EPOCH = "1600-03-01"


def _stream(key: str, kind: Column, half: Column, turn: Column) -> Column:
    """128 hex digits from the key, the kind, the turn and the other half."""
    seed = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), F.array_join(F.transform(half, lambda x: x.cast("string")), ","))
    return F.concat(F.sha2(F.concat(seed, F.lit("|a")), 256), F.sha2(F.concat(seed, F.lit("|b")), 256))


def feistel(symbols: Column, bases: Column, kind: Column, key: str) -> Column:
    """The permuted symbols: an array<int> whose i-th element is below the i-th base."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    cut = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.size(x) - half))
    (left, right), (lb, rb) = cut(symbols), cut(bases)

    def shifted(side: Column, base: Column, other: Column, turn: Column) -> Column:
        step = lambda s, x, i: F.pmod(x + F.conv(F.substr(s, F.pmod(3 * i, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int"), F.get(base, i)).cast("int")
        return let(_stream(key, kind, other, turn), lambda s: F.transform(side, lambda x, i: step(s, x, i)))

    def both(acc: Column, turn: Column) -> Column:
        return let(
            shifted(acc["l"], acc["lb"], acc["r"], 2 * turn),
            lambda l: F.struct(l.alias("l"), shifted(acc["r"], acc["rb"], l, 2 * turn + 1).alias("r"), acc["lb"].alias("lb"), acc["rb"].alias("rb")),
        )

    start = F.struct(left.alias("l"), right.alias("r"), lb.alias("lb"), rb.alias("rb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DOUBLE_ROUNDS)), start, both, lambda acc: F.concat(acc["l"], acc["r"]))


def _characters(value: Column, kind: Column, key: str, hexadecimal: bool = False) -> Column:
    """Permutes digits and letters of a string, each in its own range; all else stays."""
    span = 6 if hexadecimal else 26

    def code(c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a.between(48, 57), a - 48).when(a.between(65, 90), a - 65).when(a.between(97, 122), a - 97).otherwise(0)

    def base(c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a.between(48, 57), 10).when(a.between(65, 90) | a.between(97, 122), span).otherwise(1)

    def char(c: Column, x: Column) -> Column:
        a = F.ascii(c)
        low = F.when(a.between(48, 57), 48).when(a.between(65, 90), 65).when(a.between(97, 122), 97)
        return F.when(low.isNull(), c).otherwise(F.char(low + x))

    split = F.filter(F.split(value, ""), lambda c: c != "")
    return let(
        split,
        lambda cs: F.array_join(F.zip_with(cs, feistel(F.transform(cs, code), F.transform(cs, base), kind, key), char), ""),
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of an array of digits, counted from the right: the last has weight one."""
    n = F.size(digits)
    weight = lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x.cast("int"))


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(value, r"\D", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _mod97(value: Column) -> Column:
    """The number of an IBAN (letters as 10 to 35, first four characters last) modulo 97."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def _date(value: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy"))).cast("date")


def _ssn(value: Column, kind: Column, key: str) -> Column:
    """Permutes area, group and serial among those that are given out: areas 1 to 899 but 666, groups and serials from 1."""
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    symbols = F.array(place, group - 1, F.floor((serial - 1) / 101).cast("int"), F.pmod(serial - 1, F.lit(101)))
    made = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(99), F.lit(101)), kind, key)
    fresh = lambda x: F.format_string("%03d-%02d-%04d", F.when(x[0] < 665, x[0] + 1).otherwise(x[0] + 2), x[1] + 1, x[2] * 101 + x[3] + 1)
    return let(made, fresh)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9]", "")


def _relaid(value: Column, fresh: Column) -> Column:
    """The characters of fresh in place of the digits and letters of value, one by one."""
    step = lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["out"], F.substr(fresh, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: acc["out"])


def _card(value: Column) -> Column:
    """The part of a found number that is a card's: without a group of three after four groups of four if that makes it valid; else null."""
    valid = lambda v: let(_digits(v), lambda d: F.size(d).between(13, 19) & (luhn_sum(d) % 10 == 0))
    short = F.regexp_replace(value, rf"(?<=^.{{19}}){_SEP}\d{{3}}$", "")
    return F.when(valid(value), value).when(valid(short), short)


def kind_of(value: Column) -> Column:
    """The kind of a found value, if it is valid; else null."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    valid = {
        "ip": F.forall(octets, lambda x: x <= 255),
        "card": _card(value).isNotNull(),
        "iban": _mod97(_bare(value)) == 1,
        "ssn": ~value.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"),
        "date": _date(value).isNotNull(),
    }
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        bare = pattern
        for around in (r"(?<![A-Za-z0-9._%+-])", r"(?<![A-Za-z0-9+])", r"(?<![A-Za-z0-9./-])", r"(?<![A-Za-z0-9.])", r"(?<![A-Za-z0-9-])", r"(?<![A-Za-z0-9])"):
            bare = bare.removeprefix(around)
        fits = value.rlike(f"^(?:{bare})$")
        out = F.when(fits, F.when(valid[kind], F.lit(kind)) if kind in valid else F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind."""
    at = F.instr(value, "@")
    email = F.concat(_characters(F.substr(value, F.lit(1), at - 1), F.concat(kind, F.substr(value, at)), key), F.substr(value, at))
    number = _bare(value)
    code = F.when(value.startswith("+"), F.regexp_extract(number, _CODE, 0)).otherwise("")
    phone = _relaid(value, F.concat(code, _characters(F.substr(number, F.length(code) + 1), kind, key)))
    body = F.regexp_extract(value, r"[0-9A-Fa-f]{16,128}$", 0)
    secret = F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(body)), _characters(body, kind, key, hexadecimal=True))
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    ip = F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), kind, key), lambda x: x.cast("string")), ".")
    part = F.coalesce(_card(value), value)
    digits = _bare(part)
    head = _characters(F.substr(digits, F.lit(1), F.length(digits) - 1), kind, key)
    card = let(head, lambda h: F.concat(h, F.pmod(-luhn_sum(F.concat(_digits(h), F.array(F.lit(0)))), F.lit(10)).cast("string")))
    card = F.concat(_relaid(part, card), F.substr(value, F.char_length(part) + 1))
    account = F.concat(F.substr(number, F.lit(1), F.lit(2)), F.lit("00"), _characters(F.substr(number, F.lit(5)), F.concat(kind, F.substr(number, F.lit(1), F.lit(2))), key))
    iban = let(account, lambda x: F.concat(F.substr(x, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(x)).cast("string"), 2, "0"), F.substr(x, F.lit(5))))
    iban = _relaid(value, iban)
    span = CYCLE[0] * CYCLE[1]
    days = F.datediff(_date(value), F.lit(_EPOCH).cast("date"))
    turn = lambda d: F.pmod(d, F.lit(span)).cast("int")
    moved = let(
        days,
        lambda d: let(
            feistel(F.array(F.floor(turn(d) / CYCLE[1]).cast("int"), F.pmod(turn(d), F.lit(CYCLE[1]))), F.array(F.lit(CYCLE[0]), F.lit(CYCLE[1])), kind, key),
            lambda s: F.date_add(F.lit(_EPOCH).cast("date"), (d - turn(d) + F.get(s, F.lit(0)) * CYCLE[1] + F.get(s, F.lit(1))).cast("int")),
        ),
    )
    day_first = F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNotNull()
    date = F.when(value.contains("/"), F.when(day_first, F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))).when(value.contains("."), F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "yyyy-MM-dd"))
    forms = {"email": email, "phone": phone, "secret": secret, "ip": ip, "card": card, "iban": iban, "date": date, "ssn": _ssn(value, kind, key)}
    out = value
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Per document row: doc_id, text with pseudonyms, n_found, kinds (the kind of each, in order)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    none = F.array().cast("array<string>")
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none)
    rows = rows.withColumn("found", F.coalesce(found, none))
    rows = rows.withColumn("kind", F.transform("found", kind_of))
    fresh = F.zip_with("found", "kind", lambda v, k: F.coalesce(pseudonym(v, k, key), v))

    def joined(swap: Column) -> Column:
        gaps = F.split("text", ANY, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(swap, i), F.lit("")))), "")

    text = F.when(F.exists("kind", lambda k: k.isNotNull()), let(fresh, joined)).otherwise(F.col("text"))
    kinds = F.filter("kind", lambda k: k.isNotNull())
    return rows.select("doc_id", text.alias("text"), F.size(kinds).cast("bigint").alias("n_found"), kinds.alias("kinds"))
