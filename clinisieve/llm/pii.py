"""Pseudonyms for personal numbers and dates that keep their format.

Candidates are found by patterns and validated: checksums of cards and IBANs, ranges of addresses,
days and social security numbers.  A valid value is replaced by another valid value of the same
format, by a keyed Feistel permutation of the numbers that the format leaves free.  Equal values get
equal pseudonyms in all documents, different values different ones, and whoever has the key can
turn them back.  Everything is built-in functions over the row's own text; no data moves.

A text is cut at the matches of one pattern, so that texts between matches are never touched, and
only texts with a digit are searched at all.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: The setting that holds the key; without it the example key is taken, which everybody knows.
KEY_SETTING, KEY = "clinisieve.pseudonyms.key", "change this key"

# The forms of the identifiers, in the order in which they are tried.
_NO_DIGIT_BEFORE, _NO_DIGIT_AFTER = r"(?<![0-9])(?<![0-9]\.)", r"(?!\.?[0-9])"
#: Characters of the IBANs of a country, which tell where one that is printed in groups of four ends.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV SD", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_GROUPED_IBAN = "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                         for n, countries in _IBAN_LENGTHS.items())
_GROUPED_CARD = r"[0-9]{4}(?: [0-9]{4}){3}"
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + _GROUPED_IBAN + r")(?![A-Za-z0-9])",
    "ip": _NO_DIGIT_BEFORE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _NO_DIGIT_AFTER,
    "date": _NO_DIGIT_BEFORE + r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})" + r"(?![0-9])(?![-/.][0-9])",
    "ssn": r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+[0-9]{1,3}[ .-])?[0-9]{3}-[0-9]{3}-[0-9]{4}"
             r"|\+[0-9]{8,15}|\+[0-9]{1,3}(?:(?!(?: " + _GROUPED_CARD + r")+(?! ?[0-9])) [0-9]{2,4}){3,5}(?<!" + "[0-9] ?" * 15 + r"[0-9]))(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX_LOWER, _HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def session_key(spark: SparkSession) -> str:
    """The key that the session names; a warning goes out where it names none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the example key and hide nothing", stacklevel=2)
    return key or KEY


def pattern() -> str:
    """All forms in one; the groups that dates refer back to are renumbered by their place, which is the same as dates hold the only two."""
    return "|".join(f"(?:{form})" for form in FORMS.values())


def _hash(key: str, label: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), turn.cast("string"), value.cast("string")), 512)


def _turns(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _pair(key: str, label: str, left: Column, right: Column, a: int, b: int, inverse: bool) -> Column:
    """A permutation of the pairs of [0, a) x [0, b): the halves take turns, each moved by a hash of the other."""
    sign = -1 if inverse else 1

    def step(at: Column, turn: Column) -> Column:
        def moved(own: Column, other: Column, size: int) -> Column:
            by = F.conv(F.substring(_hash(key, label, turn, other), 1, 12), 16, 10).cast("bigint")
            return F.pmod(own + sign * F.pmod(by, F.lit(size)), F.lit(size)).cast("bigint")
        return F.when(turn % 2 == 0, F.struct(moved(at["l"], at["r"], a).alias("l"), at["r"].alias("r"))).otherwise(
            F.struct(at["l"].alias("l"), moved(at["r"], at["l"], b).alias("r")))
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(_turns(inverse), start, step)


def _number(key: str, label: str, value: Column, a: int, b: int, inverse: bool) -> Column:
    """A permutation of [0, a * b)."""
    return F.transform(F.array(_pair(key, label, F.floor(value / b), F.pmod(value, F.lit(b)), a, b, inverse)),
                       lambda p: p["l"] * F.lit(b) + p["r"])[0]


def _string(key: str, label: str, value: Column, alphabets: tuple[str, ...], inverse: bool) -> Column:
    """A permutation of the strings whose characters lie in the same alphabets, place by place.

    The halves of the string take turns: each character moves within its alphabet by a hash of the other half.
    Characters of no alphabet stay, and take part in no hash but their half's.
    """
    sign = -1 if inverse else 1
    middle = F.floor(F.length(value) / 2).cast("int")

    def moved(part: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                place = F.call_function("instr", F.lit(alphabet), c) - 1
                out = F.when((c != "") & (place >= 0), F.substring(F.lit(alphabet), F.pmod(place + sign * by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
            return out
        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(at: Column, turn: Column) -> Column:
        left, right = at["l"], at["r"]
        return F.when(turn % 2 == 0, F.struct(moved(left, _hash(key, label, turn, right)).alias("l"), right.alias("r"))).otherwise(
            F.struct(left.alias("l"), moved(right, _hash(key, label, turn, left)).alias("r")))
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, F.length(value)).alias("r"))
    return F.aggregate(_turns(inverse), start, step, lambda at: F.concat(at["l"], at["r"]))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _refill(form: Column, digits: Column) -> Column:
    """The digits put in the places of the digits of ``form``, in order."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("used"))

    def step(at: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        return F.struct(F.concat(at["done"], F.when(is_digit, F.substring(digits, at["used"] + 1, F.lit(1))).otherwise(c)).alias("done"),
                        (at["used"] + is_digit.cast("int")).alias("used"))
    return F.aggregate(F.split(form, ""), start, step, lambda at: at["done"])


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The checksum of a card's digits, the last one undoubled."""
    def step(at: Column, c: Column) -> Column:
        twice = c.cast("int") * 2
        value = F.when(at["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))
        return F.struct((at["sum"] + value).alias("sum"), (~at["odd"]).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda at: at["sum"])


def _card(key: str, m: Column, inverse: bool) -> Column:
    """The first digit stays, the last one is the checksum, those between are permuted."""
    def permuted(d: Column) -> Column:
        free = _string(key, "card", F.substring(d, F.lit(2), F.length(d) - 2), (_DIGITS,), inverse)
        body = F.concat(F.substring(d, 1, 1), free)
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return _refill(m, F.concat(body, check))
    return _let(_only_digits(m), lambda d: F.when(F.substring(d, 1, 1).between("2", "6") & (luhn_sum(d) % 10 == 0), permuted(d)))


def _iban_rest(value: Column) -> Column:
    """The number that an IBAN spells, its first four characters moved to the end, modulo 97."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def step(at: Column, c: Column) -> Column:
        letter = F.call_function("instr", F.lit(_UPPER), c) + 9
        return F.when(letter > 9, (at * 100 + letter) % 97).otherwise((at * 10 + F.call_function("instr", F.lit(_DIGITS), c) - 1) % 97).cast("int")
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(key: str, m: Column, inverse: bool) -> Column:
    """Country, letters and blanks stay, digits of the account are permuted, the check digits follow."""
    bare = F.regexp_replace(m, " ", "")

    def checked(body: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = F.lpad((F.lit(98) - _iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return F.concat(country, check, body)
    account = F.substring(bare, F.lit(5), F.length(bare))
    refilled = _refill(account, _string(key, "iban", _only_digits(account), (_DIGITS,), inverse))
    return F.when(checked(account) == bare, _refill(m, _only_digits(_let(refilled, checked))))


def _card_within(key: str, m: Column, inverse: bool) -> Column:
    """What looks like an IBAN in groups of four and is none, with the pseudonym of a card in it; null without one."""
    form = r"(?<![0-9])" + _GROUPED_CARD + r"(?![0-9])"
    inner = F.regexp_extract(m, form, 0)
    return F.when(inner != "", _let(_card(key, inner, inverse), lambda c: F.regexp_replace(m, F.lit(form), c)))


def _ip(key: str, m: Column, inverse: bool) -> Column:
    parts = F.split(m, r"\.")
    sound = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    pair = _pair(key, "ip", parts[0].cast("int") * 256 + parts[1].cast("int"), parts[2].cast("int") * 256 + parts[3].cast("int"), 1 << 16, 1 << 16, inverse)
    spelled = _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), h % 256)]))
    return F.when(sound, spelled)


def _ssn(key: str, m: Column, inverse: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serial numbers from 0001."""
    area, group, serial = (p.cast("int") for p in (F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)))
    sound = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def spelled(p: Column) -> Column:
        a = F.floor(p["l"] / 99)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in (
            (a + F.when(a >= 665, 2).otherwise(1), 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4))])
    return F.when(sound, _let(_pair(key, "ssn", left, serial - 1, 898 * 99, 9999, inverse), spelled))


# Of the days of the years 1904 to 2099, 49 cycles of four years, those to the 12th are 147 x 192, those from the 13th on 245 x 177.
_FIRST_YEAR, _LAST_YEAR, _CYCLE = 1904, 2099, 1461
_LENGTHS = [29 if m == 1 and y == 0 else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m] for y in range(4) for m in range(12)]
_LATE_STARTS = [sum(n - 12 for n in _LENGTHS[:i]) for i in range(48)]
_LATE_CYCLE = sum(_LENGTHS) - 12 * 48


def _month(year: Column, month: Column) -> Column:
    return (year - _FIRST_YEAR) * 12 + month - 1


def _is_date(year: Column, month: Column, day: Column) -> Column:
    lengths = F.array(*[F.lit(n) for n in _LENGTHS])
    return F.coalesce(year.between(_FIRST_YEAR, _LAST_YEAR) & month.between(1, 12) & (day >= 1)
                      & (day <= F.get(lengths, F.pmod(_month(year, month), F.lit(48)))), F.lit(False))


def _early_day(key: str, y: Column, m: Column, d: Column, inverse: bool, spell) -> Column:
    """Days to the 12th stay so: where they might be months, the pseudonym is read in the same order."""
    def back(n: Column) -> Column:
        return _let(F.floor(n / 12), lambda months: spell(F.floor(months / 12) + _FIRST_YEAR, months % 12 + 1, n % 12 + 1))
    return _let(_number(key, "early date", _month(y, m) * 12 + d - 1, 147, 192, inverse), back)


def _late_day(key: str, y: Column, m: Column, d: Column, inverse: bool, spell) -> Column:
    """The 13th and later stay so: only one order of day and month allows them."""
    starts = F.array(*[F.lit(n) for n in _LATE_STARTS])
    cycle, month = F.floor(_month(y, m) / 48), F.pmod(_month(y, m), F.lit(48))
    number = _number(key, "late date", cycle * _LATE_CYCLE + F.get(starts, month) + d - 13, 245, 177, inverse)

    def back(n: Column) -> Column:
        rest = F.pmod(n, F.lit(_LATE_CYCLE))
        return _let(F.size(F.filter(starts, lambda s: s <= rest)) - 1, lambda k: _let(F.floor(n / _LATE_CYCLE) * 48 + k, lambda months: spell(
            F.floor(months / 12) + _FIRST_YEAR, months % 12 + 1, rest - F.get(starts, k) + 13)))
    return _let(number, back)


def _day(key: str, y: Column, m: Column, d: Column, inverse: bool, spell) -> Column:
    """The same day for a date however it is spelled."""
    return F.when(d <= 12, _early_day(key, y, m, d, inverse, spell)).otherwise(_late_day(key, y, m, d, inverse, spell))


def _date(key: str, m: Column, inverse: bool) -> Column:
    """Year first, or year last: then month first after a slash if that is a date, and else day first; after others the other way round."""
    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")
    mark = F.regexp_extract(m, "[-/.]", 0)
    first = m.rlike("^[0-9]{4}")
    iso = [F.substring(m, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2))]
    left, right, year = F.substring(m, 1, 2).cast("int"), F.substring(m, 4, 2).cast("int"), F.substring(m, 7, 4).cast("int")
    written_iso = lambda y, mo, d: F.concat(y.cast("string"), mark, two(mo), mark, two(d))
    month_first = lambda y, mo, d: F.concat(two(mo), mark, two(d), mark, y.cast("string"))
    day_first = lambda y, mo, d: F.concat(two(d), mark, two(mo), mark, y.cast("string"))
    as_month, as_day = _is_date(year, left, right), _is_date(year, right, left)
    # Two numbers up to 12 stay two such numbers, so a pseudonym is read in the order of its date.
    slash = mark == "/"
    by_month = F.when(slash, as_month).otherwise(~as_day & as_month)
    in_order = F.when(first, F.lit("iso")).when(by_month, F.lit("month")).otherwise(F.lit("day"))
    month = F.when(first, iso[1]).when(in_order == "month", left).otherwise(right)
    day = F.when(first, iso[2]).when(in_order == "month", right).otherwise(left)
    y = F.when(first, iso[0]).otherwise(year)

    def spelled(y: Column, mo: Column, d: Column) -> Column:
        return F.when(in_order == "iso", written_iso(y, mo, d)).when(in_order == "month", month_first(y, mo, d)).otherwise(day_first(y, mo, d))
    return F.when(F.when(first, _is_date(*iso)).otherwise(as_month | as_day), _day(key, y, month, day, inverse, spelled))


def _phone(key: str, m: Column, inverse: bool) -> Column:
    """The country's code stays; with eight digits at least and fifteen at most, the others are permuted."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    digits = _only_digits(rest)
    return F.when(F.length(_only_digits(m)).between(8, 15), F.concat(country, _refill(rest, _string(key, "phone", digits, (_DIGITS,), inverse))))


def _email(key: str, m: Column, inverse: bool) -> Column:
    """Letters and digits of the name are permuted; the host stays."""
    name = F.regexp_extract(m, "^[^@]+", 0)
    return F.concat(_string(key, "email", name, (_DIGITS, _LOWER, _UPPER), inverse), F.substring(m, F.length(name) + 1, F.length(m)))


def _token(key: str, m: Column, inverse: bool) -> Column:
    """Hexadecimal digits in their case; a token of digits only is left to the other forms."""
    mixed = m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    return F.when(mixed & m.rlike("[a-f]"), _string(key, "token", m, (_HEX_LOWER,), inverse)).when(mixed, _string(key, "token", m, (_HEX_UPPER,), inverse))


_KINDS = {"email": _email, "token": _token, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(match: Column) -> Column:
    """The first form that the whole of a match has."""
    out = F.lit(None).cast("string")
    for kind in reversed(FORMS):
        out = F.when(match.rlike(f"^(?:{FORMS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    """(kind, value): the pseudonym of a match and its kind; both null if the match is not valid."""
    def of(kind: Column) -> Column:
        value = F.lit(None).cast("string")
        for name in reversed(FORMS):
            value = F.when(kind == name, _KINDS[name](key, match, inverse)).otherwise(value)
        def told(v: Column) -> Column:
            within = F.when(v.isNull() & (kind == "iban"), _card_within(key, match, inverse))
            return _let(within, lambda c: F.struct(F.when(v.isNotNull(), kind).when(c.isNotNull(), F.lit("card")).alias("kind"), F.coalesce(v, c).alias("value")))
        return _let(value, told)
    return _let(kind_of(match), of)


def with_pseudonyms(df: DataFrame, text_col: str = "text", key: str = KEY, inverse: bool = False, kinds: str | None = None) -> DataFrame:
    """``df`` with the pseudonyms in the text, and with ``kinds`` the array of what was replaced, in order.

    ``inverse`` turns the pseudonyms of the same key back.  Null texts stay null and texts without
    a valid value unchanged.  All other columns stay, whatever their names, but for one named as ``kinds`` says, which is replaced.

    Repeated rows, and a day in each of its spellings, get the same pseudonyms; an empty table gives an empty table.

    Limits: dates are those of 1904 to 2099 in ten characters, and a date keeps whether its day is past the 12th;
    IBANs in groups of four are those of the countries listed, and IBANs with hyphens, IPv6 addresses and phone numbers
    with dots only are not found; names of e-mail addresses that differ in case are different names;
    a value that overlaps the end of an earlier match that is not valid is not found; a value may by chance
    be its own pseudonym (for dates one in 28,224 at most).  The key is a literal of the plan: set
    ``spark.redaction.string.regex`` to keep it out of event logs and printed plans.
    """
    text = F.col(f"`{text_col}`")
    names = [c for c in df.columns if c.lower() != (kinds or "").lower()]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    one = pattern()
    found = F.when(F.coalesce(text.rlike("[0-9@]"), F.lit(False)), F.regexp_extract_all(text, F.lit(one), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Each step is a column of its own and used more than once, so that Spark works it out once per row.
    matched = df.select(row, found.alias("found"))
    told = matched.select("row", "found", F.transform("found", lambda m: pseudonym(m, key, inverse)).alias("told"))
    gaps = F.split(F.col(f"row.`{text_col}`"), one, -1)
    filled = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("told"), i)["value"], F.get(F.col("found"), i), F.lit(""))))
    text = F.when(F.size("found") > 0, F.array_join(filled, "")).otherwise(F.col(f"row.`{text_col}`"))
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    if kinds:
        columns.append(F.filter(F.transform("told", lambda t: t["kind"]), lambda k: k.isNotNull()).alias(kinds))
    return told.select(*columns)
