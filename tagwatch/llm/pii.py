"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are matched by one pattern and validated by kind: card numbers by
their check digit, IBANs by modulus, addresses by octet range, dates by the
calendar, social security numbers by their reserved parts.  A valid value
becomes a sequence of symbols, each with a radix; a keyed Feistel network
permutes the sequence within those radices (halves shifted in turn by a hash
of the other half), check digits are computed anew, and the text is put
together again.  The map is one-to-one within a format, so equal values keep
equal pseudonyms in all documents, and different values differ.

Card numbers and IBANs are matched with the numbers that follow them, and the
run is looked through group by group: a card number is the first of the usual
forms, or else the longest part of 13 to 19 digits, that ends with a group and
is valid, an IBAN has its country's length; what they do not take is searched
for other values.

Kinds: card, iban, date, ip, phone, ssn, email (the part before the @).

Defined results: a null text stays null, a text without valid values stays as
it is; nothing else of a row is touched, whatever the columns are called (but
for the one named by count, which must be new); repeated rows are treated
alike; the same key gives the same pseudonyms in every run.  Time is linear in
a text's length but for values that follow one another in one run, of which
each costs a copy of the list so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwatch.llm.scratch import fresh, quoted

ROUNDS = 8
#: The pseudonyms' key where none is given; give a secret one in production.
KEY = "tagwatch-pseudonyms"

_BEFORE, _AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Loops over groups are possessive: those Java runs without recursion, however long a domain or a run is.
EMAIL = rf"[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+{_AFTER})++"
#: Lengths of IBANs by country (the registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
DATE = r"(?:1[89]|2[01])[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|1[0-2])\2(?:1[89]|2[01])[0-9]{2}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Numbers that follow a card number or IBAN: whether they are part of it, or values themselves, is told with the run.
_TAIL = rf"(?:[ ./-](?!{EMAIL})[0-9]+{_AFTER})*+"
#: The first kind that matches at a place is taken; runs are looked through group by group.
RUN = rf"(?:{IBAN}|[0-9](?:(?:[ -](?!{EMAIL}))?[0-9]){{12,18}}){_AFTER}{_TAIL}"
ANY = f"{_BEFORE}(?:(?:{EMAIL}|{IP}|{DATE}|{SSN}|{PHONE}){_AFTER}|{RUN})"
#: Characters that a value in a run can have, and more.
_WINDOW = 64
#: Usual forms of card numbers, looked for before any other: unbroken, 4-4-4-4, 4-6-5 and 4-6-4.
_CARD_FORMS = (r"[0-9]{13,19}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}")

_SYMBOL = "struct<base:int,v:int,m:int>"


def _symbol(base: Column | int, v: Column | int, m: Column | int) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(as_int(base).alias("base"), as_int(v).alias("v"), as_int(m).alias("m"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(half: Column, other: Column, key: str, turn: int) -> Column:
    """half, each symbol moved within its radix by the keyed hash of the other half."""
    told = F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ",")
    digest = F.sha2(F.concat(F.lit(f"{key}|{turn}|"), F.size(half).cast("string"), F.lit("|"), told), 256)
    return _let(
        digest,
        lambda h: F.transform(
            half,
            lambda s, i: _symbol(s["base"], F.pmod(s["v"] + F.conv(F.substring(h, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), s["m"]), s["m"]),
        ),
    )


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _round(key: str, turn: int) -> Callable[[Column], Column]:
    """One turn: the halves move alternately."""
    if turn % 2 == 0:
        return lambda x: _pair(_shifted(x["a"], x["b"], key, turn), x["b"])
    return lambda x: _pair(x["a"], _shifted(x["b"], x["a"], key, turn))


def feistel(symbols: Column, key: str) -> Column:
    """A keyed permutation of symbol arrays that have the same bases and radices."""
    cut = F.ceil(F.size(symbols) / 2).cast("int")
    state = _let(symbols, lambda s: _pair(F.slice(s, 1, cut), F.slice(s, cut + 1, F.size(s))))
    for turn in range(ROUNDS):
        state = _let(state, _round(key, turn))
    return _let(state, lambda x: F.concat(x["a"], x["b"]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _char_symbol(c: Column) -> Column:
    """Digits within digits, letters within their case; any other character stays."""
    code = F.ascii(c)
    for_range = lambda low, n: _symbol(F.lit(low), code - low, F.lit(n))
    return F.when(c.between("0", "9"), for_range(48, 10)).when(c.between("a", "z"), for_range(97, 26)).when(c.between("A", "Z"), for_range(65, 26)).otherwise(_symbol(code, 0, 1))


def _text(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: F.char(s["base"] + s["v"])), "")


def _moved(symbols: Column, key: str) -> Column:
    """Only symbols with a choice go through the network; the others keep their places."""
    free = feistel(F.filter(symbols, lambda s: s["m"] > 1), key)
    filled = lambda new: F.transform(
        symbols, lambda s, i: F.when(s["m"] > 1, F.get(new, F.size(F.filter(F.slice(symbols, 1, i), lambda x: x["m"] > 1)))).otherwise(s)
    )
    return _let(free, filled)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column, skip: int) -> Column:
    """The Luhn sum; skip 0: with the check digit, 1: of what stands before it."""
    backwards = F.reverse(_chars(digits))
    doubled = F.transform(backwards, lambda d, i: F.when(F.pmod(i, F.lit(2)) == 1 - skip, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))


def _into(template: Column, digits: Column) -> Column:
    """The template's digits replaced in turn."""
    chars = _chars(template)
    return F.array_join(
        F.transform(
            chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(template, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
        ),
        "",
    )


def _valid_card(value: Column) -> Column:
    return F.pmod(_luhn(_digits(value), 0), F.lit(10)) == 0


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = _text(_moved(F.transform(_chars(body), _char_symbol), f"{key}|card"))
    whole = _let(new, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn(b, 1), F.lit(10)), F.lit(10)).cast("string")))
    return F.when(_valid_card(value), _let(whole, lambda w: _into(value, w)))


def _mod97(text: Column) -> Column:
    """text: letters and digits; letters count from 10 to 35."""
    return F.aggregate(
        _chars(text), F.lit(0), lambda a, c: F.pmod(F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    )


def _valid_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = _text(_moved(F.transform(_chars(body), _char_symbol), f"{key}|iban"))
    whole = _let(new, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    spaced = lambda w: F.array_join(
        F.transform(_chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substring(w, F.length(F.replace(F.substring(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), ""
    )
    return F.when(_valid_iban(value), _let(whole, spaced))


def _date(value: Column, key: str) -> Column:
    """Days of the four centuries from 1800, a whole calendar cycle of 146097 = 189 * 773 days."""
    first = value.rlike("^[0-9]{4}")
    mark = F.when(first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    d = _digits(value)
    iso = F.when(first, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(
        F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    )
    origin = F.lit("1800-01-01").cast("date")
    day = F.datediff(iso.try_cast("date"), origin)
    moved = feistel(F.array(_symbol(0, F.floor(day / 773), 189), _symbol(0, F.pmod(day, F.lit(773)), 773)), f"{key}|date")
    new = _let(moved, lambda s: F.date_add(origin, (s[0]["v"] * 773 + s[1]["v"]).cast("int")))
    written = lambda x: F.when(first, F.concat_ws("", F.date_format(x, "yyyy"), mark, F.date_format(x, "MM"), mark, F.date_format(x, "dd"))).otherwise(
        F.concat_ws("", F.date_format(x, "dd"), mark, F.date_format(x, "MM"), mark, F.date_format(x, "yyyy"))
    )
    return F.when(day.between(0, 146096), _let(new, written))


def _ip(value: Column, key: str) -> Column:
    """The first octet within 1 to 255, the others within 0 to 255."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    symbols = F.transform(octets, lambda x, i: F.when(i == 0, _symbol(1, x - 1, 255)).otherwise(_symbol(0, x, 256)))
    new = F.array_join(F.transform(feistel(symbols, f"{key}|ip"), lambda s: (s["base"] + s["v"]).cast("string")), ".")
    return F.when(F.forall(octets, lambda x: x <= 255) & F.element_at(octets, 1).between(1, 255), new)


def _phone(value: Column, key: str) -> Column:
    """The country code stays; in North American numbers, area and exchange keep to 2 to 9."""
    code = F.regexp_extract(value, r"^\+(?:1(?=[^0-9])|[0-9]{1,3}(?=[^0-9])|[0-9]{2})", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    american = (code.isin("", "+1")) & (F.length(_digits(rest)) == 10)
    place = lambda i: F.length(_digits(F.substring(rest, F.lit(1), i + 1)))
    symbol = lambda c, i: F.when(american & c.between("2", "9") & place(i).isin(1, 4), _symbol(50, F.ascii(c) - 50, 8)).otherwise(_char_symbol(c))
    new = _text(_moved(F.transform(_chars(rest), symbol), f"{key}|phone"))
    return F.when(F.length(_digits(value)).between(8, 15) | american, F.concat(code, new))


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(F.array(_symbol(0, rank, 898), _symbol(0, group - 1, 99), _symbol(0, serial - 1, 9999)), f"{key}|ssn")
    three = lambda v: F.lpad(F.when(v >= 665, v + 2).otherwise(v + 1).cast("string"), 3, "0")
    new = _let(moved, lambda s: F.concat_ws("-", three(s[0]["v"]), F.lpad((s[1]["v"] + 1).cast("string"), 2, "0"), F.lpad((s[2]["v"] + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new)


def _email(value: Column, key: str) -> Column:
    name, rest = F.substring_index(value, "@", 1), F.concat(F.lit("@"), F.substring_index(value, "@", -1))
    return F.concat(_text(_moved(F.transform(_chars(name), _char_symbol), f"{key}|email")), rest)


_KINDS = (("email", EMAIL, _email), ("iban", IBAN, _iban), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("phone", PHONE, _phone), ("card", CARD, _card))


def _kind(value: Column) -> Column:
    kind = F.lit("")
    for name, pattern, _ in reversed(_KINDS):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of a matched value, or the value itself where it is not valid."""
    def of_kind(told: Column) -> Column:
        chosen = told["value"]
        for name, _, of in reversed(_KINDS):
            chosen = F.when(told["kind"] == name, of(told["value"], key)).otherwise(chosen)
        return F.coalesce(chosen, told["value"])

    return _let(F.struct(value.alias("value"), _kind(value).alias("kind")), of_kind)


def _grouped(n: int) -> str:
    """n characters in groups of four."""
    return f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")


def _iban_forms() -> list[str]:
    """IBANs of the registry's countries by their lengths; of others by any length, the longest first."""
    known = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}{_grouped(n - 4)}" for n, names in IBAN_LENGTHS.items()]
    every = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return [f"(?:{'|'.join(known)})", *(f"(?!{every})[A-Z]{{2}}[0-9]{{2}}{_grouped(n - 4)}" for n in range(34, 14, -1))]


def _head(text: Column, forms: list[str], valid: Callable[[Column], Column]) -> Column:
    """The first valid one of what the forms match at the start of the text, where they end at a boundary; or null."""
    return F.get(F.filter(F.array(*[F.regexp_extract(text, f"^(?:{x}){_AFTER}", 0) for x in forms]), lambda x: F.when(x != "", valid(x)).otherwise(False)), 0)


def _value_at(text: Column) -> Column:
    """The value at the start of the text, or null: a valid card number or IBAN, or what may be of another kind."""
    other = F.regexp_extract(text, f"^(?:{IP}|{DATE}|{SSN}|{PHONE}){_AFTER}", 0)
    cards = [*_CARD_FORMS, *(rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1))]
    return F.when(text.rlike("^[A-Z]"), _head(text, _iban_forms(), _valid_iban)).when(other != "", other).otherwise(_head(text, cards, _valid_card))


_PARTS = "array<struct<text:string,value:boolean>>"


def _part(text: Column, value: bool) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(value).alias("value")))


def _parts(match: Column) -> Column:
    """The match, or the values in a run and what lies between; a value may start at each group that no value before it has taken."""
    groups = F.split(match, "(?<=[ ./-])(?=[0-9A-Z])")
    # of every group: its length, and the text from there on
    told = _let(groups, lambda g: F.transform(g, lambda x, i: F.struct(F.length(x).alias("n"), F.substring(F.array_join(F.slice(g, i + 1, F.lit(_WINDOW // 2)), ""), 1, _WINDOW).alias("text"))))
    state = lambda start, at, parts: F.struct(start.cast("int").alias("start"), at.cast("int").alias("at"), parts.cast(_PARTS).alias("parts"))

    def step(a: Column, group: Column) -> Column:
        start, after = a["start"], a["start"] + group["n"]
        taken = lambda v: F.when(
            v.isNotNull(), state(after, start + F.length(v), F.concat(a["parts"], _part(F.substring(match, a["at"] + 1, start - a["at"]), False), _part(v, True)))
        ).otherwise(state(after, a["at"], a["parts"]))
        return F.when(start < a["at"], state(after, a["at"], a["parts"])).otherwise(_let(_value_at(group["text"]), taken))

    done = F.aggregate(told, state(F.lit(0), F.lit(0), F.array()), step, lambda x: F.concat(x["parts"], _part(F.substring(match, x["at"] + 1, F.length(match)), False)))
    return F.when(match.rlike(f"^(?:{RUN})$"), done).otherwise(_part(match, True))


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the text's valid values replaced; count: a column to add with the number of values replaced."""
    own = F.col(f"`{text}`")
    values, pieces, parts, new = fresh(docs, "values", "pieces", "parts", "new")
    has = own.rlike("[0-9]|@") & own.rlike(ANY)
    told = docs.withColumn(values, F.when(has, F.regexp_extract_all(own, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    told = told.withColumn(pieces, F.when(has, F.split(own, ANY, -1)).otherwise(F.array(own)))
    each = F.transform(pieces, lambda p, i: F.concat(_part(p, False), F.when(i < F.size(values), _parts(F.get(values, i))).otherwise(F.array().cast(_PARTS))))
    told = told.withColumn(parts, F.when(F.size(values) > 0, F.flatten(each)))
    told = told.withColumn(new, F.transform(parts, lambda x: F.when(x["value"], pseudonym(x["text"], key)).otherwise(x["text"])))
    changed = F.coalesce(F.array_join(new, ""), own)
    number = F.size(F.filter(F.arrays_zip(F.col(parts).alias("old"), F.col(new).alias("new")), lambda z: z["old"]["text"] != z["new"])).cast("long")
    number = F.when(F.col(parts).isNull(), F.lit(0)).otherwise(number)
    columns = [changed.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns]
    return told.select(*columns, *([number.alias(count)] if count else []))
