"""Retailers' price strings and product titles, by expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwatch.functions.once import let

# Word lists of the product model: fixed values.
BRANDS = (
    "samsung oneplus xiaomi redmi realme motorola nothing google apple iphone vivo oppo poco infinix tecno lava iqoo honor asus lenovo acer hp "
    "dell msi microsoft lg sony boat jbl sennheiser bose noise skullcandy marshall beats soundcore anker"
).split()
NOISE = (
    "smartphone mobile phone 5g 4g lte ai new latest with and the for buy online best price in india laptop notebook headphone headphones earbuds "
    "earphone wireless bluetooth true tws gaming official warranty launched edition"
).split()
COLOURS = (
    "black white blue green red grey gray silver gold purple pink yellow orange titanium graphite midnight starlight onyx marble cream lavender mint "
    "obsidian phantom cosmic aurora twilight charcoal platinum sage navy teal bronze copper ivory beige violet amber"
).split()
UNITS = ("gb", "tb", "ram", "rom")


def _unaccented() -> tuple[str, str]:
    """Letters that compatibility decomposition turns into one ASCII character and marks, and that character; marks themselves go."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)) for c in map(chr, range(0x80, 0x2FA20)) if unicodedata.normalize("NFKD", c) != c]
    single = [(c, p.lower()) for c, p in pairs if len(p) == 1]
    marks = [c for c in map(chr, range(0x300, 0x370))]
    return "".join(c for c, _ in single) + "".join(marks), "".join(p for _, p in single)


ACCENTED, PLAIN = _unaccented()


def _words(names: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def parse_price(raw: Column) -> Column:
    """A rupee amount from a label; null where there is none between 1 and 10 million."""
    text = F.regexp_replace(raw, "₹|Rs\\.|Rs", " ")
    text = F.regexp_replace(text, r"(?i)\b(mrp|m\.r\.p\.?|price|from|starting|at)\b", " ")
    text = F.replace(F.btrim(F.regexp_replace(text, "[^0-9.,]", ""), F.lit(".,")), F.lit(","), F.lit(""))
    # of several dots only the last is a decimal point
    text = F.regexp_replace(text, r"\.(?=.*\.)", "")
    value = text.try_cast("double")
    return F.when((value >= 1) & (value <= 10_000_000), F.round(value, 2))


def parse_int(raw: Column) -> Column:
    """The first run of digits and commas as an int."""
    return F.replace(F.nullif(F.regexp_extract(raw, r"\d[\d,]*", 0), F.lit("")), F.lit(","), F.lit("")).try_cast("int")


def _gigabytes(match: Column) -> Column:
    number = F.regexp_extract(match, r"(\d+)", 1).try_cast("long")
    return F.when(F.lower(match).contains("tb"), number * 1024).otherwise(number)


def _capacity(gb: Column) -> Column:
    return F.when((gb >= 1024) & (gb % 1024 == 0), F.concat((gb / 1024).cast("long").cast("string"), F.lit("tb"))).otherwise(F.concat(gb.cast("string"), F.lit("gb")))


def variant_of(title: Column) -> Column:
    """RAM and storage: labelled amounts first, else the least and greatest of those named."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(r"(?i)\d+\s*(?:gb|tb)\b"), 0), _gigabytes)))
    ram = F.nullif(F.regexp_extract(title, r"(?i)(\d+)\s*gb\s*ram", 1), F.lit("")).try_cast("long")
    storage = _gigabytes(F.nullif(F.regexp_extract(title, r"(?i)\d+\s*(?:gb|tb)\s*(?:rom|storage|internal)", 0), F.lit("")))

    def named(told: Column) -> Column:
        first = F.coalesce(told["ram"], F.when(F.size(told["found"]) >= 2, F.try_element_at(told["found"], F.lit(1))))
        return F.struct(first.alias("ram"), F.coalesce(told["storage"], F.try_element_at(told["found"], F.lit(-1))).alias("storage"))

    def text(told: Column) -> Column:
        ram, storage = told["ram"], told["storage"]
        both = (ram > 0) & (storage > 0) & (ram != storage)
        return F.when(both, F.concat(ram.cast("string"), F.lit("gb-"), _capacity(storage))).when(storage > 0, _capacity(storage))

    return let(F.struct(found.alias("found"), ram.alias("ram"), storage.alias("storage")), lambda told: let(named(told), text))


def brand_of(text: Column) -> Column:
    """The brand named first in a lower-cased text; of several there, the longest."""
    # one pattern: the leftmost match, and at a place the alternatives in order
    named = rf"\b({'|'.join(sorted(BRANDS, key=len, reverse=True))})\b"
    return let(F.nullif(F.regexp_extract(text, named, 1), F.lit("")), lambda first: F.when(first == "iphone", F.lit("apple")).otherwise(first))


def title_case(text: Column) -> Column:
    """Upper case after anything but a letter."""
    parts = F.regexp_extract_all(text, F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def plain_text(title: Column) -> Column:
    """Lower case, without accents, bracketed blocks and signs."""
    text = F.translate(F.lower(F.trim(title)), ACCENTED, PLAIN)
    text = F.regexp_replace(text, r"[(\[{].*?[)\]}]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9\s\-+]", " "), r"\s+", " "))


def parse_title(title: Column, apart: bool = False) -> Column:
    """struct(match_key, brand, model, variant, canonical_title, is_confident): what titles of one product share across sellers.

    Numbers of five digits and more are no part of a model; with ``apart`` they are where no brand is known, since such titles are not told apart by anything else.
    """
    told = lambda own, text: F.struct(own.alias("own"), text.alias("text"), variant_of(own).alias("variant"), brand_of(text).alias("brand"))
    return let(F.trim(title), lambda own: let(plain_text(own), lambda text: let(told(own, text), lambda t: _parsed(t, apart))))


def _parsed(told: Column, apart: bool) -> Column:
    brand, variant = told["brand"], told["variant"]
    drop = _words([*NOISE, *COLOURS, *UNITS])
    stray = lambda t: t.rlike(r"^\d{5,}$") & brand.isNotNull() if apart else t.rlike(r"^\d{5,}$")
    keep = lambda t: (
        ~F.array_contains(drop, t) & (brand.isNull() | (t != brand)) & ~t.rlike(r"^\d+(gb|tb)$") & ~stray(t) & (t != "")
    )
    tokens = F.slice(F.filter(F.split(told["text"], " "), keep), 1, 4)

    def named(model: Column) -> Column:
        bits = F.nullif(F.concat_ws(" ", brand, model, variant), F.lit(""))
        return F.struct(
            F.concat_ws("|", F.coalesce(brand, F.lit("unknown")), F.coalesce(model, F.lit("unknown")), variant).alias("match_key"),
            brand.alias("brand"),
            model.alias("model"),
            variant.alias("variant"),
            F.coalesce(title_case(bits), told["own"]).alias("canonical_title"),
            (brand.isNotNull() & model.isNotNull()).alias("is_confident"),
        )

    return let(F.nullif(F.array_join(tokens, " "), F.lit("")), named)
