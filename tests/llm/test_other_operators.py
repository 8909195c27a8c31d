"""PII, toxicity, HTML, embeddings, URLs and the pipeline."""

import datetime
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwatch.llm import embedding_dedup, html_extract, pii, queries, toxicity, url_filter
from tagwatch.llm import components as components_module
from tagwatch.llm.components import components

SF = "/root/testdata/sf0.01"


def luhn(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


VALUES = ["4349000490986231", "4111 1111-1111 1111", "+1 (543) 555-9258", "hnp.46@mail3.example.com", "67.190.110.215", "2024-02-29", "31.12.1999", "123-45-6789", "GB82 WEST 1234 5698 7654 32"]
INVALID = ["4349000490986232", "999.1.1.1", "2023-02-30", "000-45-6789", "version 4.0.", "GB83 WEST 1234 5698 7654 32"]


def test_pseudonyms_keep_their_format(spark):
    text = "; ".join(VALUES)
    rows = [(1, text), (2, f"again {VALUES[0]} end"), (3, " | ".join(INVALID)), (4, None), (5, "")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    new = got[1].text.split("; ")
    assert got[1].n == len(VALUES) and not set(new) & set(VALUES)
    shape = lambda x: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", x)))
    assert [shape(a) for k, a in enumerate(new) if k != 4] == [shape(a) for k, a in enumerate(VALUES) if k != 4]
    assert luhn(new[0]) and luhn(new[1]) and all(0 <= int(x) <= 255 for x in new[4].split("."))
    assert got[2].text == f"again {new[0]} end"  # linked across documents
    assert got[3].text == " | ".join(INVALID) and got[3].n == 0
    assert got[4].text is None and got[5].text == ""
    other = pii.pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string"), key="another").first().text
    assert other != got[1].text


IBANS = ("ES9121000418450200051332", "GB82 WEST 1234 5698 7654 32")
AROUND = [
    ("4111111111111111", "{} 12/25"), ("4111111111111111", "{} 1 item"), ("4111111111111111", "{} 12"), ("4111 1111 1111 1111", "{} 123"), ("4111 1111 1111 1111", "{} 12/25 123"),
    ("4111111111111111", "2 {}"), ("4111111111111111", "no. 12 {} 3 x"), ("378282246310005", "{} 1234"), ("3782 822463 10005", "{} 12-25"), ("411111 1111111111", "{} 12/25"),
    (IBANS[0], "{} BIC CAIXESBBXXX"), (IBANS[0], "{} 12"), (IBANS[1], "{} BIC"), (IBANS[1], "{} 4 items"), ("ES91 2100 0418 4502 0005 1332", "IBAN {} BIC X"), ("4111 1111 1111 1111", "AB12 {}"),
]


def test_values_with_numbers_around_them(spark):
    rows = [(k, around.format(value)) for k, (value, around) in enumerate(AROUND)] + [(100 + k, value) for k, (value, _) in enumerate(AROUND)]
    both = {200: "378282246310005 2025-01-31", 201: "4111111111111111 123-45-6789", 202: "4111111111111111 10.0.0.1", 203: "4111111111111111 555-123-4567", 204: "4111111111111111 12.bob@example.com", 205: "4111111111111111 4349000490986231"}
    none = {300: "4349000490986232", 301: "1 2 3 4", 302: "GB83 WEST 1234 5698 7654 32 BIC", 303: " ".join(["0.5"] * 30_000)}
    docs = spark.createDataFrame([*rows, *both.items(), *none.items()], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(docs, count="n").collect()}
    for k, (value, around) in enumerate(AROUND):
        alone = got[100 + k][0]
        assert alone != value and got[k] == (around.format(alone), 1), value
    card = got[100][0]
    assert all(got[k][1] == 2 for k in both) and all(got[k][0].startswith(f"{card} ") for k in range(201, 206))
    assert all(got[k][0].split(" ")[1] != text.split(" ")[1] for k, text in both.items())
    assert re.fullmatch(r"\d\d\.[a-z]{3}@example\.com", got[204][0].split(" ")[1]) and not got[204][0].split(" ")[1].startswith("12.")
    assert all(got[k] == (text, 0) for k, text in none.items())


def moved_by_hand(text, key, symbols=None):
    """Digits within digits, letters within their case, or the given (base, value, radix); the rest stays."""
    told = symbols or [(48, ord(c) - 48, 10) if c.isdigit() else (97, ord(c) - 97, 26) if c.islower() else (65, ord(c) - 65, 26) if c.isupper() else (ord(c), 0, 1) for c in text]
    free = [(v, m) for _, v, m in told if m > 1]
    new = iter(feistel_by_hand([v for v, _ in free], [m for _, m in free], key))
    return "".join(chr(b + (next(new) if m > 1 else 0)) for b, _, m in told)


def check_digit(body):
    return str(next(d for d in range(10) if luhn(f"{body}{d}")))


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def refilled(template, chars, keep):
    new = iter(chars)
    return "".join(c if c in keep else next(new) for c in template)


def pseudonym_by_hand(value, key):
    """By plain Python, kind after kind; None where the value is not valid."""
    is_a = lambda pattern: re.fullmatch(pattern, value, re.A)
    digits = re.sub(r"\D", "", value)
    if is_a(pii.EMAIL):
        name, at = value.split("@")
        return f"{moved_by_hand(name, key + '|email')}@{at}"
    if is_a(pii.IBAN):
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = moved_by_hand(plain[4:], f"{key}|iban")
        return refilled(value, f"{plain[:2]}{98 - mod97(f'{body}{plain[:2]}00'):02d}{body}", " ")
    if is_a(pii.IP):
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or not octets[0]:
            return None
        new = feistel_by_hand([octets[0] - 1, *octets[1:]], [255, 256, 256, 256], f"{key}|ip")
        return ".".join(map(str, [new[0] + 1, *new[1:]]))
    if is_a(pii.DATE):
        first = bool(re.match(r"\d{4}", value))
        y, m, d = (int(x) for x in (re.split(r"[-/.]", value) if first else reversed(re.split(r"[-/.]", value))))
        origin = datetime.date(1800, 1, 1)
        try:
            day = (datetime.date(y, m, d) - origin).days
        except ValueError:
            return None
        if not 0 <= day <= 146096:
            return None
        a, b = feistel_by_hand([day // 773, day % 773], [189, 773], f"{key}|date")
        new, mark = origin + datetime.timedelta(a * 773 + b), value[4 if first else 2]
        return new.strftime(f"%Y{mark}%m{mark}%d" if first else f"%d{mark}%m{mark}%Y")
    if is_a(pii.SSN):
        area, group, serial = (int(x) for x in value.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, g, n = feistel_by_hand([area - 2 if area > 666 else area - 1, group - 1, serial - 1], [898, 99, 9999], f"{key}|ssn")
        return f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{n + 1:04d}"
    if is_a(pii.PHONE):
        code = (re.match(r"\+(?:1(?=\D)|\d{1,3}(?=\D)|\d{2})", value) or [""])[0]
        rest = value[len(code) :]
        american = code in ("", "+1") and len(re.sub(r"\D", "", rest)) == 10
        if not (8 <= len(digits) <= 15 or american):
            return None
        symbols, n = [], 0
        for c in rest:
            n += c.isdigit()
            symbols.append((50, ord(c) - 50, 8) if american and "2" <= c <= "9" and n in (1, 4) else (48, ord(c) - 48, 10) if c.isdigit() else (ord(c), 0, 1))
        return code + moved_by_hand(rest, f"{key}|phone", symbols)
    if is_a(pii.CARD) and luhn(value):
        body = moved_by_hand(digits[:-1], f"{key}|card")
        return refilled(value, body + check_digit(body), " -")
    return None


def value_at_by_hand(text):
    """The value that a run's text starts with."""
    end = pii._AFTER
    first = lambda pattern: (re.match(f"(?:{pattern}){end}", text, re.A) or [""])[0]
    if re.match("[A-Z]", text):
        known = {c: n for n, names in pii.IBAN_LENGTHS.items() for c in names.split()}
        for n in [known[text[:2]]] if text[:2] in known else range(34, 14, -1):
            found = first(r"[A-Z]{2}\d{2}" + r"(?: ?[A-Z0-9]{4})" * ((n - 4) // 4) + (r" ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else ""))
            plain = found.replace(" ", "")
            if found and mod97(plain[4:] + plain[:4]) == 1:
                return found
        return None
    if other := first(f"{pii.IP}|{pii.DATE}|{pii.SSN}|{pii.PHONE}"):
        return other
    for form in (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", *(r"\d(?:[ -]?\d){%d}" % (n - 1) for n in range(19, 12, -1))):
        if (found := first(form)) and luhn(found):
            return found
    return None


def pseudonymised_by_hand(text, key=pii.KEY):
    out, at, n = [], 0, 0
    for m in re.finditer(pii.ANY, text or "", re.A):
        run = bool(re.fullmatch(pii.RUN, m[0], re.A))
        starts = [0, *(k.end() for k in re.finditer(r"(?<=[ ./-])(?=[0-9A-Z])", m[0]))] if run else [0]
        done = 0
        for start in starts:
            if start < done:
                continue
            value = value_at_by_hand(m[0][start : start + 64]) if run else m[0]
            new = value and pseudonym_by_hand(value, key)
            if value:
                out += [text[at : m.start() + start], new or value]
                n += new is not None and new != value
                at, done = m.start() + start + len(value), start + len(value)
    return None if text is None else "".join(out) + text[at:], n


def test_pii_equals_brute_force(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def value():
        body = digits(15)
        card, day = body + check_digit(body), f"{rng.randrange(1, 29):02d}"
        bban = digits(18)
        return rng.choice([
            card, f"{card[:4]} {card[4:8]}-{card[8:12]} {card[12:]}", digits(16), f"DE{98 - mod97(f'{bban}DE00'):02d}{bban}", f"DE{digits(20)}", f"GB82 WEST 1234 5698 7654 3{rng.choice('23')}",
            ".".join(str(rng.randrange(300)) for _ in range(4)), f"{rng.randrange(1790, 2199)}-0{rng.randrange(1, 10)}-{day}", f"{day}.1{rng.randrange(3)}.{rng.randrange(1800, 2100)}", "2023-02-30",
            f"{digits(3)}-{digits(2)}-{digits(4)}", f"+49 {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 {digits(3)}.{digits(3)}.{digits(4)}",
            f"Bob.{digits(2)}@mail{digits(1)}.example.com", "a@b", "a_b@c.de_f", "x@y.z.w_", digits(rng.randrange(1, 9)), "word", "BIC", "12/25",
        ])

    texts = [rng.choice(["", " ", "("]) + "".join(value() + rng.choice([" ", ", ", "; ", "\n", ".", " and "]) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [None, "", *VALUES, *INVALID]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymise(docs, count="n").collect()}
    for k, text in enumerate(texts):
        assert got[k] == pseudonymised_by_hand(text), text
    assert sum(n for _, n in got.values()) > 400


@pytest.mark.parametrize("unit", ["x a@" + "b." * 500_000 + "b", "4111111111111111" + " 12" * 300_000, "9" * 1_000_000, "GB82 " + "WEST 1234 " * 100_000, "a" * 1_000_000 + "@b.c", "1.2." * 250_000, "+1 " * 300_000, "a.b@c" * 200_000])
def test_pii_of_very_long_texts(spark, unit):
    began = time.time()
    got = pii.pseudonymise(spark.createDataFrame([(1, unit)], "doc_id long, text string")).first().text
    assert (len(got) == len(unit) or unit.startswith("1.2.")) and time.time() - began < 120  # octets change their lengths


def test_pii_of_clashing_columns(spark):
    row = (1, "mail bob@example.com", 7, [1], "x", None)
    columns = "doc_id long, text string, own_values int, own_pieces array<int>, `a.b` string, __parts string"
    got = pii.pseudonymise(spark.createDataFrame([row, row], columns), count="n")
    assert got.columns == ["doc_id", "text", "own_values", "own_pieces", "a.b", "__parts", "n"]
    rows = got.collect()
    assert rows[0] == rows[1] and tuple(rows[0])[2:] == (*row[2:], 1) and rows[0].text != row[1]


def test_pseudonyms_are_one_to_one(spark):
    days = spark.range(20_000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("v"))
    assert days.select(pii.pseudonym(F.col("v")).alias("p")).distinct().count() == 20_000
    ssn = spark.range(1, 5_000).select(F.format_string("123-45-%04d", "id").alias("v"))
    assert ssn.select(pii.pseudonym(F.col("v")).alias("p")).distinct().count() == 4_999


def feistel_by_hand(values, radices, key):
    import hashlib

    cut = -(-len(values) // 2)
    halves = [(list(values[:cut]), radices[:cut]), (list(values[cut:]), radices[cut:])]
    for turn in range(pii.ROUNDS):
        (own, m), (other, _) = (halves[0], halves[1]) if turn % 2 == 0 else (halves[1], halves[0])
        h = hashlib.sha256(f"{key}|{turn}|{len(own)}|{','.join(map(str, other))}".encode()).hexdigest()
        for i in range(len(own)):
            own[i] = (own[i] + int(h[i % 16 * 4 : i % 16 * 4 + 4], 16)) % m[i]
    return halves[0][0] + halves[1][0]


def test_feistel_equals_plain_python(spark):
    values = [4, 3, 4, 9, 0, 0, 0, 4, 9, 0, 9, 8, 6, 2, 3]
    want = "".join(map(str, feistel_by_hand(values, [10] * 15, f"{pii.KEY}|card")))
    got = spark.createDataFrame([("4349000490986231",)], "v string").select(pii.pseudonym(F.col("v")).alias("p")).first().p
    assert got[:15] == want


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(labels[i], rows[i].predicted) for i in labels if rows[i].held_out]
    hits, false = sum(y and p for y, p in held), sum(p and not y for y, p in held)
    assert hits / sum(y for y, _ in held) > 0.8 and false <= 0.05 * hits
    assert any(r.passages for r in rows.values())


def test_maximal_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, 2.0]) for _ in range(rng.randrange(1, 14))]
        scored = [(k, s) for k, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(scored, drift=-1.0)

        def split(a, b, scores=scores):
            best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*split(a, i), best[0], *split(j, b)]

        assert sorted(s for _, _, s in got) == sorted(split(0, len(scores)))


def test_toxicity_merges_only_near_copies(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, copy = some(30), some(200)
    texts = [f"{some(30)} {shared} {some(30)}" for _ in range(30)] + [f"{copy} one", f"{copy} two", f"{copy} two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen = spark.createDataFrame([(k, float(k % 2)) for k in range(33)], "doc_id long, y double")
    got = {bytes(r.words).decode(): r.y for r in toxicity._texts(docs, chosen).collect()}
    want = {text: float(k % 2) for k, text in enumerate(texts[:30])} | {f"{copy} one": 1 / 3}  # labels 0, 1 and 0
    assert got.keys() == want.keys() and all(abs(got[k] - y) < 1e-12 for k, y in want.items())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "some text", 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.report(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.report(docs.limit(0), none).count() == 0
    model = toxicity.fit(docs, none)
    assert toxicity.clean(docs, model).columns == docs.columns and toxicity.clean(docs, model).count() == 3


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu<li>More</ul></nav>
<aside class="sidebar">Related things, many of them, here.</aside><div class="cookie-notice">We use cookies.</div><main><article><h1>A  title</h1><p>First &amp; foremost,
a long sentence.<p>Second <b>bold</b> part<br>goes on; and on.<ul><li>one<li>two</ul><form><input><label>Name</label></form><script>var x = "<p>no</p>";</script></article></main>
<section id="comments"><p>A comment, with words.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A title\nFirst & foremost, a long sentence.\nSecond bold part goes on; and on.\none\ntwo"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") * 0 == ""
    soup = "<div><a href=1>Home</a> <a href=2>News</a></div><div>" + "".join(f"<p>Sentence {k}, with some words in it, and a mark.</p>" for k in range(6)) + "</div><div><a>Imprint</a></div>"
    assert html_extract.main_text(soup).count("\n") == 5 and "Home" not in html_extract.main_text(soup)


BODY = "<h1>The title</h1><p>First, a long sentence with some words in it.</p><h2>Next</h2><p>Second, another long sentence, which ends here.</p>"
BODY_TEXT = "The title\nFirst, a long sentence with some words in it.\nNext\nSecond, another long sentence, which ends here."


@pytest.mark.parametrize("wrapper", ['class="site no-sidebar"', 'class="content has-sidebar"', 'class="sidebar"', 'id="main-header"', 'class="social"'])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_hints_around_the_whole_page(wrapper, inner):
    page = f"<body class='sidebar'><nav>Menu</nav><div {wrapper}><{inner}>{BODY}</{inner}></div><footer>Us</footer></body>"
    assert html_extract.main_text(page) == BODY_TEXT


@pytest.mark.parametrize("name", ["related-work", "social-impact", "side-effects", "legal-framework", "related", "legal"])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_anchors_are_no_hints(name, outer):
    page = f'<{outer}><header class="entry-header"><h1>The title</h1></header>{BODY}<h2 id="{name}">Anchor</h2><p>Third, a sentence of the section, quite long.</p></{outer}>'
    want = f"{BODY_TEXT}\nAnchor\nThird, a sentence of the section, quite long."
    assert html_extract.main_text(page) == ("The title\n" if outer == "article" else "") + want
    page = f'<article>{BODY}<section id="{name}"><h2>Anchor</h2><p>Third, a sentence of the section, quite long.</p></section></article>'
    assert html_extract.main_text(page) == want


def test_hints_beside_the_text():
    beside = '<div class="share"><a href=1>Tweet</a> <a href=2>Mail</a></div>'
    assert html_extract.main_text(f"<article>{BODY}{beside}</article>") == BODY_TEXT
    for name in ("sidebar", "cookie-notice", "site-footer"):
        assert html_extract.main_text(f'<div>{BODY}</div><div class="{name}">Words at the margin, some of them.</div>') == BODY_TEXT


def test_html_of_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n".join(x for x in lines if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, 3), (1, "u", "", 3)], "page_id long, url string, html string, n_chars int")
    assert [r.text for r in html_extract.extract(odd).collect()] == ["", ""]


def test_the_ratios_decide(monkeypatch):
    page = f"<body><article>{BODY}<p>Short note</p></article><div>Some words beside it, not many.</div></body>"
    usual = html_extract.main_text(page)
    assert usual == f"{BODY_TEXT}\nShort note"
    monkeypatch.setattr(html_extract, "SHARE", 1e9)
    assert html_extract.main_text(page) == ""
    monkeypatch.setattr(html_extract, "SHARE", 0.0)
    assert html_extract.main_text(page) == f"{usual}\nSome words beside it, not many."


LONG = "".join(f"<p>Paragraph {k}, with a fair number of words in it, and marks; so it reads as text.</p>" for k in range(5))
LONG_TEXT = "\n".join(f"Paragraph {k}, with a fair number of words in it, and marks; so it reads as text." for k in range(5))
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(6)) + "</ul>"


@pytest.mark.parametrize(("page", "want"), [
    (f"<body><div class=top>{MENU}</div><div class=body><h1>Title</h1>{LONG}</div><div class=end>{MENU}</div></body>", f"Title\n{LONG_TEXT}"),
    (f"<body><div>{MENU}</div><div><div class=head><h1>Title</h1></div>{LONG}<ul><li>one item</li><li>another</li></ul></div></body>", f"Title\n{LONG_TEXT}\none item\nanother"),
    (f"<main>{LONG}<div class=ad>Buy now, it is cheap!</div></main>", LONG_TEXT),
    (f"<main><article>{LONG}</article><div class=ad>Buy this now, it is cheap!</div></main>", LONG_TEXT),
    (f"<main><article>{LONG}<div class=legal><p>By law, this section of the text, on its legal side, is content.</p></div></article></main>", f"{LONG_TEXT}\nBy law, this section of the text, on its legal side, is content."),
    (f"<body><table><tr><td>{MENU}</td><td>{LONG}</td></tr></table></body>", LONG_TEXT),
    (f"<article>{LONG}<p>See <a href=1>this page</a> and <a href=2>that one</a>, too, for more.</p></article>", f"{LONG_TEXT}\nSee this page and that one, too, for more."),
    (f"<body>{LONG}</body>", LONG_TEXT),
    (f"<body><header>Site</header>{LONG}<footer>Us</footer>", LONG_TEXT),
])
def test_pages_of_other_kinds(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 200_000, "<div class=x>text, " * 60_000, '<a title="x>' * 90_000, "<a title='x\">" * 80_000, "<p>don't <b" * 90_000, '<a ="' * 200_000 + ">", "<!--" * 250_000, "<b><i>" * 170_000 + "</b>" * 50_000,
    "<li><div>" + "<b><li>" * 140_000, "a<b>b</b>" * 110_000, "<" * 1_000_000, "<div></p>" * 110_000, "&amp" * 250_000, "<script>" * 120_000, "<x y=" * 200_000,
])
def test_hostile_pages(page):
    import tracemalloc

    tracemalloc.start()
    began = time.process_time()
    html_extract.main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - began < 20 and peak < 400_000_000  # tracing makes both several times as much


def test_html_of_odd_tables(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, PAGE, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1
    assert html_extract.extract(pages.limit(0)).count() == 0


def vectors_by_hand(rows, threshold):
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    count, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, a) in enumerate(usable):
        for j, w, b in usable[:k]:
            if a == b and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                count[i] += 1
                count[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (count[i], root(i)) for i in count}


@pytest.mark.parametrize(("bucket", "block"), [(1024, 4096), (64, 100)])
def test_embedding_links(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(900):
        v = rng.standard_normal(32)
        if rows and k % 3:
            v = np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.5, 2) + rng.standard_normal(32) * rng.choice([0, 0.1, 0.35])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 7 == 0)))
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, rows[0][1], None), (1003, [1.0, None], 1), (1004, [float("nan")] * 32, 0), (1005, [1.0, 2.0], 1), (1006, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(df).collect()}
    want = vectors_by_hand(rows, embedding_dedup.THRESHOLD)
    assert got.keys() == want.keys()
    right = sum(w[0] for w in want.values())
    if bucket > 900:
        assert got == want
    else:  # found by buckets: none below the threshold, and nearly all above
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.97 * right
    assert embedding_dedup.links(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    for dim in (16, 64, 200):
        a = rng.standard_normal((300, dim))
        b = a * 0.6 + rng.standard_normal((300, dim)) * rng.uniform(0, 1.5, (300, 1))
        cosine = np.einsum("ij,ij->i", a, b) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
        reach = np.diagonal(embedding_dedup.may_reach(embedding_dedup.codes(a), embedding_dedup.codes(b), dim, 0.93))
        assert reach[cosine >= 0.93].mean() > 0.999 and (dim < 64 or reach[cosine < 0.6].mean() < 0.05)
        assert embedding_dedup.codes(a).dtype.itemsize <= 8 * -(-dim // 64) * 5 + 12


@pytest.mark.parametrize("size", [900, 1100, 6000])
def test_recall_of_planted_pairs(spark, size):
    """The production layout on either side of BUCKET, held against brute force."""
    rng = np.random.default_rng(size)
    v = rng.standard_normal((size, 64))
    for k in range(0, size // 2):  # near copies about the threshold
        noise = rng.standard_normal(64)
        noise -= noise @ v[k] / (v[k] @ v[k]) * v[k]
        c = rng.uniform(0.925, 0.96)
        v[size - 1 - k] = v[k] / np.linalg.norm(v[k]) * c + noise / np.linalg.norm(noise) * math.sqrt(1 - c * c)
    v = v.astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T >= embedding_dedup.THRESHOLD).sum(1) - 1).tolist()
    df = spark.createDataFrame([(k, x.tolist(), 7) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.links(df).collect()}
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(want) > size // 4
    assert sum(got.values()) >= (1 if size <= embedding_dedup.BUCKET else 0.99) * sum(want)
    if size == 1100:
        assert [got[k] for k in range(size)] != [0] * size
        assert {r.vec_id: r.n_links for r in embedding_dedup.links(df, exact=True).collect()} == dict(enumerate(want))


def test_embedding_links_equal_the_oracle(spark):
    """The registered SQL on vectors that have links: the table's own, each with a scaled and perturbed copy."""
    import duckdb

    own = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    rng = np.random.default_rng(8)
    rows = []
    for r in own.itertuples():
        v = np.asarray(r.embedding, np.float32)
        rows.append((int(r.vec_id), v.tolist(), int(r.label)))
        rows.append((int(r.vec_id) + 10**6, (v * 2 + rng.standard_normal(len(v)) * np.linalg.norm(v) * rng.uniform(0.01, 0.12)).astype(np.float32).tolist(), int(r.label)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = sorted(con.execute(queries.ORACLES["op8_embedding_dedup"]).fetchall())
    assert sorted(map(tuple, embedding_dedup.links(df).collect())) == want and sum(r[1] for r in want) > len(own) // 2


@pytest.mark.parametrize("chunk", [components_module.CHUNK, 20])
def test_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}


URLS = ["http://a.com/en/1?x", "https://Example.COM/en/7/9", "http://x.example.net/de/81#y", "http://spam-farm.example.org/fr/", "http://net/de/", "no scheme", None, "://", "http://evil-com/en/", "HTTP://H?q", "http://x.org/es"]


def test_url_rules(spark):
    rules = queries.url_rules() + [url_filter.Rule.of_pattern("||evil*.example^", "block")]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    want = {
        0: ("a.com", "/en/1", "com/en/", "block"), 1: ("example.com", "/en/7/9", "example.com/en/7", "allow"), 2: ("x.example.net", "/de/81", "example.net/de/8", "block"),
        3: ("spam-farm.example.org", "/fr/", None, "block"), 4: ("net", "/de/", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("evil-com", "/en/", None, "allow"), 9: ("h", "", None, "allow"), 10: ("x.org", "/es", None, "allow"),
    }
    for inline in (url_filter.INLINE, 0):  # in the row, and joined
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules, inline=inline).collect()}
        assert got == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def clashing(spark, rows):
    """documents with columns that operators could name their own so, one with a dot, one with a back-tick."""
    columns = "doc_id long, text string, own_found int, own_told string, `a.b` int, `c``d` int, __found int, sig string, n int, component_id long, words string"
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "s", 5, 6, "w") for i, t in rows], columns)


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    docs = clashing(spark, [(1, "Mail bob@example.com now"), (2, None), (3, ""), (3, ""), (None, "a text"), (5, "long " * 50_000)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) == (5 if name == "jaccard join" else 6) and all(tuple(r)[2:] == (1, "x", 2, 3, 4, "s", 5, 6, "w") for r in rows), name


def test_url_filter_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.org/es/" + "a/" * 200_000), (1, None), (1, None)], "page_id long, url string")
    got = url_filter.judge(pages, [url_filter.Rule.of_site(*r) for r in queries.SITE_RULES]).collect()
    assert sorted(r.verdict for r in got) == ["allow", "allow", "block"]


def test_embedding_rows_that_repeat(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.01], 1), (None, [1.0, 2.0], 1), (3, [-1.0, 2.0], 1)]
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (None, 0, None)], key=repr)


def test_toxicity_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    odd = clashing(spark, [(1, "word " * 200_000), (2, "same"), (2, "same"), (None, None), (4, "")])
    got = toxicity.append_scores(odd, model, "score").collect()
    assert len(got) == 5 and all(0 <= r.score.score <= 1 for r in got) and got[1].score == got[2].score


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept <= texts.keys() and len(kept) > 0.5 * len(texts)
    by_text = {}
    for i in sorted(kept):
        assert by_text.setdefault(texts[i], i) == i  # no exact copy stays
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a text", None, None, 6)], docs.schema)
        got = stage(spark, odd, sf)
        assert got.columns == docs.columns and got.count() == 3, name
        assert stage(spark, odd.limit(0), sf).count() == 0
