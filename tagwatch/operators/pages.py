"""Product facts from archived pages: schema.org blocks, embedded state, price and urgency text.

All but entity decoding, brace matching and CSS lookup are expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.titles import parse_int, parse_price
from tagwatch.plans.shipping import ship

# Urgency phrases with the place of their number, if any: fixed values.
URGENCY = (
    ("stock_claim", r"only (\d+) left", 1),
    ("stock_claim", r"(\d+) left in stock", 1),
    ("stock_claim", "hurry", 0),
    ("stock_claim", "limited stock", 0),
    ("stock_claim", "selling fast", 0),
    ("viewer_claim", r"(\d+) people (are )?viewing", 1),
    ("viewer_claim", r"(\d+) others? (are )?looking", 1),
)


def unescaped(text: Column) -> Column:
    """Entities decoded twice, white space squeezed."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(html.unescape(html.unescape(v)).split()))

    return F.coalesce(decode(text), F.lit(""))


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """(url, html, place, block): every object of the pages' ld+json scripts, in order of place; lists and @graph are flattened, trailing commas repaired."""
    raw = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    scripts = pages.select("url", "html", F.posexplode(raw).alias("script", "raw"))
    fixed = F.regexp_replace("raw", r",\s*([}\]])", "$1")
    data = F.coalesce(F.try_parse_json("raw"), F.try_parse_json(fixed))
    text = scripts.select("url", "html", "script", F.trim(F.to_json(data)).alias("doc")).where("doc is not null")
    as_list = lambda c: F.from_json(c, "array<string>")
    tops = text.select("url", "html", "script", F.posexplode(F.when(F.startswith("doc", F.lit("[")), as_list(F.col("doc"))).otherwise(F.array("doc"))).alias("at", "top"))
    graph = F.get_json_object("top", "$.@graph")
    each = F.when(F.startswith(graph, F.lit("[")), as_list(graph)).otherwise(F.array("top"))
    blocks = tops.select("url", "html", "script", "at", F.posexplode(each).alias("within", "block")).where(F.startswith("block", F.lit("{")))
    return blocks.select("url", "html", F.struct("script", "at", "within").alias("place"), "block")


def jsonld_products(pages: DataFrame, mrp_paths: Sequence[str] = ("offers.highPrice", "offers.listPrice")) -> DataFrame:
    """One row per page with a priced Product: the first such block."""
    at = lambda path: F.get_json_object("block", path)
    rows = jsonld_blocks(pages).where(F.lower(at("$.@type")) == "product")
    offer = F.when(F.startswith(at("$.offers"), F.lit("[")), at("$.offers[0]")).otherwise(at("$.offers"))
    rows = rows.withColumn("offer", offer)
    of = lambda path: F.get_json_object("offer", f"$.{path}")
    listed = []
    for path in mrp_paths:
        value = of(path.removeprefix("offers.")) if path.startswith("offers.") else at(f"$.{path}")
        inner = F.coalesce(F.get_json_object(value, "$.price"), F.get_json_object(value, "$.value"))
        listed.append(parse_price(F.when(F.startswith(value, F.lit("{")), inner).otherwise(value)))
    marked = parse_price(F.nullif(F.regexp_extract("html", r'"marked"\s*:\s*\{[^}]*?"min"\s*:\s*([\d.]+)', 1), F.lit("")))
    price, mrp = parse_price(of("price")), F.coalesce(*listed, marked)
    stock = F.nullif(F.lower(of("availability")), F.lit(""))
    told = rows.select(
        "url",
        "place",
        unescaped(at("$.name")).alias("raw_title"),
        price.alias("selling_price"),
        F.when(mrp >= price, mrp).alias("mrp"),
        F.when(F.replace(stock, F.lit("_"), F.lit("")).contains("outofstock"), 0).when(stock.isNotNull(), 1).alias("in_stock"),
        F.coalesce(F.get_json_object(at("$.brand"), "$.name"), at("$.brand")).alias("brand"),
    )
    priced = told.where((F.col("raw_title") != "") & F.col("selling_price").isNotNull())
    kept = [c for c in told.columns if c not in ("url", "place")]
    return priced.groupBy("url").agg(F.min_by(F.struct(*kept), "place").alias("first")).select("url", "first.*")


def jsonld_listing(pages: DataFrame) -> DataFrame:
    """(page, position, name, url) of ItemList elements; of equal links the first."""
    lists = jsonld_blocks(pages).where(F.get_json_object("block", "$.@type") == "ItemList")
    items = F.from_json(F.get_json_object("block", "$.itemListElement"), "array<string>")
    rows = lists.select(F.col("url").alias("page"), F.posexplode(items).alias("position", "item"))
    name, url = (F.coalesce(F.get_json_object("item", f"$.{k}"), F.get_json_object("item", f"$.item.{k}")) for k in ("name", "url"))
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    found = rows.select("page", "position", unescaped(name).alias("name"), full.alias("url")).where((F.col("name") != "") & F.col("url").isNotNull())
    return found.groupBy("page", "url").agg(F.min(F.struct("position", "name")).alias("first")).select("page", "first.position", "first.name", "url")


def modal_price(pages: DataFrame) -> DataFrame:
    """The rupee amount that a page repeats most; of equals the smallest."""
    amounts = F.transform(F.regexp_extract_all("html", F.lit(r"₹\s?([\d,]{3,12})"), 1), parse_price)
    values = pages.select("url", F.explode(amounts).alias("price")).where("price >= 100")
    counts = values.groupBy("url", "price").agg(F.count("*").alias("n"))
    return counts.groupBy("url").agg(F.max_by("price", F.struct(F.col("n"), F.negate("price"))).alias("price"))


def visible_text(page: Column) -> Column:
    """A page's text in lower case, scripts and tags dropped."""
    text = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def urgency(pages: DataFrame, phrases: Sequence[tuple[str, str, int]] = URGENCY) -> DataFrame:
    """(url, kind, snippet, value): the first hit of each phrase; the phrases are configuration, looked up in the row."""
    text = F.col("__text")

    def hit(kind: str, pattern: str, group: int) -> Column:
        at, found = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
        start = F.greatest(at - 30, F.lit(1))
        value = F.regexp_extract(text, pattern, group).try_cast("double") if group else F.lit(None).cast("double")
        told = F.struct(F.lit(kind).alias("kind"), F.trim(F.substring(text, start, at + F.length(found) + 30 - start)).alias("snippet"), value.alias("value"))
        return F.when(at > 0, told)

    hits = F.filter(F.array(*[hit(*p) for p in phrases]), lambda h: h.isNotNull())
    return pages.select("url", visible_text(F.col("html")).alias("__text")).select("url", F.explode(hits).alias("h")).select("url", "h.*")


def balanced(page: str, marker: str) -> str | None:
    """The object assigned to a marker: braces counted outside of strings."""
    found = re.search(rf"{re.escape(marker)}\s*=\s*(?=\{{)", page)
    if not found:
        return None
    depth = 0
    for token in re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S).finditer(page, found.end()):
        depth += (token[0] == "{") - (token[0] == "}")
        if depth == 0 and token[0] == "}":
            return page[found.end() : token.end()]
    return None


def state_items(pages: DataFrame, marker: str, items: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per item of a page's embedded state.  items and fields: JSON paths; fields needs title, price and may have mrp, url."""

    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def blob(values: pd.Series) -> pd.Series:
        return values.map(lambda v: balanced(v, marker) if v else None)

    rows = pages.select("url", F.explode(F.from_json(F.get_json_object(blob("html"), items), "array<string>")).alias("item"))
    get = lambda name: F.get_json_object("item", fields[name]) if name in fields else F.lit(None).cast("string")
    price, mrp = parse_price(get("price")), parse_price(get("mrp"))
    return rows.select("url", F.trim(get("title")).alias("raw_title"), price.alias("selling_price"), F.when(mrp >= price, mrp).alias("mrp"), get("url").alias("item_url")).where("raw_title <> '' and selling_price is not null")


class _Finder(HTMLParser):
    """Text and attributes of the elements that carry given classes, within item elements."""

    def __init__(self, item: str | None):
        super().__init__()
        self.item, self.open, self.items = item, [], [] if item else [[]]

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        classes = set((own.get("class") or "").split())
        if self.item and self.item in classes:
            self.items.append([])
        entry = (tag, classes, own, [])
        if tag not in ("img", "br", "input", "meta", "link", "hr"):
            self.open.append(entry)
        if self.items:
            self.items[-1].append(entry)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for entry in self.open:
            entry[3].append(data)


def select(elements: list, selector: str | None) -> str | None:
    """The first text or attribute that one of the comma-separated ``.class``, ``tag`` or ``tag.class`` (``@attribute``) alternatives finds."""
    for alternative in (selector or "").split(","):
        path, _, attribute = alternative.strip().partition("@")
        tag, _, name = path.partition(".")
        for own_tag, classes, own, texts in elements:
            if (not tag or tag == own_tag) and (not name or name in classes) and (tag or name):
                value = own.get(attribute) if attribute else " ".join(" ".join(texts).split())
                if value:
                    return value.strip()
    return None


def css_items(pages: DataFrame, item: str | None, selectors: Mapping[str, str]) -> DataFrame:
    """One row per item element (class ``item``; None: the page): title, price, mrp and the like by selectors."""
    names = ["title", "href", "price", "mrp", "rating_count", "stock"]

    ship(pages.sparkSession)

    @F.pandas_udf("array<struct<title:string,href:string,price:string,mrp:string,rating_count:string,stock:string>>")
    def found(values: pd.Series) -> pd.Series:
        def parse(page: str | None) -> list[dict]:
            finder = _Finder(item)
            finder.feed(page or "")
            return [{n: select(x, selectors.get(n)) for n in names} for x in finder.items]

        return values.map(parse)

    rows = pages.select("url", F.explode(found("html")).alias("i"))
    stock = F.lower("i.stock")
    return rows.select(
        "url",
        F.col("i.title").alias("raw_title"),
        F.col("i.href").alias("item_url"),
        parse_price(F.col("i.price")).alias("selling_price"),
        parse_price(F.col("i.mrp")).alias("mrp"),
        parse_int(F.col("i.rating_count")).alias("rating_count"),
        F.when(stock.contains("out of stock"), 0).when(stock.isNotNull(), 1).alias("in_stock"),
    ).where("raw_title is not null")


def category_url(base: Column, path: Column, page: int = 1) -> Column:
    url = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))
    return url if page <= 1 else F.concat(url, F.when(url.contains("?"), F.lit("&page=")).otherwise(F.lit("?page=")), F.lit(str(page)))


def fingerprint_collisions(products: DataFrame) -> DataFrame:
    """Pairs of categories that hold the very same products.  products: (category, url); joined by fingerprint."""
    prints = products.groupBy("category").agg(F.sum(F.xxhash64("url").cast("decimal(38,0)")).alias("mark"), F.count_distinct("url").alias("n"))
    a, b = prints.alias("a"), prints.alias("b")
    same = (F.col("a.mark") == F.col("b.mark")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.category") < F.col("b.category"))
    return a.join(b, same).select(F.col("a.category").alias("category_a"), F.col("b.category").alias("category_b"), F.col("a.n").alias("n_products"))


def resolved(base: Column, link: Column) -> Column:
    """A link as a page at ``base`` means it: absolute, //host, /path, ?query, or beside the page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(path == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(path, link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, "^[^#]*", 0), link))
        .otherwise(F.concat(folder, link))
    )
    # dot segments of what stands before the query
    head, tail = F.regexp_extract(whole, r"^[^?#]*", 0), F.regexp_extract(whole, r"[?#].*$", 0)
    root = F.regexp_extract(head, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    steps = F.split(F.substring(head, F.length(root) + 2, F.length(head)), "/")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    )
    last = F.element_at(steps, -1).isin(".", "..")
    plain = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(last & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(head.rlike(r"/\.{1,2}(/|$)"), F.concat(plain, tail)).otherwise(whole)


def archived(pages: DataFrame, selectors: Mapping[str, str]) -> DataFrame:
    """(url, raw_title, selling_price, mrp): from schema.org, else by selectors, else the amount repeated most; pages without title or price give none."""
    told = jsonld_products(pages).select("url", F.struct("raw_title", "selling_price", "mrp").alias("a"))
    found = css_items(pages, None, selectors).select("url", F.struct("raw_title", "selling_price", "mrp").alias("b"))
    modal = modal_price(pages).select("url", F.col("price").alias("c"))
    name = unescaped(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select("url", F.nullif(name, F.lit("")).alias("name")).join(told, "url", "left").join(found, "url", "left").join(modal, "url", "left")
    by_selector = F.col("a.selling_price").isNull()
    return rows.select(
        "url",
        F.coalesce("a.raw_title", "b.raw_title", "name").alias("raw_title"),
        F.coalesce("a.selling_price", "b.selling_price", "c").alias("selling_price"),
        F.coalesce(F.col("a.mrp"), F.when(by_selector, F.col("b.mrp"))).alias("mrp"),
    ).where("raw_title is not null and selling_price is not null")


def selector_health(pages: DataFrame, item: str, selectors: Mapping[str, str]) -> DataFrame:
    """By category: how many items the selectors find, and in how many each field.  pages: category, url, html."""
    found = css_items(pages, item, selectors).join(pages.select("url", "category"), "url", "right")
    fields = {"title": "raw_title", "url": "item_url", "selling_price": "selling_price", "mrp": "mrp"}
    counts = found.groupBy("category").agg(F.count("raw_title").alias("items_found"), *[F.count(c).alias(f"n_{n}") for n, c in fields.items()])
    return counts.withColumn("ok", (F.col("items_found") > 0) & (F.col("n_url") > 0) & (F.col("n_selling_price") > 0))


def category_health(products: DataFrame) -> DataFrame:
    """By category: products found, and whether no other category holds the very same ones.  products: (category, url)."""
    # sets of products: one that a category lists twice counts once
    mark = F.coalesce(F.sum(F.when(F.col("url").isNotNull(), F.xxhash64("url").cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)"))
    prints = products.distinct().groupBy("category").agg(F.count("url").alias("products_found"), mark.alias("mark"))
    same = prints.groupBy("products_found", "mark").agg(F.count("category").alias("alike"))
    told = prints.join(same, ["products_found", "mark"]).withColumn("collides", F.col("category").isNotNull() & (F.col("alike") > 1))
    return told.select("category", "products_found", "collides", ((F.col("products_found") > 0) & ~F.col("collides")).alias("ok"))


def detail_probe(pages: DataFrame) -> DataFrame:
    """(url, ok, price, mrp, title) of detail pages: whether their schema.org block yields a price."""
    found = jsonld_products(pages)
    return pages.select("url").join(found, "url", "left").select("url", F.col("selling_price").isNotNull().alias("ok"), F.col("selling_price").alias("price"), "mrp", F.substring("raw_title", 1, 56).alias("title"))


#: How a source's pages are read, by the name of its strategy.
STRATEGIES = {
    "static": lambda pages, extra: css_items(pages, extra.get("item"), extra.get("selectors", {})),
    "json_ld": lambda pages, extra: jsonld_products(pages),
    "json_state": lambda pages, extra: state_items(pages, extra["marker"], extra["items"], extra["fields"]),
    "wayback": lambda pages, extra: archived(pages, extra.get("selectors", {})),
}


def parse_pages(strategy: str, pages: DataFrame, extra: Mapping[str, object] | None = None) -> DataFrame:
    """Pages read by a named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](pages, dict(extra or {}))


def backfill(pages: DataFrame, captures: DataFrame, selectors: Mapping[str, str], most: int) -> DataFrame:
    """Items of archived captures, the ``most`` earliest days of each link (a parameter of the crawl), with their days and source wayback.

    captures: (url, day, timestamp); pages: (url, timestamp, html).
    """
    earliest = F.row_number().over(Window.partitionBy("url").orderBy("day"))
    chosen = captures.withColumn("k", earliest).where(F.col("k") <= most).drop("k")
    key = F.concat_ws(" ", "url", "timestamp")
    rows = pages.join(chosen, ["url", "timestamp"]).withColumn("capture", key)
    items = archived(rows.select(F.col("capture").alias("url"), "html"), selectors).withColumnRenamed("url", "capture")
    return items.join(rows.select("capture", "url", F.col("day").alias("obs_date")), "capture").drop("capture").withColumn("source", F.lit("wayback"))


def page_archive(pages: DataFrame, root: str) -> None:
    """Raw pages as compressed text by day, site and label (signs replaced, 120 characters at most).  pages: obs_date, site_key, label, html."""
    label = F.substring(F.regexp_replace("label", r"[^A-Za-z0-9._-]+", "_"), 1, 120)
    rows = pages.select("obs_date", "site_key", label.alias("label"), F.to_json(F.struct("html")).alias("value"))
    rows.write.mode("append").partitionBy("obs_date", "site_key", "label").option("compression", "gzip").text(root)
