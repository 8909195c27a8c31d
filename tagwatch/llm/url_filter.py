"""URL rules looked up by their rarest literal token.

A rule says where it fits by a regular expression over ``host + path`` and
names the literal tokens that every such URL holds.  The index keeps each rule
under the one of its tokens that is rarest in the corpus; the tokens of a URL
fetch the candidate rules, and only those run their expressions.  All of it is
DataFrame functions.  Up to INLINE rules the index is a literal looked up in
the row (no shuffle); beyond, a table joined by token.

Defined results: a null URL, or one without ``://``, has empty host and path
and fits no rule; repeated pages are judged alike; page_id may be null; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules kept in the plan itself.
INLINE = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<name:string,site:boolean,verdict:string,weight:int,regex:string>>"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool

    @classmethod
    def of_site(cls, name: str, verdict: str) -> Rule:
        """``host/path``: that host and its subdomains, paths that start so."""
        host, slash, path = name.partition("/")
        head = "" if not host else rf"(?:[^/]*\.)?{re.escape(host)}"
        return cls(name, verdict, f"^{head}{re.escape(slash + path)}", tuple(_whole_tokens(f".{host}{slash}{path}", end=False)), True)

    @classmethod
    def of_pattern(cls, pattern: str, verdict: str) -> Rule:
        """``*``: anything; ``||`` in front: where a host label starts; ``^``: a separator or the end."""
        anchored = pattern.startswith("||")
        body = pattern[2:] if anchored else pattern
        regex = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
        literal = body.replace("*", "\0")
        tokens = _whole_tokens(("." if anchored else "\0") + literal, end=False)
        return cls(pattern, verdict, ("(?s)^(?:[^/]*\\.)?" if anchored else "(?s)") + regex, tuple(tokens), False)


    @classmethod
    def of_word(cls, word: str, verdict: str) -> Rule:
        """Hosts that hold the word between marks: ``word.org``, ``my-word.net``."""
        return cls(f"*{word}*", verdict, rf"^(?:[^/]*[^a-z0-9/])?{word}(?![a-z0-9])", (word,), False)


def _whole_tokens(literal: str, end: bool) -> list[str]:
    """Runs of letters and digits with a literal mark on either side: whole tokens of any URL that fits."""
    found = re.finditer(r"(?<=[^a-z0-9\0])[a-z0-9]+(?=[^a-z0-9\0])", literal.lower() + ("/" if end else ""))
    return list(dict.fromkeys(m[0] for m in found))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """After the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit("[a-z0-9]+"), 0))


def rarest(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """The index: rules by the token that the fewest URLs hold; under "" those without a whole token."""
    own = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if own:
        tokens = pages.select(F.explode(_tokens(F.concat("host", "path"))).alias("token"))
        known = tokens.sparkSession.createDataFrame([(t,) for t in own], "token string")
        seen = tokens.where(F.col("token").isin(own)) if len(own) <= INLINE else tokens.join(known, "token", "left_semi")
        counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}  # a row for each token of a rule
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return index


def _literal(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.site).alias("site"), F.lit(r.verdict).alias("verdict"), F.lit(len(r.name)).alias("weight"), F.lit(r.regex).alias("regex")) for r in rules]).cast(_RULE)


def _fitting_inline(sites: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    always = _literal(index[""]) if "" in index else F.array().cast(_RULE)
    named = [(t, rs) for t, rs in index.items() if t]
    if named:
        table = F.create_map(*[c for t, rs in named for c in (F.lit(t), _literal(rs))])
        fetched = F.flatten(F.filter(F.transform(_tokens(F.concat("host", "path")), lambda t: F.element_at(table, t)), lambda x: x.isNotNull()))
        always = F.concat(always, fetched)
    fits = F.filter(always, lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))
    return sites.withColumn("__fits", fits)


def _fitting_joined(sites: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    spark = sites.sparkSession
    rows = [(t, r.name, r.site, r.verdict, len(r.name), r.regex) for t, rs in index.items() for r in rs]
    table = spark.createDataFrame(rows, "token string, name string, site boolean, verdict string, weight int, regex string")
    places = sites.select("host", "path").distinct()
    tokens = places.select("host", "path", F.explode(F.concat(_tokens(F.concat("host", "path")), F.array(F.lit("")))).alias("token"))
    fits = (
        tokens.join(table, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(F.collect_set(F.struct("name", "site", "verdict", "weight", "regex")).cast(_RULE).alias("__fits"))
    )
    return sites.join(fits, ["host", "path"], "left").withColumn("__fits", F.coalesce("__fits", F.array().cast(_RULE)))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", inline: int = INLINE) -> DataFrame:
    """page_id, host, path, rule and verdict.

    The longest fitting site rule decides (of equals, the last by name); without one, a fitting pattern
    decides, blocking before allowing; else ``default``.
    """
    sites = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = sites.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    index = rarest(sites, rules)
    found = (_fitting_inline if len(rules) <= inline else _fitting_joined)(sites, index)
    best = F.array_max(F.transform(F.filter("__fits", lambda r: r["site"]), lambda r: F.struct(r["weight"].alias("weight"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    patterns = F.transform(F.filter("__fits", lambda r: ~r["site"]), lambda r: r["verdict"])
    return found.select("page_id", "host", "path", best.alias("best"), F.array_max(patterns).alias("pattern")).select(
        "page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", "pattern", F.lit(default)).alias("verdict")
    )
