"""URL filters: rules fetched by their rarest literal token, then checked by regular expressions.

Method: every rule is a pattern (a host expression and a path expression) with literal
tokens that any URL it fits must hold.  The rule is filed under the rarest of them, by a
count over all URLs of the table (only tokens of rules are counted, so the counts are as
few as the rules).  A URL's tokens fetch candidate rules, and only those run.

Site rules come first: a rule ``example.org/es/`` fits its host and all subdomains where the
URL's path starts with the rule's; the longest one wins, then the first in order.  Where no
site rule fits, the first other rule that fits decides, and a URL that none fits is allowed.
Rules come from a text or file (``url_rules`` states the syntax and holds the default list).
A rule without any literal token is tried on every URL.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no site
rule and is allowed; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import url_rules
from skein.llm.common import map_arrow

_TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    """A pattern: ``name``, expressions for a whole host and a path's beginning, literal tokens, verdict."""

    name: str
    host: str
    path: str
    tokens: tuple[str, ...]
    verdict: str
    site: bool = False


def site(verdict: str, name: str) -> Rule:
    """The rule of ``host/path`` text."""
    host, slash, path = name.partition("/")
    whole = _TOKEN.findall(host) + [t for t in re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", slash + path)]
    return Rule(name, rf"(?:.*\.)?{re.escape(host)}", re.escape(slash + path), tuple(whole), verdict, True)


def parse_rules(text: str) -> tuple[Rule, ...]:
    """The rules of a text in the syntax of ``url_rules``; a line that can't be read is an error."""
    rules = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.partition("#")[0].split()
        if not line:
            continue
        if len(line) != 3 or line[0] not in ("allow", "block") or line[1] not in ("site", "host", "path"):
            raise ValueError(f"line {n} isn't a rule")
        verdict, kind, pattern = line
        if kind == "site":
            rules.append(site(verdict, pattern))
        elif kind == "host":
            rules.append(Rule(f"host:{pattern}", rf"(?:.*[.-])?{re.escape(pattern)}(?:[.-].*)?", "", tuple(_TOKEN.findall(pattern)), verdict))
        else:
            rules.append(Rule(f"path:{pattern}", ".*", rf"(?:.*[/_.-])?{re.escape(pattern)}(?:[/_.-]|$)", tuple(_TOKEN.findall(pattern)), verdict))
    return tuple(rules)


def read_rules(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[Rule, ...]:
    """The rules of text files, read by Spark in the order of their lines; they go to every task, so more than ``most`` lines are an error."""
    lines = spark.read.text(path, wholetext=False).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"more than {most} rules")
    return parse_rules("\n".join(r[0] for r in lines))


#: The query's rules: sites, and the words of unwanted hosts and paths.
RULES = parse_rules(url_rules.DEFAULT)


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = _SPLIT.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def rarest(urls: DataFrame, rules: tuple[Rule, ...], column: str = "url") -> dict[str, int]:
    """In how many URLs each rule token stands, over the whole table."""
    literals = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.col(column).cast("string")), "[^a-z0-9]+"))).alias("t"))
    return {r["t"]: r["count"] for r in tokens.where(F.col("t").isin(literals)).groupBy("t").count().collect()}


def index(rules: tuple[Rule, ...], count: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token to the numbers of the rules filed under it; those without a token under the empty one."""
    filed = defaultdict(list)
    for i, r in enumerate(rules):
        filed[min(r.tokens, key=lambda t: (count.get(t, 0), t), default="")].append(i)
    return dict(filed)


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", column: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row; ``pattern`` names the other rule that decided, if one did."""
    filed = index(rules, rarest(urls, rules, column))

    def run(rows: dict) -> dict:
        compiled = [(re.compile(r.host, re.S), re.compile(r.path, re.S)) for r in rules]
        out: dict[str, list] = {n: [] for n in ("host", "path", "rule", "verdict", "pattern")}
        for url in rows["url"]:
            host, path = parts(url)
            fetched = sorted({i for t in {"", *_TOKEN.findall((url or "").lower())} & filed.keys() for i in filed[t]}) if host or path else []
            fits = [rules[i] for i in fetched if compiled[i][0].fullmatch(host) and compiled[i][1].match(path)]
            rule = max((r for r in fits if r.site), key=lambda r: len(r.name), default=None)
            spam = next((r for r in fits if not r.site), None) if rule is None else None
            out["host"].append(host)
            out["path"].append(path)
            out["rule"].append(rule and rule.name)
            out["pattern"].append(spam and spam.name)
            out["verdict"].append((rule or spam).verdict if rule or spam else "allow")
        return {id_column: rows["id"]} | out

    kind = urls.schema[id_column].dataType.simpleString()
    return map_arrow(urls.selectExpr(f"`{id_column}` id", f"cast(`{column}` as string) url"), run, f"`{id_column}` {kind}, host string, path string, rule string, verdict string, pattern string")


def oracle_sql() -> str:
    """DuckDB SQL for the verdicts of ``RULES`` over ``pages``."""
    sites, spam_rules = [r for r in RULES if r.site], [r for r in RULES if not r.site]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fit = {r.name: f"regexp_full_match(host, {quote('(?s:' + r.host + ')')})" + f" and regexp_matches(path, {quote('(?s)^(?:' + r.path + ')')})" * bool(r.path) for r in RULES}
    longest = sorted(sites, key=lambda r: -len(r.name))
    rule = "case " + " ".join(f"when {fit[r.name]} then {quote(r.name)}" for r in longest) + " end"
    spam = "case " + " ".join(f"when {fit[r.name]} then {quote(r.name)}" for r in spam_rules) + " end"
    verdict = "case " + " ".join(f"when rule = {quote(r.name)} then {quote(r.verdict)}" for r in sites) + " " + " ".join(f"when pattern = {quote(r.name)} then {quote(r.verdict)}" for r in spam_rules) + " else 'allow' end"
    return f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
halves as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
named as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from halves),
ruled as (select *, {rule} as rule from named),
spammed as (select *, case when rule is null then {spam} end as pattern from ruled)
select page_id, host, path, rule, {verdict} as verdict, pattern from spammed"""
