"""URL filters: site rules, then pattern rules found by their rarest literal token.

A site rule is ``host/path``; it fits the host and its subdomains if the url's path starts with
its own path, and the longest rule wins (of two as long, the longer host). A url that no site rule
fits goes to the pattern rules: ``*`` stands for anything, ``^`` for one separator or the end,
``||`` for the begin of a host label, ``|`` for the begin or the end of the url; ``$match-case``
after a pattern keeps its case. ``read_rules`` takes a list of them from a text file. Each pattern is filed under one token that any url that it
matches must hold, the one that fewest urls hold; a url's tokens fetch the patterns that can
match, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
#: Options stand behind the last "$" of a rule: names with hyphens, with or without a value.
OPTIONS = re.compile(r"\$(~?[a-z][a-z-]*(?:=[^,/]*)?(?:,~?[a-z][a-z-]*(?:=[^,/]*)?)*)$")
#: Site rules of the query, as its contract gives them.
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Pattern rules in their usual form; "@@" marks an exception, which outranks a block.
PATTERN_RULES = ("||spam-farm.", "||cheap-pills.", "/casino/*", "-casino.", "||ads.*^banner^", "/tracking-pixel^", "@@||cheap-pills.*/about^")


def parts(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z only) and path of a url; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host, rest = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest, maxsplit=1)[0]


@dataclass(frozen=True)
class Pattern:
    """A pattern rule. ``begin``: what anchors it ("||", "|" or nothing); ``end``: whether it ends with the url."""

    text: str
    allow: bool
    body: str
    begin: str = ""
    end: bool = False
    exact_case: bool = False

    @classmethod
    def parse(cls, text: str) -> Pattern:
        """A rule as it is written; an option other than match-case is an error."""
        allow = text.startswith("@@")
        body, options = text.removeprefix("@@"), ""
        if found := OPTIONS.search(body):  # any other "$" is a character of the url
            body, options = body[: found.start()], found[1]
        if unknown := set(filter(None, options.split(","))) - {"match-case"}:
            raise ValueError(f"{text}: unknown options {sorted(unknown)}")
        begin = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(begin) :]
        end = body.endswith("|")
        body = body.removesuffix("|") if end else body
        return cls(text, allow, body if options else body.lower(), begin, end, bool(options))

    def regex(self) -> str:
        lead = {"||": r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*\.)?", "|": "^", "": ""}[self.begin]
        return lead + re.escape(self.body).replace(r"\*", ".*").replace(r"\^", r"([^a-zA-Z0-9_.%-]|$)") + ("$" if self.end else "")

    def tokens(self) -> list[str]:
        """Tokens that stand alone in any url that matches: bounded on both sides by the pattern itself."""
        body, out = self.body.lower(), []
        for m in TOKEN.finditer(body):
            left = body[m.start() - 1] if m.start() else self.begin or "*"
            right = body[m.end()] if m.end() < len(body) else ("|" if self.end else "*")
            if "*" not in (left, right):
                out.append(m[0])
        return out


class UrlFilter:
    def __init__(self, site_rules=SITE_RULES, patterns=PATTERN_RULES, counts: dict[str, int] | None = None):
        self.sites: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in site_rules:
            host, slash, path = rule.partition("/")
            self.sites[host].append((slash + path, rule, verdict))
        self.index: dict[str, list[tuple[re.Pattern, Pattern]]] = defaultdict(list)
        self.always: list[tuple[re.Pattern, Pattern]] = []
        self.ran = 0
        for text in patterns:
            p = Pattern.parse(text)
            tokens = p.tokens()
            entry = (re.compile(p.regex(), re.DOTALL), p)
            if tokens:
                self.index[min(tokens, key=lambda t: ((counts or {}).get(t, 0), -len(t), t))].append(entry)
            else:
                self.always.append(entry)

    def site(self, host: str, path: str) -> tuple[str | None, str | None]:
        fits, at = [], 0
        while host and at >= 0:
            suffix = host[at:]
            fits += [(len(rule), len(suffix), rule, verdict) for prefix, rule, verdict in self.sites.get(suffix, ()) if path.startswith(prefix)]
            at = host.find(".", at) + 1 or -1
        if not fits:
            return None, None
        return max(fits)[2:]

    def pattern(self, url: str | None) -> Pattern | None:
        """The pattern that decides: an exception before a block, then in the order of their text. A null url matches none."""
        if url is None:
            return None
        low = url.lower()
        found = [entry for token in sorted(set(TOKEN.findall(low))) for entry in self.index.get(token, ())] + self.always
        self.ran += len(found)
        hits = [p for expression, p in found if expression.search(url if p.exact_case else low)]
        return min(hits, key=lambda p: (not p.allow, p.text), default=None)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """Host, path, the site rule that decides, the verdict, and the pattern that decides."""
        host, path = parts(url)
        rule, verdict = self.site(host, path)
        if rule is not None:
            return host, path, rule, verdict, None
        p = self.pattern(url)
        return host, path, None, "block" if p is not None and not p.allow else "allow", p.text if p else None


def read_rules(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The pattern rules of a text file, one a line; lines that begin with ``!`` or ``[`` are comments."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^([!\[]|$)")).select(F.trim("value").alias("value"))
    return tuple(sorted({r.value for r in lines.collect()}))


def token_counts(urls: DataFrame, tokens: list[str], url_col: str = "url") -> dict[str, int]:
    """How many urls hold each token of the rules; as many rows as the rules have tokens."""
    if not tokens:
        return {}
    held = F.array_intersect(F.regexp_extract_all(F.lower(url_col), F.lit("([a-z0-9]+)")), F.array(*map(F.lit, tokens)))
    return {r.token: r.n for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(pages: DataFrame, site_rules=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for each row of ``pages``.

    A null url and one without ``://`` have an empty host and path and no site rule; a null url
    matches no pattern and is allowed. Repeated rows and null ids each get their row; urls of any
    length are read whole; other columns are ignored, whatever their names; an empty table gives no
    rows. The rules are the caller's list and travel with the task; of site rules that fit alike the
    longer host wins, of patterns an exception.
    """
    tokens = sorted({t for p in patterns for t in Pattern.parse(p).tokens()})
    counts = token_counts(pages, tokens)

    def judge(batches):
        rules = UrlFilter(site_rules, patterns, counts)
        for batch in batches:
            out = [rules.judge(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], pa.string()) for k in range(5))], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string")


#: What the pattern rules of the query say, written in SQL by hand.
BLOCKED = r"""regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?spam-farm[.]') OR contains(low, '/casino/') OR contains(low, '-casino.')
    OR regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?ads[.].*([^a-z0-9_.%-])banner([^a-z0-9_.%-]|$)', 's') OR regexp_matches(low, '/tracking-pixel([^a-z0-9_.%-]|$)', 's')
    OR regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?cheap-pills[.]')"""
EXCEPTED = r"regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?cheap-pills[.].*/about([^a-z0-9_.%-]|$)', 's')"


def oracle() -> str:
    """DuckDB SQL for the query's rows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH r(rhost, rpath, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
u AS (SELECT page_id, lower(url) AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT p.*, row_number() OVER () AS n FROM p),
f AS (SELECT n, r.rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC, length(rhost) DESC) AS place
      FROM k JOIN r ON (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath))
SELECT page_id, host, path, f.rule AS rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN coalesce({EXCEPTED}, false) THEN 'allow'
            WHEN coalesce({BLOCKED}, false) THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN f ON k.n = f.n AND f.place = 1"""
