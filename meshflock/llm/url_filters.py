"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a pattern over ``host + path`` (or the host only): ``||`` at its start means the
start of the host or of one of its labels, ``^`` a separator (any character that is no
ASCII letter or digit, or an end), ``*`` anything; all else stands for itself. A run of
ASCII letters and digits in a pattern is a literal token if both its neighbours are fixed
non-alphanumeric characters, separators or anchors, so that every matching URL has it as a
whole token. Token counts of all URLs tell each rule's rarest token; the rule is filed under
it. A URL's tokens fetch candidate rules, and only those run their regular expressions.
Rules without a literal token are run on every URL.

Site rules (``site``) come first: the longest that matches decides. Otherwise an ``allow``
pattern beats ``block`` patterns, and without any the URL is allowed.

The rules are the caller's list, not data; ``RULES_PER_PASS`` of them at most are sent to a
task at once and longer lists take several passes. Null URLs and URLs without ``://`` have
an empty host and path and are allowed. Long URLs are matched whole. Of rules of one rank the
greater pattern decides, so the order of the list does not matter. Rows are judged one by one:
repeated rows get equal verdicts, and an empty table gives an empty result. Input columns
named as an output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.llm.carry import add_columns

RULES_PER_PASS = 50_000
TOKEN = re.compile("[A-Za-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    site: str | None = None
    host_only: bool = False

    def regex(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            out, body = r"\A(?:[^/]*\.)?", body[2:]
        for ch in body:
            out += ".*" if ch == "*" else r"(?:\A|\Z|[^A-Za-z0-9])" if ch == "^" else re.escape(ch)
        return f"(?s){out}"

    def tokens(self) -> list[str]:
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        out = []
        for m in TOKEN.finditer(body):
            left = body[m.start() - 1] if m.start() else ("^" if anchored else "*")
            right = body[m.end()] if m.end() < len(body) else "*"
            if left != "*" and right != "*":
                out.append(m[0])
        return out


def site(verdict: str, place: str) -> Rule:
    """Rule for a host with its subdomains and a path prefix, such as ``example.org/es/``."""
    return Rule(verdict, f"||{place}", site=place)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


def token_counts(df: DataFrame, rules: list[Rule], url: str) -> dict[str, int]:
    """Number of URLs with each literal token of the rules, over all URLs."""
    known = sorted({t for r in rules for t in r.tokens()})
    if not known:
        return {}
    # the host is lower-cased in matching, so tokens of either spelling are counted
    found = F.array_union(F.split(F.col(url), "[^A-Za-z0-9]+"), F.split(F.lower(url), "[^A-Za-z0-9]+"))
    hit = F.array_intersect(found, F.array(*map(F.lit, known)))
    rows = df.select(F.explode(hit).alias("token")).groupBy("token").count().collect()  # at most one row per rule token
    return {r["token"]: r["count"] for r in rows}


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.always, self.by_token = [], {}
        for r in rules:
            entry = (re.compile(r.regex()), r)
            tokens = r.tokens()
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def matches(self, host: str, path: str):
        whole = host + path
        seen = set(TOKEN.findall(whole))
        candidates = [*self.always, *(e for t in seen & self.by_token.keys() for e in self.by_token[t])]
        return [r for rx, r in candidates if rx.search(host if r.host_only else whole)]


def better(a: Rule | None, b: Rule | None) -> Rule | None:
    def rank(r):
        return (0,) if r is None else (2, len(r.site), r.site) if r.site is not None else (1, r.verdict == "allow", r.pattern)

    return max(a, b, key=rank)


ADDED = ("host", "path", "rule", "verdict", "pattern")


def judge(df: DataFrame, rules: list[Rule], url: str = "url", counts: dict[str, int] | None = None) -> DataFrame:
    """Add host, path, rule (the deciding site rule), verdict and pattern (the deciding rule's)."""
    counts = token_counts(df, rules, url) if counts is None else counts
    out = df
    passes = [rules[i : i + RULES_PER_PASS] for i in range(0, len(rules), RULES_PER_PASS)] or [[]]
    for k, part in enumerate(passes):

        def make(part=part, first=k == 0):
            index = Index(part, counts)

            def judged(urls, *before):
                best = [None] * len(urls)
                if not first:  # the best of the passes before
                    best = [p and Rule(v, p, s, h) for p, v, s, h in zip(*(c.to_pylist() for c in before), strict=True)]
                parts = [split_url(u) for u in urls.to_pylist()]
                for i, (host, path) in enumerate(parts):
                    for r in index.matches(host, path):
                        best[i] = better(best[i], r)
                text = [[h for h, _ in parts], [p for _, p in parts], [r and r.site for r in best], [r.verdict if r else "allow" for r in best], [r and r.pattern for r in best]]
                return [*(pa.array(t, pa.string()) for t in text), pa.array([bool(r and r.host_only) for r in best])]

            return judged

        before = [] if k == 0 else ["pattern", "verdict", "rule", "_host_only"]
        out = add_columns(out, make, [*((c, "string") for c in ADDED), ("_host_only", "boolean")], [url, *before])
    return out.drop("_host_only")


SITES = [site("allow", "org/"), site("block", "example.org/es/"), site("block", "example.org/en/1"), site("allow", "com/fr/"), site("block", "com/de/")]
#: Words that mark unwanted hosts.
UNWANTED = ("ads-track", "adult", "bets", "casino", "escort", "pills", "poker", "porn", "spam", "viagra")
RULES = SITES + [Rule("block", f"^{w}^", host_only=True) for w in UNWANTED]

ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  (SELECT max('^' || w || '^') FROM unnest([WORDS]) AS u(w) WHERE regexp_matches(c.host, '(^|[^A-Za-z0-9])' || w || '($|[^A-Za-z0-9])')) AS hit FROM c)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN '||' || rule ELSE hit END AS pattern
FROM d
""".replace("WORDS", ", ".join(f"'{w}'" for w in UNWANTED))
