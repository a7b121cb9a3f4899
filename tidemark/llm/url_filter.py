"""URL rules whose block decisions spread to aliases: pages that redirect or name a canonical address are one with their target.

1. `parts` cuts urls into host and path; of the rules that fit, the longest decides (see `rule_column`). Rules are a short list
   in the program and become a column expression: no shuffle.
2. Edges join a page's url with the target of each `<link rel=canonical>` and `<meta http-equiv=refresh>` of its html, and with any further
   (source, target) pairs, such as a crawl's redirects. Only pages that may hold one of these tags reach Python. A url's node is its text without
   scheme and fragment, its host lower-cased.
3. Equivalence classes are the connected components of these edges, by alternating star steps over joins. Nodes are numbered first, so
   that no two of them can share a hash.
4. A class with a member that a rule blocks is blocked. A page that a rule fits keeps this rule's verdict, allow or block: an
   explicit allow takes precedence over the class, for the page itself and not for its aliases (else a page could escape by naming an
   allowed one as canonical). Other pages are blocked if their class is, and allowed otherwise.

Hosts that hold a third of all urls, and targets that a third of all pages name, are met by joins on whole urls against one row per blocked
alias; nothing gathers the members of a class. Null urls and urls without `://` have empty host and path, no rule and no class. Null or empty
html has no edges; only tags outside comments and scripts count, a relative target is resolved against the page's url, and what can't be
resolved to a host is no edge. Rows are returned as often as they occur, null ids included."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """`host` and all its subdomains, where the path starts with `path`."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null urls and urls without `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_column(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits (ties: the longer host, then allow), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "allow"))
    first = None
    for rule in ordered:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        first = F.when(fits, found) if first is None else first.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if first is None else first


def node_column(url: Column) -> Column:
    """The node of a url: host, path and query; null where there is no host."""
    host, _ = parts(url)
    rest = F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


# A comment, a script or style with its content, or a tag whose attributes may hold `>` in quotes.
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_REFRESH = re.compile(r"\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?(.+)", re.S | re.I)
MAYBE = r"(?i)canonical|http-equiv"


def targets(page_url: str, text: str) -> list[str]:
    """Absolute targets of the canonical links and refreshes of one page."""
    base, found = page_url, []
    for piece in _PIECE.finditer(text):
        kind = (piece.group(2) or "").lower()
        if not kind:
            continue
        attributes = {}
        for name, *values in _ATTRIBUTE.findall(piece.group(3)):
            attributes.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")).strip())
        target = None
        if kind == "base":
            base = _joined(base, attributes.get("href", ""))
        elif kind == "link" and "canonical" in attributes.get("rel", "").lower().split():
            target = attributes.get("href")
        elif kind == "meta" and attributes.get("http-equiv", "").lower() == "refresh":
            match = _REFRESH.match(attributes.get("content", ""))
            target = match and match.group(1).strip().strip("'\"")
        if target:
            found.append(_joined(base, target))
    return found


def _joined(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:  # such as an unclosed [ in a host
        return ""


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target) urls of the links in `pages` (url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, target = [], []
            for url, text in zip(batch.column("url"), batch.column("html")):
                own = targets(url.as_py(), text.as_py())
                source += [url.as_py()] * len(own)
                target += own
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(target, pa.string())], names=["source", "target"])

    maybe = pages.where(F.col("url").isNotNull() & F.col("html").rlike(MAYBE))
    return maybe.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "source string, target string")


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """node: every node of a class in which a rule blocks some member, by `edges` (source, target)."""
    linked = edges.select(node_column(F.col("source")).alias("source"), node_column(F.col("target")).alias("target"))
    linked = checkpointed(linked.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct())
    nodes = linked.select(F.col("source").alias("node")).union(linked.select("target")).distinct()
    nodes = checkpointed(nodes.select("node", F.monotonically_increasing_id().alias("id")))  # stored: the numbers stay as they are
    numbered = (linked.join(nodes.select(F.col("node").alias("source"), F.col("id").alias("a")), "source")
                .join(nodes.select(F.col("node").alias("target"), F.col("id").alias("b")), "target").select("a", "b"))
    classes = nodes.join(components(numbered), "id").select("node", "component")
    host, path = parts(F.concat(F.lit("://"), "node"))
    verdict = rule_column(rules, host, path)["verdict"]
    blocked = classes.where(verdict == "block").select("component").distinct()
    return classes.join(blocked, "component", "left_semi").select("node")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, by_alias for every row of `pages` (page_id, url, html); `redirects`: further (source, target) urls."""
    host, path = parts(F.col("url"))
    judged = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), node_column(F.col("url")).alias("node"))
    judged = judged.withColumn("found", rule_column(rules, F.col("host"), F.col("path")))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    blocked = blocked_aliases(edges, rules).select("node", F.lit(True).alias("blocked"))
    by_alias = F.col("found").isNull() & F.coalesce(F.col("blocked"), F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(by_alias, "block").otherwise("allow"))
    return judged.join(blocked, "node", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("by_alias"))
