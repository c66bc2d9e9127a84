"""URL filters whose decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.graph import connected_components
from cloudloom.llm.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def parts(url: Column) -> list[Column]:
    """Host (A-Z lower-cased), path and query of a URL; all empty without ``://``."""
    host, path, query = (F.coalesce(F.regexp_extract(url, _URL, k), F.lit("")) for k in (1, 2, 3))
    return [F.translate(host, UPPER, LOWER), path, query]


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}{_VALUE}"
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def targets(html: Column) -> Column:
    """What a page names as itself: canonical links and the targets of refreshes, as written."""
    tags = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0)))

    def one(tag: Column) -> Column:
        link = tag.rlike(r"(?is)^<link\b") & F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
        refresh = tag.rlike(r"(?is)^<meta\b") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
        to = F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*['\"]?\s*([^'\"\s]+)", 1)
        return F.when(link, F.trim(_attribute(tag, "href"))).when(refresh, to)

    return F.filter(F.transform(tags, one), lambda x: x.isNotNull() & (x != ""))


def resolve(base_url: Column, host: Column, path: Column, link: Column) -> Column:
    """The link as a full URL, seen from a page."""
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.lit("http://"), host, path, link))
        .when(~link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.concat(F.lit("http://"), host, folder, link))
    )


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (action, host and path) that fits, as struct(rule, action), or null.  A rule fits its host and all subdomains if the path starts with its path; of rules of one length the first in order of code points wins."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _node(host: Column, path: Column, query: Column) -> Column:
    return F.xxhash64(host, path, query)


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url, html; other columns are ignored).

    A page that a rule fits gets the rule's action.  For the others, URLs are
    nodes (host, path and query) and canonical links, refreshes and
    ``redirects`` (source, target) are edges.  A URL's aliases are its connected
    component: if a rule blocks one of them, linked URLs included, the page is
    blocked, unless a rule explicitly allows one.  Everything else is allowed.

    A null URL and one without ``://`` have an empty host and path, are no
    alias of anything, fit no rule and are allowed.  A null html has no links.
    Repeated rows are judged alike.  An empty table gives an empty result.
    The rules are a short list in the plan; pages are joined only to
    components that have an edge and a decision.
    """
    host, path, query = parts(F.col("url"))
    known = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumns({"host": host, "path": path, "query": query})
    known = known.withColumns({"node": F.when(F.col("host") != "", _node(F.col("host"), F.col("path"), F.col("query"))), "said": rule_for(F.col("host"), F.col("path"), rules)})

    linked = known.where("node is not null").select("node", "said", "host", "path", "url", F.explode(targets(F.col("html"))).alias("link"))
    linked = linked.select("node", F.col("said.action").alias("action"), resolve(F.col("url"), F.col("host"), F.col("path"), F.col("link")).alias("to"))
    if redirects is not None:
        h, p, q = parts(F.col("source"))
        more = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("to")).withColumns({"h": h, "p": p, "q": q}).where("h <> ''")
        linked = linked.unionByName(more.select(_node(F.col("h"), F.col("p"), F.col("q")).alias("node"), rule_for(F.col("h"), F.col("p"), rules)["action"].alias("action"), "to"))
    h, p, q = parts(F.col("to"))
    linked = linked.withColumns({"h": h, "p": p, "q": q}).where("h <> ''")
    edges = materialize(linked.select(F.col("node").alias("u"), _node(F.col("h"), F.col("p"), F.col("q")).alias("v"), F.col("action").alias("a"), rule_for(F.col("h"), F.col("p"), rules)["action"].alias("b")), "aliases")

    comps = connected_components(edges.select("u", "v"))
    marks = edges.select(F.col("u").alias("node"), F.col("a").alias("action")).unionAll(edges.select("v", "b")).where("action is not null").distinct()
    decided = marks.join(comps, "node").groupBy("component").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed")).where("blocked and not allowed")
    blocked = comps.join(decided.select("component"), "component").select("node", F.lit(True).alias("by_alias"))
    out = known.select("page_id", "host", "path", "node", "said").join(blocked, "node", "left")
    verdict = F.coalesce(F.col("said.action"), F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("said.rule").alias("rule"), verdict.alias("verdict"))
