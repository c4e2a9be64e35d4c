"""URL filtering with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains,
and the longest fitting rule decides a url. A url that no rule fits inherits
the decision of its aliases: urls with the same normal form, and urls tied by
redirects, canonical links or refresh tags. Aliases are the connected
components of that graph. Within a component an explicit allow goes before any
block; a component without a rule is allowed.

Normal forms contract the graph before any iteration: a url and its variants
(scheme, leading www. or m., fragment, tracking parameters, trailing slash or
.html) are one node, so the distributed components run over explicit edges
only. Decisions are gathered per node with map-side combination.

Links are seen from their page or its base tag: relative targets, "?", "." and ".."
are resolved; other schemes, like mailto, are no links.

Defined cases: a null url or one without "://" has empty host and path, no rule
and no alias, and is allowed; a null page body has no edges; a page that links
to itself adds nothing; repeated rows are judged alike, row by row; targets
outside the table carry their own rules' decisions; an empty table gives an
empty table; further columns pass through unless named like an output.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.components import components
from refloom.llm.scratch import cut

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TRACKING = r"(?:utm_[a-z]*|ref|fbclid|gclid)=[^&]*(?:&|$)"


class Rule(NamedTuple):
    action: str  # "allow" or "block"
    text: str  # host, then the path prefix from its slash on

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def fitting(host_: Column, path_: Column, rules: Sequence[Rule], out) -> Column:
    """out(rule) of the longest rule that fits, else null. Of equally long ones the first given decides."""
    found = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        found = F.when(fits, F.lit(out(rule))).otherwise(found)
    return found


def normal(url: Column) -> Column:
    """The normal form of a url: one node for all its variants. Null without "://"."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(?:^|(?<=&)){_TRACKING}", ""), "&$", "")
    bare = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    short = F.regexp_replace(path(url), r"(?:/|\.html?)+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(bare, short, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _absolute(target: Column, page: Column) -> Column:
    """A link's target seen from a page; null for a page without "://" and for other schemes, like mailto."""
    top = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(page), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    whole = (
        F.when(target.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(top, target))
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.rlike(r"\A[?#]"), F.concat(top, path(page), target))
        .otherwise(F.concat(top, folder, target))
    )
    dotted = path(whole).rlike(r"/\.\.?(?:/|\z)")
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*[^?#]*(.*)\z", 1)
    plain = F.when(dotted, F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), _undotted(path(whole)), rest)).otherwise(whole)
    return F.when(F.instr(page, "://") > 0, plain)


def _undotted(path_: Column) -> Column:
    """A path without its "." and ".." parts."""
    parts = F.split(F.substring(F.regexp_replace(path_, r"(/\.\.?)\z", "$1/"), F.lit(2), F.length(path_) + 1), "/")
    step = lambda a, p: F.when(p == ".", a).when(p == "..", F.regexp_replace(a, r"/[^/]*\z", "")).otherwise(F.concat(a, F.lit("/"), p))
    return F.aggregate(parts, F.lit(""), step)


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, target) from canonical links and refresh tags of page bodies."""
    html = F.col(html_col)
    some = pages.select(F.col(url_col).alias("url"), html.alias("html")).where(html.isNotNull() & F.col(url_col).isNotNull() & html.rlike(r"(?i)canonical|http-equiv"))
    base = F.nullif(F.regexp_extract("html", r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))
    tags = some.select("url", F.coalesce(_absolute(base, F.col("url")), F.col("url")).alias("from"), F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    link = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    turn = F.when(F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = tags.select("url", "from", F.replace(F.coalesce(link, turn), F.lit("&amp;"), F.lit("&")).alias("to")).where(F.col("to") != "")
    return found.select("url", _absolute(F.col("to"), F.col("from")).alias("target")).where("target is not null")


def _decision(df: DataFrame, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    url = F.col(url_col)
    return df.select(normal(url).alias("node"), fitting(host(url), path(url), rules, lambda r: r.action).alias("own"))


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Add host, path, rule, inherited (the aliases' decision) and verdict to every row; ``redirects`` has (url, target)."""
    edges = [page_edges(pages, url_col, html_col)] if html_col else []
    edges += [redirects.select("url", "target")] if redirects is not None else []
    given = cut(reduce(DataFrame.union, edges).distinct(), "links") if edges else None
    # url and target of a link judge themselves besides the pages
    judged = _decision(pages, url_col, rules)
    if given is not None:
        judged = judged.union(_decision(given, "target", rules)).union(_decision(given, "url", rules))
    flag = lambda action: F.max((F.col("own") == action).cast("int"))
    nodes = judged.where("node is not null and own is not null").groupBy("node").agg(flag("allow").alias("allow"), flag("block").alias("block"))
    if given is not None and not given.isEmpty():
        roots = cut(components(given.select(normal(F.col("url")).alias("a"), normal(F.col("target")).alias("b")), "a", "b"), "roots")
        tied = nodes.join(roots, "node").groupBy("root").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
        spread = roots.join(tied, "root").select("node", "allow", "block")
        nodes = nodes.union(spread).groupBy("node").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    decided = nodes.select("node", F.when(F.col("allow") == 1, "allow").otherwise("block").alias("inherited"))
    url = F.col(url_col)
    own = pages.drop("inherited").withColumns({"host": host(url), "path": path(url), "node": normal(url)})
    own = own.withColumn("rule", fitting(F.col("host"), F.col("path"), rules, lambda r: r.text)).withColumn("own", fitting(F.col("host"), F.col("path"), rules, lambda r: r.action))
    out = own.join(decided, "node", "left").withColumn("verdict", F.coalesce("own", "inherited", F.lit("allow")))
    return out.drop("node", "own")
