"""URL filter: rules by host and path, and blocks that follow redirects and canonical links to aliases.

Pages that redirect to one another or name the same canonical address are one site page under several addresses. The
edges come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of each page, and from an optional table of
redirects seen by the crawler. Addresses are nodes; a component of the graph is a set of aliases. An address with a rule
keeps its rule's verdict. Any other is allowed if an alias is explicitly allowed, else blocked if an alias is blocked,
else allowed: an explicit allow goes before a block that was only passed on. Addresses that are named by links but are no
pages of the table count as aliases too.

Links are resolved as browsers do: against the page's first ``<base href>`` where it has one, with ``.`` and ``..`` taken out of the
path, and a link that is only a query or fragment keeps the base's path.

Cases: a null address, or one without ``://``, has an empty host and path and fits no rule; null or empty html has no
links; a link to the page itself is none; repeated pages get equal rows; the first canonical and the first refresh of a
page count, as browsers do; comments and scripts are not read for links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COMMENTS = "(?is)<!--.*?-->|<script\\b.*?</script>"
CANONICAL = "(?is)<link\\b[^>]*?\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>"
REFRESH = "(?is)<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"
HREF = "(?is)\\bhref\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"
BASE = "(?is)<base\\b[^>]*\\bhref\\b[^>]*>"
TARGET = "(?is)\\burl\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"


class Rule(NamedTuple):
    """A host (with all its subdomains) and the beginning of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(name, verdict) of the longest rule that fits, or null; of equal rules an allow. Rules are a short given list."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """An address as a node: scheme and host in lower case, ``/`` for an empty path, no fragment; null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    made = F.concat(scheme, F.lit("://"), host(url), F.when(path(url) == "", "/").otherwise(path(url)), query)
    return F.when(F.instr(url, "://") > 0, made)


def resolved(base: Column, link: Column) -> Column:
    """A link as a whole address: absolute, without scheme, from the host's root, a query or fragment alone, or relative to the base's folder."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    own = F.when(path(base) == "", "/").otherwise(path(base))
    query = F.regexp_extract(base, "(?s)^[^?#]*(\\?[^#]*)", 1)
    folder = F.regexp_extract(own, "(?s)^(.*/)", 1)
    return (F.when(link == "", F.lit(None)).when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(root, own, link))
            .when(link.startswith("#"), F.concat(root, own, query, link))
            .otherwise(F.concat(root, folder, link)))


def undotted(url: Column) -> Column:
    """A whole address without ``.`` and ``..`` in its path; what would go above the root stays there."""
    parts = F.split(path(url), "/")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
                       lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done)
                       .otherwise(F.concat(done, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.when(F.size(kept) > 0, "/").otherwise("")).otherwise("")
    made = F.concat(F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), end, F.regexp_extract(url, "(?s)^[^?#]*([?#].*)$", 1))
    return F.when(F.rlike(path(url), F.lit("/[.][.]?(/|$)")), made).otherwise(url)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (source, target) of the canonical and refresh links of all pages, as addresses."""
    own = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")).where(
        F.rlike("html", F.lit("(?i)canonical|refresh")) & (F.instr("url", "://") > 0))
    plain = own.select("url", F.regexp_replace("html", COMMENTS, " ").alias("html"))
    based = plain.select("url", "html", F.regexp_extract(F.regexp_extract("html", BASE, 0), HREF, 1).alias("href"))
    # one step at a time: each step's expressions use the last one's several times
    based = based.select("url", "html", F.when(F.col("href") != "", resolved(F.col("url"), F.col("href"))).otherwise(F.col("url")).alias("base"))
    found = based.select("url", "base", F.explode(F.array(
        F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1))).alias("link"))
    whole = found.where("link <> ''").select("url", resolved(F.col("base"), F.col("link")).alias("target"))
    whole = whole.select("url", undotted(F.col("target")).alias("target"))
    made = whole.select(address(F.col("url")).alias("source"), address(F.col("target")).alias("target"))
    return made.where("target IS NOT NULL AND source <> target").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, page_id: str = "page_id",
          url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, by_alias), one per page; ``redirects`` has columns source and target."""
    edges = links(pages, url, html)
    if redirects is not None:
        seen = redirects.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target"))
        edges = edges.unionByName(seen.where("source <> target")).distinct()
    found = components(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    named = edges.select(F.explode(F.array("source", "target")).alias("address")).distinct()
    told = named.select(F.xxhash64("address").alias("node"),
                        rule_of(host(F.col("address")), path(F.col("address")), rules)["verdict"].alias("verdict"))
    passed = (told.where("verdict IS NOT NULL").join(found, "node").groupBy("component")
              .agg(F.min("verdict").alias("passed")))  # "allow" sorts before "block"
    aliases = named.withColumn("node", F.xxhash64("address")).join(found.join(passed, "component"), "node").select("address", "passed")

    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    placed = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                        address(F.col("url")).alias("address"), "url")
    # pages without an address have no aliases; a key of their own keeps them from meeting in one task
    placed = placed.withColumn("address", F.coalesce("address", F.concat_ws("-", F.lit("none"), "page_id", "url"))).drop("url")
    ruled = placed.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).join(aliases, "address", "left")
    return ruled.select("page_id", "host", "path", F.col("own.name").alias("rule"),
                        F.coalesce("own.verdict", "passed", F.lit("allow")).alias("verdict"),
                        (F.col("own").isNull() & F.col("passed").isNotNull()).alias("by_alias"))
