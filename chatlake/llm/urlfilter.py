"""URL filters over redirect equivalence.

Rules name a host and a path and say allow or block.  A rule fits its host and
all subdomains when the URL's path starts with the rule's; of the rules that
fit, the longest (host labels, then path) wins.  Redirects (meta refresh) and
canonical links make two URLs aliases.  The components of those links are
found by distributed connected components, and a URL without a rule of its own
is blocked when any URL of its component is blocked by a rule, allowed
otherwise.  A URL's own rule always stands, so an explicit allow is never
overruled by an alias, and an allowed alias never clears a blocked one.

Scale: rules meet pages as a broadcast below ``RULES_SENT`` rows (checked),
else through a join on (rule host), with one row a parent domain of each
host.  Pages reach the graph as 64-bit keys; blocked components are joined
back by key.  HTML is read once, for the links.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule, has no alias and is allowed; null HTML has no links; a link is
resolved against its page, with the basic HTML entities decoded; ``.`` and
``..`` segments of a path and the fragment are no part of a URL's identity;
repeated rows get the same verdict; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import stored
from chatlake.llm.graph import connected_components

#: Rules up to this many rows are broadcast.
RULES_SENT = 100_000
#: Rules of the production query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path (up to ``?`` or ``#``) of a URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _SMALL)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def winning_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, host, path) -> (key, rule, rule_verdict) for the keys that a rule fits."""
    r = rules.select(F.col("host").alias("domain"), F.col("path").alias("r_path"),
                     F.col("verdict").alias("rule_verdict"))
    if rules.limit(RULES_SENT + 1).count() <= RULES_SENT:
        r = F.broadcast(r)
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(
        F.slice("labels", i, F.size("labels")), "."))
    near = (urls.where("host <> ''").withColumn("labels", labels)
            .select("key", "path", F.explode(parents).alias("domain")))
    fit = near.join(r, "domain").where(F.startswith("path", "r_path"))
    # Longest host first, then longest path; of equal rules, allow.
    win = F.max(F.struct(F.length("domain").alias("a"), F.length("r_path").alias("b"),
                         (F.col("rule_verdict") == "allow").alias("c"), "domain", "r_path", "rule_verdict"))
    return (fit.groupBy("key").agg(win.alias("w"))
            .select("key", F.concat("w.domain", "w.r_path").alias("rule"), F.col("w.rule_verdict").alias("rule_verdict")))


def absolute(link: F.Column, base: F.Column) -> F.Column:
    """A link as a URL of its own, resolved against the page it stands on."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    site = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link))
            .otherwise(F.concat(site, folder, link)))


def decoded(value: F.Column) -> F.Column:
    """An attribute's value with the basic HTML entities decoded; ``&amp;`` last, so nothing is decoded twice."""
    for pattern, char in (("quot|#0*34|#x0*22", '"'), ("apos|#0*39|#x0*27", "'"), ("lt|#0*60|#x0*3c", "<"),
                          ("gt|#0*62|#x0*3e", ">"), ("amp|#0*38|#x0*26", "&")):
        value = F.regexp_replace(value, f"(?i)&(?:{pattern});", char)
    return value


def without_dots(url: F.Column) -> F.Column:
    """A URL whose path has no ``.`` and ``..`` segments."""
    site = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*/([^?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(ends, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(url.rlike(r"^[^:/?#]*://[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(
        site, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


def identity(url: F.Column) -> F.Column:
    """64-bit key of a URL without its fragment and dot segments, scheme and host lower-cased."""
    bare = F.regexp_extract(without_dots(url), r"(?s)^([^#]*)", 1)
    head = F.translate(F.regexp_extract(bare, r"(?s)^([^/?]*(?://[^/?]*)?)", 1), _UPPER, _SMALL)
    return F.xxhash64(F.concat(head, F.substr(bare, F.length(head) + 1)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) URLs of canonical links and meta refreshes in (url, html)."""
    tags = F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")
    tag = pages.where("url like '%://%' and html is not null").select("url", F.explode(tags).alias("tag"))
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def attr(name):
        return F.concat(*[F.regexp_extract("tag", rf"(?is)\s{name}{value}", i) for i in (1, 2, 3)])

    canonical = (F.lower(F.substring("tag", 1, 5)) == "<link") & F.lower(attr("rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = (F.lower(F.substring("tag", 1, 5)) == "<meta") & (F.lower(F.trim(attr("http-equiv"))) == "refresh")
    to = (F.when(canonical, F.trim(decoded(attr("href"))))
          .when(refresh, F.trim(F.regexp_extract(decoded(attr("content")), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))))
    return (tag.select(F.col("url").alias("source"), to.alias("to")).where("to <> ''")
            .select("source", without_dots(absolute(F.col("to"), F.col("source"))).alias("target")))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component of every page.

    ``redirects``: further (source, target) URLs known to be aliases.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"),
                        F.when(F.col("url").contains("://"), identity(F.col("url"))).alias("node"))
    edges = page_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = stored(edges.where("source is not null and target is not null"), "aliases")
    # Targets need no page of their own to pass a block on.
    ends = (edges.select(F.col("source").alias("url")).unionByName(edges.select(F.col("target").alias("url")))
            .distinct())
    h, p = url_parts(F.col("url"))
    ends = ends.select(h.alias("host"), p.alias("path"), identity(F.col("url")).alias("node"))
    seen = stored(rows.select("host", "path", "node").unionByName(ends).where("host <> ''").distinct(), "urls")
    # A URL's rule depends on host and path alone.
    places = seen.select("host", "path").distinct().withColumn("key", F.struct("host", "path"))
    ruled = stored(winning_rules(places, rules).select("key.host", "key.path", "rule", "rule_verdict"), "ruled")
    roots = connected_components(edges.select(identity(F.col("source")).alias("a"),
                                              identity(F.col("target")).alias("b")))
    roots = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "urlroots")
    linked = seen.join(roots, "node")
    blocked = (linked.join(ruled, ["host", "path"]).where("rule_verdict = 'block'").select("root").distinct())
    tainted = (roots.join(blocked.withColumn("tainted", F.lit(True)), "root", "left")
               .select("node", "root", "tainted"))
    out = rows.join(ruled, ["host", "path"], "left").join(tainted, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                      F.coalesce("root", "node").alias("component"))
