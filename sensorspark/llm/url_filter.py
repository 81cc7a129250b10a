"""URL filters: rules on hosts and paths, and block decisions carried over to aliases.

A rule fits its host, all subdomains, and paths that begin with the rule's; the longest fitting rule
decides.  Pages that redirect to one another or name one another as canonical are aliases: their
connected component shares one decision, allow if any member has a fitting allow rule, else block if
any has a fitting block rule, else the default.  A page's own rule comes before its component's.

Links are resolved by RFC 3986 against the page's url, or against its first ``<base href>`` resolved in
the same way (one with a data or javascript scheme does not count): dot segments are removed, a link of
only a query keeps the path, one of only a fragment the query too.

Rules are joined on the suffixes of the distinct hosts, so both tables may be large.  Components are
computed on the pages with such links only.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a null
html has no links; rows repeat as in the input; rules that fit and are equally long are decided for
allow; a link to itself or to a target that is no http url is ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm.components import components
from sensorspark.session import broadcast_if_small, materialize

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ATTRIBUTE = r"""(?is)\s{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# More suffixes than any host name has.
MAX_LABELS = 128


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its question mark, or nothing."""
    return F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def undotted(path: Column) -> Column:
    """An absolute or empty path without the segments ``.`` and ``..``."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out)
        .when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.concat(out, F.array(s))),
    )
    # A last segment of dots names a folder.
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(F.concat(kept, folder), "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The url without scheme, dot segments and fragment: what redirects and canonical links are about."""
    return F.concat(host_of(url), undotted(path_of(url)), query_of(url))


def resolved(base: Column, link: Column) -> Column:
    """The http url without fragment that ``link`` means at the url ``base``; null for another scheme."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    path = path_of(base)
    folder = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    joined = (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .when((link == "") | F.startswith(link, F.lit("#")), F.concat(origin, path, query_of(base)))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )
    place = F.regexp_extract(joined, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(place, undotted(path_of(joined)), query_of(joined))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for the distinct places that some rule fits."""
    labels = F.split("host", r"\.")
    n = F.least(F.size(labels), F.lit(MAX_LABELS))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    spread = places.select("host", "path").where("host != ''").distinct().withColumn("rule_host", F.explode(suffixes))
    fitting = spread.join(broadcast_if_small(rules), "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("first"), rule.alias("rule")))
    return fitting.groupBy("host", "path").agg(best.alias("b")).select(
        "host", "path", "b.rule", F.when(F.col("b.first"), "allow").otherwise("block").alias("rule_verdict")
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = ATTRIBUTE.format(name)
    parts = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.trim(F.replace(F.concat(*parts), F.lit("&amp;"), F.lit("&")))


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): redirects by refresh and canonical links found in the pages."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    bases = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?is)<base\s[^>]*>"), F.lit(0)), lambda tag: tag.rlike(r"(?i)\shref\s*=")
    )
    # Links inside comments and scripts say nothing about the page.
    found = materialize(
        pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
        .withColumn("html", F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", ""))
        .select("url", _attribute(F.get(bases, F.lit(0)), "href").alias("base"), F.explode(tags).alias("tag")),
        "alias-tags",
    )
    canonical = F.when(
        F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"),
        _attribute(F.col("tag"), "href"),
    )
    refresh = F.when(
        F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh",
        F.trim(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)),
    )
    base = F.when(
        F.col("base").isNull() | F.col("base").rlike(r"(?i)^(?:data|javascript):"), F.col("url")
    ).otherwise(resolved(F.col("url"), F.col("base")))
    named = materialize(
        found.select("url", base.alias("base"), F.coalesce(canonical, refresh).alias("link")), "alias-targets"
    ).where("link != ''")
    # An absolute link needs no base, whatever the page's is.
    target = resolved(F.coalesce("base", F.lit("")), F.col("link"))
    rooted = F.col("base").isNotNull() | F.col("link").rlike(r"(?i)^https?://")
    return named.where(rooted).select("url", target.alias("target")).where(F.col("target").isNotNull())


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict and the alias component (null without links) per page."""
    links = materialize(
        alias_links(pages.select("url", "html"))
        .select("url", "target", node_of(F.col("url")).alias("src"), node_of(F.col("target")).alias("dst")),
        "alias-links",
    ).where("src != dst")
    own = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.coalesce(node_of(F.col("url")), F.lit("")).alias("node"),
    )
    ends = links.select(F.col("url").alias("u")).unionByName(links.select(F.col("target").alias("u"))).distinct()
    ends = ends.select(host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), node_of(F.col("u")).alias("node"))
    fits = materialize(
        matched(own.select("host", "path").unionByName(ends.select("host", "path")), rules), "rule-fits"
    )
    out = own.join(fits, ["host", "path"], "left")
    if links.isEmpty():
        out = out.withColumns({"alias": F.lit(None).cast("string"), "shared": F.lit(None).cast("string")})
    else:
        joined = components(links.select("src", "dst"))
        decided = (
            ends.join(fits, ["host", "path"]).join(joined.withColumnRenamed("v", "node"), "node")
            .groupBy("component")
            # "allow" sorts before "block".
            .agg(F.min("rule_verdict").alias("shared"))
        )
        known = materialize(
            joined.join(decided, "component", "left").select(
                F.col("v").alias("node"), F.col("component").alias("alias"), "shared"
            ),
            "alias-verdicts",
        )
        out = out.join(known, "node", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "shared", F.lit(default)).alias("verdict"), "alias",
    )
