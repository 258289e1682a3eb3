"""URL filters: rules on host and path, block decisions passed on to aliases.

A rule (host, path, verdict) fits its host and all subdomains where the URL's
path starts with the rule's; the longest rule wins.  URLs that lead to one
place are aliases: redirects and canonical links are the edges of a graph
whose connected components are found by distributed star steps.  An alias
without a rule of its own takes its component's decision: allowed if a member
is allowed by a rule (explicit allow goes before block), else blocked if a
member is blocked by a rule, else the default.

Edges come from each page: ``<link rel=canonical>``, ``<meta
property=og:url>`` and ``<meta http-equiv=refresh>`` in the head of its html
(comments, scripts and the like left out; relative references and dot segments
resolved, character references decoded), and the redirects that a URL's form implies (http to https, ``www.`` to the bare
host, fragment, default port and tracking parameters dropped).

Edge cases: a null URL or one without ``://`` has an empty host and path, no
alias, and the default verdict; null html adds no edge; repeated rows give
equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that carry no content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
ABSOLUTE = "(?s)^[^:]*?://"


def host_of(url: Column) -> Column:
    got = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def place_of(url: Column) -> Column:
    """Where a URL's form leads: the key of its node; null for no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/(index\.html?)?$", "")
    query = F.regexp_replace(query_of(url), rf"(?<=[?&])({TRACKING})=[^&]*(&|$)", "")
    query = F.regexp_replace(query, "[?&]+$", "")
    return F.when(url.contains("://"), F.concat(host, path, query))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    def step(kept: Column, segment: Column) -> Column:
        return (F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .when(segment == ".", kept).otherwise(F.array_append(kept, segment)))

    segments = F.split(path, "/")
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), step)
    # a last dot segment names a folder
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def absolute(base: Column, href: Column) -> Column:
    """``href`` as a URL, taken from the page at ``base``; null if it names no
    place on the web (``mailto:``, ``javascript:``)."""
    own = F.regexp_extract(href, "(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(href, "(?s)^[^?#]*(.*)$", 1)
    root = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(path_of(base), "[^/]*$", ""), F.lit("")), F.lit("/"))
    full = (F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?)://", 1), F.lit(":"), href))
            .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(href.startswith("/"), F.concat(root, href))
            .when(own != "", F.concat(root, folder, href))
            .when(href.startswith("?"), F.concat(root, path_of(base), tail))
            .otherwise(F.concat(root, path_of(base), query_of(base), tail)))
    return F.concat(F.regexp_extract(full, "(?s)^(.*?://[^/?#]*)", 1), without_dots(path_of(full)),
                    F.regexp_extract(full, "(?s)^.*?://[^?#]*(.*)$", 1))


# The character references that stand in URLs; & goes last, so
# that a written-out reference is decoded once.
REFERENCES = [("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"),
              ("sol|#47|#x2f", "/"), ("colon|#58|#x3a", ":"), ("quest|#63|#x3f", "?"), ("equals|#61|#x3d", "="),
              ("num|#35|#x23", "#"), ("amp|#38|#x26", "&")]


def decoded(value: Column) -> Column:
    for names, char in REFERENCES:
        value = F.regexp_replace(value, f"(?i)&({names});", char)
    return value


# a page without any of these words names no other URL
NAMES = "(?i)canonical|og:url|refresh"
# comments, the bodies of raw elements, and all after the head
OUTSIDE = (r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript)\b.*?(?:</\1\s*>|\z)"
           r"|</head\b.*|<body\b.*")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def link_targets(html: Column) -> Column:
    """Array of the hrefs by which a page names another URL as its own."""
    start = r"(?<=[\s\"'/])"

    def first(head: Column, tag: str, name: str, value: str, attribute: str) -> Column:
        element = F.regexp_extract(
            head, rf"(?is)<{tag}\b[^>]*{start}{name}\s*=\s*([\"'][^\"'>]*(?<=[\s\"']){value}(?=[\s\"'])|{value}(?=[\s>/]))[^>]*>", 0)
        quoted = rf"(?is){start}{attribute}\s*=\s*([\"'])\s*(.*?)\s*\1"
        return once(element, lambda e: F.coalesce(
            F.nullif(F.regexp_extract(e, quoted, 2), F.lit("")),
            F.regexp_extract(e, rf"(?is){start}{attribute}\s*=\s*([^\"'>\s]+)", 1)))

    def found(head: Column) -> Column:
        refresh = F.regexp_extract(first(head, "meta", "http-equiv", "refresh", "content"),
                                   r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*[\"']?\s*([^\"'\s]+)", 1)
        return F.array(first(head, "link", "rel", "canonical", "href"),
                       first(head, "meta", "property", "og:url", "content"), refresh)

    targets = F.when(html.rlike(NAMES), once(F.regexp_replace(html, OUTSIDE, " "), found))
    return F.transform(F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda x: x != ""), decoded)


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add (rule, rule_verdict) of the longest fitting rule, or nulls, to rows
    with ``host`` and ``path``.

    Hosts are matched once each by their suffixes; a host's rules are joined
    back as an array, whose paths are tested in place.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (urls.select("host").distinct().withColumn("_suffix", F.explode(suffixes))
             .join(rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), "verdict"), "_suffix")
             .groupBy("host").agg(F.collect_set(F.struct(
                 F.length(F.concat("_suffix", "_path")).alias("length"), (F.col("verdict") == "allow").alias("allow"),
                 F.concat("_suffix", "_path").alias("rule"), F.col("_path").alias("path"), "verdict")).alias("_rules")))
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return (urls.join(found, "host", "left").withColumn("_best", best)
            .withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict"))
            .drop("_rules", "_best"))


def decide(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every page."""
    url = F.col(url_col).cast("string")
    # written once: the html is parsed in one pass, not in each of the joins below
    base = stored(pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                               link_targets(F.col(html_col).cast("string")).alias("targets")))
    own = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                      F.md5(place_of(F.col("url"))).alias("node"), F.md5(F.col("url")).alias("form"))
    judged = rule_matches(own, rules)
    # redirects by form: the URL as written and the place that it leads to
    formal = base.where(place_of(F.col("url")).isNotNull()).select(
        F.md5("url").alias("a"), F.md5(place_of(F.col("url"))).alias("b"))
    named = (base.where("url like '%://%' and size(targets) > 0").withColumn("target", F.explode("targets"))
             .withColumn("target", absolute(F.col("url"), F.col("target"))).where("target is not null"))
    links = named.select(F.md5(place_of(F.col("url"))).alias("a"), F.md5(place_of(F.col("target"))).alias("b"))
    member = components(formal.unionByName(links).where("a is not null and b is not null"))
    # targets that are no page count with their own rules
    targets = rule_matches(named.select(host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"),
                                        F.md5(place_of(F.col("target"))).alias("form")), rules)
    explicit = (judged.select("form", "rule_verdict").unionByName(targets.select("form", "rule_verdict"))
                .where("rule_verdict is not null").distinct())
    inherited = (explicit.join(member, explicit.form == member.node).groupBy("component")
                 .agg(F.max(F.col("rule_verdict") == "allow").alias("has_allow"),
                      F.max(F.col("rule_verdict") == "block").alias("has_block")))
    verdict = (F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict"))
               .when(F.col("has_allow"), F.lit("allow")).when(F.col("has_block"), F.lit("block"))
               .otherwise(F.lit(default)))
    return (judged.join(member, judged.form == member.node, "left").join(inherited, "component", "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component"))
