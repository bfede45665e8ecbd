"""URL filters: block and allow rules by host suffix and path prefix, spread over equivalent addresses.

Everything is built-in functions. Redirects (meta refresh), canonical links and the normal form of an address are
edges of a graph of addresses; its connected components are sets of aliases. A page that no rule fits takes its
component's decision: allow where any member is explicitly allowed, else block where any is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.operators.components import connected_components
from atlasmill.session import materialize

#: (host, path prefix, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules up to which they are one expression; a longer list is joined on the host's suffixes.
LITERAL_RULES = 200
#: Query parameters that do not change what an address shows.
TRACKING = "(?:utm_[a-z]+|gclid|fbclid|ref)"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' where there is no '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host up to '?', '#' or the end; '' where there is no '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """The address without scheme, fragment, tracking parameters, default port and closing slash; null where there is no host."""
    query = F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(query, f"(?i)(?:^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    host = F.regexp_replace(host_of(url), ":(?:80|443)$", "")
    form = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", form)


def _target(tag: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(tag, pattern, 1), "&amp;", "&"), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that starts with '/', its '.' and '..' segments carried out."""
    parts = F.split(path, "/")
    parts = F.when(path.rlike("/\\.\\.?$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(seen: Column, part: Column) -> Column:
        up = F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", seen).otherwise(F.concat(seen, F.array(part)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(F.instr(path, "/.") > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """The address that a link target stands for on the page url; null where it has no host (mailto:, javascript:)."""
    origin = F.nullif(F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1), F.lit(""))
    path, rest = F.regexp_extract(to, "(?s)^[^?#]*", 0), F.regexp_extract(to, "(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), "(?s)^/(.*/)", 1))
    return (
        F.when(to.rlike("(?i)^[a-z][a-z0-9+.-]*://"), to)
        .when(to.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("#"), F.concat(F.regexp_extract(url, "(?s)^[^#]*", 0), to))
        .when(to.startswith("?"), F.concat(origin, path_of(url), to))
        .when(to.startswith("/"), F.concat(origin, without_dots(path), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


#: What a browser does not read as tags: comments and scripts.
UNREAD = "(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)"
CANONICAL = "(?is)^<link\\b[^>]*\\srel\\s*=\\s*(?:\"(?:[^\">]*\\s)?canonical(?:\\s[^\">]*)?\"|'(?:[^'>]*\\s)?canonical(?:\\s[^'>]*)?'|canonical[\\s/>])"
REFRESH = "(?is)^<meta\\b[^>]*\\shttp-equiv\\s*=\\s*[\"']?refresh\\b"
HREF, ADDRESS = "(?is)\\shref\\s*=\\s*[\"']?([^\"'\\s>]+)", "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: canonical links and meta refresh redirects written in the pages, outside comments and scripts.

    Relative ones are resolved against the page's first base address, or else its own.
    """
    html = pages.select("url", "html").where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull())
    tags = F.regexp_extract_all(F.regexp_replace("html", UNREAD, " "), F.lit("(?is)<(?:link|meta|base)\\b[^>]*>"), F.lit(0))
    html = html.select("url", tags.alias("tags"))
    base = _target(F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base\\b") & t.rlike(HREF)), F.lit(0)), HREF)
    tag = F.col("tag")
    to = F.when(tag.rlike(CANONICAL), _target(tag, HREF)).when(tag.rlike(REFRESH), _target(tag, ADDRESS))
    # Written out so that the expressions below refer to a column, not to copies of these patterns.
    found = materialize(html.select("url", base.alias("base"), F.explode("tags").alias("tag")).select("url", "base", to.alias("to")), "links").where("to is not null")
    origin = F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))
    found = materialize(found.select("url", origin.alias("origin"), "to"), "links")
    return materialize(found.select(F.col("url").alias("src"), resolved(F.col("origin"), F.col("to")).alias("dst")), "links").where("dst is not null")


def _best_literal(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (rule, verdict): the first that fits of an array sorted by length."""
    longest = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow"), reverse=True)
    table = F.array(*[F.struct(F.lit(n).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for n, p, v in longest])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.transform(fits, lambda r: F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))


def _judge(pages: DataFrame, rules) -> DataFrame:
    """Add best (rule, verdict), null where no rule fits. Of equally long rules allow wins."""
    if isinstance(rules, DataFrame):
        # Hosts are distinct before their suffixes meet the rules, so a host with a third of all pages is one row.
        hosts = pages.select("host").distinct()
        labels = F.split("host", "\\.")
        suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
        fitting = suffixes.join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict"), "suffix")
        fitting = fitting.groupBy("host").agg(F.collect_set(F.struct("suffix", "prefix", "verdict")).alias("rules"))
        best = F.array_max(F.transform(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])), lambda r: F.struct((F.length(r["suffix"]) + F.length(r["prefix"])).alias("n"), (r["verdict"] == "allow").alias("a"), F.concat(r["suffix"], r["prefix"]).alias("rule"), r["verdict"].alias("verdict"))))
        return pages.join(fitting, "host", "left").withColumn("best", best).withColumn("best", F.when(F.col("best").isNotNull(), F.struct("best.rule", "best.verdict"))).drop("rules")
    return pages.withColumn("best", F.get(_best_literal(F.col("host"), F.col("path"), rules), F.lit(0)))


def filter_urls(pages: DataFrame, rules=RULES, links: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component.

    rules: (host, path, verdict) tuples, or a DataFrame of those columns for long lists. links: further (src, dst)
    addresses, such as a crawl's redirect log; the pages' own canonical and refresh links are always used.
    A page that no rule fits and no alias decides is allowed. Null urls have empty host and path and no alias.
    Repeated rows give repeated rows; an empty table gives none; extra columns are ignored.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > LITERAL_RULES:
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    judged = _judge(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    judged = judged.withColumn("node", normal_form(F.col("url")))
    found = page_links(pages) if "html" in pages.columns else None
    edges = [x for x in (found, links) if x is not None]
    joined, ends = None, None
    for x in edges:
        both = x.select(F.explode(F.array("src", "dst")).alias("url"))
        ends = both if ends is None else ends.union(both)
        part = x.select(normal_form(F.col("src")).alias("src"), normal_form(F.col("dst")).alias("dst"))
        joined = part if joined is None else joined.union(part)
    light = materialize(judged.select("page_id", "host", "path", "best", "node"), "judged")
    if joined is not None:
        labels = connected_components(materialize(joined, "aliases"), small=0)
        light = light.join(labels, light["node"] == labels["node"], "left").select(light["*"], F.coalesce("component", light["node"]).alias("component"))
    else:
        light = light.withColumn("component", F.col("node"))
    said = light.where("best is not null and component is not null").select("component", "best.verdict")
    if joined is not None:
        # Addresses that are only linked to, without a page of their own, are members with a decision too.
        named = _judge(ends.where("url is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct(), rules)
        named = named.where("best is not null").select(normal_form(F.col("url")).alias("node"), "best.verdict")
        named = named.where("node is not null").join(labels, "node", "left").select(F.coalesce("component", "node").alias("component"), "verdict")
        said = said.union(named)
    spread = said.groupBy("component").agg(F.min("verdict").alias("inherited"))
    # 'allow' sorts before 'block': an explicit allow in the component wins.
    out = light.join(spread, "component", "left")
    verdict = F.coalesce("best.verdict", "inherited", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "component")
