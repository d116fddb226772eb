"""URL filters: host and path rules, spread over redirect and canonical-link aliases.

Rules are joined by host suffix and the longest that fits decides. Urls joined by redirects or
canonical links are one component; there a block decided by a rule reaches every alias that
no rule decides, unless a rule allows one of the aliases: allow goes first. DataFrame functions
only; components are found by distributed star rounds over the linked urls alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from .common import free_name, written
from .components import connected_components

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Fixed values of HTML: what holds no tags, tags with an address (a quoted ``>`` is no end), and
# attributes with a value. Loops are possessive, so tags may have any length.
NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
TAG = r"""(?i)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""([^\s"'>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFRESH = r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?\s*([^\"'\s]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _AZ, _az)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^(.*?)://", 1))


def _site_of(url: Column) -> Column:
    """The host without the port that its scheme implies."""
    port = F.when(scheme_of(url) == "http", ":80").when(scheme_of(url) == "https", ":443")
    host = host_of(url)
    return F.when(host.endswith(port), F.substr(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)


def node_of(url: Column) -> Column:
    """What stands for a url in the graph: host, path and query; the scheme, its own port and the
    fragment go. Null where there is no ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(_site_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its segments ``.`` and ``..``."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    none = F.expr("cast(array() as array<string>)")
    step = lambda a, x: (
        F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    )
    walked = F.aggregate(parts, none, step)
    walked = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def place_of(url: Column) -> Column:
    """What addresses are resolved against: scheme, host without its scheme's port, and path."""
    return F.struct(scheme_of(url).alias("scheme"), _site_of(url).alias("site"), path_of(url).alias("path"))


def resolved_node(place: Column, target: Column) -> Column:
    """The node of an address, resolved against a place; null for an address that is blank, a
    fragment or of a scheme without ``://``."""
    site, path = place["site"], F.regexp_extract(target, "^([^?#]*)", 1)
    query = F.regexp_extract(target, "^[^?#]*([^#]*)", 1)
    folder = F.regexp_replace(place["path"], r"(?s)[^/]*\z", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    walked = F.when(target.startswith("/"), path).otherwise(F.concat(folder, path))
    absolute = F.when(target.startswith("//"), F.concat(place["scheme"], F.lit(":"), target)).otherwise(target)
    return (
        F.when(target.rlike("^(?:$|#)"), None)
        .when(target.rlike("(?i)^(?:[a-z][a-z0-9+.-]*:)?//"), rx.let(absolute, node_of))
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(target.startswith("?"), F.concat(site, place["path"], query))
        .otherwise(F.concat(site, rx.let(walked, _without_dots), query))
    )


def decoded(text: Column) -> Column:
    """A text with its character references as characters; those of no character stay."""
    return rx.let(text, lambda t: F.when(t.rlike(ENTITY), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    named = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (f"&{k};", v)])

    def numbered(e: Column) -> Column:
        digits = F.regexp_extract(e, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        return F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")

    def one(e: Column) -> Column:
        valid = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        character = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(e)
        return F.when(e.startswith("&#"), rx.let(numbered(e), character)).otherwise(F.try_element_at(named, e))

    parts, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.array_join(F.zip_with(parts, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, without quotes and outer spaces."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    at = (F.array_position(names, name) - 1).cast("int")
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), at)
    return F.regexp_replace(decoded(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")), r"^\s+|\s+$", "")


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes joined by a canonical link or a meta refresh.

    Tags in comments and scripts don't count, character references in addresses are decoded, and
    relative addresses are resolved against the page's first ``base`` with an address, or else
    its url.
    """
    page, text, tag = F.col(f"`{url}`"), F.col(f"`{html}`"), F.col("tag")
    tags = F.regexp_extract_all(F.regexp_replace(text, NO_TAGS, ""), F.lit(TAG), F.lit(0))
    is_link, is_meta = tag.rlike("(?i)^<link"), tag.rlike("(?i)^<meta")
    canonical = is_link & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = is_meta & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    target = F.when(canonical, _attribute(tag, "href")).when(refresh, F.regexp_extract(_attribute(tag, "content"), REFRESH, 1))
    ground = F.get(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b.*\bhref\s*=")), F.lit(0))
    place = F.col("place")
    based = rx.let(_attribute(ground, "href"), lambda h: F.concat(place["scheme"], F.lit("://"), resolved_node(place, h)))
    stated = F.filter(F.array(target), lambda t: t.isNotNull())
    return (
        pages.where(page.contains("://") & text.rlike("(?i)canonical|http-equiv"))
        .select(node_of(page).alias("a"), place_of(page).alias("place"), tags.alias("tags"))
        .select("a", "place", F.when(ground.isNotNull(), based).alias("based"), F.explode("tags").alias("tag"))
        .select("a", F.when(F.col("based").isNull(), place).otherwise(rx.let(F.col("based"), place_of)).alias("place"), F.explode(stated).alias("target"))
        # exploded, so that the address is not resolved once more for each condition on it
        .select("a", F.explode(F.array(resolved_node(F.col("place"), F.col("target")))).alias("b"))
        .where("a != b")
    )


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decision) of those places that a rule fits; the longest wins.

    Of rules of equal length that with the longer host wins, of equal rules allow. Hosts are
    walked label by label and paths at the lengths of their suffix's rules, so each place meets
    only rules that fit it, however many a host has.
    """
    known = rules.select(
        F.lower("host").alias("suffix"),
        F.coalesce("path", F.lit("/")).alias("prefix"),
        F.col("verdict").alias("decision"),
    ).where(F.col("suffix").isNotNull() & F.col("decision").isin("allow", "block"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    lengths = known.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    fits = (
        places.where("host != ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(lengths, "suffix")
        .select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
        .withColumn("prefix", F.substr("path", F.lit(1), F.col("n")))
        .join(known, ["suffix", "prefix"])
        .withColumn("rule", F.concat("suffix", "prefix"))
    )
    best = F.max(
        F.struct(F.length("rule").alias("n"), F.length("suffix").alias("m"), (F.col("decision") == "allow").alias("allow"), "rule")
    )
    return (
        fits.groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("decision"))
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    links: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of every row with host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block); ``links`` has url pairs a, b of
    redirects known beforehand, beside those read from ``html``. A page that a rule fits takes
    its verdict. Any other page is blocked if a rule blocks one of its aliases (pages or linked
    urls) and no rule allows one, else allowed. Null urls and urls without ``://`` have empty
    host and path, no rule and no aliases; repeated rows come back repeated; empty tables are
    allowed; result columns whose name is taken get underscores in front.
    """
    keep = pages.columns if keep is None else keep
    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    out = {n: free_name(kept, n) for n in ("host", "path", "rule", "verdict")}
    page = F.col(f"`{url}`")
    edges = []
    if html is not None:
        edges.append(links_of(pages, url, html))
    if links is not None:
        edges.append(links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"),
        host_of(page).alias("host"),
        path_of(page).alias("path"),
        node_of(page).alias("node"),
    )
    decided = match_rules(rows.select("host", "path").distinct(), rules)
    rows = rows.join(decided, ["host", "path"], "left")
    if edges:
        every = edges[0]
        for e in edges[1:]:
            every = every.unionByName(e)
        alias = connected_components(every)
        nodes = alias.withColumns(
            {
                "host": F.regexp_extract("node", "(?s)^([^/?#]*)", 1),
                "path": F.regexp_extract("node", "(?s)^[^/?#]*([^?#]*)", 1),
            }
        )
        ruled = nodes.join(match_rules(nodes.select("host", "path").distinct(), rules), ["host", "path"])
        blocked = (
            ruled.groupBy("component")
            .agg(F.bool_or(F.col("decision") == "block").alias("some"), F.bool_or(F.col("decision") == "allow").alias("none"))
            .where("some and not none")
            .select("component")
        )
        reached = written(alias.join(blocked, "component").select("node", F.lit("block").alias("spread")), "blocked-aliases")
        rows = rows.join(reached, "node", "left")
    else:
        rows = rows.withColumn("spread", F.lit(None).cast("string"))
    return rows.select(
        "kept_columns.*",
        F.col("host").alias(out["host"]),
        F.col("path").alias(out["path"]),
        F.col("rule").alias(out["rule"]),
        F.coalesce("decision", "spread", F.lit("allow")).alias(out["verdict"]),
    )
