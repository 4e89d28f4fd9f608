"""URL filters with redirect equivalence, in DataFrame operations only.

Explicit rules on host and path decide first.  The others take the decision of
their aliases: urls that redirect to each other, or name the same canonical
url, are one component, found by distributed connected components; one
explicit allow in it allows, else one explicit block blocks, else the default holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change what a url shows. Fixed values.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def identity_of(url: Column) -> Column:
    """A name shared by spellings of one url: no scheme, fragment, tracking parameters or final slash. Null if there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(" + "|".join(TRACKING) + ")(=|$)"))
    tail = F.array_join(F.array_sort(kept), "&")
    base = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) != "", F.when(tail != "", F.concat(base, F.lit("?"), tail)).otherwise(base))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits, as struct(rule, verdict); allow before block among equals."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    out = None
    for verdict, rule_host, rule_path in order:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    if out is None:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    return out.otherwise(F.lit(None).cast("struct<rule: string, verdict: string>"))


_NAMED = {"amp": "&", "AMP": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "equals": "=", "num": "#", "percnt": "%", "lowbar": "_", "plus": "+", "comma": ",", "semi": ";"}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; written out, nested uses of it would multiply the plan."""
    return F.transform(F.array(value), f)[0]


def _decoded(value: Column) -> Column:
    """An attribute's value without character references: any by number, and the names of letters that urls are made of."""
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        name = names[F.regexp_extract(piece, "^&([A-Za-z]+);$", 1)]
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+);?$", 1)
        code = F.when(piece.rlike("^&#[xX]"), digits).when(digits != "", F.conv(digits, 10, 16))
        number = F.conv(code, 16, 10).cast("long")
        letter = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(piece.startswith("&#") & letter, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(F.coalesce(name, piece))

    pieces = lambda v: F.regexp_extract_all(v, F.lit("[^&]+|&#[xX][0-9a-fA-F]{1,6};?|&#[0-9]{1,7};?|&[A-Za-z]+;|&"), F.lit(0))
    return _let(value, lambda v: F.when(v.contains("&"), F.array_join(F.transform(pieces(v), one), "")).otherwise(v))


def _attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's attribute, empty if there is none."""
    found = rf"""(?is)(?<=[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>]+))"""
    return F.trim(_decoded(F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)])))


def targets_of(html: Column) -> Column:
    """Urls that a page names as its canonical one or redirects to, as they are written there."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = lambda t: F.array_contains(F.split(_ascii_lower(_attribute(t, "rel")), r"\s+"), "canonical")
    link = F.transform(F.filter(tags, canonical), lambda t: _attribute(t, "href"))

    def refresh(t: Column) -> Column:
        url = F.regexp_extract(_attribute(t, "content"), r"""(?is)^[\s\d.]*(?:[;,]\s*(?:url\s*=\s*)?|url\s*=\s*)["']?([^"']*)""", 1)
        return F.when(url != "", F.trim(url)).otherwise(_decoded(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)))

    meta = F.transform(F.filter(tags, lambda t: _ascii_lower(_attribute(t, "http-equiv")) == "refresh"), refresh)
    return F.filter(F.concat(link, meta), lambda x: x != "")


def base_of(url: Column, html: Column) -> Column:
    """What a page's relative targets are resolved against: its first ``<base href>``, seen from its url, else its url."""
    named = _attribute(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0), "href")
    return _let(named, lambda x: F.coalesce(F.when(x != "", resolved(url, x)), url))


def _without_dots(path: Column) -> Column:
    """``path``, which starts with a slash, without ``.`` and ``..``."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as an absolute url seen from ``url``, by the rules of RFC 3986; null for other schemes and for the page itself."""
    return _let(url, lambda u: _let(target, lambda t: _resolved(u, t)))


def _resolved(url: Column, target: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _let(path, _without_dots), rest))
        .when(path == "", F.concat(root, path_of(url), rest))
        .otherwise(F.concat(root, _let(F.concat(folder, path), _without_dots), rest))
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for every row of ``pages``.

    ``rules`` are (verdict, host, path), a short list that becomes part of the
    plan; a rule fits its host and all subdomains where the path starts with
    its own, and the longest wins.  ``redirects`` (from_url, to_url) adds known
    redirects to the links found in ``html``; their ends are decided like
    pages, whether or not they are pages.  alias_of is the least spelling of
    the url's component.

    Null urls and urls without ``://`` have empty host and path, no rule and
    no aliases, and get ``default``.  Repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored.

    Hot targets are no problem: a component takes one minimum, and decisions
    are one partially aggregated row for each component.  Pages without links
    only meet the others in joins by their url's name, which adaptive
    execution splits where many share it.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), targets_of(F.col(html_col)).alias("targets"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url), "name": identity_of(url)})
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    named = rows.select("page_id", "host", "path", "name", "fit")

    ends = rows.where(F.size("targets") > 0).select("url", base_of(url, F.col("html")).alias("base"), F.explode("targets").alias("target")).select("url", resolved(F.col("base"), F.col("target")).alias("to"))
    if redirects is not None:
        ends = ends.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to")))
    edges = ends.select(identity_of(url).alias("u"), identity_of(F.col("to")).alias("v")).where("u is not null and v is not null")
    family = components(edges)

    # an alias that is no page still has the rules' decision
    far = ends.select(F.explode(F.array("url", "to")).alias("url")).where("url is not null")
    far = far.select(identity_of(url).alias("name"), fitting_rule(host_of(url), path_of(url), rules)["verdict"].alias("verdict"))
    said = named.select("name", F.col("fit.verdict").alias("verdict")).unionByName(far).where("name is not null and verdict is not null").distinct()
    voted = said.join(family.withColumnRenamed("node", "name"), "name", "left").groupBy(F.coalesce("component", "name").alias("component")).agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    found = named.join(family.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    judged = found.join(voted, "component", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block"), F.lit(default))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("component").alias("alias_of"))
