"""Links and sites."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .chars import let, text_or_empty

# Addresses of the one known kind of site.
KNOWN_SITES = (r"ccgp\.gov\.cn", r"ccgp-.*\.gov\.cn")
SITE_KIND = "ccgp"


def site_type(url: Column, default: str = SITE_KIND) -> Column:
    """Parser family for a page; unknown sites fall to the default kind."""
    return (F.when(text_or_empty(url).rlike("|".join(KNOWN_SITES)), F.lit(SITE_KIND))
            .otherwise(F.lit(default)))


def host_of(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def fold(parts: Column) -> Column:
        kept = F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts) - 1), F.array().cast("array<string>"),
            lambda acc, s: (F.when(s == "..", F.slice(acc, F.lit(1),
                                                      F.greatest(F.size(acc) - 1, F.lit(0))))
                            .when(s == ".", acc)
                            .otherwise(F.array_append(acc, s))))
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        # A path that ends in a dot segment names a folder.
        return F.when(F.element_at(parts, -1).isin(".", "..") & ~joined.endswith("/"),
                      F.concat(joined, F.lit("/"))).otherwise(joined)

    return F.when(path.contains("/."), let(F.split(path, "/"), fold)).otherwise(path)


_URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_parts(url: Column) -> Column:
    """struct(scheme, host, path, query) of an absolute URL."""
    return F.struct(*[F.regexp_extract(text_or_empty(url), _URL, i).alias(name)
                      for i, name in enumerate(("scheme", "host", "path", "query"), start=1)])


def _join(b: Column, href: Column) -> Column:
    root = F.concat(b["scheme"], F.lit("://"), b["host"])
    folder = F.when(b["path"] == "", F.lit("/")).otherwise(
        F.regexp_extract(b["path"], r"^(.*/)", 1))
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (F.when(href == "", F.concat(root, b["path"], b["query"]))
            .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
            .when(href.startswith("#"), F.concat(root, b["path"], b["query"], href))
            .when(href.startswith("?"), F.concat(root, b["path"], href))
            .when(href.startswith("/"), F.concat(root, _without_dots(path), rest))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest)))


def join_url(base_parts: Column, href: Column) -> Column:
    """Relative reference against the parts of an absolute base (RFC 3986, section 5)."""
    return let(F.struct(base_parts.alias("b"), href.alias("h")),
               lambda v: _join(v["b"], v["h"]))


def absolute_url(href: Column, base_parts: Column) -> Column:
    """Absolute link on the same host; null for an empty link or another host."""
    def resolve(v: Column) -> Column:
        host = F.regexp_extract(v["link"], r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
        return F.when((host == "") | (host == v["b"]["host"]), v["link"])

    return (F.when(text_or_empty(href) == "", F.lit(None).cast("string"))
            .when(href.startswith("http"), href)
            .otherwise(let(F.struct(join_url(base_parts, href).alias("link"),
                                    base_parts.alias("b")), resolve)))
