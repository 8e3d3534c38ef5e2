"""Column macros over urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that are never documents, and those that are single pages.
SKIPPED_PATHS = (
    "/subscribe", "/donate", "/2025-fundraiser", "/privacy-policy", "/support", "/newsletter", "/contact",
    "/careers/expression-of-interest", "/careers/expression-of-interest-power-concentration",
)
PAGE_PATHS = ("/", "/about", "/careers", "/research")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def category(url: Column, hosts: list[str]) -> Column:
    """research, people or pages for a document's url on one of the site's hosts; else null."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    return (
        F.when(~host(url).isin(hosts), F.lit(None).cast("string"))
        .when(p.startswith("/research/"), "research").when(p.startswith("/people/"), "people")
        .when(p.isin(*SKIPPED_PATHS), None).when(p.isin(*PAGE_PATHS), "pages")
    )


def slug(url: Column) -> Column:
    """The path's segments joined by two underscores; ``home`` for the root."""
    bare = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(bare == "", "home").otherwise(F.replace(bare, F.lit("/"), F.lit("__")))


def route(url: Column, hosts: list[str]) -> Column:
    """(category, slug, path) of the reader's page for a url of the site; null for others."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    first, second = F.get(parts, 0), F.get(parts, 1)
    named = first.isin("research", "people") & second.isNotNull()
    kind = F.when(F.size(parts) == 0, "pages").when(named, first).when(F.size(parts) == 1, "pages")
    name = F.when(F.size(parts) == 0, "index").when(named, second).when(F.size(parts) == 1, first)
    made = F.struct(kind.alias("category"), name.alias("slug"), F.concat(F.lit("/article/"), kind, F.lit("/"), name).alias("path"))
    return F.when(host(url).isin(hosts) & kind.isNotNull(), made)


def lookup_key(url: Column) -> Column:
    """The url without blanks, closing slashes and fragment; case and query stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), "#.*$", ""), "/+$", "")


def recall_key(url: Column) -> Column:
    """Authority and path in lower case, without closing slashes; scheme, query and fragment go."""
    return F.lower(F.concat(authority(url), F.regexp_replace(path(url), "/+$", "")))


def fragment_encoded(text: Column) -> Column:
    """Percent-encoded for a text fragment: as in a url's component, with hyphens encoded as well."""
    made = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%27", "'"), ("-", "%2D")):
        made = F.replace(made, F.lit(found), F.lit(wanted))
    return made


def cite_parameter(text: Column) -> Column:
    """``?cite=`` and up to 240 characters of the collapsed text; null under 8 characters."""
    flat = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 240)
    return F.when(F.length(flat) >= 8, F.concat(F.lit("?cite="), F.replace(fragment_encoded(flat), F.lit("%2D"), F.lit("-"))))
