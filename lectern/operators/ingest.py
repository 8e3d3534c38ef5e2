"""Documents from pages: embedded JSON, meta tags, and records of the site's content types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_markdown, iso_date, strip_markdown, word_count
from ..functions.urls import slug

NAMED = "array<struct<name:string,slug:string,role:string>>"


def embedded_json(html: Column) -> Column:
    """The JSON in a page's data script; null where it is missing or broken."""
    inner = F.nullif(F.trim(F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)), F.lit(""))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


#: A quoted or bare value of an attribute.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# The named characters that titles and descriptions have.
NAMED_CHARACTERS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&mdash;": "\u2014", "&ndash;": "\u2013", "&hellip;": "\u2026", "&lsquo;": "\u2018", "&rsquo;": "\u2019", "&ldquo;": "\u201c", "&rdquo;": "\u201d", "&middot;": "\u00b7", "&copy;": "\u00a9"}


def decoded(text: Column) -> Column:
    """Text with character references decoded: the named ones above, decimal and hexadecimal ones; &amp; comes last, so that none is decoded twice."""
    for name, char in NAMED_CHARACTERS.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    parts = F.split(F.regexp_replace(text, r"(&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});)", "\u001f$1\u001f"), "\u001f")

    def char(p: Column) -> Column:
        number = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(p, "([0-9]+);$", 1)).cast("int")
        # Code points as UTF-32 bytes.
        sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")

    made = F.transform(parts, lambda p: F.when(p.rlike(r"^&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});$"), char(p)).otherwise(p))
    return F.replace(F.array_join(made, ""), F.lit("&amp;"), F.lit("&"))


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """The decoded content of the first meta tag with the attribute, in whatever order, case and quotes it has them; empty if it is empty, null if the tag is missing."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), 0)
    named = rf"""(?is)[\s"']{attribute}\s*=\s*["']?{name}["'\s/>]"""
    tag = F.get(F.filter(tags, lambda t: t.rlike(named) & t.rlike(r"(?is)[\s\"']content\s*=")), 0)
    inner = lambda k: F.regexp_extract(tag, rf"""(?is)[\s"']content\s*=\s*{VALUE}""", k)
    return decoded(F.concat(inner(1), inner(2), inner(3)))


def page_meta(html: Column) -> Column:
    """(title, description, heading): the page's titles by tag; a description falls back only where its tag is missing."""
    og = meta_content(html, "property", "og:title")
    inside = lambda tag: decoded(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    described = F.coalesce(meta_content(html, "property", "og:description"), meta_content(html, "name", "description"), F.lit(""))
    return F.struct(F.coalesce(og, inside("title")).alias("title"), described.alias("description"), inside("h1").alias("heading"))


def section_bodies(sections: Column) -> Column:
    """Bodies, introductions and texts of sections (array of structs), trimmed, joined by blank lines."""
    parts = F.flatten(F.transform(sections, lambda s: F.array(s["body"], s["intro"], s["text"])))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), "\n\n")


def author_refs(authors: Column) -> Column:
    """Authors with a name, trimmed."""
    return F.filter(F.transform(authors, lambda a: a.withField("name", F.trim(a["name"]))), lambda a: a["name"].isNotNull() & (a["name"] != ""))


def topic_names(topics: Column) -> Column:
    """Distinct trimmed topic names in their first order."""
    return F.array_distinct(F.filter(F.transform(topics, lambda x: F.trim(x)), lambda t: t.isNotNull() & (t != "")))


def series_of(series: Column) -> Column:
    """(title, parts, current): parts with a slug and a title; current is the place, from 0, of the last part marked so in the raw list."""
    parts = F.filter(series["parts"], lambda p: p["slug"].isNotNull() & p["title"].isNotNull())
    marked = F.filter(F.transform(series["parts"], lambda p, i: F.when(p["isCurrent"], i)), lambda i: i.isNotNull())
    current = F.when(F.size(marked) > 0, F.array_max(marked)).otherwise(series["nav"]["currentIndex"] - 1)
    return F.when(
        series["name"].isNotNull(), F.struct(series["name"].alias("title"), F.size(parts).alias("totalParts"), current.cast("int").alias("currentIndex"), F.transform(parts, lambda p: F.struct(p["slug"], p["title"])).alias("parts"))
    )


PAGE_PROPS = (
    "struct<props:struct<pageProps:struct<page:struct<title:string,description:string,body:string,publishedAt:string,"
    f"authors:{NAMED},topics:array<string>,sections:array<struct<body:string,intro:string,text:string>>,"
    "series:struct<name:string,parts:array<struct<slug:string,title:string,isCurrent:boolean>>,nav:struct<currentIndex:int>>>>>>"
)


def records(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Typed documents of pages with embedded JSON: one row a page whose JSON has a title."""
    read = pages.select(id_col, "url", F.from_json(embedded_json(F.col("html")), PAGE_PROPS)["props"]["pageProps"]["page"].alias("p"))
    body = clean_markdown(F.concat_ws("\n\n", F.nullif(F.trim("p.body"), F.lit("")), F.nullif(section_bodies(F.col("p.sections")), F.lit(""))))
    made = read.where(F.trim("p.title") != "").select(
        id_col, "url", F.trim("p.title").alias("title"), F.coalesce("p.description", F.lit("")).alias("description"), author_refs(F.col("p.authors")).alias("authors"),
        topic_names(F.col("p.topics")).alias("topics"), iso_date(F.col("p.publishedAt")).alias("publishedAt"), series_of(F.col("p.series")).alias("series"), body.alias("body"),
    )
    return made.withColumn("text", strip_markdown(F.col("body"))).withColumn("wordCount", word_count(F.col("text")))


PAGE_FIELDS = "struct<props:struct<pageProps:struct<page:struct<fields:struct<title:string,slug:string,sections:array<struct<body:string,intro:string,text:string>>>>>>>"


def page_records(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Records of plain pages: those whose data have fields. The body is the title as a heading, and the sections.

    Titles fall back to the page's own, descriptions to the first 240 characters of the text; a slug to
    the url's.
    """
    f = F.col("f")
    read = pages.select(id_col, "url", page_meta(F.col("html")).alias("m"), meta_content(F.col("html"), "property", "og:description").alias("d"), F.from_json(embedded_json(F.col("html")), PAGE_FIELDS)["props"]["pageProps"]["page"]["fields"].alias("f"))
    title = F.coalesce(F.trim(f["title"]), F.lit(""))
    body = clean_markdown(F.concat_ws("\n\n", F.when(title != "", F.concat(F.lit("# "), title)), F.nullif(section_bodies(f["sections"]), F.lit(""))))
    made = read.where(f.isNotNull()).select(id_col, "url", F.coalesce(f["slug"], slug(F.col("url"))).alias("slug"), F.coalesce(F.nullif(title, F.lit("")), F.col("m.title")).alias("title"), "d", body.alias("body"))
    made = made.withColumn("text", strip_markdown(F.col("body")))
    return made.select(id_col, "url", F.lit("pages").alias("category"), "slug", "title", F.coalesce(F.nullif("d", F.lit("")), F.substring("text", 1, 240)).alias("description"), "body", "text", word_count(F.col("text")).alias("wordCount"))
