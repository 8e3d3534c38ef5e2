"""Column macros over text and markdown. All are built-in expressions; none needs Python in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of queries, and the query words that ask for people.
STOPWORDS = (
    "a an and are as at be but by for from has have he her him his i if in into is it its of on or our she that the their them they "
    "this to was we were what when which who why will with you your"
).split()
PERSON_TERMS = (
    "who researcher researchers fellow fellows team people staff author authors scholar scholars director leadership founder founders"
).split()
# Names of sections that list references.
REFERENCE_SECTIONS = ("references", "bibliography", "works cited", "further reading")

# Fixed value: a mark of sources in an answer.
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def _each(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def tokenize(text: Column) -> Column:
    """Lower-case words of 2 to 39 characters out of a-z, 0-9, hyphen and apostrophe."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-']", " "), r"\s+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & (F.length(t) < 40))


def query_terms(text: Column) -> Column:
    """Distinct tokens without stop words, in the order of their first place."""
    return F.array_except(tokenize(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markdown(text: Column) -> Column:
    """Plain words of markdown: code and images go, links leave their labels, marks become spaces."""
    # The patterns and their order.
    return collapse(
        _each(
            text, ("(?s)```.*?```", " "), (r"`[^`\n]+`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[\^[^\]]+\]", ""), ("[#>*_~]", " ")
        )
    )


def clean_markdown(text: Column) -> Column:
    """Markdown without inline directives, with plain newlines and spaces and at most one blank line."""
    # The patterns and their order.
    made = _each(text, (r":inline-(?:graphic|quote)\{[^}]*\}", ""), (r"(?m)^[ \t]+$", ""), ("\u00a0", " "), ("\r\n", "\n"), (r"\n{3,}", "\n\n"))
    return F.regexp_replace(made, r"^\s+|\s+$", "")


# The patterns of a preview, in their order, and what stands for them.
PREVIEW = (
    ("(?s)```.*?```", ""), (r"\[\^[^\]]+\]:?", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"!\[[^\n\]]*\]?(?:\([^\n)]*\)?)?", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}>+\s?", ""), (r"(?m)^\s*[-*_]{3,}\s*$", ""),
    (r"(?m)^\s*\|?[\s:-]+\|[\s:|-]*$", ""), (r"(?m)^\s*\|", ""), (r"(?m)\|\s*$", ""), (r"\s*\|\s*", " "),
    (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), ("~~(.*?)~~", "$1"), ("`([^`]+)`", "$1"), (r"\\([\-_*\[\]()`~#+.!])", "$1"),
)


def clean_snippet(text: Column) -> Column:
    """A preview without markdown, for snippets that may end within an image or a link."""
    return F.coalesce(collapse(_each(text, *PREVIEW)), F.lit(""))


def snippet(text: Column, most: int = 280, slack: int = 80) -> Column:
    """Up to ``most`` characters, or to the end of the last sentence that ends within ``slack`` of it."""
    flat = collapse(text)
    window = F.substring(flat, 1, most + slack)
    # Characters before the last ". " of the window, or -1.
    last = F.length(window) - F.instr(F.reverse(window), " .") - 1
    last = F.when(F.instr(F.reverse(window), " .") > 0, last).otherwise(-1)
    ends_well = (last > most - slack) & (last < most + slack)
    return (
        F.when(F.length(flat) <= most, flat).when(ends_well, F.substring(window, F.lit(1), (last + 1).cast("int"))).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))
    )


def sentences(text: Column) -> Column:
    """Sentences, parted by white space after . ! or ?; blank ones left out."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def markers_in(text: Column) -> Column:
    """Numbers of all citation marks like [3] or [1, 6], in order, repeats kept."""
    groups = F.regexp_extract_all(text, F.lit(MARKER), 1)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.try_cast("int"))


def strip_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*" + MARKER, ""))


def truncated(text: Column, most: int) -> Column:
    """The text, or its first ``most`` - 1 characters and three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("...")))


def looks_like_references(text: Column, section: Column) -> Column:
    """A list of references: by the section's name, or by three footnote marks, four urls or three academic words."""
    named = F.coalesce(F.lower(section), F.lit(""))
    by_name = named.contains(REFERENCE_SECTIONS[0])
    for name in REFERENCE_SECTIONS[1:]:
        by_name = by_name | named.contains(name)
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern))
    # The patterns and how often each must occur.
    return (
        by_name | (counted(r"\[\^[\w-]+\]") >= 3) | (counted(r"https?://\S+") >= 4) | (counted(r"(?i)arxiv|doi|forum\.effectivealtruism|lesswrong") >= 3)
    )


def strip_code_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block; other texts trimmed."""
    bare = F.trim(text)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^```[A-Za-z]*\s*\n?", ""), r"\n?\s*```$", ""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def iso_date(text: Column) -> Column:
    """A leading YYYY-MM-DD, or null."""
    return F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def month_year(text: Column) -> Column:
    """Like ``Mar 2024``; null where the text is no date."""
    return F.date_format(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), "MMM yyyy")


def percent_shifted(text: Column, shift: int = 37) -> Column:
    """The first ``N%`` changed to another percentage, for answers that must be wrong."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)?)%", 1)
    value = found.try_cast("double")
    moved = F.pmod(value + shift, F.lit(95.0)).cast("int")
    moved = F.when(moved == value.cast("int"), moved + 7).otherwise(moved)
    moved = F.when(moved == 0, 13).otherwise(moved)
    at = F.regexp_instr(text, F.lit(r"\d+(?:\.\d+)?%"))
    whole = F.concat(F.substring(text, F.lit(1), at - 1), moved.cast("string"), F.substring(text, at + F.length(found), F.length(text)))
    return F.when(found != "", whole).otherwise(text)


def likely_abstract(text: Column) -> Column:
    """Whether a raw chunk is the abstract (its mark in the first 150 characters), or a first-level heading with under 40 characters after it."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^#\s+[^\n]*\n+", ""), r"^\s+|\s+$", "")
    return F.coalesce(F.substring(text, 1, 150).contains("**Abstract.**") | (bare.rlike(r"^#\s+\S") & (F.length(rest) < 40)), F.lit(False))
