"""Text expressions: case folding, terms, counts and normal forms, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no coverage.
COVERAGE_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "was", "were", "what", "which", "with",
)
FEATURE_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "what", "which", "with",
)
HEADER_STOPWORDS = ("and", "the", "for", "with", "from")
# Characters that quotes may spell in more than one way.
DASHES = "‐‑‒–—―−"
APOSTROPHES = "‘’‚‛′ʼ"
QUOTATIONS = "“”„‟″"
SPACES = "       "
INVISIBLES = "​‌‍﻿­"
#: Space separators: what trimming takes off.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def fold(text: Column) -> Column:
    """Case folding: lower case, and sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def terms(text: Column) -> Column:
    """Word terms of folded text, in order, with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(r"(?U)\w+"), F.lit(0))


def dotted_terms(text: Column) -> Column:
    """Terms that may hold dots and dashes after their first character."""
    return F.regexp_extract_all(fold(text), F.lit(r"(?U)\w[\w.-]*"), F.lit(0))


def coverage_terms(text: Column, stopwords: tuple[str, ...] = COVERAGE_STOPWORDS) -> Column:
    return F.array_except(F.array_distinct(dotted_terms(text)), F.array(*[F.lit(w) for w in stopwords]))


def word_count(text: Column) -> Column:
    """Tokens of the built-in counter: runs of what isn't white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("long")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trimmed(text: Column) -> Column:
    """text without space separators at its ends. One argument: where a function of an array's elements takes two, the second is a place."""
    return F.btrim(text, F.lit(BLANKS))


def normal(text: Column) -> Column:
    """White space collapsed, folded: two texts are the same if this is."""
    return collapsed(fold(text))


def quote_normal(text: Column) -> Column:
    """The form in which quotes are looked for: one spelling for dashes, apostrophes, quotation marks and spaces; no invisible characters."""
    text = F.replace(text, F.lit("…"), F.lit("..."))
    one = DASHES + APOSTROPHES + QUOTATIONS + SPACES
    text = F.translate(text, one + INVISIBLES, "-" * len(DASHES) + "'" * len(APOSTROPHES) + '"' * len(QUOTATIONS) + " " * len(SPACES))
    return normal(text)


def fragments(quote: Column) -> Column:
    """Parts of a normalised quote between elision marks."""
    return F.filter(F.transform(F.split(quote, r"\s*\.\s*\.\s*\.\s*"), trimmed), lambda x: x != "")


def quote_found(quote: Column, context: Column) -> Column:
    """Whether a normalised quote is in a normalised context: contiguous, or its fragments in order if it has elision marks."""
    step = lambda at, part: F.when(at == 0, F.lit(0)).otherwise(
        F.when(F.position(part, context, at) > 0, F.position(part, context, at) + F.length(part)).otherwise(F.lit(0))
    )
    parts = fragments(quote)
    return F.when(~quote.rlike(r"\.\s*\.\s*\."), F.contains(context, quote)).otherwise((F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_html(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def identity(*parts: Column) -> Column:
    """Content address: SHA-256 over parts joined by NUL, the first of which names the kind."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)
