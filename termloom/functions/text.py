"""Column expressions for markup removal, tokens and text normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.stopwords import ENGLISH

# Markup patterns and their replacements, applied from top to bottom.
MARKUP_RULES = (
    (r"(?is)<ref[^>]*?>.*?</ref>", " "),
    (r"(?s)\{\{.*?\}\}", " "),
    (r"(?s)<[^>]+>", " "),
    (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", " "),
    (r"https?://\S+", " "),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"[_\[\]]", " "),
    (r"\s+", " "),
)

# White space as Python's str methods understand it, wider than Java's \s.
WIDE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# One link, its text after the first pipe in group 1, or without a pipe in group 2.
LINK = r"\[\[(?:[^|\]]*\|([^\]]*)|([^|\]]+))\]\]"
# The first-generation order of the rules. Links collapse before tags and URLs go.
MARKUP_RULES_V1 = (
    (r"(?is)<ref.*?>.*?</ref>", " "),
    (r"(?s)\{\{.*?\}\}", " "),
    (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", " "),
    (LINK, "$1$2"),
    (r"<[^>]+>", " "),
    (rf"https?://[^{WIDE_SPACE}]+", " "),
    (r"\[\[|\]\]", " "),
    (rf"[{WIDE_SPACE}]+", " "),
)

# Fixed value: a token is a run of two or more ASCII letters in lower-cased text.
TOKEN = "[a-z]{2,}"


def _replace_all(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip_markup(text: Column) -> Column:
    """Page markup to plain text; NULL stays NULL."""
    return F.trim(_replace_all(text, MARKUP_RULES))


def strip_markup_v1(text: Column) -> Column:
    """The first-generation cleaner: other rule order, Unicode white space, NULL becomes ''."""
    return F.trim(_replace_all(F.coalesce(text, F.lit("")), MARKUP_RULES_V1))


def collapse_links(text: Column) -> Column:
    """`[[target|alias]]` to alias (possibly empty), `[[target]]` to target, in one scan."""
    return F.regexp_replace(text, LINK, "$1$2")


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without_stopwords(tokens: Column, words: Iterable[str] = ENGLISH) -> Column:
    """Drop stop words, keep order and duplicates. The literal list becomes a hash set lookup."""
    words = [w.lower() for w in words]
    if not words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(words))


def normalize_title(title: Column) -> Column:
    return F.lower(F.btrim(title, F.lit(WIDE_SPACE)))


def normalize_query(query: Column) -> Column:
    """Words of a search text: lower case, split on white space."""
    return F.filter(F.split(F.lower(query), f"[{WIDE_SPACE}]+"), lambda word: word != "")
