"""Tokenisers as column expressions, and their spelling in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. White space between words; characters cut from a word's edges; characters deleted
#: anywhere in a strict token: ASCII punctuation, decimal digits, and digits that are not decimal.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
EDGES = "?!.;:[](),"
DELETED = r"[!-/:-@\[-`{-~\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"

#: Stop-words of the registered queries; any list may be given instead.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "der", "die", "el", "en", "un", "des", "was", "that", "for", "it", "with")


def split_words(text: Column) -> Column:
    """Words between white space, empty ones left out; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def edge_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words without the edge characters, stop-words and empty words left out."""
    cleaned = F.transform(split_words(F.lower(text)), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.filter(cleaned, lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


def strict_tokens(text: Column) -> Column:
    """Lower-case words without any punctuation or digit; empty words left out."""
    # what is deleted is never white space, so it may go before the split: one pass a text, not one a word
    return split_words(F.regexp_replace(F.lower(text), DELETED, ""))


def has_strict_token(text: Column) -> Column:
    """Whether a text has any strict token: a character that is neither deleted nor white space."""
    return F.coalesce(text.rlike(rf"[^{DELETED[1:-1]}{SPACE[1:-2]}]"), F.lit(False))


def month_name(date: Column) -> Column:
    """The month as two digits."""
    return F.date_format(date, "MM")


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda w: w <> '')"


def edge_tokens_sql(text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> str:
    return f"list_filter(list_transform({words_sql(text)}, lambda w: trim(lower(w), '{EDGES}')), lambda w: w <> '' AND w NOT IN ({quoted(stop_words)}))"


def strict_tokens_sql(text: str) -> str:
    return f"list_filter(list_transform({words_sql(text)}, lambda w: regexp_replace(lower(w), '{DELETED}', '', 'g')), lambda w: w <> '')"
