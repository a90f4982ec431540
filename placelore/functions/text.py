"""Text scalars: cleaning, keys, splitting and tokens. All return Columns; only NFKD and the HTML
entity decode need Python, and those run as Arrow batches."""

from __future__ import annotations

import re

import html
import html.entities
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points removed as emoji, URL and punctuation patterns.
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F926}-\x{1F937}\x{10000}-\x{10FFFF}"
         r"\x{2640}-\x{2642}\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+")
URL = r"https?://\S+|www\.\S+"
REPEATED_PUNCTUATION = r"([!?.]){3,}"
BLANK = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INLINE_BLANK = BLANK.replace(r"\s", r" \t\x{0B}\f\r")
KEPT_SHORT_WORDS = ["am", "pm", "no", "not"]
LISTING_SUFFIX = r"(?i)(Unclaimed|Claimed)?If_?you_?own_?this_?business.*$"
PROFILE_SUFFIXES = [r"UnclaimedIf_you_own.*", r"Someone_from_this_business.*"]


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else html.unescape(s))


#: A reference that says where it ends; the ampersand alone may be written without its semicolon.
CLOSED = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;|amp)")


def _closed(found: re.Match) -> str:
    ref = found[0]
    if ref[1] == "#" or ref[1:] in html.entities.html5:
        return html.unescape(ref)
    return "&" + ref[4:] if ref.startswith("&amp") else ref


@F.pandas_udf(StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else CLOSED.sub(_closed, s))


def decode_entities(text: Column) -> Column:
    return unescape_html(text)


def decode_closed_entities(text: Column) -> Column:
    """Like ``decode_entities``, but an entity that was cut off before its semicolon stays as it is (``&amp`` does not)."""
    return unescape_closed(text)


def remove_emojis(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def reduce_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, REPEATED_PUNCTUATION, "$1")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    lines = F.regexp_replace(text, r"\r\n|\r", "\n")
    lines = F.regexp_replace(lines, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(lines, rf"[{INLINE_BLANK}]+", " "))


def clean_text(text: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """Display form: entities, emoji, URLs, NFKD, punctuation runs, white space - in that order."""
    decoded = remove_urls(remove_emojis(decode(F.coalesce(text, F.lit("")))))
    return normalize_whitespace(reduce_punctuation(nfkd(decoded)))


def flat_text(text: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """Entities decoded and all white space collapsed to single blanks."""
    return strip(F.regexp_replace(decode(F.coalesce(text, F.lit(""))), r"\s+", " "))


def safe_key(name: Column) -> Column:
    key = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"[^\w]", "_")
    key = F.regexp_replace(F.regexp_replace(key, r"_+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))


def profile_name(key: Column) -> Column:
    for suffix in PROFILE_SUFFIXES:
        key = F.regexp_replace(key, suffix, "")
    return strip(F.replace(key, F.lit("_"), F.lit(" ")))


def clean_name(raw: Column) -> Column:
    name = F.replace(F.regexp_replace(raw, LISTING_SUFFIX, ""), F.lit("_"), F.lit(" "))
    return strip(F.regexp_replace(name, r"\s+", " "))


def loose_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(clean_name(name)), r"[^a-z0-9]", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sentence_key(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Split after end punctuation followed by white space; blanks are dropped."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def scored_sentences(title: Column, body: Column, min_chars: int = 15) -> Column:
    joined = F.concat_ws(". ", title, body)
    return F.filter(sentences(joined), lambda s: F.length(s) >= min_chars)


def first_long_piece(text: Column, min_chars: int = 20) -> Column:
    pieces = F.transform(F.split(text, r"\."), strip)
    return F.try_element_at(F.filter(pieces, lambda s: F.length(s) > min_chars), F.lit(1))


def plain_quotes(text: Column) -> Column:
    return F.lower(F.translate(text, "’‘“”", "''\"\""))


def tokens(text: Column, stop_words: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words if w not in KEPT_SHORT_WORDS])
    keep = F.array(*[F.lit(w) for w in KEPT_SHORT_WORDS])
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: (~F.array_contains(stop, w) & (F.length(w) > 1)) | F.array_contains(keep, w))


def bigrams(words: Column) -> Column:
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(heads, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def split_places(raw: Column) -> Column:
    parts = F.transform(F.split(F.replace(F.coalesce(raw, F.lit("")), F.lit("\n"), F.lit(",")), ","), strip)
    return F.filter(parts, lambda s: s != "")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "")


def finite(x: Column) -> Column:
    bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
    return F.when(~bad, x)


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(F.expr("cast(null as double)") if value is None else value.try_cast("double")),
                      F.lit(default))


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its column; null if one of them is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
