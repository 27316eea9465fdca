"""Scalar text operators as column expressions. White space is ASCII (space, tab, line feed, vertical tab, form feed, return)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

WS = r"[ \t\n\x0B\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that mark page furniture (fixed values).
FURNITURE = r"copyright|all rights reserved|doi:|http://|https://|www\.|issn|journal of|downloaded"
#: Beginnings of captions (fixed values).
CAPTION = r"^[ \t\r\n-]*(?:fig\.|figure |table |above:|below:|left:|right:|photo:|source:)"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def ascii_lower(text: Column) -> Column:
    """A-Z only: other letters stay."""
    return F.translate(text, UPPER, LOWER)


def list_marker(text: Column) -> Column:
    """Layout's rule: a bullet or a number with a dot or bracket, and then white space."""
    return trim(text).rlike(rf"^(?:[-*+]{WS}|[0-9]+[.)]{WS})")


def recovered_list_marker(text: Column) -> Column:
    """Recovery's rule: any bullet, or digits, spaces and one of ``. ) : -``."""
    return F.regexp_replace(text, r"^[ \t\r\n]+", "").rlike(r"^[-*+]|^[0-9]+[ \t]*[.):-]")


def dot_leader(text: Column) -> Column:
    return text.contains("...") | text.contains(" . . ")


def dot_leader_token(text: Column) -> Column:
    """At least three bytes, three quarters of them dots, underscores, hyphens or spaces."""
    bare = trim(text)
    size = F.octet_length(bare)
    return (size >= 3) & (size - F.octet_length(F.regexp_replace(bare, r"[._ -]", "")) >= 0.75 * size)


def decimal_marker(text: Column) -> Column:
    bare = trim(text)
    return F.when(bare.rlike(r"^[0-9]{1,4}\z"), bare.cast("int"))


def visible(text: Column) -> Column:
    """Bytes that are not white space."""
    return F.octet_length(F.regexp_replace(text, WS, ""))


def page_marker(text: Column) -> Column:
    bare = F.regexp_replace(text, WS, "")
    digits, letters = F.regexp_count(bare, F.lit("[0-9]")), F.regexp_count(bare, F.lit("[A-Za-z]"))
    roman = bare.rlike(r"^[^A-Za-z]*(?:[IVXLCDMivxlcdm][^A-Za-z]*)+\z")
    return bare.rlike(r"^[0-9A-Za-z/|().:-]{1,16}\z") & (((digits > 0) & (letters <= 4)) | ((digits == 0) & (letters > 0) & roman))


def furniture_pattern(text: Column) -> Column:
    return ascii_lower(text).rlike(FURNITURE) | page_marker(text)


def caption_prefix(text: Column) -> Column:
    return ascii_lower(text).rlike(CAPTION)


def furniture_key(text: Column) -> Column:
    """Lower case, each run of digits a #, runs of spaces one space, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(ascii_lower(text), "[0-9]+", "#"), f"{WS}+", " "))


def json_at(document: Column, pointer: str) -> Column:
    """The JSON text of what an RFC 6901 pointer names in a JSON document; null if there is nothing, or no JSON.
    ValueError for a key that Spark's variant paths cannot name: an empty one, or one with both kinds of quotes."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer}")
    here = F.try_parse_json(document)
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        quote = "'" if "'" not in key else '"'
        if not key or quote in key:
            raise ValueError(f"a key that Spark's paths cannot name: {key!r}")
        member = F.try_variant_get(here, f"$[{quote}{key}{quote}]", "variant")
        here = F.coalesce(member, F.try_variant_get(here, f"$[{int(part)}]", "variant")) if re.fullmatch("0|[1-9][0-9]*", part) else member
    return F.to_json(here)


#: Line ends and white space as Unicode has them (fixed values).
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
TRAILING = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clean_reference(text: Column) -> Column:
    """Lines without trailing white space, no blank lines at either end, and a line feed at the end of what is left."""
    bare = F.array_join(F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, rf"{TRAILING}\z", "")), "\n")
    bare = F.regexp_replace(bare, r"^\n+|\n+\z", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def media_type(path: Column) -> Column:
    suffix = ascii_lower(F.regexp_extract(path, r"\.([^./\\]*)\z", 1))
    out = F.lit("application/octet-stream")
    for ext, kind in (("pdf", "application/pdf"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp"), ("json", "application/json"), ("md", "text/markdown"), ("html", "text/html")):
        out = F.when(suffix == ext, kind).otherwise(out)
    return out


def simple_normal(text: Column) -> Column:
    return trim(F.regexp_replace(ascii_lower(text), f"{WS}+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, Unicode white space collapsed, case folded. Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.pandas_udf(StringType())
def fnv1a_id(text: pd.Series) -> pd.Series:
    """doc_ and 16 hex digits of FNV-1a-64 (a Python loop: the wrapping product overflows in ANSI mode)."""

    def one(t: str) -> str:
        h = 14695981039346656037
        for b in t.encode():
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        return f"doc_{h:016x}"

    return text.map(lambda t: None if t is None else one(t))


def _distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists, a row of the table at a time."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(w, len(number)) for w in side] for side in (a, b))
    target, places = np.array(y, np.int64), np.arange(len(y) + 1)
    row = places.copy()
    for i, w in enumerate(x):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (target != w))
        row = np.minimum.accumulate(best - places) + places  # a run of insertions from any place before
    return int(row[-1])


@F.pandas_udf(LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance in words (runs of anything but ASCII white space); null if a side is null."""
    blank = re.compile(f"{WS}+")
    words = lambda t: [w for w in blank.split(t) if w]
    return pd.Series([None if p is None or q is None else _distance(words(p), words(q)) for p, q in zip(a, b)], dtype="Int64")
