"""Line-first cleaning: judge each line, remove those that fail, then reject documents that lose too much text.

A line without a word stays as it is. A line with words fails, in this order, by

* ``punctuation``: runs of ``!``/``?`` or of symbols make up more than a fifth of its words, or the line has
  more than ``LONG_LINE`` words and does not end in sentence punctuation;
* ``navigation``: two or more separators standing alone, links for a third of its words or more, or a place in a menu:
  three or more lines with words in succession of at most ``MENU_WORDS`` words each, none with a sentence's end;
* ``boilerplate``: it repeats an earlier line of the document, has a legal mark, or holds one of the stock phrases.

Only the stock phrases are words of a language; they are listed for each language and looked for in all texts.

A document is kept if it passes the base rules and the words of its remaining lines are at least half of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table
from ._words import blocks, shingles, words_of, xxh64

LONG_LINE = 60
MENU_WORDS = 8
MENU_RUN = 3
PHRASES = {
    "any": ("cookie", "javascript", "lorem ipsum", "copyright"),
    "en": ("privacy policy", "terms of service", "terms of use", "all rights reserved", "click here", "subscribe to", "sign up", "log in", "read more"),
    "fr": ("politique de confidentialité", "mentions légales", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "lire la suite", "se connecter"),
    "de": ("datenschutzerklärung", "impressum", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "weiterlesen", "jetzt anmelden"),
    "es": ("política de privacidad", "aviso legal", "condiciones de uso", "todos los derechos reservados", "haga clic aquí", "leer más", "iniciar sesión"),
}
STOCK = "|".join(p for group in PHRASES.values() for p in group)
MARK = r"[©®™]|\([cC]\)[\x20\x09]*[0-9]{4}"
LINK = r"https?://|www\."
NOISE = r"[!?]{2,}|[#*$%&|<>]+"
ENDING = r"[.!?:;,…][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SEPARATOR = r"[\x20\x09][|»>•·/][\x20\x09]"

_noise, _ending, _separator, _symbol = re.compile(NOISE), re.compile(ENDING), re.compile(SEPARATOR), re.compile(r"[#*$%&|<>]")
_stock, _mark, _link = re.compile(STOCK), re.compile(MARK), re.compile(LINK)
_blank = re.compile(r"[\x20\x09-\x0D]+")


def failure(line: str, words: list[str], menu: bool = False, again: bool = False) -> str | None:
    """The rule that a line with these words fails, or None. ``menu``: it stands in a menu; ``again``: it repeats a line."""
    if 5 * len(_noise.findall(line)) > len(words) or len(words) > LONG_LINE and not _ending.search(line):
        return "punctuation"
    if menu or len(_separator.findall(line)) >= 2 or 3 * sum(bool(_link.match(w)) for w in words) >= len(words):
        return "navigation"
    return "boilerplate" if again or _mark.search(line) or _stock.search(line.lower()) else None


def in_menus(stubs: list[bool]) -> list[bool]:
    """Which of a document's lines with words stand in a run of MENU_RUN or more stubs."""
    out, run = [False] * len(stubs), 0
    for i, stub in enumerate([*stubs, False]):
        if stub:
            run += 1
            continue
        if run >= MENU_RUN:
            out[i - run : i] = [True] * run
        run = 0
    return out


def clean(text: str) -> tuple[str, dict[str, int], int]:
    """The text without failing lines, the number of lines that failed each rule, and the words that went with them."""
    stay, failed, lost = [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0
    split = [(line, [w for w in _blank.split(line) if w]) for line in text.split("\n")]
    menus = iter(in_menus([len(words) <= MENU_WORDS and not _ending.search(line) for line, words in split if words]))
    seen: set[str] = set()
    for line, words in split:
        why = failure(line, words, next(menus), line in seen) if words else None
        if words:
            seen.add(line)
        if why:
            failed[why] += 1
            lost += len(words)
        else:
            stay.append(line)
    return "\n".join(stay), failed, lost


def _base(texts: list[str]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = np.zeros((5, len(texts)), np.int64)
    for at, block in blocks([t.encode("utf-8", "surrogatepass") for t in texts]):
        w = words_of(block)
        n = np.diff(w.first)
        out[0, at : at + len(block)] = n
        start, end, before = shingles(w, 3)
        text = np.repeat(np.arange(len(n)), np.diff(before))
        whole = n[text] >= 3
        keys = xxh64(w.buf, start[whole], end[whole])
        order = np.lexsort((keys, text[whole]))
        k, t = keys[order], text[whole][order]
        same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = (w.first[text] + np.arange(len(text)) - before[text])[whole][order][twice]
        covered = np.zeros(len(w.start), bool)
        for j in range(3):
            covered[first + j] = True
        out[4, at : at + len(block)] = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    for i, t in enumerate(texts):
        out[1, i] = len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")
        out[2, i] = len(_symbol.findall(t))
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        out[3, i] = len(lines) - len(set(lines))
    return tuple(out)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FAILED = ("failed_punctuation", "failed_navigation", "failed_boilerplate")


def line_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, cleaned_text, the base counts, base_failed, lines failed by each rule, words_lost and kept of every row.

    A null text counts as empty: no words, base_failed, not kept. Repeated rows are judged each for itself; an
    empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = _base(texts)
            cleaned = [clean(t) for t in texts]
            n, repeated = counts[0], counts[4]
            failed = (n < 50) | (100 * repeated > 50 * n)
            lost = np.fromiter((c[2] for c in cleaned), np.int64, len(texts))
            rules = [pa.array([c[1][k] for c in cleaned], pa.int64()) for k in ("punctuation", "navigation", "boilerplate")]
            columns = [batch.column("doc_id"), pa.array([c[0] for c in cleaned], pa.string()), *map(pa.array, counts), pa.array(failed), *rules, pa.array(lost), pa.array(~failed & (2 * lost <= n))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cleaned_text", *COUNTS, "base_failed", *FAILED, "words_lost", "kept"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, cleaned_text string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{c} long" for c in FAILED) + ", words_lost long, kept boolean"
    return src.mapInArrow(run, schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents that are kept, less their failing lines."""
    return line_quality(docs).where("kept").select("doc_id", F.col("cleaned_text").alias("text"))


def op1_line_quality(spark, sf_dir: str) -> DataFrame:
    """line_quality of all documents, less the cleaned texts; null texts fail the base rules."""
    return line_quality(table(spark, sf_dir, "documents")).drop("cleaned_text")


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT *, len(regexp_extract_all(line, '{_W}')) AS n, regexp_matches(line, {_re(ENDING)}) AS ended
  FROM (SELECT rid, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM (SELECT rid, string_split(text, chr(10)) AS w FROM d))),
stubs AS (
  SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS again,
         coalesce(sum((NOT stub)::INTEGER) OVER (PARTITION BY rid ORDER BY pos), 0) AS run
  FROM (SELECT *, n <= {MENU_WORDS} AND NOT ended AS stub FROM lines WHERE n > 0)),
placed AS (SELECT *, stub AND count(*) FILTER (stub) OVER (PARTITION BY rid, run) >= {MENU_RUN} AS menu FROM stubs),
judged AS (
  SELECT rid, line, n, CASE
      WHEN 5 * len(regexp_extract_all(line, {_re(NOISE)})) > n OR (n > {LONG_LINE} AND NOT ended) THEN 'punctuation'
      WHEN menu OR len(regexp_extract_all(line, {_re(SEPARATOR)})) >= 2
        OR 3 * len(list_filter(regexp_extract_all(line, '{_W}'), lambda w: regexp_matches(w, '^(?:{LINK})'))) >= n THEN 'navigation'
      WHEN again OR regexp_matches(line, {_re(MARK)}) OR regexp_matches(lower(line), {_re(STOCK)}) THEN 'boilerplate' END AS why
  FROM placed),
per AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (why IS NOT NULL), 0) AS words_lost,
         count(*) FILTER (why = 'punctuation') AS failed_punctuation, count(*) FILTER (why = 'navigation') AS failed_navigation,
         count(*) FILTER (why = 'boilerplate') AS failed_boilerplate
  FROM judged GROUP BY rid),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{_W}') AS w FROM d)),
wins AS (SELECT rid, i, word, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)),
counted AS (SELECT rid, i, word, CASE WHEN w3 IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 THEN 1 ELSE 0 END AS twice FROM wins),
covered AS (SELECT rid, word, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM counted),
base AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words FROM covered GROUP BY rid),
tot AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(failed_punctuation, 0)::BIGINT AS failed_punctuation,
         coalesce(failed_navigation, 0)::BIGINT AS failed_navigation, coalesce(failed_boilerplate, 0)::BIGINT AS failed_boilerplate,
         coalesce(words_lost, 0)::BIGINT AS words_lost
  FROM d LEFT JOIN per USING (rid) LEFT JOIN base USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * words_lost <= n_words AS kept
FROM tot
"""
