"""Line-first cleaning: rules judge every line, failing lines go, documents that lose too much go.

Rules of a line (counts are code points, words are runs without ASCII white space):

* punctuation: more than a tenth of its characters are symbols ``#*$%&|<>``; or it shouts (three words
  or more, over 70 % of its A-Z letters are capitals); or it has ten words or more and no mark that ends a
  sentence or clause;
* navigation: a fifth or more of its words are separators such as ``|`` or ``»``, two at least;
* boilerplate: at most twelve words, and one of ``BOILERPLATE`` in it.

A document is kept when it passes the base test (ten words, at most a fifth of them in repeated
five-word windows) and its remaining lines hold at least half of its characters.

Defined results: a null text has no words and fails; an empty or white text likewise; rows may repeat;
an empty table gives an empty result; other columns pass through whatever their names. Memory is
bounded by one Arrow batch and the words of one document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 10
MAX_REPEAT = 20
MIN_LEFT = 50
SEPARATORS = ("|", "»", "›", "·", "•", ">", "/")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "accept cookies",
    "enable javascript", "click here", "sign up", "log in", "subscribe now", "skip to content", "back to top", "read more",
)
_WHITE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes that start no code point
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ENDS = (b".", b"!", b"?", b":", b";", "…".encode(), "。".encode(), "؟".encode(), "।".encode())
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_BOILERPLATE = tuple(s.encode() for s in BOILERPLATE)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

MEASURES = T.StructType([
    *[T.StructField(n, T.LongType()) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "left_chars")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = sum(h[k:n + k] * _ODD[k] for k in range(5))
    order = np.sort(sums)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    # Equal sums may be a coincidence, so these few windows are compared word by word.
    starts = np.flatnonzero(np.isin(sums, twice)).tolist()
    seen = Counter(tuple(words[i:i + 5]) for i in starts)
    covered = np.zeros(len(words), bool)
    for i in starts:
        if seen[tuple(words[i:i + 5])] > 1:
            covered[i:i + 5] = True
    return int(covered.sum())


def line_fails(line: bytes) -> bool:
    words = line.split()
    if not words:
        return False
    chars = len(line.translate(None, _WHITE + _INNER))
    if 10 * (len(line) - len(line.translate(None, _SYMBOLS))) > chars:
        return True
    upper, lower = len(line) - len(line.translate(None, _UPPER)), len(line) - len(line.translate(None, _LOWER))
    if len(words) >= 3 and 10 * upper > 7 * (upper + lower):
        return True
    if len(words) >= 10 and not any(e in line for e in _ENDS):
        return True
    marks = sum(w in _SEPARATORS for w in words)
    if marks >= 2 and 5 * marks >= len(words):
        return True
    return len(words) <= 12 and any(p in low for low in (line.lower(),) for p in _BOILERPLATE)


def measure(text: str | None) -> tuple[dict, str | None]:
    """The measures of a text, and the text without its failing lines."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    full = [line for line in lines if line.strip()]
    good = [line for line in lines if not line_fails(line)]
    chars = len(raw.translate(None, _WHITE + _INNER))
    left = sum(len(line.translate(None, _WHITE + _INNER)) for line in good)
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": repeated, "n_bad_lines": len(lines) - len(good),
        "left_chars": left, "base_failed": failed, "kept": not failed and 100 * left >= MIN_LEFT * chars,
    }, text if len(good) == len(lines) else b"\n".join(good).decode()


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to its good lines, and the measures of the whole text in ``__measures``."""
    place = docs.columns.index("text")
    arrow = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.bool_()) for f in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [measure(x.as_py()) for x in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array([t for _, t in done], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([m for m, _ in done], arrow)], names=[*batch.schema.names, "__measures"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__measures", MEASURES)])
    return docs.mapInArrow(run, schema)


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"__measures.{f.name}") for f in MEASURES])


_STRIPPED = r"length(regexp_replace({0}, '[\x20\x09-\x0D]', '', 'g'))"
_COUNT = "length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))"
SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
         unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN
         concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS win
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT doc_id, pos, win IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM windows),
covered AS (
  SELECT doc_id, max(CAST(twice AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c
  FROM counted),
word_sums AS (SELECT doc_id, COUNT(*) AS n_words, CAST(SUM(c) AS BIGINT) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM texts),
measured AS (
  SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws, {_STRIPPED.format('l')} AS chars,
         {_COUNT.format('l', '[#*$%&|<>]')} AS symbols, {_COUNT.format('l', '[A-Z]')} AS up, {_COUNT.format('l', '[a-z]')} AS low
  FROM lines),
judged AS (
  SELECT *, len(ws) > 0 AND (
      10 * symbols > chars OR (len(ws) >= 3 AND 10 * up > 7 * (up + low))
      OR (len(ws) >= 10 AND NOT regexp_matches(l, '[.!?:;…。؟।]'))
      OR (len([x for x in ws if x IN ({', '.join(f"'{s}'" for s in SEPARATORS)})]) >= 2
          AND 5 * len([x for x in ws if x IN ({', '.join(f"'{s}'" for s in SEPARATORS)})]) >= len(ws))
      OR (len(ws) <= 12 AND regexp_matches(lower(l), '{'|'.join(BOILERPLATE)}'))) AS bad
  FROM measured),
line_sums AS (
  SELECT doc_id, CAST(SUM(chars) AS BIGINT) AS word_chars, CAST(SUM(symbols) AS BIGINT) AS n_symbols,
         COUNT(*) FILTER (WHERE len(ws) > 0) - COUNT(DISTINCT CASE WHEN len(ws) > 0 THEN l END) AS n_dup_lines,
         COUNT(*) FILTER (WHERE bad) AS n_bad_lines, CAST(coalesce(SUM(chars) FILTER (WHERE NOT bad), 0) AS BIGINT) AS left_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT l.*, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_words, 0) < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed
  FROM line_sums l LEFT JOIN word_sums w ON l.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, left_chars, base_failed,
       NOT base_failed AND 100 * left_chars >= {MIN_LEFT} * word_chars AS kept
FROM base
"""
