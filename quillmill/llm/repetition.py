"""Quality rules by repetition coverage.

For each document: how many of its characters lie inside n-grams of words that occurred before in it
(n = 5 to 10; overlapping occurrences count a character once), and how many lines, and characters of lines,
repeat an earlier line.  A document is kept unless a share passes its limit.  First occurrences don't count, so that
a text that is written twice has a share of one half in all measures: more than longer repeats of characters may
take.  Longer n-grams have smaller limits, as what they repeat is inside shorter ones too.

Words are separated by ASCII white space, lines by line feeds; a line is its sequence of words, and one
without words is no line.  Characters are code points of words, so the shares don't depend on spacing.

Scale: one pass without any shuffle; the measures are integers, the decision is made on the JVM side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.textbatch import Words, doc_sums, mix, segment_hash, slices

#: n -> largest share of characters, in hundredths, inside n-grams that occurred before.
NGRAM_LIMITS = {5: 45, 6: 43, 7: 41, 8: 39, 9: 37, 10: 35}
#: Largest share, in hundredths, of lines and of their characters that repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 50, 50

FIELDS = ["n_words", "word_chars", "n_lines", "dup_lines", "dup_line_chars", *(f"dup{n}_chars" for n in NGRAM_LIMITS)]
_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    s = np.sort(keys)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    again = again[np.concatenate(([True], again[1:] != again[:-1]))]
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The FIELDS of each text of a slice."""
    words = Words(column)
    h, n = words.hash, len(words.hash)
    chars, bounds = words.chars(), words.bounds
    out = {"n_words": np.diff(bounds), "word_chars": doc_sums(chars, bounds)}
    if not n:
        zero = np.zeros(words.n_docs, dtype=np.int64)
        return {f: out.get(f, zero) for f in FIELDS}
    doc = words.doc
    salt = mix(doc.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))

    line = words.lines()
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.append(first[1:], n)
    key = segment_hash(h, first, last) ^ salt[first]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    line_chars = np.add.reduceat(chars, first)
    at = np.searchsorted(first, bounds)
    out["n_lines"] = np.diff(at)
    out["dup_lines"] = doc_sums(later.astype(np.int64), at)
    out["dup_line_chars"] = doc_sums(line_chars * later, at)

    # An n-gram can only repeat where the shorter ones at its place and the next do: each length looks at what is left of the one before.
    room = bounds[1:][doc] - np.arange(n)
    at = np.flatnonzero(room >= 2)
    grams = np.empty(n, dtype=np.uint64)
    grams[:] = h
    size = 1
    multiplier = np.uint64(0x2545F4914F6CDD1D)
    for length in range(2, max(NGRAM_LIMITS) + 1):
        size = length
        grams[at] = mix(grams[at] * multiplier + h[at + size - 1])
        at = at[_repeated(grams[at] ^ salt[at])]
        if length in NGRAM_LIMITS:
            if len(at):
                key = grams[at] ^ salt[at]
                order = np.argsort(key, kind="stable")
                again = at[order[1:]][key[order[1:]] == key[order[:-1]]]
                edge = np.bincount(again, minlength=n + 1)[: n + 1] - np.bincount(again + length, minlength=n + 1)[: n + 1]
                out[f"dup{length}_chars"] = doc_sums(chars * (np.cumsum(edge)[:n] > 0), bounds)
            else:
                out[f"dup{length}_chars"] = np.zeros(words.n_docs, dtype=np.int64)
        hit = np.zeros(n + 1, dtype=bool)
        hit[at] = True
        at = at[hit[at + 1] & (room[at] > length)]
    return out


@F.arrow_udf(_TYPE)
def repetition_measures(text: pa.Array) -> pa.Array:
    parts = [measure(text.slice(a, b - a)) for a, b in slices(text)]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[f] for p in parts]).astype(np.int64) if parts else [], type=pa.int64()) for f in FIELDS], names=FIELDS
    )


def keep_rule(measures: Column) -> Column:
    over = F.lit(False)
    for n, limit in NGRAM_LIMITS.items():
        over = over | (measures[f"dup{n}_chars"] * 100 > measures["word_chars"] * limit)
    over = over | (measures["dup_lines"] * 100 > measures["n_lines"] * LINE_LIMIT)
    return ~(over | (measures["dup_line_chars"] * 100 > measures["word_chars"] * LINE_CHAR_LIMIT))


def repetition_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measures and keep, one row for each row of docs.

    A null or empty text has no words: all its measures are 0 and it is kept; a very long one is measured whole.  Repeated rows are measured
    each for itself; a null id stays null; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), repetition_measures(docs[text]).alias("m"))
    return rows.select("doc_id", *[F.col("m")[f].alias(f) for f in FIELDS], keep_rule(F.col("m")).alias("keep"))


def repetition_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that repetition_report keeps, with all their columns."""
    return docs.where(keep_rule(repetition_measures(docs[text])))


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents
), flat AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), chars AS (
  SELECT doc_id, i, length(w[i]) AS c FROM flat
), sized AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM words
), grams AS (
  SELECT doc_id, i, n, hash(array_to_string(w[i:i+n-1], ' ')) AS g FROM flat, (SELECT unnest(range(5, 11)) AS n) WHERE i + n - 1 <= len(w)
), repeated AS (
  SELECT doc_id, n, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS k FROM grams) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, n, i + d AS i FROM (SELECT *, unnest(range(0, n)) AS d FROM repeated)
), dup AS (
  SELECT doc_id, {", ".join(f"sum(CASE WHEN n = {n} THEN c ELSE 0 END) AS dup{n}_chars" for n in NGRAM_LIMITS)}
  FROM covered JOIN chars USING (doc_id, i) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents
), line_words AS (
  SELECT doc_id, k, list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM lines
), line_rank AS (
  SELECT doc_id, list_sum(list_transform(w, lambda x: length(x))) AS c, row_number() OVER (PARTITION BY doc_id, array_to_string(w, ' ') ORDER BY k) AS r FROM line_words WHERE len(w) > 0
), line_sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS dup_lines, coalesce(sum(c) FILTER (r > 1), 0) AS dup_line_chars FROM line_rank GROUP BY doc_id
), m AS (
  SELECT doc_id, n_words, word_chars, coalesce(n_lines, 0) AS n_lines, coalesce(dup_lines, 0) AS dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(f"coalesce(dup{n}_chars, 0) AS dup{n}_chars" for n in NGRAM_LIMITS)}
  FROM sized LEFT JOIN dup USING (doc_id) LEFT JOIN line_sums USING (doc_id)
)
SELECT {", ".join(["doc_id", *(f"CAST({f} AS BIGINT) AS {f}" for f in FIELDS)])},
  NOT ({" OR ".join(f"dup{n}_chars * 100 > word_chars * {x}" for n, x in NGRAM_LIMITS.items())} OR dup_lines * 100 > n_lines * {LINE_LIMIT} OR dup_line_chars * 100 > word_chars * {LINE_CHAR_LIMIT}) AS keep
FROM m
"""
