"""Substring dedup by recompression.

Each document is a sequence of words.  Rounds of recompression replace maximal runs of one symbol, and then pairs
of a "left" and a "right" symbol (sides are drawn anew each round by the symbol's hash), by new symbols, until a
symbol stands for FULL words or more and takes part no more.  A new symbol's name is a digest of the round and of
the symbols that it replaces: equal content has one name in every task of the cluster, so that naming is global
without an exchange.  Which symbols appear inside a stretch of text depends only on the text a few symbols around,
so equal stretches have equal interior symbols.

A repeat of MIN_WORDS words or more has some interior symbol in common.  Symbols that occur once are dropped; every
window of MIN_WORDS words that holds a shared symbol is then verified: windows are grouped by a digest of all their
words (128 bits).  A window whose words stand in an earlier place, by document id and position, is a duplicate, and
the words it covers are cut.

Scale: one narrow row for about FULL words is shuffled to find shared symbols; texts move once, to the stretches
with shared symbols; only windows in these are shuffled.  No step has more state in memory than a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import cut, fresh, text_key
from quillmill.llm.textbatch import Words, mix, segment_hash, slices

MIN_WORDS = 50
FULL, ROUNDS = 8, 32

_RUN, _PAIR, _NEXT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def parse(symbols: np.ndarray, doc: np.ndarray, full: int = FULL, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols that stand for full words or more when the rounds are over.

    A run that reaches full words is named by what is repeated, not how often, so that runs of different lengths
    share their name; its words are given as a negative number, with what a broken period on either side can add.
    One that holds a repeat of itself is given twice.
    """
    n = len(symbols)
    sym, start, length, d = symbols.copy(), np.arange(n), np.ones(n, dtype=np.int64), doc
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        if len(sym) < 2:
            break
        salt = mix(np.array([r + 1], dtype=np.uint64))[0]
        active = length < full
        if not (active[1:] & active[:-1]).any():
            break
        link = (d[1:] == d[:-1]) & active[1:] & active[:-1]
        same = link & (sym[1:] == sym[:-1])
        if same.any():
            at = np.flatnonzero(np.concatenate(([True], ~same)))
            k = np.diff(np.append(at, len(sym)))
            run, base, unit = k > 1, sym[at], length[at]
            sym = np.where(run, mix(base * _RUN + k.astype(np.uint64) + salt), base)
            start, length, d = start[at], unit * k, d[at]
            big = run & (length >= full)
            if big.any():
                name, part = mix(base[big] ^ _RUN), unit[big] - 1
                first, words = start[big] - part, length[big] + 2 * part
                runs.append((name, first, -words))
                more = words > MIN_WORDS + part
                runs.append((name[more], start[big][more] + 1, 1 - length[big][more]))
                sym[big] = 0  # given already
            active = length < full
            link = (d[1:] == d[:-1]) & active[1:] & active[:-1]
        left = (mix(sym ^ salt) >> np.uint64(63)).astype(bool)
        pair = link & left[:-1] & ~left[1:]
        if not pair.any():
            continue
        at = np.flatnonzero(np.concatenate(([True], ~pair)))
        paired = np.append(pair, False)[at]
        after = np.minimum(at + 1, len(sym) - 1)
        sym = np.where(paired, mix(mix(sym[at] * _PAIR + salt) + sym[after] * _NEXT), sym[at])
        start, length, d = start[at], length[at] + np.where(paired, length[after], 0), d[at]
    whole = (length >= full) & (sym != 0)
    parts = [(sym[whole], start[whole], length[whole]), *runs]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _windows_hash(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest, as two int64, of words[i : i + size] for each i of at."""
    first = segment_hash(words, at, at + size)
    second = segment_hash(mix(words ^ _PAIR), at, at + size)
    return first.view(np.int64), second.view(np.int64)


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sym, doc_id, k, a, b): a symbol's first word and length; for a whole document sym is k, a is -1 - its words, b a digest of them."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            words = Words(part.column(2))
            if len(words.hash) < MIN_WORDS:
                continue
            doc, k = words.doc, part.column(1).to_numpy()
            sym, start, length = parse(words.hash, doc)
            d = doc[start - (length >> 63) * (-length // 2)]  # a run may begin before its document
            size = np.diff(words.bounds)
            long = np.flatnonzero(size >= MIN_WORDS)
            whole = segment_hash(words.hash, words.bounds[long], words.bounds[long + 1])
            enough = size[d] >= MIN_WORDS
            sym, start, length, d = sym[enough], start[enough], length[enough], d[enough]
            place = start - words.bounds[d]
            before = np.minimum(place, 0)
            place, length = place - before, length - before * np.sign(length)
            rows = np.concatenate([d, long])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([sym.view(np.int64), k[long]])),
                    part.column(0).take(pa.array(rows)),
                    pa.array(k[rows]),
                    pa.array(np.concatenate([place, -1 - size[long]])),
                    pa.array(np.concatenate([length, whole.view(np.int64)])),
                ],
                names=["sym", "doc_id", "k", "a", "b"],
            )


def _stack(carry: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if carry is None else pa.concat_batches([carry, batch])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sym, k, a, b, doc_id: symbols in two places or more, for equal texts only in the first of them; and equal texts with that first one (source)."""
    carry, given = None, False
    for batch in batches:
        if not len(batch):
            continue
        rows = _stack(carry, batch)
        sym, k, a, b = (rows.column(i).to_numpy() for i in (0, 2, 3, 4))
        new_sym = np.concatenate(([True], sym[1:] != sym[:-1]))
        new = new_sym.copy()
        new[1:] |= (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(sym)), 0))
        group = np.cumsum(new_sym) - 1
        entries = np.bincount(group[new])
        many = entries[group] >= 2
        emit = new & many & (a >= 0)
        if carry is not None and given:
            emit[0] = False
            same = group == 0
            emit |= same & new & (a >= 0) & (np.arange(len(sym)) > 0)
            many |= same
        copies = ~new & (a < 0)
        own, source = rows.column(1).take(pa.array(np.flatnonzero(copies))), rows.column(1).take(pa.array(head[copies]))
        yield _places(rows, emit, pa.nulls(int(emit.sum()), rows.column(1).type))
        if len(own):
            other = pc.fill_null(pc.not_equal(own, source), pa.scalar(True))
            both_null = pc.and_(pc.is_null(own), pc.is_null(source))
            keep = pc.and_(other, pc.invert(both_null))
            mask = np.zeros(len(sym), dtype=bool)
            mask[np.flatnonzero(copies)[keep.to_numpy(zero_copy_only=False)]] = True
            yield _places(rows, mask, source.filter(keep))
        last = int(head[-1])
        given = bool(many[-1])
        carry = rows.slice(last, 1)


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first differs from the one before; nulls are alike."""
    other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), pa.scalar(False)).to_numpy(zero_copy_only=False)
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    return other | (null[1:] != null[:-1])


def _places(rows: pa.RecordBatch, mask: np.ndarray, source: pa.Array) -> pa.RecordBatch:
    at = pa.array(np.flatnonzero(mask))
    return pa.RecordBatch.from_arrays([*(rows.column(i).take(at) for i in (1, 2, 3, 4)), source], names=["doc_id", "k", "a", "b", "source"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, k, text, places (first words and lengths in turn): h1, h2, doc_id, k, at for each window that holds one of the places."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            words = Words(part.column(2))
            n = len(words.hash)
            lists = part.column(3)
            flat = lists.flatten().to_numpy().reshape(-1, 2)
            d = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()) // 2)
            begin, end = words.bounds[d], words.bounds[d + 1]
            # a window that holds the symbol; of a run, one that shares FULL words with it
            run, size = flat[:, 1] < 0, np.abs(flat[:, 1])
            low = np.maximum(begin, begin + flat[:, 0] + np.where(run, FULL, size) - MIN_WORDS)
            high = np.minimum(begin + flat[:, 0] + np.where(run, size - FULL, 0), end - MIN_WORDS)
            ok = high >= low
            edge = np.bincount(low[ok], minlength=n + 2)[: n + 2] - np.bincount(high[ok] + 1, minlength=n + 2)[: n + 2]
            at = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            if not len(at):
                continue
            h1, h2 = _windows_hash(words.hash, at, MIN_WORDS)
            doc = np.searchsorted(words.bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(at - words.bounds[doc])],
                names=["h1", "h2", "doc_id", "k", "at"],
            )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by h1, h2, doc_id, k, at: all but the first of equal ones, with the first one's document (source)."""
    carry = None
    for batch in batches:
        if not len(batch):
            continue
        rows = _stack(carry, batch)
        h1, h2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        k, at = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        again = ~new
        again[1:] &= _changes(rows.column(2)) | (k[1:] != k[:-1]) | (at[1:] != at[:-1])  # repeated rows give a window twice
        later = pa.array(np.flatnonzero(again))
        yield pa.RecordBatch.from_arrays([*(rows.column(i).take(later) for i in (2, 3, 4)), rows.column(2).take(pa.array(head[again]))], names=["doc_id", "k", "at", "source"])
        carry = rows.slice(int(head[-1]), 1)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, k, at, n, source sorted by doc_id, k, at: the stretches of words that the ranges [at, at + n) cover, with the first range's source."""
    carry, reach = None, 0
    for batch in batches:
        if not len(batch):
            continue
        rows = _stack(carry, batch)
        k, at, n = (rows.column(i).to_numpy() for i in (1, 2, 3))
        ids = rows.column(0)
        doc = np.concatenate(([0], np.cumsum(_changes(ids) | (k[1:] != k[:-1]))))
        end = at + n
        if carry is not None:
            end[0] = reach
        # the furthest end so far in the document
        span = int(end.max()) + 1
        far = np.maximum.accumulate(end + doc * span) - doc * span
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > far[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        done = first[:-1]
        take = pa.array(done)
        yield pa.RecordBatch.from_arrays([ids.take(take), rows.column(1).take(take), pa.array(at[done]), pa.array(far[last[:-1]]), rows.column(4).take(take)], names=["doc_id", "k", "start_word", "end_word", "source"])
        carry, reach = rows.slice(int(first[-1]), 1), int(far[-1])
    if carry is not None:
        yield pa.RecordBatch.from_arrays([carry.column(0), carry.column(1), carry.column(2), pa.array([reach], pa.int64()), carry.column(4)], names=["doc_id", "k", "start_word", "end_word", "source"])


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, k (text key), start_word, end_word, source_id: see repeated_passages."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("k"), docs[text].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    symbols = base.mapInArrow(_symbols, f"sym bigint, doc_id {kind}, k bigint, a bigint, b bigint")
    places = cut(
        symbols.repartition(n, "sym").sortWithinPartitions("sym", "k", "a", "b", "doc_id")
        .mapInArrow(_shared, f"doc_id {kind}, k bigint, a bigint, b bigint, source {kind}")
    )
    where = (
        places.where("a >= 0").groupBy(F.col("doc_id").alias("d"), F.col("k").alias("dk"))
        .agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("places")).hint("shuffle_hash")
    )
    inside = base.join(where, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("dk"))).select("doc_id", "k", "text", "places")
    windows = inside.mapInArrow(_windows, f"h1 bigint, h2 bigint, doc_id {kind}, k bigint, at bigint")
    later = (
        windows.repartition(n, "h1").sortWithinPartitions("h1", "h2", "doc_id", "k", "at").mapInArrow(_later, f"doc_id {kind}, k bigint, at bigint, source {kind}")
    )
    found = cut(
        later.select("doc_id", "k", "at", F.lit(MIN_WORDS).cast("bigint").alias("n"), "source")
        .repartition(n, "doc_id", "k").sortWithinPartitions("doc_id", "k", "at")
        .mapInArrow(_merged, f"doc_id {kind}, k bigint, start_word bigint, end_word bigint, source {kind}")
    )
    # an equal text is a repeat as a whole; its beginning comes from where the first such text has it from
    opening = found.where("start_word = 0").select(F.col("doc_id").alias("d"), F.col("k").alias("dk"), F.col("source").alias("earlier"))
    copies = places.where("a < 0").select("doc_id", "k", F.lit(0).cast("bigint").alias("start_word"), (-1 - F.col("a")).alias("end_word"), "source").distinct()
    copies = copies.join(opening, F.col("source").eqNullSafe(F.col("d")) & (F.col("k") == F.col("dk")), "left")
    copies = copies.select("doc_id", "k", "start_word", "end_word", F.when(F.col("dk").isNull(), F.col("source")).otherwise(F.col("earlier")).alias("source_id"))
    return found.withColumnRenamed("source", "source_id").union(copies)


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start_word, end_word, source_id: the stretches of words (from 0, end exclusive) that substring dedup cuts.

    A stretch is covered by windows of MIN_WORDS words that stand in an earlier place too, by document id and then
    position; source_id is the first document that holds the stretch's first window.  Repeats inside one document
    count.  Null, empty and shorter texts have none; very long texts are taken whole.  Rows alike in id and text are one document, in which nothing
    repeats for that; rows with one id and different texts are ordered by a digest of the text.  A null id is the
    least.  An empty table gives an empty one.  Only id and text are read.
    """
    return repeats(docs, text, doc_id).drop("k")


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, ranges: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for lo, hi in slices(text):
        words = Words(text.slice(lo, hi - lo))
        raw = words.data.tobytes()
        for i, own in enumerate(ranges.slice(lo, hi - lo).to_pylist()):
            begin, end = int(words.offsets[i]), int(words.offsets[i + 1])
            if own is None:
                out.append(None)
                continue
            first, parts, at = int(words.bounds[i]), [], begin
            total = int(words.bounds[i + 1]) - first
            for a, b in sorted(zip(own[::2], own[1::2], strict=True)):
                parts.append(raw[at : int(words.starts[first + a])])
                at = int(words.starts[first + b]) if b < total else end
            out.append(b"".join([*parts, raw[at:end]]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with repeated_passages cut out of text, and n_chars (if there is such a column) counted anew for those texts.

    A document of which nothing but white space is left goes; all others stay, rows alike each, columns as they were.
    """
    d, dk, ranges = fresh(docs.columns, "d", "dk", "ranges")
    own = (
        repeats(docs, text, doc_id).groupBy(F.col("doc_id").alias(d), F.col("k").alias(dk))
        .agg(F.flatten(F.collect_list(F.array("start_word", "end_word"))).alias(ranges)).hint("shuffle_hash")
    )
    joined = docs.join(own, docs[doc_id].eqNullSafe(F.col(d)) & (text_key(docs[text]) == F.col(dk)), "left")
    whole = joined.where(F.col(ranges).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    left = joined.where(F.col(ranges).isNotNull()).withColumn(text, _without(F.col(text), F.col(ranges)))
    if n_chars and n_chars in docs.columns:
        left = left.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    left = left.where(F.length(F.trim(F.regexp_replace(text, r"[\t\n\r\f\x0B]", " "))) > 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return whole.union(left)


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS pos FROM w WHERE len(w) >= {MIN_WORDS}
), win AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + {MIN_WORDS}], ' ')) AS h FROM places
), later AS (
  SELECT doc_id, pos, source FROM (
    SELECT doc_id, pos, first(doc_id) OVER (PARTITION BY h ORDER BY doc_id, pos) AS source, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS r FROM win) WHERE r > 1
), island AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM later)
)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + {MIN_WORDS} AS BIGINT) AS end_word, CAST(arg_min(source, pos) AS BIGINT) AS source_id FROM island GROUP BY doc_id, g
"""
