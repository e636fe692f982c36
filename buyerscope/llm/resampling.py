"""Importance resampling towards a target distribution (hashed n-gram features, Gumbel top-k).

Every run of words falls into a bucket by its CRC-32. The checksum is linear, so it is the XOR of what each byte adds at its
distance from the end, and of a constant of the length: a table of byte by distance, one gather, and ``bitwise_xor.reduceat`` over
the spans give the checksums of all features of a piece of text at once. Spans longer than the table are folded block by block.

A bucket's gain is the log ratio of its share in the target and in the raw documents; a document's weight is the sum over its
features. Weight plus Gumbel noise, highest first, is a sample without replacement in proportion to the importance weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.byte_words import Words, words_of
from buyerscope.llm.common import share, table
from buyerscope.llm.numbering import number_rows
from buyerscope.storage import write_once

POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
REACH = 64  # bytes from the end that the position table covers
MAX_BUCKETS = 1 << 20  # counts and gains of all buckets pass through the driver


class PositionCrc:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, reach: int = REACH):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
        rows = [byte]
        for _ in range(reach - 1):
            rows.append(byte[rows[-1] & 255] ^ (rows[-1] >> 8))
        self.reach, self.table = reach, np.concatenate(rows)
        self.lengths = np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], dtype=np.uint32)

    def _xor(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """XOR of the contributions of spans of 1 .. reach bytes."""
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = at - begin[owner]
        added = self.table[((sizes[owner] - 1 - inside) << 8) + data[starts[owner] + inside]]
        return np.bitwise_xor.reduceat(added, begin)

    def _fold(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for longer spans: blocks of ``reach`` bytes from the end, folded from the first on."""
        blocks = -(-sizes // self.reach)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        first = np.cumsum(blocks) - blocks
        number = np.arange(len(owner)) - first[owner]
        head = sizes - (blocks - 1) * self.reach
        begin = starts[owner] + np.where(number == 0, 0, head[owner] + (number - 1) * self.reach)
        part = self._xor(data, begin, np.where(number == 0, head[owner], self.reach))
        state = np.zeros(len(sizes), dtype=np.uint32)
        for k in range(int(blocks.max())):
            on = np.flatnonzero(blocks > k)
            moved = np.zeros(len(on), dtype=np.uint32)
            for byte in range(4):  # the state is carried over one whole block
                moved ^= self.table[((self.reach - 1 - byte) << 8) + ((state[on] >> np.uint32(8 * byte)) & 255)]
            state[on] = moved ^ part[first[on] + k]
        return state

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of ``data[starts[i]:starts[i] + sizes[i]]`` for every i; sizes are positive."""
        out = np.empty(len(starts), dtype=np.uint32)
        long = sizes > self.reach
        if not long.all():
            short = ~long
            out[short] = self._xor(data, starts[short], sizes[short]) ^ self.lengths[sizes[short]]
        if long.any():
            different, which = np.unique(sizes[long], return_inverse=True)
            constant = np.array([zlib.crc32(bytes(int(n))) for n in different], dtype=np.uint32)
            out[long] = self._fold(data, starts[long], sizes[long]) ^ constant[which]
        return out


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each: bytes, start and size of every word."""
    sizes = np.diff(words.offsets)
    starts = words.offsets[:-1] + np.arange(len(sizes))
    data = np.full(len(words.data) + len(sizes), 32, dtype=np.uint8)
    data[np.arange(len(words.data)) + np.repeat(np.arange(len(sizes)), sizes)] = words.data
    return data, starts, sizes


def features_of(column: pa.Array, crc: PositionCrc, max_n: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of the column: the row of every word, and row and bucket of every run of 1 .. ``max_n`` words."""
    tail: Words | None = None
    for words in words_of(column):
        fresh = words.rows
        old = 0
        if words.continues and tail is not None:  # runs that reach over the cut
            old = len(tail)
            words = Words(
                np.concatenate([tail.data, words.data]), np.concatenate([tail.offsets, words.offsets[1:] + tail.offsets[-1]]),
                np.concatenate([tail.rows, words.rows]), True,
            )
        data, starts, sizes = _spaced(words)
        rows, buckets = [], []
        for n in range(1, max_n + 1):
            last = np.arange(max(n - 1, old), len(words))
            last = last[words.rows[last] == words.rows[last - n + 1]]
            if len(last):
                begin = starts[last - n + 1]
                rows.append(words.rows[last])
                buckets.append((crc(data, begin, starts[last] + sizes[last] - begin) % n_buckets).astype(np.int64))
        keep = max(len(words) - max_n + 1, 0)
        tail = Words(words.data[words.offsets[keep] :], words.offsets[keep:] - words.offsets[keep], words.rows[keep:], True)
        empty = np.zeros(0, dtype=np.int64)
        yield fresh, np.concatenate([*rows, empty]), np.concatenate([*buckets, empty])


def feature_counts(df: DataFrame, text: str, max_n: int, n_buckets: int) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has any. A null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, found = PositionCrc(), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for _, _, buckets in features_of(batch.column(0), crc, max_n, n_buckets):
                found += np.bincount(buckets, minlength=n_buckets)
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(found[hit])], names=["bucket", "n"])

    return df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, from the counts of raw (s, S) and target (t, T) features.

    ``n_buckets`` bounds what reaches the driver, whatever the size of the tables.
    """
    counts = []
    for found in (raw, target):
        one = np.zeros(n_buckets)
        for r in found.collect():
            one[r["bucket"]] = r["n"]
        counts.append(one)
    s, t = counts
    above, below = (t + 1.0) * (s.sum() + n_buckets), (s + 1.0) * (t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(above, below, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str, max_n: int) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` (sum of the gains of its features; 0 without any)."""
    shared, n_buckets = share(docs.sparkSession, "gains", gains), len(gains)
    kept = [c for c in docs.columns if c not in ("n_words", "n_features", "weight")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, gain = PositionCrc(), shared()
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for word_rows, rows, buckets in features_of(batch.column(n_kept), crc, max_n, n_buckets):
                words += np.bincount(word_rows, minlength=n)
                features += np.bincount(rows, minlength=n)
                np.add.at(weight, rows, gain[buckets])
            columns = [*batch.columns[:n_kept], pa.array(words), pa.array(features), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:n_kept], *added]))

    n_kept = len(kept)
    added = [pa.field(c, pa.int64()) for c in ("n_words", "n_features", "weight")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_weighed_text"))
    fields = rows.schema.fields[:n_kept]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields] + [f"{f.name} long" for f in added])
    return rows.mapInArrow(sums, schema)


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1,
    n_buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, carry: list[str] | None = None,
) -> DataFrame:
    """Columns ``key`` and ``carry`` of every row of ``docs`` with ``n_words, n_features, weight, score, rank``.

    ``score`` is the weight plus Gumbel noise that the seed and the key decide; of the N rows with at least ``min_words`` words the
    floor(N * percent / 100) highest scores are drawn, ties to the smaller key, and ranked from 1; the others have no rank. The
    sum of weights is exact in whole numbers, so the order of rows and partitions decides nothing.

    A null text has no feature and weight 0. A null key counts as the empty text in the noise and comes before all others in ties.
    Rows that repeat a key get equal noise and ranks of their own. An empty table, or an empty target, is no special case. Names
    of added columns must not be carried.
    """
    if not 1 <= n_buckets <= MAX_BUCKETS:
        raise ValueError(f"n_buckets must be 1 to {MAX_BUCKETS}")
    taken = set(carry or ()) & {key, "n_words", "n_features", "weight", "score", "rank"}
    if taken:
        raise ValueError(f"columns cannot be carried under these names: {sorted(taken)}")
    raw = feature_counts(docs, text, max_n, n_buckets)
    gains = bucket_gains(raw, feature_counts(target, target_text, max_n, n_buckets), n_buckets)
    rows = docs.select(key, *(carry or ()), F.col(text).alias("_resampled_text"))
    weighed = weigh(rows, gains, "_resampled_text", max_n).drop("_resampled_text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = write_once(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    drawn = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    able = number_rows(scored.where(F.col("n_words") >= min_words), [F.desc("score"), F.asc_nulls_first(key)], "_resampled_number")
    place = F.col("_resampled_number") + 1
    ranked = able.withColumn("rank", F.when(place <= drawn, place)).drop("_resampled_number")
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark, folder: str) -> DataFrame:
    """Weight, score and rank of every document; the target is the text of ``benchmark``. Null texts have no feature."""
    docs, target = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), n AS (
  SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL
), kinds AS (
  SELECT DISTINCT w, hex(encode(w)) AS h FROM n
), steps AS (
  SELECT w, h, 1 AS i, 4294967295::BIGINT AS c FROM kinds
  UNION ALL
  SELECT w, h, i + 2, xor(t[xor(c, ('0x' || substr(h, i, 2))::BIGINT) % 256 + 1], c >> 8) FROM steps, crc_table WHERE i < length(h)
), bucketed AS (
  SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM steps WHERE i > length(h)
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM n JOIN bucketed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts
), weights AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM n JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank, n_features AS n_words
FROM scored LEFT JOIN ranked USING (doc_id)
"""
