"""Best-fit packing of documents into sequences of fixed length, without conflicts inside a sequence.

Bins are ordered by their residual room and carry bitmaps of the sources and of the duplicate clusters they hold. A piece goes to
the tightest bin that fits: the search starts at the first bin with enough room and moves to its successors until one is compatible.
Documents are dealt to groups of bounded size by a hash of the whole row's key, so that a hot source or cluster is spread over all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import split_words, table
from buyerscope.storage import write_once

CAPACITY = 2_048
GROUP_ROWS = 4_096  # documents of one group, on average
PER_SOURCE = 2  # documents of one source that a sequence may hold


class Bins:
    """Open bins of one group, ordered by (residual, number); full bins are left out."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []  # per bin one bitmap for each document a source may add
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.count: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int, int]:
        """(bin, offset, position) of a piece; ``source`` and ``cluster`` are single bits, 0 for none."""
        top = self.per_source - 1
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            number = self.order[at][1]
            if not (self.sources[number][top] & source or self.clusters[number] & cluster):
                residual = self.order.pop(at)[0]
                break
            at += 1
        else:
            number, residual = len(self.used), self.capacity
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.used.append(0)
            self.count.append(0)
        for k, held in enumerate(self.sources[number]):
            if not held & source:
                self.sources[number][k] = held | source
                break
        self.clusters[number] |= cluster
        offset, position = self.used[number], self.count[number]
        self.used[number] += length
        self.count[number] += 1
        if residual > length:
            insort(self.order, (residual - length, number))
        return number, offset, position


def pack_group(lengths: list[int], sources: list, clusters: list, ties: list, capacity: int, per_source: int) -> list[tuple]:
    """(row, piece, bin, offset, position, length) for the documents of one group, longest pieces first.

    A document longer than the capacity gives full pieces with a bin each and a rest. Documents of length 0 get piece 0 with bin -1. A null
    source or cluster conflicts with nothing. Equal lengths go in the order of ``ties``.
    """
    bits: dict = {}
    source_bits = [0 if s is None else 1 << bits.setdefault(s, len(bits)) for s in sources]
    marks: dict = {}
    cluster_bits = [0 if c is None else 1 << marks.setdefault(c, len(marks)) for c in clusters]
    pieces = []
    for row, length in enumerate(lengths):
        for piece in range(max(1, -(-length // capacity))):
            pieces.append((-min(capacity, length - piece * capacity), ties[row], row, piece))
    bins, out = Bins(capacity, per_source), []
    for negative, _, row, piece in sorted(pieces):
        if not negative:
            out.append((row, piece, -1, 0, 0, 0))
        else:
            out.append((row, piece, *bins.place(-negative, source_bits[row], cluster_bits[row]), -negative))
    return out


PACKED = "piece int, group long, bin long, bin_offset long, bin_position int, n_tokens long"


def pack(
    docs: DataFrame, length: Column, cluster: Column, source: str = "source", doc_id: str = "doc_id", capacity: int = CAPACITY,
    per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, group, bin, bin_offset, bin_position, n_tokens``; (group, bin) names a sequence.

    No sequence holds two pieces of one cluster, nor more than ``per_source`` of one source. Every document gets at least one row. Null lengths
    count as 0; null sources and clusters conflict with nothing. Rows are dealt by a hash of id, cluster and length; rows equal in
    all of these share a group, and their places are interchangeable. An empty table gives no rows.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be positive")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.alias("cluster"),
        F.coalesce(length, F.lit(0)).cast("long").alias("n"),
    ).withColumn("tie", F.xxhash64("doc_id", "cluster", "n"))
    rows = write_once(rows, "lengths")
    groups = max(1, -(-rows.count() // group_rows))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(table_: pa.Table) -> pa.Table:
        order = np.lexsort((table_["tie"].to_numpy(), table_["n"].to_numpy()))
        table_ = table_.take(pa.array(order))
        group = table_["group"][0].as_py()
        got = pack_group(*(table_[c].to_pylist() for c in ("n", "source", "cluster", "tie")), capacity, per_source)
        row, piece, number, offset, position, size = (np.array(x, dtype=np.int64) for x in zip(*got, strict=True))
        return pa.table(
            {
                "doc_id": table_["doc_id"].take(pa.array(row)), "piece": piece.astype(np.int32), "group": np.full(len(row), group),
                "bin": number, "bin_offset": offset, "bin_position": position.astype(np.int32), "n_tokens": size,
            }
        )

    dealt = rows.withColumn("group", F.pmod("tie", F.lit(groups).cast("long")))
    return dealt.groupBy("group").applyInArrow(run, f"doc_id {kind}, {PACKED}")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: ``group, bin, n_tokens, members`` (doc_id, piece and offset in order). Bins hold a bounded number of pieces."""
    member = F.struct("bin_offset", "bin_position", "doc_id", "piece", "n_tokens")
    return packed.where("bin >= 0").groupBy("group", "bin").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(member)).alias("members")
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """``pack`` with word counts as lengths and equal texts as clusters."""
    return pack(docs, F.size(split_words(F.col("text"))), F.md5("text"), **options)


def op5_best_fit_packing(spark, folder: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack_documents(table(spark, folder, "documents").select("doc_id", "text", "source"))
