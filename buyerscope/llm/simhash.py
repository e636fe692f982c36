"""SimHash near-duplicates: 64-bit fingerprints linked by a Gray-ordered hierarchical index.

Fingerprints within ``d`` bits agree on one of ``d + 1`` bit blocks, so each fingerprint is dealt to ``d + 1`` cells by (block,
value). Inside a cell they are sorted by Gray rank; runs of neighbours form nodes that hold the bits all members share, and
nodes form upper nodes in the same way. A search walks down, adds the differences a node's own shared bits settle, and drops
whole groups once more than ``d`` differ. Cells of very many fingerprints are dealt again by the blocks of their other bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import free_names, table
from buyerscope.llm.components import connected_components, merge_links
from buyerscope.storage import write_once

FAN_OUT = 8
CELL_ROWS = 4_096  # larger cells are dealt again
FRONTIER = 2_000_000  # (query, node) pairs that a search holds at once, about
SEED = 42


def fingerprint_of(text: bytes, shingle: int) -> int:
    """Fingerprint of one UTF-8 text; 0 if it has no word."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_key, fp`` (signed 64 bits, the first a hash of the text) of every row; null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_of(x, shingle) if x else 0 for x in batch.column(1).cast(pa.binary()).to_pylist()]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed)], names=["doc_id", "text_key", "fp"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return docs.select(doc_id, text, F.xxhash64(text)).mapInArrow(compute, f"doc_id {kind}, text_key long, fp long")


def _levels(values: np.ndarray, cells: np.ndarray) -> list[tuple]:
    """Index over values sorted by (cell, Gray rank), from leaves to roots: (shared bits, their values, first child, children).

    Runs of ``FAN_OUT`` neighbours of one cell share a parent until every cell has a single root.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    mask, value, owner = np.full(len(values), full), values, cells
    levels = [(mask, value, np.arange(len(values)), np.ones(len(values), dtype=np.int64))]
    while True:
        first_of_cell = np.concatenate([[True], owner[1:] != owner[:-1]])
        if first_of_cell.all():
            return levels
        starts = np.flatnonzero(first_of_cell)
        inside = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        heads = np.flatnonzero(inside % FAN_OUT == 0)
        ones = np.bitwise_and.reduceat(value & mask, heads)
        zeros = np.bitwise_and.reduceat(~value & mask, heads)
        mask, value, owner = ones | zeros, ones, owner[heads]
        levels.append((mask, value, heads, np.diff(np.append(heads, len(inside)))))


def linked_pairs(values: np.ndarray, cells: np.ndarray, distance: int) -> Iterator[tuple]:
    """Positions (i, j), i < j, of values of one cell that differ in at most ``distance`` bits, block by block.

    Both arrays are sorted by (cell, Gray rank). A block holds as many queries as bounded memory allows for the largest cell.
    """
    levels = _levels(values, cells)
    roots = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(roots, len(cells)))
    root_of = np.repeat(np.arange(len(roots)), sizes)
    block = int(np.clip(FRONTIER // sizes.max(), 16, 20_000))
    for start in range(0, len(values), block):
        query = np.arange(start, min(start + block, len(values)))
        node, spent = root_of[query], np.zeros(len(query), dtype=np.uint8)
        settled = np.zeros(len(query), dtype=np.uint64)  # bits that ancestors have compared
        for depth in range(len(levels) - 1, -1, -1):
            mask, value, first, children = levels[depth]
            spent = spent + np.bitwise_count((values[query] ^ value[node]) & mask[node] & ~settled)
            alive = spent <= distance
            query, node, spent, settled = query[alive], node[alive], spent[alive], mask[node[alive]]
            if depth:
                times, begin = children[node], first[node]
                query, spent, settled = np.repeat(query, times), np.repeat(spent, times), np.repeat(settled, times)
                offsets = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                node = np.repeat(begin, times) + offsets
                if depth == 1:  # leaves: each pair once
                    later = node > query
                    query, node, spent, settled = query[later], node[later], spent[later], settled[later]
        later = node > query
        yield query[later], node[later]


def cell_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows ``cell, fp``: a spanning forest per cell, never all of its pairs.

    Rows arrive sorted by (cell, Gray rank); complete cells are searched together, the last one waits for its rest.
    """

    def search(cells: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        parent = np.arange(len(values))
        for left, right in linked_pairs(values, cells, distance):
            parent = merge_links(parent, left, right)
        rows = np.flatnonzero(parent != np.arange(len(parent)))
        signed = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[rows]), pa.array(signed[parent[rows]])], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = np.searchsorted(cells, cells[-1])  # the last cell may go on
        if cut and (cut + sum(len(x) for x, _ in held)) >= 50_000:
            held.append((cells[:cut], values[:cut]))
            yield search(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(cells[cut:], values[cut:])]
        else:
            held.append((cells, values))
    if held:
        yield search(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _blocks(parts: int, bits: list[int]) -> list[list[int]]:
    """``bits`` cut into ``parts`` even runs."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def fingerprint_links(distinct: DataFrame, distance: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``u, v`` that connect exactly the fingerprints (``fp``, distinct) linked by at most ``distance`` bits."""
    parts = _blocks(distance + 1, list(range(64)))
    first = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("bits")) for i, bits in enumerate(parts)
    ]
    dealt = distinct.select("fp", F.explode(F.array(*first)).alias("c")).select("fp", "c.part", "c.bits")
    large = dealt.groupBy("part", "bits").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).withColumn("large", F.lit(True))
    marked = dealt.join(large.drop("n"), ["part", "bits"], "left")
    # A large cell's fingerprints agree on its block; of their other bits one sub-block agrees as well.
    again = F.array(
        *[
            F.when(
                F.col("part") == i,
                F.array(
                    *[
                        F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(F.lit(_mask(sub))).alias("sub_bits"))
                        for k, sub in enumerate(_blocks(distance + 1, [b for b in range(64) if b not in bits]))
                    ]
                ),
            )
            for i, bits in enumerate(parts)
        ]
    )
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_bits")))
    keys = marked.select(
        "fp", "part", "bits", F.explode(F.when(F.col("large"), F.get(again, F.col("part"))).otherwise(whole)).alias("s")
    ).select("fp", F.xxhash64("part", "bits", "s.sub", "s.sub_bits").alias("cell"))
    # Cells whose hashes collide are searched together: more to compare, the same links.
    ranked = keys.withColumn("rank", _gray_rank(F.col("fp")))
    ordered = ranked.repartition("cell").sortWithinPartitions("cell", "rank").select("cell", "fp")
    return ordered.mapInArrow(lambda batches: cell_links(batches, distance), "u long, v long")


def _gray_rank(fp):
    """Gray rank of a signed fingerprint, as a sortable number."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` of every row.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest id reachable (null only if all ids of
    the component are null). Equal texts, null and empty texts (fingerprint 0) link with each other; repeated rows come out as often as they go in.
    Copies are collapsed to one fingerprint before anything is compared, and the comparison returns a spanning forest only.
    """
    return _grouped(docs, shingle, distance).drop("component")


def _grouped(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``near_duplicates`` with ``component``, the group's smallest fingerprint: two groups may have the same smallest id."""
    marked = write_once(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(fingerprint_links(distinct.select("fp"), distance))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = write_once(named, "fingerprint_parts")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id", "component")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each group, the one with the smallest id, in the columns of ``docs``.

    Rows of a group that repeat the surviving id are one document and leave one row; a group whose ids are all null leaves one row per text.
    An id with different texts in several groups stays once in each group of which it is the smallest.
    """
    found = _grouped(docs, shingle, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    doc, text, part, own, nameless = free_names(docs, "near_doc", "near_text", "near_part", "near_own", "near_nameless")
    kept = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), F.col("component").alias(part)).distinct()
    marked = docs.withColumn(own, F.xxhash64("text"))
    # Equal texts have equal fingerprints, so that a row meets one group at most.
    stay = marked.join(kept, marked["doc_id"].eqNullSafe(kept[doc]) & (marked[own] == kept[text]))
    # Texts with the surviving id belong to one document each; a null id says nothing about that.
    one = stay.withColumn(nameless, F.when(F.col("doc_id").isNull(), F.col(own))).dropDuplicates([part, "doc_id", nameless])
    return one.drop(doc, text, part, own, nameless)


def op8_simhash_gray_index(spark, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
