"""Prefix trie of conversations: count-min screening of prefix digests, exact grouping of the prefixes that may be shared.

Every turn becomes a digest; a prefix is the XOR of the hashes of (depth, turn) up to its depth, 128 bits wide, so prefixes of long
conversations are running values that segments of 4,096 turns compute on their own. A count-min sketch of all prefix digests
never counts too little: an estimate of one proves that no other conversation shares the prefix, nor any longer one of this
conversation. Those tails become nodes where they lie; only the other prefixes are shuffled and grouped by digest.

Sums over subtrees need no walk down the trie: a node's smallest member stands for it, so a node's value is added to the prefixes of
that one conversation, and each prefix group adds up what its members bring.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope.llm.common import share, table
from buyerscope.llm.numbering import number_rows
from buyerscope.storage import write_once

SEGMENT = 4_096  # turns of one conversation that a task handles together
ID_BITS = 16  # ids of one end node are joined in blocks of 2^16 neighbouring numbers
SKETCH_ROWS = 4
SKETCH_WIDTH = (1 << 12, 1 << 24)  # bounds of the counters per sketch row; four counters a prefix between them
SKETCH_BLOCK = 1 << 15  # counters of one block of the sketch as it is merged

EMPTY_SHA256 = sha256(b"").hexdigest()


def head_turns(conv_id: Column) -> Column:
    """Number of leading turns that a conversation takes over: CRC-32 of its decimal id modulo 6."""
    return (F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % 6).cast("long")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations ``conv_id, total``; turns ``conv_id, depth, mark, size, total``) after every conversation got its new head.

    Own turns are ordered by turn, null first, equal turns by their digest; each conversation starts with the first h turns of
    conversation c - c % 100 and goes on with its own turns after the h-th. ``mark`` is the digest of role and text, ``size`` the
    code points of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
        F.length(text).cast("long").alias("size"),
    )
    own = number_rows(slim, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("mark")], "number")
    lengths = own.groupBy("conv_id").agg(F.min("number").alias("first"), F.count("*").alias("n_own"))
    lengths = lengths.withColumn("head", head_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = lengths.where("conv_id = base").select("base", F.col("n_own").alias("n_base"))
    conversations = write_once(
        lengths.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0))))
        .withColumn("total", F.col("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))),
        "conversations",
    )
    placed = own.join(conversations.select("conv_id", "first", "head", "taken", "total"), "conv_id").withColumn("at", F.col("number") - F.col("first"))
    rest = placed.where("at >= head").select("conv_id", (F.col("taken") + F.col("at") - F.col("head") + 1).alias("depth"), "mark", "size", "total")
    # At most five turns of every hundredth conversation, each for at most a hundred others.
    heads = placed.where("conv_id % 100 = 0 and at < 5").select(F.col("conv_id").alias("base"), "at", "mark", "size")
    taken = (
        conversations.select("conv_id", "base", "taken", "total").join(heads, "base").where("at < taken")
        .select("conv_id", (F.col("at") + 1).alias("depth"), "mark", "size", "total")
    )
    return conversations.select("conv_id", "total"), rest.unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, total, size, x, y, px, py``: digest of the first ``depth`` turns and of one turn less, by conversation and depth."""
    part = F.floor((F.col("depth") - 1) / SEGMENT).cast("long")
    marked = turns.withColumn("segment", part).withColumn("hx", F.xxhash64(F.lit(1), "depth", "mark")).withColumn("hy", F.xxhash64(F.lit(2), "depth", "mark"))
    sums = marked.where(F.col("total") > SEGMENT).groupBy("conv_id", "segment").agg(F.bit_xor("hx").alias("ox"), F.bit_xor("hy").alias("oy"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "segment", F.bit_xor("ox").over(before).alias("ox"), F.bit_xor("oy").over(before).alias("oy"))
    inside = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    # Offsets join before the window, so that the rows stay in its order when they are written.
    run = marked.drop("mark").join(offsets, ["conv_id", "segment"], "left")
    x = F.bit_xor("hx").over(inside).bitwiseXOR(F.coalesce("ox", F.lit(0)))
    y = F.bit_xor("hy").over(inside).bitwiseXOR(F.coalesce("oy", F.lit(0)))
    return run.withColumns({"x": x, "y": y}).select(
        "conv_id", "depth", "total", "size", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py")
    )


def sketch_slots(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Counter of every digest in each row of the sketch: (rows, digests); ``width`` is a power of two."""
    a, b = x.astype(np.uint64), y.astype(np.uint64) | np.uint64(1)
    return np.stack([((a + b * np.uint64(k)) >> np.uint64(20)) % np.uint64(width) for k in range(SKETCH_ROWS)]).astype(np.int64)


def shared_plane(digests: DataFrame, n_rows: int, bounds: tuple[int, int] = SKETCH_WIDTH) -> np.ndarray:
    """Count-min sketch of the digests ``x, y``, as bits: (sketch rows, width), set where a counter is two or more.

    Counters stop at two, which is all that the screening asks. Each task sends the blocks that it has touched, packed;
    tasks merge them block by block as a stream. The result is bounded by ``bounds`` (8 MB); beyond some 4 million
    prefixes counters are shared by more and more of them, so fewer singletons are proven, and nothing else changes.
    """
    width = 1 << int(np.clip(np.ceil(np.log2(max(4 * n_rows, 1))), *np.log2(bounds).astype(int)))
    block = min(SKETCH_BLOCK, width)
    n_blocks = width // block

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_ROWS * width, dtype=np.uint8)
        for batch in batches:
            slots = sketch_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), width)
            flat, n = np.unique(slots + (np.arange(SKETCH_ROWS) * width)[:, None], return_counts=True)
            counts[flat] = np.minimum(counts[flat] + np.minimum(n, 2), 2)
        table_ = counts.reshape(-1, block)
        for number in np.flatnonzero(table_.any(axis=1)).tolist():
            planes = np.packbits(table_[number] >= 1).tobytes() + np.packbits(table_[number] == 2).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([planes], pa.binary())], names=["block", "planes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = np.frombuffer(planes, dtype=np.uint8).reshape(2, -1)
                if number in merged:
                    before = merged[number]
                    merged[number] = [before[0] | one, before[1] | two | (before[0] & one)]
                else:
                    merged[number] = [one, two]
        for number, (_, two) in merged.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([two.tobytes()], pa.binary())], names=["block", "planes"])

    blocks = digests.select("x", "y").mapInArrow(build, "block long, planes binary")
    spread = min(SKETCH_ROWS * n_blocks, digests.sparkSession.sparkContext.defaultParallelism)
    merged = blocks.repartition(spread, "block").mapInArrow(merge, "block long, planes binary")
    plane = np.zeros((SKETCH_ROWS * n_blocks, block // 8), dtype=np.uint8)
    for r in merged.collect():  # at most 8 MB
        plane[r["block"]] = np.frombuffer(r["planes"], dtype=np.uint8)
    return plane.reshape(SKETCH_ROWS, width // 8)


def screen(found: DataFrame, plane: np.ndarray) -> DataFrame:
    """``found`` (prefixes in order) with ``alone``: proven to belong to one conversation, and ``top``: the prefix above is not known to be.

    A prefix is alone if a counter of it is below two, or if the row before it is the prefix above and alone.
    """
    shared, width = share(found.sparkSession, "sketch", plane), plane.shape[1] * 8

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared()
        last = (None, 0, False)  # conversation, depth, alone
        for batch in batches:
            conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            slots = sketch_slots(batch.column("x").to_numpy(), batch.column("y").to_numpy(), width)
            twice = (bits[np.arange(SKETCH_ROWS)[:, None], slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            proven = ~twice.all(axis=0)
            goes_on = np.zeros(len(conv), dtype=bool)
            goes_on[1:] = (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1)
            if len(conv):
                goes_on[0] = last[0] == conv[0] and last[1] + 1 == depth[0]
                start = np.maximum.accumulate(np.where(goes_on, -1, np.arange(len(conv))))
                hit = np.maximum.accumulate(np.where(proven, np.arange(len(conv)), -1))
                alone = np.where(start < 0, (hit >= 0) | last[2], hit >= start)
                above = np.concatenate([[last[2]], alone[:-1]]) & goes_on
                last = (conv[-1], depth[-1], bool(alone[-1]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(alone), pa.array(alone & ~above)], names=[*batch.schema.names, "alone", "top"]
                )

    return found.mapInArrow(look, ", ".join(f"{c} long" for c in found.columns) + ", alone boolean, top boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """``x, y, depth, ends_sha256`` of all nodes where conversations ``conv_id`` end: SHA-256 of their ids, ascending, comma-joined.

    Ids are joined in blocks of neighbouring numbers; a node with several blocks is hashed as a stream of blocks in order.
    """
    node, block = ["x", "y", "depth"], F.shiftright("conv_id", ID_BITS).alias("block")
    joined = ends.groupBy(*node, block).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    joined = write_once(joined, "end_blocks")
    several = joined.groupBy(*node).agg(F.count("*").alias("blocks")).where("blocks > 1").drop("blocks")
    single = joined.join(several, node, "left_anti").select(*node, F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([running.hexdigest()])], names=[*node, "ends_sha256"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in [*node, "ids"]), strict=True)
            for x, y, depth, ids in rows:
                if key == (x, y, depth):
                    running.update(b",")
                else:
                    if key is not None:
                        yield out()
                    key, running = (x, y, depth), sha256()
                running.update(ids.encode())
        if key is not None:
            yield out()

    streams = joined.join(several, node, "left_semi").repartition(*node).sortWithinPartitions(*node, "block").select(*node, "ids")
    return single.unionByName(streams.mapInArrow(digest, "x long, y long, depth long, ends_sha256 string"))


def _sums_below(chains: DataFrame) -> DataFrame:
    """``chains`` (``conv_id, depth, saved, total``) with ``below``: sum of ``saved`` of the same conversation at this depth or deeper."""
    # The root lies in the first segment.
    cut = chains.withColumn("segment", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / SEGMENT).cast("long"))
    sums = cut.where(F.col("total") > SEGMENT).groupBy("conv_id", "segment").agg(F.sum("saved").alias("later"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("conv_id", "segment", F.sum("later").over(deeper).alias("later"))
    inside = Window.partitionBy("conv_id", "segment").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("saved").over(inside) + F.coalesce("later", F.lit(0))
    return cut.join(later, ["conv_id", "segment"], "left").withColumn("below", below).drop("segment", "later")


def prefix_trie(turns: DataFrame, sketch: tuple[int, int] = SKETCH_WIDTH) -> DataFrame:
    """All nodes of the trie over the rebuilt conversations of ``turns`` (``conv_id, turn, role, text``; other columns are ignored).

    A node is a distinct sequence of the first ``depth`` turns; ``conv_id`` is its smallest member, which with the depth names it.
    ``n_convs`` members, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256`` of the members that end there.

    A null role or text counts as empty. Rows without ``conv_id`` belong to no conversation. Null turns come
    first, equal turns in the order of their digest, repeated rows are turns of their own. Texts are read whole. The root has depth 0 and no
    parent; conversations without turns end there. An empty table has no nodes.
    """
    conversations, rebuilt = rebuilt_turns(turns)
    found = write_once(prefixes(rebuilt), "prefixes")
    screened = write_once(screen(found, shared_plane(found, found.count(), sketch)), "screened")
    root = conversations.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit(0).cast("long").alias("size"),
        *(F.lit(0).cast("long").alias(c) for c in ("x", "y", "px", "py")),
    )
    possible = screened.where("not alone").drop("alone", "top").unionByName(root)
    alone = screened.where("alone")

    # Nodes of prefixes that may be shared, by digest: partial sums come before the shuffle.
    node = ["x", "y", "depth"]
    nodes = write_once(
        possible.groupBy(*node).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
            F.min_by("total", "conv_id").alias("total"), F.min("px").alias("px"), F.min("py").alias("py"),
        ),
        "nodes",
    )
    tops = alone.where("top").select("conv_id", "depth", "total", "px", "py")
    up = [F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").select(*up).unionByName(tops.select(*up)).groupBy(*node).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))

    def with_parent(df: DataFrame) -> DataFrame:
        # A prefix whose upper neighbour is no possible node hangs below a prefix that is alone: its own conversation.
        named = df.join(parents, ["px", "py", "depth"], "left")
        return named.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))).drop("parent")

    full = with_parent(nodes).join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).drop("px", "py", "size")
    full = write_once(full, "full_nodes")

    # What each conversation brings to the prefixes above the nodes that it stands for.
    chains = full.select("conv_id", "depth", "saved", ((F.col("depth") == F.col("total")) & (F.col("n_children") == 0)).cast("long").alias("leaf"))
    tails = alone.select("conv_id", "depth", F.lit(0).cast("long").alias("saved"), (F.col("depth") == F.col("total")).cast("long").alias("leaf"))
    brought = chains.unionByName(tails).groupBy("conv_id").agg(
        F.sum("saved").alias("saved"), F.max("leaf").alias("leaf"), F.min("depth").alias("first_depth")
    ).where("saved > 0 or leaf > 0")
    others = (
        possible.select("conv_id", *node).join(brought, "conv_id").where("depth < first_depth")
        .groupBy(*node).agg(F.sum("saved").alias("others_saved"), F.sum("leaf").alias("others_leaves"))
    )
    own_leaf = brought.select("conv_id", "leaf")
    summed = _sums_below(full).join(own_leaf, "conv_id", "left").join(others, node, "left")
    ended = end_digests(possible.where("depth = total").select("conv_id", *node))
    shared = summed.join(ended, node, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.coalesce("leaf", F.lit(0)) + F.coalesce("others_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("below") + F.coalesce("others_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    lower = alone.where("not top").select("conv_id", "depth", "total", F.col("conv_id").alias("parent_conv_id"))
    ends_here, one, none = F.col("depth") == F.col("total"), F.lit(1).cast("long"), F.lit(0).cast("long")
    tail = with_parent(tops).select("conv_id", "depth", "total", "parent_conv_id").unionByName(lower).select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(ends_here, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(ends_here, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    return shared.unionByName(tail)


def op11_conversation_trie(spark, folder: str) -> DataFrame:
    """Every node of the prefix trie over all conversations; null roles and texts are empty, an empty table gives no nodes."""
    return prefix_trie(table(spark, folder, "conversations"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), sizes AS (
  SELECT conv_id, count(*) AS n_own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), steps AS (
  SELECT conv_id, conv_id::VARCHAR AS w, 1 AS i, 4294967295::BIGINT AS c FROM sizes
  UNION ALL
  SELECT conv_id, w, i + 1, xor(t[xor(c, ascii(substr(w, i, 1))) % 256 + 1], c >> 8) FROM steps, crc_table WHERE i <= length(w)
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM steps WHERE i > length(w)
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT h.conv_id, base, h, least(h, coalesce(b.n_own, 0)) AS taken, least(h, coalesce(b.n_own, 0)) + greatest(s.n_own - h, 0) AS total
  FROM heads h JOIN sizes s USING (conv_id) LEFT JOIN sizes b ON b.conv_id = h.base
), turns AS (
  SELECT c.conv_id, i AS d, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND i <= taken
  UNION ALL
  SELECT c.conv_id, taken + i - h, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND i > h
), members AS (
  SELECT conv_id, d, length(text) AS size, md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), ',')
    OVER (PARTITION BY conv_id ORDER BY d)) AS p FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT m.d, p, min(m.conv_id) AS rep, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (total = m.d), '')) AS ends_sha256
  FROM members m JOIN convs c USING (conv_id) GROUP BY m.d, p
), linked AS (
  SELECT n.*, a.p AS above FROM nodes n LEFT JOIN members a ON a.conv_id = n.rep AND a.d = n.d - 1
), kids AS (
  SELECT d - 1 AS d, above AS p, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.d = l.d AND k.p = l.p
), below AS (
  SELECT m.d, m.p, sum((f.n - 1) * f.size) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM full_nodes f JOIN members m ON m.conv_id = f.rep AND m.d <= f.d GROUP BY m.d, m.p
)
SELECT f.rep AS conv_id, f.d AS depth, u.rep AS parent_conv_id, f.n AS n_convs, f.n_children::BIGINT AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.d = f.d AND b.p = f.p LEFT JOIN nodes u ON u.d = f.d - 1 AND u.p = f.above
"""
