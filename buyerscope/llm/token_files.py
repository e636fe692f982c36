"""Token-id files: documents in ascending id order, in blocks compressed by Re-Pair grammars.

A file is a Parquet file written through Spark's commit protocol, with one row per block (the shard of the grammar): its place, the
documents it holds, and four little-endian buffers: rules (pairs of symbols), their expansion lengths, the compressed sequence
and the documents' lengths. A document is found by the running sum of its block's expansion lengths and expanded alone.

Re-Pair: the pairs of neighbouring symbols are counted over the whole block, the frequent ones get a new symbol and are replaced, and
so on. One round replaces many pairs at once, the most frequent first come first in the rules. The end id is never part of a rule, so
that no symbol reaches across documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buyerscope.llm.common import table, worker_cache
from buyerscope.storage import shared_root

END_ID = 1
BLOCK_IDS = 2_000_000  # a block is closed once it holds so many ids
ROUNDS = 5
BROADCAST_BLOCKS = 500_000  # three numbers each: under 20 MB
SYMBOLS = 1 << 16  # symbols below this number take two bytes
SLOT_BITS = 20
MIN_COUNT = 8  # a pair seen less often gets no rule
CACHE_WORDS = 1_000_000  # words a worker remembers, at most
RUNS = 512  # letter runs encoded in one text
SLICE_BYTES = 8_000_000  # text encoded at a time
GATHERED = 1_000_000  # words or symbols expanded at a time
WORD_CHARS = 64  # longer words are encoded again instead of remembered
# Letters whose lower-case form is one letter of the same kind and needs no composition, then marks of which none can join them.
SIMPLE = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#*$%&]*)|.*)$", re.MULTILINE).findall


class WordEncoder:
    """Ids of whole texts through the tokenizers library, word by word.

    The tokenizer's own rules split at white space and treat every stretch between on its own, so that the ids of a text are those of its
    words in turn, and frequent words need not be encoded again. That is checked for the tokenizer at hand: it must split at
    white space and add nothing; otherwise whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        # Letter runs reach this one in their normal form already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        split = next((x for x in pre.get("pretokenizers", [pre]) if x.get("type") == "Split"), {})
        specials = spec.get("added_tokens", [])
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)
        self.by_word = (
            split.get("behavior") == "Removed" and split.get("invert") is True and r"[^\s" in split.get("pattern", {}).get("Regex", "")
            and not any(x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in specials)
        )

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn_runs(self, runs: list[str]) -> None:
        """Remember runs of letters; many go into one text, as the token that ends a word shows where each run ends."""
        for start in range(0, len(runs), RUNS):
            part = runs[start : start + RUNS]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                whole, last = ids.tobytes(), 0
                for run, cut in zip(part, (cuts * 4).tolist(), strict=True):
                    self.known[run] = whole[last:cut]
                    last = cut
            else:
                self.known.update(zip(part, self._encode(part), strict=True))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Remember new words and return their ids. A word of letters and closing marks is the sum of its letter run and its marks."""
        known, found = self.known, SIMPLE("\n".join(words)) if words else []  # words hold no line feeds
        lows = [letters.lower() for letters, _ in found]
        rest = [word for word, low in zip(words, lows, strict=True) if not low]
        rest += {marks for letters, marks in found if letters}.difference(known)
        self._learn_runs(list(set(lows).difference(known, ("",))))
        known.update(zip(rest, self._encode(rest), strict=True))
        known[""] = b""
        out = []
        for word, low, (_, marks) in zip(words, lows, found, strict=True):
            ids = known[low or word]
            if marks:
                ids += known[marks]
            if marks or low != word:
                known[word] = ids
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and their number in each text. Every distinct word is looked up once."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(known.get, words))
        new = [i for i, ids in enumerate(parts) if ids is None]
        short = [i for i in new if len(words[i]) <= WORD_CHARS]
        long = [i for i in new if len(words[i]) > WORD_CHARS]
        for some, learn in ((short, self._learn), (long, self._encode)):
            for i, ids in zip(some, learn([words[i] for i in some]) if some else [], strict=True):
                parts[i] = ids
        pool, sizes = np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        places, starts = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[places])])
        ids = [_gather(pool, starts, sizes, places[i : i + GATHERED]) for i in range(0, len(places), GATHERED)]
        upto = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.diff(ends[upto], prepend=0)


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The entries of ``pool`` that the given places stand for, one place after the other."""
    counts = sizes[places]
    upto = np.cumsum(counts)
    return pool[np.repeat(starts[places] - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)]


def _places(joined: np.ndarray, inner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where one of the pairs stands, and which one. One table of hashes finds nearly all; pairs that lost their slot are searched."""
    mixed = _slots(joined)
    table_ = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    own = _slots(pairs)
    table_[own] = np.arange(len(pairs))
    at = np.flatnonzero((table_[mixed] >= 0) & inner)
    rank = table_[mixed[at]]
    exact = pairs[rank] == joined[at]
    lost = np.flatnonzero(table_[own] != np.arange(len(pairs)))
    if len(lost):
        order = lost[np.argsort(pairs[lost])]
        rest = np.flatnonzero(~exact)
        found = np.minimum(np.searchsorted(pairs[order], joined[at[rest]]), len(order) - 1)
        rank[rest] = order[found]
        exact[rest] = pairs[rank[rest]] == joined[at[rest]]
    return at[exact], rank[exact]


def _slots(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint64:
        return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return (pairs * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)


def re_pair(
    ids: np.ndarray, first_symbol: int, barrier: int = END_ID, rounds: int | None = ROUNDS, min_count: int = MIN_COUNT, symbols: int = SYMBOLS
) -> tuple:
    """``(rules, lengths, sequence)`` of a block: rule k stands for symbol ``first_symbol + k`` and names two earlier symbols.

    Symbols stay below ``symbols`` where the vocabulary allows: 65,536 gives two bytes each. ``rounds`` shares the symbols out over so many rounds;
    with None each round replaces the pairs at least half as frequent as the most frequent one, until no pair is left that is seen
    ``min_count`` times or no symbol is free.
    """
    room = max(symbols, 1 << 16) - first_symbol if first_symbol < max(symbols, 1 << 16) else 1 << 14
    wide = first_symbol + room > 1 << 16
    sequence = ids.astype(np.uint32)
    rules = np.empty((0, 2), dtype=np.uint32)
    lengths = np.empty(0, dtype=np.uint32)
    left = rounds
    while left is None or left:
        if len(sequence) < 2 or not room:
            break
        a, b = sequence[:-1], sequence[1:]
        joined = (a.astype(np.uint64) << np.uint64(32) | b) if wide else a << np.uint32(16) | b
        inner = (a != barrier) & (b != barrier)
        ordered = np.sort(joined[inner])
        if not len(ordered):
            break
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(heads, len(ordered)))
        frequent = np.flatnonzero(counts >= (min_count if left else max(min_count, counts.max() / 2)))
        take = min(len(frequent), room // (left or 1))
        if not take:
            break
        best = frequent[np.argsort(-counts[frequent], kind="stable")[:take]]
        pairs = ordered[heads[best]]
        shift = np.uint64(32) if wide else np.uint32(16)
        low = (1 << int(shift)) - 1
        at, rank = _places(joined, inner, pairs)
        # Of overlapping places in a row every second one is replaced.
        run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        at, rank = at[place % 2 == 0], rank[place % 2 == 0]
        symbol = (first_symbol + len(rules) + rank).astype(np.uint32)
        sequence = sequence.copy()
        sequence[at] = symbol
        keep = np.ones(len(sequence), dtype=bool)
        keep[at + 1] = False
        new = np.stack([pairs >> shift, pairs & pairs.dtype.type(low)], axis=1).astype(np.uint32)
        known = np.concatenate([np.ones(first_symbol, dtype=np.uint32), lengths])
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, known[new[:, 0]] + known[new[:, 1]]])
        sequence = sequence[keep]
        room -= take
        left = left and left - 1
    return rules, lengths, sequence


def expand(rules: np.ndarray, sequence: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that a sequence stands for, gathered from one table of all expansions."""
    phrases: list[bytes] = []
    of = lambda x: phrases[x - first_symbol] if x >= first_symbol else x.to_bytes(4, "little")
    for a, b in rules.tolist():
        phrases.append(of(a) + of(b))
    pool = np.concatenate([np.arange(first_symbol, dtype="<u4"), np.frombuffer(b"".join(phrases), dtype="<u4")])
    sizes = np.concatenate([np.ones(first_symbol, np.int64), np.fromiter(map(len, phrases), np.int64, len(phrases)) // 4])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([np.empty(0, "<u4"), *(_gather(pool, starts, sizes, sequence[i : i + GATHERED]) for i in range(0, len(sequence), GATHERED))])


BLOCK_SCHEMA = (
    "part int, block int, first_symbol int, n_docs int, n_ids long, doc_ids array<long>, doc_lengths array<long>, width int, "
    "rules binary, lengths binary, sequence binary"
)


def _block(part: int, number: int, first_symbol: int, held: list[tuple], options: dict) -> tuple:
    """One row of a file from ``(ids of documents, their sizes, their token ids)`` of some runs of documents."""
    sizes, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    rules, lengths, sequence = re_pair(ids, first_symbol, **options)
    width = 2 if first_symbol + len(rules) <= 1 << 16 else 4
    pack = lambda x: x.astype(f"<u{width}").tobytes()
    return (
        part, number, first_symbol, len(sizes), len(ids), [d for x in held for d in x[0]], sizes.tolist(), width,
        pack(rules), lengths.astype("<u4").tobytes(), pack(sequence),
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``SLICE_BYTES`` of text; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def write_token_files(
    docs: DataFrame, tokenizer_path: str | None, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, rounds: int | None = ROUNDS,
    symbols: int = SYMBOLS,
) -> None:
    """Encode ``doc_id, text`` and write the ids, an ``end_id`` after each document, to ``path`` in ascending id order.

    Null texts count as empty and have the end id alone. Null ids come first; rows that repeat an id follow each other in the order of their texts'
    hashes, so that one frequent id does not fall to one task. An empty table gives an empty file. ``rounds`` and ``symbols`` go to ``re_pair``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        opened = tokenizer_path or default_tokenizer()  # looked up where it is used
        encoder = worker_cache("tokenizer", opened, lambda: WordEncoder(opened))
        first_symbol = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        options = {"barrier": end_id, "rounds": rounds, "symbols": symbols}

        def rows(found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

        for whole in batches:
            for batch in _slices(whole):
                names = batch.column(0).to_pylist()
                ids, counts = encoder.encode(batch.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(np.uint32)
                counts, ends, low = counts + 1, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), 0
                while low < len(names):
                    # A block ends with the document that fills it.
                    high = min(int(np.searchsorted(ends, ends[low] + block_ids - size)), len(names))
                    held.append((names[low:high], counts[low:high], ids[ends[low] : ends[high]]))
                    size, low = size + int(ends[high] - ends[low]), high
                    if size >= block_ids:
                        yield rows(_block(part, number, first_symbol, held, options))
                        number, held, size = number + 1, [], 0
        if held:
            yield rows(_block(part, number, first_symbol, held, options))

    arrow = pa.schema(
        [
            ("part", pa.int32()), ("block", pa.int32()), ("first_symbol", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("width", pa.int32()),
            ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()),
        ]
    )
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows_.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _starts(blocks: DataFrame) -> DataFrame:
    """``part, block, base``: ids of all blocks before each; two running sums, over parts and within a part."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per part of the files, not per document or block.
    above = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", F.coalesce(above, F.lit(0)).alias("above"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    numbered = blocks.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(bases, "part")
    return numbered.select("part", "block", (F.col("above") + F.col("inside")).alias("base"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` of every document of the files; ``start`` counts all ids before it."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    bases = _starts(blocks.select("part", "block", "n_ids"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = f"<u{row['width']}"
                rules = np.frombuffer(row["rules"], dtype=kind).reshape(-1, 2)
                ids = expand(rules, np.frombuffer(row["sequence"], dtype=kind), row["first_symbol"])
                sizes = np.array(row["doc_lengths"], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                whole = ids.tobytes()
                sums = [zlib.crc32(whole[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"]), pa.array(sizes), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    edges = np.append(starts, len(ids)).astype(np.int32)
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    # Blocks stay where they are read while the table of their bases is small.
    small = F.broadcast(bases) if bases.count() <= BROADCAST_BLOCKS else bases
    used = blocks.join(small, ["part", "block"]).select("base", "first_symbol", "doc_ids", "doc_lengths", "width", "rules", "sequence")
    return used.mapInArrow(run, schema)


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of single documents: only their blocks are read, and of these only their own symbols are expanded."""
    wanted = F.array(*[F.lit(int(x)) for x in doc_ids]).cast("array<long>")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", wanted))
    chosen = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind = f"<u{row['width']}"
                rules, sequence = np.frombuffer(row["rules"], dtype=kind).reshape(-1, 2), np.frombuffer(row["sequence"], dtype=kind)
                first, lengths = row["first_symbol"], np.frombuffer(row["lengths"], dtype="<u4")
                sizes = np.where(sequence >= first, lengths[np.maximum(sequence.astype(np.int64) - first, 0)] if len(lengths) else 1, 1)
                ends = np.cumsum(sizes)
                starts = np.cumsum([0, *row["doc_lengths"]])
                for i, doc in enumerate(row["doc_ids"]):
                    if doc in chosen:
                        low = np.searchsorted(ends, starts[i], side="right")
                        own = sequence[low : np.searchsorted(ends, starts[i + 1]) + 1]
                        ids = expand(rules, own, first).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_repair_token_files(spark, folder: str, tokenizer_path: str | None = None) -> DataFrame:
    """Place, length and checksum of every document, from files that were written and read back."""
    path = f"{shared_root(spark)}/token_files-{uuid.uuid4().hex}"
    write_token_files(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path, path)
    return read_token_files(spark, path, with_ids=False)
