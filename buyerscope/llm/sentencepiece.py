"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi search.

The pieces and scores come from a model file; the best segmentation is the one with the highest sum of scores, ties going to
the earlier start (the longer last piece). Characters outside the vocabulary become byte pieces, so that decoding restores every text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import table, worker_cache

BLANK = "▁"
CACHE_UNITS = 400_000  # units a worker remembers, at most
UNIT_CHARS = 64  # longer units are searched again instead of remembered
UNKNOWN_PENALTY = 10.0
LEAST = float("-inf")
GATHERED = 1_000_000  # ids decoded at a time


class Codec:
    """Automaton and tables of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = {}
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.bytes_of: list[bytes] = []
        lowest, letters, crossing = 0.0, set(), False
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                letters.update(piece)
                crossing |= re.search(f"[^{BLANK}]{BLANK}", piece) is not None
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        # Decoding gathers from one run of bytes.
        self.pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.unknown_id, self.unknown = model.unk_id(), lowest - UNKNOWN_PENALTY
        # Text can be cut where no piece reaches across: before a run of blanks, and around characters of no piece.
        cuts = "" if "\n" in letters else r"|\n"
        rest = "" if "\n" in letters else r"\n"
        self.units = None if crossing else re.compile(f"{BLANK}*[^{BLANK}{rest}]+|{BLANK}+{cuts}")

    def _fallback(self, char: str) -> list[int]:
        if len(self.byte_ids) < 256:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of an escaped text."""
        if self.single.issuperset(text):
            return self._viterbi_known(text)
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        done, single, unknown = 0, self.single, self.unknown
        for end, (length, score, piece) in self.automaton.iter(text):
            while done < end:  # ends before this one have met all their pieces
                done += 1
                if text[done - 1] not in single and best[done - 1] + unknown > best[done]:
                    best[done], back[done] = best[done - 1] + unknown, (1, None)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (length, piece)
        while done < n:
            done += 1
            if text[done - 1] not in single and best[done - 1] + unknown > best[done]:
                best[done], back[done] = best[done - 1] + unknown, (1, None)
        out, at = [], n
        while at:
            length, piece = back[at]
            out.append([piece] if piece is not None else self._fallback(text[at - 1]))
            at -= length
        return [i for part in reversed(out) for i in part]

    def _viterbi_known(self, text: str) -> list[int]:
        """The same search where every character is a piece of its own, so that each position is reached by pieces."""
        best, length_at, piece_at = [0.0] + [LEAST] * len(text), [0] * (len(text) + 1), [0] * (len(text) + 1)
        for last, (length, score, piece) in self.automaton.iter(text):
            end = last + 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], length_at[end], piece_at[end] = total, length, piece
        out, at = [], len(text)
        while at:
            out.append(piece_at[at])
            at -= length_at[at]
        out.reverse()
        return out

    def packed(self, text: str) -> bytes:
        """Ids of an escaped text as little-endian 32-bit numbers."""
        ids = self.viterbi(text)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str | None, known: dict[str, bytes]) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        escaped = BLANK + text.replace(" ", BLANK)
        if self.units is None:
            return self.packed(escaped)
        units = self.units.findall(escaped)
        for unit in set(units).difference(known):
            if len(unit) <= UNIT_CHARS:
                known[unit] = self.packed(unit)
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            return b"".join([known[u] if u in known else self.packed(u) for u in units])

    def _gather(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[ids] - upto + sizes, sizes) + np.arange(upto[-1])].tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of several rows: ``ids`` of all rows in turn and where each row ends. The blank before the first word goes."""
        upto = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        raw = b"".join(self._gather(ids[i : i + GATHERED]) for i in range(0, len(ids), GATHERED))
        edges = upto[np.concatenate([[0], ends])].tolist()
        texts = [raw[low:high].decode("utf-8", "replace") for low, high in zip(edges, edges[1:])]
        return pa.array([x[1:] if x.startswith(" ") else x for x in texts], pa.string())


def _encoded(codec: Codec, known: dict[str, bytes], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, and where each text ends."""
    if len(known) > CACHE_UNITS:
        known.clear()
    parts = [codec.encode(x, known) for x in texts.to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
    return np.frombuffer(b"".join(parts), dtype="<i4"), ends


def _codec(model_path: str | None) -> tuple[Codec, dict[str, bytes]]:
    """The worker's codec; the standard model is looked up where it is used."""
    path = model_path or default_model()
    return worker_cache("sentencepiece", path, lambda: (Codec(path), {}))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def encode(df: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int; replaced if there is one).

    Null and empty texts have no ids; a very long text is searched unit by unit as a whole; repeated rows stay repeated and get the
    same ids; an empty table stays empty.
    """
    base = df.drop("ids")
    position = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(model_path)
        for batch in _slices(batches):
            flat, ends = _encoded(codec, known, batch.column(position))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return base.mapInArrow(run, base.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(df: DataFrame, model_path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids (null ids give null). A blank character U+2581 in the source comes back as a space."""
    base = df.drop("decoded")
    position = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(model_path)
        for batch in _slices(batches):
            column = batch.column(position)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)  # null rows hold no values
            texts = pc.if_else(column.is_valid(), codec.decode(flat, np.cumsum(sizes, dtype=np.int64)), None)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, base.withColumn("decoded", F.lit(None).cast("string")).schema)


def round_trip(df: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_pieces, ids_crc32, restored``: every whole text is encoded and its ids decoded in one pass over the rows.

    ``ids_crc32`` covers the ids as little-endian 32-bit numbers; ``restored`` says whether decoding gives the text back (a null text counts
    as empty). Repeated rows stay repeated; an empty table gives none.
    """
    used = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(model_path)
        for batch in _slices(batches):
            flat, ends = _encoded(codec, known, batch.column(1))
            same = pc.equal(codec.decode(flat, ends), pc.fill_null(batch.column(1), ""))
            raw, edges = flat.tobytes(), [0, *(4 * ends).tolist()]
            sums = [zlib.crc32(raw[low:high]) for low, high in zip(edges, edges[1:])]
            counts = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), same], names=[key, "n_pieces", "ids_crc32", "restored"]
            )

    kind = used.schema["key"].dataType.simpleString()
    return used.mapInArrow(run, f"`{key}` {kind}, n_pieces long, ids_crc32 long, restored boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece_viterbi(spark, folder: str, model_path: str | None = None) -> DataFrame:
    """Number and checksum of the pieces of every document, and whether decoding restores it."""
    return round_trip(table(spark, folder, "documents"), model_path)
