"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is read as its words (runs of letters, lower case), each padded with blanks; the model gives every letter, and the
blank after the word, a probability from the letters before it. The language with the lowest cross-entropy per character wins; a text whose
cross-entropy is higher than that of nearly all training texts of similar length is rejected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buyerscope.llm.common import free_names, share, table, worker_cache
from buyerscope.storage import write_once

ORDER = 4
BROADCAST_ENTRIES = 2_000_000  # probabilities and weights of all languages up to which every worker gets the whole model
CHUNK_BYTES = 16_000_000  # text scored together, with the part of the model that it needs, if the model is larger
REJECT_QUANTILE = 0.999
REJECT_SLACK = 1.5  # factor on the calibrated cross-entropy
LENGTH_EDGES = (50, 200, 1_000)  # characters; short texts vary more
CACHE_WORDS = 500_000
PART_CHARACTERS = 4_000_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Runs of word characters other than decimal digits; some, such as fractions, hold no letter."""
    return LETTERS.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all n-grams of order ``ORDER`` of the words, each between blanks (0), and the number of each word's n-grams."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    pad = "\0" * (ORDER - 1)
    flat = np.frombuffer((pad + ("\0" + pad).join(words) + "\0").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    skipped = np.arange(len(words)) * (ORDER - 1)  # no n-gram starts in the blanks that lead to the next word
    first = np.arange(sizes.sum()) + np.repeat(skipped, sizes)
    return flat[first[:, None] + np.arange(ORDER)], sizes


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points; the row's length is part of it."""
    out = np.full(len(grams), np.uint64(grams.shape[1] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for column in range(grams.shape[1]):
            out = (out ^ (grams[:, column] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: n-grams of order ``ORDER`` over all texts of ``rows`` (``lang, text``), blanks written as spaces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs, found, numbers = [], [], []
            for lang, seen in words.items():
                kept = [w for w in seen if has_letter(w)]
                if not kept:
                    continue
                windows, sizes = _windows(kept)
                _, first, which = np.unique(_hash(windows), return_index=True, return_inverse=True)
                weight = np.repeat(np.fromiter(map(seen.__getitem__, kept), dtype=np.int64, count=len(kept)), sizes)
                total = np.bincount(which, weights=weight).astype(np.int64)
                text = windows[first].astype("<u4").tobytes().decode("utf-32-le").replace("\0", " ")
                found += [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                numbers.append(total)
                langs += [lang] * len(total)
            words.clear()
            numbers = np.concatenate([*numbers, np.empty(0, dtype=np.int64)])
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(numbers)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_in(text))
            if sum(map(len, words.values())) > CACHE_WORDS:
                yield flush()
        yield flush()

    found = rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _kneser_ney(counts: dict[str, int]) -> list[dict]:
    """Per order 1..ORDER: probabilities of n-grams and back-off weights of contexts (``model_entries`` in memory)."""
    levels, current = [], counts
    for order in range(ORDER, 0, -1):
        levels.append(current)
        lower: Counter = Counter()
        for gram in current:
            lower[gram[1:]] += 1  # distinct letters before it
        current = lower
    levels.reverse()
    vocabulary = len(levels[0]) + 1
    model: list[dict] = []
    for order, grams in enumerate(levels, 1):
        once = sum(1 for n in grams.values() if n == 1)
        twice = sum(1 for n in grams.values() if n == 2)
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in grams.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight = {context: discount * kinds[context] / total[context] for context in total}
        lower = model[-1]["p"] if model else {}
        p = {
            gram: (n - discount) / total[gram[:-1]] + weight[gram[:-1]] * (lower[gram[1:]] if order > 1 else 1 / vocabulary)
            for gram, n in grams.items()
        }
        model.append({"p": p, "weight": weight, "unknown": 1 / vocabulary})
    return model


class LanguageModel:
    """All languages' models as sorted hash arrays: per language and order (hashes, log probabilities) and (hashes, log weights)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.tables = []
        for lang in self.languages:
            levels = _kneser_ney(counts[lang])
            self.tables.append(
                {
                    "unknown": np.log(levels[0]["unknown"]),
                    "empty": np.log(levels[0]["weight"].get("", 1.0)),
                    "p": [self._array(level["p"]) for level in levels],
                    "weight": [None] + [self._array(level["weight"]) for level in levels[1:]],
                }
            )
        self.limits: dict[str, list[float]] = {}

    @classmethod
    def from_entries(cls, constants: dict[str, tuple[float, float]], entries: pa.Table) -> LanguageModel:
        """A model that holds the given ``lang, kind, gram, value`` rows; ``constants``: language -> (unknown, empty)."""
        model = cls({})
        model.languages = sorted(constants)
        entries = entries.select(["lang", "kind", "gram", "value"]).combine_chunks()
        langs = pc.index_in(entries.column("lang"), value_set=pa.array(model.languages, pa.string())).to_numpy()
        weights = pc.equal(entries.column("kind"), "w").to_numpy()
        widths, values = pc.utf8_length(entries.column("gram")).to_numpy(), entries.column("value").to_numpy()
        model.tables = [
            {"unknown": constants[lang][0], "empty": constants[lang][1], "p": [None] * ORDER, "weight": [None] * ORDER}
            for lang in model.languages
        ]
        for kind, width in [("p", n) for n in range(1, ORDER + 1)] + [("weight", n) for n in range(1, ORDER)]:
            at = np.flatnonzero((widths == width) & (weights == (kind == "weight")))
            text = "".join(entries.column("gram").take(pa.array(at)).to_pylist()).replace(" ", "\0")
            hashes = _hash(np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64).reshape(-1, width))
            order = np.lexsort((hashes, langs[at]))
            ends = np.searchsorted(langs[at][order], np.arange(len(model.languages) + 1))
            for k, t in enumerate(model.tables):
                part = order[ends[k] : ends[k + 1]]
                t[kind][width - (kind == "p")] = hashes[part], values[at][part]
        return model

    @staticmethod
    def _array(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(values).replace(" ", "\0")
        width = len(next(iter(values)))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(-1, width)
        hashes = _hash(codes)
        order = np.argsort(hashes)
        return hashes[order], np.log(np.fromiter(values.values(), dtype=np.float64))[order]

    @staticmethod
    def _find(arrays: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The stored number of each hash, NaN if it is not stored."""
        keys, values = arrays
        if not len(keys):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], np.nan)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        windows, sizes = _windows(words)
        grams = [_hash(windows[:, ORDER - n :]) for n in range(1, ORDER + 1)]
        contexts = [None] + [_hash(windows[:, ORDER - n : -1]) for n in range(2, ORDER + 1)]
        out = np.empty((len(words), len(self.languages)))
        edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k, t in enumerate(self.tables):
            score = np.full(len(windows), np.nan)
            backed = np.zeros(len(windows))
            for n in range(ORDER, 0, -1):
                open_ = np.flatnonzero(np.isnan(score))
                if not len(open_):
                    break
                score[open_] = backed[open_] + self._find(t["p"][n - 1], grams[n - 1][open_])
                open_ = open_[np.isnan(score[open_])]
                if n > 1:
                    backed[open_] += np.nan_to_num(self._find(t["weight"][n - 1], contexts[n - 1][open_]), nan=0.0)
                else:
                    score[open_] = backed[open_] + t["empty"] + t["unknown"]
            out[:, k] = np.add.reduceat(score, edges)
        return out

    def score_texts(self, texts: list[str | None], known: dict[str, int], matrix: list) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and the number of characters scored.

        ``known`` and ``matrix`` remember words from call to call; they are emptied when they grow too large. Texts are split into words
        a part at a time, so that few words are held at once.
        """
        part = np.cumsum([len(x or "") for x in texts]) // PART_CHARACTERS
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        found = [self._score_part(texts[a:b], known, matrix) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _score_part(self, texts: list[str | None], known: dict[str, int], matrix: list) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > CACHE_WORDS:
            known.clear()
            matrix.clear()
        split = [words_in(x) for x in texts]
        new = list({w for words in split for w in words if w not in known})
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            sizes = np.array([(len(w) + 1) * has_letter(w) for w in part])
            matrix.append(np.column_stack([self.score_words(part), np.ones(len(part))]) * (sizes > 0)[:, None])
            matrix[-1][:, -1] = sizes
        if len(matrix) > 1:
            matrix[:] = [np.concatenate(matrix)]
        total = np.zeros((len(texts), len(self.languages) + 1))
        for i, words in enumerate(split):
            if words:
                total[i] = matrix[0][np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return total[:, :-1], total[:, -1].astype(np.int64)

    def limit(self, language: int, lengths: np.ndarray) -> np.ndarray:
        return np.array(self.limits[self.languages[language]])[np.searchsorted(LENGTH_EDGES, lengths, side="right")]


def held_out(doc_id: Column) -> Column:
    """True for documents that the models never learn from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def model_entries(counted: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The interpolated Kneser-Ney models of all languages from all n-grams (``lang, gram, n``), without a bound on their number.

    Rows ``lang, kind, gram, value``: log probabilities of n-grams of order 1..ORDER (kind ``p``) and log back-off weights of contexts
    (kind ``w``). The second result gives per language the log probability of an unknown letter and the log weight of the empty context.
    """
    levels = {ORDER: counted.select("lang", "gram", "n")}
    for order in range(ORDER - 1, 0, -1):  # distinct letters before it
        shorter = levels[order + 1].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        levels[order] = write_once(shorter, "grams")
    sizes = {}
    for order, grams in levels.items():
        found = grams.groupBy("lang").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        for r in found.collect():
            once = r["once"]
            sizes[r["lang"], order] = r["kinds"], min(max(once / (once + 2 * r["twice"]) if once else 0.5, 0.1), 0.9)
    languages = sorted({lang for lang, _ in sizes})
    if not languages:
        return counted.selectExpr("lang", "'p' AS kind", "gram", "CAST(n AS DOUBLE) AS value").limit(0), {}

    def per_language(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    parts, lower, empty = [], None, {}
    for order in range(1, ORDER + 1):
        discount = per_language({lang: sizes[lang, order][1] for lang in languages})
        grams = levels[order].withColumn("context", F.substring("gram", 1, order - 1))
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = write_once(contexts.withColumn("weight", discount * F.col("kinds") / F.col("total")), "contexts")
        joined = grams.join(contexts, ["lang", "context"]).withColumn("own", (F.col("n") - discount) / F.col("total"))
        if order == 1:
            empty = {r["lang"]: r["weight"] for r in contexts.collect()}
            p = joined.withColumn("p", F.col("own") + F.col("weight") * per_language({lang: 1 / (sizes[lang, 1][0] + 1) for lang in languages}))
        else:
            joined = joined.withColumn("suffix", F.substring("gram", 2, order - 1))
            p = joined.join(lower, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("weight") * F.col("lower"))
            parts.append(contexts.select("lang", F.lit("w").alias("kind"), F.col("context").alias("gram"), F.log("weight").alias("value")))
        written = write_once(p.select("lang", "gram", "p"), "probabilities")
        parts.append(written.select("lang", F.lit("p").alias("kind"), "gram", F.log("p").alias("value")))
        lower = written.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    constants = {lang: (float(-np.log(sizes[lang, 1][0] + 1)), float(np.log(empty[lang]))) for lang in languages}
    return reduce(DataFrame.unionByName, parts), constants


class StoredModel:
    """All languages' models as written tables, with their rejection limits; small ones also whole, for every worker."""

    def __init__(self, entries: DataFrame, constants: dict[str, tuple[float, float]]):
        self.entries, self.constants = entries, constants
        self.limits: dict[str, list[float]] = {}
        small = entries.count() <= BROADCAST_ENTRIES
        self.whole = LanguageModel.from_entries(constants, entries.toArrow()) if small else None

    def set_limits(self, quantiles: dict[tuple[str, int], tuple[float, int]]) -> None:
        """``quantiles``: (language, length class) -> high quantile of the cross-entropy of its distinct training texts, and their number.

        A class of fewer than 100 texts, or none, takes the loosest limit of its language.
        """
        for lang in self.constants:
            known = [quantiles.get((lang, c), (np.inf, 0)) for c in range(len(LENGTH_EDGES) + 1)]
            fallback = max((q for q, n in known if n), default=np.inf)
            limits = [(q if n >= 100 else fallback) * REJECT_SLACK for q, n in known]
            # Longer texts vary less: a limit never exceeds that of shorter ones.
            self.limits[lang] = np.minimum.accumulate(limits).tolist()

    def apply(self, rows: DataFrame, text: str, work: Callable, schema: T.StructType) -> DataFrame:
        """``work(model, batch, known, matrix)`` over all rows, where the model holds at least the n-grams of the batch's texts.

        A model of bounded size goes whole to every worker. With a larger one, rows are dealt to chunks by a hash of all their atomic
        columns, and the entries that a chunk's distinct n-grams need are joined to it. Probabilities are the same either way.
        """
        limits, constants, mark = self.limits, self.constants, uuid.uuid4().hex
        if self.whole is not None:
            self.whole.limits = limits
            shared = share(rows.sparkSession, "language_id", self.whole)

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m = shared()
                known, matrix = worker_cache("language_id_words", mark, lambda: ({}, []))
                for batch in batches:
                    yield work(m, batch, known, matrix)

            return rows.mapInArrow(whole, schema)

        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        atoms = [F.col(f"`{f.name}`") for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
        chunk = F.pmod(F.xxhash64(*atoms), F.lit(size // CHUNK_BYTES + 1)).alias("chunk")
        lookups = [("p", ORDER - n, n) for n in range(1, ORDER + 1)] + [("w", ORDER - n, n - 1) for n in range(2, ORDER + 1)]
        grams = rows.select(chunk, F.col(f"`{text}`")).mapInArrow(chunk_grams, "chunk long, gram string").distinct()
        keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.substring("gram", at + 1, n).alias("gram")) for k, at, n in lookups])
        needed = grams.select("chunk", F.explode(keys).alias("key")).select("chunk", "key.kind", "key.gram").distinct()
        held = needed.join(self.entries, ["kind", "gram"]).select("chunk", "lang", "kind", "gram", "value")
        columns = rows.columns
        dealt = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), chunk)

        def part(left: pa.Table, right: pa.Table) -> pa.Table:
            m = LanguageModel.from_entries(constants, right)
            m.limits = limits
            known, matrix, out = {}, [], []
            for batch in left.to_batches():
                inner = pa.RecordBatch.from_struct_array(batch.column(batch.schema.get_field_index("row")))
                out.append(work(m, inner, known, matrix))
            return pa.Table.from_batches(out)

        return dealt.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(part, schema)


def chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk, gram``: n-grams of order ``ORDER`` in the texts of each chunk, blanks written as spaces, each once per flush."""
    seen: dict[int, set[str]] = {}

    def flush() -> pa.RecordBatch:
        chunks, found = [], []
        for chunk, words in seen.items():
            kept = list(filter(has_letter, words))
            if kept:
                windows, _ = _windows(kept)
                _, first = np.unique(_hash(windows), return_index=True)
                text = windows[first].astype("<u4").tobytes().decode("utf-32-le").replace("\0", " ")
                found += [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                chunks += [chunk] * len(first)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(found, pa.string())], names=["chunk", "gram"])

    for batch in batches:
        for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(chunk, set()).update(words_in(text))
        if sum(map(len, seen.values())) > CACHE_WORDS:
            yield flush()
    yield flush()


def learn(labelled: DataFrame) -> StoredModel | None:
    """Models without limits from ``lang, text`` rows (null in either is ignored); None if there is nothing to learn.

    All texts are counted, and the models hold every n-gram.
    """
    entries, constants = model_entries(write_once(count_grams(labelled.select("lang", "text").dropna()), "grams"))
    return StoredModel(entries, constants) if constants else None


def fit(labelled: DataFrame) -> StoredModel | None:
    """The same with rejection limits from all distinct texts of ``labelled``."""
    model = learn(labelled)
    if model is not None:
        rows = labelled.select("lang", "text").dropna().distinct()
        scored = score_rows(rows.withColumn("copy", F.xxhash64("text")), model, "text", ["lang", "copy"])
        calibrate(model, scored, "lang", "copy")
    return model


def score_rows(docs: DataFrame, model: StoredModel, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``totals`` (log probability in each language, in their order) and ``scored`` (characters)."""
    names = [f"`{c}`" for c in keep]
    read = free_names(docs.select(*names), "scored_text")[0]
    rows = docs.select(*names, F.col(f"`{text}`").alias(read))
    n_languages = len(model.constants)

    def score(m: LanguageModel, batch: pa.RecordBatch, known: dict, matrix: list) -> pa.RecordBatch:
        total, length = m.score_texts(batch.column(len(keep)).to_pylist(), known, matrix)
        bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_languages)
        new = [pa.ListArray.from_arrays(bounds, pa.array(total.ravel())), pa.array(length)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, *added])

    added = free_names(rows, "totals", "scored")
    schema = T.StructType([
        *rows.schema.fields[: len(keep)], T.StructField(added[0], T.ArrayType(T.DoubleType())), T.StructField(added[1], T.LongType()),
    ])
    scored = model.apply(rows, read, score, schema)
    return scored.select(*names, F.col(added[0]).alias("totals"), F.col(added[1]).alias("scored"))


def calibrate(model: StoredModel, scored: DataFrame, lang: str, copy: str) -> None:
    """Set the rejection limits from the cross-entropy of all distinct training texts, by language and length class.

    ``scored`` holds totals and lengths of the training rows, their language, and a hash of the text: copies count once.
    """
    languages = sorted(model.constants)
    own = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang))
    size = sum((F.when(F.col("scored") >= e, 1).otherwise(0) for e in LENGTH_EDGES), F.lit(0))
    # A language without a single letter in its texts has no model.
    texts = scored.where(F.col(lang).isin(languages) & (F.col("scored") > 0)).select(
        F.col(lang).alias("lang"), F.col(copy).alias("copy"), size.alias("size"),
        (-F.get("totals", own.cast("int") - 1) / F.col("scored")).alias("entropy"),
    )
    found = texts.groupBy("lang", "copy").agg(F.first("size").alias("size"), F.first("entropy").alias("entropy")).groupBy("lang", "size")
    limits = found.agg(F.percentile_approx("entropy", REJECT_QUANTILE, 10_000).alias("q"), F.count("*").alias("n")).collect()
    model.set_limits({(r["lang"], r["size"]): (r["q"], r["n"]) for r in limits})


ADDED = ["lang_pred", "score", "cross_entropy", "accepted"]


def decide(scored: DataFrame, model: StoredModel) -> DataFrame:
    """``scored`` with ``ADDED`` in place of totals and lengths; the limits are a small table of languages and length classes."""
    languages = sorted(model.constants)
    some, best = F.col("scored") > 0, F.array_max("totals")
    place = (F.array_position("totals", best) - 1).cast("int")  # the first of equal ones
    per = F.transform("totals", lambda x: F.exp((x - F.array_max("totals")) / F.greatest(F.col("scored"), F.lit(1)) * 8))
    entropy = -best / F.greatest(F.col("scored"), F.lit(1))
    size = sum((F.when(F.col("scored") >= e, 1).otherwise(0) for e in LENGTH_EDGES), F.lit(0))
    limits = F.array(*[F.array(*[F.lit(float(x)) for x in model.limits[lang]]) for lang in languages])
    columns = [F.col(f"`{c}`") for c in scored.columns if c not in ("totals", "scored")]
    return scored.select(
        *columns, F.when(some, F.get(F.array(*[F.lit(x) for x in languages]), place)).otherwise("und").alias("lang_pred"),
        F.when(some, F.lit(1.0) / F.aggregate(per, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0).alias("score"),
        F.when(some, entropy).alias("cross_entropy"), (some & (entropy <= F.get(F.get(limits, place), size))).alias("accepted"),
    )


def _unknown(docs: DataFrame) -> DataFrame:
    """No model: nothing is identified."""
    return docs.withColumns(
        {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "accepted": F.lit(False)}
    )


def predict(docs: DataFrame, model: StoredModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, cross_entropy, accepted`` (columns of these names, and ``totals`` and ``scored``, are replaced).

    ``lang_pred`` is ``und`` (score 0, cross-entropy null, not accepted) if the text is null, empty or has no letter, or if nothing was
    learned. ``score`` is the winner's share of the probability over all languages, taken per word-sized stretch of the text; ties go to
    the alphabetically first language. ``accepted`` is false if the cross-entropy exceeds the calibrated limit. Only the text is read, and
    the whole of it, a part of its words at a time; rows are judged one by one, so repeated rows get equal results.
    """
    base = docs.drop(*ADDED, "totals", "scored")
    return _unknown(base) if model is None else decide(score_rows(base, model, text, base.columns), model)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Models learned from the labelled documents that are not held out, applied to all documents; columns ``keep`` (all by default).

    Every text is scored once: the limits are taken from the written scores of the training rows.
    """
    base = docs.drop(*ADDED, "totals", "scored")
    keep = [c for c in (base.columns if keep is None else keep) if c in base.columns]
    teaching = ~held_out(F.col("doc_id"))
    model = learn(base.where(teaching).select("lang", "text"))
    if model is None:
        return _unknown(base.select(*[F.col(f"`{c}`") for c in keep]))
    lang, copy = free_names(base, "taught_lang", "taught_copy")
    marked = base.withColumns({lang: F.when(teaching, F.col("lang")), copy: F.xxhash64("text")})
    scored = write_once(score_rows(marked, model, "text", [*keep, lang, copy]), "language_scores")
    calibrate(model, scored, lang, copy)
    return decide(scored.drop(lang, copy), model)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is accepted, in the columns of ``docs``."""
    return identify(docs).where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_kneser_ney_language(spark, folder: str) -> DataFrame:
    """Language, confidence and acceptance of every document."""
    found = identify(table(spark, folder, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
