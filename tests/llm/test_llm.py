"""Every operator against a brute-force version, and on nulls, ties, repeated rows, long texts, clashing columns and empty tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from buyerscope.llm import (
    components, embeddings, language_id, line_dedup, packing, quality, registry, sentencepiece, sharding, simhash, token_files, url_filter,
)

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(names) == columns
    assert same([tuple(r[c] for c in columns) for r in df.collect()], want)


# --- components


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1


def test_viterbi_is_the_best_segmentation(spark, small, odd, nothing):
    codec = sentencepiece.Codec(sentencepiece.default_model())
    pieces = {p: (s, i) for p, (_, s, i) in codec.automaton.items()}
    for text in ["▁abandoned▁ships", "▁▁▁x", "▁naïve▁日本☃", "▁" + "aaab" * 6]:
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                part = text[start:end]
                if part in pieces:
                    best[end] = max(best[end], best[start] + pieces[part][0])
                elif end - start == 1:
                    best[end] = max(best[end], best[start] + codec.unknown)
        ids, score, at = codec.viterbi(text), 0.0, 0
        score_of = {i: s for s, i in pieces.values()}
        by_bytes = {i: b for b, i in codec.byte_ids.items()}
        while at < len(ids):
            if ids[at] in by_bytes:
                first = by_bytes[ids[at]]
                at += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                score += codec.unknown
            else:
                score += score_of[ids[at]]
                at += 1
        assert score == pytest.approx(best[-1])
        # Cutting the text into units and remembering them changes nothing.
    for text in small["text"].head(20):
        escaped = "▁" + text.replace(" ", "▁")
        assert np.frombuffer(codec.encode(text, {}), dtype="<i4").tolist() == codec.viterbi(escaped)


def test_decoding_restores_texts(spark, odd, nothing):
    path = sentencepiece.default_model()
    clashing = odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    for r in sentencepiece.decode(sentencepiece.encode(clashing, path), path).collect():
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert sentencepiece.encode(nothing, path).count() == 0
    # Null ids give null, and rows keep their own texts around them.
    some = spark.createDataFrame([(1, [300]), (2, None), (3, [])], "k int, ids array<int>")
    found = {r["k"]: r["decoded"] for r in sentencepiece.decode(some).collect()}
    assert found[2] is None and found[3] == "" and found[1] is not None


def test_one_pass_gives_the_ids_of_a_separate_search(spark, folder, small, odd, nothing):
    """Counts and checksums of the query against a search over all starts, without units, memory or automaton."""
    codec = sentencepiece.Codec(sentencepiece.default_model())
    pieces = {p: (s, i) for p, (_, s, i) in codec.automaton.items()}
    longest = max(map(len, pieces))

    def plain(text):
        escaped = "▁" + text.replace(" ", "▁") if text else ""
        best, back = [0.0] + [-np.inf] * len(escaped), [None] * (len(escaped) + 1)
        for end in range(1, len(escaped) + 1):
            for start in range(max(0, end - longest), end):
                part = escaped[start:end]
                if part in pieces and best[start] + pieces[part][0] > best[end]:
                    best[end], back[end] = best[start] + pieces[part][0], (start, [pieces[part][1]])
            if escaped[end - 1] not in pieces and best[end - 1] + codec.unknown > best[end]:
                best[end], back[end] = best[end - 1] + codec.unknown, (end - 1, [codec.byte_ids[b] for b in escaped[end - 1].encode()])
        out, at = [], len(escaped)
        while at:
            at, ids = back[at]
            out[:0] = ids
        return len(out), zlib.crc32(np.array(out, dtype="<i4").tobytes())

    found = {r["doc_id"]: r for r in sentencepiece.op1_sentencepiece_viterbi(spark, folder).collect()}
    assert len(found) == len(small)
    for doc, text in zip(small["doc_id"], small["text"]):
        if text is None or len(text) < 3_000:
            assert (found[doc]["n_pieces"], found[doc]["ids_crc32"]) == plain(text), doc
        assert found[doc]["restored"] == ("▁" not in (text or ""))
    rows = sentencepiece.round_trip(odd).collect()
    assert len(rows) == odd.count() and all(r["n_pieces"] == 0 for r in rows if r["doc_id"] in (3, 4))
    assert sentencepiece.round_trip(nothing).count() == 0


# --- 2


def brute_vectors(vectors, threshold=0.95):
    v = np.stack(vectors).astype(float)
    n = np.linalg.norm(v, axis=1)
    linked = (v @ v.T) / (n[:, None] * n[None]) >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(v))
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(v))])
        if (new == label).all():
            return linked.sum(1), label
        label = new


def test_forest_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF_ROWS", 64)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, 24))
    near = base[:200] + rng.standard_normal((200, 24)) * 0.28  # about the threshold
    group = base[300] + rng.standard_normal((260, 24)) * 0.05
    vectors = np.concatenate([base, near, group, base[:5], base[:3] * 2]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    links, label = brute_vectors(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(links[i]), int(label[i]), bool(label[i] == i)) for i in range(len(vectors))}


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [0.0, 1.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("kept", F.lit("x"))
    got = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, None)]
    assert same(got, [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *lone])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- 3


def test_only_entries_active_at_fetch_time_count(spark):
    entries = spark.sql(
        """select * from values ('l','host','a.com','block',timestamp'2024-01-05'), ('l','host','a.com','remove',timestamp'2024-03-01'),
        ('l','domain','b.org','block',timestamp'2023-01-01'), ('l','prefix','x.b.org/ok/','allow',timestamp'2024-02-01'),
        ('l','url','x.b.org/ok/bad','block',timestamp'2024-02-10'), ('l','host',null,'block',timestamp'2024-01-01')
        as t(list_id, kind, value, action, effective_at)"""
    )
    captures = spark.sql(
        """select * from values (1,'http://A.com:80/x',timestamp'2024-01-04 23:59:59'), (2,'http://a.com/x?q',timestamp'2024-01-05'),
        (3,'http://a.com/x',timestamp'2024-03-01'), (4,'https://u@x.b.org/ok/fine#f',timestamp'2024-02-03'),
        (5,'https://x.b.org/ok/fine',timestamp'2024-01-31'), (6,'https://x.b.org/ok/bad',timestamp'2024-02-11'), (7,null,timestamp'2024-02-11'),
        (8,'no url',timestamp'2024-02-11'), (9,'http://a.com/x',null), (2,'http://a.com/x?q',timestamp'2024-01-05') as t(page_id, url, fetched_at)"""
    ).withColumn("blocked", F.lit("clash"))
    got = url_filter.filter_captures(captures, entries)
    want = [(1, False), (2, True), (2, True), (3, False), (4, False), (5, True), (6, True), (7, False), (8, False), (9, False)]
    assert same([(r["page_id"], r["blocked"]) for r in got.collect()], want)
    assert url_filter.filter_captures(captures.limit(0), entries).count() == 0
    assert url_filter.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0


def test_columns_of_any_name_pass_through(spark, odd):
    """Names that the operators have used for their own columns."""
    names = ["_u", "_t", "_hit", "seen_url", "SEEN_HIT", "_l_text", "_l_new", "removed_at", "line_key", "fresh_text", "_k", "_kt", "_c", "_null", "near_part"]
    docs = odd.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    for found in (line_dedup.dedup_lines(docs), simhash.drop_near_duplicates(docs)):
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == n + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for n in names)
    pages = docs.withColumns({"url": F.lit("http://a.test/x"), "fetched_at": F.lit("2024-02-01").cast("timestamp")})
    entries = spark.createDataFrame([("l", "host", "a.test", "block", "2024-01-01")], "list_id string, kind string, value string, action string, at string")
    entries = entries.withColumn("effective_at", F.col("at").cast("timestamp"))
    found = url_filter.filter_captures(pages, entries)
    assert set(pages.columns) <= set(found.columns) and found.where("blocked").count() == pages.count()
    assert all(r[n].startswith(n) for r in found.collect() for n in names)


def test_a_far_fetch_time_adds_one_month(spark):
    times = ["2024-01-05", "2024-03-05", "9999-12-31"]
    seen = spark.createDataFrame([(t,) for t in times], "t string").select(F.lit("u").alias("_u"), F.col("t").cast("timestamp").alias("_t"))
    spans = [("2023-01-01", None), ("2024-02-01", "2024-03-02"), ("2024-01-20", "2024-02-10"), ("2024-01-31", "2024-03-01")]
    intervals = spark.createDataFrame(spans, "a string, b string").select(F.col("a").cast("timestamp").alias("valid_from"), F.col("b").cast("timestamp").alias("valid_to"))
    low, high = (F.lit(x).cast("timestamp") for x in (times[0], times[2]))
    found = url_filter._by_month(intervals, seen, low, high).groupBy("valid_from").count().collect()
    assert {str(r["valid_from"])[:10]: r["count"] for r in found} == {"2023-01-01": 3, "2024-02-01": 1, "2024-01-20": 1, "2024-01-31": 2}


# --- 4


def test_token_files_hold_the_library_ids(spark, folder, small, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    start, want = 0, []
    for doc, text in zip(small["doc_id"].tolist(), small["text"], strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert same([tuple(r) for r in QUERIES["op4_repair_token_files"](spark, folder).collect()], want)


def test_token_files_odd_rows_and_single_documents(spark, odd, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    special = spark.createDataFrame([(20, "a<|endoftext|> b's <|startoftext|>c İstanbul ΟΔΟΣ é \"quoted\" it's")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(special)
    path = str(tmp_path / "f")
    token_files.write_token_files(docs, token_files.default_tokenizer(), path, block_ids=2_000)
    want = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert same([(r["doc_id"], r["ids"]) for r in got], want)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert same([(r["doc_id"], r["ids"]) for r in token_files.fetch_documents(spark, path, [6, 9]).collect()], [x for x in want if x[0] in (6, 9)])
    empty = str(tmp_path / "e")
    token_files.write_token_files(nothing, token_files.default_tokenizer(), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_do_not_depend_on_slices(spark, folder, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = []
    for size, block in ((8_000_000, 50_000), (1_000, 50_000)):
        path = str(tmp_path / str(size))
        monkeypatch.setattr(token_files, "SLICE_BYTES", size)
        monkeypatch.setattr(token_files, "GATHERED", 700 if size == 1_000 else 1_000_000)
        token_files.write_token_files(docs, None, path, block_ids=block)
        files = spark.read.parquet(path).orderBy("part", "block").collect()
        assert all(r["n_ids"] >= block for r in files if any(x["part"] == r["part"] and x["block"] > r["block"] for x in files))
        found.append([(r["n_ids"], r["doc_ids"], r["doc_lengths"], bytes(r["rules"]), bytes(r["sequence"])) for r in files])
    assert found[0] == found[1] and len(found[0]) > 1


def test_re_pair_without_a_limit_leaves_no_frequent_pair():
    """Until no pair is seen often enough: places of each pair that do not overlap are counted by a plain scan."""
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.zipf(1.4, 30_000) % 300 + 2, np.tile(np.arange(2, 90), 60), np.full(500, 9)]).astype("<u4")
    ids[::101] = 1
    rules, lengths, sequence = token_files.re_pair(ids, 400, rounds=None, symbols=1 << 32)
    assert np.array_equal(token_files.expand(rules, sequence, 400), ids)
    seen, last = Counter(), {}
    for i, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist(), strict=False)):
        if 1 not in pair and last.get(pair) != i - 1:
            seen[pair] += 1
            last[pair] = i
    # A run of one symbol overlaps itself, so its pair may be counted twice as often as it can be replaced.
    assert max(seen.values()) < token_files.MIN_COUNT
    assert lengths.max() > 32


@pytest.mark.parametrize("bits", [20, 6])
@pytest.mark.parametrize("first", [50, 70_000])
def test_re_pair_round_trip(first, bits, monkeypatch):
    monkeypatch.setattr(token_files, "SLOT_BITS", bits)  # with few slots most pairs lose theirs
    rng = np.random.default_rng(1)
    ids = rng.choice(first, size=20_000, p=None) % 40
    ids[::17] = 1
    ids[5_000:6_000] = 7
    rules, lengths, sequence = token_files.re_pair(ids.astype("<u4"), first)
    assert len(sequence) < len(ids)
    assert np.array_equal(token_files.expand(rules, sequence, first), ids)
    for k in range(len(rules)):
        whole = token_files.expand(rules, np.array([first + k]), first)
        assert len(whole) == lengths[k] and 1 not in whole


# --- 5


def naive_best_fit(items, capacity, per_source):
    bins, out = [], {}
    for length, tie, row, piece, source, cluster in sorted((-n, t, r, p, s, c) for n, t, r, p, s, c in items):
        best = None
        for k, b in enumerate(bins):
            fits = b["left"] >= -length and b["s"][source] < per_source and cluster not in b["c"]
            if fits and (best is None or (b["left"], k) < (bins[best]["left"], best)):
                best = k
        if best is None:
            bins.append({"left": capacity, "s": Counter(), "c": set()})
            best = len(bins) - 1
        bins[best]["left"] += length
        bins[best]["s"][source] += 1
        bins[best]["c"].add(cluster)
        out[row, piece] = best
    return out


def test_packing_is_best_fit_under_conflicts():
    rng = np.random.default_rng(5)
    n = 400
    lengths, sources, clusters = rng.integers(1, 900, n).tolist(), rng.integers(0, 4, n).tolist(), rng.integers(0, 300, n).tolist()
    ties = rng.permutation(n).tolist()
    got = {(r, p): b for r, p, b, *_ in packing.pack_group(lengths, sources, clusters, ties, 500, 2)}
    items = [(min(500, x - p * 500), ties[i], i, p, sources[i], clusters[i]) for i, x in enumerate(lengths) for p in range(-(-x // 500))]
    assert got == naive_best_fit(items, 500, 2)


def test_packing_odd_rows(spark, odd, nothing):
    packed = packing.pack_documents(odd.withColumn("bin", F.lit("clash")), capacity=512, group_rows=4).cache()
    totals = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    words = {}
    for r in odd.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len([w for w in re.split("[\x20\x09-\x0d]+", r["text"] or "") if w])
    assert totals == words
    for r in packing.sequences(packed).collect():
        assert r["n_tokens"] <= 512 and r["members"][0]["bin_offset"] == 0
    assert packing.pack_documents(nothing).count() == 0


# --- 6


def test_kneser_ney_adds_up_to_one():
    model = language_id.LanguageModel({"x": {"   a": 3, "  ab": 2, " ab ": 2, "  a ": 1, "   b": 1, "  b ": 1}})
    for history in ("", "a", "b"):
        words = [history + c for c in "abz"]
        prefix = model.score_words([history])[0, 0] if history else 0.0
        # P(word) holds the closing blank; sum over next letters and the blank of P(next | history).
        t = model.tables[0]
        total = 0.0
        for c in ["a", "b", "\0", "z"]:
            window = ("\0\0\0" + history + c)[-4:]
            codes = np.frombuffer(window.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)[None, :]
            backed, p = 0.0, None
            for n in range(4, 0, -1):
                found = model._find(t["p"][n - 1], language_id._hash(codes[:, 4 - n :]))[0]
                if not np.isnan(found):
                    p = np.exp(backed + found)
                    break
                if n > 1:
                    backed += np.nan_to_num(model._find(t["weight"][n - 1], language_id._hash(codes[:, 4 - n : -1]))[0])
            total += p if p is not None else np.exp(backed + t["empty"] + t["unknown"])
        assert total == pytest.approx(1.0), (words, prefix)


def test_every_gram_counts(spark):
    """All n-grams are in the model, with the probabilities of Kneser-Ney over whole counts."""
    rng = np.random.default_rng(5)
    letters = np.array([chr(0x4E00 + i) for i in range(400)])
    words = ["".join(x) for x in letters[rng.integers(0, 400, (60_000, 4))]]
    texts = [("zh", " ".join(words[i : i + 200])) for i in range(0, len(words), 200)] + [("en", "the cat and the hat " * 3)] * 5
    entries, constants = language_id.model_entries(language_id.count_grams(spark.createDataFrame(texts, "lang string, text string")))
    found = {(r["lang"], r["kind"], r["gram"]): r["value"] for r in entries.collect()}
    counts = {"zh": Counter(), "en": Counter()}
    for lang, text in texts:
        for word in text.split():
            padded = f"   {word} "
            counts[lang].update(padded[i : i + 4] for i in range(len(padded) - 3))
    assert len(counts["zh"]) > 200_000
    want = {}
    for lang, seen in counts.items():
        levels = language_id._kneser_ney(seen)
        want |= {(lang, "p", g): np.log(p) for level in levels for g, p in level["p"].items()}
        want |= {(lang, "w", g): np.log(w) for level in levels[1:] for g, w in level["weight"].items()}
        assert constants[lang] == pytest.approx((np.log(levels[0]["unknown"]), np.log(levels[0]["weight"][""])))
    assert found.keys() == want.keys()
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_chunks_with_their_part_of_the_model_give_the_same(spark, folder, odd, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-1, "Ελληνικά γράμματα", None)], docs.schema)
    docs = docs.unionByName(odd.select(docs.columns)).unionByName(foreign)
    want = language_id.identify(docs).collect()
    monkeypatch.setattr(language_id, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 50_000)
    assert same(map(tuple, language_id.identify(docs).collect()), map(tuple, want))
    assert language_id.predict(foreign, language_id.fit(docs)).first()["doc_id"] == -1


def test_limits_come_from_all_distinct_texts(spark, monkeypatch):
    """A rare language among many rows, and copies of one text that outnumber the rest, have the limits of the distinct texts."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgh"))

    def text():
        return " ".join("".join(letters[rng.integers(0, 8, 5)]) for _ in range(12))

    common, rare = [text() for _ in range(1_500)], [text().upper().replace("A", "ö") for _ in range(3)]
    rows = [("big", t) for t in common] + [("big", common[0])] * 40_000 + [("rare", t) for t in rare]
    found = {}
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string").repartition(8))
    for lang, texts in (("big", common), ("rare", rare)):
        total, length = model.whole.score_texts(texts, {}, [])
        found[lang] = np.sort(-total[:, model.whole.languages.index(lang)] / length)
    limits = {lang: x[1] / language_id.REJECT_SLACK for lang, x in model.limits.items()}  # 50 to 199 characters
    assert limits["rare"] == pytest.approx(found["rare"][-1])
    assert found["big"][-4] < limits["big"] <= found["big"][-1]


def test_held_out_accuracy(spark, folder, small):
    rows = {r["doc_id"]: r for r in QUERIES["op6_kneser_ney_language"](spark, folder).collect()}
    truth = dict(zip(small["doc_id"].tolist(), small["lang"], strict=True))
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert np.mean([r["accepted"] for r in rows.values()]) > 0.97


def test_language_odd_rows(spark, odd, nothing):
    found = language_id.identify(odd.withColumn("score", F.lit("clash"))).collect()
    for r in found:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.identify(nothing).count() == 0


def test_foreign_letters_are_rejected(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(docs.select("lang", "text"))
    foreign = spark.createDataFrame([(1, "Ελληνικά και άλλα γράμματα που κανείς δεν έμαθε ποτέ " * 5)], "doc_id long, text string")
    assert not language_id.predict(foreign, model).first()["accepted"]


# --- 7


def test_lines_on_many_sites_stay_with_the_first_document(spark, odd, nothing):
    data = [(i, f"own {i}\n shared line \nend {i}", f"s{i % 6}", 1) for i in range(12)] + [(50 + i, "same site", "s0", 1) for i in range(9)]
    df = spark.createDataFrame([*data, (None, "shared line", "s0", 1), (99, None, "s1", None)], "doc_id long, text string, source string, removed_at int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, min_sites=6).collect()}
    assert got[0] == "own 0\n shared line \nend 0" and got[3] == "own 3\nend 3" and got[50] == "same site" and got[None] == "" and got[99] is None
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(nothing).count() == 0


# --- 8


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in ([b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, folder, small):
    prints = np.array([brute_fingerprint(t) for t in small["text"]], dtype=np.uint64)
    ids = small["doc_id"].to_numpy()
    linked = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    label = ids.copy()
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    want = [(int(i), f"{p:016x}", int(c)) for i, p, c in zip(ids, prints.tolist(), label, strict=True)]
    assert same([tuple(r) for r in QUERIES["op8_simhash_gray_index"](spark, folder).collect()], want)


def test_gray_index_links_everything_even_in_large_cells(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base for _ in range(3)]
    tight = [base[0] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a in range(30) for b in range(a)]
    values = np.unique(np.array([*base, *near, *tight, 0, 2**64 - 1], dtype=np.uint64))
    linked = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    for cell_rows in (20, 4_096):
        parts = components.connected_components(simhash.fingerprint_links(df, 3, cell_rows))
        groups = {}
        for r in parts.collect():
            groups.setdefault(r["component"], set()).add(r["node"])
        want = {}
        for x, c in zip(values.view(np.int64).tolist(), label.tolist(), strict=True):
            want.setdefault(c, set()).add(x)
        assert same(map(sorted, groups.values()), [sorted(g) for g in want.values() if len(g) > 1])


def test_simhash_odd_rows(spark, odd, nothing):
    found = simhash.near_duplicates(odd.withColumn("fp", F.lit("clash"))).collect()
    assert len(found) == odd.count()
    blank = {r["doc_id"]: r["component_id"] for r in found if r["fp"] == 0}
    assert set(blank) == {3, 4, 5, None} and set(blank.values()) == {3}
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(odd).collect()]
    assert len(kept) == len(set(kept)) and 1 in kept and 2 not in kept and 3 in kept and 4 not in kept
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_an_id_with_two_texts_loses_no_group(spark):
    a, b = ("one two three four five six seven " * 9, "completely other words stand here in this second text " * 9)
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (7, a), (5, a)], "doc_id long, text string")
    assert same(map(tuple, simhash.drop_near_duplicates(docs).collect()), [(5, a), (5, b)])


# --- 9


def test_shards(spark, folder, small):
    rows = QUERIES["op9_jump_shards"](spark, folder).toPandas()
    texts = dict(zip(small["doc_id"], small["text"], strict=True))
    for r in rows.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_growing_by_one_moves_the_necessary_share(spark, odd, nothing):
    ids = spark.range(20_000)
    for n in (1, 5, 40):
        moved = ids.select(sharding.jump_shard(F.col("id"), n).alias("a"), sharding.jump_shard(F.col("id"), n + 1).alias("b")).where("a <> b")
        assert moved.where(f"b <> {n}").count() == 0
        assert moved.count() == pytest.approx(20_000 / (n + 1), rel=0.2)
    clashing = odd.withColumn("shard", F.lit("x"))
    placed = sharding.number_slots(sharding.assign_shards(clashing, "doc_id", 4), "doc_id", "text").toPandas()
    assert len(placed) == odd.count()
    for _, g in placed.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.assign_shards(nothing, "doc_id", 4).count() == 0


# --- 10


def test_quality_odd_rows(spark, odd, nothing):
    for r in quality.judge(odd.withColumn("kept", F.lit("clash"))).collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", r["text"] or "") if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})
    assert quality.clean(nothing).count() == 0


def test_failing_lines_go(spark):
    body = "\n".join(f"Every{i} sentence{i} tells{i} something{i} new{i} today{i}." for i in range(20))
    junk = "Home | News | Contact | About\nAll rights reserved.\nBUY!! NOW!! CHEAP!! HERE!!\na*** b&&& c%%%\nmenu"
    mostly_junk = junk + "\n" + "\n".join(f"w{i} | x{i} | y{i} |" for i in range(60))
    df = spark.createDataFrame([(1, f"{body}\n{junk}"), (2, body), (3, mostly_junk)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert got[1]["clean_text"] == body and got[1]["kept"] and set(got[1]["rules"]) == {"navigation", "boilerplate", "shouting", "symbols", "open"}
    assert got[2]["clean_text"] == body and got[2]["rules"] == [] and not got[3]["kept"]
    assert sorted(r["doc_id"] for r in quality.clean(df).collect()) == [1, 2]


# --- pipeline


def test_pipeline_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            docs = out.cache()
            counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] > counts[4] > 0
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == counts[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "line dedup", "SimHash near-dedup", "best-fit packing"]


def test_token_files_look_each_distinct_word_up_once():
    """A known word costs one look-up a slice, and new words come back in their order with the ids of whole texts."""
    import pyarrow as pa

    from buyerscope.llm import token_files

    class Counting(dict):
        asked = 0

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

        def get(self, word, default=None):
            self.asked += 1
            return super().get(word, default)

    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    texts = ["Ab ab, AB. ab", "", None, "x1 " + "long" * 30 + " ...", "über Ab\nab ,"]
    whole = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for w in whole for i in w] and counts.tolist() == [len(w) for w in whole]
    encoder.known = known = Counting(encoder.known)
    words = {w for t in texts for w in (t or "").replace("\n", " ").split(" ")}
    encoder.encode(pa.array(texts))
    assert known.asked <= len(words)
