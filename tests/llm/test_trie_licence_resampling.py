"""Conversation trie, licence scan and importance resampling against brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buyerscope.llm import byte_words, conversation_trie, license_scan, registry, resampling

QUERIES = registry.queries()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- 11


def brute_trie(rows):
    """All nodes by plain dictionaries: (smallest member, depth) -> the other columns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:head] + turns[head:])
    nodes = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = ",".join(str(c) for c in members if len(whole[c]) == len(prefix))
        out[members[0], len(prefix)] = (
            nodes[prefix[:-1]][0] if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def trie_rows(df):
    return {
        (r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
        for r in df.collect()
    }


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sketch", [(16, 16), (4_096, 16_384)])
def test_trie_equals_brute_force(spark, monkeypatch, sketch):
    """Few texts, null turns and roles, repeated rows, absent heads, and segments shorter than the conversations."""
    monkeypatch.setattr(conversation_trie, "SEGMENT", 3)
    monkeypatch.setattr(conversation_trie, "ID_BITS", 2)
    rnd = random.Random(3)
    rows = [
        (c, rnd.choice([None, 0, 1, 2, 3, 4, 5, 6, 7]), rnd.choice([None, "u", "a"]), rnd.choice([None, "", "x", "yé"]))
        for c in list(range(30)) * 8 + [100, 101, 199, 230, -5, -100] * 4
    ]
    rows += [(500, t, "u", f"only here {t}") for t in range(40)] + [(None, 1, "a", "no conversation")] + [(c, 0, "u", "alike") for c in range(300, 330)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).repartition(5)
    assert trie_rows(conversation_trie.prefix_trie(df, sketch)) == brute_trie(rows)


def test_trie_of_one_conversation_with_most_rows_and_of_none(spark):
    rows = [(7, i, "u", f"turn {i}") for i in range(9_000)] + [(c, 0, "u", "hi") for c in range(8, 20)]
    got = trie_rows(conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert max(d for _, d in got) > 8_990 and got[7, 0][1] == 13
    deepest = max(d for c, d in got if c == 7)
    assert got[7, deepest] == (7, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # Conversation 105 loses its only turn to its head, and there is no conversation 100 to take one from.
    lost = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6)
    only = trie_rows(conversation_trie.prefix_trie(spark.createDataFrame([(lost, 0, "u", "gone")], TURNS)))
    assert only == {(lost, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())}


def test_sketch_never_proves_a_shared_prefix(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**62), 2**62, (2, 3_000))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)] + [(int(a), int(b)) for a, b in zip(x[:500], y[:500], strict=True)], "x long, y long")
    for bounds in ((64, 64), (4_096, 1 << 20)):
        plane = conversation_trie.shared_plane(df.repartition(7), df.count(), bounds)
        slots = conversation_trie.sketch_slots(x, y, plane.shape[1] * 8)
        bits = np.unpackbits(plane, axis=1)
        twice = np.stack([bits[k, slots[k]] for k in range(len(bits))]).all(axis=0)
        assert twice[:500].all()
    assert twice[500:].mean() < 0.1


# --- 12


def longest_ends(text, sequences):
    """Per word the longest run ending there that some sequence holds."""
    grams = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max(k for k in range(e + 2) if not k or tuple(text[e - k + 1 : e + 1]) in grams) for e in range(len(text))]


@pytest.mark.parametrize("together", [0, 24])
def test_automaton_knows_statistics_phrases_and_matches(monkeypatch, together):
    monkeypatch.setattr(license_scan, "_TOGETHER", together)
    rnd = random.Random(5)
    for _ in range(40):
        letters = "abcd"[: rnd.randint(2, 4)]
        templates = [(f"t{i}", " ".join(rnd.choices(letters, k=rnd.randint(1, 9)))) for i in range(4)]
        phrases = [(" ".join(rnd.choices(letters, k=rnd.randint(1, 3))), "p") for _ in range(3)]
        automaton = license_scan.LicenseAutomaton(phrases, templates, 2, 3)
        texts = [rnd.choices(letters + "z", k=rnd.randint(0, 30)) for _ in range(50)]
        flat = [w for t in texts for w in t]
        rows = np.array([i for i, t in enumerate(texts) for _ in t])
        ids = automaton.ids(pa.array([w.encode() for w in flat], pa.large_binary()))
        state, length = automaton.statistics(ids, rows)
        assert length.tolist() == [n for t in texts for n in longest_ends(t, automaton.template_words + automaton.phrase_words)]
        places = {
            (i, p) for i in range(len(flat)) for p, w in enumerate(automaton.phrase_words)
            if flat[i : i + len(w)] == w and rows[i] == rows[i + len(w) - 1]
        }
        found = list(automaton.phrase_places(state, length))
        assert set(found) == places and len(found) == len(places)
        at = 0
        for text in texts:
            got = sorted((t, e, n) for t, e, n, _ in automaton.matches(state[at : at + len(text)], length[at : at + len(text)]))
            want = []
            for t, w in enumerate(automaton.template_words):
                ends = [*longest_ends(text, [w]), 0]
                want += [(t, e, n) for e, n in enumerate(ends[:-1]) if n >= min(2, len(w)) and ends[e + 1] != n + 1]
            assert got == want
            at += len(text)


def test_scan_of_documents_against_brute_force(spark, folder, small):
    rows = {r["doc_id"]: r for r in QUERIES["op12_license_automaton"](spark, folder).collect()}
    assert len(rows) == len(small)
    for doc, text in zip(small["doc_id"].tolist(), small["text"], strict=True):
        w, r = words(text), rows[doc]
        hits = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        text_line = " ".join(w)
        extra = {label for label, t in license_scan.TEMPLATES if f" {' '.join(words(t))} " in f" {text_line} "}
        assert r["labels"] == ",".join(sorted({x for _, x in hits} | extra))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(r["labels"])


def test_notices_with_changes_are_spans(spark):
    notice = next(t for label, t in license_scan.TEMPLATES if label == "bsd")
    changed = notice.replace("provided that the following", "provided the following").replace("binary form must", "binary form shall")
    half = " ".join(notice.split()[:20])
    docs = spark.createDataFrame(
        [(1, f"Some code.\n{changed}\nMore of it"), (2, half), (3, "redistribution is a word"), (4, None), (5, f"{notice} filler {notice}")],
        "doc_id long, text string",
    )
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    (span,) = [s for s in rows[1]["spans"] if s["label"] == "bsd"]
    assert span["first_word"] == 2 and 0.9 < span["share"] < 1 and span["last_word"] == rows[1]["n_words"] - 4
    assert 0 < max(s["share"] for s in rows[2]["spans"]) < 0.5 and rows[3]["spans"] == [] and rows[4]["n_words"] == 0
    assert len([s for s in rows[5]["spans"] if s["label"] == "bsd" and s["share"] == 1]) == 2


def test_scan_odd_rows(spark, odd, nothing):
    for r in license_scan.scan(odd.withColumn("_scanned", F.lit("x"))).collect():
        assert r["_scanned"] == "x" and r["phrase_hits"] == []
    long = spark.createDataFrame([(1, ("mit license " * 400_000) + "free")], "doc_id long, text string")
    (r,) = license_scan.scan(long).collect()
    assert r["n_words"] == 800_001 and [h["word"] for h in r["phrase_hits"]] == list(range(0, 800_000, 2))
    assert license_scan.scan(nothing).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        license_scan.scan(odd.withColumn("n_words", F.lit(1)))


# --- 13


def test_position_table_gives_crc32():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 100_000).astype(np.uint8)
    crc = resampling.PositionCrc()
    starts, sizes = rng.integers(0, 90_000, 600), rng.choice([1, 2, 5, 63, 64, 65, 128, 129, 500, 9_999], 600)
    assert crc(data, starts, sizes).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]


TEXTS = ["Hello, World ÀÉ日本 x1", None, "", "a" * 300 + " b", "...", "end", "One two THREE four five six seven " * 20, "z" * 50]


@pytest.mark.parametrize("limit", [7, 40, 1 << 20])
def test_words_do_not_depend_on_the_pieces(limit):
    got = [
        (int(r), bytes(w.data[w.offsets[i] : w.offsets[i + 1]]).decode())
        for w in byte_words.words_of(pa.array(TEXTS), limit) for i, r in enumerate(w.rows)
    ]
    assert got == [(i, w) for i, t in enumerate(TEXTS) for w in words(t)]


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_features_of_several_words(monkeypatch, limit):
    cut = byte_words.words_of
    monkeypatch.setattr(resampling, "words_of", lambda column: cut(column, limit))
    got = Counter()
    for _, rows, buckets in resampling.features_of(pa.array(TEXTS), resampling.PositionCrc(8), 3, 997):
        got.update(zip(rows.tolist(), buckets.tolist(), strict=True))
    want = Counter()
    for i, t in enumerate(TEXTS):
        w = words(t)
        want.update((i, zlib.crc32(" ".join(w[k : k + n]).encode()) % 997) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert got == want


def test_resampling_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("the quick brown fox",), (None,)], "text string")
    rows = resampling.resample(odd, target, percent=50, min_words=3, carry=["lang", "source"]).toPandas()
    assert len(rows) == odd.count()
    able = rows[rows["n_words"] >= 3]
    drawn = able.dropna(subset=["rank"]).sort_values("rank")
    assert drawn["rank"].tolist() == list(range(1, len(able) // 2 + 1))
    assert drawn["score"].is_monotonic_decreasing and able[able["rank"].isna()]["score"].max() <= drawn["score"].min()
    assert (rows[rows["n_features"] == 0]["weight"] == 0).all()
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == odd.count()
    with pytest.raises(ValueError, match="score"):
        resampling.resample(odd.withColumn("score", F.lit(1)), target, carry=["score"])
