"""Shards against a plain loop of the jump hash, and in sessions with different histories."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buyerscope.llm import registry, sharding


def plain_jump(key, n):
    at, target, k = -1, 0, 0
    while target < n:
        at = target
        drawn = int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 1.0
        target, k = int((at + 1) * float(16**13) // drawn), k + 1
    return at


def test_shards_and_slots_of_the_query(spark, folder):
    rows = registry.queries()["op9_jump_shards"](spark, folder).toPandas()
    assert rows["shard"].tolist() == [plain_jump(i, 40) for i in rows["doc_id"]]
    assert rows["grown_shard"].tolist() == [plain_jump(i, 41) for i in rows["doc_id"]]
    rows["mark"] = [hashlib.md5(f"{i}|{c}".encode()).hexdigest() for i, c in zip(rows["doc_id"], rows["text_crc32"], strict=True)]
    for _, g in rows.groupby("shard"):
        assert g.sort_values("mark")["slot"].tolist() == list(range(len(g)))


def test_clashing_names_pass_through(spark, odd):
    clashing = odd
    for name in ("slot", "SLOT_mark", "number_tie", "number_place", "_s_mark"):
        clashing = clashing.withColumn(name, F.lit(name))
    placed = sharding.number_slots(sharding.assign_shards(clashing, "doc_id", 3), "doc_id", "text").toPandas()
    assert len(placed) == odd.count()
    for name in ("SLOT_mark", "number_tie", "number_place", "_s_mark"):
        assert set(placed[name]) == {name}
    for _, g in placed.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


SCRIPT = """
import sys
from buyerscope.llm import registry
from buyerscope.session import build_session
spark = build_session("history", "local[2]", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
for _ in range(int(sys.argv[2])):
    spark.read.parquet(sys.argv[1] + "/documents.parquet")
for name in ("op9_jump_shards", "op3_temporal_url_filter"):
    print(name, registry.queries()[name](spark, sys.argv[1]).count())
"""


@pytest.mark.parametrize("reads", [0, 1, 2, 3])
def test_earlier_reads_of_a_fresh_session_do_not_matter(folder, reads):
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", SCRIPT, folder, str(reads)], cwd=root, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2_000:]
    assert "op9_jump_shards 200" in done.stdout and "op3_temporal_url_filter" in done.stdout
