import pytest

from buyerscope import storage


def test_written_tables_go_to_the_configured_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_CHECKPOINT_DIR", "spark.buyerscope.test.dir")
    monkeypatch.setattr(storage, "_written", {})
    spark.conf.set("spark.buyerscope.test.dir", str(tmp_path))
    try:
        table = storage.write_once(spark.range(5), "five")
        assert table.count() == 5 and [p.name for p in tmp_path.iterdir()][0].startswith("five-")
        assert storage.remove_written(spark) == 1 and not list(tmp_path.iterdir())
    finally:
        spark.conf.unset("spark.buyerscope.test.dir")


def test_a_cluster_needs_the_setting(spark, monkeypatch):
    monkeypatch.setattr(storage, "_CHECKPOINT_DIR", "spark.buyerscope.unset.dir")

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = spark.conf, Context()

    with pytest.raises(ValueError, match="spark.buyerscope.unset.dir"):
        storage.shared_root(Session())
