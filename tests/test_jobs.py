import random

import pytest

from buyerscope import schema as S
from buyerscope.models.learners import Learner, probability
from buyerscope.models.selection import select_features
from buyerscope.operators.splits import stratified_folds
from buyerscope.plans import jobs
from buyerscope.sources.customers import read_dated
from buyerscope.storage import write_once

NAMES = [f.name for f in S.raw_schema().fields]


def customer(i: int, source: random.Random) -> dict:
    good = source.random() < 0.4
    day, month = source.randint(13, 28), source.randint(1, 12)
    return {
        "ID": i, "Year_Birth": 1950 + source.randint(0, 45), "Education": source.choice(["PhD", "Master", "Basic"]),
        "Marital_Status": source.choice(["Single", "Married", "Unknown"]), "Income": source.choice([30000, 50000, "", 80000]),
        "Kidhome": source.randint(0, 2), "Teenhome": source.randint(0, 1),
        "Dt_Customer": f"{day}-{month:02d}-2013" if i % 2 else f"{day % 12 + 1}/{month}/2013",
        "Recency": source.randint(0, 40 if good else 99), "MntWines": source.randint(200, 900) if good else source.randint(0, 300),
        **{c: source.randint(0, 100) for c in S.SPEND[1:]},
        S.DEALS: source.randint(0, 5), **{c: source.randint(0, 9) for c in S.CHANNELS}, S.VISITS: source.randint(0, 9),
        **{c: int(source.random() < 0.2) for c in S.CAMPAIGNS}, "Complain": 0, "Z_CostContact": 3, "Z_Revenue": 11,
        "Target": int(good),
    }


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    source, folder = random.Random(5), tmp_path_factory.mktemp("csv")
    rows = [customer(i, source) for i in range(300)]
    out = []
    for name, part, columns in (("train", rows[:220], NAMES), ("test", rows[220:], NAMES[:-1])):
        path = folder / f"{name}.csv"
        path.write_text("\n".join([",".join(columns), *[",".join(str(r[c]) for c in columns) for r in part]]) + "\n")
        out.append(str(path))
    return out


def test_full_run_writes_everything(spark, files, tmp_path):
    out = str(tmp_path / "run")
    grids = {"logistic_regression": {"C": [0.1, 1.0]}, "decision_tree": {"max_depth": [3]}, "oracle": {"x": [1]}}
    tables = jobs.run(spark, *files, out, grids=grids)
    comparison = {r["Model"]: r for r in tables["comparison"].collect()}
    assert comparison["oracle"]["error"] and comparison["oracle"]["Accuracy"] is None
    assert comparison["logistic_regression"]["ROC AUC"] > 0.7
    predictions = spark.read.csv(f"{out}/predictions", header=True, inferSchema=True)
    assert predictions.columns == ["ID", "Target"] and predictions.count() == 80
    record = spark.read.json(f"{out}/experiments").first()
    assert record["test_samples"] == 80 and record["positive_predictions"] == predictions.where("Target = 1").count()
    assert spark.read.parquet(f"{out}/evaluation/thresholds").count() == 18
    assert spark.read.parquet(f"{out}/cv_metrics").first()["cv_folds"] == 5
    # The stored scorer takes raw rows, without any other file.
    again = jobs.score(jobs.load_scorer(f"{out}/model"), read_dated(spark, files[1], False))
    same = again.join(predictions.withColumnRenamed("Target", "t"), "ID").where("prediction <> t").count()
    assert same == 0
    # The other fitted models are stored as well, and one call scores a file.
    summary = jobs.score_file(spark, f"{out}/models/decision_tree", files[1], f"{out}/again", with_probability=True).first()
    assert summary["n"] == 80 and 0 <= summary["min_p"] <= summary["max_p"] <= 1
    assert spark.read.csv(f"{out}/again", header=True).columns == ["ID", "Target", "Probability"]


def test_prepare_applies_training_values_to_other_rows(spark, files):
    prepared, test = jobs.load_and_prepare(spark, *files)
    assert prepared.train.columns == ["key", "label", "features"]
    assert test.count() == 80 and test.select("features").first()[0].size == len(prepared.names)
    assert "Target" not in prepared.names and "ID" not in prepared.names and "TotalSpent" in prepared.names


def test_final_training(spark, files):
    prepared, _ = jobs.load_and_prepare(spark, *files)
    small = {
        kind: {"n_estimators": ("int", 2, 3), "learning_rate": ("log", 0.05, 0.3), "max_depth": ("int", 2, 2)}
        for kind in ("lightgbm", "xgboost")
    }
    done = jobs.train_final(prepared, trials=1, n_features=8, spaces=small, folds=2)
    assert len(done.features) == 8 and 0 < done.threshold < 1
    assert done.scores.count() == 220
    scored = jobs.score(done.scorer, read_dated(spark, files[1], False))
    assert scored.count() == 80
    row = scored.first()
    assert row["prediction"] == int(row["p"] >= done.threshold)


def test_report_has_every_table(spark, files):
    from buyerscope.operators.cleaning import Cleaner

    train = read_dated(spark, files[0])
    tables = jobs.eda_report(Cleaner().fit(train).transform(train))
    assert tables["shape"].first()["n_rows"] == 220
    for name, table in tables.items():
        assert table.columns, name
    assert tables["campaigns_by_label"].count() == 10


def test_chosen_votes_are_refitted_on_all_rows(spark, files):
    prepared, _ = jobs.load_and_prepare(spark, *files)
    bases = [
        Learner(kind="logistic_regression", name="lr"), Learner(kind="decision_tree", name="dt", params={"max_depth": 2}),
        Learner(kind="decision_tree", name="stump", params={"max_depth": 1}),
    ]
    done = jobs.choose_subset(prepared, bases)
    table = {r["models"]: r["roc_auc"] for r in done.candidates.collect()}
    assert set(table) == {"lr+dt", "lr+stump", "dt+stump", "lr+dt+stump"}
    assert table["+".join(done.weights)] == max(table.values()) and set(done.weights.values()) == {1.0}
    raw = read_dated(spark, files[1], False)
    got = {r["ID"]: (r["prediction"], r["p"]) for r in jobs.score(done.scorer, raw).collect()}
    assert len(got) == 80 and all(d == int(p > 0.5) for d, p in got.values())
    # The members' own scores, fitted on all rows, average to the vote.
    ready = jobs.vectors(prepared, raw)
    members = [b.fit(prepared.train).transform(ready) for b in bases if b.opt("name") in done.weights]
    names = list(done.weights)
    own = [{r["ID"]: r["p"] for r in m.select("ID", probability(n).alias("p")).collect()} for m, n in zip(members, names)]
    for key, (_, p) in got.items():
        assert p == pytest.approx(sum(o[key] for o in own) / len(own), abs=1e-9)

    pair = jobs.choose_weight(prepared, *bases[:2])
    areas = {round(r["weight"], 1): r["roc_auc"] for r in pair.candidates.collect()}
    assert len(areas) == 11 and areas[round(pair.weights["lr"], 1)] == max(areas.values())
    assert sum(pair.weights.values()) == pytest.approx(1.0)
    assert jobs.score(pair.scorer, raw).count() == 80


def test_feature_selection_methods(spark, files):
    prepared, _ = jobs.load_and_prepare(spark, *files)
    names = prepared.names
    base = Learner(kind="decision_tree", name="dt", params={"max_depth": 3})
    folds = write_once(stratified_folds(prepared.train, "key", "label", k=2), "selection_folds")
    assert select_features(folds, names, "first", top_n=3) == names[:3]
    assert select_features(folds, names, top_n=3) == names[:3]
    best = select_features(folds, names, "attribution", base, 4)
    assert len(best) == 4 and set(best) <= set(names)
    assert len(select_features(folds, names, "permutation", base, 2, repeats=1)) == 2
    kept = select_features(folds, names, "elimination", base, 2, step=len(names) // 2)
    assert len(kept) == 2 and set(kept) <= set(names)
    with pytest.raises(ValueError):
        select_features(folds, names, "other")


def test_model_queries_run_at_full_size(monkeypatch):
    """Final training and the benchmark get the jobs' defaults, the search 30 points of the whole space."""
    from types import SimpleNamespace

    from buyerscope.models.validation import SPACES, draw_from_space
    from buyerscope.plans import catalog

    calls = {}

    def note(name, result):
        return lambda *args, **options: calls.update({name: (args[1:], options)}) or result

    table = SimpleNamespace(train="train", names=["a"])
    monkeypatch.setattr(catalog, "prepared", lambda spark, folder: table)
    monkeypatch.setattr(catalog, "training", lambda spark, folder: "rows")
    monkeypatch.setattr(catalog, "history", lambda spark, folder: "rows")
    monkeypatch.setattr(catalog, "score", lambda scorer, rows: rows)
    monkeypatch.setattr(catalog, "train_final", note("final_train", SimpleNamespace(scorer=None)))
    monkeypatch.setattr(catalog, "benchmark", note("benchmark", SimpleNamespace(table=None)))
    monkeypatch.setattr(catalog, "cross_validated_search", note("space_search", [None] * 3))
    catalog.final_train(None, "")
    catalog.model_benchmark(None, "")
    catalog.space_search(None, "")
    assert calls["final_train"] == calls["benchmark"] == ((), {})
    assert calls["space_search"][0][1] == draw_from_space(SPACES["catboost"], 30)


def test_tuned_stacks(spark, files):
    """Lean features with a regression on top and raw records with a network, over small grids: every row out of fold, raw rows scored."""
    from buyerscope.features.variants import CompactFeatures, LeanFeatures
    from buyerscope.models.stacking import meta_learner
    from buyerscope.plans.tuned import tuned_stack

    train, test = read_dated(spark, files[0]), read_dated(spark, files[1], False)
    bases = {"logistic_regression": {"C": [0.1, 1.0]}, "lightgbm": {"n_estimators": [3, 5], "num_leaves": [4, 8]}}
    for stage, meta in [
        (lambda df: LeanFeatures(keep_key=True), meta_learner()),
        (lambda df: CompactFeatures().fit(df), meta_learner("mlp", "stack", hidden=[4], max_iter=20)),
    ]:
        done = tuned_stack(train, stage, bases, meta, n_iter=3, folds=2)
        assert done.scores.count() == 220 == done.scores.select("key").distinct().count()
        assert {k: t.count() for k, t in done.searches.items()} == {"logistic_regression": 2, "lightgbm": 3}
        scored = jobs.score(done.scorer, test)
        assert scored.count() == 80 and scored.where("p not between 0 and 1").count() == 0
