import json
import random

import pytest
from pyspark.sql import functions as F

from genoplane.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(80):
        y = i % 8 < 4
        data.append((f"a{i}", f"g{i % 8}", "positive" if y else "negative", rng.gauss(2.0 if y else -2.0, 1.0), float(rng.randint(0, 3)), "B"))
    return spark.createDataFrame(data, "assembly_accession string, source_genome_id string, target_label string, f1 double, f2 double, evidence_tier string").cache()


def test_contract(spark, rows):
    names, classes = M.prepare(rows)
    assert names == ["f1", "f2"] and classes == {"negative": 40, "positive": 40}
    bad = [rows.withColumn("f1", F.lit("x")), rows.withColumn("f1", F.lit(float("inf"))), rows.withColumn("f2", F.lit(None).cast("double")), rows.withColumn("target_label", F.lit("positive")), rows.drop("f1", "f2"), rows.drop("target_label"), rows.filter("false")]
    for df in bad:
        with pytest.raises(M.TrainingDataError):
            M.prepare(df)
    with pytest.raises(M.TrainingDataError):
        M.train(rows, "perceptron")
    with pytest.raises(M.TrainingDataError):
        M.train(rows, "logistic_regression", imbalance="SMOTE")


def test_features_are_scaled_by_the_population_deviation(rows):
    model = M.train(rows, "logistic_regression")
    got = model.pipeline.transform(rows).select(F.explode(F.transform(M.vector_to_array("scaled"), lambda x: x * x)).alias("v")).agg(F.avg("v")).first()[0]
    assert got == pytest.approx(1.0, abs=1e-9)


def test_one_score_channel_per_model(spark, rows):
    model = M.train(rows, "svc")
    scored = model.score(rows, "decision")
    assert scored.filter("positive_probability IS NOT NULL OR decision_score IS NULL").count() == 0
    assert scored.filter("(decision_score > 0) <> (predicted_label = 'positive')").count() == 0
    named = lambda df, name: df.withColumn("model_name", F.lit(name))
    both = named(scored, "a").unionByName(named(model.score(rows), "b"))
    assert M.score_channels(both) == {"a": "decision_score", "b": "positive_probability"}
    for bad in (named(scored, "a").unionByName(named(model.score(rows), "a")), named(model.score(rows), "b").withColumn("positive_probability", F.when(F.col("f2") > 0, F.col("positive_probability"))), named(model.score(rows), "b").withColumn("positive_probability", F.lit(1.5))):
        with pytest.raises(M.MetricError):
            M.score_channels(bad)
    with pytest.raises(M.ArtifactError):
        M.train(rows, "random_forest", trees=3).score(rows, "decision")
    got = M.cross_validate(rows, ["logistic_regression"], n_splits=2, n_repeats=1, channel="decision")
    assert got.aggregate.filter("metric = 'roc_auc'").first()["fold_mean"] > 0.9


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest", "svc"])
def test_models_learn_a_clear_signal(rows, name):
    held_out, training = rows.filter("source_genome_id IN ('g0', 'g7')"), rows.filter("source_genome_id NOT IN ('g0', 'g7')")
    scored = M.train(training, name, trees=10, max_depth=4).score(held_out).collect()
    assert sum(r["predicted_label"] == r["target_label"] for r in scored) >= 18
    assert all(0 <= r["positive_probability"] <= 1 for r in scored)


def test_grouped_cross_validation(rows):
    got = M.cross_validate(rows, ["logistic_regression"], n_splits=2, n_repeats=2)
    assert got.predictions.count() == 160 and got.fold_metrics.count() == 4
    assert got.ranking.first()["model_name"] == "logistic_regression"
    assert got.aggregate.filter("metric = 'roc_auc'").first()["fold_mean"] > 0.9
    with pytest.raises(M.MetricError):
        M.cross_validate(rows, ["logistic_regression"], n_splits=2, n_repeats=1, manifest=got.manifest.filter("repeat = 1 AND assembly_accession <> 'a0'"))


def test_predictions_do_not_hold_the_fitted_models(rows):
    got = M.cross_validate(rows, ["random_forest"], n_splits=2, n_repeats=1, trees=3, max_depth=3)
    plan = got.predictions._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "UDF" not in plan and "InMemoryRelation" not in plan
    assert got.predictions.count() == 80 and got.predictions.select("assembly_accession").distinct().count() == 80


def test_stored_models_keep_their_contract(rows, tmp_path):
    model = M.train(rows, "logistic_regression")
    path = f"file://{tmp_path}/m"
    M.save_model(model, path, "d", "f")
    loaded, contract = M.load_model(path)
    assert contract["features"] == ["f1", "f2"] and M.round_trip_mismatches(model, loaded, rows, "assembly_accession").count() == 0
    with pytest.raises(Exception):
        M.save_model(model, path, "d", "f")
    with pytest.raises(M.ArtifactError):
        M.save_model(model, path + "2", "", "f")
    with pytest.raises(M.ArtifactError):
        loaded.score(rows.drop("f1"))
    with pytest.raises(M.ArtifactError):
        M.load_model(path + "3")
    M.save_model(model, path, "d2", "f", overwrite=True)
    assert M.load_model(path)[1]["dataset_fingerprint"] == "d2" and contract["hyperparameters"]["maxIter"] == 1000 and contract["label_mapping"] == {"negative": 0, "positive": 1}


@pytest.mark.parametrize("name", ["random_forest", "svc"])
def test_forests_and_kernel_models_are_stored_too(rows, tmp_path, name):
    model = M.train(rows, name, trees=5, max_depth=4)
    M.save_model(model, f"file://{tmp_path}/m", "d", "f")
    loaded, contract = M.load_model(f"file://{tmp_path}/m")
    assert contract["model_name"] == name and M.round_trip_mismatches(model, loaded, rows, "assembly_accession").count() == 0


def test_a_contract_at_odds_with_itself_is_refused(spark, rows, tmp_path):
    path = f"file://{tmp_path}/m"
    M.save_model(M.train(rows, "logistic_regression"), path, "d", "f")
    good = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    for change in ({"label_mapping": {"negative": 1, "positive": 0}}, {"target": ""}, {"features": ["f1", "f1"]}, {"version": "0"}, {"hyperparameters": None}):
        bad = good | change
        if bad["hyperparameters"] is None:
            del bad["hyperparameters"]
        spark.createDataFrame([(json.dumps(bad),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
        with pytest.raises(M.ArtifactError):
            M.load_model(path)
