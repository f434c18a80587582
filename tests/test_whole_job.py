"""Queries and commands that did less than the whole job."""

import inspect
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from genoplane.operators import labeling as B
from genoplane.operators import models as M
from genoplane.plans import evaluation_queries as E
from genoplane.sources import sinks as S


@pytest.fixture
def vectors(spark, tmp_path):
    rows = [(i, [0.0] * 19 + [float(i % 10 < 5)], i % 10) for i in range(80)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_models_see_every_element_of_a_vector(spark, vectors):
    rows = E._vectors(spark, vectors)
    assert M.feature_names(rows) == [f"e{i}" for i in range(20)]
    assert all((r["e19"] == 1.0) == (r["target_label"] == "positive") for r in rows.collect())


def test_model_queries_run_all_folds_repeats_and_trees(spark, vectors, monkeypatch):
    calls = []
    monkeypatch.setattr(E, "cross_validate", lambda df, models, **options: calls.append((models, options)) or SimpleNamespace(aggregate=df))
    monkeypatch.setattr(E, "_soundness", lambda rows, aggregate: aggregate)
    for query in (E.m3_logreg_cv, E.m4_forest_cv, E.m5_svm_cv):
        query(spark, vectors)
    for models, options in calls:
        bound = inspect.signature(M.cross_validate).bind(None, models, **options)
        bound.apply_defaults()
        got = inspect.signature(M.train).bind(None, models[0], **bound.arguments["options"])
        got.apply_defaults()
        assert (bound.arguments["n_splits"], bound.arguments["n_repeats"]) == (5, 3)
        assert (got.arguments["trees"], got.arguments["max_depth"]) == (300, 30)
    assert [m for m, _ in calls] == [["logistic_regression"], ["random_forest"], ["svc"]]


def manifest(spark, *changes):
    sound = {c: "x" for c in B.MANIFEST_COLUMNS} | {"target_label": "positive", "evidence_tier": "A", "evidence_source": "literature", "dataset_role": "train_candidate", "label_date": "2024-01-31"}
    rows = [sound | {"assembly_accession": f"GCF_{i:09d}.1"} | c for i, c in enumerate(changes, 1)]
    return spark.createDataFrame([tuple(r[c] for c in B.MANIFEST_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in B.MANIFEST_COLUMNS))


def test_every_offender_is_named(spark, tmp_path):
    bad = manifest(spark, {"label_date": "2024-02-30"}, {"label_date": "2024-02-30", "evidence_tier": "Z"}, {"organism_name": " "}, {"assembly_accession": "GCF_000000001.1"}, {"assembly_accession": "GCF_9"})
    got = B.check_offenders(B.trimmed(bad), B.manifest_row_checks(), "assembly_accession", F.col("assembly_accession"))
    assert {tuple(r) for r in got.collect()} == {
        ("bad_date", "2024-02-30", None, 2), ("vocabulary:evidence_tier", "Z", None, 1), ("blank:organism_name", None, "GCF_000000003.1", 1), ("duplicate:assembly_accession", "GCF_000000001.1", None, 2), ("bad_accession", "GCF_9", None, 1),
    }
    features = spark.createDataFrame([("", 1.0), ("GCF_000000001.1", 2.0), ("GCF_000000001.1", 3.0)], "accession_id string, score double")
    with pytest.raises(B.LabelingError):
        S.label_and_write(features, bad, f"{tmp_path}/full.parquet", f"{tmp_path}/train.parquet", f"{tmp_path}/report.json")
    rows = json.loads((tmp_path / "report.json").read_text())["offenders"]
    assert sum(r["table_name"] == "manifest" for r in rows) == 5
    assert {(r["check"], r["value"]) for r in rows if r["table_name"] == "features"} == {("blank:accession_id", None), ("duplicate:accession_id", "GCF_000000001.1")}


def test_reports_hold_every_unmatched_key_and_failure(spark, tmp_path):
    labels = manifest(spark, *[{}] * 30)
    keys = [f"GCA_{i:09d}.1" for i in range(25)]
    features = spark.createDataFrame([(k, 1.0) for k in [*keys, "GCF_000000001.1"]], "accession_id string, score double")
    S.label_and_write(features, labels, f"{tmp_path}/full.parquet", f"{tmp_path}/train.parquet", f"{tmp_path}/report.json")
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["unmatched_feature_accessions"] == keys and len(report["unmatched_label_accessions"]) == report["unmatched_label_count"] == 29
    with pytest.raises(B.LabelingError):
        S.label_and_write(features, labels, f"{tmp_path}/f.parquet", f"{tmp_path}/t.parquet", f"{tmp_path}/strict.json", strict_mismatches=True)
    assert json.loads((tmp_path / "strict.json").read_text())["unmatched_feature_accessions"] == keys
    failures = spark.range(130).select(F.format_string("g%03d", "id").alias("accession"), F.lit("why").alias("error"))
    S.run_metadata(features, 156, failures, f"{tmp_path}/run.json")
    assert json.loads((tmp_path / "run.json").read_text())["failures"] == [{"accession": f"g{i:03d}", "error": "why"} for i in range(130)]
    S.write_report({}, f"{tmp_path}/none.json", {"failures": failures.limit(0)})
    assert json.loads((tmp_path / "none.json").read_text()) == {"failures": []}


def test_folds_read_labels_and_genomes_in_any_writing(spark, tmp_path):
    rows = [(10 * i + j, g, label) for i in range(16) for j, (g, label) in enumerate(zip((f"GCF_{100 + i:09d}.1", f"gca_{100 + i:09d}.2"), ("positive", " POSITIVE") if i < 8 else ("negative ", "Negative")))]
    rows += [(900, "GCF_000000999.1", "positive"), (901, "GCA_000000999.2", "NEGATIVE"), (902, "  ", "positive"), (903, "GCF_000000100.1", None)]
    spark.createDataFrame(rows, "record_id bigint, source_genome_id string, target_label string").write.parquet(f"{tmp_path}/grouped_training_dataset.parquet")
    folds = E.w8_fold_manifest(spark, str(tmp_path)).collect()
    assert {r["assembly_accession"] for r in folds} == {str(i) for i, *_ in rows[:32]} and len(folds) == 96
    assert len({(r["repeat"], int(r["assembly_accession"]) // 10, r["fold"]) for r in folds}) == 48
    assert [tuple(r) for r in E.a16_mixed_groups(spark, str(tmp_path)).collect()] == [("acc:999", 2)]
    got = E.v11_dataset_summary(spark, str(tmp_path)).first()
    assert [got[c] for c in ("all_rows", "n_rows", "n_groups", "unlabelled_rows", "blank_group_rows", "mixed_rows")] == [36, 34, 17, 1, 1, 2]
    assert all(r["n_violations"] == 0 for r in E.v13_manifest_checks(spark, str(tmp_path)).collect())
