import random

import pytest
from pyspark.sql import functions as F

from genoplane.operators import folds as D
from genoplane.operators import labeling as B
from genoplane.operators import metrics as M

MANIFEST = {c: "x" for c in B.MANIFEST_COLUMNS} | {"target_label": "positive", "evidence_tier": "A", "evidence_source": "literature", "dataset_role": "train_candidate", "label_date": "2024-01-31"}


def manifest(spark, *changes):
    rows = [MANIFEST | {"assembly_accession": f"GCF_{i:09d}.1", "source_genome_id": f"g{i}"} | c for i, c in enumerate(changes, 1)]
    return spark.createDataFrame([tuple(r[c] for c in B.MANIFEST_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in B.MANIFEST_COLUMNS))


def features(spark, *keys):
    return spark.createDataFrame([(k, "ok", float(i)) for i, k in enumerate(keys)], "accession_id string, notes string, score double")


KEYS = [f"GCF_{i:09d}.1" for i in range(1, 7)]


def test_label_dataset_joins_masks_and_reports(spark):
    labels = manifest(spark, {}, {"target_label": " uncertain "}, {"evidence_tier": "C"}, {"evidence_reference": ""}, {"dataset_role": "edge_case"}, {"target_label": "negative"})
    got = B.label_dataset(features(spark, *KEYS[::-1], "GCA_000000099.1"), labels)
    assert [r["assembly_accession"] for r in got.full.collect()] == KEYS
    assert [r["assembly_accession"] for r in got.training.collect()] == [KEYS[0], KEYS[5]]
    assert {"notes", "notes_feature"} <= set(got.full.columns)
    r = got.report
    assert (r["matched_rows"], r["training_ready_rows"], r["excluded_from_training_count"], r["unmatched_feature_count"], r["unmatched_feature_accessions"]) == (6, 2, 4, 1, ["GCA_000000099.1"])
    assert r["training_exclusion_reasons"] == {"target_label_not_binary": 1, "evidence_tier_not_allowed": 1, "dataset_role_not_train_candidate": 1, "missing_evidence_reference": 1, "missing_source_genome_id": 0}
    assert r["target_label_distribution"] == {"positive": 4, "negative": 1, "uncertain": 1} and len(r["validation_warnings"]) == 2
    with pytest.raises(B.LabelingError):
        B.label_dataset(features(spark, *KEYS[:5]), labels, strict_mismatches=True)


def test_all_violations_are_gathered(spark):
    bad = manifest(spark, {"assembly_accession": "GCF_1.1"}, {"evidence_tier": "Z"}, {"label_date": "2024-02-30"}, {"organism_name": " "}, {}, {})
    bad = bad.unionByName(bad.limit(10).filter("assembly_accession = 'GCF_000000005.1'"))
    with pytest.raises(B.LabelingError) as e:
        B.label_dataset(features(spark, "nope", KEYS[0], KEYS[0]), bad)
    errors = " ".join(e.value.report["validation_errors"])
    for word in ("manifest bad_accession", "vocabulary:evidence_tier", "bad_date", "blank:organism_name", "manifest duplicate", "features bad_accession", "features duplicate"):
        assert word in errors
    with pytest.raises(B.LabelingError):
        B.label_dataset(features(spark), manifest(spark))
    with pytest.raises(B.LabelingError):
        B.label_dataset(features(spark, *KEYS), manifest(spark, {}).drop("notes"))


def grouped(spark, n=80, groups=16):
    rows = [(f"a{i}", f"g{i % groups}", "positive" if i % groups < groups / 2 else "negative") for i in range(n)]
    return spark.createDataFrame(rows, "acc string, grp string, label string")


COLUMNS = ("acc", "grp", "label")


def test_folds_are_sound_and_repeatable(spark):
    df = grouped(spark)
    assert D.check_dataset(df, *COLUMNS, 4, 2)["n_groups"] == 16
    m = D.fold_manifest(df, *COLUMNS, 4, 2, seed=1)
    assert all(r["n_violations"] == 0 for r in D.manifest_violations(df, m, *COLUMNS, 4, 2).collect())
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(m) == rows(D.fold_manifest(df.repartition(7), *COLUMNS, 4, 2, seed=1)) != rows(D.fold_manifest(df, *COLUMNS, 4, 2, seed=2))
    training, validation = D.fold_rows(df, m, 1, 2, "acc", "grp")
    assert training.count() + validation.count() == 80 and D.shared_groups(training, validation, "grp").count() == 0
    counts = D.fold_counts(df, m, "grp", "label").filter("repeat = 1 AND fold = 2").first()
    assert (counts["training_rows"], counts["validation_rows"]) == (training.count(), validation.count())


def test_groups_are_dealt_to_the_fold_with_the_fewest_rows(spark):
    rng = random.Random(6)
    for _ in range(200):
        k, n, c, first = rng.randint(2, 6), rng.randint(1, 9), rng.randint(0, 40), rng.randint(0, 5)
        loads = [rng.randint(0, 60) for _ in range(k)]
        got, level = [0] * k, list(loads)
        for _ in range(c):
            f = min(range(k), key=lambda f: (level[f], (f - first) % k))
            got[f], level[f] = got[f] + 1, level[f] + n
        assert D.level_loads(loads, n, c, first % k) == got
    rows = [(f"a{g}-{i}", f"g{g}", "positive" if g % 2 else "negative") for g in range(60) for i in range(200 if g < 2 else 90 if g < 6 else g % 5 + 1)]
    df = spark.createDataFrame(rows, "acc string, grp string, label string")
    m = D.fold_manifest(df, *COLUMNS, 4, 3)
    assert all(r["n_violations"] == 0 for r in D.manifest_violations(df, m, *COLUMNS, 4, 3).collect())
    for r in m.groupBy("repeat", "label").pivot("fold").count().collect():
        sizes = sorted(r[2:])
        assert sizes[-1] == 200 or sizes[-1] - sizes[0] <= 90
    largest = {tuple(r) for r in m.filter("grp IN ('g0', 'g1')").select("repeat", "fold").distinct().collect()}
    assert len({f for _, f in largest}) > 1
    assert [tuple(r)[:2] for r in D.sorted_manifest(m, "acc").select("repeat", "fold").collect()] == sorted(tuple(r) for r in m.select("repeat", "fold").collect())


def test_sides_of_a_fold_need_rows_of_both_classes(spark):
    df = grouped(spark)
    D.check_fold(df.filter("grp <> 'g0'"), df.filter("grp IN ('g0')").unionAll(df.filter("grp = 'g9'").withColumn("grp", F.lit("new"))), "grp", "label")
    for training, validation in ((df, df.filter("false")), (df, df.filter("label = 'positive'")), (df, df)):
        with pytest.raises(D.LeakageError):
            D.check_fold(training, validation, "grp", "label")


def test_manifest_checks_find_each_breach(spark):
    df = grouped(spark)
    m = D.fold_manifest(df, *COLUMNS, 4, 1)
    found = lambda x: {r["check"] for r in D.manifest_violations(df, x, *COLUMNS, 4, 1).collect() if r["n_violations"]}
    assert found(m.filter("acc <> 'a3'")) == {"missing_row"}
    assert found(m.unionAll(m.filter("acc = 'a3'"))) == {"repeated_row"}
    assert "split_group" in found(m.withColumn("fold", F.when(F.col("acc") == "a3", F.col("fold") % 4 + 1).otherwise(F.col("fold")).cast("int")))
    assert found(m.withColumn("label", F.when(F.col("acc") == "a3", "odd").otherwise(F.col("label")))) == {"changed_row"}
    assert "unexpected_fold" in found(m.withColumn("fold", F.col("fold") + 1)) and found(m.withColumn("split", F.lit("train"))) == {"not_validation"}


@pytest.mark.parametrize(("change", "splits"), [("acc <> 'a0'", True), ("acc <> 'a0'", 1), ("grp IN ('g0', 'g9')", 2), (None, 2)])
def test_bad_datasets_are_refused(spark, change, splits):
    df = grouped(spark)
    df = df.filter(change) if change else df.unionAll(df.limit(1))
    with pytest.raises(D.LeakageError):
        D.check_dataset(df, *COLUMNS, splits, 1)


def test_mixed_groups_are_refused(spark):
    df = grouped(spark).withColumn("label", F.when(F.col("acc") == "a3", "negative").otherwise(F.col("label")))
    assert [tuple(r) for r in D.mixed_groups(df, "grp", "label").collect()] == [("g3", 2)]
    with pytest.raises(D.LeakageError, match="g3"):
        D.check_dataset(df, *COLUMNS, 2, 1)


def brute_curves(rows):
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, before = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp, k = sum(x >= s for x in pos), sum(x >= s for _, x in rows)
        ap += (tp - before) / len(pos) * tp / k if pos else 0
        before = tp
    return auc, ap if pos else None


def test_metrics_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, rng.random() < 0.4 if g != "neg" else False, round(rng.random(), 1)) for g in ("a", "b", "neg") for _ in range(120)]
    df = spark.createDataFrame([*rows, ("a", None, 0.5), ("a", True, float("nan"))], "model_name string, t boolean, s double")
    got = {r["model_name"]: r for r in M.binary_metrics(df.filter("NOT isnan(s)"), ["model_name"], F.col("t"), F.col("s") >= 0.5, F.col("s")).collect()}
    for g in ("a", "b", "neg"):
        mine = [(t, s) for m, t, s in rows if m == g]
        auc, ap = brute_curves(mine)
        r = got[g]
        assert (r["roc_auc"], r["average_precision"]) == (pytest.approx(auc) if auc is not None else None, pytest.approx(ap) if ap is not None else None)
        assert r["tp"] == sum(t and s >= 0.5 for t, s in mine) and r["tn"] + r["fp"] == r["negative_support"]
        assert r["accuracy"] == pytest.approx(sum(t == (s >= 0.5) for t, s in mine) / 120)
    assert got["neg"]["precision"] == got["neg"]["recall"] == got["neg"]["f1"] == 0.0
    with pytest.raises(M.MetricError):
        M.check_probabilities(df, "s")


def test_aggregation_and_ranking(spark):
    folds = spark.createDataFrame([("m1", 0.8, 0.5, 0.5), ("m1", 0.6, 0.5, float("nan")), ("m2", 0.7, 0.5, 0.5), ("m2", 0.7, 0.5, None), ("m0", 0.1, 0.9, 0.9)], "model_name string, average_precision double, balanced_accuracy double, f1 double")
    agg = M.aggregate_folds(folds, metrics=("average_precision", "balanced_accuracy", "f1"))
    f1 = agg.filter("model_name = 'm1' AND metric = 'f1'").first()
    assert (f1["fold_mean"], f1["fold_std"], f1["valid_fold_count"], f1["total_fold_count"]) == (0.5, 0.0, 1, 2)
    ranked = M.rank_models(agg).orderBy("rank").collect()
    assert [(r["model_name"], r["tied_with_best"]) for r in ranked] == [("m1", True), ("m2", True), ("m0", False)]
    assert M.selection_report(M.rank_models(agg))["selected"] == "m1"
    for bad in (agg.filter("metric <> 'f1'"), agg.unionAll(agg), agg.filter("false")):
        with pytest.raises(M.SelectionError):
            M.rank_models(bad)
    with pytest.raises(M.SelectionError):
        M.rank_models(agg, tie_breakers=("f1", "f1"))


def test_coverage(spark):
    df = spark.createDataFrame([("m", 1, "a"), ("m", 1, "a"), ("m", 1, "b")], "model_name string, repeat int, assembly_accession string")
    assert [(r["assembly_accession"], r["n"]) for r in M.prediction_coverage(df).collect()] == [("a", 2)]
