"""Classifiers, grouped cross-validation, and stored models with their contract."""

from __future__ import annotations

import gc
import json
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoplane.operators.folds import check_dataset, check_fold_counts, fold_manifest, manifest_violations, sorted_manifest
from genoplane.operators.metrics import MetricError, aggregate_folds, binary_metrics, prediction_coverage, rank_models, score_channels
from genoplane.session import cut_lineage, release

# Columns that are never features, and the version of stored models.
METADATA_COLUMNS = ("accession_id", "status", "assembly_accession", "organism_name", "strain", "evidence_tier", "evidence_source", "evidence_reference", "taxonomy_group", "source_genome_id", "dataset_role", "label_curator", "label_date", "notes")
ARTIFACT_VERSION = "1.1"
PLATT_PARTS = 3
ROWS_PER_TASK = 5_000
CLASSES = ("negative", "positive")


class TrainingDataError(ValueError):
    """A training table that breaks its contract."""


class ArtifactError(ValueError):
    """A stored model that is incomplete, of another version, or does not fit the data."""


def feature_names(df: DataFrame, target: str = "target_label", metadata: Sequence[str] = METADATA_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in metadata and c != target]


def prepare(df: DataFrame, target: str = "target_label", metadata: Sequence[str] = METADATA_COLUMNS) -> tuple[list[str], dict[str, int]]:
    """Check a training table; returns (feature names, rows per class).

    Column names have to be unique, features numeric and finite (null counts as not finite), and the target
    exactly the two classes without nulls. One aggregate pass.
    """
    if len(set(df.columns)) < len(df.columns):
        raise TrainingDataError("repeated column names")
    if target not in df.columns:
        raise TrainingDataError(f"no column {target}")
    names = feature_names(df, target, metadata)
    if not names:
        raise TrainingDataError("no feature columns")
    types = dict(df.dtypes)
    if bad := [c for c in names if types[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") and not types[c].startswith("decimal")]:
        raise TrainingDataError(f"features that are not numeric: {bad}")
    odd = {c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"o{i}") for i, c in enumerate(names)}
    got = df.agg(*odd.values(), *[F.count_if(F.col(target) == k).alias(f"n_{k}") for k in CLASSES], F.count(F.lit(1)).alias("n")).first()
    if bad := [c for i, c in enumerate(names) if got[f"o{i}"]]:
        raise TrainingDataError(f"features that are not finite: {bad}")
    classes = {k: got[f"n_{k}"] for k in CLASSES}
    if not got["n"] or sum(classes.values()) < got["n"] or not all(classes.values()):
        raise TrainingDataError(f"the target has to be exactly {list(CLASSES)}")
    return names, classes


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht 2007), with gamma = 1 / inputs.

    The projection follows from the seed and the input width, which are stored with the transformer, so nothing is
    fitted; vectors go through Arrow in batches.
    """

    outputs = Param(Params._dummy(), "outputs", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the projection", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "width of the input vectors", TypeConverters.toInt)

    def __init__(self, inputCol: str = "scaled", outputCol: str = "lifted", outputs: int = 256, seed: int = 42, inputs: int = 1) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, outputs=outputs, seed=seed, inputs=inputs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width, outputs = self.getOrDefault(self.inputs), self.getOrDefault(self.outputs)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = rng.normal(0.0, np.sqrt(2.0 / width), (width, outputs))
        shift = rng.uniform(0.0, 2 * np.pi, outputs)
        scale = np.sqrt(2.0 / outputs)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                z = scale * np.cos(np.stack(x.to_numpy()) @ w + shift) if len(x) else np.empty((0, len(shift)))
                yield pd.Series(list(z))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


# The columns that a model's stages add.
STAGE_COLUMNS = ("assembled", "centred", "scaled", "lifted", "margin", "rawPrediction", "probability", "prediction", "sigmoidRaw", "sigmoidPrediction")


@dataclass
class FittedModel:
    """A fitted pipeline with the contract of its inputs; `score` adds predicted_label and the model's score channel.

    All three models give probabilities, so positive_probability is set and decision_score null; with
    ``channel="decision"`` the margin of logistic_regression and svc takes its place. A model never gives both.
    """

    name: str
    pipeline: PipelineModel
    features: list[str]
    classes: dict[str, int] = field(default_factory=dict)
    target: str = "target_label"
    hyperparameters: dict = field(default_factory=dict)

    def score(self, df: DataFrame, channel: str = "probability") -> DataFrame:
        if missing := [c for c in self.features if c not in df.columns]:
            raise ArtifactError(f"missing features: {missing}")
        if clash := [c for c in STAGE_COLUMNS if c in df.columns]:
            df = df.drop(*clash)
        if channel not in ("probability", "decision") or channel == "decision" and self.name == "random_forest":
            raise ArtifactError(f"{self.name} has no channel {channel!r}")
        out = self.pipeline.transform(df)
        label = F.when(F.col("prediction") == 1.0, CLASSES[1]).otherwise(CLASSES[0])
        none = F.lit(None).cast("double")
        probability = vector_to_array("probability")[1] if channel == "probability" else none
        decision = vector_to_array("rawPrediction")[1] if channel == "decision" else none
        return out.select(*df.columns, label.alias("predicted_label"), probability.alias("positive_probability"), decision.alias("decision_score"))


def _scaler(data: DataFrame, names: Sequence[str], n: int) -> list:
    """Fitted stages from the features to ``scaled``: mean 0 and population deviation 1; constant features become 0."""
    assemble = VectorAssembler(inputCols=list(names), outputCol="assembled")
    centre = StandardScaler(inputCol="assembled", outputCol="centred", withMean=True).fit(assemble.transform(data.select(*names)))
    # the scaler divides by the sample deviation, which is larger by this factor
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    return [assemble, centre, ElementwiseProduct(inputCol="centred", outputCol="scaled", scalingVec=Vectors.dense([factor] * len(names)))]


def train(df: DataFrame, name: str, seed: int = 42, imbalance: str = "ClassWeight", target: str = "target_label", metadata: Sequence[str] = METADATA_COLUMNS, trees: int = 300, max_depth: int = 30) -> FittedModel:
    """Fit logistic_regression, random_forest or svc on a checked table.

    Classes are weighted n / (2 x n_class) (``ClassWeight``) or not (``None``). The logistic regression has an
    L2 penalty of strength 1 on features scaled by their population deviation; the forest takes the square root of
    the features per split; svc is a linear SVM on Fourier features of a Gaussian kernel. Its probability is a sigmoid
    of the margin (Platt 1999), fitted without class weights to margins of rows that the SVM had not seen: of three
    parts by hash, each is scored by an SVM fitted on the other two. Scalers are fitted on `df` alone.
    """
    if imbalance not in ("ClassWeight", "None"):
        raise TrainingDataError(f"imbalance handling {imbalance!r} is not supported")
    names, classes = prepare(df, target, metadata)
    n = sum(classes.values())
    weight = {k: n / (2.0 * v) if imbalance == "ClassWeight" else 1.0 for k, v in classes.items()}
    positive = F.col(target) == CLASSES[1]
    data = df.select(*names, F.when(positive, 1.0).otherwise(0.0).alias("_y"), F.when(positive, weight[CLASSES[1]]).otherwise(weight[CLASSES[0]]).alias("_w"))
    data = data.coalesce(n // ROWS_PER_TASK + 1)  # iterations over small tables are one task each, not many empty ones
    common = {"labelCol": "_y", "weightCol": "_w"}
    given = {"seed": seed, "imbalance": imbalance}
    if name == "logistic_regression":
        total = sum(weight[k] * v for k, v in classes.items())
        stages = _scaler(data, names, n)
        last = LogisticRegression(featuresCol="scaled", maxIter=1000, tol=1e-7, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, **common)
        fitted = last.fit(PipelineModel(stages).transform(data))
        return FittedModel(name, PipelineModel([*stages, fitted]), names, classes, target, given | {"regParam": 1.0 / total, "maxIter": 1000})
    if name == "random_forest":
        assemble = VectorAssembler(inputCols=names, outputCol="assembled")
        last = RandomForestClassifier(featuresCol="assembled", numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed, **common)
        return FittedModel(name, PipelineModel([assemble, last.fit(assemble.transform(data))]), names, classes, target, given | {"numTrees": trees, "maxDepth": max_depth})
    if name == "svc":
        stages = [*_scaler(data, names, n), FourierFeatures(seed=seed, inputs=len(names))]
        lifted = PipelineModel(stages).transform(data).select("lifted", "_y", "_w")
        lifted = lifted.withColumn("_part", F.pmod(F.xxhash64(vector_to_array("lifted"), "_y"), F.lit(PLATT_PARTS))).persist(StorageLevel.MEMORY_AND_DISK)
        svm = LinearSVC(featuresCol="lifted", maxIter=100, tol=1e-3, regParam=1.0 / n, **common)
        margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
        seen: list[DataFrame] = []
        for part in range(PLATT_PARTS):
            others = lifted.filter(F.col("_part") != part)
            if others.select("_y").distinct().count() == 2:
                seen.append(margin.transform(svm.fit(others).transform(lifted.filter(F.col("_part") == part))).select("margin", "_y"))
        fitted = svm.fit(lifted)
        margins = reduce(DataFrame.unionByName, seen) if seen else margin.transform(fitted.transform(lifted))
        sigmoid = LogisticRegression(featuresCol="margin", labelCol="_y", maxIter=100, rawPredictionCol="sigmoidRaw", predictionCol="sigmoidPrediction")
        sigmoid = sigmoid.fit(margins)
        lifted.unpersist()
        return FittedModel(name, PipelineModel([*stages, fitted, margin, sigmoid]), names, classes, target, given | {"regParam": 1.0 / n, "maxIter": 100, "outputs": 256})
    raise TrainingDataError(f"unknown model {name!r}")


@dataclass(frozen=True)
class CrossValidation:
    """Folds, out-of-fold predictions, fold metrics, aggregate metrics and ranking."""

    manifest: DataFrame
    predictions: DataFrame
    fold_metrics: DataFrame
    aggregate: DataFrame
    ranking: DataFrame


def cross_validate(
    df: DataFrame, models: Sequence[str] = ("logistic_regression", "random_forest", "svc"), n_splits: int = 5, n_repeats: int = 3, seed: int = 42, accession: str = "assembly_accession", group: str = "source_genome_id", target: str = "target_label",
    manifest: DataFrame | None = None, parallel: int = 4, metadata: Sequence[str] = METADATA_COLUMNS, channel: str = "probability", **options,
) -> CrossValidation:
    """Repeated grouped cross-validation; every model sees the same folds, each fold fits its own scaler.

    A given manifest is checked first. Fits run in a small thread pool over a written table, and the predictions of a fit
    are written as soon as it ends, so that the driver holds the models being fitted and no others. Each row has to be predicted once per model and repeat. The curve metrics of a model come from its one
    score channel, which is checked (`score_channels`). Predictions and fold metrics are sorted by model, repeat, fold
    (and accession), the aggregate by model and metric.
    """
    if not models or len(set(models)) < len(models):
        raise TrainingDataError("models have to be named, each once")
    check_dataset(df, accession, group, target, n_splits, n_repeats)
    prepare(df, target, metadata)
    df = cut_lineage(df, "rows")
    if manifest is None:
        manifest = fold_manifest(df, accession, group, target, n_splits, n_repeats, seed)
    manifest = cut_lineage(manifest, "folds")
    broken = {r["check"]: r["n_violations"] for r in manifest_violations(df, manifest, accession, group, target, n_splits, n_repeats).collect() if r["n_violations"]}
    if broken:
        raise MetricError(f"the fold manifest is not sound: {broken}")

    # a row has its folds beside it, so a fold is a filter; that no group is in two folds of a repeat has been checked
    tags = [F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"_fold{r}") for r in range(1, n_repeats + 1)]
    tagged = cut_lineage(df.join(manifest.groupBy(accession).agg(*tags), accession), "tagged")
    for r in range(1, n_repeats + 1):
        check_fold_counts({(x[0], x[1]): x[2] for x in tagged.groupBy(f"_fold{r}", target).count().collect()}, range(1, n_splits + 1))

    def one(job: tuple[str, int, int]) -> DataFrame:
        name, repeat, fold = job
        training, validation = (tagged.filter(c).select(*df.columns) for c in (F.col(f"_fold{repeat}") != fold, F.col(f"_fold{repeat}") == fold))
        fitted = train(training, name, seed + (repeat - 1) * n_splits + fold - 1, target=target, metadata=metadata, **options)
        scored = fitted.score(validation, channel)
        scored = scored.select(F.lit(name).alias("model_name"), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), accession, group, F.col(target).alias("true_label"), "predicted_label", "positive_probability", "decision_score")
        written = cut_lineage(scored, "scored")
        # the model, its broadcasts and its tasks' closures stay on the driver until both sides collect their garbage
        del fitted, scored
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        return written

    jobs = [(m, r, f) for m in models for r in range(1, n_repeats + 1) for f in range(1, n_splits + 1)]
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(lambda context, job: context.run(one, job), [copy_context() for _ in jobs], jobs))
    predictions = cut_lineage(reduce(DataFrame.unionByName, parts), "predictions")
    if not prediction_coverage(predictions, ("model_name", "repeat", accession)).isEmpty() or predictions.count() != df.count() * n_repeats * len(models):
        raise MetricError("rows were not predicted exactly once per model and repeat")
    release(df, tagged, *parts)
    score_channels(predictions)
    truth, guess, score = F.col("true_label") == CLASSES[1], F.col("predicted_label") == CLASSES[1], F.coalesce("positive_probability", "decision_score")
    folds = binary_metrics(predictions, ["model_name", "repeat", "fold"], truth, guess, score)
    pooled = binary_metrics(predictions, ["model_name"], truth, guess, score)
    aggregate = aggregate_folds(folds, pooled)
    order = ["model_name", "repeat", "fold"]
    return CrossValidation(sorted_manifest(manifest, accession), predictions.orderBy(*order, accession), folds.orderBy(*order), aggregate.orderBy("model_name", "metric"), rank_models(aggregate))


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def save_model(model: FittedModel, path: str, dataset_fingerprint: str, feature_fingerprint: str, overwrite: bool = False) -> None:
    """Store any of the three models as a pipeline with its contract; refuses to replace a stored one unless told to.

    The contract has version, model name, features, target, label mapping, positive class, rows per class,
    hyperparameters and both fingerprints, which have to be given.
    """
    if not dataset_fingerprint or not feature_fingerprint:
        raise ArtifactError("both fingerprints are needed")
    if not model.target:
        raise ArtifactError("the target has no name")
    spark = SparkSession.active()
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        if not overwrite:
            raise ArtifactError(f"{path} exists")
        fs.delete(target, True)
    contract = {
        "version": ARTIFACT_VERSION, "model_name": model.name, "features": model.features, "target": model.target, "label_mapping": {c: i for i, c in enumerate(CLASSES)}, "positive_class": CLASSES[1], "classes": model.classes,
        "hyperparameters": model.hyperparameters, "dataset_fingerprint": dataset_fingerprint, "feature_fingerprint": feature_fingerprint, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
    }
    model.pipeline.write().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/contract")


CONTRACT_KEYS = {"version", "model_name", "features", "target", "label_mapping", "positive_class", "classes", "hyperparameters", "dataset_fingerprint", "feature_fingerprint"}


def load_model(path: str) -> tuple[FittedModel, dict]:
    """(model, contract) of a stored pipeline; raises ArtifactError for another version, a missing key, or a contract at odds with itself."""
    spark = SparkSession.active()
    try:
        contract = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    except Exception as e:
        raise ArtifactError(f"no readable contract under {path}") from e
    if missing := CONTRACT_KEYS - contract.keys():
        raise ArtifactError(f"the contract lacks {sorted(missing)}")
    if contract["version"] != ARTIFACT_VERSION:
        raise ArtifactError(f"version {contract['version']} is not {ARTIFACT_VERSION}")
    if contract["label_mapping"].get(contract["positive_class"]) != 1 or sorted(contract["label_mapping"].values()) != [0, 1]:
        raise ArtifactError("the positive class has to be label 1 of two")
    if not contract["target"] or not contract["features"] or len(set(contract["features"])) < len(contract["features"]) or contract["target"] in contract["features"]:
        raise ArtifactError("the contract needs a target and distinct features that do not include it")
    model = FittedModel(contract["model_name"], PipelineModel.load(f"{path}/pipeline"), contract["features"], contract["classes"], contract["target"], contract["hyperparameters"])
    return model, contract


def round_trip_mismatches(original: FittedModel, loaded: FittedModel, df: DataFrame, key: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose label or probability differs between a model and its stored form."""
    a = original.score(df).select(key, F.col("predicted_label").alias("a_label"), F.col("positive_probability").alias("a_p"))
    b = loaded.score(df).select(key, F.col("predicted_label").alias("b_label"), F.col("positive_probability").alias("b_p"))
    return a.join(b, key).filter((F.col("a_label") != F.col("b_label")) | (F.abs(F.col("a_p") - F.col("b_p")) > tolerance))
