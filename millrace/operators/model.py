"""Fitting, choosing, registering and applying classifiers of the training set."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.features import category_map, encode, top_contributions
from millrace.operators import shapley
from millrace.operators.dataset import chronological_split
from millrace.operators.metrics import baselines, ranking_metrics
from millrace.spec import MODEL_INPUTS
from millrace.workers import reach

MODEL_TYPES = ("gbt", "forest", "logistic")
THRESHOLD = 0.5


def _stages(model_type: str, label: str, params: dict, early: bool) -> list:
    common = {"labelCol": label, "weightCol": "_weight"}
    raw = VectorAssembler(inputCols=MODEL_INPUTS, outputCol="_features")
    if model_type == "gbt":
        # boosting ends when the validation rows stop gaining
        stop = {"validationIndicatorCol": "_valid", "validationTol": 0.001} if early else {}
        return [raw, GBTClassifier(featuresCol="_features", **common, **stop, **({"maxIter": 20, "maxDepth": 4, "seed": 42} | params))]
    if model_type == "forest":
        return [raw, RandomForestClassifier(featuresCol="_features", **common, **({"numTrees": 20, "maxDepth": 6, "seed": 42} | params))]
    scaled = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True)
    return [raw, scaled, LogisticRegression(featuresCol="_scaled", **common, **({"maxIter": 50, "regParam": 0.01} | params))]


def fit(train: DataFrame, maps: dict[str, list[str]], model_type: str = "gbt", label: str = "is_fraud", valid: DataFrame | None = None, **params) -> PipelineModel:
    """A pipeline over encoded inputs, weighted by class; with validation rows, boosting stops early by them."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    early = valid is not None and model_type == "gbt"
    rows = encode(train, maps).withColumn("_valid", F.lit(False))
    counts = rows.agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    weight = (counts["n"] - (counts["p"] or 0.0)) / max(counts["p"] or 0.0, 1.0)
    if early:
        rows = rows.unionByName(encode(valid, maps).withColumn("_valid", F.lit(True)))
    rows = rows.withColumn("_weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=_stages(model_type, label, params, early)).fit(rows)


def scorer(model: PipelineModel, maps: dict[str, list[str]]) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `score` to rows with the model's inputs; the rows' own columns stay as they are."""

    def run(df: DataFrame) -> DataFrame:
        kept = F.struct(*df.columns).alias("_row")
        scored = model.transform(encode(df.select("*", kept), maps))
        return scored.select("_row.*", vector_to_array("probability")[1].alias("score"))

    return run


def tree_scorer(model: PipelineModel, maps: dict[str, list[str]]) -> Callable[[DataFrame], DataFrame]:
    """As `scorer`, of trees, with each input's exact Shapley value: base and contributions add up to what `shapley` explains."""
    found = shapley.leaves(model.stages[-1])

    def run(df: DataFrame) -> DataFrame:
        reach(df.sparkSession)
        kept = F.struct(*df.columns).alias("_row")
        scored = model.transform(encode(df.select("*", kept), maps))
        parts = shapley.contributions(found, [F.col(c) for c in MODEL_INPUTS])
        rows = scored.select("_row", vector_to_array("probability")[1].alias("score"), parts.alias("_parts"))
        named = F.struct(*[F.get("_parts", F.lit(i)).alias(c) for i, c in enumerate(MODEL_INPUTS)])
        return rows.select("_row.*", "score", F.lit(shapley.base(found)).alias("base"), named.alias("contributions"))

    return run


def linear_scorer(weights: dict[str, float], bias: float = 0.0, centre: dict[str, float] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A logistic score of numeric inputs by fixed weights, with each input's contribution to its margin."""
    centre = centre or {}

    def run(df: DataFrame) -> DataFrame:
        parts = {n: (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - centre.get(n, 0.0)) * w for n, w in weights.items()}
        margin: Column = F.lit(float(bias))
        for x in parts.values():
            margin = margin + x
        return df.withColumns({"score": 1 / (1 + F.exp(-margin)), "contributions": F.struct(*[x.alias(n) for n, x in parts.items()])})

    return run


def explained(scored: DataFrame, inputs: Iterable[str], k: int = 5) -> DataFrame:
    """Rows of a `linear_scorer` or a `tree_scorer` with their k largest contributions; all of them add up exactly."""
    return scored.withColumn("top", top_contributions({n: F.col(f"contributions.{n}") for n in inputs}, k))


def score(df: DataFrame, model: PipelineModel, maps: dict[str, list[str]], threshold: float = THRESHOLD) -> DataFrame:
    """df (with its own columns, unencoded), a probability, and whether it reaches the threshold."""
    return scorer(model, maps)(df).withColumn("flagged", F.col("score") >= threshold)


def grid(**choices: list) -> list[dict]:
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def search(split: DataFrame, candidates: list[dict], label: str = "is_fraud", model_type: str = "gbt", early_stop: bool = False) -> tuple[PipelineModel, dict, dict[str, list[str]]]:
    """The best of the candidates by average precision on the validation slice; the kept model has the searched parameters."""
    train, valid = split.filter("split = 'train'").persist(), split.filter("split = 'valid'").persist()
    try:
        maps = category_map(train)
        best: tuple[float, dict, PipelineModel] | None = None
        for params in candidates:
            model = fit(train, maps, model_type, label, valid if early_stop else None, **params)
            found = ranking_metrics(score(valid, model, maps), "score", label).first()["average_precision"] or 0.0
            if best is None or found > best[0]:
                best = found, params, model
    finally:
        train.unpersist(), valid.unpersist()
    return best[2], {"average_precision": best[0], "params": best[1]}, maps


def training_run(rows: DataFrame, candidates: dict[str, list[dict]], registry: str | None = None, label: str = "is_fraud", threshold: float = THRESHOLD, early_stop: bool = True) -> dict:
    """Split in time, search each model type, choose the winner by the validation slice, and report it on the test slice.

    The report has the baselines, each type's validation figure, and the winner's test metrics and
    importances; the test slice plays no part in the choice.  With a registry the winner is saved as its next version."""
    split = chronological_split(rows)
    found = {kind: search(split, options, label, kind, early_stop) for kind, options in candidates.items()}
    winner = max(found, key=lambda kind: found[kind][1]["average_precision"])
    model, info, maps = found[winner]
    test = split.filter("split = 'test'")
    report = {
        "winner": winner,
        "params": info["params"],
        "validation": {kind: f[1]["average_precision"] for kind, f in found.items()},
        "test": ranking_metrics(score(test, model, maps), "score", label).first().asDict(),
        "baselines": baselines(test, label).first().asDict(),
        "importance": importance(model)[:10],
    }
    if registry:
        report["version"] = register(rows.sparkSession, model, maps, registry, winner, threshold, report)
    return report


def importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Inputs by importance: of trees their gain, of a linear model the size of its scaled weights."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(MODEL_INPUTS, [abs(float(x)) for x in values.toArray()], strict=True), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, maps: dict[str, list[str]], path: str, threshold: float = THRESHOLD, model_type: str = "gbt", report: dict | None = None) -> None:
    model.write().overwrite().save(f"{path}/model")  # metadata is one JSON line beside it, written last
    meta = json.dumps({"inputs": MODEL_INPUTS, "categories": maps, "threshold": threshold, "type": model_type, "report": report})
    SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])


def versions(spark: SparkSession, registry: str) -> list[int]:
    """Numbers of the complete versions: those whose metadata, which comes last, is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(registry)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{registry}/{n}/metadata/_SUCCESS")))


def register(spark: SparkSession, model: PipelineModel, maps: dict[str, list[str]], registry: str, model_type: str = "gbt", threshold: float = THRESHOLD, report: dict | None = None) -> int:
    """Save as the next version; its number."""
    number = max(versions(spark, registry), default=0) + 1
    save(model, maps, f"{registry}/v{number}", threshold, model_type, report)
    return number


def latest(spark: SparkSession, registry: str) -> tuple[PipelineModel, dict]:
    found = versions(spark, registry)
    if not found:
        raise FileNotFoundError(f"no model in {registry}")
    return load(f"{registry}/v{found[-1]}")
