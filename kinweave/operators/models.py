"""Match models: boosted trees, a forest, and a stack of both over folds that keep entities whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from .labels import class_weight
from .sampling import fold


@dataclass(frozen=True)
class Preset:
    """Sizes of one way of training."""

    trees: int
    depth: int
    rate: float
    forest: int = 0  # trees of the second model; 0: no stack
    folds: int = 0
    negatives: int | None = None  # hardest negatives an entity; None: all
    cap: int = 300
    k: int = 35


#: The ways of training, from one model to the stack over grouped folds.
PRESETS = {
    "single": Preset(350, 6, 0.06),
    "single_deep": Preset(400, 7, 0.06, cap=250, k=25),
    "stack_v2": Preset(400, 7, 0.06, 350, 5, 8, 250, 30),
    "stack_v3": Preset(500, 8, 0.05, 400, 5, 10, 250, 35),
    "stack_v4": Preset(500, 8, 0.05, 400, 5, 10, 250, 35),
    "stack_v5": Preset(450, 7, 0.06, 350, 3, 8, 250, 35),
    "stack_v6": Preset(1200, 8, 0.05, 600, 3, None, 5000, 60),
    "small": Preset(8, 4, 0.2, 8, 3, 8),
}


@dataclass
class Matcher:
    """Trained models, the columns they read, and the thresholds their scores are cut at."""

    columns: list[str]
    boosted: PipelineModel
    forest: PipelineModel | None = None
    meta: PipelineModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    global_threshold: float = 0.75

    def save(self, path: str) -> None:
        for name in ("boosted", "forest", "meta"):
            model = getattr(self, name)
            if model:
                model.write().overwrite().save(f"{path}/{name}")
        side = {"columns": self.columns, "thresholds": self.thresholds, "global_threshold": self.global_threshold, "models": [n for n in ("boosted", "forest", "meta") if getattr(self, n)]}
        _session().createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")

    @staticmethod
    def load(path: str) -> Matcher:
        side = json.loads(_session().read.text(f"{path}/bundle").first()["value"])
        models = {n: PipelineModel.load(f"{path}/{n}") for n in side.pop("models")}
        return Matcher(**side, **models)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _pipeline(columns: list[str], classifier, rows: DataFrame) -> PipelineModel:
    from pyspark.ml import Pipeline

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="kw_features"), classifier]).fit(rows)


def _scored(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).drop("kw_features", "rawPrediction", "probability", "prediction")


def _boosted(p: Preset, seed: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="kw_features", labelCol="label", weightCol="kw_weight", maxIter=p.trees, maxDepth=p.depth, stepSize=p.rate, subsamplingRate=0.85, minInstancesPerNode=5, seed=seed, checkpointInterval=10)


def _forest(p: Preset, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="kw_features", labelCol="label", weightCol="kw_weight", numTrees=p.forest, maxDepth=min(p.depth + 2, 12), subsamplingRate=0.85, seed=seed)


def weighted(labelled: DataFrame) -> DataFrame:
    """kw_weight: positives weigh as much as there are more negatives; a row that stands for several (``times``) as much as they."""
    w = class_weight(labelled).first()["scale_pos_weight"]  # one number
    rows = labelled if "times" in labelled.columns else labelled.withColumn("times", F.lit(1))
    return rows.withColumn("times", F.col("times").cast("double")).withColumn("kw_weight", F.when(F.col("label") == 1, w).otherwise(1.0) * F.col("times"))


def train(labelled: DataFrame, columns: list[str], preset: Preset, seed: int = 42) -> Matcher:
    """``labelled``: s1_id, cand_id, label and ``columns``; with ``times``, the number of equal rows that a row stands for.
    Folds are by entity, so no entity is on both sides of one."""
    known = [x for x in ("s1_id", "label", "times") if x in labelled.columns]
    stored = labelled.select(*known, *columns)
    # Trees read their rows a few times, so these are a table, not a cache beside the trees' own.
    stored = staging.table(stored.withColumn("kw_fold", fold("s1_id", preset.folds, seed)) if preset.forest else stored)
    try:
        rows = weighted(stored)
        boosted = _pipeline(columns, _boosted(preset, seed), rows)
        if not preset.forest:
            return Matcher(columns, boosted)
        forest = _pipeline(columns, _forest(preset, seed), rows)
        out = None
        for k in range(preset.folds):
            inside, outside = rows.filter(F.col("kw_fold") != k), rows.filter(F.col("kw_fold") == k)
            part = _scored(_pipeline(columns, _forest(preset, seed), inside), _scored(_pipeline(columns, _boosted(preset, seed), inside), outside, "p_boosted"), "p_forest").select("label", "times", "p_boosted", "p_forest")
            out = part if out is None else out.unionByName(part)
        out = staging.table(out)
        meta = _pipeline(["p_boosted", "p_forest"], LogisticRegression(featuresCol="kw_features", labelCol="label", weightCol="times", regParam=1e-4, maxIter=100), out)
        staging.drop(out)
        return Matcher(columns, boosted, forest, meta)
    finally:
        staging.drop(stored)


def score(matcher: Matcher, rows: DataFrame) -> DataFrame:
    """``rows`` with prob."""
    out = _scored(matcher.boosted, rows, "p_boosted")
    if not matcher.meta:
        return out.withColumnRenamed("p_boosted", "prob")
    return _scored(matcher.meta, _scored(matcher.forest, out, "p_forest"), "prob").drop("p_boosted", "p_forest")


def auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", metricName="areaUnderROC").evaluate(scored)


def importance(matcher: Matcher, most: int = 15) -> list[tuple[str, float]]:
    """The features that the boosted trees split on most."""
    values = matcher.boosted.stages[-1].featureImportances.toArray()
    return sorted(zip(matcher.columns, map(float, values)), key=lambda x: (-x[1], x[0]))[:most]


def describe(preset: str) -> dict:
    return asdict(PRESETS[preset])
