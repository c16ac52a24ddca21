"""The optional ranker on feature vectors: it refines confidence, it never decides what is found.

Boosted trees, one model of a class against the rest, whose shares are made to sum
to one.  Trees are added until the error on rows held out for that, which no tree
is fitted on, rises.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.operators import features

#: A class takes a model; so many are refused to be sure that labels are classes.
MOST_LABELS = 64


class Model:
    """The fitted stages, the labels in order, and the columns that they read."""

    def __init__(self, stages: PipelineModel, labels: list[str], columns: list[str]):
        self.stages, self.labels, self.columns = stages, labels, columns


def validation(group: Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row is held out to stop the training; rows of a group are on one side."""
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(1000)) < int(1000 * share)


def train(rows: DataFrame, label: str, columns: list[str] | None = None, group: str | None = None, trees: int = 20, depth: int = 4, seed: int = 42) -> Model:
    """Rows without a label aren't learnt from.  ``group``: rows that agree in it are validated together."""
    columns = columns or features.names()
    known = rows.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in known.select(label).distinct().limit(MOST_LABELS + 1).collect())
    if not 2 <= len(labels) <= MOST_LABELS:
        raise ValueError(f"{len(labels)} labels; 2 to {MOST_LABELS} can be told apart")
    held = validation(F.col(group), seed=seed) if group else validation(F.struct(*columns), seed=seed)
    known = known.select(*columns, held.alias("__held"), *[(F.col(label) == x).cast("double").alias(f"__y{i}") for i, x in enumerate(labels)])
    stages = [VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="keep")]
    for i in range(len(labels)):
        g = GBTClassifier(
            labelCol=f"__y{i}", featuresCol="__features", predictionCol=f"__c{i}", maxIter=trees, maxDepth=depth, seed=seed, validationIndicatorCol="__held"
        )
        stages.append(g.setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__p{i}"))
    some = known.agg(F.count(F.when(F.col("__held"), 1)), F.count(F.when(~F.col("__held"), 1))).first()
    if not all(some):  # too few rows to hold some out
        for s in stages[1:]:
            s.clear(s.validationIndicatorCol)
    return Model(Pipeline(stages=stages).fit(known), labels, columns)


def shares(model: Model) -> Column:
    """The share of each label, in order."""
    p = [vector_to_array(f"__p{i}")[1] for i in range(len(model.labels))]
    total = sum(p[1:], p[0])
    return F.array(*[x / total for x in p])


def predict(model: Model, rows: DataFrame, top: int = 3) -> DataFrame:
    """``rows`` with model_label, model_confidence, model_top (the first labels and their shares) and ood (a confidence below twice the even share)."""
    out = model.stages.transform(rows).withColumn("__s", shares(model))
    names = F.array(*map(F.lit, model.labels))
    # the greatest share first; of equal ones, the first label
    order = F.transform(F.arrays_zip(names.alias("label"), F.col("__s").alias("share")), lambda x: F.struct((-x["share"]).alias("s"), x["label"].alias("label")))
    best = F.slice(F.array_sort(order), 1, top)
    out = out.withColumn("__t", best).withColumns({
        "model_label": F.col("__t")[0]["label"], "model_confidence": F.round(-F.col("__t")[0]["s"], 4),
        "model_top": F.transform("__t", lambda x: F.struct(x["label"].alias("label"), F.round(-x["s"], 4).alias("share"))),
    })
    return out.withColumn("ood", F.col("model_confidence") < 2 / len(model.labels)).select(*rows.columns, "model_label", "model_confidence", "model_top", "ood")


def evaluate(predicted: DataFrame, label: str) -> DataFrame:
    """(rows, right, top_right, accuracy, ood): over rows with a label."""
    known = predicted.where(F.col(label).isNotNull())
    g = known.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("model_label") == F.col(label), 1)).alias("right"),
        F.count(F.when(F.exists("model_top", lambda x: x["label"] == F.col(label)), 1)).alias("top_right"), F.count(F.when(F.col("ood"), 1)).alias("ood"),
    )
    return g.withColumn("accuracy", F.when(F.col("rows") > 0, F.col("right") / F.col("rows")).otherwise(0.0))


def importances(model: Model, n: int = 10) -> list[tuple[str, float]]:
    """The features of greatest mean importance over all classes."""
    every = [s.featureImportances.toArray() for s in model.stages.stages[1:]]
    mean = sum(every) / len(every)
    return sorted(((a, float(b)) for a, b in zip(model.columns, mean, strict=True)), key=lambda x: (-abs(x[1]), x[0]))[:n]


def hybrid(trace: Column, model: Column) -> Column:
    return F.round(0.5 * trace + 0.5 * model, 4)


def record_vectors(scopes: DataFrame) -> DataFrame:
    """The features of each file's first function that touches a sink, else of its module."""
    f = features.extract(scopes)
    touching = F.struct(F.when((F.col("scope") > 0) & (F.col("sink_count") > 0), 0).otherwise(1).alias("other"), F.col("scope"))
    first = f.groupBy("path").agg(F.min_by(F.struct(*[c for c in f.columns if c != "path"]), touching).alias("x"))
    return first.select("path", "x.*")


_LAYOUT = "version int, features array<string>, labels array<string>"


def save(model: Model, path: str) -> None:
    """The model and beside it the feature layout that it was fitted on."""
    model.stages.write().overwrite().save(f"{path}/model")
    layout = [(features.VERSION, model.columns, model.labels)]
    SparkSession.active().createDataFrame(layout, _LAYOUT).write.mode("overwrite").json(f"{path}/layout")


def load(path: str, columns: list[str] | None = None) -> Model:
    """Refuses a model of another layout."""
    row = SparkSession.active().read.schema(_LAYOUT).json(f"{path}/layout").first()
    if row is None or row["version"] != features.VERSION or row["features"] != (columns or features.names()):
        raise ValueError(f"a model of another layout than {features.VERSION} can't be used")
    return Model(PipelineModel.load(f"{path}/model"), row["labels"], row["features"])


def available(path: str | None) -> tuple[Model | None, str]:
    """(model, why there is none): a scan goes on by its rules alone."""
    if not path:
        return None, ""
    try:
        return load(path), ""
    except Exception as error:  # whatever a broken bundle raises
        return None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


def refined(found: DataFrame, scopes: DataFrame, model: Model) -> DataFrame:
    """``found`` with confidence the mean of the flow's and the model's, for flows; ood, and a reason where the model ranks another class first."""
    scored = predict(model, features.extract(scopes)).groupBy("path", "function").agg(F.first("model_label").alias("__l"), F.first("model_confidence").alias("__c"), F.max("ood").alias("ood"))
    out = found.join(scored, ["path", "function"], "left")
    flow = (F.col("detector") != "pattern") & F.col("__c").isNotNull()
    return out.withColumns({
        "confidence": F.when(flow, hybrid(F.col("confidence"), F.col("__c"))).otherwise(F.col("confidence")),
        "reason": F.when(flow & (F.col("__l") != F.col("cwe")), F.concat(F.lit("the model ranks "), "__l", F.lit(" first; the flow decides"))),
        "ood": F.coalesce("ood", F.lit(False)),
    }).drop("__l", "__c")
