"""Models of candidates' classes that are kept and served: forests that vote, the cascade, a linear model, and what to do without one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classes as C
from . import evaluation as E

#: How much a class weighs in training; the least confidence; the gap of mean F1 that is no overfitting; columns that no feature may show.
CLASS_WEIGHTS = {"include": 1.0, "exclude_nested": 1.2, "not_length": 1.4}
SURE, GAP = 0.55, 0.05
HIDDEN = ("decision", "role", "reason", "locked", "reviewed_by_human")
SEEDS = (42, 52, 62, 72, 82)


def _mean(names: list[str]) -> Column:
    """The mean of the members' probabilities, by class."""
    return F.array(*(sum((vector_to_array(n)[i] for n in names), F.lit(0.0)) / len(names) for i in range(len(E.CLASSES))))


class Forests:
    """Forests that vote with their mean probabilities; the most probable class, however sure."""

    kind = "forests_v1"

    def __init__(self, names: list[str], members: list):
        self.names, self.members = names, members

    def classify(self, d: DataFrame) -> DataFrame:
        x, cols = C._vectors(d, self.names), []
        for i, m in enumerate(self.members):
            m = m.copy().setPredictionCol(f"_y{i}").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
            x = m.transform(x)
            cols.append(f"_p{i}")
        x = x.withColumn("_v", E.winner(_mean(cols)))
        return x.select(*d.columns, F.col("_v.pred").alias("pred"), F.col("_v.p").alias("confidence"), F.format_string(f"forests×{len(cols)} %.2f", "_v.p").alias("why"))

    def parts(self) -> dict:
        return {f"forest{i}": m for i, m in enumerate(self.members)}


class Linear:
    """A scaled linear model; a class that isn't sure is ambiguous."""

    kind = "linear_v1"

    def __init__(self, names: list[str], scaler, model):
        self.names, self.scaler, self.model = names, scaler, model

    def classify(self, d: DataFrame, threshold: float = SURE) -> DataFrame:
        x = self.model.transform(self.scaler.transform(C._vectors(d, self.names))).withColumn("_v", E.winner(_mean(["_linear_p"])))
        pred = F.when(F.col("_v.p") >= threshold, F.col("_v.pred")).otherwise("ambiguous")
        return x.select(*d.columns, pred.alias("pred"), F.col("_v.p").alias("confidence"), F.format_string("linear %.2f", "_v.p").alias("why"))

    def parts(self) -> dict:
        return {"scaler": self.scaler, "linear": self.model}


class Cascade(C.Cascade):
    """The linear model and the forest of classes.Cascade, with the words that say whether they agreed."""

    kind = "cascade_v2"

    def classify(self, d: DataFrame, threshold: float = SURE) -> DataFrame:
        x = super().classify(d, threshold)
        unsure = F.concat(F.lit("cascade unsure "), "linear", F.lit("/"), "forest")
        return x.withColumn("why", F.when(F.col("pred") == "ambiguous", unsure).otherwise(F.format_string("cascade %.2f", "confidence"))).select(*d.columns, "pred", "confidence", "why")

    def parts(self) -> dict:
        return {"linear": self.linear, "forest": self.forest}


def no_leak(names: list[str]) -> None:
    """Refuse features that give the label away."""
    if shown := sorted(set(names) & set(HIDDEN)):
        raise ValueError(f"features show what they are to tell: {shown}")


def fit_forests(rows: DataFrame, names: list[str], label: str, weight: str, seeds: tuple[int, ...] = SEEDS, trees: int = 10, depth: int = 5) -> Forests:
    """A forest for each seed on the rows of resolved classes, weighted by class too. rows is read often: pass a written table.

    Trees see all features and draw their rows: with few of the many flags in sight, most splits would show the weights alone.
    """
    no_leak(names)
    d = _labelled(rows, names, label, weight)
    fit = lambda s: RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=20, featureSubsetStrategy="all", subsamplingRate=0.7, seed=s).fit(d)
    return Forests(names, [fit(s) for s in seeds])


def fit_linear(rows: DataFrame, names: list[str], label: str, weight: str) -> Linear:
    no_leak(names)
    d = _labelled(rows, names, label, weight)
    scaler = StandardScaler(inputCol="_x", outputCol="_s", withMean=True).fit(d)
    model = LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", maxIter=100, predictionCol="_linear", probabilityCol="_linear_p", rawPredictionCol="_linear_r").fit(scaler.transform(d))
    return Linear(names, scaler, model)


def _labelled(rows: DataFrame, names: list[str], label: str, weight: str) -> DataFrame:
    resolved = rows.filter(F.col(label).isin(*E.CLASSES))
    if resolved.limit(C.LEAST_ROWS).count() < C.LEAST_ROWS:
        raise ValueError(f"fewer than {C.LEAST_ROWS} labelled rows")
    y = F.array_position(F.array(*map(F.lit, E.CLASSES)), F.col(label)).cast("double") - 1
    by_class = F.element_at(F.create_map(*(F.lit(v) for kv in CLASS_WEIGHTS.items() for v in kv)), F.col(label))
    return C._vectors(resolved.withColumns({"_y": y, "_w": F.col(weight) * by_class}), names)


def save(model, spark: SparkSession, path: str) -> None:
    """Keep a model: its kind, its features and its parts, in a folder that Spark reads."""
    for name, part in model.parts().items():
        part.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(model.kind, model.names, list(model.parts()))], "kind string, names array<string>, parts array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/head")


def load(spark: SparkSession, path: str):
    """The model that was kept there; None where none was. A kind that isn't known is an error."""
    try:
        head = spark.read.json(f"{path}/head").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    read = {"scaler": StandardScalerModel, "linear": LogisticRegressionModel}
    parts = {p: read.get(p, RandomForestClassificationModel).load(f"{path}/{p}") for p in head["parts"]}
    if head["kind"] == Forests.kind:
        return Forests(head["names"], list(parts.values()))
    if head["kind"] == Linear.kind:
        return Linear(head["names"], parts["scaler"], parts["linear"])
    if head["kind"] == Cascade.kind:
        return Cascade(head["names"], parts["linear"], parts["forest"])
    raise ValueError(f"unknown kind of model: {head['kind']}")


def decide(d: DataFrame, model) -> DataFrame:
    """d with decision, role and reason by a model of any kind; without a model every row counts, as a draft."""
    if model is None:
        return d.withColumns({"decision": F.lit("include"), "role": F.lit("main"), "reason": F.lit("draft without a model")})
    out = model.classify(d.drop("decision", "role", "reason"))
    role = F.when(F.col("pred") == "include", "main").otherwise("other")
    return out.withColumns({"decision": F.col("pred"), "role": role, "reason": F.col("why")}).drop("pred", "confidence", "why")


def overfitting(train: DataFrame, validation: DataFrame) -> tuple[float, bool]:
    """The mean F1 on training rows minus that on validation rows (y and pred each), and whether it is small enough."""
    gap = E.overall_metrics(train).first()["macro_f1"] - E.overall_metrics(validation).first()["macro_f1"]
    return gap, gap < GAP
