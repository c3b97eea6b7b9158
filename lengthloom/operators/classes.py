"""Classes of candidates by models trained on Spark ML: a linear model and a forest that must agree."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import CLASSES

#: Fewer labelled rows than this are refused.
LEAST_ROWS = 100


class Cascade:
    """Two fitted models; a row gets their class if they agree and the less sure of both is sure enough."""

    def __init__(self, names: list[str], linear, forest):
        self.names, self.linear, self.forest = names, linear, forest

    def classify(self, d: DataFrame, threshold: float = 0.55) -> DataFrame:
        """d with linear, forest, confidence and pred; rows on which the models don't agree are ambiguous."""
        name = lambda p: F.element_at(F.array(*map(F.lit, CLASSES)), (F.col(p) + 1).cast("int"))
        both = self.forest.transform(self.linear.transform(_vectors(d, self.names)))
        sure = F.least(*(F.array_max(vector_to_array(p)) for p in ("_linear_p", "_forest_p")))
        out = both.withColumns({"linear": name("_linear"), "forest": name("_forest"), "confidence": sure})
        out = out.withColumn("pred", F.when((F.col("linear") == F.col("forest")) & (F.col("confidence") >= threshold), F.col("linear")).otherwise("ambiguous"))
        return out.select(*d.columns, "linear", "forest", "confidence", "pred")


def _vectors(d: DataFrame, names: list[str]) -> DataFrame:
    """A missing value counts as 0."""
    plain = d.withColumns({f"_f{i}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for i, n in enumerate(names)})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(names))], outputCol="_x").transform(plain)


def fit_cascade(rows: DataFrame, names: list[str], label: str, weight: str, trees: int = 20, seed: int = 7) -> Cascade:
    """Fit both models to the rows whose label is one of the resolved classes. rows is read often: pass a written table."""
    resolved = rows.filter(F.col(label).isin(*CLASSES))
    if resolved.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} labelled rows")
    y = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)).cast("double") - 1
    d = _vectors(resolved.withColumn("_y", y), names)
    same = {"featuresCol": "_x", "labelCol": "_y", "weightCol": weight}
    linear = LogisticRegression(family="multinomial", regParam=0.01, elasticNetParam=0.2, maxIter=30, predictionCol="_linear", probabilityCol="_linear_p", rawPredictionCol="_linear_r", **same)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed, predictionCol="_forest", probabilityCol="_forest_p", rawPredictionCol="_forest_r", **same)
    return Cascade(names, linear.fit(d), forest.fit(d))
