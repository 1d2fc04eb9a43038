"""Random-forest classes for point clouds, on MLlib."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.operators import cloud

LABELS = {2: "Ground", 5: "Vegetation", 6: "Building"}
DOMAIN = 200.0

# The rehearsal scene. Roofs are (x, y, width, depth, height).
GROUND_POINTS, ROOF_POINTS, TREES, TREE_POINTS = 55_000, 4_200, 40, (250, 600)
ROOFS = [(60.0, 55.0, 26.0, 20.0, 11.0), (130.0, 120.0, 30.0, 24.0, 8.0), (95.0, 150.0, 18.0, 18.0, 14.0)]
COLORS = {2: (150, 121, 78, 10), 6: (182, 184, 190, 8), 5: (48, 122, 46, 14)}


def _terrain(x: Column, y: Column) -> Column:
    return 12 + 3 * F.sin(x / 34) + 2.2 * F.cos(y / 27) + 0.6 * F.sin((x + y) / 15)


def _chance(*keys) -> Column:
    """A number in (0, 1) that hangs on its keys alone, so any task draws the same scene."""
    return (F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _bell(*keys) -> Column:
    return F.sqrt(-2 * F.log(_chance(*keys, "radius"))) * F.cos(2 * math.pi * _chance(*keys, "angle"))


def scene(spark: SparkSession, seeds: list[int], noise: bool = False) -> DataFrame:
    """Labelled scenes (seed, pt_id, x, y, z, r, g, b, cls): rolling ground, flat roofs, round trees.

    Every coordinate is an expression of (seed, pt_id); with ``noise`` positions, heights and
    colours are shaken as a survey would.
    """
    runs = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed")
    key = [F.col("seed"), F.col("pt_id")]
    roofs = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(ROOFS)], "k int, bx double, by double, w double, d double, h double")

    ground = spark.range(GROUND_POINTS).select(F.col("id").alias("pt_id"), runs)
    ground = ground.withColumn("x", DOMAIN * _chance(*key, "x")).withColumn("y", DOMAIN * _chance(*key, "y"))
    ground = ground.withColumn("z", _terrain(F.col("x"), F.col("y")) + 0.04 * _bell(*key, "z")).withColumn("cls", F.lit(2))

    tops = spark.range(ROOF_POINTS * len(ROOFS)).select((F.col("id") + GROUND_POINTS).alias("pt_id"), (F.col("id") % len(ROOFS)).cast("int").alias("k"), runs).join(F.broadcast(roofs), "k")  # three rows
    tops = tops.withColumn("x", F.col("bx") + F.col("w") * _chance(*key, "x")).withColumn("y", F.col("by") + F.col("d") * _chance(*key, "y"))
    tops = tops.withColumn("z", _terrain(F.col("bx") + F.col("w") / 2, F.col("by") + F.col("d") / 2) + F.col("h") + 0.06 * _bell(*key, "z")).withColumn("cls", F.lit(6))

    trees = spark.range(TREES).select(F.col("id").alias("tree"), runs)
    at = lambda name: 10 + (DOMAIN - 20) * _chance(F.col("seed"), F.col("tree"), name)
    trees = trees.withColumn("cx", at("cx")).withColumn("cy", at("cy")).withColumn("tall", 3 + 6 * _chance(F.col("seed"), F.col("tree"), "tall"))
    n = (TREE_POINTS[0] + F.floor((TREE_POINTS[1] - TREE_POINTS[0]) * _chance(F.col("seed"), F.col("tree"), "n"))).cast("int")
    trees = trees.withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    trees = trees.withColumn("pt_id", GROUND_POINTS + ROOF_POINTS * len(ROOFS) + F.col("tree") * TREE_POINTS[1] + F.col("i") - 1)
    trees = trees.withColumn("x", F.col("cx") + 3 * _bell(*key, "x")).withColumn("y", F.col("cy") + 3 * _bell(*key, "y"))
    trees = trees.withColumn("z", _terrain(F.col("cx"), F.col("cy")) + 0.5 + (F.col("tall") - 0.5) * _chance(*key, "z")).withColumn("cls", F.lit(5))

    out = None
    for part in (ground, tops, trees):
        part = part.select("seed", "pt_id", "x", "y", "z", "cls")
        out = part if out is None else out.unionByName(part)
    colors = spark.createDataFrame([(c, *v) for c, v in COLORS.items()], "cls int, r0 int, g0 int, b0 int, spread int")
    out = out.join(F.broadcast(colors), "cls")  # three rows
    more = 28 if noise else 0
    paint = lambda c: F.least(F.greatest(F.col(f"{c}0") + F.col("spread") * _bell(*key, c) + more * _bell(*key, c, "noise"), F.lit(0.0)), F.lit(255.0)).cast("int")
    shake = lambda c: F.col(c) + ((0.06 * _bell(*key, c, "noise") + (0.20 * _bell(*key, "height", "noise") if c == "z" else 0.0)) if noise else 0.0)
    return out.select("seed", "pt_id", *[shake(c).alias(c) for c in "xyz"], *[paint(c).alias(c) for c in "rgb"], "cls")


def training_set(spark: SparkSession, seeds: tuple[int, ...] = (7, 11, 23, 42, 99, 128)) -> DataFrame:
    """Features and label of every point of several noisy scenes."""
    out = None
    for seed in seeds:
        one = cloud.features(scene(spark, [seed], noise=True).drop("seed")).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Trained:
    model: PipelineModel
    accuracy: float
    confusion: DataFrame  # ``class_report`` makes precision and recall of it
    importances: dict[str, float]
    cv_accuracy: float | None = None


def train(data: DataFrame, trees: int = 150, depth: int = 14, leaf: int = 12, seed: int = 42, folds: int = 0) -> Trained:
    """Balanced forest on a stratified 70/30 split (by hash, within each class)."""
    counts = data.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    total, classes = data.count(), counts.count()
    weight = (F.lit(float(total)) / (classes * F.col("n"))).alias("weight")
    rows = data.join(F.broadcast(counts), "cls").withColumn("weight", weight).withColumn("label", F.col("cls").cast("double"))  # one row a class
    part = F.pmod(F.xxhash64(F.lit(seed), *[c for c in ("seed", "pt_id") if c in data.columns]), F.lit(10))
    fit, test = rows.where(part < 7), rows.where(part >= 7)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", seed=seed, featuresCol="features")
    steps = Pipeline(stages=[VectorAssembler(inputCols=cloud.FEATURES, outputCol="features"), forest])
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    cv = None
    if folds > 1:
        checked = CrossValidator(estimator=steps, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=seed).fit(rows)
        cv = float(checked.avgMetrics[0])
    model = steps.fit(fit)
    guessed = model.transform(test)
    confusion = guessed.groupBy("cls", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return Trained(model, judge.evaluate(guessed), confusion, dict(zip(cloud.FEATURES, map(float, model.stages[-1].featureImportances.toArray()), strict=True)), cv)


def class_report(confusion: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support) from (cls, predicted, n); 0 where nothing was predicted or is there."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    true = confusion.groupBy("cls").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("cls") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    guessed = confusion.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("guesses"))
    rows = true.join(guessed, "cls", "full").na.fill(0, ["support", "hits", "guesses"])
    rows = rows.withColumn("precision", ratio(F.col("hits"), F.col("guesses"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return rows.select("cls", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"), "support")


def predict(model: PipelineModel, points: DataFrame) -> DataFrame:
    """points with cls from the forest."""
    rows = cloud.features(points.drop("cls"))
    return model.transform(rows).withColumn("cls", F.col("prediction").cast("int")).select(*[c for c in points.columns if c != "cls"], "cls")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def available(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
