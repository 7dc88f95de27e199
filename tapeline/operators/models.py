"""Models on Spark ML: clustering, boosted heads, evaluation, importance."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.operators.sampling import hash_order
from tapeline.session import materialize


def classification_metrics(rows: DataFrame, keys: list[str], pred: str = "pred", label: str = "y") -> DataFrame:
    """Accuracy, precision, recall and F1 from counts."""
    p, y = F.col(pred), F.col(label)
    c = rows.groupBy(*keys).agg(
        F.count_if(p & y).alias("_tp"), F.count_if(p & ~y).alias("_fp"), F.count_if(~p & y).alias("_fn"),
        F.count_if(p == y).alias("_ok"), F.count(F.lit(1)).alias("n"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return c.select(
        *keys, "n", ratio(F.col("_ok"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def agreement(rows: DataFrame, old: str, new: str, gate: float = 0.80) -> DataFrame:
    return rows.agg(F.avg((F.col(old) == F.col(new)).cast("double")).alias("agreement")).withColumn("passes", F.col("agreement") >= gate)


def cluster_profiles(profiles: DataFrame, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """Cluster of every instrument; features are standardised first."""
    v = VectorAssembler(inputCols=features, outputCol="_v").transform(profiles)
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(v).transform(v)
    model = KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("_v", "_z")


def name_clusters(clustered: DataFrame, features: list[str]) -> DataFrame:
    """Centre of each cluster in original units and a name from its highest feature."""
    overall = clustered.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    centres = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), *[F.avg(f).alias(f) for f in features])
    j = centres.crossJoin(F.broadcast(overall))
    z = F.array(*[F.struct(((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).alias("z"), F.lit(f).alias("f")) for f in features])
    top = F.array_max(z)
    return j.withColumn("name", F.concat(F.when(top["z"] > 0, "high_").otherwise("low_"), top["f"])).select("cluster", "members", "name", *features)


def class_weight(rows: DataFrame, label: str) -> DataFrame:
    """Weight of positives: negatives over positives."""
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    w = F.when(F.col(label) == 1, F.col("_q") / F.greatest(F.col("_p"), F.lit(1))).otherwise(1.0)
    return rows.crossJoin(F.broadcast(counts)).withColumn("weight", w).drop("_p", "_q")


def fit_entry_head(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42):
    data = VectorAssembler(inputCols=features, outputCol="features").transform(class_weight(train, label))
    return GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed).fit(data)


def fit_value_head(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42):
    data = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(data)


def score(model, rows: DataFrame, features: list[str], out: str) -> DataFrame:
    """Probability (classifier) or value (regressor) of each row."""
    data = VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
    done = model.copy({model.featuresCol: "_v"}).transform(data)
    value = vector_to_array("probability")[1] if "probability" in done.columns else F.col("prediction")
    return done.select(*rows.columns, value.alias(out))


def auc(scored: DataFrame, label: str, value: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=value, numBins=0).evaluate(scored)


def gate(rows: DataFrame, probability: str, tp: str, sl: str, accept: float = 0.55, least_ratio: float = 1.5) -> DataFrame:
    """Accept a signal when it is likely and its target is far enough."""
    ok = (F.col(probability) >= accept) & (F.col(tp) / F.greatest(F.col(sl), F.lit(1e-9)) >= least_ratio)
    return rows.withColumn("accepted", ok)


def score_counts(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``keys, score, pos, neg``: how many of either label share a score."""
    y = F.col(label).cast("boolean")
    return rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def auc_by_group(counts: DataFrame, keys: list[str], pieces: int = 64) -> DataFrame:
    """``keys, auc`` from ``score_counts``: the exact rank sum, ties counted half; 0 where one label is missing.

    A group's scores are cut at approximate quantiles; running counts inside a
    piece and the sums of the pieces before it give every score its rank, so no
    group is sorted in one task.
    """
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    # Stored: a sketch may differ when it is made again, and both uses below must cut alike.
    cuts = materialize(counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("score", shares, F.lit(1000))).alias("_q")))
    rows = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_q", lambda x: x <= F.col("score")))).drop("_q")
    inside = Window.partitionBy(*keys, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy(*keys, "_b").agg(F.sum("neg").alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(below, [*keys, "_b"])
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    # twice the wins, in whole numbers
    wins = F.sum((F.col("pos") * (2 * (F.col("_before") + F.col("_in")) + F.col("neg"))).cast("decimal(38,0)")).cast("double")
    return ranked.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), wins / 2 / pos / neg).otherwise(0.0).alias("auc"))


def fold_gaps(rows: DataFrame, fold: str, score: str, label: str, overfit: float = 0.10) -> DataFrame:
    """``fold, test_auc, train_auc, auc_gap, overfit_flag`` of expanding folds: a fold is tested, all folds before it train.

    Counts of equal scores are copied to the later folds, not rows.
    """
    counts = score_counts(rows, [fold], score, label)
    folds = counts.select(F.col(fold).alias("_f")).distinct()
    both = counts.join(folds, F.col("_f") >= F.col(fold)).select(
        F.col("_f").alias(fold), F.when(F.col("_f") == F.col(fold), "test").otherwise("train").alias("part"), "score", "pos", "neg")
    both = both.groupBy(fold, "part", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = auc_by_group(both, [fold, "part"]).groupBy(fold).agg(
        *[F.coalesce(F.max(F.when(F.col("part") == p, F.col("auc"))), F.lit(0.0)).alias(f"{p}_auc") for p in ("test", "train")])
    gap = F.col("train_auc") - F.col("test_auc")
    return found.withColumns({"auc_gap": gap, "overfit_flag": F.round(gap, 12) > overfit})


def retrain_gates(rows: DataFrame, keys: list[str], score: str, label: str, auc_gate: float = 0.55) -> DataFrame:
    """``keys, auc, profit_factor, accepted, reason`` of a candidate model on its validation rows.

    The profit factor is right over wrong predictions of a win at 0.5.
    """
    y, p = F.col(label).cast("boolean"), F.col(score) >= 0.5
    pf = rows.groupBy(*keys).agg((F.count_if(p & y) / F.greatest(F.count_if(p & ~y), F.lit(1))).alias("profit_factor"))
    found = auc_by_group(score_counts(rows, keys, score, label), keys).join(pf, keys)
    low_auc, low_pf = F.round("auc", 12) < auc_gate, F.col("profit_factor") < 1.0
    return found.withColumns({"accepted": ~low_auc & ~low_pf, "reason": F.when(low_auc, "auc").when(low_pf, "profit_factor")})


def permutation_importance(model, rows: DataFrame, features: list[str], label: str, tie: str, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Loss of AUC when a feature is shuffled.

    The shuffle pairs rows by two hash orders, numbered in hash ranges.
    """
    from tapeline.operators.blocks import number_rows

    base = auc(score(model, rows, features, "_p"), label, "_p")
    out = []
    for f in features:
        for rep in range(repeats):
            shuffled = _shuffle(rows, f, tie, number_rows, seed + rep)
            out.append((f, rep, base - auc(score(model, shuffled, features, "_p"), label, "_p")))
    return rows.sparkSession.createDataFrame(out, "feature string, repeat int, importance double")


def _shuffle(rows: DataFrame, feature: str, tie: str, number_rows, seed: int) -> DataFrame:
    def placed(df, s):
        spread = F.timestamp_seconds(F.shiftright(hash_order(tie, seed=s), 32))
        return number_rows(df.withColumns({"_h": spread, "_all": F.lit(0)}), ["_all"], "_h", 1 << 20, (tie,), "_i", None).drop("_h", "_all")

    left = placed(rows.drop(feature), seed)
    right = placed(rows.select(tie, feature), seed + 7919).select("_i", feature)
    return left.join(right, "_i").drop("_i")
