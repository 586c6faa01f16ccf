"""Model training, scoring and evaluation with Spark ML over DataFrames.

Splits and folds are exact per class but computed distributedly (see
``ranking``); every statistic a model needs (means, class counts) is one
small aggregate row, bound into the plan as literals. Metrics aggregate
(label, prediction) pairs on executors.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.functions import scalar as X
from carepath.operators import boosting
from carepath.operators.joins import sized_broadcast
from carepath.operators.ranking import prefix_sum, rank_within

SEED = 42


# ------------------------------------------------------------ model inputs
def training_frame(features: DataFrame, feature_cols: list[str], label: str = "high_risk_label",
                   recency_default: float = -1.0) -> DataFrame:
    """Labelled rows; missing recency reads ``recency_default`` (-1 for the basic and ward
    models, 0 for the enhanced one) and other gaps 0."""
    cols = []
    for c in feature_cols:
        if c == "days_since_last_admission":
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(recency_default)).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
    return features.filter(F.col(label).isNotNull()).select("subject_id", *cols, F.col(label).alias("label"))


def nonzero_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, std, keep): sample std of every candidate in one aggregate; the exact value decides."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(c).alias("std"))
                      for i, c in enumerate(cols)])
    return (row.select(F.inline(items))
               .withColumn("keep", F.coalesce(F.col("std") > 0, F.lit(False)))
               .withColumn("std", X.stable(F.col("std"))).drop("position"))


def kept_features(df: DataFrame, cols: list[str]) -> list[str]:
    keep = {r["feature"] for r in nonzero_variance(df, cols).filter("keep").collect()}
    return [c for c in cols if c in keep]


def _shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A pseudo-random order of the rows by key and seed that any engine can compute."""
    return df.withColumn("_h", F.md5(F.concat(F.col("subject_id").cast("string"), F.lit(f":{seed}")).cast("binary")))


def stratified_split(df: DataFrame, label: str = "label", test_fraction: str = "0.2",
                     seed: int = SEED) -> DataFrame:
    """Adds ``split`` in {train, test}: exactly ceil(f·n_c) test rows per class (``test_fraction`` is a decimal).

    Rows are ordered by a seeded digest of the key within their class; the
    class counts (one number per class) set the cut.
    """
    ranked = rank_within(_shuffled(df, seed), [label], ["_h", "subject_id"], name="_r")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    cut = counts.select(label, F.ceil(F.col("_n") * F.lit(Decimal(test_fraction))).alias("_cut"))
    return (ranked.join(sized_broadcast(cut), label)
                  .withColumn("split", F.when(F.col("_r") < F.col("_cut"), "test").otherwise("train"))
                  .drop("_h", "_r", "_cut"))


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` in 0..k-1: class sizes per fold differ by at most one."""
    return (rank_within(_shuffled(df, seed), [label], ["_h", "subject_id"], name="_r")
            .withColumn("fold", (F.col("_r") % k).cast("int")).drop("_h", "_r"))


def standardize_params(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column from the training rows (one aggregate row)."""
    row = train.agg(*[x for c in cols for x in (X.stable(F.avg(c)).alias(f"m_{c}"),
                                                 X.stable(F.stddev_pop(c)).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in cols}


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a constant column keeps scale 1."""
    out = df
    for c, (m, s) in params.items():
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0))
    return out


def class_weights(df: DataFrame, label: str = "label", mode: str = "balanced") -> DataFrame:
    """Adds ``weight``: balanced n/(k·n_c), or neg/pos on positives ("pos_scale")."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    if mode == "balanced":
        expr = None
        for c, nc in counts.items():
            wv = F.lit(n / (k * nc))
            expr = F.when(F.col(label) == c, wv) if expr is None else expr.when(F.col(label) == c, wv)
        return df.withColumn("weight", expr.otherwise(F.lit(1.0)))
    neg, pos = counts.get(0, 0), counts.get(1, 0)
    scale = neg / pos if pos > 0 else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(F.lit(1.0)))


# --------------------------------------------------------------- trainers
def _assembler(cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")


def dealt(rows: int, cores: int, rows_per_partition: int = 50_000, most_rows: int = 500_000) -> int:
    """Partitions, one a core or a multiple, to which more than ``rows_per_partition`` rows a core are dealt; 0 for fewer rows."""
    return cores * math.ceil(rows / (cores * most_rows)) if rows > rows_per_partition * cores else 0


def sized(train: DataFrame, rows_per_partition: int = 50_000, most_rows: int = 500_000) -> DataFrame:
    """Training rows in partitions for tree fits, where each level is a job over all partitions.

    Up to ``rows_per_partition`` rows a core: partitions of about that many. Beyond, dealt evenly to one partition a core
    (or a multiple, of at most ``most_rows``), as a level pays for each task and waits for the last. Rows are
    ordered within and checkpointed: bagging draws by a row's place, which must not change when a partition is read again.
    """
    n = train.count()
    parts = dealt(n, train.sparkSession.sparkContext.defaultParallelism, rows_per_partition, most_rows)
    if not parts:
        return train.coalesce(max(1, math.ceil(n / rows_per_partition)))
    return train.repartition(parts).sortWithinPartitions(*train.columns).checkpoint(eager=True)


def train_logistic(train: DataFrame, cols: list[str]) -> PipelineModel:
    """L2 logistic regression at C = 1 on standardized inputs with balanced weights."""
    n = train.count()
    lr = LogisticRegression(weightCol="weight", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=100)
    return Pipeline(stages=[_assembler(cols), lr]).fit(train)


def train_forest(train: DataFrame, cols: list[str], trees: int = 100, depth: int = 30) -> PipelineModel:
    """Balanced forest; ``depth`` is the deepest Spark grows, in place of no limit.

    A row's node in each tree is kept from level to level (``cacheNodeIds``), not found again from the root.
    """
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=SEED, cacheNodeIds=True)
    return Pipeline(stages=[_assembler(cols), rf]).fit(sized(train))


def train_gbt(train: DataFrame, cols: list[str], rounds: int = 100, depth: int = 4, step: float = 0.1,
              subsample: float = 1.0, colsample: str = "all", rows_per_partition: int = 50_000) -> PipelineModel:
    """Boosted trees; positives weighted neg/pos by the caller's ``weight`` column.

    Beyond ``rows_per_partition`` rows a core the trees grow from column blocks (see ``boosting``).
    """
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample,
                        featureSubsetStrategy=colsample, weightCol="weight", seed=SEED, maxBins=64)
    parts = dealt(train.count(), train.sparkSession.sparkContext.defaultParallelism, rows_per_partition)
    model = boosting.fit(gbt, train, cols, parts) if parts and boosting.suits(gbt) else None
    if model:
        return PipelineModel([_assembler(cols), model])
    return Pipeline(stages=[_assembler(cols), gbt]).fit(sized(train))


def train_gbt_base(train: DataFrame, cols: list[str] = S.BASIC_FEATURES, rounds: int = 100) -> PipelineModel:
    return train_gbt(train, cols, rounds=rounds, depth=4, step=0.1)


def train_gbt_enhanced(train: DataFrame, cols: list[str], rounds: int = 300) -> PipelineModel:
    return train_gbt(train, cols, rounds=rounds, depth=6, step=0.05, subsample=0.8, colsample="0.8")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds risk_score (P(class 1)), risk_prediction (0.5 cut) and risk_tier."""
    out = model.transform(df)
    p1 = vector_to_array("probability")[1]
    return (out.withColumn("risk_score", p1)
               .withColumn("risk_prediction", F.col("prediction").cast("int"))
               .withColumn("risk_tier", X.risk_tier("risk_score"))
               .drop("features", "rawPrediction", "probability", "prediction"))


# ------------------------------------------------------------------ wards
def ward_indexer() -> StringIndexer:
    """Ward label -> index in lexicographic order of the labels."""
    return StringIndexer(inputCol="predicted_ward", outputCol="label", stringOrderType="alphabetAsc")


def train_ward(train: DataFrame, cols: list[str] = S.WARD_FEATURES, rounds: int = 100, depth: int = 4,
               step: float = 0.1, weight: str | None = None) -> PipelineModel:
    """Boosted multiclass ward model: indexer -> assembler -> one boosted model per ward against the rest.

    The wards' models are fitted in parallel; ``weight`` names a column of row weights, as ``class_weights`` adds.
    """
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=SEED, maxBins=64)
    each = OneVsRest(classifier=gbt, parallelism=4)
    if weight:
        each.setWeightCol(weight)
    return Pipeline(stages=[ward_indexer(), _assembler(cols), each]).fit(sized(train))


def ward_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``ward_probabilities``: per ward (in label order) its model's probability, normalised to sum to one."""
    out = model.stages[1].transform(df)
    for i, m in enumerate(model.stages[-1].models):     # as many as there are wards
        out = (m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1])
               .drop("rawPrediction", "probability", "prediction"))
    each = [f"_p{i}" for i in range(len(model.stages[-1].models))]
    total = sum((F.col(c) for c in each[1:]), F.col(each[0]))
    return out.withColumn("ward_probabilities", F.array(*[F.col(c) / total for c in each])).drop("features", *each)


def score_ward(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted ward for every row, with the largest class probability (3 dp); the first label wins a tie."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    p = F.col("ward_probabilities")
    return (ward_probabilities(model, df)
            .withColumn("ward_pred", F.element_at(labels, F.array_position(p, F.array_max(p)).cast("int")))
            .withColumn("ward_probability", X.round_confidence("ward_probabilities")).drop("ward_probabilities"))


def ward_importance(spark: SparkSession, model: PipelineModel, cols: list[str] = S.WARD_FEATURES) -> DataFrame:
    """(feature, importance): mean of the wards' models, sorted desc."""
    each = [m.featureImportances.toArray() for m in model.stages[-1].models]
    return _importances(spark, cols, (sum(each) / len(each)).tolist())


# ---------------------------------------------------------------- metrics
def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1, support plus accuracy / macro / weighted rows.

    One grouped count of (label, prediction) pairs on executors; the rest is
    arithmetic over at most classes^2 rows.
    """
    pairs = pred.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")) \
                .agg(F.count(F.lit(1)).alias("n"))
    tp = pairs.filter("y = p").select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    npred = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("n_pred"))
    per = (sup.join(npred, "cls", "full_outer").join(tp, "cls", "left")
              .select("cls", F.coalesce("support", F.lit(0)).alias("support"),
                      F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp")))
    per = per.select("cls", "support",
                     F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")),
                                F.lit(0.0)).alias("precision"),
                     F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")),
                                F.lit(0.0)).alias("recall"), "tp")
    per = per.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  X.stable(F.avg("precision")).alias("mp"), X.stable(F.avg("recall")).alias("mr"),
                  X.stable(F.avg("f1")).alias("mf"),
                  X.stable(F.sum(F.col("precision") * F.col("support"))).alias("wp"),
                  X.stable(F.sum(F.col("recall") * F.col("support"))).alias("wr"),
                  X.stable(F.sum(F.col("f1") * F.col("support"))).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("cls"), F.col("n").alias("support"),
                     F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                     (F.col("tp") / F.col("n")).alias("f1"))
    macro = tot.select(F.lit("macro avg").alias("cls"), F.col("n").alias("support"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"))
    weighted = tot.select(F.lit("weighted avg").alias("cls"), F.col("n").alias("support"),
                          (F.col("wp") / F.col("n")).alias("precision"), (F.col("wr") / F.col("n")).alias("recall"),
                          (F.col("wf") / F.col("n")).alias("f1"))
    return per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(pred: DataFrame, classes: list, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """One row per true class, one ``pred_<class>`` count column per predicted class (zeros kept)."""
    m = pred.groupBy(label).pivot(prediction, classes).agg(F.count(F.lit(1)))
    return m.select(label, *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes])


def roc_auc(pred: DataFrame, label: str = "label", score_col: str = "risk_score") -> DataFrame:
    """Area under ROC (ties count one half), as one row.

    Rows are first reduced to (score, positives, negatives) per distinct
    score; negatives below each score come from a distributed prefix sum.
    """
    per = (pred.groupBy(F.col(score_col).alias("s"))
               .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    cum = prefix_sum(per, "s", "neg", name="neg_below")
    agg = cum.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("u"),
                  F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(F.try_divide(F.col("u"), (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"))


def quality_gate(auc: DataFrame) -> DataFrame:
    """Hold-out gate message: >= .80 target, >= .75 good, >= .70 decent, else improving."""
    a = F.col("roc_auc")
    msg = (F.when(a >= 0.80, F.lit("target achieved (ROC-AUC >= 0.80)"))
            .when(a >= 0.75, F.lit("good (ROC-AUC >= 0.75)"))
            .when(a >= 0.70, F.lit("decent (ROC-AUC >= 0.70)"))
            .otherwise(F.lit("still improving")))
    return auc.withColumn("gate", msg)


def cv_summary(fold_scores: DataFrame, col: str = "roc_auc") -> DataFrame:
    return fold_scores.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.count(col).alias("folds"))


def _importances(spark: SparkSession, cols: list[str], values: list[float]) -> DataFrame:
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=True)], "feature string, importance double") \
                .orderBy(F.desc("importance"), F.asc("feature"))


def feature_importance(spark: SparkSession, model: PipelineModel, cols: list[str]) -> DataFrame:
    """(feature, importance) sorted desc — a vector as long as the feature list."""
    return _importances(spark, cols, model.stages[-1].featureImportances.toArray().tolist())


def holdout_report(pred: DataFrame) -> DataFrame:
    """Report rows of hold-out predictions, each with the ROC-AUC and the gate message."""
    gate = quality_gate(roc_auc(pred))
    return classification_report(pred, prediction="risk_prediction").withColumns(
        {c: gate.select(c).scalar() for c in ("roc_auc", "gate")})


def side_by_side(spark: SparkSession, fits: dict) -> dict:
    """What each of ``fits`` (name -> function) returns, run at once, one driver thread each: a fit is a chain of small
    jobs, so one alone leaves most of a cluster idle."""
    with ThreadPool(len(fits)) as pool:
        return dict(zip(fits, pool.map(inheritable_thread_target(spark)(lambda name: fits[name]()), fits), strict=True))


def fold_predictions(df: DataFrame, fit, k: int = 5) -> DataFrame:
    """(subject_id, label, fold, risk_score, risk_prediction): every row scored by the model of the other folds.

    The folds' models are fitted ``side_by_side``.
    """
    folded = stratified_folds(df, k=k).checkpoint(eager=True)

    def one(f: int) -> DataFrame:
        model = fit(folded.filter(F.col("fold") != f))
        return score(model, folded.filter(F.col("fold") == f)).select(
            "subject_id", "label", "fold", "risk_score", "risk_prediction")

    parts = side_by_side(df.sparkSession, {f: partial(one, f) for f in range(k)})
    return reduce(DataFrame.unionByName, parts.values())


def fold_auc(pred: DataFrame, k: int = 5) -> DataFrame:
    """(roc_auc, fold) of predictions with a ``fold`` column."""
    return reduce(DataFrame.unionByName, [
        roc_auc(pred.filter(F.col("fold") == f)).withColumn("fold", F.lit(f)) for f in range(k)])


def cross_validate(df: DataFrame, fit, k: int = 5) -> DataFrame:
    """Per-fold ROC-AUC: train on k-1 folds, score the held-out one."""
    return fold_auc(fold_predictions(df, fit, k).checkpoint(eager=True), k)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
