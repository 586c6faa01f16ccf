"""Models at small sizes: what must hold whatever the trees look like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath import schemas as S
from carepath.operators import ml as ML
from carepath.operators import shap as SH
from carepath.plans import ml_queries as Q
from carepath.session import shared_path
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    """Two classes that the first feature tells apart but for some noise."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(600, 4))
    y = (x[:, 0] + 0.3 * rnd.normal(size=600) > 0.4).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(600)],
                               ["subject_id", *S.BASIC_FEATURES, "label"])
    return df.withColumn("label", F.col("label").cast("int")).checkpoint(eager=True)


def _auc(pred):
    p = [(r.risk_score, r.label) for r in pred.collect()]
    pos, neg = [s for s, y in p if y == 1], [s for s, y in p if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_split_cut_is_exact_decimal(spark):
    # 15 * 0.2 is a little above 3 in doubles
    df = spark.range(15).select(F.col("id").alias("subject_id"), F.lit(1).alias("label"))
    assert ML.stratified_split(df).where("split = 'test'").count() == 3


def test_three_models_learn(rows):
    sp = ML.stratified_split(rows).checkpoint(eager=True)
    train, test = (sp.where(f"split = '{s}'") for s in ("train", "test"))
    params = ML.standardize_params(train, S.BASIC_FEATURES)
    std = ML.class_weights(ML.standardize(sp, params))
    fits = {
        "logistic": (ML.train_logistic(std.where("split = 'train'"), S.BASIC_FEATURES), std.where("split = 'test'")),
        "forest": (ML.train_forest(ML.class_weights(train), S.BASIC_FEATURES, trees=10, depth=6), test),
        "boosted": (ML.train_gbt_base(ML.class_weights(train, mode="pos_scale"), rounds=10), test),
    }
    for name, (model, held) in fits.items():
        pred = ML.score(model, held)
        assert pred.count() == test.count(), name
        assert ML.roc_auc(pred).first().roc_auc == pytest.approx(_auc(pred), abs=1e-12)
        assert _auc(pred) > 0.85, name
        report = {r.cls: r for r in ML.holdout_report(pred).collect()}
        assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
        assert report["0"].support + report["1"].support == report["accuracy"].support == test.count()
        assert report["1"].gate == "target achieved (ROC-AUC >= 0.80)" and report["1"].roc_auc == pytest.approx(_auc(pred))


def test_cross_validation_scores_each_row_once(rows):
    pred = ML.fold_predictions(ML.class_weights(rows, mode="pos_scale"), lambda t: ML.train_gbt_base(t, rounds=5), 3)
    pred = pred.checkpoint(eager=True)
    assert sorted(r.subject_id for r in pred.collect()) == list(range(600))
    folds = {r.subject_id: r.fold for r in ML.stratified_folds(rows, k=3).collect()}
    assert all(folds[r.subject_id] == r.fold for r in pred.collect())
    per = {r.fold: r.roc_auc for r in ML.fold_auc(pred, 3).collect()}
    for f in range(3):
        assert per[f] == pytest.approx(_auc(pred.where(F.col("fold") == f)), abs=1e-12)
    s = ML.cv_summary(ML.fold_auc(pred, 3)).first()
    assert s.mean == pytest.approx(np.mean(list(per.values()))) and s.std == pytest.approx(np.std(list(per.values())))


def test_boosted_wards(spark):
    rnd = np.random.default_rng(2)
    names = ["General", "ICU", "MICU", "Private"]
    data = []
    for i in range(500):
        w = i % 4
        data.append((i, *[float(v) for v in rnd.normal(size=6)], float(w + 0.2 * rnd.normal()), names[w] if i % 9 else None))
    df = spark.createDataFrame(data, ["subject_id", *S.WARD_FEATURES, "predicted_ward"]).checkpoint(eager=True)
    known = df.where("predicted_ward is not null")
    for train, weight in ((known, None), (ML.class_weights(known, "predicted_ward"), "weight")):
        model = ML.train_ward(train, rounds=5, weight=weight)
        got = {r.subject_id: r for r in ML.score_ward(model, df).collect()}
        probs = {r.subject_id: r.ward_probabilities for r in ML.ward_probabilities(model, df).collect()}
        assert set(got) == set(range(500))
        assert all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p in probs.values())
        assert all(got[i].ward_pred == names[int(np.argmax(p))] and got[i].ward_probability == np.round(max(p), 3)
                   for i, p in probs.items())
        assert sum(got[i].ward_pred == names[i % 4] for i in got) > 450
        imp = {r.feature: r.importance for r in ML.ward_importance(spark, model).collect()}
        assert sum(imp.values()) == pytest.approx(1) and max(imp, key=imp.get) == "risk_score"
    path = shared_path(spark, "ward_model")
    ML.save_model(model, path)
    again = {r.subject_id: r.ward_pred for r in ML.score_ward(ML.load_model(path), df).collect()}
    assert again == {i: r.ward_pred for i, r in got.items()}


def test_waterfall_ends_at_the_log_odds(spark, rows):
    model = ML.train_gbt_base(ML.class_weights(rows, mode="pos_scale"), rounds=5)
    path = shared_path(spark, "waterfall_model")
    ML.save_model(model, path)
    some = rows.where("subject_id % 50 = 0")
    shap = SH.shap_values(spark, some, S.BASIC_FEATURES, SH.gbt_stage_path(path, spark))
    steps = {}
    for r in SH.waterfall(shap, some).orderBy("subject_id", "rank").collect():
        steps.setdefault(r.subject_id, []).append(r)
    score = {r.subject_id: r for r in ML.score(model, some).collect()}
    assert set(steps) == set(score)
    for i, x in steps.items():
        assert [s.rank for s in x] == [1, 2, 3, 4] and x[0].start == x[0].base_value
        assert all(a.end == b.start and abs(a.shap) >= abs(b.shap) for a, b in zip(x, x[1:]))
        assert all(s.end == pytest.approx(s.start + s.shap) and s.feature_value == score[i][s.feature[5:]] for s in x)
        p = score[i].risk_score
        assert x[-1].end == pytest.approx(np.log(p / (1 - p)), abs=1e-6)


def test_models_are_fitted_once_per_state_of_the_inputs(spark, tmp_path, monkeypatch):
    fits = []
    monkeypatch.setattr(Q, "shared_path", lambda spark, name, unique=True: str(tmp_path / name))
    build = lambda c, folder: (fits.append(folder), spark.range(1).write.parquet(f"{folder}/x"))
    one, two = (Q._stored(spark, SF_SMALL, "risk", build) for _ in range(2))
    assert one == two and len(fits) == 1
    assert Q._stored(spark, SF_SMALL, "risk", build, rebuild=True) != one and len(fits) == 2


def _random_tree(rnd, features, depth, next_to=()):
    """A full tree with a feature used again on a path, and thresholds that values hit exactly."""
    n = 2 ** (depth + 1) - 1
    inner = np.arange(n) < 2 ** depth - 1
    cover = np.ones(n)
    for j in range(n - 1, 0, -1):
        cover[j] = cover[j] if inner[j] else rnd.integers(1, 9)
    for j in range(2 ** depth - 2, -1, -1):
        cover[j] = cover[2 * j + 1] + cover[2 * j + 2]
    return SH.Tree(np.where(inner, 2 * np.arange(n) + 1, -1), np.where(inner, 2 * np.arange(n) + 2, -1),
                   np.where(inner, rnd.integers(0, features, n), -1), rnd.integers(0, 4, n) / 2.0, rnd.normal(size=n), cover, 1.0)


def test_attributions_are_worked_out_per_pattern_not_per_row(monkeypatch):
    rnd = np.random.default_rng(4)
    sizes, extend = [], SH._extend
    monkeypatch.setattr(SH, "_extend", lambda path, pz, po, pi: (sizes.append(len(po)), extend(path, pz, po, pi))[1])
    for features, depth in ((4, 4), (2, 5), (11, 6)):
        tree = _random_tree(rnd, features, depth)
        X = rnd.integers(-1, 5, (3000, features)) / 2.0
        X[0, 0], X[1, 0] = np.nan, -np.inf
        phi = SH.tree_shap(tree, X)
        assert np.allclose(phi.sum(axis=1), SH.ensemble_margin([tree], X) - SH.expected_value(tree), atol=1e-9)
        few = SH.tree_shap(tree, X[:5])          # fewer rows than patterns
        assert np.allclose(few, phi[:5], atol=1e-12)
    assert max(sizes) <= 2 ** 6
    leaf = SH.Tree(*(np.array([v]) for v in (-1, -1, -1)), np.array([np.nan]), np.array([0.5]), np.array([3.0]), 1.0)
    assert not SH.tree_shap(leaf, np.zeros((2, 3))).any()


def test_a_ward_query_fits_the_one_model_it_uses(spark, tmp_path, monkeypatch):
    fits, train = [], ML.train_ward
    monkeypatch.setattr(Q, "shared_path", lambda spark, name, unique=True: str(tmp_path / name))
    monkeypatch.setattr(ML, "train_ward", lambda rows: (fits.append(rows.count()), train(rows, rounds=1))[1])
    assert Q.q_train_ward(spark, SF_SMALL).count() and Q.q_ward_importance(spark, SF_SMALL).count() == len(S.WARD_FEATURES)
    assert len(fits) == 1
    assert Q.q_score_ward(spark, SF_SMALL).count() and len(fits) == 2 and fits[1] > fits[0]


def test_side_by_side_runs_at_once_and_keeps_names(spark):
    import threading
    meet = threading.Barrier(3, timeout=60)
    assert ML.side_by_side(spark, {n: lambda n=n: (meet.wait(), n)[1] for n in "abc"}) == {n: n for n in "abc"}


def test_rows_of_tree_fits_are_dealt_evenly_over_the_cores(spark, rows):
    cores = spark.sparkContext.defaultParallelism
    places = lambda df: [[r.subject_id for r in p] for p in df.rdd.glom().collect()]
    uneven = rows.where("subject_id < 600").repartitionByRange(3, F.expr("sqrt(subject_id)")).where("subject_id % 3 < 2")
    for most, parts in ((500, cores), (30, cores * -(-400 // (30 * cores)))):
        dealt = ML.sized(uneven, rows_per_partition=10, most_rows=most)
        got = places(dealt)
        assert len(got) == parts and max(map(len, got)) - min(map(len, got)) <= 3 and max(map(len, got)) <= most
        assert sorted(i for p in got for i in p) == [i for i in range(600) if i % 3 < 2]
        assert all(p == sorted(p) for p in got)                                # places that bagging can draw by
        assert got == places(ML.sized(uneven, rows_per_partition=10, most_rows=most))
    assert ML.sized(rows).rdd.getNumPartitions() == 1                          # few rows stay together


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    train = ML.class_weights(rows)
    kept = ML.train_forest(train, S.BASIC_FEATURES, trees=5).stages[-1]
    assert kept.getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=5, maxDepth=30, weightCol="weight", seed=ML.SEED, cacheNodeIds=False)
    again = Pipeline(stages=[ML._assembler(S.BASIC_FEATURES), plain]).fit(ML.sized(train)).stages[-1]
    assert kept.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]


def test_trees_of_blocks_are_those_of_spark_ml(spark, rows):
    train = ML.class_weights(rows.withColumn("admission_count", F.round("admission_count")), mode="pos_scale")
    for depth, step in ((4, 0.1), (6, 0.05)):
        given = {"cols": S.BASIC_FEATURES, "rounds": 12, "depth": depth, "step": step}      # margins are kept anew in between
        plain, blocks = ML.train_gbt(train, **given), ML.train_gbt(train, **given, rows_per_partition=0)
        a, b = ({r.subject_id: (r.risk_score, r.risk_prediction) for r in ML.score(m, train).collect()} for m in (plain, blocks))
        assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
        assert blocks.stages[-1].treeWeights == plain.stages[-1].treeWeights
        assert blocks.stages[-1].featureImportances.toArray().sum() == pytest.approx(1)
    path = shared_path(spark, "block_model")
    ML.save_model(blocks, path)
    assert {r.subject_id: (r.risk_score, r.risk_prediction) for r in ML.score(ML.load_model(path), train).collect()} == b
    trees = SH.load_ensemble(spark, SH.gbt_stage_path(path, spark))
    assert all(t.cover[0] == 600 and np.isclose(t.cover[t.left >= 0], t.cover[t.left[t.left >= 0]] + t.cover[t.right[t.left >= 0]]).all()
               for t in trees)


def test_blocks_of_many_rows_draw_rows_and_features(spark, rows):
    train = ML.class_weights(rows, mode="pos_scale")
    fits = [ML.train_gbt(df, S.BASIC_FEATURES, rounds=10, depth=6, step=0.05, subsample=0.8, colsample="0.5", rows_per_partition=0)
            for df in (train, train)]
    one, two = ({r.subject_id: r.risk_score for r in ML.score(m, train).collect()} for m in fits)
    assert one == two and _auc(ML.score(fits[0], train)) > 0.9                         # the same draws in every fit
    path = shared_path(spark, "drawn_model")
    ML.save_model(fits[0], path)
    trees = SH.load_ensemble(spark, SH.gbt_stage_path(path, spark))
    drawn = [t.cover[0] for t in trees]
    assert len(set(drawn)) > 3 and 430 < min(drawn) <= max(drawn) < 530 and {int(t.feature[0]) for t in trees} > {0}
    pred = ML.fold_predictions(train, lambda t: ML.train_gbt(t, S.BASIC_FEATURES, rounds=5, subsample=0.8, rows_per_partition=0), 3)
    assert sorted(r.subject_id for r in pred.collect()) == list(range(600)) and _auc(pred) > 0.85


def test_blocks_with_odd_rows(rows):
    from carepath.operators import boosting as B
    fit = lambda df: ML.train_gbt(df, S.BASIC_FEATURES, rounds=2, rows_per_partition=0)
    train = ML.class_weights(rows, mode="pos_scale")
    same = train.withColumns({c: F.lit(1.0) for c in S.BASIC_FEATURES})                  # nothing to split on
    scores = {r.risk_score for r in ML.score(fit(same), same).collect()}
    assert len(scores) == 1 and 0.49 < scores.pop() < 0.51
    none = ML.class_weights(rows.withColumn("label", F.lit(0)), mode="pos_scale")        # one class only
    assert {r.risk_prediction for r in ML.score(fit(none), none).collect()} == {0}
    with pytest.raises(Exception, match="NaN"):
        fit(train.withColumn("admission_count", F.lit(float("nan"))))
    assert B.split_points(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4), 8).tolist() == [1.5, 2.5]
    assert len(B.split_points(np.arange(1000.0), np.ones(1000), 64)) == 63
