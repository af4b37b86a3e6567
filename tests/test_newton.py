"""Logistic regression against a dense solution."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.learning import models, newton, training

GRID = models.LOGISTIC.grid["C"]


@pytest.fixture(scope="module")
def points():
    """Badly scaled columns that nearly depend on each other, one of them constant."""
    draw = np.random.default_rng(2)
    n = 400
    age, bp, chol = (draw.integers(*r, n) for r in ((30, 80), (90, 180), (150, 300)))
    x = np.c_[age, bp, chol, age**2, bp**2, chol**2, age * bp, bp / chol, np.zeros(n)].astype(float)
    y = (chol + draw.normal(0, 20, n) < 230).astype(float)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    return x, y, weight, np.arange(n) % 5


@pytest.fixture(scope="module")
def rows(spark, points):
    made = [(a.tolist(), float(b), float(c), int(d)) for a, b, c, d in zip(*points, strict=True)]
    df = spark.createDataFrame(made, "x array<double>, target double, weight double, fold int")
    return df.select(array_to_vector("x").alias("features"), "target", "weight", "fold").repartition(5).cache()


def dense(points, C, left_out=None):
    x, y, weight, fold = points
    keep = np.ones(len(y), dtype=bool) if left_out is None else fold != left_out
    z = np.c_[x, np.ones(len(x))][keep]
    sign, weight = np.where(y == 1, 1.0, -1.0)[keep], weight[keep]
    scale = np.sqrt((z**2).mean(0))
    scale[scale == 0] = 1
    z, ridge, beta = z / scale, 1 / scale**2, np.zeros(z.shape[1])

    def value(b):
        return 0.5 * (ridge * b) @ b + C * weight @ np.logaddexp(0, -sign * (z @ b))

    for _ in range(200):
        miss = 1 / (1 + np.exp(np.clip(sign * (z @ beta), -700, 700)))
        slope = ridge * beta - C * (weight * sign * miss) @ z
        curve = np.diag(ridge) + C * (z * (weight * miss * (1 - miss))[:, None]).T @ z
        root = 1 / np.sqrt(np.diag(curve))
        step, size = root * np.linalg.solve(curve * np.outer(root, root), root * slope), 1.0
        while value(beta - size * step) > value(beta) * (1 + 1e-13) and size > 1e-9:
            size /= 2
        beta = beta - size * step
    return beta / scale


def test_a_grid_and_its_folds_are_solved_to_rest(rows, points):
    problems = [newton.Problem(C, fold) for C in GRID for fold in (None, 0, 3)]
    found = newton.fit_linear(rows, problems, weight="weight", fold="fold")
    for problem, got in zip(problems, found, strict=True):
        assert got == pytest.approx(dense(points, problem.C, problem.left_out), rel=1e-6, abs=1e-9)


def test_slopes_of_all_penalties(rows, points):
    class Assembler:
        def getInputCols(self):
            return [f"c{i}" for i in range(points[0].shape[1])]

    from pyspark.ml.functions import vector_to_array

    named = rows.withColumns({f"c{i}": vector_to_array("features")[i] for i in range(points[0].shape[1])})
    train = training.TrainingSet(named, Assembler(), rows.count())
    for C in GRID:
        model = models.logistic({"C": C}, 0).fit(rows)
        assert training.logistic_gradient(train, model, C) < 1e-9


def test_the_model_is_sparks_own(spark, rows, points, tmp_path):
    model = newton.NewtonClassifier(labelCol="target", weightCol="weight", C=0.5).fit(rows)
    assert isinstance(model, LogisticRegressionModel)
    beta = dense(points, 0.5)
    assert model.coefficients.toArray() == pytest.approx(beta[:-1], rel=1e-6, abs=1e-9)
    assert model.intercept == pytest.approx(beta[-1], rel=1e-6)
    model.write().save(f"{tmp_path}/model")
    loaded = LogisticRegressionModel.load(f"{tmp_path}/model")
    assert loaded.coefficients == model.coefficients
    got = loaded.transform(rows).select("prediction", "probability", "features").head(20)
    for r in got:
        margin = r.features.toArray() @ beta[:-1] + beta[-1]
        assert r.probability[1] == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-5)
        assert r.prediction == float(margin > 0)


def test_the_result_does_not_depend_on_partitions(rows):
    one = newton.fit_linear(rows.coalesce(1), [newton.Problem(1.0)], weight="weight")[0]
    many = newton.fit_linear(rows.repartition(37), [newton.Problem(1.0)], weight="weight")[0]
    assert many == pytest.approx(one, rel=1e-7, abs=1e-10)


def test_separable_one_class_and_empty(spark):
    schema = "x array<double>, target double"

    def table(data):
        return spark.createDataFrame(data, schema).select(array_to_vector("x").alias("features"), "target")

    split = newton.fit_linear(table([([float(i)], float(i > 4)) for i in range(10)]), [newton.Problem(1e4)])[0]
    assert split[0] > 0 and -9 < split[1] / split[0] < 0
    same = newton.fit_linear(table([([1.0], 1.0)] * 5), [newton.Problem(1.0)])[0]
    assert same[0] > 0 and same[1] > 0
    with pytest.raises(ValueError, match="no rows"):
        newton.fit_linear(table([]), [newton.Problem(1.0)])


def test_arrays_are_added_up_in_groups(spark):
    rows = [(i % 3, np.array([1.0, i]).tobytes()) for i in range(500)]
    partials = spark.createDataFrame(rows, "key int, sums binary").repartition(30)
    assert newton.added_up(partials, 30)[0].tolist() == [167, sum(range(0, 500, 3))]
    found = newton.added_up(partials, 5_000)
    assert {k: v[0] for k, v in found.items()} == {0: 167, 1: 167, 2: 166}
    assert sum(v[1] for v in found.values()) == sum(range(500))


def test_rounded_hinge(rows, points):
    """Against plain descent on the same loss, and its derivatives against differences."""
    margin = np.linspace(-3, 3, 601) + 1e-4
    for loss_of in newton.LOSSES.values():
        loss, fall, bend = loss_of(margin)
        ahead, behind = loss_of(margin + 1e-6), loss_of(margin - 1e-6)
        assert (behind[0] - ahead[0]) / 2e-6 == pytest.approx(fall, abs=1e-5)
        smooth = np.abs(np.abs(margin - 1) - newton.BEND) > 1e-3
        assert ((behind[1] - ahead[1]) / 2e-6)[smooth] == pytest.approx(bend[smooth], abs=1e-4)
    x, y, weight, _ = points
    small = np.c_[(x[:, 0] - 55) / 15, (x[:, 2] - 225) / 45]
    z, sign = np.c_[small, np.ones(len(x))], np.where(y == 1, 1.0, -1.0)
    beta = np.zeros(3)
    for _ in range(40_000):
        _, fall, _ = newton.hinge_loss(sign * (z @ beta))
        beta -= 5e-4 * (beta - (weight * sign * fall) @ z)
    table = rows.sparkSession.createDataFrame(
        [(a.tolist(), float(b), float(c)) for a, b, c in zip(small, y, weight, strict=True)],
        "x array<double>, target double, weight double",
    ).select(array_to_vector("x").alias("features"), "target", "weight")
    found = newton.fit_linear(table, [newton.Problem(1.0)], weight="weight", loss="hinge")[0]
    assert found == pytest.approx(beta, abs=1e-5)
    model = newton.NewtonClassifier(labelCol="target", weightCol="weight", loss="hinge").fit(table)
    got = model.transform(table).select("rawPrediction", "features").head(5)
    for r in got:
        assert r.rawPrediction[1] == pytest.approx(r.features.toArray() @ found[:2] + found[2])


def test_features_made_on_the_way(rows):
    """The result is that of the features stored."""
    def squares(x):
        return np.hstack([x[:, :2], x[:, :2] ** 2])

    from pyspark.ml.functions import vector_to_array

    old = vector_to_array("features")
    wide = rows.select(
        array_to_vector(F.array(old[0], old[1], old[0] * old[0], old[1] * old[1])).alias("features"), "target", "weight"
    )
    on_the_way = newton.fit_linear(rows, [newton.Problem(1.0)], weight="weight", mapped=squares)[0]
    stored = newton.fit_linear(wide, [newton.Problem(1.0)], weight="weight")[0]
    assert on_the_way == pytest.approx(stored, rel=1e-6, abs=1e-9)


def test_folds_start_where_all_rows_end(spark, monkeypatch):
    """Fold problems wait for the whole one, and come to the same rest in fewer steps."""
    draw = np.random.default_rng(8)
    made = [
        ([float(a), float(b)], float(a + b + c > 0), i % 5)
        for i, (a, b, c) in enumerate(draw.normal(size=(600, 3)))
    ]
    df = spark.createDataFrame(made, "x array<double>, target double, fold int").select(
        array_to_vector("x").alias("features"), "target", "fold"
    ).persist()
    looked, evaluated = [], newton._evaluated

    def counted(rows, scales, at, *rest):
        looked.append(sorted(at))
        return evaluated(rows, scales, at, *rest)

    monkeypatch.setattr(newton, "_evaluated", counted)
    for loss in ("logistic", "hinge"):
        folds = [newton.Problem(1.0, fold) for fold in range(5)]
        looked.clear()
        alone = newton.fit_linear(df, folds, fold="fold", loss=loss)
        steps = sum(len(at) for at in looked)
        looked.clear()
        together = newton.fit_linear(df, [*folds, newton.Problem(1.0)], fold="fold", loss=loss)
        assert looked[0] == [5] and all(5 not in at or at == [5] for at in looked)
        assert sum(len(at) for at in looked if at != [5]) < steps
        for a, b in zip(alone, together):
            assert a == pytest.approx(b, rel=1e-5, abs=1e-7)
