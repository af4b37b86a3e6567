"""The kernel machine against an exact one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from riskframe.learning import models, training, workflow
from riskframe.learning.kernel import Nystrom, NystromModel, gaussian


def vectors(spark, x, *more):
    rows = [(i, p.tolist(), *(float(m[i]) for m in more)) for i, p in enumerate(x)]
    names = ", ".join(f"m{i} double" for i in range(len(more)))
    df = spark.createDataFrame(rows, "id long, x array<double>" + (f", {names}" if names else ""))
    return df.withColumn("features", array_to_vector("x"))


def test_products_are_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(80, 3)) * [1, 10, 100] + [5, 0, -3]
    x = np.c_[x, np.full(80, 7.0)]
    df = vectors(spark, np.r_[x, x[:5]]).repartition(3)
    model = Nystrom(size=100, gamma=0.3).fit(df)
    out = {r[0]: r[1] for r in model.transform(df).select("id", vector_to_array("kernel_features")).collect()}
    z = np.array([out[i] for i in range(85)])
    both = np.r_[x, x[:5]]
    unit = np.where(both.std(0, ddof=1) > 0, both.std(0, ddof=1), np.inf)
    exact = gaussian((both - both.mean(0)) / unit, (both - both.mean(0)) / unit, 0.3)
    # As many landmarks as rows: nothing is approximated.
    assert np.abs(z @ z.T - exact).max() < 1e-4
    # Equal rows map equally.
    assert np.array_equal(z[80:], z[:5])


def test_few_landmarks_approximate_it(spark):
    x = np.random.default_rng(3).normal(size=(400, 4))
    df = vectors(spark, x)
    errors = []
    for size in (10, 40, 160):
        model = Nystrom(size=size).fit(df)
        marks = np.array(model.getOrDefault(model.landmarks)).reshape(-1, 4)
        assert len(marks) <= size
        z = np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("kernel_features")).collect()])
        exact = gaussian(*[(x - x.mean(0)) / x.std(0, ddof=1)] * 2, model.getOrDefault(model.gamma))
        errors.append(np.abs(z @ z.T - exact).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.005


def test_default_width_and_saved_model(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(30, 3))
    x[:, 2] = 4.0
    df = vectors(spark, x)
    model = Nystrom(size=8).fit(df)
    # One over the columns that vary.
    assert model.getOrDefault(model.gamma) == 0.5
    model.write().save(f"{tmp_path}/model")
    loaded = NystromModel.load(f"{tmp_path}/model")
    a, b = (m.transform(df).orderBy("id").select(vector_to_array("kernel_features")).collect() for m in (model, loaded))
    assert a == b


def test_equal_rows_only(spark):
    df = vectors(spark, np.ones((6, 2)))
    out = Nystrom(size=4).fit(df).transform(df).select(vector_to_array("kernel_features")).distinct()
    assert out.count() == 1


def exact_machine(x, y, weight, at, gamma, C):
    """Margins of a kernel machine by coordinate steps on the dual, to the end."""
    sign = np.where(y == 1, 1.0, -1.0)
    kernel = (gaussian(x, x, gamma) + 1) * np.outer(sign, sign)
    alpha, slope = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(1_000):
        moved = 0.0
        for i in range(len(y)):
            new = min(max(alpha[i] - slope[i] / kernel[i, i], 0), C * weight[i])
            step = new - alpha[i]
            if step:
                slope += step * kernel[:, i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-6:
            break
    return (gaussian(at, x, gamma) + 1) @ (alpha * sign)


@pytest.fixture(scope="module")
def people(spark):
    """500 patients whose label no straight line tells."""
    draw = np.random.default_rng(8)
    x = np.c_[draw.integers(30, 80, 500), draw.integers(90, 180, 500), draw.integers(150, 300, 500)].astype(float)
    z = (x - x.mean(0)) / x.std(0)
    y = ((z**2).sum(1) + draw.normal(scale=0.5, size=500) < 2.6).astype(int)
    rows = [(i, *p.tolist(), "all", int(t)) for i, (p, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, thal string, target int")


def test_as_good_as_the_exact_machine(people):
    trained = workflow.prepare(people)
    spec = models.Spec("svm", models.svm, {"C": (1,)}, loss="hinge", features=models.KERNEL_FEATURES)
    _, machine = training.fit_svm(trained.train, spec)
    got = machine.transform(trained.test).select("id", "target", "prediction").collect()
    accuracy = np.mean([r.target == r.prediction for r in got])

    def numbers(df):
        rows = df.select("a", "b", "c", "target").collect()
        return np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])

    (x, y), (at, truth) = numbers(trained.train.rows), numbers(trained.test)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    center, unit = x.mean(0), x.std(0, ddof=1)
    margins = exact_machine((x - center) / unit, y, weight, (at - center) / unit, 1 / 3, 1)
    exact = np.mean((margins > 0) == (truth == 1))
    assert exact > 0.85 and abs(accuracy - exact) <= 0.03
