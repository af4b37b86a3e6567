"""Registered learning queries, on patients made from customer.

Most search the whole grids of their models on the stratified four fifths of the
table. What such a model learns no SQL can tell, but what must hold of it can
be: which patients are held out, which fold each training row was left out with,
that classes follow from probabilities and votes from members. The queries
compute these facts from the fitted models. Two small models are recomputed by
SQL: the coefficients of a logistic regression and the split of a tree's root.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.learning import models
from riskframe.learning.kernel import Nystrom
from riskframe.learning.newton import Problem, fit_linear
from riskframe.learning.training import (
    SearchResult,
    fit_stacking,
    fit_svm,
    grid_search,
    logistic_gradient,
    scorer,
    soft_vote,
    unseen_scores,
)
from riskframe.learning.trees import SavedTrees
from riskframe.learning.workflow import (
    Trained,
    importances,
    metrics_rows,
    prepare,
    score_all,
)
from riskframe.operators.features import engineer_features
from riskframe.operators.joins import attach_lookup
from riskframe.operators.metrics import class_weights
from riskframe.session import materialize, scratch_path
from riskframe.sources import stores
from workload import tables

RUN = datetime(2024, 2, 1)
MEASURES = ("id", "age", "sex", "trestbps", "chol", "thalach", "target")
MEMBERS = (models.FOREST, models.LOGISTIC, models.TREE)
#: Largest slope of the loss after a fit, per unit of weight and of a feature's root mean square.
AT_REST = 1e-6
CLOSE = 1e-9


def start(spark: SparkSession, sf_dir: str) -> Trained:
    return prepare(engineer_features(tables.patients(spark, sf_dir).select(*MEASURES)))


def searched(trained: Trained) -> list[SearchResult]:
    return [grid_search(trained.train, spec) for spec in MEMBERS]


def finish(trained: Trained, name: str, model) -> DataFrame:
    """Held-out patients as one model scores them."""
    trained.models[name] = model
    scored = materialize(score_all(trained, RUN), "scored")
    return scored.select(
        "patient_id",
        "model_name",
        F.col("target").cast("int").alias("target"),
        F.col("probability").between(0, 1).alias("probability_in_range"),
        (F.col("prediction") == (F.col("probability") > 0.5).cast("int")).alias(
            "class_follows_probability"
        ),
    )


def probability(column: str) -> Column:
    return vector_to_array(column)[1]


def train_lr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = start(spark, sf_dir)
    found = grid_search(trained.train, models.LOGISTIC)
    slope = logistic_gradient(trained.train, found.model, found.params["C"])
    held_out = finish(trained, models.LOGISTIC.name, scorer(trained.train, found.model))
    return held_out.withColumn("at_rest", F.lit(slope) < AT_REST)


def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a regression on two measures for each penalty of the grid, from one search
    through all of them."""
    patients = tables.patients(spark, sf_dir)
    weights = class_weights(patients, "target").select("target", "weight")
    measured = attach_lookup(patients, weights, "target", True).select(
        array_to_vector(
            F.array((F.col("chol") - 225) / 75.0, (F.col("trestbps") - 135) / 45.0)
        ).alias("features"),
        "target",
        "weight",
    )
    penalties = models.LOGISTIC.grid["C"]
    problems = [Problem(C) for C in penalties]
    found = fit_linear(materialize(measured, "measured"), problems, weight="weight")
    rows = [
        (float(C), term, float(beta))
        for C, betas in zip(penalties, found, strict=True)
        for term, beta in zip(("chol", "trestbps", "intercept"), betas, strict=True)
    ]
    listed = spark.createDataFrame(rows, "C double, term string, coefficient double")
    return listed.withColumn("coefficient", F.round("coefficient", 5))


#: What the root of a tree may be split by: few whole numbers each, so that every one is tried.
STEPS = {
    "age_step": ("age", 10), "chol_step": ("chol", 25),
    "bp_step": ("trestbps", 15), "hr_step": ("thalach", 10),
}


def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of a deep tree, its gain, and the rows and cases of the two nodes under it.

    Leaves of one class are not merged: where all leaves are of one class no root would be left.
    A table that cannot be split has no row.
    """
    patients = tables.patients(spark, sf_dir).select(
        "target",
        F.lit(1.0).alias("weight"),
        array_to_vector(
            F.array(*[F.floor(F.col(c) / size).cast("double") for c, size in STEPS.values()])
        ).alias("features"),
    )
    deep = models.tree({"max_depth": 5, "min_samples_leaf": 1}, 0, merged=False).fit(patients)
    nodes = SavedTrees(spark, deep).trees[0].rows
    root = nodes[0]
    rows = []
    if root["leftChild"] >= 0:
        left, right = nodes[root["leftChild"]], nodes[root["rightChild"]]
        rows.append((
            list(STEPS)[root["split"]["featureIndex"]],
            float(root["split"]["leftCategoriesOrThreshold"][0]),
            round(float(root["gain"]), 6),
            left["rawCount"], round(left["impurityStats"][1]),
            right["rawCount"], round(right["impurityStats"][1]),
        ))
    return spark.createDataFrame(
        rows,
        "feature string, threshold double, gain double, "
        "left_rows long, left_cases long, right_rows long, right_cases long",
    )


def kernel_equal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients of one age and sex, and how many different kernel features they get."""
    patients = tables.patients(spark, sf_dir).select(
        "age", "sex", array_to_vector(F.array(F.col("age") * 1.0, F.col("sex") * 1.0)).alias("features")
    )
    mapped = Nystrom(size=32).fit(patients).transform(patients)
    return mapped.groupBy("age", "sex").agg(
        F.count(F.lit(1)).alias("patients"),
        F.count_distinct(vector_to_array("kernel_features")).alias("different"),
    )


def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out patients, and whether a model scores them alike after it was stored and loaded."""
    trained = start(spark, sf_dir)
    model = scorer(trained.train, models.logistic({"C": 1}, 0).fit(trained.train.rows))
    folder = scratch_path(spark, "models")
    stores.save_model(model, folder, models.LOGISTIC.name)
    loaded = stores.load_model(folder, models.LOGISTIC.name)
    before = model.transform(trained.test).select("id", probability("probability").alias("p"))
    after = loaded.transform(trained.test).select(
        F.col("id").alias("patient_id"), probability("probability").alias("q")
    )
    return before.join(after, F.col("id") == F.col("patient_id")).select(
        "patient_id", (F.col("p") == F.col("q")).alias("same_probability")
    )


def voting_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out patients, with the vote set against the mean of its members."""
    trained = start(spark, sf_dir)
    bases = searched(trained)
    vote = soft_vote(trained.train, bases)
    by_members = vote.transform(trained.test)
    mean = sum(probability(f"{base.name}_probability") for base in bases) / len(bases)
    by_members = materialize(
        by_members.select(F.col("id").alias("_id"), mean.alias("_mean")), "members"
    )
    held_out = finish(trained, "voting_classifier", vote)
    scored = materialize(
        vote.transform(trained.test).select(
            F.col("id").alias("_id"),
            probability("probability").alias("_vote"),
            F.col("prediction").alias("_class"),
        ),
        "votes",
    ).join(by_members, "_id")
    facts = scored.select(
        "_id",
        (F.abs(F.col("_vote") - F.col("_mean")) < CLOSE).alias("vote_is_mean"),
        (F.col("_class") == (F.col("_mean") > 0.5).cast("int")).alias("class_is_majority"),
    )
    return held_out.join(facts, F.col("patient_id") == F.col("_id")).drop("_id")


def stacking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out patients, and training patients with the fold their scorers had not seen."""
    trained = start(spark, sf_dir)
    bases = searched(trained)
    scores = [f"{base.name}_probability" for base in bases]
    columns = ("id", models.LABEL, models.WEIGHT, "left_out", *scores)
    unseen = materialize(unseen_scores(trained.train, bases).select(*columns), "scores")
    between = F.lit(True)
    for score in scores:
        between = between & probability(score).between(0, 1)
    training = materialize(
        unseen.groupBy(F.col("id").alias("patient_id"), F.col("target").cast("int").alias("target"))
        .agg(
            F.count(F.lit(1)).alias("times_scored"),
            F.max("left_out").alias("left_out"),
            F.bool_and(between).alias("probability_in_range"),
        ),
        "unseen",
    )
    held_out = finish(trained, "stacking_classifier", fit_stacking(trained.train, bases, unseen))
    columns = ("patient_id", "target", "times_scored", "left_out", "probability_in_range")
    nothing = F.lit(None).cast("int")
    return training.select(*columns).union(
        held_out.withColumns({"times_scored": F.lit(0).cast("long"), "left_out": nothing}).select(
            *columns
        )
    )


def svm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = start(spark, sf_dir)
    _, model = fit_svm(trained.train)
    # The class is the side of the margin, which the calibrated probability may round away.
    return finish(trained, models.SVM.name, model).drop("class_follows_probability")


def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the searched forest: importances of 0 to 1 that add up, ranked without gaps."""
    trained = start(spark, sf_dir)
    found = grid_search(trained.train, models.FOREST)
    listed = importances(spark, found.model, trained.train.columns)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    ranked = listed.withColumn("place", place)
    whole = Window.partitionBy()
    return ranked.select(
        "feature",
        F.col("importance").between(0, 1).alias("in_range"),
        F.round(F.sum("importance").over(whole), 6).alias("total"),
        F.sum("place").over(whole).cast("long").alias("sum_of_places"),
        F.lit(found.model.getNumTrees == found.params["n_estimators"]).alias("trees_as_chosen"),
    )


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid search of the tree, measured on the held-out rows."""
    trained = start(spark, sf_dir)
    found = grid_search(trained.train, models.TREE)
    trained.add(scorer(trained.train, found.model), found)
    measured = metrics_rows(trained, materialize(score_all(trained, RUN), "scored"), RUN)
    tn, fp, fn, tp = (F.col("confusion_matrix")[i][j] for i in (0, 1) for j in (0, 1))
    return measured.select(
        "model_name",
        (tn + fp + fn + tp).cast("long").alias("held_out"),
        (fn + tp).cast("long").alias("positives"),
        (F.abs(F.col("accuracy") - (tp + tn) / (tn + fp + fn + tp)) < CLOSE).alias("accuracy_fits"),
        F.col("cv_precision_mean").between(0, 1).alias("cv_in_range"),
        F.lit(found.params in models.TREE.candidates()).alias("chosen_from_grid"),
    )


QUERIES = {
    "train_lr_score": train_lr_score,
    "logistic_coefficients": logistic_coefficients,
    "tree_root": tree_root,
    "kernel_equal_rows": kernel_equal_rows,
    "model_store": model_store,
    "search_metrics": search_metrics,
    "forest_importance": forest_importance,
    "voting_score": voting_score,
    "stacking_score": stacking_score,
    "svm_score": svm_score,
}
