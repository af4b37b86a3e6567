import os
from collections import Counter

import pytest

import corpus_pipeline
from riskframe.llm import pieces, queries

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="no tokenizer file")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    return str(path)


def test_stages_hand_on_whole_documents(spark, folder, awkward):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, table, folder), name)
        assert after.columns == columns, name
        if name == "near_duplicates":
            texts = Counter(r.text or "" for r in after.collect())
            # Texts without words are alike, and so are copies and repeated rows.
            assert max(n for t, n in texts.items() if t.strip()) == 1
            assert sum(n for t, n in texts.items() if not t.strip()) == 1
            assert {r.text for r in after.collect() if r.text and r.text.strip()} <= {t for _, t, _ in awkward}
        if name == "mixing":
            assert {r.text for r in after.collect()} == {r.text for r in table.collect()}
        table = after
    last = corpus_pipeline.STAGES[-1][1](spark, table, folder)
    assert last.count() == table.count()


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.round_trip and r.parity for r in rows)


def test_names_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("stage", [corpus_pipeline.without_copies, corpus_pipeline.mixed])
def test_rows_keep_their_numbers_when_the_table_is_cut_otherwise(spark, tmp_path, stage):
    rows = [(i, f"text {i} of its own", "big" if i % 4 else "small") for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    after = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    # As if executors had come or gone between two jobs: files are packed into other partitions.
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        found = Counter((r.doc_id, r.text, r.source) for r in after.collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert set(found) == set(rows)
    assert all(n == 1 for row, n in found.items() if stage is not corpus_pipeline.mixed or row[2] == "big")
