"""Documents with everything that may be awkward about them."""

import pytest
from awkward import CLASHING, awkward_rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, awkward):
    names = "doc_id long, text string, lang string, source string, n_chars long, "
    names += ", ".join(f"`{name}` string" for name in CLASHING)
    rows = [
        (i, text, None if i is None or i % 5 == 0 else "en", source, None, *CLASHING)
        for i, text, source in awkward
    ]
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
