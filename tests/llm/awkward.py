"""Rows with everything that may be awkward about documents."""

import random

# Extra columns, named like columns that operators use inside.
CLASHING = (
    "score", "fingerprint", "component_id", "component", "node", "row", "kept", "shard", "slot",
    "run", "lot", "order", "pass", "block", "fraction", "word", "n", "ids", "size", "_row", "_id",
)


def awkward_rows(seed=1, number=60):
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, repeats."""
    random.seed(seed)
    words = ["alpha", "Beta", "gamma,", "ÄÖ", "niño", "日本", "x", "the", "of", "licence"]
    rows = []
    for i in range(number):
        text = " ".join(random.choice(words) + str(random.randint(0, 30)) for _ in range(random.randint(1, 60)))
        rows.append((i * 3, text, random.choice(["a", "a", "b", None])))
    rows += [(200 + i, rows[5][1], "a") for i in range(7)]
    rows += [(220 + i, rows[6][1] + f" tail{i % 2}", "b") for i in range(4)]
    rows += [(230, None, "a"), (231, "", "b"), (232, " \t\n", "c"), (233, "one", "c"), (234, "one two", None)]
    rows += [(None, "no id here at all", "a"), (None, None, None)]
    rows += [(240, "word " * 20_000, "long"), (241, "repeated row", "b"), (241, "repeated row", "b")]
    rows += [(242, "same id, one text", "b"), (242, "same id, another text", "a")]
    return rows
