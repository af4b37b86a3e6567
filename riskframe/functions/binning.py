"""Right-closed bins. ``Bucketizer`` is left-closed, so it does not fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]``; null outside all bins."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = F.when(col <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(col <= upper, label)
    return out


def quantile_label(
    col: Column,
    edges: Column,
    labels: Sequence[str],
    on_duplicate_edges: str = "collapse",
) -> Column:
    """Label by quantile edges: right-closed, lowest edge included.

    ``edges`` is an array column with one more element than there are labels.
    Where neighbouring edges are equal, 'collapse' gives the lowest label whose
    upper edge reaches the value; 'error' fails the query.
    """
    if on_duplicate_edges not in ("collapse", "error"):
        raise ValueError(on_duplicate_edges)
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    if on_duplicate_edges == "error":
        repeated = F.size(F.array_distinct(edges)) <= len(labels)
        out = out.when(repeated, F.raise_error(F.lit("quantile edges are not unique")))
    for i, label in enumerate(labels[:-1], start=1):
        out = out.when(col <= edges[i], label)
    return out.otherwise(labels[-1])
