"""Exact quantiles of columns of any size in two scans.

The first scan makes a mergeable sketch of each column (``percentile_approx``),
whose answers are off by one rank in ``ACCURACY`` at most. That gives every
wanted quantile a window which holds its exact value and little else, whatever
the distribution. The second scan counts the values below and at the ends of
each window, and keeps the few that lie inside. The exact rank is found among
those. Columns of few rows take one exact aggregate as their second scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import quantile_label
from riskframe.session import materialize

#: Ranks of a sketch: its answers are off by rows / ACCURACY at most.
ACCURACY = 10_000
#: So many values may be held by one task, and so many are gathered by one, about.
DIRECT_ROWS = 1_000_000
GATHERED = 200_000


def _number(name: str) -> Column:
    col = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(col), col)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation; nulls and NaN are skipped.

    Infinite values count as the lowest and highest. Between two values of which
    one is infinite the quantile is that one. A column without values has none.
    ``df`` is read twice, so it should be a stored table.
    """
    facts = _sketched(df, cols, probs, accuracy)
    out: dict[str, list[float | None]] = {name: [None] * len(probs) for name in cols}
    few = [c for c in cols if 0 < facts[c]["n"] <= direct_rows and facts[c]["finite"]]
    if few:
        wanted = F.array(*[F.lit(float(prob)) for prob in probs])
        row = df.agg(*[F.percentile(_number(c), wanted).alias(c) for c in few]).first()
        out.update(row.asDict())
    many = [c for c in cols if facts[c]["n"] and c not in few]
    if many:
        ranks = {}
        for c in many:
            places = [prob * (facts[c]["n"] - 1) for prob in probs]
            ranks[c] = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
        values = _at_ranks(df, facts, ranks, accuracy, direct_rows)
        for c in many:
            out[c] = [_between(values[c], prob * (facts[c]["n"] - 1)) for prob in probs]
    return out


def quantile_bins(
    df: DataFrame, col: str, name: str, labels: Sequence[str], on_duplicate_edges: str = "collapse"
) -> DataFrame:
    """Add a label column that cuts ``col`` into equally filled, right-closed bins."""
    probs = [i / len(labels) for i in range(len(labels) + 1)]
    edges = exact_quantiles(df, [col], probs)[col]
    column = F.array(*[F.lit(edge).cast("double") for edge in edges])
    return df.withColumn(name, quantile_label(F.col(col), column, labels, on_duplicate_edges))


def _between(values: dict[int, float], place: float) -> float:
    low, high = values[math.floor(place)], values[math.ceil(place)]
    share = place - math.floor(place)
    if share == 0 or low == high:
        return low
    if math.isinf(low) or math.isinf(high):
        return high if math.isinf(high) else low
    return low * (1 - share) + high * share


def _sketched(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int
) -> dict[str, dict]:
    """Number of values of each column, whether all are finite, and a window for each of
    ``probs``: values on either side of the exact quantile."""
    margin = 3.0 / accuracy
    ends = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-margin, margin)]
    asked = F.array(*[F.lit(end) for end in ends])
    row = df.agg(
        *[
            F.struct(
                F.count(_number(c)).alias("n"),
                F.coalesce(F.max(F.abs(_number(c))) < math.inf, F.lit(True)).alias("finite"),
                F.percentile_approx(_number(c), asked, accuracy).alias("ends"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    ).first()
    out = {}
    for i, c in enumerate(cols):
        fact = row[f"c{i}"]
        windows = []
        if fact["n"]:
            windows = [(fact["ends"][2 * j], fact["ends"][2 * j + 1]) for j in range(len(probs))]
        out[c] = {"n": fact["n"], "finite": fact["finite"], "windows": windows}
    return out


def _at_ranks(
    df: DataFrame,
    facts: dict[str, dict],
    ranks: dict[str, list[int]],
    accuracy: int,
    direct_rows: int,
) -> dict[str, dict[int, float]]:
    """The values at ``ranks`` (from 0) of each column.

    One aggregate counts the rows and gathers the values inside. Of n values a window
    keeps 6 n / ``accuracy`` or so, the ends apart, which may be frequent and are
    only counted; so many parts gather them that none holds many.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    todo = {c: set(r) for c, r in ranks.items()}
    windows = {c: sorted(set(facts[c]["windows"])) for c in ranks}
    share = 6 / accuracy
    while any(todo.values()):
        spans = [(c, low, high) for c in todo if todo[c] for low, high in windows[c]]
        most = max(facts[c]["n"] for c in todo)
        counts, inside = _counted(df, spans, math.ceil(most * share * len(spans) / GATHERED))
        sizes = {i: counts[f"size{i}"] for i in range(len(spans))}
        inner: dict[int, list[int]] = {}
        for i, (c, low, high) in enumerate(spans):
            below, at_low, at_high = (counts[f"{k}{i}"] for k in ("below", "low", "high"))
            first = below + at_low
            for rank in list(todo[c]):
                if below <= rank < first:
                    found[c][rank] = low
                elif first <= rank < first + sizes[i]:
                    inner.setdefault(i, []).append(rank)
                elif first + sizes[i] <= rank < first + sizes[i] + at_high:
                    found[c][rank] = high
                else:
                    continue
                todo[c].discard(rank)
        for i, (c, _, _) in enumerate(spans):
            if i in inner:
                offset = counts[f"below{i}"] + counts[f"low{i}"]
                own = inside.select(F.explode(f"in{i}").alias("x"))
                chosen = sorted(set(inner[i]))
                values = _selected(
                    own, sizes[i], [r - offset for r in chosen], accuracy, direct_rows
                )
                found[c].update(zip(chosen, values, strict=True))
        # A rank outside all its windows, as of a few rows that ranks are far apart for: look
        # through all values.
        windows, share = {c: [(-math.inf, math.inf)] for c in todo}, 1.0
    return found


def _counted(
    df: DataFrame, spans: list[tuple[str, float, float]], parts: int
) -> tuple[dict, DataFrame]:
    """Values below, at the lower end, at the upper end and inside of each span; and the values
    inside as lists ``in0``, ``in1`` and so on, in ``parts`` rows."""
    cells = []
    for i, (c, low, high) in enumerate(spans):
        x = _number(c)
        hit = F.when((x > low) & (x < high), x)
        cells += [
            F.count_if(x < low).alias(f"below{i}"),
            F.count_if(x == low).alias(f"low{i}"),
            F.count_if((x == high) & (F.lit(low) < high)).alias(f"high{i}"),
            F.count(hit).alias(f"size{i}"),
            F.collect_list(hit).alias(f"in{i}"),
        ]
    names = sorted({c for c, _, _ in spans})
    own = df.select(
        *[F.col(f"`{c}`") for c in names],
        F.pmod(F.spark_partition_id(), F.lit(max(1, parts))).alias("_part"),
    )
    gathered = materialize(own.groupBy("_part").agg(*cells), "inside")
    sums = [c for c in gathered.columns if c != "_part" and not c.startswith("in")]
    counts = gathered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    return counts.asDict(), gathered


def _selected(
    values: DataFrame, n: int, ranks: list[int], accuracy: int, direct_rows: int
) -> list[float]:
    """The values at ``ranks`` of the one column ``x`` of ``n`` values, all of them numbers."""
    if n <= direct_rows:
        ordered = values.agg(F.sort_array(F.collect_list("x")).alias("all"))
        row = ordered.select(*[F.get("all", F.lit(r)).alias(f"r{i}") for i, r in enumerate(ranks)])
        return list(row.first())
    probs = [r / (n - 1) for r in ranks]
    facts = _sketched(values, ["x"], probs, accuracy)
    found = _at_ranks(values, facts, {"x": ranks}, accuracy, direct_rows)["x"]
    return [found[r] for r in ranks]
