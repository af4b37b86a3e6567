"""Order of rows on disk, so that filters on either of several columns skip most of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of each column in the key.
BITS = 16


def interleaved(numbers: Sequence[Column], bits: int = BITS) -> Column:
    """One whole number whose bits are those of ``numbers`` (0 to 2 ** bits - 1) in turn.

    Rows near each other in it are near each other in every column.
    """
    parts = []
    for bit in range(bits):
        for place, number in enumerate(numbers):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long"))
            parts.append(F.shiftleft(one, bit * len(numbers) + place))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def ordered_by_all(
    df: DataFrame, keys: Sequence[Column], *ties: str, bits: int = BITS
) -> DataFrame:
    """``df`` in ranges of the interleaved ``keys``, each sorted by it.

    ``keys`` are numbers; nulls count as the lowest. Each key is cut into 2 ** bits
    equal steps between its extremes, which are found in one aggregate. Ranges
    split where many rows share a key, by ``ties``.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    numbers = df.select(*[k.cast("double").alias(n) for k, n in zip(keys, names, strict=True)])
    extremes = numbers.agg(
        *[f(n).alias(f"{n}{f.__name__}") for n in names for f in (F.min, F.max)]
    ).first()
    steps = []
    for key, name in zip(keys, names, strict=True):
        low, high = extremes[f"{name}min"], extremes[f"{name}max"]
        width = (high - low) if low is not None and high > low else 1.0
        share = (key.cast("double") - F.lit(0.0 if low is None else low)) / F.lit(width)
        step = F.floor(share * ((1 << bits) - 1))
        steps.append(F.coalesce(F.greatest(step, F.lit(0).cast("long")), F.lit(0).cast("long")))
    keyed = df.withColumn("_place", interleaved(steps, bits))
    order = ["_place", *ties]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
