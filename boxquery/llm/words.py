"""The frequent part of a counted vocabulary, cut by a threshold instead of a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Steps of the count scale per doubling; a threshold is a step's lower end.
STEPS = 16


def frequent(counted: DataFrame, key: str, value: str, at_most: int, count: str = "n") -> tuple[dict, int]:
    """({key: value}, least): the rows whose count is `least` or more, at most `at_most` of them.

    A histogram of the counts, a few hundred rows, gives the threshold. A row below it makes up no more than
    1/at_most of all occurrences or so, so a later join on the key meets no hot key.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * STEPS).cast("int")
    scale = counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min(count).alias("least")).collect()
    least, rows, total = None, 0, 0
    for row in sorted(scale, key=lambda r: -r["step"]):
        rows += row["rows"]
        if rows > at_most:
            break
        least, total = row["least"], rows
    if least is None:
        return {}, 1 << 62
    kept = counted.filter(F.col(count) >= least).select(key, value).toPandas()
    assert len(kept) == total, "counts changed between two reads"
    return dict(zip(kept[key].tolist(), kept[value].tolist())), least
