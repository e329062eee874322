"""Forward-looking labels over the ordered window of a block (see ``series.rolling`` with rows ahead)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def future_return(price: str, horizon: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(price, horizon).over(w), F.col(price)) - 1


def direction(ret: str, threshold: float = 0.0) -> Column:
    r = F.col(ret)
    return F.when(r.isNotNull(), F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0))


def triple_barrier(price: str, high: str, low: str, horizon: int, up: float, down: float, w: WindowSpec) -> Column:
    """struct(label, held): 1 or -1 by the first of the next ``horizon`` bars that reaches a barrier (the upper one counts if
    both do), 0 if none does; null without ``horizon`` bars ahead."""
    ahead = F.collect_list(F.struct(F.col(high).alias("h"), F.col(low).alias("l"))).over(w.rowsBetween(1, horizon))
    hit = F.transform(
        ahead,
        lambda b, i: F.struct(
            F.when(b["h"] >= F.col(price) * (1 + up), 1).when(b["l"] <= F.col(price) * (1 - down), -1).otherwise(0).alias("label"), (i + 1).alias("held")
        ),
    )
    first = F.get(F.filter(hit, lambda x: x["label"] != 0), F.lit(0))
    return F.when(F.size(ahead) == horizon, F.coalesce(first, F.struct(F.lit(0).alias("label"), F.lit(horizon).alias("held"))))
