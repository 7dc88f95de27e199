"""Walk-forward runs with the caller's own labels, model and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize


def walk_forward(
    rows: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    fit: Callable[[DataFrame], Any],
    score: Callable[[Any, DataFrame], DataFrame],
    evaluate: Callable[[DataFrame], DataFrame],
    fold: str = "window",
    least: int = 1,
    together: int = 4,
) -> DataFrame:
    """``fold`` and the columns of ``evaluate`` for every window that has at least ``least`` windows before it.

    ``label`` adds the target to the rows, once for all folds; the result is
    stored.  For each fold ``fit`` gets the labelled rows of all earlier
    windows, ``score`` its model and the rows of the window, ``evaluate`` what
    ``score`` returns.  Up to ``together`` folds run side by side, which keeps
    the cluster busy while a fit waits for its last tasks.  Only the window
    numbers reach the driver; null windows belong to no fold.
    """
    stored = materialize(label(rows).filter(F.col(fold).isNotNull()))
    folds = [r[0] for r in stored.select(fold).distinct().orderBy(fold).collect()][least:]
    if not folds:
        empty = evaluate(score(fit(stored), stored.limit(0))).limit(0)
        return empty.select(F.lit(None).cast(stored.schema[fold].dataType).alias(fold), *empty.columns)

    def run(f: Any) -> DataFrame:
        model = fit(stored.filter(F.col(fold) < f))
        found = evaluate(score(model, stored.filter(F.col(fold) == f)))
        return materialize(found.select(F.lit(f).cast(stored.schema[fold].dataType).alias(fold), *found.columns))

    with ThreadPoolExecutor(together) as pool:
        done = list(pool.map(inheritable_thread_target(stored.sparkSession)(run), folds))
    return reduce(DataFrame.unionByName, done)
