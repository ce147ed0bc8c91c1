"""Driver loops over DataFrames: each round is one job whose result is cut from its lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sparkloom.session import dropped, stored


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame], bool], most: int) -> DataFrame:
    """``state`` after rounds of ``step`` until ``done(after)`` or ``most`` rounds.

    A step that must compare a row with its last value carries that along, so that the test is a scan of the stored rows.
    """
    state = stored(state)
    for k in range(1, most + 1):
        after = stored(step(state, k))
        stop = done(after)
        dropped(state.sparkSession, [state])
        state = after
        if stop:
            break
    return state
