"""Tables in periods: a run replaces the periods it touches and leaves the others' files alone.

    awards/run=3/period=24290/…    what run 3 wrote of that period
    counts/run=3/period=24290/…    and what belongs to it
    done/run=3/period=24290/…      written last: run 3 is whole, and this period's newest state is its own

A period that a run names as done but wrote no row of is empty.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.session import delete_folder
from tenderlens.sources.segments import folder_names

PERIOD = "period"
DONE = "done"
NO_DATE = -(1 << 31)


def month_of(moment: str) -> Column:
    """Months since year 0; a missing date has a period before all others, as it comes first in any order."""
    when = F.col(moment).cast("timestamp")
    return F.coalesce(F.year(when) * 12 + F.month(when), F.lit(NO_DATE)).alias(PERIOD)


def _numbers(names: Sequence[str], prefix: str) -> list[int]:
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).lstrip("-").isdigit()]


def live_periods(spark: SparkSession, path: str) -> dict[int, int]:
    """Each period's newest whole run; names only, no data is read."""
    live: dict[int, int] = {}
    for run in sorted(_numbers(folder_names(spark, f"{path}/{DONE}"), "run=")):
        inside = folder_names(spark, f"{path}/{DONE}/run={run}")
        if "_SUCCESS" in inside:
            live.update(dict.fromkeys(_numbers(inside, f"{PERIOD}="), run))
    return live


def next_run(spark: SparkSession, path: str, parts: Sequence[str]) -> int:
    """A number above all in use, those of failed runs included."""
    return 1 + max((n for part in (*parts, DONE) for n in _numbers(folder_names(spark, f"{path}/{part}"), "run=")), default=0)


def write_periods(rows: DataFrame, path: str, part: str, run: int) -> None:
    """``rows`` have a column ``period``. Adaptive execution gives a large period several tasks and files, and puts
    small ones together, without the second run of the plan that range bounds would take."""
    rows.hint("rebalance", F.col(PERIOD)).write.partitionBy(PERIOD).parquet(f"{path}/{part}/run={run}")


def finish_run(spark: SparkSession, path: str, run: int, periods: Sequence[int]) -> None:
    """Make the run count. One row for each period, of which there are as many as months in the data."""
    done = spark.createDataFrame([(p, True) for p in periods], f"{PERIOD} int, done boolean")
    done.coalesce(1).write.partitionBy(PERIOD).parquet(f"{path}/{DONE}/run={run}")


def read_periods(
    spark: SparkSession, path: str, part: str, live: dict[int, int], only: Collection[int] | None = None
) -> DataFrame | None:
    """The live rows of all periods, or of some; None where there are none. Only their files are opened."""
    inside = {run: set(folder_names(spark, f"{path}/{part}/run={run}")) for run in set(live.values())}
    folders = [
        f"{path}/{part}/run={run}/{PERIOD}={p}" for p, run in sorted(live.items())
        if (only is None or p in only) and f"{PERIOD}={p}" in inside[run]
    ]
    return spark.read.option("basePath", f"{path}/{part}").parquet(*folders).drop("run") if folders else None


def drop_replaced(spark: SparkSession, path: str, parts: Sequence[str], live: dict[int, int]) -> None:
    """Delete periods that a later run replaced, and what failed runs left. Call it when a run begins, so that
    readers of the state before the last run have had that long."""
    for part in parts:
        for run in _numbers(folder_names(spark, f"{path}/{part}"), "run="):
            for period in _numbers(folder_names(spark, f"{path}/{part}/run={run}"), f"{PERIOD}="):
                if live.get(period) != run:
                    delete_folder(spark, f"{path}/{part}/run={run}/{PERIOD}={period}")
