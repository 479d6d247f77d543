"""Checks of a stream: each micro-batch is profiled and held against a contract.

The batch engine has no stream operators to match; this runs the same check inside foreachBatch, so a contract of a table
serves the stream that feeds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..contract.check import check
from ..contract.findings import Report
from ..contract.model import Contract
from ..operators.profile import ProfileOptions, profile


def monitor(stream: DataFrame, table: str, contract: Contract, on_report: Callable[[int, Report], None], checkpoint: str, options: ProfileOptions | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts a query that calls on_report(batch, report) for each micro-batch that has rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            p = profile(batch, table, options=options)
            if p.row_count:
                on_report(number, check(p, contract))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
