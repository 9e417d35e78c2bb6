"""Keeps views up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.views import Views


def feed(views: Views, name: str, source: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Each micro-batch adds its partial states under its own number: a batch that runs twice replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        views.apply(name, batch, f"stream-{number:012d}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
