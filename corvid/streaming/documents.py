"""Keyed document state over streams of edits: latest version, debounced analysis, tumbling counts.

Edits have ``uri``, ``version``, ``text`` and ``ts``. A document's version orders its edits, not their
arrival; late edits of an older version change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "uri string, version long, text string"


def latest_versions(edits: DataFrame) -> DataFrame:
    """An update for each document that a batch brings to a newer version."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        best = None
        for batch in batches:
            batch = batch.sort_values(["version", "text"], na_position="first")
            row = batch.iloc[-1]
            if (held is None or row.version > held) and (best is None or (row.version, row.text or "") > (best.version, best.text or "")):
                best = row
        if best is not None:
            state.update((int(best.version),))
            yield pd.DataFrame({"uri": [key[0]], "version": [int(best.version)], "text": [best.text]})

    return edits.select("uri", "version", "text").where("version IS NOT NULL").groupBy("uri").applyInPandasWithState(step, LATEST, "version long", "update", GroupStateTimeout.NoTimeout)


def debounced(edits: DataFrame, pause: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One analysis for each run of a document's edits with pauses below ``pause``: its newest version."""
    newest = F.max(F.struct("version", "text")).alias("newest")
    runs = edits.withWatermark("ts", late).groupBy("uri", F.session_window("ts", pause)).agg(newest, F.count("*").alias("n_edits"))
    return runs.select("uri", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "newest.version", "newest.text", "n_edits")


def unseen(edits: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Edits whose document and content haven't come within ``late`` before."""
    return edits.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["uri", "hash"])
