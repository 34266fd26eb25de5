"""What changes from one version of a document to the next."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[A-Za-z]+")
_ROWS = 20_000


def token_changes(versions: DataFrame) -> DataFrame:
    """conv_id, turn, token and delta: by how much a token's count differs from that in the version before (``turn`` less 1), if there is one.

    ``versions`` has conv_id, turn (long) and text; rows of equal keys are one version. Each text goes to its own version and to
    the next, and versions stream through sorted: a task holds the counts of one version at a time, and no token is shuffled.
    """
    own = F.struct("turn", F.lit(1).alias("sign"))
    onward = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct((F.col("turn") + 1).alias("turn"), F.lit(-1).alias("sign")))
    dealt = versions.select("conv_id", F.explode(F.filter(F.array(own, onward), lambda x: x.isNotNull())).alias("x"), "text").select("conv_id", "x.turn", "x.sign", "text")
    # Its own texts come first, so that a version that isn't there is passed over.
    ready = dealt.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", F.desc("sign"))
    key = versions.schema["conv_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, out, types = None, None, ([], [], [], []), None

        def close() -> None:
            if counts:
                changed = [(token, n) for token, n in counts.items() if n]
                for column, value in zip(out, (*([v] * len(changed) for v in at), [t for t, _ in changed], [n for _, n in changed]), strict=True):
                    column.extend(value)

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*types, pa.string(), pa.int64()), strict=True)], names=["conv_id", "turn", "token", "delta"])
            for column in out:
                column.clear()
            return done

        for some in batches:
            types = (some.schema.types[0], some.schema.types[1])
            for conv, turn, sign, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if (conv, turn) != at:
                    close()
                    at, counts = (conv, turn), Counter() if sign > 0 else None
                if counts is not None and text:
                    if sign > 0:
                        counts.update(_TOKEN.findall(text))
                    else:
                        counts.subtract(_TOKEN.findall(text))
                if len(out[0]) >= _ROWS:
                    yield batch()
        close()
        if types is not None:
            yield batch()

    return ready.mapInArrow(rows, f"conv_id {key}, turn long, token string, delta long")
