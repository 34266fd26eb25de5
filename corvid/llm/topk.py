"""Exact top-k search by inner product over whole numbers.

Vectors are sorted by descending length and cut into bands, which are searched in waves, each of twice as
many bands as the one before. A query goes on to a wave only if the longest vector there could still reach
its threshold: its k-th best score so far, at first over a few of the longest vectors. Queries that go on
are dealt into as few shards as hold them, and vectors are copied to those shards only. After each wave a
query keeps its best k. Within a band, vectors come longest first; queries and vectors are rotated so that
the first coordinates hold most of the energy, and a pair goes on from its partial sum over those
only if the partial sum and, by Cauchy-Schwarz, the product of both residual lengths reach the
threshold. What is left is scored exactly.

The rotation is fitted on a bounded sample; any rotation gives the same results.

Edge cases: vectors that are null or have null or non-finite components take no part, nor do rows
without an id. Vectors of different lengths are padded with zeros. Repeated rows are vectors of
their own: a row isn't its own candidate, but another row with its id is. Components and scores
beyond 64 bits saturate. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.storage import stored

_FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, values (floor of ``scale`` times each component), norm and an own ``row``."""
    x = F.col(embedding).cast("array<double>")
    sound = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    values = F.transform(x, lambda v: F.floor(v * scale))
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.where(sound).select(F.col(vec_id).cast("bigint").alias("vec_id"), values.alias("values")).select("vec_id", "values", norm.alias("norm"), F.monotonically_increasing_id().alias("row"))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products as whole numbers; doubles hold sums below 2**53 exactly."""
    reach = np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0)
    if reach < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([max(low, min(high, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


def _best(pool: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, score, id) the best ``k`` of each query, in order."""
    query, score, ids = pool
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], score[keep], ids[keep]


def search_band(queries: pd.DataFrame, band: pd.DataFrame, turn: np.ndarray, head: int, k: int, chunk: int = 1024) -> pd.DataFrame:
    """The best ``k`` of a band for each query that they can matter to."""
    width = len(turn)
    band = band.sort_values(["norm", "row"], ascending=[False, True])
    q, c = _matrix(queries["values"], width), _matrix(band["values"], width)
    q_norm, c_norm = queries["norm"].to_numpy(), band["norm"].to_numpy()
    q_turned, c_turned = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (q_turned, c_turned))
    q_row, c_row, c_id = queries["row"].to_numpy(), band["row"].to_numpy(), band["vec_id"].to_numpy()
    least = queries["least"].to_numpy(float, na_value=-math.inf)
    pool: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
    for at in range(0, len(c), chunk):
        part = slice(at, at + chunk)
        slack = 1e-9 * (q_norm * c_norm[at] + 1)
        live = np.flatnonzero(q_norm * c_norm[at] >= least - slack)
        if not len(live):
            break
        bound = q_turned[live, :head] @ c_turned[part, :head].T + q_rest[live, None] * c_rest[None, part]
        i, j = np.nonzero(bound >= (least - slack)[live, None])
        i, j = live[i], j + at
        other = q_row[i] != c_row[j]
        i, j = i[other], j[other]
        for s in range(0, len(i), 200_000):
            a, b = i[s : s + 200_000], j[s : s + 200_000]
            score = _exact(q[a], c[b])
            good = score >= least[a]
            pool = _best(tuple(np.concatenate(x) for x in zip(pool, (a[good], score[good], c_id[b[good]]), strict=True)), k)
            full = np.flatnonzero(np.bincount(pool[0], minlength=len(q)) == k)
            ends = np.searchsorted(pool[0], full, side="right") - 1
            least[full] = np.maximum(least[full], pool[1][ends])
    return pd.DataFrame({"query_row": q_row[pool[0]], "query_id": queries["vec_id"].to_numpy()[pool[0]], "vec_id": pool[2], "score": pool[1]})


def _rotation(sample: list[list[int]], width: int) -> tuple[np.ndarray, int]:
    """Right singular vectors, and how many hold four fifths of the energy."""
    held = _matrix(pd.Series(sample, dtype=object), width)
    _, s, turn = np.linalg.svd(held if len(held) >= width else np.vstack([held, np.eye(width) * 1e-9]), full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    return turn.T, int(min(width, max(1, np.searchsorted(share, 0.8) + 1)))


def _best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, band: int = 8192, shard: int = 1024, sample: int = 4096, seeds: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best other rows for each query row.

    Bands are ``band`` vectors and queries are dealt out by ``shard``; a task holds one of each. All that is
    broadcast are the rotation and the ``seeds``; the driver learns one length for each wave.
    """
    spark = vectors.sparkSession
    table = stored(whole_numbers(vectors, vec_id, embedding, scale), "vectors")
    n, width = table.agg(F.count("*"), F.max(F.size("values"))).first()
    width = max(width or 0, 1)
    turn, head = _rotation([r["values"] for r in table.orderBy(F.xxhash64("row"), "row").select("values").limit(sample).collect()], width)

    cuts = max(1, -(-n // band))
    bands = stored(table.repartitionByRange(cuts, F.desc("norm"), F.col("row")).withColumn("band", F.spark_partition_id()), "bands")
    last = bands.agg(F.max("band")).first()[0]
    seed = spark.sparkContext.broadcast(table.orderBy(F.desc("norm"), "row").limit(seeds).toPandas())

    def start(batches):
        held = seed.value
        c = _matrix(held["values"], width)
        for batch in batches:
            scores = _matrix(batch["values"], width) @ c.T
            scores[batch["row"].to_numpy()[:, None] == held["row"].to_numpy()[None, :]] = -math.inf
            best = np.sort(scores, axis=1)[:, -k] if len(held) > k else np.full(len(batch), -math.inf)
            # Doubles may round sums from 2**53; a slightly lower threshold is as right.
            yield batch.assign(least=np.where(np.isfinite(best), best - np.abs(best) * 1e-12, None))

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "score")})
        return search_band(queries, held, turn, head, k)

    asked = stored(table.where(is_query).mapInPandas(start, "vec_id bigint, `values` array<bigint>, norm double, row bigint, least double"), "asked")
    best, low, waves = None, 0, 1
    while last is not None and low <= last:
        high = min(low + waves, last + 1)
        longest = bands.where(F.col("band") >= low).agg(F.max("norm")).first()[0]
        least = asked
        if best is not None:
            kth = best.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
            least = asked.join(kth.select(F.col("query_row").alias("row"), "kth"), "row", "left").withColumn("least", F.greatest("least", F.col("kth") - F.abs("kth") * 1e-12)).drop("kth")
        going = least.where(F.col("least").isNull() | (F.lit(longest) * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("least")))
        count = going.count()
        if not count:
            break
        shards = -(-count // shard)
        each = F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
        sides = going.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn("band", each).groupBy("band", "shard")
        copies = bands.where(F.col("band").between(low, high - 1)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
        found = sides.cogroup(copies.groupBy("band", "shard")).applyInPandas(search, _FOUND)
        best = stored(_best_of(found if best is None else found.unionByName(best.select("query_row", "query_id", "vec_id", "score")), k), "best")
        low, waves = high, 2 * waves
    if best is None:
        return spark.range(0).selectExpr("id AS query_id", "CAST(id AS int) AS rank", "id AS vec_id", "id AS score")
    return best.select("query_id", "rank", "vec_id", "score")
