"""Exact token counts from a length histogram.

Documents are encoded whole and counted by encoded length. The histogram is as long as there are
different lengths, not documents. Its suffix sums give, for every context limit, how many documents
reach it, their tokens, and the tokens that are left when each document is cut at the limit.

The histogram has a row for each length, and a window over all its rows runs in one task: a text of ``c``
characters has at most ``4 * c`` tokens, so that task's rows don't grow with the number of documents.

Edge cases: a null text has length 0, as an empty one. Repeated rows count each. An empty table
has an empty histogram. Special tokens' strings are ordinary text. Whole texts are encoded, however long:
a run of blanks over ``LONG_RUN`` characters, on which the encoder's pattern would run out of stack, is cut
out where the pattern cuts it, and encoded as the one piece that it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.batches import sliced

# Fixed value: how this vocabulary's encoder cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The characters that the pattern takes for blanks.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1000
_LONG = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}")


@cache
def _encoder(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoder: tiktoken.Encoding, text: str) -> int:
    """The number of tokens of a whole text.

    The pattern takes a run of blanks as one piece, but for its last one if other text follows, which
    goes on with that text.
    """
    n = at = 0
    for run in _LONG.finditer(text):
        stop = run.end() - (run.end() < len(text))
        n += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : stop]))
        at = stop
    return n + len(encoder.encode_ordinary(text[at:]))


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text. The vocabulary's file is broadcast."""
    out = docs.drop(name)
    names = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField(name, T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        for batch in sliced(batches):
            lengths = [encoded_length(encoder, t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(lengths, pa.int64())], names=[*names, name])

    return out.mapInArrow(count, schema)


def length_histogram(docs: DataFrame, text: str = "text", **more) -> DataFrame:
    """``n_tokens`` and ``n_docs``."""
    return encoded_lengths(docs.select(text), text, **more).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_totals(histogram: DataFrame) -> DataFrame:
    """The histogram with what each length answers as a limit.

    ``docs_reaching`` and ``tokens_reaching`` are of documents of that length or more;
    ``truncated_total`` is all tokens when documents are cut at it; ``quantile`` is the share of
    documents of that length or less. The window is over lengths, not documents.
    """
    up, down = Window.orderBy("n_tokens"), Window.orderBy(F.desc("n_tokens"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = histogram.select("n_tokens", "n_docs", F.sum("n_docs").over(down).alias("docs_reaching"), F.sum(tokens).over(down).alias("tokens_reaching"), F.sum("n_docs").over(up).alias("to_here"), F.sum(tokens).over(up).alias("tokens_to_here"))
    cut = F.col("tokens_to_here") + F.col("n_tokens") * (F.col("docs_reaching") - F.col("n_docs"))
    return out.select("n_tokens", "n_docs", "docs_reaching", "tokens_reaching", cut.alias("truncated_total"), (F.col("to_here") / (F.col("to_here") + F.col("docs_reaching") - F.col("n_docs"))).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit``, ``docs_over``, ``truncated_total`` and ``lost`` for any limits."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in sorted(set(limits))], "`limit` bigint")
    sums = histogram.join(F.broadcast(asked)).groupBy("limit").agg(F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"), F.sum(F.greatest(F.col("n_tokens") - F.col("limit"), F.lit(0)) * F.col("n_docs")).alias("lost"))
    return asked.join(sums, "limit", "left").na.fill(0)
