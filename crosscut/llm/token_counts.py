"""Token counts by rank-synchronous array merging.

A slice of texts is cut into chunks; its distinct pre-tokens form one ragged numpy array, on which all
pre-tokens apply their lowest-rank pair simultaneously, round by round (bpe.Bpe.merge). A pre-token's count is the number
of surviving symbols; chunks and texts add them up.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of added tokens inside a text count as one token,
as the library's default is; very long pre-tokens merge like any other; repeated rows, null ids and extra columns pass
through, and an input column named like a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, Bpe
from .common import documents, map_texts, worker_kernel
from .token_files import tokenizer_path

LIMIT = 512
#: Bytes counted at once: what a task holds beside its Arrow batch is some hundred times this at most.
SLICE_BYTES = 1_000_000


class Counter:
    """Numbers of tokens of a slice of texts; every distinct pre-token of the slice is merged once."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        chunks, word, offsets = self.bpe.numbered(texts)
        cut = [[] if isinstance(c, int) else self.bpe.pieces(c) for c in chunks]
        pieces = list(set(itertools.chain.from_iterable(cut)))
        _, n = self.bpe.merge([p.encode() for p in pieces])
        count = dict(zip(pieces, n.tolist())).__getitem__
        each = np.array([1 if isinstance(c, int) else sum(map(count, p)) for c, p in zip(chunks, cut)], np.int64)
        return np.diff(np.concatenate([[0], np.cumsum(each[word])])[offsets])


def worker_counter(path: str) -> Counter:
    """This worker's counter: the vocabulary is read once, whatever number of tasks the worker runs."""
    return worker_kernel(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (boolean)."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]

    def make():
        counter = worker_counter(tokenizer)
        return lambda texts: {"n_tokens": counter(texts)}

    counted = map_texts(docs.withColumn("n_bytes", F.octet_length(F.coalesce(text, F.lit(""))).cast("long")), make, "n_tokens long", [*keep, "n_bytes"], text, SLICE_BYTES, arrow=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
