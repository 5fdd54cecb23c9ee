"""Whole texts to token ids and back, inside Spark tasks (the method is in bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.bpe import encoder
from faultline.llm.common import slices


def encoded(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string): ids as little-endian unsigned 32-bit integers.

    A null text is empty and gives no ids; repeated rows and keys are encoded each for itself; other columns
    are left out, so their names don't matter. No row is longer than its text, and no rows are moved.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in slices(batches, "t"):
            ids, ends = e.encode(b.column(1))
            rows = [ids[a:z] for a, z in zip(ends, ends[1:])]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()),
                    pa.array([e.decode(r) for r in rows], pa.string()),
                ],
                ["k", "ids", "decoded"],
            )

    return (
        docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t")
        .mapInArrow(run, f"k {kind}, ids binary, decoded string")
        .withColumnRenamed("k", key)
    )


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with hashes in place of ids and decoded text, which then needn't leave the task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches, "t"):
            ids, ends = e.encode(b.column(1))
            rows = [ids[a:z] for a, z in zip(ends, ends[1:])]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([sha(r.astype("<u4").tobytes()) for r in rows], pa.string()),
                    pa.array([sha(e.decode(r).encode()) for r in rows], pa.string()),
                ],
                ["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return (
        docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t")
        .mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("k", key)
    )
