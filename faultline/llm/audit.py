"""How five text filters act together: what each removes, alone and after any of the others, in every order.

A document becomes a 32-bit survival word: bit S is set if no filter of the subset S rejects it. Positional popcounts of
these words (carry-save adders, all parts side by side) are the survivors of every subset, for each part and label. All figures
of all 120 orders are sums and differences of those 32 counts, so documents are looked at once, not once an order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import materialize, slices
from faultline.llm.words import Words

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
FEWEST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
#: Labels counted besides all documents: (name, column of the labels table).
LABELS = ("quality", "toxic")

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*|"]] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[ord("A") : ord("Z") + 1] = True
_POINTS = np.ones(256, bool)
_POINTS[0x80:0xC0] = False
#: Word of a document that fails the filters of the index: bit S tells whether it survives the filters of S.
SURVIVES = np.array([sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)], np.uint32)


def failures(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """For each text the filters A to D it fails, as bits, and a digest of the text. Null counts as empty."""
    words = Words(texts)
    n, at = words.count, words.offsets
    distinct = np.fromiter((len(np.unique(words.key[a:z])) for a, z in zip(words.first, words.first[1:])), np.int64, len(n))

    def found(kind: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(words.data) + 1, np.int64)
        np.cumsum(kind[words.data], out=upto[1:])
        return np.diff(upto[at])

    failed = (n < FEWEST_WORDS).astype(np.int32)
    failed |= (100 * distinct < LEAST_DISTINCT_PERCENT * n).astype(np.int32) << 1
    failed |= (100 * found(_CAPITALS) > MOST_CAPITALS_PERCENT * found(_POINTS)).astype(np.int32) << 2
    failed |= (found(_MARKS) > 0).astype(np.int32) << 3
    return failed, [hashlib.sha256(words.data[a:z]).digest() for a, z in zip(at, at[1:])]


def positional(segment: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """(n, 32): how often each bit is set in the words of each segment; `segment` is sorted.

    Three words of one weight are added to a sum word and a carry word of twice the weight, in all segments at once, until a
    segment has one word of every weight left.
    """
    counts, weight = np.zeros((n, 32), np.int64), 1
    while len(words):
        carries = []
        while True:
            sizes = np.bincount(segment, minlength=n)
            if sizes.max() <= 1:
                break
            rows = -(-sizes // 3)
            ahead = np.cumsum(sizes) - sizes
            place = 3 * (np.cumsum(rows) - rows)[segment] + np.arange(len(segment)) - ahead[segment]
            grid = np.zeros(3 * rows.sum(), np.uint32)
            grid[place] = words
            a, b, c = grid.reshape(-1, 3).T
            segment = np.repeat(np.arange(n), rows)
            half = a ^ b
            carries.append((segment, (a & b) | (half & c)))
            words = half ^ c
        counts[segment] += (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64) * weight
        weight *= 2
        segment, words = (np.concatenate(x) for x in zip(*carries)) if carries else (segment[:0], words[:0])
        some = np.flatnonzero(words)
        some = some[np.argsort(segment[some], kind="stable")]
        segment, words = segment[some], words[some]
    return counts


def survivors(documents: DataFrame) -> DataFrame:
    """(part, alive map<int,long>) from rows (part, failed, quality, toxic): 32 subsets, then the same for each label.

    A task sends one count a part, label and subset for every batch of rows, whatever the size of a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0).dictionary_encode()
            code = np.asarray(parts.indices)
            order = np.argsort(code, kind="stable")
            code, word = code[order], SURVIVES[np.asarray(b.column(1))[order]]
            n = len(parts.dictionary)
            tables = [positional(code, word, n)]
            for label in (2, 3):
                has = np.asarray(b.column(label))[order]
                tables.append(positional(code[has], word[has], n))
            counts = np.concatenate(tables, axis=1)
            part, slot = np.nonzero(counts)
            yield pa.record_batch(
                [parts.dictionary.take(pa.array(part)), pa.array(slot.astype(np.int32)), pa.array(counts[part, slot])],
                ["part", "slot", "n"],
            )

    rows = documents.select("part", "failed", *LABELS).mapInArrow(run, "part string, slot int, n long")
    summed = rows.groupBy("part", "slot").agg(F.sum("n").alias("n"))
    return summed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("alive"))


def marked(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, failed, quality, toxic), one row per row of docs.

    E looks up the smallest key of equal texts by (digest, key), so rows of a text that a third of the documents share are
    spread over the tasks by their keys. Rows without a key have no smaller one and no labels, and are not joined.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            failed, digests = failures(b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(failed), pa.array(digests, pa.binary())], ["k", "part", "f", "digest"])

    given = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("t"))
    rows = materialize(given.mapInArrow(run, f"k {kind}, part string, f int, digest binary"))
    keyed = rows.where("k IS NOT NULL")
    first = keyed.groupBy("digest").agg(F.min("k").alias("k")).withColumn("first", F.lit(True))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in LABELS]
    )
    again = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    joined = keyed.join(first, ["digest", "k"], "left").join(known, "k", "left")
    return joined.select(
        "part", F.col("f").bitwiseOR(again).alias("failed"), *[F.coalesce(c, F.lit(False)).alias(c) for c in LABELS]
    ).unionAll(rows.where("k IS NULL").select("part", F.col("f").alias("failed"), *[F.lit(False).alias(c) for c in LABELS]))


def _steps() -> Column:
    """All orders and steps: filter_order, step, the step's filter, the subsets before and with it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            rows.append(f"named_struct('o', '{''.join(order)}', 's', {step}, 'x', {FILTERS.index(letter)}, 'b', {before})")
            before |= 1 << FILTERS.index(letter)
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """600 rows a part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty, a null part is the part "", an empty table has no parts. Repeated rows count each; rows of one key and
    text are not copies of each other, as neither key is the smaller. A key that the labels repeat has a label if any of its rows
    does. Other columns are not read. Distinct words are told apart by 64-bit hashes, texts by SHA-256.
    """
    counted = survivors(marked(docs, labels, key, text, part))
    alive = lambda subset, label=0: F.coalesce(F.try_element_at("alive", subset + F.lit(32 * label)), F.lit(0).cast("long"))

    def shapley(x: int) -> Column:
        rest = [s for s in range(ALL + 1) if not s >> x & 1]
        orders = {s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) for s in rest}
        return sum((orders[s] * (alive(F.lit(s)) - alive(F.lit(s | 1 << x))) for s in rest), F.lit(0).cast("long"))

    stepped = counted.withColumn("shapley", F.array(*[shapley(x) for x in range(len(FILTERS))])).select("*", F.explode(_steps()).alias("at"))
    before, own = F.col("at.b"), F.expr("shiftleft(1, at.x)")
    after = before.bitwiseOR(own)
    lost = lambda label: alive(before, label) - alive(after, label)
    fails = alive(F.lit(0)) - alive(own)
    return stepped.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        alive(after).alias("kept"),
        lost(0).alias("removed"),
        (fails - lost(0)).alias("redundant"),
        (alive(F.lit(ALL) - own) - alive(F.lit(ALL))).alias("unique_fails"),
        lost(1).alias("good_lost"),
        lost(2).alias("toxic_lost"),
        F.element_at("shapley", F.col("at.x") + 1).alias("shapley"),
    )
