"""Packing of documents into token sequences by cutting-stock column generation.

1. Every document is encoded and closed with one end id. What is over whole sequences of SIZE tokens is cut
   off as pieces that fill a sequence each; the rest, of fewer tokens, is one piece to pack.
2. The rests are counted by length class (lengths rounded up to GRAIN tokens). That histogram has SIZE / GRAIN
   entries whatever the corpus. On it the driver solves the linear program "fewest sequences" over patterns
   (how many pieces of each class share a sequence): the simplex holds a basis of patterns, and a knapsack over
   the dual prices finds the next pattern, until none is worth its sequence.
3. Patterns are rounded down; the pieces left over, fewer than the patterns' entries, fill sequences greedily.
4. The pieces of a class are ranked. Ranks are dealt to patterns in runs, so each task finds a piece's sequence
   by searching a bounded table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.bpe import encoder
from faultline.llm.common import materialize, slices

SIZE, END = 2048, 1
GRAIN = 8
#: Bytes of text encoded at once.
ENCODED_BYTES = 1 << 20
#: Documents whose ranks one window works out.
SLICE_ROWS = 20_000


def lengths(docs: DataFrame, tokenizer: str, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(k, n, crcs): tokens with the end id, and the checksum of each piece: full ones first, then the rest."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in slices(batches, "t", ENCODED_BYTES):
            ids, ends = e.encode(b.column(1))
            crcs, end = [], np.array([END], "<u4").tobytes()
            for a, z in zip(ends.tolist(), ends[1:].tolist()):
                raw = ids[a:z].astype("<u4").tobytes() + end
                crcs.append([zlib.crc32(raw[i : i + 4 * size]) for i in range(0, len(raw), 4 * size)])
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(ends) + 1, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["k", "n", "crcs"]
            )

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"k {kind}, n long, crcs array<long>")


def price(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for these dual prices: unbounded knapsack; class i takes i + 1 units of room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        got = best[r - 1 :: -1][: len(worth)] + worth[:r]
        i = int(np.argmax(got))
        if got[i] > best[r - 1] + 1e-12:
            best[r], pick[r] = got[i], i
        else:
            best[r] = best[r - 1]
    pattern, r = np.zeros(len(worth), np.int64), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            pattern[pick[r]] += 1
            r -= pick[r] + 1
    return float(best[room]), pattern


def solve(demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """Patterns and how many sequences take each: column generation, then rounding; demand[i]: pieces of i + 1 units."""
    rows = np.flatnonzero(demand)
    need = demand[rows].astype(float)
    m = len(rows)
    if not m:
        return []
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, room // (rows + 1))
    inverse = np.diag(1 / np.diag(basis))
    level = inverse @ need
    for step in range(40 * m + 100):
        duals = inverse.sum(axis=0)
        worth = np.zeros(room)
        worth[rows] = np.maximum(duals, 0)
        value, pattern = price(worth, room)
        if value <= 1 + 1e-6:
            break
        column = pattern[rows].astype(float)
        move = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(level, move, out=ratio, where=move > 1e-9)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            pivot = inverse[out] / move[out]
            inverse -= np.outer(move, pivot)
            inverse[out] = pivot
        level = np.maximum(inverse @ need, 0)
    left, found = demand.copy(), []
    for j in range(m):
        times = int(np.floor(level[j] + 1e-9))
        pattern = np.zeros(len(demand), np.int64)
        pattern[rows] = np.rint(basis[:, j])
        used = pattern > 0
        times = min([times, *(left[used] // pattern[used])]) if used.any() else 0
        if times:
            found.append((int(times), pattern))
            left -= times * pattern
    more: Counter = Counter()
    while left.any():  # largest first; every pass closes one kind of sequence as often as it can be had
        free, pattern = room, np.zeros(len(demand), np.int64)
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i]), free // (int(i) + 1))
            pattern[i] = k
            free -= k * (int(i) + 1)
        used = pattern > 0
        times = int(min(left[used] // pattern[used]))
        more[tuple(pattern)] += times
        left -= times * pattern
    return found + [(t, np.array(p)) for p, t in more.items()]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one end id. Repeated keys and rows are documents of their own; ties are ranked by
    key and then by checksums. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs_ = materialize(lengths(docs, tokenizer, key, text, size))
    units = size // GRAIN
    rest = (F.col("n") % size).cast("int")
    parts = docs_.select(
        "*",
        F.floor(F.col("n") / size).alias("full"),
        F.ceil(rest / GRAIN).cast("int").alias("c"),
    )
    sums = parts.groupBy("c").agg(F.count("*").alias("rows"), F.sum("full").alias("full")).collect()  # SIZE / GRAIN rows
    total = sum(r["rows"] for r in sums)
    demand = np.zeros(units, np.int64)
    for r in sums:
        if r["c"]:
            demand[r["c"] - 1] = r["rows"]
    n_slices = max(1, -(-total // SLICE_ROWS))
    parts = parts.withColumn("slice", F.pmod(F.xxhash64("k", "n", "crcs"), F.lit(n_slices)))

    # ranks of the rests in their class, and numbers of the full pieces, by slice and then across slices
    inner = Window.partitionBy("slice", "c").orderBy("k", "crcs")
    parts = parts.withColumn("rn", F.row_number().over(inner) - 1).withColumn(
        "fn", F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")
    )
    counts = parts.groupBy("c", "slice").agg(F.count("*").alias("m"), F.sum("full").alias("f"))
    by_class = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "c", "slice", F.coalesce(F.sum("m").over(by_class), F.lit(0)).alias("m0"), F.coalesce(F.sum("f").over(by_class), F.lit(0)).alias("f0")
    )
    ranked = parts.join(counts, ["c", "slice"])

    # where the full pieces of each class begin, and the runs of ranks that each pattern takes
    full_base, at = {}, 0
    for r in sorted(sums, key=lambda r: r["c"]):
        full_base[r["c"]] = at
        at += r["full"]
    plan = solve(demand, units)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
    taken, base = np.zeros(units, np.int64), at
    for times, pattern in plan:
        for i in np.flatnonzero(pattern):
            runs[i + 1].append((int(taken[i]), int(pattern[i]), base))
            taken[i] += times * pattern[i]
        base += times
    starts = [np.array([x[0] for x in r], np.int64) for r in runs]
    each = [np.array([x[1] for x in r], np.int64) for r in runs]
    bases = [np.array([x[2] for x in r], np.int64) for r in runs]
    fulls = np.array([full_base.get(c, 0) for c in range(units + 1)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n, crcs, c, rank, fn = b.columns
            n, c, rank, fn = (np.asarray(x) for x in (n, c, rank, fn))
            seq = np.full(len(n), -1, np.int64)
            for x in np.unique(c[c > 0]):
                mine = np.flatnonzero(c == x)
                run = np.searchsorted(starts[x], rank[mine], "right") - 1
                seq[mine] = bases[x][run] + (rank[mine] - starts[x][run]) // each[x][run]
            pieces = np.diff(np.asarray(crcs.offsets))
            doc = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            full = number < (n // size)[doc]
            yield pa.record_batch(
                [
                    k.take(pa.array(doc)),
                    pa.array(number * size),
                    pa.array(np.where(full, size, (n % size)[doc])),
                    crcs.flatten(),
                    pa.array(n[doc]),
                    pa.array(np.where(full, (fulls[c] + fn)[doc] + number, seq[doc])),
                ],
                ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"],
            )

    kind = docs.schema[key].dataType.simpleString()
    dealt = ranked.select("k", "n", "crcs", "c", (F.col("m0") + F.col("rn")).cast("long").alias("rank"), (F.col("f0") + F.col("fn")).cast("long").alias("fn")).mapInArrow(
        deal, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    )
    inside = Window.partitionBy("sequence_id").orderBy("k", "start", "ids_crc32", "length").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("offset", F.sum("length").over(inside) - F.col("length")).withColumnRenamed("k", key)
