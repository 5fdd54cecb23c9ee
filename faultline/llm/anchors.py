"""Routing of repeated stretches: equal windows of a corpus meet in one task, whatever their documents.

A window's anchor is the smallest of its k-gram hashes, the first of equal ones, so equal windows have equal anchors.
Consecutive windows with one anchor make a piece. Anchors are counted over the corpus first; those that occur once can't
belong to a repeated window. The others go into a Bloom filter of bounded size (a false hit costs work, never a
result; when it is full, everything passes), and pieces that pass are sent to the task of their anchor's hash range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import STEP_BYTES, groups, materialize, slices
from faultline.llm.lm import packed, spread, unpacked
from faultline.llm.words import mix, sums

#: Largest filter, bits for each anchor, and probes.
MOST_BYTES, ITEM_BITS, PROBES = 48 << 20, 10, 3
#: Distinct anchors a task gathers before it sends them; bytes of pieces it gathers.
GATHERED, PIECE_BYTES = 3_000_000, 1 << 20
#: Bytes of text in which pieces are looked for at once; that takes some seventy times as much memory.
FOUND_BYTES = 512 << 10
#: Pieces of a bucket that a task puts in order at once, whole anchors.
SHARE = 1 << 15
#: Rows that a segment of a filter of rows is made of.
SEGMENT_ROWS = 500_000
_STEP = np.uint64(0xD1342543DE82EF95)


class Pieces:
    """first, last: window starts of each piece; at: its anchor's place; key: the anchor's hash. All in units of a slice."""

    def __init__(self, gram: np.ndarray, owner_ends: np.ndarray, length: int, k: int):
        """gram: hash of the k-gram that starts at each unit; owner_ends: offsets of the documents, in units."""
        self.length = length
        width, n = length - k + 1, int(owner_ends[-1])
        self.first = self.last = self.at = self.row = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if len(gram) < width or n < length:
            return
        place_bits = np.uint64(max(1, int(len(gram)).bit_length()))
        low = (gram >> place_bits << place_bits) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)[: n - length + 1]
        room = np.repeat(owner_ends[1:], np.diff(owner_ends))[: len(at)]
        whole = np.arange(len(at)) + length <= room
        starts = np.flatnonzero(whole)
        if not len(starts):
            return
        at = at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(starts)]]) - 1
        self.first, self.last, self.at = starts[head], starts[tail], at[head]
        self.key = mix(gram[self.at])
        self.row = np.searchsorted(owner_ends, self.first, "right") - 1


class Seen:
    """A Bloom filter in segments by hash range."""

    def __init__(self, segments: list[bytes]):
        self.bytes = np.frombuffer(b"".join(segments), np.uint8)
        self.size = np.array([8 * len(s) for s in segments], np.uint64)
        self.base = (np.cumsum(self.size) - self.size).astype(np.int64)

    @staticmethod
    def places(key: np.ndarray, size: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
        x = mix(key ^ _STEP)
        for _ in range(PROBES):
            yield ((x >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)
            x = mix(x + _STEP)

    @staticmethod
    def segment(key: np.ndarray, most: int) -> bytes:
        size = 8 * min(most, max(8, ITEM_BITS * len(key) // 8 + 1))
        bits = np.zeros(size, bool)
        for at in Seen.places(key, np.uint64(size)):
            bits[at] = True
        return np.packbits(bits).tobytes()

    def has(self, key: np.ndarray) -> np.ndarray:
        part = spread(key, len(self.size))
        out = np.ones(len(key), bool)
        for at in self.places(key, self.size[part]):
            at = self.base[part] + at
            out &= (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        return out


def documents(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(k, h, t, *more): key with nulls last of all, hash of the text, the text with null as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"), *more)


def repeated(rows: DataFrame, pieces: Callable[[pa.Array], tuple], parts: int, by_text: bool) -> Seen:
    """The filter of anchors of at least two pieces; `by_text`: of two documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            kinds, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return kinds, np.minimum(np.bincount(back, np.concatenate([c for _, c in held])), 2).astype(np.uint8)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = merged()
            cut = np.searchsorted(spread(keys, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                yield pa.record_batch(
                    [pa.array([p], pa.int32()), pa.array([packed(keys[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]])], pa.binary())],
                    ["bucket", "blob"],
                )
            held.clear()

        for b in slices(batches, "t", FOUND_BYTES):
            found = pieces(b.column(2))[0]
            key = found.key
            if by_text:
                order = np.lexsort((found.row, key))
                key, row = key[order], found.row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key = key[new]
            kinds, counts = np.unique(key, return_counts=True)
            held.append((kinds, np.minimum(counts, 2).astype(np.uint8)))
            if sum(len(x) for x, _ in held) > GATHERED:
                held[:] = [merged()]
                if len(held[0][0]) > GATHERED // 2:
                    yield from flush()
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in groups(batches, 1):
            for a, z in zip(at, at[1:]):
                both = [unpacked(x.as_buffer(), "<u8", "<u1") for x in b.column(1).slice(int(a), int(z - a))]
                keys, back = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in both]), minlength=len(keys))
                blob = Seen.segment(keys[counts > 1], MOST_BYTES // parts)
                yield pa.record_batch([b.column(0).slice(int(a), 1), pa.array([blob], pa.binary())], ["bucket", "blob"])

    return _segments(rows.mapInArrow(send, "bucket int, blob binary"), count, parts)


def _segments(sent: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], parts: int) -> Seen:
    segments = materialize(
        sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(make, "bucket int, blob binary")
    )
    found = {r["bucket"]: bytes(r["blob"]) for r in segments.toLocalIterator()}  # MOST_BYTES at most
    return Seen([found.get(p, b"\0" * 8) for p in range(parts)])


def filter_of(keys: DataFrame, *columns: Column) -> Callable[..., Column]:
    """A function of columns: whether `keys` may have a row with their values. False only where it has none; it is MOST_BYTES at most."""
    parts = max(8, -(-keys.count() // SEGMENT_ROWS))
    hashed = keys.select(F.xxhash64(*columns).alias("h"))
    part = F.shiftrightunsigned(F.shiftrightunsigned("h", 40) * F.lit(parts).cast("long"), 24)  # as `spread`

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in groups(batches, 1):
            for a, z in zip(at, at[1:]):
                blob = Seen.segment(np.unique(np.asarray(b.column(1).slice(int(a), int(z - a))).view(np.uint64)), MOST_BYTES // parts)
                yield pa.record_batch([b.column(0).slice(int(a), 1), pa.array([blob], pa.binary())], ["bucket", "blob"])

    seen = _segments(hashed.select(part.cast("int").alias("bucket"), "h"), make, parts)
    shared = keys.sparkSession.sparkContext.broadcast(seen)

    @F.arrow_udf("boolean")
    def may(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(np.asarray(h).view(np.uint64)))

    return lambda *columns: may(F.xxhash64(*columns))


def routed(
    batches: Iterator[pa.RecordBatch], pieces: Callable[[pa.Array], tuple], has: Callable[[np.ndarray], np.ndarray], parts: int
) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): the pieces whose anchor passes, packed by its hash range.

    They are looked for in little text at once, and sent together for as much as a step has elsewhere.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def passing(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        found, data, first, last = pieces(b.column(2))
        some = np.flatnonzero(has(found.key))
        first, last, row = first[some], last[some], found.row[some]
        size = last - first
        total, down = sums(data)
        name = mix((total[last] - total[first]) * down[first] + size.astype(np.uint64))
        start = found.first[some]
        units, shift = found.last[some] + found.length - start, found.at[some] - start
        where = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return (
            np.array(b.column(0), "<i8"), np.array(b.column(1), "<i8"), row, found.key[some],
            (start - found.base[row]).astype("<u4"), shift.astype("<u1"), size.astype("<u4"), name, units.astype("<u2"), data[where],
        )

    def flush() -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *(len(x[0]) for x in held)])
        row = np.concatenate([x[2] + n for x, n in zip(held, before)])
        ids, hashes, _, key, start, shift, size, name, units, data = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(key, kind="stable")
        begin = np.cumsum(size, dtype=np.int64) - size
        cut = np.searchsorted(spread(key[order], parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)):
            x = order[cut[p] : cut[p + 1]]
            n = size[x].astype(np.int64)
            where = np.repeat(begin[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            kinds, doc = np.unique(row[x], return_inverse=True)
            blob = packed(ids[kinds], hashes[kinds], key[x], doc.astype("<u4"), start[x], shift[x], size[x], data[where], name[x], units[x])
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    text = 0
    for b in slices(batches, "t", FOUND_BYTES):
        n = pc.sum(pc.binary_length(b.column(2))).as_py() or 0
        if held and text + n > STEP_BYTES:
            yield from flush()
            text = 0
        held.append(passing(b))
        text += n
    if held:
        yield from flush()


def spans(
    rows: DataFrame,
    pieces: Callable[[pa.Array], tuple],
    judge: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]],
    by_text: bool,
) -> DataFrame:
    """(k, h, spans): stretches of each document that `judge` finds, as pairs of little-endian 32-bit start and end.

    pieces(texts) gives Pieces, the bytes of the texts, and each piece's first and last byte; judge(key, k, h, start, shift, data,
    ends) gets the pieces of some anchors, ordered by anchor, with documents in order, and returns (piece, start, end) in
    units. Of equal pieces it gets those that are not duplicates of an earlier one as a whole; the others are spans.
    """
    spark = rows.sparkSession
    rows = rows.select("k", "h", "t")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 2
    seen = spark.sparkContext.broadcast(repeated(rows, pieces, parts, by_text))

    sent = rows.mapInArrow(lambda batches: routed(batches, pieces, seen.value.has, parts), "bucket int, blob binary")
    sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(lambda batches: compared(batches, judge, by_text), "k long, h long, spans binary")
    return materialize(found)


def shares(blobs: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces of a bucket, SHARE or about as many at a time, whole anchors: k, h, key, start, shift, size, name, units, data."""
    all_ = [unpacked(x.as_buffer(), "<i8", "<i8", "<u8", "<u4", "<u4", "<u1", "<u4", "<u1", "<u8", "<u2") for x in blobs]
    ends = [np.concatenate([[0], np.cumsum(x[6], dtype=np.int64)]) for x in all_]
    low, high = (int(f(x[2][i] for x in all_)) for f, i in ((min, 0), (max, -1)))  # a blob's keys are in order
    ways = max(1, -(-sum(len(x[2]) for x in all_) // SHARE))
    bounds = np.array([low + (high - low) * i // ways for i in range(ways)] + [high], np.uint64)
    cuts = [np.append(np.searchsorted(x[2], bounds[:-1]), len(x[2])) for x in all_]
    for i in range(ways):
        own = [(x, e, int(c[i]), int(c[i + 1])) for x, e, c in zip(all_, ends, cuts) if c[i] < c[i + 1]]
        if own:
            k, h = (np.concatenate([x[j][x[3][a:z]] for x, _, a, z in own]) for j in (0, 1))
            rest = (np.concatenate([x[j][a:z] for x, _, a, z in own]) for j in (2, 4, 5, 6, 8, 9))
            yield k, h, *rest, np.concatenate([x[7][e[a] : e[z]] for x, e, a, z in own])


def compared(batches: Iterator[pa.RecordBatch], judge: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], by_text: bool) -> Iterator[pa.RecordBatch]:
    """(k, h, spans): what `spans` tells of the buckets."""
    for b, at in groups(batches, 1):
        for a, z in zip(at, at[1:]):
            for k, h, key, start, shift, size, name, units, data in shares(b.column(1).slice(int(a), int(z - a))):
                order = np.lexsort((start, h, k, name, key))
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
                head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                whole = k[order] > k[order[head]]
                if not by_text:  # a document's own earlier piece counts too
                    x, y = order[1:], order[:-1]
                    whole[1:] |= ~new[1:] & (k[x] == k[y]) & (h[x] == h[y]) & (start[x] > start[y])
                if whole.any():
                    x = order[whole]
                    yield from _by_document(k[x], h[x], start[x].astype(np.int64), start[x].astype(np.int64) + units[x])
                order = order[~whole]
                order = order[np.lexsort((start[order], h[order], k[order], key[order]))]
                kinds, counts = np.unique(key[order], return_counts=True)
                order = order[np.isin(key[order], kinds[counts > 1])]
                if not len(order):
                    continue
                ends = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
                k, h, key, start, shift = (x[order] for x in (k, h, key, start.astype(np.int64), shift))
                begin, n = ends[order], size[order].astype(np.int64)
                done = 0  # whole anchors at a time, about PIECE_BYTES of them
                filled = np.cumsum(n)
                while done < len(order):
                    end = int(np.searchsorted(filled, (filled[done - 1] if done else 0) + PIECE_BYTES, "right"))
                    end = int(np.searchsorted(key, key[min(max(end, done + 1), len(order)) - 1], "right"))
                    part = slice(done, end)
                    m = n[part]
                    where = np.repeat(begin[part] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    piece, lo, hi = judge(key[part], k[part], h[part], start[part], shift[part], data[where], np.concatenate([[0], np.cumsum(m)]))
                    if len(piece):
                        yield from _by_document(k[part][piece], h[part][piece], lo, hi)
                    done = end


def _by_document(k: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((hi, lo, h, k))
    k, h, lo, hi = k[order], h[order], lo[order], hi[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    cut = np.concatenate([np.flatnonzero(new), [len(k)]])
    both = np.stack([lo, hi], axis=1).astype("<u4").tobytes()
    yield pa.record_batch(
        [pa.array(k[cut[:-1]]), pa.array(h[cut[:-1]]), pa.array([both[8 * a : 8 * z] for a, z in zip(cut, cut[1:])], pa.binary())], ["k", "h", "spans"]
    )


def covered(raw: list[bytes], units: int) -> np.ndarray:
    """Which of a document's units lie in the spans."""
    change = np.zeros(units + 1, np.int64)
    both = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2)
    np.add.at(change, both[:, 0], 1)
    np.add.at(change, both[:, 1], -1)
    return np.cumsum(change[:units]) > 0


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the list of their spans, empty where there are none."""
    gathered = found.groupBy("k", "h").agg(F.collect_list("spans").alias("spans"))  # as much as the document's text
    gathered = materialize(gathered).withColumnRenamed("k", "k2").withColumnRenamed("h", "h2")
    return rows.join(gathered, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2")), "left").select(*rows.columns, "spans")
