"""Scoring by a bigram model whose counts live in a log-frequency Bloom filter.

Texts are written once as token numbers, some MB of text to a slice. Tasks send a slice's sorted hashes of tokens and of
bigrams, packed by hash range; the task of a range sums counts over the whole training corpus, makes its segment of the
filter, as large as its items need, and answers each slice's hashes from it. Ranges grow in number with the text, so a
segment stays small and no worker or driver holds the whole filter. An n-gram of count c is put in once for every level up
to 1 + floor(log(c, BASE)); a count is read back by probing level after level until one misses. N-grams below CUTOFF aren't
in it. A token's probability mixes the estimates from the bigram and from the token alone.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import groups, materialize, slices
from faultline.llm.words import LOWER, Words, mix, windows

END = np.uint64(0x656E64)  # the end token; words' hashes fill 64 bits
BASE, LEVELS = 1.5, 64
#: The smallest count kept of single tokens and of bigrams.
CUTOFF = (1, 2)
#: Bits for each item and probes for each level.
ITEM_BITS, PROBES = 12, 4
#: Bytes of text for each hash range.
RANGE_BYTES = 64 << 20
#: Weight of the bigram estimate; the rest is the single token's.
BIGRAM = 0.3
_STEP = np.uint64(0xD1342543DE82EF95)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an END after each, and the texts' offsets."""
    words = Words(column, alike=LOWER)
    n = len(words.count)
    offsets = words.first + np.arange(n + 1)
    out = np.empty(len(words.key) + n, np.uint64)
    last = np.zeros(len(out), bool)
    last[offsets[1:] - 1] = True
    out[last] = END
    out[~last] = words.key
    return out, offsets


def spread(key: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each key; it grows with the key."""
    return ((key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<u4", len(kinds)), kinds):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def planes(key: np.ndarray) -> np.ndarray:
    """Differences of rising keys, their first bytes, then their second ones and so on: short when compressed."""
    return np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()


def keys_of(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def probes(key: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    x = mix(key ^ np.uint64(level * int(_STEP) % 2**64))
    for _ in range(PROBES):
        yield (x >> np.uint64(32)) * size.astype(np.uint64) >> np.uint64(32) if isinstance(size, np.ndarray) else (x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        x = mix(x + _STEP)


def segment(key: np.ndarray, count: np.ndarray, most: int | None, cutoff: int) -> bytes:
    """A filter for the n-grams of one hash range, as large as they need, or of `most` bytes at the largest."""
    key, count = key[count >= cutoff], count[count >= cutoff]
    level = np.minimum(1 + np.floor(np.log(count / cutoff) / math.log(BASE) + 1e-9).astype(np.int64), LEVELS)
    need = max(8, ITEM_BITS * int(level.sum()) // 8 + 1)
    size = 8 * (need if most is None else min(most, need))
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in probes(key[level >= j], j, size):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def middle(level: int, cutoff: int) -> float:
    """The count that a level stands for: the middle of the whole numbers in it."""
    if not level:
        return 0.0
    low, high = math.ceil(cutoff * BASE ** (level - 1) - 1e-9), math.ceil(cutoff * BASE**level - 1e-9) - 1
    return (low + high) / 2 if high >= low else cutoff * BASE ** (level - 0.5)


class Filter:
    """All segments end to end."""

    def __init__(self, segments: list[bytes], cutoff: int):
        self.value = np.array([middle(j, cutoff) for j in range(LEVELS + 1)])
        self.bytes = np.frombuffer(b"".join(segments), np.uint8)
        self.size = np.array([8 * len(s) for s in segments], np.int64)
        self.base = np.cumsum(self.size) - self.size

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The last level that all probes hit, 0 if none."""
        part = spread(key, len(self.size))
        base, size = self.base[part], self.size[part]
        found = np.zeros(len(key), np.int64)
        some = np.arange(len(key))
        for j in range(1, LEVELS + 1):
            hit = np.ones(len(some), bool)
            for at in probes(key[some], j, size[some]):
                at = base[some] + at.astype(np.int64)
                hit &= (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            some = some[hit]
            if not len(some):
                break
            found[some] = j
        return found

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Counts as the filter has them."""
        return self.value[self.levels(key)]


def bigrams(key: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token with the one before it in its text, and which tokens have one."""
    pair = np.zeros(len(key), np.uint64)
    pair[1:] = windows(key, 2)
    inner = np.ones(len(key), bool)
    inner[offsets[:-1]] = False
    return pair, inner


def score(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where `held_out` is true are scored and not learned from; a null there counts as false. A null or empty text is one
    end token. Repeated rows are learned and scored each. Other columns are not read. If nothing is learned, N and V are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("k"),
        F.coalesce(F.col(held_out), F.lit(False)).alias("o"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of texts: keys, flags, lengths in tokens, bytes, and the distinct tokens with each token's place in them."""
        for b in slices(batches, "t"):
            tokens_, offsets = tokens(b.column(2))
            names, places = np.unique(tokens_, return_inverse=True)
            values = [b.column(0).to_pylist(), b.column(1).to_pylist(), np.diff(offsets).tolist(), int(pc.sum(pc.binary_length(b.column(2))).as_py())]
            # a random name: slices of the same texts are different slices
            values = [int.from_bytes(os.urandom(8), "little") >> 1, *values, packed(planes(names), places.astype(np.uint32))]
            yield _batch(_SLICE, values)

    sliced = materialize(rows.mapInArrow(number, _schema(_SLICE)))
    size = sliced.agg(F.sum("size")).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice and range: kind 0 its tokens by text, kind 1 its bigrams."""
        for sid, out, offsets, names, places in _slices(batches):
            n = len(out)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            both, tf = np.unique(places * n + owner, return_counts=True)
            name, r = both // n, (both % n).astype(np.uint32)
            texts = np.bincount(name, minlength=len(names)).astype(np.uint32)
            train = np.bincount(name, np.where(out[r], 0, tf), minlength=len(names)).astype(np.uint32)
            tf, ends = tf.astype(np.uint32), np.concatenate([[0], np.cumsum(texts, dtype=np.int64)])
            cut = np.searchsorted(spread(names, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                a, z = cut[p], cut[p + 1]
                i, j = ends[a], ends[z]
                yield _batch(_SENT, [int(p), 0, sid, packed(planes(names[a:z]), train[a:z], texts[a:z], r[i:j], tf[i:j], np.array([n], np.uint32))])
            kinds, back, inner = _pairs(names[places], offsets)
            train = np.bincount(back, ~out[owner[inner]], minlength=len(kinds)).astype(np.uint32)
            cut = np.searchsorted(spread(kinds, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                a, z = cut[p], cut[p + 1]
                yield _batch(_SENT, [int(p), 1, sid, packed(planes(kinds[a:z]), train[a:z])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range: answers by slice (kinds 0 and 1), and its share of N and V (kind 2)."""
        for b, at in groups(batches, 2):
            for a, z in zip(at, at[1:]):
                g = b.slice(int(a), int(z - a))
                bucket, kind, sids = g.column(0)[0].as_py(), g.column(1)[0].as_py(), g.column(2).to_pylist()
                kinds = ("<u1", "<u4") if kind else ("<u1", "<u4", "<u4", "<u4", "<u4", "<u4")
                # keys and counts of all slices; the rest is unpacked again when its slice is answered
                both = [(keys_of(x), c) for x, c, *_ in (unpacked(x.as_buffer(), *kinds) for x in g.column(3))]
                done = np.cumsum([0, *(len(x) for x, _ in both)])
                trained = np.concatenate([c for _, c in both])
                keys, back = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
                del both
                counts = np.bincount(back, trained, minlength=len(keys)).astype(np.int64)
                levels = Filter([segment(keys, counts, None, CUTOFF[kind])], CUTOFF[kind]).levels(keys).astype(np.uint8)
                if not kind:
                    yield _batch(_ANSWER, [bucket, 2, 0, b"", int(counts.sum()), int((counts > 0).sum())])
                for i, sid in enumerate(sids):
                    mine = back[done[i] : done[i + 1]]
                    if kind:
                        yield _batch(_ANSWER, [bucket, 1, sid, packed(levels[mine]), 0, 0])
                        continue
                    _, _, texts, r, tf, n = unpacked(g.column(3)[i].as_buffer(), *kinds)
                    c = np.repeat(counts[mine], texts)
                    sums = np.bincount(r, tf * np.log10(c + 0.5), minlength=int(n[0]))
                    known = np.bincount(r, tf * (c > 0), minlength=int(n[0]))
                    yield _batch(_ANSWER, [bucket, 0, sid, packed(levels[mine], sums, known), 0, 0])

    sent = sliced.mapInArrow(send, _schema(_SENT)).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    answers = materialize(sent.mapInArrow(count, _schema(_ANSWER)))
    total = answers.agg(F.sum("all").alias("N"), F.sum("kinds").alias("V")).first()
    n_all, v_all = total["N"] or 0, total["V"] or 0
    low = n_all + 0.5 * (v_all + 1)
    value = [np.array([middle(j, c) for j in range(LEVELS + 1)]) for c in CUTOFF]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of each slice (its first row) from the answers of all ranges (by kind and range, so in the order of its hashes)."""
        for b, at in groups(batches, 1):
            for a, z in zip(at, at[1:]):
                g = b.slice(int(a), int(z - a))
                _, out, offsets, names, places = next(_slices([g.slice(0, 1).select(list(_SLICE))]))
                sums, known, found = 0.0, 0.0, ([], [])
                for kind, blob in zip(g.column(1).to_pylist()[1:], g.column(g.schema.get_field_index("blob"))[1:]):
                    if kind:
                        found[1].extend(unpacked(blob.as_buffer(), "<u1"))
                        continue
                    levels, x, y = unpacked(blob.as_buffer(), "<u1", "<f8", "<f8")
                    found[0].append(levels)
                    sums, known = sums + x, known + y
                single = value[0][np.concatenate(found[0])]
                uni = ((single + 0.5) / low)[places]
                both, history = np.zeros(len(places)), np.ones(len(places))
                _, back, inner = _pairs(names[places], offsets)
                both[inner] = value[1][np.concatenate([np.zeros(0, np.uint8), *found[1]])][back]
                history[1:] = single[places[:-1]]
                follows = both / np.maximum(np.maximum(history, both), 1.0)
                logs = np.log10(np.where(inner, BIGRAM * follows + (1 - BIGRAM) * uni, uni))
                n = np.diff(offsets)
                values = [g.column(g.schema.get_field_index("k"))[0].values, pa.array(out), pa.array(n), pa.array(np.rint(known).astype(np.int64))]
                values += [pa.array(sums - n * math.log10(low)), pa.array(np.add.reduceat(logs, offsets[:-1]))]
                yield pa.record_batch(values, ["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    slice_rows = sliced.select("sid", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), *[c for c in _SLICE if c != "sid"])
    together = slice_rows.unionByName(answers.where("kind < 2").select("sid", "kind", "bucket", "blob"), allowMissingColumns=True)
    scored = (
        together.repartition("sid")
        .sortWithinPartitions("sid", "kind", "bucket")
        .mapInArrow(add, "k long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "binary": pa.binary()}
_SLICE = {"sid": "long", "k": "array<long>", "o": "array<boolean>", "n": "array<long>", "size": "long", "blob": "binary"}
_SENT = {"bucket": "int", "kind": "int", "sid": "long", "blob": "binary"}
_ANSWER = _SENT | {"all": "long", "kinds": "long"}


def _schema(kinds: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in kinds.items())


def _batch(kinds: dict[str, str], values: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], _ARROW[t]) for v, t in zip(values, kinds.values())], list(kinds))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sid, flags, offsets, distinct tokens, places) of rows of _SLICE."""
    for b in batches:
        for i in range(b.num_rows):
            names, places = unpacked(b.column(5)[i].as_buffer(), "<u1", "<u4")
            offsets = np.concatenate([[0], np.cumsum(np.asarray(b.column(3)[i].values), dtype=np.int64)])
            out = b.column(2)[i].values.to_numpy(zero_copy_only=False).astype(bool)
            yield b.column(0)[i].as_py(), out, offsets, keys_of(names), places.astype(np.int64)


def _pairs(key: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, rising, the place in them of each token that has one, and which tokens have one."""
    pair, inner = bigrams(key, offsets)
    return *np.unique(pair[inner], return_inverse=True), inner
