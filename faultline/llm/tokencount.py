"""Token counts of whole texts by a byte-level BPE, without forming the tokens and without moving a word.

Texts are cut into pre-tokens as the tokenizer's expression does it, by arrays of character classes. Their numbers of
tokens come from two tiers: a compact hash table of the frequent pre-tokens' lengths, broadcast once, and for the rest a cache
in each worker, filled by encoding what it lacks. No pre-token is shuffled; a text is read where it lies.
"""

from __future__ import annotations

import functools
import json
import os
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from faultline.llm.common import slices
from faultline.llm.words import sums, mix, utf8

#: Entries of the broadcast table, at 10 bytes for each of twice as many slots.
FREQUENT = 1 << 16
#: Partitions, and bytes of text in all, that the table is fitted on. Counts don't depend on it: what it lacks is encoded.
SAMPLE_PARTS, SAMPLE_BYTES = 16, 16 << 20
#: Pre-tokens in each of the two generations of a worker's cache.
REMEMBERED = 400_000

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


class Lengths:
    """Open-addressing hash table of pre-token hashes and their numbers of tokens, as two arrays."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        size = max(2, 1 << int(2 * max(len(keys), 1) - 1).bit_length())
        self.keys, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        left = np.flatnonzero((keys != 0) & (lengths < 1 << 16))
        slot = self.home(keys[left])
        while len(left):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)  # one claimant a slot
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.lengths[slot[won]] = keys[left[won]], lengths[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of tokens; -1 for what the table doesn't hold."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self.home(keys)
        while len(left):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.lengths[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        out[keys == 0] = -1
        return out


class Tally:
    """Counts tokens in a worker: the tokenizer, its character classes and the cache of what the table lacks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.young: dict[int, int] = {}
        self.old: dict[int, int] = {}

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Class of each character; the tokenizer itself is asked once for each character that is new."""
        found = self.classes[points]
        for p in np.unique(points[found == UNKNOWN]).tolist():
            joins = lambda left: len(self.whole.pre_tokenizer.pre_tokenize_str(left + chr(p))) == 1  # noqa: E731,B023
            self.classes[p] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else SPACE
        return self.classes[points]

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a pre-token; `first` marks the characters that begin a text.

        Runs of letters, numbers, other marks or white space; the last of a run of white space before something else stands
        alone, and if it is a blank it belongs to what follows; a contraction after anything but a blank or a mark stands alone.
        """
        n = len(points)
        kind = self.classify(points)
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        ends = np.ones(n + 3, bool)  # the text ends before this character
        ends[:n] = first
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:]) if n else np.zeros(0, np.int64)
        new[last] = True
        new[last[points[last] == ord(" ")] + 1] = False
        mark = np.flatnonzero((points == ord("'")) & new)
        if len(mark):
            after = np.zeros(n + 3, np.uint32)
            after[:n] = points
            one, two = after[mark + 1], after[mark + 2]
            one[ends[mark + 1]] = 0
            two[ends[mark + 1] | ends[mark + 2]] = 0
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            new[mark[short | long] + 1] = False
            behind = np.concatenate([mark[short] + 2, mark[long] + 3])
            new[behind[behind < n]] = True  # also a letter
        return new

    def pretokens(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(bytes, starts, ends, hashes, first: for each text the number of its first pre-token, and the end)."""
        data, offsets = utf8(texts)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        first = np.zeros(len(lead), bool)
        inside = offsets[:-1][np.diff(offsets) > 0]
        first[np.searchsorted(lead, inside)] = True
        begin = lead[np.flatnonzero(self.starts(points, first))]
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        total, down = sums(data)
        keys = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        return data, begin, end, keys, np.searchsorted(begin, offsets)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def missed(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of tokens of pre-tokens that the table lacks."""
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        known = [self.young.get(k) or self.old.get(k, 0) for k in names]
        new = [i for i, x in enumerate(known) if not x]
        raw = data.tobytes()
        texts = [raw[a:z].decode("utf-8") for a, z in zip(begin[at[new]].tolist(), end[at[new]].tolist())]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        for i, x in zip(new, self.encoded(texts)):
            known[i] = self.young[names[i]] = x
        return np.array(known, np.int64)[back]

    def count(self, texts: pa.Array, table: Lengths) -> np.ndarray:
        """Tokens of each text; null counts as empty. Texts that hold a special string are encoded whole."""
        data, offsets = utf8(texts)
        raw = data.tobytes()
        special = np.zeros(len(texts), bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                special[row] |= at + len(token) <= offsets[row + 1]
                at = raw.find(token, at + 1)
        out = np.zeros(len(texts), np.int64)
        if special.any():
            whole = np.flatnonzero(special)
            out[whole] = self.encoded([raw[offsets[r] : offsets[r + 1]].decode("utf-8") for r in whole])
            texts = pa.array(["" if s else t for s, t in zip(special, texts.to_pylist())], pa.large_string())
        data, begin, end, keys, first = self.pretokens(texts)
        sizes = table.find(keys)
        lost = np.flatnonzero(sizes < 0)
        if len(lost):
            sizes[lost] = self.missed(data, begin[lost], end[lost], keys[lost])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return out + upto[first[1:]] - upto[first[:-1]]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Tally:
    """One counter per Python worker."""
    return Tally(path)


def frequent(docs: DataFrame, tokenizer: str, text: str = "text", most: int = FREQUENT) -> Lengths:
    """The table of the pre-tokens that are most frequent in a bounded sample: a share of SAMPLE_BYTES from SAMPLE_PARTS partitions.

    Each of these tasks sends its own most frequent hashes with their counts and lengths; they are added up on the driver.
    """
    only = docs.select(text)
    parts = only.rdd.getNumPartitions()
    chosen = frozenset(random.Random(0).sample(range(parts), min(parts, SAMPLE_PARTS)))
    share = SAMPLE_BYTES // max(len(chosen), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() not in chosen:
            return
        c, seen, size, bytes_read = counter(tokenizer), Counter(), {}, 0
        for b in slices(batches, "t", share // 4):
            data, begin, end, keys, _ = c.pretokens(b.column(0))
            if len(keys):
                distinct, at, n = np.unique(keys, return_index=True, return_counts=True)
                lengths = c.missed(data, begin[at], end[at], distinct)
                seen.update(dict(zip(distinct.tolist(), n.tolist())))
                size.update(zip(distinct.tolist(), lengths.tolist()))
            bytes_read += len(data)
            if bytes_read >= share:
                break
        top = [k for k, _ in seen.most_common(most)]
        row = [np.array(x, np.uint64).tobytes() for x in (top, [seen[k] for k in top], [size[k] for k in top])]
        yield pa.record_batch([pa.array([x], pa.binary()) for x in row], ["k", "n", "len"])

    total: Counter = Counter()
    size: dict[int, int] = {}
    for row in only.withColumnRenamed(text, "t").mapInArrow(run, "k binary, n binary, len binary").collect():
        keys, n, lengths = (np.frombuffer(x, np.uint64).tolist() for x in row)
        total.update(dict(zip(keys, n)))
        size.update(zip(keys, lengths))
    top = [k for k, _ in total.most_common(most)]
    return Lengths(np.array(top, np.uint64), np.array([size[k] for k in top], np.int64))


def counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text", table: Lengths | None = None
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit), one row per row of docs, equal to the library's encoding.

    A null text is empty and has no tokens; null and repeated keys stay as they are; other columns are not read. An empty
    table gives no rows. Strings of special tokens within a text count as the library takes them. Pre-tokens are told apart by 64-bit hashes of
    their bytes and length.
    """
    known = docs.sparkSession.sparkContext.broadcast(table or frequent(docs, tokenizer, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in slices(batches, "t"):
            n = c.count(b.column(1), known.value)
            size = np.diff(utf8(b.column(1))[1])
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    return (
        docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t")
        .mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("k", key)
    )
