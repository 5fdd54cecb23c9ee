"""Repeated byte strings from a suffix order built column by column over many short texts.

Texts are cut into pieces by anchor (anchors.py), so all windows of WINDOW bytes that could be equal lie in one task, in
pieces of less than twice that length. There the Burrows-Wheeler transform of the distinct pieces and the array of common
prefixes grow by one symbol of every piece a round, from the right: the place of a new suffix is the rank of its symbol
in the transform so far, and its common prefix with the neighbour is one more than the least one between the
symbol's last occurrence and this one. Transform, prefixes and owners are files that every round reads and writes
from end to end. Runs of common prefixes of WINDOW bytes or more are the repeated windows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from faultline.llm.anchors import Pieces, covered, documents, spans, with_spans
from faultline.llm.common import fresh, slices
from faultline.llm.words import mix, sums, utf8

WINDOW, GRAM = 50, 16
#: Prefixes of a block, for minima over ranges.
SPAN = 64


def pieces(column: pa.Array) -> tuple:
    data, offsets = utf8(column)
    total, down = sums(data)
    n = max(0, len(data) - GRAM + 1)
    found = Pieces(mix((total[GRAM:] - total[:n]) * down[:n]) if n else np.zeros(0, np.uint64), offsets, WINDOW, GRAM)
    found.base = offsets
    return found, data, found.first, found.last + WINDOW


class Columns:
    """The transform of a collection of strings, built in rounds over sequential files."""

    def __init__(self, folder: str, text: np.ndarray, ends: np.ndarray):
        self.folder = Path(folder)
        alphabet = np.unique(text)
        code = np.zeros(256, np.uint16)
        code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.kind = np.uint8 if len(alphabet) < 256 else np.uint16
        self.text, self.code = text, code.astype(self.kind)
        self.begin, self.ends = ends[:-1], ends[1:]

    def read(self, name: str, kind: type) -> np.ndarray:
        return np.fromfile(self.folder / name, kind)

    def write(self, name: str, new: np.ndarray) -> None:
        """Over the old file, which is never longer."""
        path = self.folder / name
        with path.open("r+b" if path.exists() else "wb") as f:
            f.write(new.data)

    def symbols(self, some: np.ndarray, length: int) -> np.ndarray:
        """What stands before the suffix of this length in each string; 0 at its start."""
        at = self.ends[some] - length - 1
        return np.where(at >= self.begin[some], self.code[self.text[np.maximum(at, 0)]], 0).astype(self.kind)

    def build(self) -> None:
        some = np.arange(len(self.ends))  # strings that have more symbols
        m = len(some)
        self.write("symbol", self.symbols(some, 0))
        self.write("prefix", np.zeros(m, np.uint8))
        self.write("owner", np.zeros(0, np.int32))
        place, length = some.copy(), 0
        while True:
            symbol, prefix = self.read("symbol", self.kind), self.read("prefix", np.uint8)
            more = self.ends[some] - self.begin[some] > length
            some, place = some[more], place[more]
            if not len(some):
                return
            length += 1
            order = np.argsort(symbol, kind="stable")
            # strings are kept in order of place, so that places are read and written from end to end; now by symbol, then place
            turn = np.argsort(symbol[place], kind="stable")
            some, asked = some[turn], np.zeros(len(symbol), bool)
            asked[place] = True
            place, mine = place[turn], np.flatnonzero(asked[order])
            bare = len(symbol) - np.count_nonzero(symbol)
            new = m + mine - bare
            # common prefixes with the occurrences of the same symbol before and after
            here = symbol[place]
            before, after = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, len(order) - 1)]
            has_before = (mine > bare) & (symbol[before] == here)
            has_after = (mine < len(order) - 1) & (symbol[after] == here)
            least = self.minima(prefix)
            low = least(before[has_before] + 1, place[has_before])
            high = least(place[has_after] + 1, after[has_after])
            total = len(symbol) + len(some)
            old = np.ones(total, bool)
            old[new] = False
            grown = np.zeros(total, self.kind)
            grown[old] = symbol
            grown[new] = self.symbols(some, length)
            self.write("symbol", grown)
            common = np.zeros(total, np.uint8)
            common[old] = prefix
            common[new] = 0
            common[new[has_before]] = low + 1
            common[new[has_after] + 1] = high + 1
            self.write("prefix", common)
            if length >= WINDOW:
                owner = self.read("owner", np.int32)
                if not len(owner):
                    owner = np.full(len(symbol), -1, np.int32)
                owners = np.zeros(total, np.int32)
                owners[old] = owner
                owners[new] = some
                self.write("owner", owners)
                lengths = np.zeros(total, np.uint8)
                lengths[old] = self.read("length", np.uint8) if length > WINDOW else 0
                lengths[new] = length
                self.write("length", lengths)
            place = new

    @staticmethod
    def minima(prefix: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function for the minima of prefix over ranges [first, last]: by minima within and across blocks of SPAN."""
        blocks = -(-len(prefix) // SPAN)
        grid = np.full(blocks * SPAN, 255, np.uint8)
        grid[: len(prefix)] = prefix

        def doubled(low: np.ndarray, limit: int) -> list[np.ndarray]:
            levels = [low]  # minima of 1, 2, 4, ... entries from each on
            while 2 << (len(levels) - 1) <= min(len(low), limit):
                half = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
            return levels

        def of(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
            out = np.empty(len(first), np.uint8)
            level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
            for j in np.unique(level):
                some = np.flatnonzero(level == j)
                out[some] = np.minimum(levels[j][first[some]], levels[j][last[some] + 1 - (1 << int(j))])
            return out

        near = doubled(grid, SPAN)
        across = doubled(np.ascontiguousarray(near[-1][::SPAN]), blocks)

        def least(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            x, y = first // SPAN, last // SPAN
            out = of(near, first, np.minimum(last, x * SPAN + SPAN - 1))
            more, far = np.flatnonzero(y > x), np.flatnonzero(y - x > 1)
            out[more] = np.minimum(out[more], of(near, y[more] * SPAN, last[more]))
            out[far] = np.minimum(out[far], of(across, x[far] + 1, y[far] - 1))
            return out

        return least

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, suffix length, group): suffixes of WINDOW bytes or more; equal windows have one group."""
        owner, length, prefix = self.read("owner", np.int32), self.read("length", np.uint8), self.read("prefix", np.uint8)
        group = np.cumsum(prefix < WINDOW)
        some = np.flatnonzero(length >= WINDOW) if len(owner) else np.zeros(0, np.int64)
        return owner[some], length[some].astype(np.int64), group[some]


def meeting(key: np.ndarray, k: np.ndarray, shift: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Which pieces can share a window with a piece of another document; a false hit costs work, never a result.

    A window holds its anchor's gram, and besides it at least half of the other bytes on one side. So equal windows agree in
    their anchor and in that stretch on its left or on its right.
    """
    gram = begin + shift
    half = (WINDOW - GRAM) // 2
    out = np.zeros(len(key), bool)
    for first, last in ((gram - half, gram + GRAM), (gram, gram + GRAM + half)):
        some = np.flatnonzero((first >= begin) & (last <= end))
        seed = mix((total[last[some]] - total[first[some]]) * down[first[some]]) ^ key[some]
        order = np.argsort(seed, kind="stable")
        seed, some = seed[order], some[order]
        heads = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))[: len(seed)]
        if len(heads):
            several = np.maximum.reduceat(k[some], heads) > np.minimum.reduceat(k[some], heads)
            out[some[np.repeat(several, np.diff(np.concatenate([heads, [len(seed)]])))]] = True
    return out


def repeats(key: np.ndarray, k: np.ndarray, h: np.ndarray, start: np.ndarray, shift: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple:
    """Windows of the pieces that also start in a document with a smaller key: (piece, first byte, end)."""
    none = (np.zeros(0, np.int64),) * 3
    anchor = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.maximum.reduceat(k, bounds) > np.minimum.reduceat(k, bounds)
    use = np.flatnonzero(several[anchor])
    if not len(use):
        return none
    size = np.diff(ends)
    total, down = sums(data)
    use = use[meeting(key[use], k[use], shift[use], ends[use], ends[use + 1], total, down)]
    if not len(use):
        return none
    name = mix((total[ends[1:]] - total[ends[:-1]]) * down[ends[:-1]] + size.astype(np.uint64))
    _, first, kind = np.unique(name[use] ^ key[use], return_index=True, return_inverse=True)
    first = use[first]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, k[use])
    n = size[first]
    where = np.repeat(ends[first] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    with tempfile.TemporaryDirectory() as folder:
        columns = Columns(folder, data[where], np.concatenate([[0], np.cumsum(n)]))
        columns.build()
        string, length, group = columns.windows()
    if not len(string):
        return none
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.minimum.reduceat(least[string], heads)[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]
    # the earliest document of each distinct piece's windows, in order of place
    base = np.concatenate([[0], np.cumsum(n - WINDOW + 1)])
    table = np.zeros(base[-1], np.int64)
    table[base[string] + n[string] - length] = earliest
    count = (size[use] - WINDOW + 1).astype(np.int64)
    at = np.repeat(base[kind] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    piece = np.repeat(use, count)
    hit = np.flatnonzero(table[at] < k[piece])
    if not len(hit):
        return none
    head = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])])
    tail = np.concatenate([head[1:], [True]])
    offset = start[piece] + at - base[kind][np.repeat(np.arange(len(use)), count)]
    return piece[hit[head]], offset[hit[head]], offset[hit[tail]] + WINDOW


def digest(b: pa.RecordBatch) -> tuple[list[pa.Array], list[bytes]]:
    """Of rows (t, spans): n_bytes, n_removed, n_spans and kept_sha256, and the bytes left."""
    data, offsets = utf8(b.column(0))
    removed, n_spans, kept = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
    for i, raw in enumerate(b.column(1).to_pylist()):
        own = data[offsets[i] : offsets[i + 1]]
        if raw:
            gone = covered(raw, len(own))
            removed[i] = gone.sum()
            n_spans[i] = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
            own = own[~gone]
        kept.append(own.tobytes())
    sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
    return [pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), sha], kept


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A null key comes last in the order of documents; rows of one key never shorten each other. Other
    columns are not read. An empty table gives no rows.
    """
    rows = documents(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            yield pa.record_batch([b.column(2), *digest(b)[0]], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = with_spans(rows, spans(rows, pieces, repeats, by_text=True)).select("t", "spans", "k")
    out = done.mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.selectExpr(f"nullif(k, {2**63 - 1}) AS `{key}`", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stripped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with texts shortened; where a cut goes through a character, its other bytes go too. A null text stays null."""
    rows = documents(docs, key, text)
    others = F.struct(*[F.col(c) for c in docs.columns if c != text], F.col(text).isNull().alias(fresh("_null", docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            texts = [x.decode("utf-8", "ignore") for x in digest(b)[1]]
            yield pa.record_batch([b.column(2), pa.array(texts, pa.string())], ["doc", "left"])

    carried = documents(docs, key, text, others.alias("doc"))
    done = with_spans(carried, spans(rows, pieces, repeats, by_text=True)).select("t", "spans", "doc")
    out = done.mapInArrow(run, StructType([done.schema["doc"], StructField("left", StringType())]))
    own = F.when(F.col("doc")[done.schema["doc"].dataType.names[-1]], F.lit(None)).otherwise(F.col("left"))
    return out.select(*[own.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
