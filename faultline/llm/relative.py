"""Repeated passages of words by relative Lempel-Ziv parsing against indexed reference blocks.

Pieces of documents are routed by anchor (anchors.py), so a block holds all of the corpus that its pieces can match, and
each piece is parsed against that block only. The block's index finds, for any window of WINDOW words, its earliest
occurrence in the corpus. Parsing takes from left to right the longest factor that starts where the parse is and
occurs earlier; a factor of WINDOW words or more is a duplicate span. Windows that straddle a factor's end
are looked up at the boundary one by one, so none is lost between factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.anchors import Pieces, covered, documents, spans, with_spans
from faultline.llm.common import slices
from faultline.llm.words import Words, windows

WINDOW, GRAM = 20, 4


def pieces(column: pa.Array) -> tuple:
    words = Words(column)
    found = Pieces(windows(words.key, GRAM), words.first, WINDOW, GRAM)
    found.base = words.first
    return found, words.data, words.starts[found.first], words.ends[found.last + WINDOW - 1]


def parse(key: np.ndarray, k: np.ndarray, h: np.ndarray, start: np.ndarray, shift: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple:
    """Factors of the pieces of a block: (piece, first word, end) in words of the document."""
    column = pa.LargeStringArray.from_buffers(len(key), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes()))
    words = Words(column)
    word, first = words.key, words.first
    if len(word) < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    gram = windows(word, WINDOW)
    stop = np.repeat(first[1:], words.count)  # of each word's piece
    piece = words.row()
    place = start[piece] + np.arange(len(word)) - first[piece]  # of each word in its document
    whole = np.flatnonzero(np.arange(len(gram)) + WINDOW <= stop[: len(gram)])
    # the index: for each distinct window its earliest occurrence, by document and place
    order = whole[np.lexsort((place[whole], h[piece[whole]], k[piece[whole]], gram[whole]))]
    head = np.ones(len(order), bool)
    head[1:] = gram[order[1:]] != gram[order[:-1]]
    earliest = order[head]
    names = gram[earliest]

    def source(at: np.ndarray) -> np.ndarray:
        """An earlier occurrence of the window at each word, -1 if there is none or its words differ."""
        s = earliest[np.searchsorted(names, gram[at])]
        p, q = piece[s], piece[at]
        same = (k[p] == k[q]) & (h[p] == h[q])
        ok = (k[p] < k[q]) | (same & (place[s] < place[at]))
        for j in range(WINDOW):
            ok &= word[s + j] == word[at + j]
        return np.where(ok, s, -1)

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = first[:-1].copy()  # every piece is parsed at its own place, all pieces step by step
    live = np.flatnonzero(words.count >= WINDOW)
    while len(live):
        at = now[live]
        s = source(at)
        hit = s >= 0
        x, s, end = at[hit], s[hit], at[hit] + WINDOW
        grow, reach = np.arange(len(x)), s + WINDOW
        while len(grow):  # the longest factor from here with this source
            grow = grow[(end[grow] < stop[x[grow]]) & (reach[grow] < stop[s[grow]])]
            grow = grow[word[end[grow]] == word[reach[grow]]]
            end[grow] += 1
            reach[grow] += 1
        out.append((live[hit], place[x], place[x] + end - x))
        # after a factor: windows that straddle its end begin one by one from here
        now[live[hit]] = end - WINDOW + 1
        now[live[~hit]] += 1
        live = live[now[live] + WINDOW <= first[live + 1]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, t, spans): every document with its duplicate spans, in words; see strip()."""
    rows = documents(docs, key, text)
    return with_spans(rows, spans(rows, pieces, parse, by_text=False))


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_text, kept_sha256.

    A null text has no words. A null key comes last in the order of documents. Of rows with one key and different
    texts none is earlier than the other, and the same rows are one document. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            words = Words(b.column(1), keyed=False)
            removed, texts = np.zeros(b.num_rows, np.int64), []
            for i, raw in enumerate(b.column(2).to_pylist()):
                a, z = words.first[i], words.first[i + 1]
                keep = np.ones(z - a, bool) if not raw else ~covered(raw, z - a)
                removed[i] = (~keep).sum()
                spots = np.flatnonzero(keep) + a
                flat = words.data
                texts.append(b" ".join(flat[s:e].tobytes() for s, e in zip(words.starts[spots], words.ends[spots])))
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(words.count.astype(np.int64)),
                    pa.array(removed),
                    pa.array([x.decode() for x in texts], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ],
                ["k", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    done = dedup(docs, key, text).select("k", "t", "spans")
    out = done.mapInArrow(run, "k long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.selectExpr(f"nullif(k, {2**63 - 1}) AS `{key}`", "n_words", "n_removed", "kept_text", "kept_sha256")
