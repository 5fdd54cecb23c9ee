"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labelled rows taken by hash, a bounded sample of each class, are the examples. All their terms make the vocabulary; document
frequencies come from all documents. IDF grows, up to TELLING + 1 times, with the term's correlation with the label, as one word may
make a text toxic. Examples lie in an inverted index, similar ones together in blocks. Lists of rare terms are
read whole; for the frequent terms every block keeps the largest weight, and a block is worked out for a text only if its
bound reaches the K-th best cosine so far, so the K nearest are exact. They vote
with weights that fall with their distance, and the votes are calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialize, slices
from faultline.llm.words import LOWER, NOT_ALNUM, Words

#: Largest number of examples of a class, and of bytes of their texts; they bound what is broadcast.
EXAMPLES, EXAMPLE_BYTES = 1500, 8 << 20
#: Besides whole words, their first bytes are terms, so that inflected forms count together.
PREFIXES = (4, 5, 6)
#: A term's IDF is multiplied by 1 + TELLING * |phi|, phi: the correlation of the term with the label over the examples.
TELLING = 10.0
K, BLOCK = 15, 64
#: Frequent terms whose weights are kept as a matrix, and texts searched at a time; neither changes results.
FREQUENT, AT_ONCE = 1024, 32
#: Examples that blocks are gathered around.
CENTRES = 16
#: Steps of the calibration.
STEPS = 40


def term_counts(column: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted; terms are hashes, or places in a sorted vocabulary, others left out."""
    words = Words(column, apart=NOT_ALNUM, alike=LOWER)
    row, key = words.row(), words.key
    longer = [(words.ends - words.starts > n, n) for n in PREFIXES]
    key = np.concatenate([key, *(words.between(words.starts[w], words.starts[w] + n) for w, n in longer if w.any())])
    row = np.concatenate([row, *(row[w] for w, _ in longer)])
    if vocabulary is not None:
        some, at = found(vocabulary, key)
        pair = np.sort(row[some] * np.int64(max(1, len(vocabulary))) + at)  # one number for text and place
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[: len(pair)]
        row, key = np.divmod(pair[first], np.int64(max(1, len(vocabulary))))
        return row, key.astype(np.uint64), np.diff(np.concatenate([first, [len(pair)]]))
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.concatenate([first, [len(key)]]))


def found(vocabulary: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are in the sorted vocabulary, and their places there; looked for from where their first bits begin."""
    none = np.zeros(0, np.int64)
    if not len(vocabulary):
        return none, none
    bits = np.uint64(64 - min(22, len(vocabulary).bit_length()))
    begins = np.searchsorted(vocabulary >> bits, np.arange((1 << (64 - int(bits))) + 1, dtype=np.uint64)).astype(np.int32)
    part = (key >> bits).astype(np.int32)
    at, end = begins[part], begins[part + 1]
    left = np.flatnonzero(at < end)
    at, end, key = at[left], end[left], key[left]
    hits, places = [none], [none]
    while len(left):
        here = vocabulary[at]
        same = here == key
        hits.append(left[same])
        places.append(at[same].astype(np.int64))
        at += 1
        go = np.flatnonzero((here < key) & (at < end))
        left, at, end, key = left[go], at[go], end[go], key[go]
    return np.concatenate(hits), np.concatenate(places)


class Index:
    """Block-max inverted index of unit TF-IDF vectors; `vectors`: (terms, counts) of each example."""

    def __init__(self, ids: list[int], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray, prior: float):
        n = len(ids)
        self.vocabulary, self.idf = vocabulary, idf
        ends = np.cumsum([0, *(len(t) for t, _ in vectors)])
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        weights = self.unit(ends, terms, np.concatenate([np.zeros(0), *(c for _, c in vectors)]))
        owner = np.repeat(np.arange(n), np.diff(ends))
        spread = np.bincount(terms, minlength=len(vocabulary))
        often = np.sort(np.argsort(-spread, kind="stable")[:FREQUENT])
        #: The row of each frequent term in the matrix; -1: a term whose list is read whole.
        self.frequent = np.full(len(vocabulary), -1, np.int64)
        self.frequent[often] = np.arange(len(often))
        whole = self.frequent[terms]
        inside = whole >= 0
        matrix = np.zeros((n, len(often)), np.float32)  # only to order examples by
        matrix[owner[inside], whole[inside]] = weights[inside]
        order = np.lexsort((np.array(ids, np.int64), _around(matrix)))
        del matrix
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = np.array(ids, np.int64)[order], np.asarray(labels)[order]
        self.blocks = max(1, -(-n // BLOCK))
        self.size = self.blocks * BLOCK
        #: matrix[block]: frequent terms by its examples; most: their largest weight in each block.
        self.matrix = np.zeros((self.blocks, len(often), BLOCK))
        at = place[owner[inside]]
        self.matrix[at // BLOCK, whole[inside], at % BLOCK] = weights[inside]
        self.most = self.matrix.max(axis=2).T
        rare = np.flatnonzero(~inside)
        rare = rare[np.lexsort((place[owner[rare]], terms[rare]))]
        self.starts = np.searchsorted(terms[rare], np.arange(len(vocabulary) + 1))
        self.places, self.weights = place[owner[rare]].astype(np.int32), weights[rare]
        share = np.bincount(self.labels, minlength=2) / max(1, n)
        self.vote = np.where(self.labels == 1, prior / max(share[1], 1e-9), (1 - prior) / max(share[0], 1e-9))
        bare = place[np.flatnonzero(np.diff(ends) == 0)]
        self.bare = (self.vote[bare] @ self.labels[bare] + prior) / (self.vote[bare].sum() + 1)
        self.steps = self.calibrate(ends, terms, weights, place)

    def unit(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of unit vectors whose terms end at `ends`."""
        w = (1 + np.log(counts)) * self.idf[terms]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        return w / np.maximum(np.sqrt(np.bincount(row, w * w, minlength=len(ends) - 1)), 1e-12)[row]

    def nearest(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines, to 9 digits, of each text's K nearest examples with a positive cosine; of equal ones the first.

        Where there are fewer, the rest has cosine 0. `but`: a place for each text that doesn't count.
        """
        n = len(ends) - 1
        places, cosines = np.zeros((n, K), np.int64), np.zeros((n, K))
        for low in range(0, n, AT_ONCE):
            high = min(n, low + AT_ONCE)
            a, z = ends[low], ends[high]
            places[low:high], cosines[low:high] = self._nearest(ends[low : high + 1] - a, terms[a:z], weights[a:z], None if but is None else but[low:high])
        return places, cosines

    def _nearest(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(ends) - 1
        row, often = np.repeat(np.arange(n), np.diff(ends)), self.frequent[terms]
        asked = np.zeros((n, self.most.shape[0]))
        asked[row[often >= 0], often[often >= 0]] = weights[often >= 0]
        row, term, weight = row[often < 0], terms[often < 0], weights[often < 0]
        long = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - (np.cumsum(long) - long), long)
        at += np.arange(len(at))
        spot, worth = np.repeat(row * self.size, long), np.repeat(weight, long)
        spot += self.places[at]
        worth *= self.weights[at]
        rare = np.bincount(spot, worth, n * self.size)
        rare = rare.reshape(n, self.blocks, BLOCK)
        bound = asked @ self.most + rare.max(axis=2)
        places, cosines = np.full((n, K), self.size, np.int64), np.zeros((n, K))

        def work_out(texts: np.ndarray, block: int) -> None:
            cosine = np.round(asked[texts] @ self.matrix[block] + rare[texts, block], 9)
            place = np.broadcast_to(np.arange(block * BLOCK, (block + 1) * BLOCK), cosine.shape)
            if but is not None:
                cosine[place == but[texts, None]] = 0
            some = cosine.max(axis=1) >= np.maximum(cosines[texts, -1], 1e-12)  # the others change nothing
            if not some.all():
                texts, cosine, place = texts[some], cosine[some], place[some]
            if not len(texts):
                return
            place = np.concatenate([places[texts], np.where(cosine > 0, place, self.size)], axis=1)
            cosine = np.concatenate([cosines[texts], np.maximum(cosine, 0)], axis=1)
            best = np.lexsort((place, -cosine), axis=1)[:, :K]
            places[texts], cosines[texts] = np.take_along_axis(place, best, 1), np.take_along_axis(cosine, best, 1)

        first = bound.argmax(axis=1)
        for block in np.unique(first):
            work_out(np.flatnonzero((first == block) & (bound[:, block] > 0)), block)
        for block in range(self.blocks):
            left = (first != block) & (bound[:, block] > 0) & (bound[:, block] >= cosines[:, -1] - 1e-8)
            if left.any():
                work_out(np.flatnonzero(left), block)
        return np.where(cosines > 0, places, 0), cosines

    def raw(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Toxic share of the votes; NaN without neighbours."""
        w = np.where(cosines > 0, self.vote[places] / (1.05 - np.minimum(cosines, 1.0)), 0.0)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[places]).sum(axis=1) / np.maximum(total, 1e-300), np.nan)

    def calibrate(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes and the share of toxic examples at each, rising; by pooling neighbours that fall."""
        if not len(place):
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        x = self.raw(*self.nearest(ends, terms, weights, place))
        y, w = self.labels[place].astype(float), self.vote[place]
        seen = np.flatnonzero(~np.isnan(x))
        if not len(seen):
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        seen = seen[np.lexsort((y[seen], x[seen]))]
        pools: list[list[float]] = []
        for part in np.array_split(seen, min(STEPS, len(seen))):
            pools.append([w[part] @ x[part], w[part] @ y[part], w[part].sum()])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        vote = np.array([p[0] / p[2] for p in pools])
        share = np.array([p[1] / p[2] for p in pools])
        return np.concatenate([[0.0], vote, [1.0]]), np.concatenate([[share[0]], share, [share[-1]]])

    def score(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, and the places and cosines of the nearest examples."""
        if not len(self.ids):
            return np.full(len(ends) - 1, float(self.bare)), np.zeros((len(ends) - 1, K), np.int64), np.zeros((len(ends) - 1, K))
        places, cosines = self.nearest(ends, terms, self.unit(ends, terms, counts))
        raw = self.raw(places, cosines)
        return np.where(np.isnan(raw), self.bare, np.interp(np.nan_to_num(raw), *self.steps)), places, cosines


def _around(vectors: np.ndarray) -> np.ndarray:
    """For each vector the number of its nearest centre; the next centre is the vector farthest from those before it."""
    nearest, closest = np.zeros(len(vectors), np.int64), np.full(len(vectors), -1.0)
    for c in range(min(CENTRES, len(vectors))):
        near = vectors @ vectors[closest.argmin()]
        nearest[near > closest] = c
        closest = np.maximum(closest, near)
    return nearest


def learn(docs: DataFrame, labels: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """The index; `held_out`: SQL on labels, rows where it is true are not learned from.

    Labels that are null or not 0 or 1 and rows without a key are left out; of several labels of a key the largest counts, of several
    texts the longest, then the first in order. A null text counts as empty. In the order of a hash, rows of a class are examples
    up to EXAMPLES rows and EXAMPLE_BYTES of text. Without examples the index is empty.
    """
    seen = labels.where(f"NOT coalesce({held_out}, false)").where(F.col(label).isNotNull() & F.col(key).isNotNull())
    seen = seen.groupBy(F.col(key).cast("long").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    seen = materialize(seen.where("y IN (0, 1)"))
    sizes = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    chosen = [seen.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(EXAMPLES) for y in (0, 1)]
    chosen = materialize(chosen[0].unionAll(chosen[1]))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "k")
    texts = texts.groupBy("k", "y").agg(F.min_by("t", F.struct(-F.octet_length("t"), "t")).alias("t"))
    upto = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k")  # EXAMPLES rows at most
    sizes_ = texts.select("k", "y", F.octet_length("t").alias("n")).withColumn("upto", F.sum("n").over(upto))
    texts = texts.join(sizes_.where(F.col("upto") <= EXAMPLE_BYTES).select("k"), "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            row, term, n = term_counts(b.column(1))
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term.view(np.int64), n.astype(np.int64))]
            yield pa.record_batch([b.column(0), b.column(2), *lists], ["k", "y", "terms", "counts"])

    # bounded by EXAMPLES and EXAMPLE_BYTES
    examples = texts.select("k", "t", "y").mapInArrow(count, "k long, y int, terms array<long>, counts array<long>").toArrow().sort_by("k")
    terms = [np.asarray(t.values, np.int64).view(np.uint64) for t in examples["terms"]]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for b in slices(batches, "t"):
            _, term, _ = term_counts(b.column(0), vocabulary)
            total += np.bincount(term.astype(np.int64), minlength=len(vocabulary))
            rows += b.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*some, -1], pa.int32()), pa.array([*total[some], rows], pa.int64())], ["i", "n"])

    sums = docs.select(F.col(text).alias("t")).mapInArrow(frequency, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    sums = sums.toArrow()  # a row for each term of the examples and one more
    at, n = np.asarray(sums["i"], np.int64), np.asarray(sums["n"], np.int64)
    df = np.zeros(len(vocabulary), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((n[at < 0].sum() + 1) / (df + 1)) + 1
    vectors = [(np.searchsorted(vocabulary, t), np.asarray(c.values, np.int64)) for t, c in zip(terms, examples["counts"])]
    y = np.asarray(examples["y"], np.int64)
    return Index(examples["k"].to_pylist(), y, vectors, vocabulary, idf * (1 + TELLING * correlation(vectors, y, len(vocabulary))), prior)


def correlation(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int) -> np.ndarray:
    """|phi| of each term's presence with the label."""
    present = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
    toxic = np.repeat(labels, [len(t) for t, _ in vectors])
    n, with_, both = len(labels), np.bincount(present, minlength=terms), np.bincount(present, toxic, terms)
    apart = with_ * (n - with_) * float(labels.sum()) * float(n - labels.sum())
    return np.abs(n * both - with_ * float(labels.sum())) / np.sqrt(np.maximum(apart, 1.0))


def predict(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, *also, score, predicted, evidence): evidence holds the keys of the nearest examples, at most 3.

    A text that is null or has no term of an example scores as the examples without terms do, and has no evidence. Repeated rows are scored each; other
    columns are neither read nor returned. Without labelled rows every score is 0.
    """
    kept = [key, *also]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches, "_t"):
            row, term, count = term_counts(b.column(len(kept)), index.vocabulary)
            score, places, cosines = index.score(np.searchsorted(row, np.arange(b.num_rows + 1)), term.astype(np.int64), count)
            score = np.clip(score, 0, 1)
            yield pa.record_batch(
                [
                    *b.columns[: len(kept)],
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                    pa.array([index.ids[p[c > 0]].tolist() for p, c in zip(places[:, :3], cosines[:, :3])], pa.list_(pa.int64())),
                ],
                [*kept, "score", "predicted", "evidence"],
            )

    return docs.select(*kept, F.col(text).alias("_t")).mapInArrow(run, f"{schema}, score double, predicted int, evidence array<long>")
