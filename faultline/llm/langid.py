"""Language identification with hypervectors.

Each letter has a random vector of +1 and -1. A run of N letters is the product of its letters' vectors, each rotated by its
place in the run; a text is the sum over its runs; a language is the sum of its texts' unit vectors. A
text's language is the prototype of the largest cosine. Everything but letters counts as one space.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices

DIMENSIONS, N = 512, 3
#: Letters share this many vectors; code points of one script never do.
LETTERS = 4096
SEED = 20_240_601
UNKNOWN = "und"
#: A text of this many characters is rejected as being in none of the languages below this cosine; shorter ones are unsure.
LONG, LEAST = 200, 0.1


@functools.lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and the vectors, of -1 and 1."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    signs = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return is_letter, signs.astype(np.int8)


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, count) for the distinct runs of each text, sorted by text; a run is coded in base LETTERS."""
    is_letter, _ = letters()
    flat = "\x00".join(t.replace("\x00", " ") if t else "" for t in texts).lower()
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    del flat
    end = code == 0
    doc = np.cumsum(end, dtype=np.int32)  # small arrays: a step's memory is a multiple of its text
    letter = is_letter[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~end[1:]  # one space after a word
    keep |= end
    code, doc, letter, end = code[keep], doc[keep], letter[keep], end[keep]
    symbol = np.where(letter, code % np.uint32(LETTERS), np.uint32(32))
    del code, letter, keep
    m = len(symbol) - N + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    run, cut = np.zeros(m, np.uint64), np.zeros(m, bool)
    for j in range(N):
        run *= np.uint64(LETTERS)
        run += symbol[j : j + m]
        cut |= end[j : j + m]
    del symbol, end
    run |= doc[:m].astype(np.uint64) << np.uint64(12 * N)
    run = run[~cut]
    run.sort()
    if not len(run):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    count = np.diff(np.concatenate([first, [len(run)]]))
    run = run[first]
    return (run >> np.uint64(12 * N)).astype(np.int64), run & np.uint64((1 << 12 * N) - 1), count


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts, and which have a letter; the others' are zero."""
    doc, run, count = runs(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(doc):
        _, signs = letters()
        kinds, back = np.unique(run, return_inverse=True)
        bound = np.ones((len(kinds), DIMENSIONS), np.int8)
        for j in range(N):
            bound *= np.roll(signs[(kinds >> np.uint64(12 * j)).astype(np.int64) % LETTERS], j, axis=1)
        bound = bound.astype(np.float32)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        weight = count.astype(np.float32)
        for i in np.flatnonzero(np.diff(ends)):
            a, z = ends[i], ends[i + 1]
            v = weight[a:z] @ bound[back[a:z]]
            out[i] = v / max(float(np.sqrt(np.dot(v, v))), 1e-9)
    some = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
    return out, some


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from rows with text and language. A row for each language comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "t"):
            v, _ = vectors(b.column(0).to_pylist())
            names = np.array(b.column(1).to_pylist(), object)
            for name in set(names):
                total[name] = total.get(name, 0.0) + v[names == name].sum(axis=0, dtype=np.float64)
        yield pa.record_batch(
            [pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    parts = rows.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in found]
    matrix = np.array([[x["x"] for x in r["v"]] for r in found]).reshape(len(names), DIMENSIONS)
    return names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, *also, lang_pred, score): score is the best cosine, from 0 to 1.

    A text that is null or has no letter is "und" with score 0, as is every text if nothing was learned. Of languages with
    equal cosines the first by name is taken. Repeated rows are predicted each; other columns are neither read nor returned.
    `text` may be a field of a struct `key`, as "doc.text"; then it is sent once.
    """
    names, prototypes = model
    kept = [key, *also]
    inside = text.removeprefix(f"{key}.") if text.startswith(f"{key}.") and text not in docs.columns else None
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b if inside is None else pa.record_batch([*b.columns, pc.struct_field(b.column(0), inside)], [*kept, "_t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(sent(batches), "_t"):
            v, some = vectors(b.column(len(kept)).to_pylist())
            cosine = v @ prototypes.T.astype(np.float32) if names else np.zeros((len(v), 1))
            best = cosine.argmax(axis=1)
            sure = np.clip(cosine[np.arange(len(v)), best], 0, 1).astype(float)
            some = some & bool(names)
            yield pa.record_batch(
                [
                    *b.columns[: len(kept)],
                    pa.array([names[i] if ok else UNKNOWN for i, ok in zip(best, some)], pa.string()),
                    pa.array(np.where(some, sure, 0.0)),
                ],
                [*kept, "lang_pred", "score"],
            )

    rows = docs.select(*kept) if inside else docs.select(*kept, F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
