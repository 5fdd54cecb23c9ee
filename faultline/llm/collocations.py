"""Phrases whose words come together more often than apart, found by SON partitioning.

The documents are dealt into shards. Each shard is mined completely, level by level, at a support lowered in proportion to its
share of the language's words: a phrase that reaches the support in all reaches the lowered one in some shard. What is
frequent in any shard is a candidate; a last pass counts all candidates over all documents exactly, by their text.

Mining uses 64-bit hashes and, from level to level, bitmaps of what was frequent. Both can only let more through, so they decide
nothing: results come from the last pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialize, slices
from faultline.llm.words import SAME, SPACE, Words, windows

#: Support of a phrase, most words of one, results a language.
SUPPORT, LONGEST, FIRST = 30, 4, 2000
#: Shards; with them the lowered support is about SUPPORT / SHARDS. A shard is mined by many tasks, so it may be of any size.
SHARDS = 4
#: Bits of a bitmap for each frequent phrase, and of the largest bitmap (32 MB). Above some 30 million frequent phrases a bitmap
#: fills up: then more phrases are counted, in proportion to the text at most, with the same results.
BITS_EACH, MOST_BITS = 16, 28
#: Bytes of text that words are looked for in at once, for mining and for counting, and occurrences that are counted at once: a
#: worker's memory is in proportion to them.
MINED_BYTES, COUNTED_BYTES, OCCURRENCES = 256 << 10, 512 << 10, 1 << 19
#: Parts that a language's candidates are ranked in before their best are ranked together.
PARTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_APART = _BREAK | SPACE
_LOWER = SAME.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[0x09] = 0x20


class Phrases:
    """The words of a column of texts and the phrases in them, by the place of their first word."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, _APART, _LOWER)
        w = self.words
        breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
        self.row = w.row()
        #: Whether a word and the next are in one piece.
        self.joined = np.zeros(len(w.key), bool)
        if len(w.key):
            self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[w.starts[1:]] == breaks[w.ends[:-1]])

    def places(self, n: int) -> np.ndarray:
        """Where n words stand in one piece."""
        ok = np.ones(max(len(self.words.key) - n + 1, 0), bool)
        for j in range(n - 1):
            ok &= self.joined[j : j + len(ok)]
        return np.flatnonzero(ok)

    def hashes(self, n: int) -> np.ndarray:
        return windows(self.words.key, n)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set: both of their bits are set."""
    bits = np.uint64(len(bitmap).bit_length() + 2)
    high = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    low = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return ((bitmap[high >> 3] >> (high & 7)) & (bitmap[low >> 3] >> (low & 7)) & 1).astype(bool)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Two bits for each row of the column `key`, in a power of two of bits; built in pieces of 32,768 bits by hash aggregation."""
    bits = min(max(15, (BITS_EACH * max(keys.count(), 1)).bit_length()), MOST_BITS)
    probes = F.array(
        F.shiftrightunsigned("key", 64 - bits) + 1, F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    )
    pieces = (
        keys.select(F.explode(probes).alias("x"))
        .groupBy(F.bitmap_bucket_number("x").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    )
    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in pieces.collect():
        at = (row["piece"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def counts(cells: list[int], codes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each key in each cell, from the numbers of cells and the keys that stand there."""
    code, key = np.concatenate(codes), np.concatenate(keys)
    key = key[np.argsort(code.astype(np.uint16) if len(cells) < 1 << 16 else code, kind="stable")]
    ends = np.cumsum(np.bincount(code, minlength=len(cells)))
    for cell, a, z in zip(cells, [0, *ends], ends):
        if a < z:
            found, n = np.unique(key[a:z], return_counts=True)
            yield pa.record_batch(
                [pa.array(np.full(len(found), cell, np.uint64).view(np.int64)), pa.array(found.view(np.int64)), pa.array(n)], ["cell", "key", "n"]
            )


def miner(level: int, shorter: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `mine` runs on (cell, text): counts from many small steps over the text are folded together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[int, int] = {}
        known, codes, keys, waiting = shorter(), [], [], 0
        for b in slices(batches, "t", MINED_BYTES):
            p = Phrases(b.column(1))
            cells = np.asarray(b.column(0)).view(np.uint64)
            at = p.places(level)
            if shorter_than := level - 1:
                part = p.hashes(shorter_than)
                cell = cells[p.row[at]]
                at = at[passes(known, part[at] ^ cell) & passes(known, part[at + 1] ^ cell)]
            distinct, code = np.unique(cells, return_inverse=True)
            code = np.array([number.setdefault(c, len(number)) for c in distinct.tolist()], np.uint32)[code]
            codes.append(code[p.row[at]])
            keys.append(p.hashes(level)[at])
            waiting += len(at)
            if waiting >= OCCURRENCES:
                yield from counts(list(number), codes, keys)
                codes, keys, waiting = [], [], 0
        if waiting:
            yield from counts(list(number), codes, keys)

    return run


def mine(docs: DataFrame, level: int, shorter: np.ndarray | None) -> DataFrame:
    """(cell, key, n): occurrences of the phrases of `level` words in each cell, a shard's part of a language.

    A phrase is counted only if both phrases of one word less in it may be frequent in the cell.
    """
    known = docs.sparkSession.sparkContext.broadcast(shorter)
    rows = docs.select("cell", "t").mapInArrow(miner(level, lambda: known.value), "cell long, key long, n long")
    return rows.groupBy("cell", "key").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> np.ndarray:
    """Bitmap of the phrases, by hash of the language and the phrase, that are frequent in a shard."""
    words = materialize(mine(docs, 1, None))
    cells = docs.groupBy("cell").agg(F.first("language").alias("language"))
    sized = words.groupBy("cell").agg(F.sum("n").alias("w")).join(cells, "cell")
    total = sized.groupBy("language").agg(F.sum("w").alias("total"))
    # the least whole number that is not below support * w / total
    lowered = "CAST((CAST(w AS DECIMAL(20,0)) * {0} + CAST(total AS DECIMAL(20,0)) - 1) div CAST(total AS DECIMAL(20,0)) AS BIGINT)"
    limits = materialize(sized.join(total, "language").select("cell", "language", F.expr(lowered.format(support)).alias("least")))

    frequent, shorter = [], None
    for level in range(1, longest + 1):
        counted = words if level == 1 else mine(docs, level, shorter)
        found = materialize(counted.join(limits, "cell").where("n >= least").select("cell", "language", "key"))
        frequent.append(found.select(F.col("key").bitwiseXOR(F.col("language")).alias("key")))
        if level < longest:
            shorter = bitmap(found.select(F.col("key").bitwiseXOR(F.col("cell")).alias("key")))
    union = frequent[0]
    for more in frequent[1:]:
        union = union.unionAll(more)
    return bitmap(materialize(union.distinct()))


def counted(docs: DataFrame, chosen: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n): exact counts of the phrases that `chosen` lets through, and under the phrase '' those of all words."""
    known = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", COUNTED_BYTES):
            p = Phrases(b.column(2))
            w = p.words
            lang = b.column(0).dictionary_encode()
            code = np.asarray(lang.indices).astype(np.int64)[p.row]
            language = np.asarray(b.column(1)).view(np.uint64)[p.row]
            text = _LOWER[w.data].tobytes()
            names, totals, langs = [""] * len(lang.dictionary), np.bincount(code, minlength=len(lang.dictionary)).tolist(), list(range(len(lang.dictionary)))
            # phrases of n words are numbered by the number of their first n - 1 and of their last word: no hash decides
            single = np.unique(w.key, return_inverse=True)[1] if len(w.key) else np.zeros(0, np.int64)
            number = single.copy()
            for n in range(1, longest + 1):
                at = p.places(n)
                if n > 1:
                    pairs = number[at] * (int(single.max(initial=0)) + 1) + single[at + n - 1]
                    number[at] = np.unique(pairs, return_inverse=True)[1]
                at = at[passes(known.value, p.hashes(n)[at] ^ language[at])]
                own = number[at] * len(lang.dictionary) + code[at]
                _, one, times = np.unique(own, return_index=True, return_counts=True)
                first = at[one]
                begin, end = w.starts[first], w.ends[first + n - 1]
                length = sum(w.ends[first + j] - w.starts[first + j] for j in range(n)) + n - 1
                plain = (end - begin == length).tolist()
                for a, z, ok in zip(begin.tolist(), end.tolist(), plain):
                    phrase = text[a:z].decode("utf-8")
                    names.append(phrase if ok else " ".join(x for x in phrase.split(" ") if x))
                totals += times.tolist()
                langs += code[first].tolist()
            yield pa.record_batch(
                [lang.dictionary.take(pa.array(langs, pa.int32())), pa.array(names, pa.string()), pa.array(totals, pa.int64())], ["lang", "phrase", "n"]
            )

    rows = docs.select("lang", "language", "t").mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one holds, from (lang, phrase, f) of all frequent ones.

    A longer phrase counts for the two of one word less in it: if some phrase holds this one and is nearly as frequent, so is
    every phrase between them.
    """
    of = F.split("phrase", " ")
    parts = frequent.select("lang", "phrase", F.col("f").alias("a"), of.alias("words")).where("size(words) > 1")
    inner = F.array(F.array_join(F.slice("words", 1, F.size("words") - 1), " "), F.array_join(F.slice("words", 2, F.size("words") - 1), " "))
    holders = parts.where("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = parts.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80)).drop("longer")
    cuts = left.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(k, "
        "array_join(slice(words, 1, k), ' ') AS one, array_join(slice(words, k + 1, size(words) - k), ' ') AS two))")).alias("cut"))  # fmt: skip
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    l = frequent.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l"))
    r = frequent.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r"))
    each = cuts.join(l, ["lang", "one"]).join(r, ["lang", "two"]).withColumn(
        "score", F.expr("CAST(2000000 * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    )
    best = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", support: int = SUPPORT, first: int = FIRST, shards: int = SHARDS
) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, a null language is `und`. Repeated rows count each; the key only deals the rows into shards, null keys
    into one. Ties are broken by count, then by the phrase's bytes. Other columns are not read. An empty table gives no
    rows. Words are told apart by 64-bit hashes within a step of 2 MB of text, phrases by their text.
    """
    lang_of, shard = F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards))
    rows = docs.select(
        lang_of.alias("lang"), F.xxhash64(lang_of).alias("language"), F.xxhash64(lang_of, shard).alias("cell"), F.col(text).alias("t")
    )
    found = materialize(counted(rows, candidates(rows, support)).where((F.col("n") >= support) | (F.col("phrase") == "")))
    words = found.where("phrase = ''").select("lang", F.col("n"))
    scores = scored(found.where("phrase <> ''").withColumnRenamed("n", "f"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    some = scores.withColumn("part", part).withColumn("rank", within).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
