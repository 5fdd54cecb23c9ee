"""Near-duplicate texts by BagMinHash over multisets of word shingles.

A text's bag holds its five-word shingles with their numbers. Every shingle runs Poisson processes over its number
of copies: the unit interval and then intervals that double, (1, 2], (2, 4], ... A point has a time, a register, and a
place in its interval; a bag sees the points at places up to its number of copies. A register keeps its first time, so
two bags agree in a register with a probability that is their weighted Jaccard similarity. A process stops when its
time is past every register of its bag, so a bag costs about as many points as it has shingles.

Registers are banded. Bags that share a band are candidates, which are verified on the whole bags: first every bag of a bucket
against the bucket's smallest. The bags of the buckets of one smallest bag are a cluster. If some of its pairs failed, it is
compared in blocks: every bag outside the largest part that passed pairs join with all bags of other parts, by a product of
incidence matrices. Pairs are never rows there.
A bag is named by its smallest key and its hash, so rows of one key and different texts are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.anchors import filter_of
from faultline.llm.common import groups, materialize, slices, stars
from faultline.llm.words import Words, mix, windows

WIDTH, LEAST = 5, 0.8
#: At a similarity of 0.8 two bags share no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Bags of a block, and shingles that a comparison of blocks works on at once.
BLOCK, COLUMNS = 256, 8192
_STEP = np.uint64(0xD1342543DE82EF95)


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, copies, offsets by text), shingles sorted in each text. A text of fewer than WIDTH words is one shingle."""
    words = Words(column)
    n = len(words.count)
    size = np.minimum(words.count, WIDTH)
    shingle = windows(words.key, WIDTH)
    row = words.row()
    inside = row[: len(shingle)] == row[WIDTH - 1 :][: len(shingle)]
    shingle, owner = shingle[inside], row[: len(shingle)][inside]
    short = np.flatnonzero((size > 0) & (size < WIDTH))
    ones = [mix(windows(words.key[words.first[i] : words.first[i + 1]], int(size[i]))) for i in short]
    shingle = np.concatenate([shingle, *ones])
    owner = np.concatenate([owner, short])
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    copies = np.diff(np.concatenate([first, [len(shingle)]]))
    return shingle[first], copies, np.searchsorted(owner[first], np.arange(n + 1))


def signatures(shingle: np.ndarray, copies: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First times (texts, M); texts without a shingle keep infinite times."""
    n = len(offsets) - 1
    times = np.full(n * M, np.inf)
    table = times.reshape(n, M)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    keys, owners, lows, widths, most = [], [], [], [], []
    low, width, k = 0, 1, 0
    some = np.arange(len(shingle))
    while len(some):
        keys.append(mix(shingle[some] + np.uint64(k * int(_STEP) % 2**64)))
        owners.append(owner[some])
        lows.append(np.full(len(some), low))
        widths.append(np.full(len(some), width))
        most.append(copies[some])
        low, width, k = low + width, max(1, low + width), k + 1
        some = some[copies[some] > low]
    key, owner, low, width, most = (np.concatenate(x) if x else np.zeros(0) for x in (keys, owners, lows, widths, most))
    now = np.zeros(len(key))
    step = 0
    while len(key):
        key = mix(key + _STEP)
        now = now - np.log(((key >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (M * width)
        other = mix(key ^ _STEP)
        register = (other >> np.uint64(32)) % np.uint64(M)
        place = low + 1 + np.floor((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width)
        seen = place <= most
        np.minimum.at(times, (owner * M + register.astype(np.int64))[seen], now[seen])
        step += 1
        if step <= 4 or step % 4 == 0:
            alive = np.unique(owner)
            last = np.zeros(n)
            last[alive] = table[alive].max(axis=1)
            go = now < last[owner]
            key, owner, low, width, most, now = (x[go] for x in (key, owner, low, width, most, now))
    return table


def bands(table: np.ndarray) -> np.ndarray:
    """Band keys (texts, BANDS)."""
    bits = table.view(np.uint64).reshape(len(table), BANDS, ROWS)
    out = np.zeros(bits.shape[:2], np.uint64)
    for j in range(ROWS):
        out = mix(out * _STEP + bits[:, :, j])
    return out.view(np.int64)


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of 64-bit values by text, wrapping."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def bag_hash(shingle: np.ndarray, copies: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return totals(mix(shingle + copies.astype(np.uint64) * _STEP), offsets)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        shingle, copies, offsets = bags(b.column(1))
        keys = bands(signatures(shingle, copies, offsets))
        yield pa.record_batch(
            [
                b.column(0),
                b.column(2),
                pa.array(np.diff(offsets)),
                pa.array(bag_hash(shingle, copies, offsets)),
                pa.array(totals(mix(shingle ^ (copies.astype(np.uint64) * _STEP)), offsets)),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
            ],
            ["k", "x", "n", "h1", "h2", "bands"],
        )


def bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        shingle, copies, offsets = bags(b.column(1))
        pack = [
            shingle[a:z].astype("<u8").tobytes() + copies[a:z].astype("<u4").tobytes() for a, z in zip(offsets, offsets[1:])
        ]
        yield pa.record_batch(
            [b.column(0), pa.array(pack, pa.binary()), pa.array(bag_hash(shingle, copies, offsets))], ["k", "bag", "h"]
        )


def similarity(a: bytes, b: bytes) -> float:
    def bag(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(x) // 12
        return np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n).astype(np.int64)

    (x, cx), (y, cy) = bag(a), bag(b)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = y[at] == x
    least = int(np.minimum(cx[both], cy[at[both]]).sum())
    return least / (int(cx.sum()) + int(cy.sum()) - least)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similarity(x.as_buffer(), y.as_buffer()) >= LEAST for x, y in zip(b.column(2), b.column(3))]
        yield pa.record_batch([*b.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of parts, one of each side of a task, that a bag of each side links."""
    for b, at in groups(batches, 3):
        for a, z in zip(at, at[1:]):
            g = b.slice(int(a), int(z - a))
            side, place = np.asarray(g.column(3)), g.column(4)
            n = int((side == 0).sum())
            if not n or n == len(side):
                continue
            fields = np.stack([np.asarray(f) for f in place.flatten()], axis=1)
            _, first, part = np.unique(fields, axis=0, return_index=True, return_inverse=True)
            part = part.reshape(-1)
            size, row, key = elements([x.as_buffer() for x in g.column(5)])
            left = row < n
            shared = np.intersect1d(key[left], key[~left])
            common = np.zeros((n, len(side) - n), np.float32)
            spot = np.searchsorted(shared, key)
            spot[spot == len(shared)] = 0
            some = shared[spot] == key if len(shared) else np.zeros(len(key), bool)
            row, spot = row[some], spot[some]
            for low in range(0, len(shared), COLUMNS):
                now = (spot >= low) & (spot < low + COLUMNS)
                table = np.zeros((len(side), min(COLUMNS, len(shared) - low)), np.float32)
                table[row[now], spot[now] - low] = 1
                common += table[:n] @ table[n:].T
            union = size[:n, None] + size[None, n:] - common
            i, j = np.nonzero((common >= LEAST * union) & (part[:n, None] != part[None, n:]))
            if len(i):
                pairs = np.unique(np.stack([part[:n][i], part[n:][j]]), axis=1)
                yield pa.record_batch([place.take(pa.array(first[p])) for p in pairs], ["a", "b"])


def elements(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size by bag, bag, element): the j-th copy of a shingle is an element of its own."""
    sizes = [len(x) // 12 for x in packs]
    shingle = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in zip(packs, sizes)])
    copies = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in zip(packs, sizes)]).astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(packs)), sizes), copies)
    number = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    key = np.repeat(shingle, copies)
    key = np.where(number > 0, mix(key + number.astype(np.uint64) * _STEP), key)
    return np.bincount(row, minlength=len(packs)).astype(np.float32), row, key


NODE = "struct<k: bigint, h: bigint>"


def late_links(tried: DataFrame, joined: DataFrame, whole: DataFrame) -> DataFrame:
    """Links (a, b) between parts of a cluster, the bags that were tried against one bag, if some of them failed: in blocks.

    All bags of a bucket are in the cluster of its smallest. A task has a block of the bags outside the cluster's largest part
    and a block of all its bags, so the bags of a cluster are sent once for every BLOCK bags outside that part.
    """
    open_ = materialize(tried.where("NOT ok").select(F.col("a").alias("cluster")).distinct())
    member = tried.select(F.col("a").alias("cluster"), F.col("b").alias("rep")).join(open_, "cluster")
    member = member.unionAll(open_.select("cluster", F.col("cluster").alias("rep")))
    member = member.join(joined, F.col("rep") == F.col("u"), "left").select("cluster", "rep", F.coalesce("v", "rep").alias("c"))
    member = materialize(member)
    main = member.groupBy("cluster", "c").agg(F.count("*").alias("m")).groupBy("cluster")
    main = main.agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m"))
    main = materialize(main.where("most < m"))

    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    def own(n: Column) -> Column:
        return F.pmod(F.xxhash64("rep"), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    some, all_ = blocks(F.col("m") - F.col("most")), blocks(F.col("m"))
    member = member.join(main, "cluster").withColumn("cluster", F.xxhash64("cluster"))
    rest = member.where("c <> main").select("cluster", own(some).alias("i"), every(all_).alias("j"), F.lit(0).alias("side"), "c", "rep")
    others = member.select("cluster", every(some).alias("i"), own(all_).alias("j"), F.lit(1).alias("side"), "c", "rep")
    task = ["cluster", "i", "j"]
    dealt = rest.unionAll(others).join(whole, F.col("rep") == F.col("node")).select(*task, "side", "c", "bag")
    return dealt.repartition(*task).sortWithinPartitions(*task, "side").mapInArrow(across, f"a {NODE}, b {NODE}")


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id (the smallest key of the group), n_shingles, kept (key = class_id), text_id, class_hash.

    A text that is null or has no word is alike to none and kept (class_hash is null). Rows of one key are judged each by its
    own text, told apart by `text_id`, a hash of the text; groups that begin with one key are told apart by `class_hash`.
    Rows of one key that are alike are all kept or all not. A null key is a class of its own and kept. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("x"))
    signed = materialize(rows.mapInArrow(sign, "k long, x long, n long, h1 long, h2 long, bands array<long>"))
    bag = ["n", "h1", "h2"]
    rep = F.struct(F.min("k").alias("k"), F.col("h1").alias("h"))
    classes = materialize(
        signed.where("n > 0 AND k IS NOT NULL").groupBy(*bag).agg(rep.alias("rep"), F.first("bands").alias("bands"))
    )
    spots = classes.select("rep", F.posexplode("bands").alias("band", "spot"))
    spots = spots.select("rep", F.xxhash64("band", "spot").alias("spot"))
    shared = materialize(spots.groupBy("spot").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = materialize(spots.join(shared, "spot").select("rep", "least"))
    reps = materialize(met.select("rep").distinct())
    # the filter is asked where the texts lie, so only texts of candidates are shuffled
    candidate = filter_of(reps, F.col("rep.k"))
    texts = rows.where(candidate(F.col("k"))).join(reps.select(F.col("rep.k").alias("k")), "k", "left_semi").dropDuplicates(["k", "x"])
    whole = texts.select("k", "t").mapInArrow(bag_rows, "k long, bag binary, h long")
    whole = materialize(whole.select(F.struct("k", "h").alias("node"), "bag"))
    pairs = met.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    left = pairs.join(whole.select(F.col("node").alias("a"), F.col("bag").alias("p")), "a")
    tried = left.join(whole.select(F.col("node").alias("b"), F.col("bag").alias("q")), "b").select("a", "b", "p", "q")
    tried = materialize(tried.mapInArrow(verify, f"a {NODE}, b {NODE}, ok boolean"))
    joined = stars(tried.where("ok"))
    of_class = classes.join(joined, F.col("rep") == F.col("u"), "left").select(*bag, F.coalesce("v", "rep").alias("c"))
    if not tried.where("NOT ok").isEmpty():
        merged = stars(late_links(tried, joined, whole).distinct())
        of_class = of_class.join(merged, F.col("c") == F.col("u"), "left").select(*bag, F.coalesce("v", "c").alias("c"))
    of_class = materialize(of_class.select(*bag, F.col("c.k").alias("class_id"), F.col("c.h").alias("g")))
    found = signed.select("k", "x", *bag).join(of_class, bag, "left").where("n > 0 AND k IS NOT NULL")
    alone = signed.where("n = 0 OR k IS NULL").select("k", "x", "n", F.col("k").alias("class_id"), F.lit(None).cast("long").alias("g"))
    same = F.coalesce(F.col("k") == F.col("class_id"), F.lit(True))
    return (
        found.select("k", "x", "n", "class_id", "g")
        .unionAll(alone)
        .select(F.col("k").alias(key), "class_id", F.col("n").alias("n_shingles"), same.alias("kept"), F.col("x").alias("text_id"), F.col("g").alias("class_hash"))
    )
