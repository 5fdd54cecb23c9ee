"""How much the operators send and work out: their results are held against brute force in test_operators.py."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import anchors, collocations, common, langid, minhash, queries, relative, stages, suffix, toxicity, words
from faultline.llm.anchors import filter_of


def test_language_of_a_field_is_told_without_a_second_copy_of_the_text(spark):
    common.importable(spark)
    texts = ["the cat sat on the mat", "die Katze saß auf der Matte", "der Hund und die Katze", None, "", "123", "the dog and the cat"]
    docs = spark.createDataFrame([(i, t, "de" if i in (1, 2) else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    found = langid.predict(docs.select(F.struct("*").alias("doc")), model, key="doc", text="doc.text")
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert {r.doc.doc_id: (r.lang_pred, r.score) for r in found.collect()} == plain and len(plain) == len(texts)
    assert "_t" not in found._jdf.queryExecution().analyzed().toString()


def test_a_task_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.record_batch([pa.array([1, 1, 2]), pa.array(["a", "b", "c"])], ["k", "t"])
    assert sum(b.num_rows for b in common.slices(iter([batch, batch]), "t", 1)) == 6 and calls == [1]
    assert sum(b.num_rows for b, _ in common.groups(iter([batch]), 1)) == 3 and calls == [1, 1]


def test_a_task_keeps_no_powers_for_the_next():
    words.powers(1 << 20)
    common.release()
    assert not len(words._grown[0]) and not len(words._grown[1])
    assert words.powers(3)[0].tolist() == [1, words._RATIO, words._RATIO**2 % 2**64]


def test_pieces_that_share_only_an_anchor_stay_out_of_the_suffix_order(monkeypatch):
    rng = random.Random(2)

    def noise(n):
        return bytes(rng.randrange(97, 123) for _ in range(n))

    def judge(a, b, shift, keys=(1, 2)):
        data = np.frombuffer(a + b, np.uint8)
        ends = np.array([0, len(a), len(a) + len(b)])
        piece, lo, hi = suffix.repeats(np.full(2, 7, np.uint64), np.array(keys), np.zeros(2), np.array([100, 200]), np.array(shift), data, ends)
        return list(zip(piece.tolist(), lo.tolist(), hi.tolist()))

    gram = noise(suffix.GRAM)
    for before in range(suffix.WINDOW - suffix.GRAM + 1):  # one window in common, with the anchor at every place in it
        window = noise(before) + gram + noise(suffix.WINDOW - suffix.GRAM - before)
        assert judge(window, b"A" + window + b"B", (before, before + 1)) == [(1, 201, 201 + suffix.WINDOW)]
        assert judge(window, window, (before, before), keys=(3, 3)) == []
    monkeypatch.setattr(suffix, "Columns", lambda *a: pytest.fail("a piece without a partner was put in order"))
    assert judge(noise(20) + gram + noise(20), noise(20) + gram + noise(20), (20, 20)) == []


def test_pieces_are_found_and_compared_little_at_a_time(monkeypatch):
    """Arrays of a step are many times as large as its text: a worker finds pieces in little text, and compares few of a bucket at once."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[i : i + 90]) if i % 3 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(90)) for i in range(300)] + ["", None, "short", " ".join(words)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(texts)], ["k", "h", "t"])

    def worked(module, judge, by_text, found, share):
        monkeypatch.setattr(anchors, "FOUND_BYTES", found)
        monkeypatch.setattr(anchors, "SHARE", share)
        read, most, total = [], [], {}

        def pieces(column):
            read.append(pa.compute.sum(pa.compute.binary_length(column)).as_py() or 0)
            return module.pieces(column)

        def judged(key, *rest):
            most.append(len(key))
            return judge(key, *rest)

        sent = list(anchors.routed(iter([batch, batch.slice(0, 0)]), pieces, lambda key: key % np.uint64(5) > 0, 3))
        sent.sort(key=lambda b: b.column(0)[0].as_py())
        for b in anchors.compared(iter(sent), judged, by_text):
            for k, h, raw in zip(*(c.to_pylist() for c in b.columns)):
                assert k == h
                total.setdefault(k, set()).update(map(tuple, np.frombuffer(raw, "<u4").reshape(-1, 2).tolist()))
        return total, len(sent), max(read), max(most)

    for module, judge, by_text in ((suffix, suffix.repeats, True), (relative, relative.parse, False)):
        whole, blobs, all_bytes, together = worked(module, judge, by_text, 1 << 30, 1 << 30)
        parts, same, most_bytes, few = worked(module, judge, by_text, 4000, 50)
        assert {k: units(v) for k, v in parts.items()} == {k: units(v) for k, v in whole.items()} and len(whole) > 100
        assert same == blobs == 3 and most_bytes <= 4000 < all_bytes and few < together


def units(found):
    return {x for a, z in found for x in range(a, z)}


def test_a_group_of_many_batches_is_put_together_once(monkeypatch):
    joined, concat = [], pa.concat_batches
    monkeypatch.setattr(common.pa, "concat_batches", lambda x: joined.append(sum(b.num_rows for b in x)) or concat(x))
    keys = [None, None, 1, 1, *[2] * 60, 3, 4, 4]
    rows = pa.record_batch([pa.array(keys, pa.int64()), pa.array(range(len(keys)))], ["k", "v"])
    for size in (1, 2, 3, 5, 100):
        cut = [rows.slice(i, size) for i in range(0, len(keys), size)]
        joined.clear()
        got = [(set(x.column(0).to_pylist()), x.column(1).to_pylist()) for b, at in common.groups(iter(cut), 1) for x in (b.slice(int(a), int(z - a)) for a, z in zip(at, at[1:]))]
        assert got == [({None}, [0, 1]), ({1}, [2, 3]), ({2}, list(range(4, 64))), ({3}, [64]), ({4}, [65, 66])]
        assert sum(joined) <= 3 * len(keys)


def test_stages_send_rows_to_workers_in_batches_of_bounded_bytes(spark):
    def largest(df):
        def sizes(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.nbytes])], ["n"])

        return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    setting = common.BATCH_SETTING
    before = spark.conf.get(setting) if setting in spark.conf.getAll else None
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('a b ', 1000) AS text")
    try:
        spark.conf.set(setting, str(8 << 20))
        stages.repeated_strings(spark, docs.limit(0), "")
        assert spark.conf.get(setting) == str(8 << 20)  # a session's own number stays
        spark.conf.unset(setting)
        assert largest(docs) > 2 * common.BATCH_BYTES
        stages.repeated_strings(spark, docs.limit(0), "")
        assert largest(docs) < 2 * common.BATCH_BYTES
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_a_filter_of_rows_lets_all_of_them_through(spark):
    common.importable(spark)
    keys = spark.range(0, 4000, 2).select(F.struct(F.col("id").alias("k")).alias("rep"))
    rows = spark.range(4000).unionAll(spark.sql("SELECT cast(NULL AS bigint)"))
    through = {r.id for r in rows.where(filter_of(keys, F.col("rep.k"))(F.col("id"))).collect()}
    assert through >= set(range(0, 4000, 2)) and len(through) < 2200
    assert rows.where(filter_of(keys.limit(0), F.col("rep.k"))(F.col("id"))).isEmpty()
    two = filter_of(spark.sql("SELECT * FROM VALUES (1L, 5L), (2L, NULL) AS t(a, b)"), F.col("a"), F.col("b"))
    assert [r.b for r in spark.sql("SELECT * FROM VALUES (1L, 5L), (1L, 6L), (2L, NULL) AS t(a, b)").where(two(F.col("a"), F.col("b"))).collect()] == [5, None]


def test_words_of_letters_are_encoded_many_at_a_time():
    from faultline.llm.bpe import JOINED, Encoder

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **more)

    rng, e = random.Random(4), Encoder(queries.word_tokenizer())
    e.short = Counted(e.short)
    words = sorted({"".join(rng.choice("abcdeéüßnrstxyzAEÖ") for _ in range(rng.randint(1, 14))) + rng.choice(["", "", ".", "!!", "(;"]) for _ in range(3000)})
    words += ["İs", "Kelvin", "it's", "x1", "a<|endoftext|>", "b" * 512, "b" * 513, "c" * 511 + "!!", "ﬁn", "é", "</w>", "a</w>"]
    texts = ["", None, " ", *(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))]
    ids, ends = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [e.full.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 0 < e.short.texts <= len(words) // JOINED + 1
    e.last[:] = False  # as of a vocabulary whose words have no last token
    e.forget()
    again, same = e.encode(pa.array(texts, pa.string()))
    assert again.tolist() == ids.tolist() and same.tolist() == ends.tolist() and e.short.texts > JOINED


def test_places_in_the_vocabulary():
    rng = np.random.default_rng(6)
    for size, top in ((0, 64), (1, 64), (2, 64), (5000, 64), (300, 9), (3000, 30)):
        vocabulary = np.unique(rng.integers(0, 2**top - 1, size, dtype=np.uint64, endpoint=True))
        key = np.concatenate([vocabulary, rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64, endpoint=True), rng.integers(0, 600, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        rng.shuffle(key)
        some, at = toxicity.found(vocabulary, key)
        assert dict(zip(some.tolist(), at.tolist())) == {i: int(np.searchsorted(vocabulary, k)) for i, k in enumerate(key) if k in vocabulary}
        assert len(some) == len(set(some.tolist()))


def test_components_of_repeated_edges_have_a_row_for_each_node(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3), (2, 4), (4, 2), (5, 6)], "a long, b long")
    assert sorted(map(tuple, common.stars(edges).collect())) == [(2, 1), (4, 1), (6, 5)]
    assert common.stars(edges.where("a = b")).isEmpty()


def test_clusters_of_failed_pairs_are_found_without_rounds_of_their_own(spark, monkeypatch):
    """Rounds write tables, each a job of every partition: only pairs that passed, and late links, are joined by rounds."""
    rng = random.Random(8)
    text, rows = [f"v{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(120):
        text[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(text)))
    runs, stars = [], common.stars
    for module in (common, minhash):
        monkeypatch.setattr(module, "stars", lambda *a: runs.append(1) or stars(*a))
    common.importable(spark)
    found = minhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == 120 and {r.class_id for r in found} == {0} and len(runs) == 2


def test_words_that_stand_in_many_small_texts_are_counted_together(spark, monkeypatch):
    """A worker looks for words in little text at once, and counts what it found in many such steps together."""
    monkeypatch.setattr(collocations, "MINED_BYTES", 64)
    texts = pa.array(["Aa bb aa bb. cc", None, "aa bb, dd", "", "bb aa bb"] * 20)
    cells = pa.array([5, 5, -6, 5, 7] * 20, pa.int64())
    batch = pa.record_batch([cells, texts], ["cell", "t"])

    def mined(level, shorter, most):
        monkeypatch.setattr(collocations, "OCCURRENCES", most)
        steps = list(collocations.miner(level, lambda: shorter)(iter([batch, batch])))
        total = Counter()
        for b in steps:
            for cell, key, n in zip(*(c.to_pylist() for c in b.columns)):
                total[cell, key] += n
        return total, sum(b.num_rows for b in steps)

    every = np.full(4096, 255, np.uint8)
    for level, expected in ((1, {5: [80, 80, 40], -6: [40, 40, 40], 7: [80, 40]}), (2, {5: [80, 40], -6: [40], 7: [40, 40]})):
        total, rows = mined(level, every, 1 << 19)
        assert rows == len(total) and total == mined(level, every, 1)[0]
        assert {c: sorted((n for (cell, _), n in total.items() if cell == c), reverse=True) for c in expected} == expected
