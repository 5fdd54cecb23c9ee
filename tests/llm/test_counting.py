"""Collocations, token counts and the filter audit on awkward rows against brute-force versions."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import audit, collocations, queries, tokencount
from tests.compare import differences, oracle_connection
from tests.llm.test_operators import ROWS, SCHEMA, words

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def spread(spark, rows, parts=4):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA).repartition(parts)


def phrase_rows():
    """Phrases of two to four words that come often, in texts of chance; one language holds most rows."""
    rng = random.Random(8)
    chance = ["".join(rng.choice("abcde") for _ in range(2)) for _ in range(25)]
    fixed = ["New York", "in the light of", "on  the\tother hand", "by and", "É à la carte"]
    rows = []
    for i in range(160):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(fixed if rng.random() < 0.2 else chance) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " ; ", "!?"])
        lang = None if i % 16 == 0 else "und" if i % 16 == 1 else "x" if i % 3 else "y"
        rows.append((None if i % 20 == 5 else i // 2, None if i % 40 == 7 else text, lang, "s", len(text)))
    return [*rows, *ROWS, rows[3], (900, "new york " * 3000, "y", "s", 1)]


def brute_phrases(rows, support, first):
    seen, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        f = seen.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\f\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            f.update(tuple(ws[i : i + n]) for n in range(1, 5) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in seen.items():
        often = {p: n for p, n in f.items() if n >= support}
        rows = []
        for p, a in often.items():
            if len(p) == 1 or any(
                len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in often.items()
            ):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("support, first, shards", [(30, 2000, 4), (6, 2000, 4), (6, 7, 1), (3, 2000, 9)])
def test_collocations_equal_brute_force(spark, support, first, shards):
    rows = phrase_rows()
    got = collocations.collocations(spread(spark, rows), support=support, first=first, shards=shards).collect()
    want = brute_phrases(rows, support, first)
    assert sorted(map(tuple, got)) == want
    assert len(want) > 5 and {len(r[2].split(" ")) for r in want} == {2, 3, 4} or support == 30 or first == 7


def test_collocations_of_no_rows_and_no_phrases(spark):
    assert collocations.collocations(spread(spark, [], 1)).collect() == []
    assert collocations.collocations(spread(spark, [(1, None, None, None, 0), (2, ". , !", "x", None, 5)])).collect() == []


def test_lowered_support_prunes_and_full_bitmaps_change_nothing(spark, monkeypatch):
    """Fewer phrases are counted than there are, and bitmaps too small for what they hold only let more through."""
    rows = phrase_rows()
    want = brute_phrases(rows, 6, 2000)
    sizes = []
    exact = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda *a: sizes.append(exact(*a).count()) or exact(*a))
    for bits in (28, 15):
        monkeypatch.setattr(collocations, "MOST_BITS", bits)
        monkeypatch.setattr(collocations, "BITS_EACH", 16 if bits == 28 else 1)
        got = collocations.collocations(spread(spark, rows), support=6).collect()
        assert sorted(map(tuple, got)) == want
    everything = sum(len(words(r[1])) for r in rows)
    assert sizes[0] < everything and sizes[0] <= sizes[1]


def test_score_passes_64_bits(spark):
    big = 4 * 10**18
    rows = [("x", "a", big), ("x", "b", big), ("x", "a b", big - 1), ("x", "c", big), ("x", "b c", big // 2), ("x", "a b c", big // 4)]
    got = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()}
    assert got["a b"].score == 2000000 * (big - 1) // (2 * big)
    assert (got["a b c"].score, got["a b c"].l, got["a b c"].r) == min(
        (2000000 * (big // 4) // (l + r), l, r) for l, r in ((big, big // 2), (big - 1, big))
    )


ALPHABET = ["'", "'s", "'re", "'ll", "'d", "'ve", " ", "  ", "\n", "\t", "a", "s", "re", "ll", "1", "23", "!", "é", "中", " ", " "]
ALPHABET += ["\x1c", "\x85", "½", "Ⅷ", "́", "​", "😀", "<|endoftext|>", "<|endof", "text|>", "İ", "\x00", "L", "'S", "|", ">"]


def awkward_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    return texts + [r[1] for r in ROWS] + [None, "", "xy" * 60_000, " " * 3000 + "a", ("word 12 " * 400_000)]


def test_token_counts_equal_the_library(spark):
    texts = awkward_texts()
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, texts[3], None, None, 0), (5, texts[5], None, None, 0)]
    whole = Tokenizer.from_file(BYTES)
    want = sorted(
        (str(k), len((t or "").encode()), n, n > 1024)
        for (k, t, *_), n in ((r, len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    )
    docs = spread(spark, rows)
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.counts(docs, BYTES).collect()) == want
    none = tokencount.Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.counts(docs, BYTES, table=none).collect()) == want
    assert tokencount.counts(spread(spark, [], 1), BYTES).collect() == []


def test_token_table_is_bounded_and_right():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    lengths = rng.integers(1, 400, len(keys))
    table = tokencount.Lengths(keys, lengths)
    assert (table.find(keys) == lengths).all() and len(table.keys) <= 4 * len(keys)
    assert (table.find(keys + np.uint64(1)) == [dict(zip(keys.tolist(), lengths.tolist())).get(k + 1, -1) for k in keys.tolist()]).all()
    assert (table.find(np.zeros(3, np.uint64)) == -1).all()


def test_token_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    tally, texts = tokencount.Tally(BYTES), awkward_texts()[:800]
    none = tokencount.Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(2):
        for i in range(0, 800, 50):
            got = tally.count(pa.array(texts[i : i + 50]), none)
            assert got.tolist() == [len(tally.whole.encode(t, add_special_tokens=False).ids) for t in texts[i : i + 50]]
            assert len(tally.young) < 2000


def audit_rows():
    rng = random.Random(4)
    rows = list(ROWS)
    for i in range(100, 260):
        text = " ".join(rng.choice(["alpha", "beta", "Gamma", "x%", f"w{i}", f"v{rng.random()}"]) for _ in range(rng.choice([20, 199, 200, 230])))
        rows.append((i, text if i % 3 else "hot copy " * 210, None, [None, "", "a", "b"][min(3, i % 7)], 0))
    return [*rows, rows[60], (None, rows[70][1], None, "a", 0), (None, None, None, "a", 0), (400, "", None, "c", 0)]


def brute_audit(rows, labels):
    quality = {k for k, q, _ in labels if q == 1} - {None}
    toxic = {k for k, _, t in labels if t == 1} - {None}
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    parts = {}
    for k, t, _, part, _ in rows:
        t = t or ""
        ws = words(t)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": k is not None and first[t] < k,
        }
        parts.setdefault(part or "", []).append((fails, k in quality, k in toxic))
    out = []
    for part, docs in parts.items():
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                failing = sum(d[0][x] for d in docs)
                shapley[x] += len(gone)
                alone = sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                rows.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), x))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    rng = random.Random(1)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)]
    labels += [(120, 1, 0), (120, 0, 1), (None, 1, 1), (9999, 1, 1)]
    labelled = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(spread(spark, rows), labelled).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)
    assert any(r.toxic_lost for r in got) and any(r.redundant for r in got)


def test_audit_of_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spread(spark, [], 1), none).collect() == []
    got = audit.audit(spread(spark, [(1, None, None, None, 0)]), none).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.part for r in got} == {""}


def test_positional_counts_of_uneven_segments():
    rng = np.random.default_rng(0)
    segment = np.sort(rng.integers(0, 50, 5000) ** 2 % 50)
    word = rng.integers(0, 1 << 32, 5000).astype(np.uint32)
    want = np.zeros((50, 32), np.int64)
    np.add.at(want, segment, (word[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64))
    assert (audit.positional(segment, word, 50) == want).all()


@pytest.mark.parametrize("name", ["op11_collocations", "op13_audit"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), oracle_connection(sf), queries.ORACLE_SQL[name]) == []


def test_shares_of_support_lose_no_phrase():
    """The lowered support of some shard is reached by whatever reaches the support in all."""
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randint(1, 40) for _ in range(5)]
        limits = [-(-30 * x // sum(w)) for x in w]
        at_most = [x - 1 for x in limits]
        assert sum(at_most) < 30 and all(Fraction(30 * x, sum(w)) <= y for x, y in zip(w, limits))
