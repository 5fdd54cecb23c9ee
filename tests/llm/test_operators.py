"""Each operator on a small table of awkward rows against a brute-force version."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import encoding, langid, lm, minhash, packing, quality, queries, relative, stages, suffix, toxicity, vectors
from faultline.llm.common import components, fold
from tests.compare import differences, oracle_connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use as names of their own, and more of them than documents has.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "k long, h string, t string, spans string, score string, kept string, n_words string, doc string, rep string, _null string"
)


def words(text):
    return WORD.findall(text or "")


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))

    texts = [prose(rng.randint(12, 120)) for _ in range(25)]
    passage = prose(60)
    texts += [texts[0], texts[0], texts[1].replace("a", "A", 1), prose(20) + " " + passage, passage + "\n" + prose(15), prose(9) + passage]
    near = prose(150).split(" ")
    for i in range(8):
        other = list(near)
        for _ in range(i):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts.append(" ".join(other))
    texts += [None, "", "   \n\t ", "!!! ???", "word", "one two three", "ééé 中文 ß İstanbul\x1c x y", prose(6000), "ab" * 4000, prose(5) * 9]
    texts += ["line one here\nline one here\n" + prose(30), "\x00zero\x00 byte", "<|endoftext|> and <|startoftext|>x"]
    rows = [(i, t, None if i % 11 == 10 else "xyz"[i % 3], None if i % 13 == 12 else f"s{i % 4 // 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    """All rows have extra columns; one row is there twice and one has no key."""
    rows = [*ROWS, ROWS[3], (None, ROWS[4][1], "x", "s0", 3)]
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame([(*r, *[None] * 10) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer())


def test_quality(spark, docs, nothing, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert quality.judge(docs).count() == docs.count() and quality.judge(nothing).count() == 0
    for key, text, *_ in ROWS:
        w, r = words(text), found[key]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_repeat_words == len(hit)
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_cuts_boilerplate(spark):
    line, more = "All rights reserved by nobody.", "Terms of use apply to every page that we have here."
    rows = [(i, f"{'own words of document ' + str(i)} {' '.join(f'{i}x{j}' for j in range(12))}\n{line}\n {more.upper()}", "en", "a", 1) for i in range(30)]
    rows += [(100 + i, "same copy in every document here, ten words at least\nand more", "en", "a", 1) for i in range(30)]
    rows += [(200, f"{line}\n{more}\nown", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(found[i].kept and found[i].n_lines_cut == 2 for i in range(30))
    assert all(found[100 + i].kept and found[100 + i].n_lines_cut == 0 for i in range(30))
    assert not found[200].base_failed and not found[200].kept
    clean = {r.doc_id: r.text for r in quality.cleaned(df).collect()}
    assert 200 not in clean and line not in clean[0] and clean[0] == rows[0][1].split("\n")[0]


def test_quality_counts_documents_of_every_line(spark):
    """Several boilerplate lines longer than the pages' own, and pages whose longest lines begin alike."""
    shared = [f"shared notice {j} of this host, longer than any line that a page has of its own {'x' * j}" for j in range(3)]
    rows = [(i, "\n".join([*shared, *(f"own {i} line {j} says {i * j}" for j in range(5))]), "en", "a", 1) for i in range(40)]
    rows += [(100 + i, f"short notice\nthe same beginning of a longest line, then page {i} has more words of its own", "en", "b", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(found[i].n_lines_cut == 3 and not found[i].kept for i in range(40))
    assert all(found[100 + i].n_lines_cut == 1 and found[100 + i].kept for i in range(40))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), oracle_connection(sf), queries.ORACLE_SQL[name]) == []


def test_langid(spark, docs, nothing):
    model = langid.learn(docs)
    found = langid.predict(docs, model, also=("lang",)).collect()
    assert len(found) == docs.count()
    for r in found:
        text = dict((x[0], x[1]) for x in ROWS).get(r.doc_id, ROWS[4][1])
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r.score <= 1
    assert langid.predict(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(nothing)).collect()} == {"und"}


def test_langid_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op2_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out AND lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_run_vectors_are_bound_sums():
    v, some = langid.vectors(["abab", None, "!?"])
    _, signs = langid.letters()
    a, b = signs[ord("a") % langid.LETTERS].astype(int), signs[ord("b") % langid.LETTERS].astype(int)
    aba = np.roll(a, 2) * np.roll(b, 1) * a
    bab = np.roll(b, 2) * np.roll(a, 1) * b
    whole = (aba + bab) / np.linalg.norm(aba + bab)
    assert np.allclose(v[0], whole, atol=1e-5) and some.tolist() == [True, False, False] and not v[1:].any()


def test_suffix(docs, nothing):
    found = {r.doc_id: r for r in suffix.strip(docs).collect()}
    assert suffix.strip(docs).count() == docs.count() and suffix.strip(nothing).count() == 0
    seen = set()
    for key, text, *_ in ROWS:
        raw, own = (text or "").encode(), []
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
            else:
                own.append(raw[i : i + 50])
        seen.update(own)
        left = bytes(c for c, g in zip(raw, gone) if not g)
        r = found[key]
        n_spans = len([1 for g, _ in itertools.groupby(gone) if g])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), n_spans), key
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()
    assert found[None].n_removed == len(ROWS[4][1].encode())


def test_columns_build_the_transform(tmp_path):
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(20)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    columns = suffix.Columns(str(tmp_path), text, np.cumsum([0, *map(len, strings)]))
    columns.build()
    order = sorted((s[i:], -1 if i == len(s) else 0, x, i) for x, s in enumerate(strings) for i in range(len(s) + 1))
    got = columns.read("prefix", np.uint8)
    texts = [o[0] for o in order]
    want = [0] + [len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))]) for a, b in zip(texts, texts[1:])]
    assert got.tolist() == want
    symbols = columns.read("symbol", np.uint8)
    assert Counter(symbols.tolist()) == Counter(0 if o[3] == 0 else (1 if strings[o[2]][o[3] - 1 : o[3]] == b"a" else 2) for o in order)


def test_encoding(docs, nothing, tokenizer):
    path = queries.word_tokenizer()
    found = {r.doc_id: r for r in encoding.encoded(docs, path).collect()}
    short = {r.doc_id: r for r in encoding.digests(docs, path).collect()}
    assert encoding.digests(nothing, path).count() == 0 and encoding.digests(docs, path).count() == docs.count()
    for key, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(found[key].ids) == raw and found[key].decoded == decoded
        assert short[key].n_tokens == len(ids) and short[key].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert short[key].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_tree_concatenation(tokenizer):
    from faultline.llm.bpe import Encoder

    rng, e = random.Random(8), Encoder(queries.word_tokenizer())
    for alphabet in ("thearinonst", "theari'.,!1é́中😀", "a", "'s", "0123", "é", "_-"):
        for n in (513, 1500, 4097):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert e.tree(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity(spark, docs, nothing):
    rng = random.Random(2)
    clean = [f"w{rng.randrange(300)}" for _ in range(300)]
    rows = [(i, " ".join(rng.choices(clean, k=30)) + (" dunce" if i % 3 == 0 else "")) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    index = toxicity.learn(df, labels, "doc_id % 5 = 0")
    found = {r.doc_id: r for r in toxicity.predict(df, index).collect()}
    assert all(found[i].predicted == int(i % 3 == 0) for i in range(300)) and found[900].predicted == found[901].predicted == 0
    assert all(e % 3 == 0 for e in found[30].evidence) and len(found) == 302
    assert {r.score for r in toxicity.predict(docs, toxicity.learn(nothing, labels.limit(0), "false")).collect()} == {0.0}


def test_nearest_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 12)
    rng = np.random.default_rng(4)
    n, terms = 700, 40
    rows = [(np.sort(rng.choice(terms, rng.integers(0, 9), replace=False)), None) for _ in range(n)]
    rows = [(t, rng.integers(1, 4, len(t))) for t, _ in rows]
    index = toxicity.Index(list(range(n)), rng.integers(0, 2, n), rows, np.arange(terms, dtype=np.uint64), rng.random(terms) + 1, 0.3)
    dense = np.zeros((n, terms))
    for i, (t, c) in enumerate(rows):
        dense[i, t] = (1 + np.log(c)) * index.idf[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    ends, flat = np.cumsum([0, *(len(t) for t, _ in rows)]), np.concatenate([t for t, _ in rows])
    places, cosines = index.nearest(ends, flat, index.unit(ends, flat, np.concatenate([c for _, c in rows])))
    want = dense @ dense[index.ids].T
    for i in range(n):
        assert np.allclose(cosines[i], np.sort(np.round(want[i], 9))[::-1][: toxicity.K], atol=2e-9)
        some = cosines[i] > 0
        assert np.allclose(want[i][places[i][some]], cosines[i][some], atol=2e-9)


def test_toxicity_against_all_cosines(spark):
    """Neighbours, evidence and calibrated scores from whole TF-IDF vectors, without index or blocks."""
    rng = random.Random(12)
    words_ = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts = {i: " ".join(rng.choices(words_, k=rng.randint(3, 60)) + ["fool Fools!"] * (i % 4 == 0) * rng.randint(0, 3)) for i in range(400)}
    texts |= {400: "", 401: None, 402: texts[8], 403: "qqqq"}
    toxic = {i: int(i % 4 == 0) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    index = toxicity.learn(docs, labels, "doc_id % 5 = 0")
    found = {r.doc_id: r for r in toxicity.predict(docs, index).collect()}

    def terms(text):
        out = Counter()
        for w in re.findall(r"[0-9a-z]+", (text or "").lower()):
            out.update([w, *(w[:n] for n in toxicity.PREFIXES if len(w) > n)])
        return out

    train = [i for i in toxic if i % 5]
    bags = {i: terms(t) for i, t in texts.items()}
    names = {w: j for j, w in enumerate(sorted(set().union(*(bags[i] for i in train))))}
    df = np.zeros(len(names))
    for bag in bags.values():
        df[[names[w] for w in bag if w in names]] += 1
    labelled, telling = np.array([toxic[i] for i in train]), np.zeros(len(names))
    for w, j in names.items():
        holds = np.array([w in bags[i] for i in train])
        telling[j] = abs(np.corrcoef(holds, labelled)[0, 1]) if 0 < holds.sum() < len(train) else 0.0
    matrix = np.zeros((len(texts), len(names)))
    for i, bag in bags.items():
        for w, n in bag.items():
            if w in names:
                idf = math.log((len(texts) + 1) / (df[names[w]] + 1)) + 1
                matrix[i, names[w]] = (1 + math.log(n)) * idf * (1 + toxicity.TELLING * telling[names[w]])
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    assert sorted(index.ids.tolist()) == train
    place = {k: p for p, k in enumerate(index.ids.tolist())}
    share = sum(toxic[i] for i in train) / len(train)
    scores = []
    for i in texts:
        cosine = np.round(matrix[train] @ matrix[i], 9)
        best = sorted((-c, place[k], k) for c, k in zip(cosine, train) if c > 0)[: toxicity.K]
        if not best:
            assert found[i].evidence == [] and found[i].score == pytest.approx(share)
            continue
        assert [float(matrix[i] @ matrix[k]) for k in found[i].evidence] == pytest.approx([-c for c, _, _ in best[:3]], abs=2e-9)
        votes = [(1 / (1.05 + max(c, -1.0)), toxic[k]) for c, _, k in best]
        raw = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        assert found[i].score == pytest.approx(float(np.interp(raw, *index.steps)), abs=1e-6)
        scores.append((raw, found[i].score))
    scores.sort()
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(scores, scores[1:]))
    assert {400, 401, 403} == {i for i, r in found.items() if not r.evidence}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v], i % 3, "x"))
    rows += [(400 + i, rows[0][1], 0, "x") for i in range(5)] + [(410, rows[0][1], None, "x"), (411, None, 0, "x"), (412, [0.0] * 16, 0, "x")]
    rows += [(413, [1.0, None] + [0.0] * 14, 0, "x"), (414, [math.nan] * 16, 0, "x"), (415, [math.inf] * 16, 0, "x"), (416, [], 0, "x"), (417, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    found = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(found) == len(rows) and vectors.near_vectors(df.limit(0)).count() == 0
    good = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    ids, x, y = np.array([r[0] for r in good]), np.array([r[1] for r in good]), np.array([r[2] for r in good])
    norm = np.linalg.norm(x, axis=1)
    near = ((x @ x.T) / np.outer(norm, norm) >= 0.98) & (y[:, None] == y[None, :]) & ~np.eye(len(x), dtype=bool)
    root = ids.copy()
    for _ in range(len(ids)):
        new = np.minimum(root, np.where(near, root[None, :], 10**9).min(axis=1))
        if (new == root).all():
            break
        root = new
    for i, n, c in zip(ids, near.sum(axis=1), root):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (n, c, i == c)
    for i in range(410, 418):
        assert (found[i].n_links, found[i].component_id) == (0, i)


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_minhash(docs, nothing):
    found = {r.doc_id: r for r in minhash.near_texts(docs).collect()}
    assert minhash.near_texts(docs).count() == docs.count() and minhash.near_texts(nothing).count() == 0
    bags = {r[0]: bag(r[1]) for r in ROWS}
    root = {k: k for k in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        x, y = bags[a], bags[b]
        least = (x & y).total()
        if least and least >= 0.8 * (x | y).total():
            root[max(find(a), find(b))] = min(find(a), find(b))
    for k in bags:
        assert (found[k].class_id, found[k].kept) == (find(k), k == find(k))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(6)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(0, 7, 300), rng.integers(0, 7, 300)
    same = 0.0
    for salt in range(12):
        salted = keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        both = [(salted[c > 0], c[c > 0]) for c in (x, y)]
        offsets = np.cumsum([0, *(len(b[0]) for b in both)])
        table = minhash.signatures(np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]), offsets)
        assert np.isfinite(table).all()
        same += (table[0] == table[1]).mean() / 12
    assert abs(same - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_across_finds_links_between_parts():
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41)), " ".join(f"v{i}" for i in range(40))]
    packs = list(minhash.bag_rows(iter([pa.record_batch([pa.array([1, 2, 3]), pa.array(texts)], ["k", "t"])])))[0].column(1)
    part = pa.array([{"k": k, "h": 0} for k in (1, 1, 2, 3)])
    g = pa.record_batch(
        [pa.array([9] * 4), pa.array([0] * 4), pa.array([0] * 4), pa.array([0, 1, 1, 1]), part, packs.take(pa.array([0, 0, 1, 2]))],
        ["cluster", "i", "j", "side", "c", "bag"],
    )
    assert [b.to_pydict() for b in minhash.across(iter([g]))] == [{"a": [{"k": 1, "h": 0}], "b": [{"k": 2, "h": 0}]}]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(4)
    a, b = ([f"v{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2))
    near_a, near_b = " ".join([*a[:-1], "other"]), " ".join([*b[:-1], "other"])
    a, b = " ".join(a), " ".join(b)
    rows = [(1, a), (1, b), (1, a), (2, near_a), (3, near_b), (5, b), (5, "a text of its own that is like none"), (6, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.class_id, r.kept) for r in minhash.near_texts(df).collect())
    assert found == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (5, 1, False), (5, 5, True), (6, 6, True), (6, 6, True)]
    left = sorted((r.doc_id, r.text or "") for r in stages.near_duplicates(spark, df, "").collect())
    assert left == sorted([(1, a), (1, b), (5, rows[6][1]), (6, ""), (6, "")])


def test_a_cluster_of_near_texts_in_chains(spark):
    """Texts that change word by word: most meet their bucket's smallest below the limit, so that blocks must link them."""
    rng = random.Random(8)
    text = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        text[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in minhash.near_texts(df).collect()}
    root, bags = list(range(400)), [bag(t) for _, t in rows]
    for i in range(400):
        for j in range(i):
            least = (bags[i] & bags[j]).total()
            if least >= 0.8 * (bags[i] | bags[j]).total():
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [found[i] for i in range(400)] == root


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_lm(docs, unique, nothing):
    found = {r.doc_id: r for r in lm.score(unique.withColumn("out", fold("doc_id", 5) == 1), "out").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: [*words((r[1] or "").translate(lower)), None] for r in ROWS}
    out = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(t for k in tokens if not out[k] for t in tokens[k])
    n, v = counts.total(), len(counts)
    for k, ts in tokens.items():
        r = found[k]
        want = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r.base_score - want) < 1e-6 and r.score < 0
    assert lm.score(docs.withColumn("out", F.lit(None).cast("boolean")), "out").count() == docs.count()
    assert lm.score(nothing.withColumn("out", F.lit(True)), "out").count() == 0


def test_lm_filter_grows_with_the_corpus(unique, monkeypatch):
    """Bigrams are told apart however many there are: no bound on the filters' bytes whatever the corpus."""
    monkeypatch.setattr(lm, "MOST_BYTES", 128, raising=False)
    monkeypatch.setattr(lm, "RANGE_BYTES", 4096, raising=False)
    found = {r.doc_id: r for r in lm.score(unique.withColumn("out", fold("doc_id", 5) == 1), "out").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: [*words((r[1] or "").translate(lower)), None] for r in ROWS}
    learned = [ts for k, ts in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    ones, twos = Counter(t for ts in learned for t in ts), Counter(p for ts in learned for p in zip(ts, ts[1:]))
    n, v = ones.total(), len(ones)

    def read(count, cutoff):
        return lm.middle(1 + math.floor(math.log(count / cutoff, lm.BASE) + 1e-9) if count >= cutoff else 0, cutoff)

    off = 0.0
    for k, ts in tokens.items():
        want = 0.0
        for i, t in enumerate(ts):
            uni = (read(ones[t], lm.CUTOFF[0]) + 0.5) / (n + 0.5 * (v + 1))
            if i:
                both, history = read(twos[ts[i - 1], t], lm.CUTOFF[1]), read(ones[ts[i - 1]], lm.CUTOFF[0])
                uni = lm.BIGRAM * both / max(history, both, 1.0) + (1 - lm.BIGRAM) * uni
            want += math.log10(uni)
        off += abs(found[k].score - want)
    assert off < 0.05 * sum(map(len, tokens.values()))  # false hits of a filter with room: under 1 % of probes


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 5000, len(keys))
    part = lm.spread(keys, 5)
    f = lm.Filter([lm.segment(keys[part == p], counts[part == p], 1 << 20, 1) for p in range(5)], 1)
    got = f.counts(keys)
    assert (got >= counts / lm.BASE).all() and np.median(got / counts) < 1.3
    assert (f.counts(keys + np.uint64(1)) > 0).mean() < 0.03


def test_relative(docs, nothing):
    found = {r.doc_id: r for r in relative.strip(docs).collect()}
    assert relative.strip(docs).count() == docs.count() and relative.strip(nothing).count() == 0
    seen = set()
    for key, text, *_ in ROWS:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        left = " ".join(x for x, g in zip(w, gone) if not g)
        r = found[key]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), left), key
        assert r.kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_packing(docs, unique, nothing, tokenizer):
    path = queries.word_tokenizer()
    assert packing.pack(nothing, path).count() == 0
    assert packing.pack(docs, path).agg(F.sum("length")).first()[0] == sum(
        len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect()
    )
    rows = packing.pack(unique, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(ROWS)
    for key, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(rng.exponential(40, 5000).astype(int), 127), minlength=128)
    plan = packing.solve(demand, 128)
    assert (sum(n * p for n, p in plan) == demand).all() and all(p @ np.arange(1, 129) <= 128 for _, p in plan)
    assert sum(n for n, _ in plan) <= 1.02 * demand @ np.arange(1, 129) / 128 + 1


def test_stages_keep_columns_and_effect(spark, unique, nothing):
    plain = unique.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (plain, plain.limit(0)):
        docs = df
        for stage in (stages.language_id, stages.quality_rules, stages.near_duplicates, stages.repeated_strings):
            done = stage(spark, docs, "")
            assert done.columns == docs.columns and done.count() <= docs.count()
            docs = done
        assert stages.packing(spark, docs, "").select("doc_id").distinct().count() == docs.count()
    left = {r.doc_id for r in stages.near_duplicates(spark, plain, "").collect()}
    assert 0 in left and 25 not in left and 26 not in left
    text = {r.doc_id: r.text for r in stages.repeated_strings(spark, plain, "").collect()}
    assert text[25] == "" and text[0] == ROWS[0][1] and len(text) == len(ROWS)
