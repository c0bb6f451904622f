import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvoice.llm import bpe, hmm, neardup, toxicity

SCHEMA = "doc_id long, text string, n long, set string, score double, label long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 0.5, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(bpe.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def check(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)
    n, ids, decoded = codec.digests([text])[0]
    assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
    assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "Hello, World's 123", "<|endoftext|>a<|startoftext|>", "\u039f\u0394\u039f\u03a3 \u0130x", "a\x1cb\x85c", "e\u0301 \u00e9", "aaaa" * 500, "!!!!....??", "</w>", "\u6f22\u5b57\U0001f642", "x" * 20_000])
def test_bpe_equals_library(codec, library, text):
    check(codec, library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=("Cs",)), max_size=60))
def test_bpe_equals_library_on_random_text(text):
    import tokenizers

    global _pair
    if "_pair" not in globals():
        _pair = bpe.Codec(bpe.read_spec(bpe.tokenizer_path())), tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    check(*_pair, text)


def test_bpe_cuts_hold_in_every_token(codec):
    for token in list(itertools.islice(codec.tokens.values(), 0, None, 97)):
        body = token.removesuffix("</w>")
        letters = {c: b for b, c in enumerate(bpe.byte_letters())}
        held = [letters[c] for c in body if c in letters]
        assert all(codec.joined[a, b] for a, b in zip(held, held[1:]))


def test_bpe_tables(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    rows = [(1, None), (2, ""), (3, "Some words here, some words there"), (3, "Some words here, some words there"), (None, "x <|endoftext|>")]
    df = frame(spark, rows)
    got = Counter(map(tuple, bpe.digests(spark, df, bpe.tokenizer_path()).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.digests(spark, df.limit(0), bpe.tokenizer_path()).count() == 0
    both = bpe.decode(spark, bpe.encode(spark, df, bpe.tokenizer_path()), bpe.tokenizer_path()).collect()
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in both)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    k, s = 3, 4
    pi, a, bt = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T
    docs = [rng.integers(0, s, n).astype(np.int16) for n in (1, 5, 3, 5)]
    pack = hmm.Packed(docs)
    got = dict(zip(pack.order, hmm.forward(pack, pi, a, bt)[0]))
    for i, d in enumerate(docs):
        p = sum(pi[z[0]] * bt[d[0], z[0]] * math.prod(a[z[t - 1], z[t]] * bt[d[t], z[t]] for t in range(1, len(d))) for z in itertools.product(range(k), repeat=len(d)))
        assert got[i] == pytest.approx(math.log10(p))


def test_expected_counts_match_enumeration():
    rng = np.random.default_rng(1)
    k, s = 2, 3
    pi, a, bt = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T
    docs = [rng.integers(0, s, n).astype(np.int16) for n in (4, 1, 3)]
    starts, moves, held = np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
    for d in docs:
        paths = {z: pi[z[0]] * bt[d[0], z[0]] * math.prod(a[z[t - 1], z[t]] * bt[d[t], z[t]] for t in range(1, len(d))) for z in itertools.product(range(k), repeat=len(d))}
        for z, p in paths.items():
            p /= sum(paths.values())
            starts[z[0]] += p
            for t in range(len(d)):
                held[d[t], z[t]] += p
                if t:
                    moves[z[t - 1], z[t]] += p
    got = hmm.expected(hmm.Packed(docs), pi, a, bt)
    for x, y in zip(got, (starts, moves, held)):
        np.testing.assert_allclose(x, y)


def test_hmm_scores(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma%d" % rng.randrange(40)]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen words"), (3, rows[3][1]), (None, "the of"), (103, "the " * 20_000)]
    df = frame(spark, rows)
    out = hmm.score(spark, df, lambda i: toxicity.id_crc(i) % 7 == 2, rounds=2).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tok = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(tok(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, t in rows:
        ws = tok(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want[(i, held(i), len(ws) + 1, sum(w in counts for w in ws) + 1, n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert hmm.score(spark, df.limit(0), lambda i: toxicity.id_crc(i) % 7 == 2).count() == 0


def test_hmm_learns_order(spark):
    rows = [(i, "a b " * 40) for i in range(30)]
    out = hmm.score(spark, frame(spark, rows), lambda i: i % 5 == 0, rounds=12).collect()
    assert all(r["score"] > 0.6 * r["base_score"] for r in out if r["held_out"])


def near_brute(rows, width, limit=80):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= limit * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids and sets[i] else d
        out[(d, len(sets[i]), c, d is not None and d == c)] += 1
    return out


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "one two three"), (7, "one two")]
    at = 10
    for size, n in ((60, 25), (200, 12), (9, 20)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randrange(max(1, size // 7))):
                own[rng.randrange(size)] = word()
            rows.append((at, " ".join(own)))
            at += 1
            base = own if rng.random() < 0.4 else base
    rows += [(at + i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(40)]
    rows += [rows[20], rows[3], (None, rows[30][1]), (None, "lonely null words"), (900, " ".join(word() for _ in range(20_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5)])
def test_near_duplicates_match_brute_force(spark, seed, width):
    rows = near_rows(seed)
    got = neardup.classes(spark, frame(spark, rows), width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == near_brute(rows, width)


def test_near_duplicates_keep_one(spark):
    rows = near_rows(3)
    df = frame(spark, rows)
    kept = neardup.keep_one(spark, df)
    assert kept.columns == df.columns
    classes_ = {c for (_, n, c, _) in near_brute(rows, 5) if n}
    empty = sum(k for (_, n, _, _), k in near_brute(rows, 5).items() if not n)
    # A component without any id has its own class in the count above only by its null id.
    assert kept.count() == len(classes_) + empty
    assert neardup.classes(spark, df.limit(0)).count() == 0


def test_signatures_under_the_threshold_share_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**32, (200, neardup.SYMBOLS), dtype=np.uint64).astype(np.uint32)
    b = a.copy()
    for row in b:
        wrong = rng.choice(neardup.SYMBOLS, 2 * neardup.CHUNKS - 1, replace=False)
        row[wrong] = rng.integers(0, 2**32, len(wrong), dtype=np.uint64).astype(np.uint32)
    x, y = neardup.keys_of(a), neardup.keys_of(b)
    assert ((x == y).any(axis=1)).all()


BAD = ["idiot", "moron", "scum"]


def toxic_rows(n=400):
    rng = random.Random(5)
    plain = lambda: [rng.choice(["the", "of", "and", "word%d" % rng.randrange(300)]) for _ in range(30)]
    docs, labels = [], []
    for i in range(n):
        ws, bad = plain(), i % 6 == 0
        if bad:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(ws)))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_rows()
    docs += [(5000, None), (5001, ""), (5002, "IDIOT " * 30_000), docs[0], (None, "the of")]
    labels += [(None, 1, 1), (9999, 1, 1), (2, None, None), (4, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r.asDict(recursive=True) for r in toxicity.score(spark, frame(spark, docs), lab).collect()]
    assert len(out) == len(docs)
    by = {r["__doc"]["doc_id"]: r for r in out}
    truth = {i: i % 6 == 0 for i in range(400)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["__predicted"] == truth[i] for i in held) and len(held) > 40
    assert by[5002]["__predicted"] == 1 and by[5000]["__predicted"] == 0 == by[5001]["__predicted"]
    assert all(0 <= r["__score"] <= 1 for r in out)
    assert by[5002]["__evidence"][0]["toxic"] == 1
    kept = toxicity.reject(spark, frame(spark, docs), lab)
    assert kept.columns == frame(spark, docs).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in by.items() if not r["__predicted"]}


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = toxic_rows(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__score"] for r in toxicity.score(spark, frame(spark, docs), none).collect()} == {0.0}
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.score(spark, frame(spark, docs).limit(0), lab).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(900):
        t = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        vectors.append((t.tolist(), rng.integers(1, 5, len(t)).tolist()))
    index = toxicity.Index(1 + rng.random(30), vectors, [0] * 900, list(range(900)), (1.0, 1.0), 0.0)
    dense = np.zeros((900, 30))
    for p in range(900):
        at = slice(index.starts[p], index.starts[p + 1])
        dense[p, index.terms[at]] = index.values[at]
    for t, c in vectors[:60]:
        q = np.zeros(30)
        q[t] = index.weights(np.array(t), c)
        cos = dense @ q
        want = np.sort(cos)[::-1][:16]
        places, got = index.nearest(np.array(t), c)
        np.testing.assert_allclose(got, want[: len(got)], atol=1e-12)
        np.testing.assert_allclose(cos[places], got, atol=1e-12)


def test_isotonic_rises():
    rng = np.random.default_rng(7)
    v = rng.random(300)
    steps = toxicity.isotonic(v.tolist(), (rng.random(300) < v).astype(int).tolist(), [1.0] * 300, 0.5)
    xs, ys = zip(*steps)
    assert list(xs) == sorted(xs) and all(0 <= y <= 1 for y in ys)


def test_toxicity_finds_neighbours_by_any_shared_word(spark):
    docs, labels = toxic_rows()
    known = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    rare = next(i for i in known if i % 6)
    texts = dict(docs)
    docs = [(i, t + " raresingleword" if i == rare else t) for i, t in docs]
    out = {r["__doc"]["doc_id"]: r["__evidence"] for r in toxicity.score(spark, frame(spark, docs + [(6000, "raresingleword"), (6001, "neverseen")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [e["doc_id"] for e in out[6000]] == [rare] and out[6001] == []
    assert all(out[i] for i in texts)


def test_toxicity_keeps_examples_that_are_no_exact_copies(spark):
    docs, labels = toxic_rows()
    known = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    texts = dict(docs)
    docs += [(8000, texts[known[0]])]
    labels += [(8000, 1, next(t for i, _, t in labels if i == known[0]))]
    index = toxicity.fit(spark, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), learns=lambda i: toxicity.id_crc(i) % 5 != 0)[1]
    assert sorted(index.ids.tolist()) == sorted(known)


def test_search_holds_few_postings_at_once():
    """64 texts over one index took more than 100 MB beside it, which two workers of an executor did not have."""
    rng = np.random.default_rng(4)
    n, v = 2000, 4000
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(v, 150, replace=False)).astype(np.int32)
        vectors.append((t, rng.integers(1, 4, len(t)).astype(np.int32)))
    ix = toxicity.Index(np.ones(v), vectors, [i % 2 for i in range(n)], list(range(n)), (1.0, 1.0), 0.0)
    queries = [(np.arange(k % 2, v, 2, dtype=np.int32), np.ones(v // 2, dtype=np.int32)) for k in range(64)]
    tracemalloc.start()
    found = ix.nearest_of(queries)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000
    for k in (0, 1):
        at = [ix.starts[:-1], ix.starts[1:]]
        cosines = np.array([ix.values[a:b][ix.terms[a:b] % 2 == k].sum() for a, b in zip(*at, strict=True)]) / np.sqrt(v // 2)
        best = np.lexsort((ix.ids, -cosines.round(12)))[: toxicity.NEIGHBOURS]
        for places, got in found[k::2]:
            np.testing.assert_allclose(got, cosines[best], atol=1e-12)
            np.testing.assert_allclose(cosines[places], got, atol=1e-12)
