import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvoice.llm import bpe, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        if name != "bpe":
            assert docs.columns == columns
        if name in ("quality_rules", "toxicity", "near_duplicates"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


def brute_toxic(index, space, text):
    """Score from dense vectors of all terms of the space."""
    terms, counts = space.counts(text)
    if not len(terms):
        return index.empty
    q = np.zeros(len(space))
    q[terms] = index.weights(terms, counts)
    dense = np.zeros((len(index.ids), len(space)))
    dense[np.repeat(np.arange(len(index.ids)), np.diff(index.starts)), index.terms] = index.values
    cosines = dense @ q
    best = [p for p in sorted(range(len(cosines)), key=lambda p: (-cosines[p], index.ids[p]))[: toxicity.NEIGHBOURS] if cosines[p] > 0]
    return index.calibrated(index.vote(np.array(best), cosines[best])) if best else index.empty


def test_run_against_brute_force(spark, tmp_path):
    """All stages over a small corpus with nulls, empty and repeated rows, near copies, toxic texts and one long text."""
    rng = random.Random(31)
    plain = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"word{k}" for k in range(400))]) for _ in range(n))
    rows = [(i, plain(rng.randrange(30, 80)), "en", f"s{i % 4}", 0) for i in range(160)]
    for i in range(0, 60, 3):
        rows[i] = (i, rows[i][1] + " idiot moron scum", "en", f"s{i % 4}", 0)
    for i in range(20):
        ws = rows[100 + i][1].split()
        rows.append((200 + i, " ".join([*ws[:-1], "changed"]), "en", "s1", 0))
    rows += [(300, None, "en", None, 0), (301, "", None, "s0", 0), (302, "few words", "en", "s0", 0), (303, "again " * 40, "en", "s1", 0), (304, plain(12_000), "en", "s2", 0), rows[70], rows[71]]
    d = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60 and i % 3 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, held = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        held[name] = [tuple(r) for r in docs.collect()]

    def good(text):
        ws = (text or "").split()
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        twice = Counter(windows)
        again = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
        return len(ws) >= 10 and 100 * len(again) <= 20 * len(ws)

    assert Counter(held["quality_rules"]) == Counter(r for r in rows if good(r[1]))
    first = spark.read.parquet(f"file://{tmp_path}/quality_rules")
    space, index = toxicity.fit(spark, first, spark.read.parquet(f"{d}/labels.parquet"))
    clean = [r for r in held["quality_rules"] if brute_toxic(index, space, r[1]) < 0.5]
    assert Counter(held["toxicity"]) == Counter(clean) and 0 < len(clean) < len(held["quality_rules"])
    assert not any("idiot" in r[1] for r in held["toxicity"])

    def shingles(text):
        ws = text.encode().lower().split()
        return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))

    sets = [(r[0], shingles(r[1])) for r in clean]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i][1] & sets[j][1])
            if 100 * both >= 80 * (len(sets[i][1]) + len(sets[j][1]) - both):
                root = [root[j] if x == root[i] else x for x in root]
    least = Counter({min(sets[k][0] for k in range(len(sets)) if root[k] == x) for x in set(root)})
    assert Counter(r[0] for r in held["near_duplicates"]) == least
    words = {r[0]: r[1].split() for r in held["near_duplicates"]}
    sizes, taken = Counter(), Counter()
    for r in held["near_duplicates"]:
        sizes[r[3]] += len(words[r[0]])
    for r in held["mixing"]:
        ws = iter(words[r[0]])
        assert all(w in ws for w in r[1].split()) and r[4] == len(r[1])
        taken[r[3]] += len(r[1].split())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, free = {}, set(sizes)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in sizes)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.tokenizer_path())
    want = Counter()
    for r in held["mixing"]:
        ids = library.encode(r[1], add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[(r[0], len(ids), *sha)] += 1
    assert Counter(held["bpe"]) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, d).collect()) == want
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, d)
    assert empty.count() == 0


def test_workers_get_a_text_once_and_short_batches(spark):
    """The text went to the workers twice, in batches of any size up to 64 MB."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    corpus_pipeline.prepare(spark)
    plan = toxicity.reject(spark, docs, labels)._jdf.queryExecution().analyzed().toString()
    assert "__text" not in plan

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    taken = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(taken) > 40_000_000 and max(taken) < 10_000_000
