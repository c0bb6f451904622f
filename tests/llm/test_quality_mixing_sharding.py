import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkvoice.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, row long, size long"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg\u00e9\u4e2d") for _ in range(rng.randint(1, 6)))
    out = [None, "", " \t\n", "one", "a b c d e", "#*$ %& |<> x\n#*$ %& |<> x\n\n", "w " * 50, "l1 l1\nl2\nl1 l1\n \nl1 l1", "a\x0bb\x0cc\rd\x1ce f"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(5, 40))]
        out.append(" ".join(base + (base if rng.random() < 0.4 else [])))
    out.append(" ".join(word() for _ in range(30_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c"][min(3, i % 5)], 0, True, 7, 1, 2) for i, t in enumerate(texts())]
    rows += rows[3:8] + [(None, "null id with some words in it", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def measures(text):
    t = text or ""
    ws = WORD.findall(t)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(docs):
    got = quality.document_measures(docs.select("doc_id", "text")).collect()
    want = Counter((r["doc_id"], *measures(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in got) == want


def test_rules_keep_columns_and_reject(spark, docs):
    kept = quality.apply_rules(spark, docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    for r in docs.collect():
        m = measures(r["text"])
        if m[0] < 10 or 100 * m[4] > 20 * m[0]:
            assert r["doc_id"] not in ids or r["doc_id"] is None
    assert ids


def test_a_bad_host_loses_all_documents_and_good_hosts_none(spark):
    fine = "these are ten different words that make a fine document %d"
    rows = [(i, fine % i if i % 10 or h != "bad" else fine % i, h) for h in ("good", "fair", "bad") for i in range(200)]
    rows = [(i, "short" if h == "bad" and i % 4 else t, h) for i, t, h in rows]
    measured = quality.document_measures(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = quality.judge(spark, measured).collect()
    assert all(r["kept"] for r in out if r["source"] in ("good", "fair"))
    assert not any(r["kept"] for r in out if r["source"] == "bad")


def test_quality_empty_table(spark, docs):
    assert quality.apply_rules(spark, docs.limit(0)).count() == 0


def test_sharding_law_and_slots(spark, docs):
    out = sharding.assign(spark, docs, bucket_rows=3).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_sharding_does_not_depend_on_partitions(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    key = lambda d: sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in sharding.assign(spark, d).collect())
    assert key(one.repartition(1)) == key(one.repartition(7))
    assert sharding.assign(spark, docs.limit(0)).count() == 0


def test_sharding_splits_rows_that_are_all_equal(spark):
    same = spark.range(400).selectExpr("cast(1 as long) as doc_id", "'x' as text")
    out = sharding.assign(spark, same, bucket_rows=10).collect()
    assert Counter(r["shard"] for r in out) == Counter({s: 25 for s in range(16)})


def test_fisher_yates_is_a_permutation_and_even():
    assert sorted(sharding.fisher_yates(100, 1)) == list(range(100))
    seen = Counter(tuple(sharding.fisher_yates(3, s)) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 800


def test_write_shards_round_trip(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text")
    sharding.write_shards(spark, plain, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"]) for r in plain.collect())


def targets(sizes):
    """Water filling by repetition, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pool, out, free = 1.5 * sum(sizes.values()), {}, list(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if total and pool * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: pool * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.remove(s)
        pool = 1.5 * sum(sizes.values()) - sum(out.values())


def sized(spark, docs):
    return docs.selectExpr("monotonically_increasing_id() as row", "doc_id", "source", "text").rdd.map(lambda r: (r["row"], r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")))).toDF("row long, doc_id long, source string, size long")


def test_mix_meets_targets(spark, docs):
    s = sized(spark, docs)
    rows = s.collect()
    total = Counter()
    for r in rows:
        total[r["source"]] += r["size"]
    want = targets(total)
    out = mixing.mix(spark, s)[0].collect()
    assert len(out) == len(rows)
    source = {r["row"]: r["source"] for r in rows}
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[source[r["row"]]]) and r["source_size"] == total[source[r["row"]]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["row"]]] += r["taken"]
    for s_, t in want.items():
        assert abs(taken[s_] - t) <= 4
    again = mixing.mix(spark, s)[0].collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_sainte_lague_against_a_plain_count(spark):
    sizes = {"a": 5300, "b": 2400, "c": 900, "d": 40}
    t = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = {r["sid"]: (r["target"], -(-r["source_size"] // 100)) for r in t.collect()}
    seats = mixing.apportion(t, 100, 90, 6, 1).collect()
    plain = sorted(((v / (2 * s + 1), -i) for i, (v, n) in want.items() for s in range(2 * n)), reverse=True)[:90]
    assert Counter(r["sid"] for r in seats) == Counter(-i for _, i in plain)
    assert Counter(r["shard"] for r in seats) == Counter({k: 15 for k in range(6)})


def test_mixed_documents_hold_the_taken_words(spark, docs):
    out = mixing.mixed_documents(spark, docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix(spark, sized(spark, docs))[0].collect())
    assert abs(sum(len(WORD.findall(r["text"])) for r in out.collect()) - taken) <= 8
    assert mixing.mixed_documents(spark, docs.limit(0)).count() == 0


def test_small_sources_meet_their_targets_in_large_blocks(spark):
    rng = random.Random(9)
    rows = [(f"big{k}", 500) for k in range(4) for _ in range(200)] + [("tiny", rng.randint(1, 9)) for _ in range(7)] + [("mid", 40)] * 8 + [("one", 1), ("zero", 0), (None, 130)]
    df = spark.createDataFrame([(i, i, s, n) for i, (s, n) in enumerate(rows)], "row long, doc_id long, source string, size long")
    total = Counter()
    for s, n in rows:
        total[s] += n
    want = targets(total)
    for blocks in (100, 1000, 131_072):
        out, pieces = mixing.mix(spark, df, blocks=blocks)
        taken, of_row = Counter(), {}
        for r in out.collect():
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[rows[r["row"]][0]] += r["taken"]
            of_row[r["row"]] = r["taken"]
        assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in want.items())
        words = Counter()
        for r in pieces.collect():
            assert 0 <= r["lo"] < r["hi"] <= rows[r["row"]][1]
            words[r["row"]] += (r["hi"] - r["lo"]) * r["times"]
        assert all(words[i] == n for i, n in of_row.items())


def test_mixed_documents_against_brute_force(spark):
    """Clashing columns, nulls, ties, repeated rows and a very long text; every text is made of the words taken."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(0, 30))), f"s{i % 4}", 7, 8) for i in range(60)]
    rows += [(100, None, "s0", 7, 8), (101, " \n", None, 7, 8), (None, "a b c", None, 7, 8), (3, rows[3][1], "s3", 7, 8), (200, "long " * 20_000, "s9", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, cuts long")
    out = [tuple(r) for r in mixing.mixed_documents(spark, df, blocks=50).collect()]
    assert all(r[3:] == (7, 8) for r in out)
    sized = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.size(mixing.words(F.col("text"))).cast("long").alias("size"))
    lines, pieces = mixing.mix(spark, sized, blocks=50)
    where = {r["row"]: r for r in lines.collect()}
    # Rows of one file come in order here, so the words of a row are known by its place.
    texts = {r["row"]: t for r, t in zip(sized.collect(), [(t or "").split() for _, t, *_ in rows])}
    want = Counter()
    taken = Counter()
    cuts = {}
    for p in pieces.collect():
        cuts.setdefault(p["row"], []).append((p["lo"], p["hi"], p["times"]))
        taken[p["row"]] += (p["hi"] - p["lo"]) * p["times"]
    assert {k: v["taken"] for k, v in where.items() if v["taken"]} == dict(taken)
    for row, held in cuts.items():
        for r in range(1, max(c[2] for c in held) + 1):
            ws = [w for lo, hi, times in sorted(held) if times >= r for w in texts[row][lo:hi]]
            want[(where[row]["doc_id"], tuple(ws))] += 1
    assert Counter((r[0], tuple(r[1].split())) for r in out) == want
    source = {r["row"]: r["source"] for r in sized.collect()}
    sizes, targets = Counter(), {}
    for r in where.values():
        sizes[source[r["row"]]] += r["taken"]
        targets[source[r["row"]]] = r["target"]
    assert {s: (v, targets[s]) for s, v in sizes.items() if abs(v - targets[s]) > 0.5 + 1e-9} == {}
    assert mixing.mixed_documents(spark, df.limit(0)).count() == 0
