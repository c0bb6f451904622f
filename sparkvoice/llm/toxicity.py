"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

The labelled examples are a sample: labelled documents in hash order, whole texts, at most ``EXAMPLES`` of each class
and ``LETTERS`` characters in all, which bounds the index and what is broadcast. All words of the examples are the
vector space, with at most ``STEMMED`` word beginnings that tell the classes apart by a log-likelihood ratio; document
frequencies are counted over all documents. The square of the ratio only weighs a word, from ``FLOOR`` to 1, so every
shared word counts. Similar examples lie in one block of the index, and a term's postings hold the largest weight of each block.
The most frequent terms have a row over all examples instead, and queries a matrix product with these rows. A query's
bound of a block is its largest such sum and the maxima of the other terms; the blocks of the highest bounds are added
up first, then all others whose bound reaches the k-th cosine found, which is exact. Votes weigh by cosine distance and by how thinly a
class was sampled, and isotonic regression over the examples, each without itself, calibrates them.

Defined cases: null or empty texts, and texts that share no word with any example, get the rate of toxic examples among such
texts; labels other than 0 and 1, null ids and labels without a document are not learnt from; of several labels for an
id the largest counts, of several texts the smallest; of examples with equal texts and labels one stays; without labels
every score is 0; repeated rows are scored one by one; an empty table gives an empty table; other columns are ignored
by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, id_crc, table, tidy

#: Examples of each class and characters in all examples; word beginnings in the space; longer words in bytes go by a digest.
EXAMPLES, LETTERS, STEMMED, TERM_BYTES = 4096, 48_000_000, 1024, 64
#: Weight of a word that tells nothing about the classes.
FLOOR = 0.05
#: Lengths of word beginnings in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Examples in a block, blocks that are added up first, examples that others are laid beside.
BLOCK, FIRST, CENTRES = 256, 2, 64
#: Most frequent terms, whose postings are held as rows with a place for every example; queries that are asked together.
DENSE, ASKED = 512, 64
#: Postings, or terms in blocks, that are added up at once, and answers that a task remembers; both bound memory only.
AT_ONCE, REMEMBERED = 200_000, 10_000
NEIGHBOURS = 16
FOLDS = 5
SEED = 5
#: ASCII letters in lower case, other ASCII marks as spaces, all else untouched.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return [w if len(w) <= TERM_BYTES else b"~" + hashlib.blake2b(w, digest_size=16).digest() for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo to hi - 1 in a row, and the ranges' lengths."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n), n


class Index:
    """Unit vectors of examples, by example and inverted, with the maxima of blocks of examples."""

    def __init__(self, idf: np.ndarray, vectors, toxic: list[int], ids: list[int], importance: tuple[float, float], empty: float):
        order = sorted(range(len(vectors)), key=lambda i: ids[i])
        self.idf, self.empty, self.importance = idf, empty, importance
        self._hold(vectors, toxic, ids, order)
        # Examples lie beside those that are closest to the same one of a few.
        near, at = np.full(len(order), -1.0), np.zeros(len(order), dtype=np.int64)
        for c in range(0, len(order), max(1, -(-len(order) // CENTRES))):
            cosines = self._to(c)
            at, near = np.where(cosines > near, c, at), np.maximum(cosines, near)
        self._hold(vectors, toxic, ids, [order[i] for i in np.lexsort((-near, at))])
        self.steps: list[tuple[float, float]] = []
        self._invert()

    def _hold(self, vectors, toxic, ids, order):
        self.toxic = np.array([toxic[i] for i in order], dtype=np.int64)
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in order])]).astype(np.int64)
        self.terms = np.concatenate([np.zeros(0, np.int32), *(np.asarray(vectors[i][0], dtype=np.int32) for i in order)])
        self.counts = np.concatenate([np.zeros(0, np.int32), *(np.asarray(vectors[i][1], dtype=np.int32) for i in order)])
        self._weigh()

    def _weigh(self):
        w = np.log(self.counts)
        w += 1
        w *= self.idf[self.terms]
        norms = np.sqrt(np.add.reduceat(w * w, self.starts[:-1])) if len(self.ids) else np.zeros(0)
        w /= np.repeat(norms, np.diff(self.starts))
        self.values = w

    def _to(self, place: int) -> np.ndarray:
        """Cosines of all examples with one of them."""
        dense = np.zeros(len(self.idf))
        at = slice(self.starts[place], self.starts[place + 1])
        dense[self.terms[at]] = self.values[at]
        return np.add.reduceat(dense[self.terms] * self.values, self.starts[:-1])

    def _invert(self):
        n, v = len(self.ids), len(self.idf)
        df = np.bincount(self.terms, minlength=v)
        often = np.sort(np.argsort(-df, kind="stable")[:DENSE]) if n else np.zeros(0, np.int64)
        often = often[df[often] > n / 16]
        self.row = np.full(v, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        # Every array goes as soon as it is used: a worker has to hold the peak of this beside its share of the executor.
        places = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        at = self.row[self.terms]
        held = np.flatnonzero(at >= 0)
        self.rows = np.zeros((len(often), n))
        self.rows[at[held], places[held]] = self.values[held]
        self.edges = np.arange(0, n, BLOCK)
        by = np.flatnonzero(at < 0)
        del at, held
        by = by[np.argsort(self.terms[by], kind="stable")]
        self.places, terms = places[by], self.terms[by]
        del places
        self.weighed = self.values[by]
        del by
        block = self.places // BLOCK
        # An entry is a term in a block: a run of postings and the largest weight in it.
        first = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.cuts = np.append(first, len(terms)).astype(np.int32)
        self.peaks = np.maximum.reduceat(self.weighed, first) if len(first) else np.zeros(0)
        self.blocks = block[first]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(terms[first], minlength=v))]).astype(np.int32)

    def __getstate__(self):
        # What is broadcast leaves out all that follows from the rest.
        kept = {k: self.__dict__[k] for k in ("idf", "empty", "importance", "toxic", "ids", "starts", "terms", "counts", "steps")}
        return zlib.compress(pickle.dumps(kept), 1)

    def __setstate__(self, packed):
        self.__dict__.update(pickle.loads(zlib.decompress(packed)))
        self._weigh()
        # Searches need the inverted form only.
        del self.counts
        self._invert()
        del self.terms, self.values
        give_back()

    def weights(self, terms: np.ndarray, counts) -> np.ndarray:
        """Unit vector of a text; every term of the space has a positive idf."""
        w = (1 + np.log(np.asarray(counts, dtype=np.float64))) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, counts, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term; ties to the smaller id."""
        return self.nearest_of([(np.asarray(terms), counts)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for several queries of at least one term."""
        n, most, m = len(self.ids), len(self.edges), len(queries)
        terms = np.concatenate([q[0] for q in queries])
        if m > 1 and (self.lists[terms + 1] - self.lists[terms]).sum() > AT_ONCE:
            return self.nearest_of(queries[: m // 2], k) + self.nearest_of(queries[m // 2 :], k)
        weights = np.concatenate([self.weights(*q) for q in queries])
        asked = np.repeat(np.arange(m), [len(q[0]) for q in queries])
        row = self.row[terms]
        held = row >= 0
        dense = np.zeros((m, len(self.rows)))
        dense[asked[held], row[held]] = weights[held]
        terms, weights, asked = terms[~held], weights[~held], asked[~held]
        entries, runs = _spread(self.lists[terms], self.lists[terms + 1])
        weights, asked, block = np.repeat(weights, runs), np.repeat(asked, runs), self.blocks[entries]
        # The rows of frequent terms are added up for all examples; what the others can add to a block is bounded.
        cosines = dense @ self.rows
        bound = np.maximum.reduceat(cosines, self.edges, axis=1)
        bound += np.bincount(asked * most + block, weights * self.peaks[entries], minlength=m * most).reshape(m, most)

        def add(chosen):
            at = np.flatnonzero(chosen[asked, block])
            e = entries[at]
            ends = np.cumsum(self.cuts[e + 1] - self.cuts[e], dtype=np.int64)
            lo = 0
            # Queries of long texts meet tens of millions of postings: they are laid out a part at a time.
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                postings, length = _spread(self.cuts[e[lo:hi]], self.cuts[e[lo:hi] + 1])
                where = np.repeat(asked[at[lo:hi]] * n, length) + self.places[postings]
                cosines.ravel()[:] += np.bincount(where, np.repeat(weights[at[lo:hi]], length) * self.weighed[postings], minlength=m * n)
                lo = hi

        first = np.zeros((m, most), dtype=bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        add(first)
        least = np.zeros(m)
        for i in range(m):
            found = np.concatenate([cosines[i, lo : lo + BLOCK] for lo in self.edges[first[i]]])
            if len(found) >= k:
                least[i] = np.partition(found, len(found) - k)[len(found) - k]
        # Rounding: a block goes only where its bound is clearly below.
        add((bound >= least[:, None] - 1e-9) & ~first)
        out = []
        for i in range(m):
            hit = np.flatnonzero((cosines[i] >= least[i]) & (cosines[i] > 0))
            best = hit[np.lexsort((self.ids[hit], -cosines[i, hit]))[:k]]
            out.append((best, cosines[i, best]))
        return out

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, by closeness."""
        w = 1 / (1.05 - np.minimum(cosines, 1.0)) * np.where(self.toxic[places] == 1, self.importance[1], self.importance[0])
        return float((w * self.toxic[places]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        """The isotonic step at a vote, straight lines between steps."""
        if not self.steps:
            return vote
        x, y = zip(*self.steps, strict=True)
        return float(np.interp(vote, x, y))


def isotonic(votes: list[float], labels: list[int], weights: list[float], prior: float) -> list[tuple[float, float]]:
    """Pool adjacent violators; each step's rate is smoothed by one example at the prior rate. Steps as (vote, rate)."""
    pools: list[list[float]] = []
    for v, y, w in sorted(zip(votes, labels, weights, strict=True)):
        pools.append([w * y, w, v * w])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [(x / w, (y + prior) / (w + 1)) for y, w, x in pools]


def _stems(word: bytes):
    """Beginnings of a word, marked as such."""
    for n in STEMS:
        if len(word) > n + 1 and not word.startswith(b"~"):
            yield word[:n] + b"*"


def _unpacked(packed: bytes):
    return Space(pickle.loads(zlib.decompress(packed)))


class Space:
    """Words of the examples and chosen beginnings, as numbers. Counts them in whole texts."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: i for i, t in enumerate(terms)}
        # Beginnings in the space, by the shortest of them.
        self.begun = {t: i for t, i in self.number.items() if t.endswith(b"*") and not t.startswith(b"~")}
        self.heads = {t[: STEMS[0]] for t in self.begun}

    def __reduce__(self):
        return _unpacked, (zlib.compress(pickle.dumps([*self.number]), 1),)

    def __len__(self):
        return len(self.number)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, rising, and counts of a text's terms."""
        found, heads = Counter(terms_of(text)), self.heads
        numbers = np.fromiter(map(self.number.get, found, repeat(-1)), np.int32, len(found))
        counts = np.fromiter(found.values(), np.int32, len(found))
        held = numbers >= 0
        numbers, counts = numbers[held], counts[held]
        more: Counter = Counter()
        for w in [w for w in found if w[: STEMS[0]] in heads]:
            for t in _stems(w):
                if t in self.begun:
                    more[self.begun[t]] += found[w]
        if more:
            numbers, counts = np.append(numbers, [*more]), np.append(counts, [*more.values()])
        order = np.argsort(numbers)
        return numbers[order], counts[order]


def choose_terms(texts: list[str | None], toxic: list[int]) -> tuple[list[bytes], np.ndarray]:
    """The terms of the space and their weights by the log-likelihood ratio."""
    n = [len(toxic) - sum(toxic), sum(toxic)]
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for text, c in zip(texts, toxic, strict=True):
        own = set(terms_of(text))
        words[c].update(own)
        stems[c].update({s for w in own for s in _stems(w)})

    def ratio(terms, by):
        clean, bad = (np.array([by[c][t] for t in terms], dtype=np.float64) for c in (0, 1))
        df, whole = clean + bad, n[0] + n[1]
        out = np.zeros(len(terms))
        for seen, meant in ((bad, df * n[1]), (clean, df * n[0]), (n[1] - bad, (whole - df) * n[1]), (n[0] - clean, (whole - df) * n[0])):
            at = seen > 0
            out[at] += 2 * seen[at] * np.log(seen[at] * whole / meant[at])
        return out

    plain = sorted(words[0] | words[1])
    begun = sorted(s for s in stems[0] | stems[1] if stems[0][s] + stems[1][s] >= 3)
    g, h = ratio(plain, words), ratio(begun, stems)
    tested = len(begun) + sum(words[0][w] + words[1][w] >= 3 for w in plain)
    least = max(12.0, 2 * math.log(max(1, tested)))
    best = [i for i in np.lexsort((np.arange(len(begun)), -h))[:STEMMED] if h[i] > least]
    return plain + [begun[i] for i in best], np.maximum(FLOOR, np.minimum(1, np.append(g, h[best]) / least) ** 2)


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, learns) -> tuple[list, list[int]]:
    """Examples (id, toxic, text) by id, and the number of labelled ids of each class."""
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    known = known.filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & learns(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = scratch.table(known.withColumn("h", F.xxhash64(F.lit(SEED), "id")), "labels")
    of_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.filter(F.col("toxic") == c).orderBy("h", "id").limit(EXAMPLES) for c in (0, 1)]
    # The sample has 2 * EXAMPLES rows of three numbers at most.
    chosen = F.broadcast(scratch.table(first[0].unionByName(first[1]), "sample"))
    shown = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(chosen, "id")
    shown = shown.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("h").alias("h"))
    shown = shown.groupBy("toxic", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.min(F.struct("id", "h", "text")).alias("one"))
    shown = scratch.table(shown.select("one.id", "one.h", "toxic", F.coalesce("one.text", F.lit("")).alias("text")), "examples")
    left, held = LETTERS, []
    for r in sorted(shown.select("id", "h", F.length("text").alias("n")).collect(), key=lambda r: (r["h"], r["id"])):
        if r["n"] <= left:
            left -= r["n"]
            held.append(r["id"])
    rows = shown.filter(F.col("id").isin(held)) if len(held) < 2 * EXAMPLES and left < LETTERS // 2 else shown
    held = set(held)
    rows = [r for r in rows.select("id", "toxic", "text").toArrow().to_pylist() if r["id"] in held] if held else []
    return sorted(rows, key=lambda r: r["id"]), [of_class.get(c, 0) for c in (0, 1)]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", learns=None, folds: int = FOLDS):
    """The term space and the index, of bounded size. ``learns``: which ids may be learnt from."""
    learns = (lambda i: id_crc(i) % folds != 0) if learns is None else learns
    rows, of_class = sample(spark, docs, labels, text, doc_id, label, learns)
    toxic = [r["toxic"] for r in rows]
    rates = [of_class[c] / max(1, toxic.count(c)) for c in (0, 1)]
    terms, factors = choose_terms([r["text"] for r in rows], toxic) if rows else ([], np.zeros(0))
    space = Space(terms)
    share = spark.sparkContext.broadcast(space)

    def frequencies(batches):
        own, df, n = share.value, np.zeros(len(share.value), dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                df[own.counts(t)[0]] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, len(df)), pa.int32()), pa.array(np.append(df[met], n), pa.int64())], names=["term", "df"])

    # The last place holds the number of rows.
    seen = np.zeros(len(terms) + 1)
    if terms:
        slim = docs.select(F.col(f"`{text}`").alias("text"))
        totals = slim.mapInArrow(tidy(frequencies), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        seen[totals.column("term").to_numpy()] = totals.column("df").to_numpy()
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1) * factors
    vectors = [space.counts(r.pop("text")) for r in rows]
    give_back()
    full = [i for i, v in enumerate(vectors) if len(v[0])]
    bare = [toxic[i] for i, v in enumerate(vectors) if not len(v[0])]
    prior = of_class[1] / max(1, sum(of_class))
    empty = (rates[1] * sum(bare) + prior) / (sum(rates[c] for c in bare) + 1) if rows else 0.0
    index = Index(idf, [vectors[i] for i in full], [toxic[i] for i in full], [rows[i]["id"] for i in full], (rates[0], rates[1]), empty)
    votes, truth = [], []
    # The examples are bounded in number and length, so the driver asks each for the others.
    for lo in range(0, len(full), ASKED):
        part = range(lo, min(lo + ASKED, len(full)))
        asked = [(index.terms[a:b], index.counts[a:b]) for a, b in zip(index.starts[part], index.starts[lo + 1 :], strict=False)]
        for place, (places, cosines) in zip(part, index.nearest_of(asked, NEIGHBOURS + 1), strict=True):
            other = np.flatnonzero(places != place)[:NEIGHBOURS]
            if len(other):
                votes.append(index.vote(places[other], cosines[other]))
                truth.append(int(index.toxic[place]))
    index.steps = isotonic(votes, truth, [rates[c] for c in truth], prior)
    give_back()
    return space, index


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, **more) -> DataFrame:
    """The columns in ``keep``, then score, predicted and evidence (up to three examples) of every row."""
    keep = [doc_id] if keep is None else keep
    space, index = fit(spark, docs, labels, text, doc_id, **more)
    shared = spark.sparkContext.broadcast((space, index))
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        own, ix = shared.value
        seen: dict = {}
        for b in batches:
            texts = (b.column(0).field(inside) if inside is not None else b.column(1)).to_pylist()
            keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            if len(seen) > REMEMBERED:
                seen.clear()
            # Equal texts are asked once.
            new = [(k, own.counts(t)) for k, t in {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}.items()]
            seen.update((k, (ix.empty, [])) for k, _ in new)
            new = [x for x in new if len(x[1][0])] if len(ix.ids) else []
            for lo in range(0, len(new), ASKED):
                part = new[lo : lo + ASKED]
                for (k, _), (places, cosines) in zip(part, ix.nearest_of([q for _, q in part]), strict=True):
                    if len(places):
                        shown = [{"doc_id": int(ix.ids[p]), "cosine": float(c), "toxic": int(ix.toxic[p])} for p, c in zip(places[:3], cosines[:3], strict=True)]
                        seen[k] = (ix.calibrated(ix.vote(places, cosines)), shown)
            scores, shown = zip(*(seen[k] for k in keys), strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(shown, evidence)], names=["__doc", "__score", "__predicted", "__evidence"])

    # A text that is kept goes to the workers once, inside its row.
    inside = keep.index(text) if text in keep else None
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"), *([F.col(f"`{text}`").alias("__text")] if inside is None else []))
    kind = packed.schema["__doc"].dataType.simpleString()
    return packed.mapInArrow(tidy(run), f"__doc {kind}, __score double, __predicted int, __evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns."""
    scored = score(spark, docs, labels, keep=docs.columns)
    return scored.filter("__predicted = 0").select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: scores of all documents."""
    scored = score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("__doc.doc_id", (id_crc(F.col("__doc.doc_id")) % FOLDS == 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"), F.col("__evidence").alias("evidence"))
