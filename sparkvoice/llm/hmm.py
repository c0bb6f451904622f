"""Hidden Markov language model.

Words of the training documents are counted over the whole corpus. The ``OWN`` most frequent words and the end of a
text are symbols of their own; every other word is the symbol of its length class, and within a class a word has the
probability (c + 1) / (C + V + 1), the last unit standing for all unseen words. Baum-Welch trains the latent states on
the symbols of every training document: each task runs scaled forward-backward over its documents, and the expected
counts are summed across tasks. The scaled forward recursion then gives the exact likelihood of every text.

The most frequent words, ``KEPT`` at most, are broadcast with their counts, a bound that does not grow with the corpus. All other
words meet their counts in a shuffle join.

Defined cases: null and empty texts are the end alone; without training documents N = V = 0 and the model is uniform;
repeated rows are learnt from and scored one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_crc, table

STATES, OWN, KEPT, KEPT_BYTES, LENGTHS = 8, 4096, 262_144, 256, 16
ROUNDS = 3
END = OWN + LENGTHS
SYMBOLS = END + 1
FLUSH = 300_000
#: Tokens that a task recurs over at a time.
PACK = 1 << 18
SEED = 9


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case; bytes split at exactly the six separators."""
    return (raw or b"").lower().split()


def _count(batches):
    """Partial counts of words, of bounded size each."""
    counts: dict[bytes, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for raw in b.column(0).to_pylist():
            for w in tokens(raw):
                counts[w] = counts.get(w, 0) + 1
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()


class Packed:
    """Documents of one pack, longest first, their symbols in order of time."""

    def __init__(self, docs: list[np.ndarray]):
        self.order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lengths = np.array([len(docs[i]) for i in self.order])
        longest = int(lengths[0])
        # at[t]: how many documents reach time t
        self.alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        self.start = np.concatenate([[0], np.cumsum(self.alive)])
        flat = np.concatenate([docs[i] for i in self.order])
        doc = np.repeat(np.arange(len(docs)), lengths)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(flat), dtype=np.int64)
        self.symbols[self.start[time] + doc] = flat


def forward(pack: Packed, pi: np.ndarray, a: np.ndarray, bt: np.ndarray):
    """Scaled forward recursion. bt: probabilities by symbol and state. Returns log10 likelihoods in the order of the
    pack, scaled alphas, scales and the emissions."""
    emit = bt[pack.symbols]
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    for t in range(len(pack.alive)):
        lo, hi = pack.start[t], pack.start[t + 1]
        n = hi - lo
        x = (alpha[pack.start[t - 1] : pack.start[t - 1] + n] @ a if t else pi) * emit[lo:hi]
        s = x.sum(axis=1)
        scale[lo:hi] = s
        np.divide(x, s[:, None], out=alpha[lo:hi])
    logs, total = np.log10(scale), np.zeros(pack.alive[0])
    for t in range(len(pack.alive)):
        total[: pack.alive[t]] += logs[pack.start[t] : pack.start[t + 1]]
    return total, alpha, scale, emit


def expected(pack: Packed, pi, a, bt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, transitions and (symbol, state)."""
    _, alpha, scale, emit = forward(pack, pi, a, bt)
    moves = np.zeros_like(a)
    beta = np.ones((pack.alive[-1], a.shape[0]))
    for t in range(len(pack.alive) - 1, 0, -1):
        lo, hi = pack.start[t], pack.start[t + 1]
        n, before = hi - lo, pack.start[t - 1]
        back = emit[lo:hi] * beta / scale[lo:hi, None]
        moves += alpha[before : before + n].T @ back
        alpha[lo:hi] *= beta
        beta = np.ones((pack.alive[t - 1], a.shape[0]))
        beta[:n] = back @ a.T
    alpha[: pack.start[1]] *= beta
    held = np.stack([np.bincount(pack.symbols, weights=alpha[:, k], minlength=bt.shape[0]) for k in range(a.shape[0])], axis=1)
    return alpha[: pack.start[1]].sum(axis=0), moves * a, held


def _packs(items, size):
    """Groups of items of about PACK symbols, gathered from four packs at a time so that lengths are alike."""
    pool, held = [], 0
    for item in items:
        pool.append(item)
        held += size(item)
        if held >= 4 * PACK:
            yield from _cut(pool, size)
            pool, held = [], 0
    yield from _cut(pool, size)


def _cut(pool, size):
    pool.sort(key=size)
    group, held = [], 0
    for item in pool:
        if group and held + size(item) > PACK:
            yield group
            group, held = [], 0
        group.append(item)
        held += size(item)
    if group:
        yield group


class Model:
    """Start, transition and emission probabilities (by symbol and state)."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.unigram = (unigram + 1.0) / (unigram + 1.0).sum()
        self.pi = np.full(STATES, 1 / STATES)
        self.a = rng.dirichlet(np.ones(STATES), STATES)
        b = self.unigram[:, None] * np.exp(0.5 * rng.standard_normal((len(unigram), STATES)))
        self.bt = b / b.sum(axis=0)

    def update(self, starts: np.ndarray, moves: np.ndarray, held: np.ndarray) -> None:
        """New probabilities from expected counts, smoothed towards even chances and the unigram."""
        self.pi = (starts + 0.1) / (starts + 0.1).sum()
        self.a = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
        b = held + 50 * self.unigram[:, None]
        self.bt = b / b.sum(axis=0)


def train(spark: SparkSession, encoded: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of encoded (column symbols: 16-bit numbers)."""
    model = Model(unigram)
    names = [f"s{k}" for k in range(STATES)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def step(batches, shared=shared):
            m = shared.value
            starts, moves, held, rows = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)), 0
            docs = (np.frombuffer(x, dtype=np.int16) for b in batches for x in b.column(0).to_pylist())
            for group in _packs(docs, len):
                got = expected(Packed(group), m.pi, m.a, m.bt)
                starts, moves, held, rows = starts + got[0], moves + got[1], held + got[2], rows + len(group)
            if rows:
                every = np.vstack([held, moves, starts[None, :]])
                seen = np.flatnonzero(every.sum(axis=1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *[pa.array(every[seen, k]) for k in range(STATES)]], names=["at", *names])

        sums = encoded.select("symbols").mapInArrow(step, "at int, " + ", ".join(f"{n} double" for n in names))
        # SYMBOLS + STATES + 1 rows whatever the corpus.
        every = np.zeros((SYMBOLS + STATES + 1, STATES))
        for r in sums.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():
            every[r["at"]] = [r[n] for n in names]
        if not every.any():
            break
        model.update(every[-1], every[SYMBOLS:-1], every[:SYMBOLS])
        shared.unpersist()
    return model


def score(spark: SparkSession, docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``held_out``: from the column of ids, which rows are not learnt from."""
    scratch = Scratch(spark, "hmm")
    i = F.col(f"`{doc_id}`")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), i.alias("doc_id"), held_out(i).alias("held_out"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("raw"))
    learnt = slim.filter("not held_out").select("raw")
    counts = scratch.table(learnt.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    ends = slim.filter("not held_out").count()
    n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = n_words["n"] + ends, n_words["v"] + (ends > 0)
    # Words are kept from the least count on that leaves KEPT at most, found in a histogram of 64,000 steps at most.
    short = counts.filter(F.octet_length("word") <= KEPT_BYTES).withColumn("step", F.floor(F.log2("c") * 1000))
    held, least = 0, 0
    for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():
        held += r["n"]
        if held > KEPT:
            least = r["step"] + 1
            break
    best = short.filter(F.col("step") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    kept, kept_c = best["word"].to_pylist(), np.array(best["c"].to_pylist(), dtype=np.float64)
    own = min(OWN, len(kept))
    size_class = F.least(F.octet_length("word"), F.lit(LENGTHS))
    class_c, class_v = np.zeros(LENGTHS + 1), np.zeros(LENGTHS + 1)
    for r in counts.groupBy(size_class.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        class_c[r["k"]], class_v[r["k"]] = r["c"], r["v"]
    for w, c in zip(kept[:own], kept_c[:own], strict=True):
        class_c[min(len(w), LENGTHS)] -= c
        class_v[min(len(w), LENGTHS)] -= 1
    unigram = np.zeros(SYMBOLS)
    unigram[:own], unigram[OWN:END], unigram[END] = kept_c[:own], class_c[1:], ends
    # At most KEPT words of at most KEPT_BYTES bytes, and their counts.
    shared = spark.sparkContext.broadcast(({w: k for k, w in enumerate(kept)}, np.log10(kept_c + 1)))
    log_end, log_class = float(np.log10(ends + 1)), np.log10(class_c[1:] + class_v[1:] + 1)

    def encoded(batches):
        number, logs = shared.value
        symbol_of = np.array([k if k < own else OWN + min(len(w), LENGTHS) - 1 for w, k in number.items()] or [0], dtype=np.int16)
        for b in batches:
            n, known, base, tail, symbols, rare = [], [], [], [], [], []
            for raw in b.column(3).to_pylist():
                ws = tokens(raw)
                codes = np.array([number.get(w, -1) for w in ws], dtype=np.int64)
                missing = np.flatnonzero(codes < 0)
                s = np.empty(len(ws) + 1, dtype=np.int16)
                s[:-1] = symbol_of[codes]
                s[-1] = END
                lost = [ws[j] for j in missing]
                s[missing] = [OWN + min(len(w), LENGTHS) - 1 for w in lost]
                found = codes[codes >= 0]
                n.append(len(ws) + 1)
                known.append(len(found) + (ends > 0))
                base.append(float(logs[found].sum()) + log_end)
                tail.append(float(logs[found[found >= own]].sum()))
                symbols.append(s.tobytes())
                rare.append(lost)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tail, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "doc_id", "held_out", "n", "known", "base", "tail", "symbols", "rare"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    coded = scratch.table(slim.mapInArrow(encoded, f"row long, doc_id {kind}, held_out boolean, n long, known long, base double, tail double, symbols binary, rare array<binary>"), "coded")
    model = train(spark, coded.filter("not held_out"), unigram, rounds)
    shared_model = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        m = shared_model.value
        for b in batches:
            docs_ = [np.frombuffer(x, dtype=np.int16) for x in b.column(b.num_columns - 1).to_pylist()]
            out = np.zeros(len(docs_))
            for group in _packs(range(len(docs_)), lambda j, d=docs_: len(d[j])):
                pack = Packed([docs_[j] for j in group])
                got = forward(pack, m.pi, m.a, m.bt)[0]
                for place, value in zip(pack.order, got, strict=True):
                    j = group[place]
                    classes = docs_[j][(docs_[j] >= OWN) & (docs_[j] < END)] - OWN
                    out[j] = value - log_class[classes].sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "hmm"])

    plain = coded.select("row", "doc_id", "held_out", "n", "known", "base", "tail", "symbols")
    scored = plain.mapInArrow(likelihood, f"row long, doc_id {kind}, held_out boolean, n long, known long, base double, tail double, hmm double")
    met = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"), F.count("c").alias("more"))
    out = scored.join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("hmm") + F.col("tail") + logs).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the log10 likelihood of every document."""
    return score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), lambda i: id_crc(i) % 7 == 2)
