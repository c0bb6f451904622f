"""Speaker similarity: pairs, verification trials, equal error rate, calibration, enrolment."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..cluster import written
from ..functions.vec import cosine, dot, unit
from .select import carried, in_conditions, name, require, resolve_reference, usable_rows

#: Rows of a block of pairs at least, rows that one window orders, pairs for each of a cap beyond which pairs are drawn.
BLOCK_ROWS, LANE_ROWS, DRAWS = 512, 500_000, 2
#: Blocks of many rows, numbers of a block beyond which there are more, rows of either side of a tile. A row is copied
#: once for each block, so blocks are few.
BLOCKS, BLOCK_NUMBERS, TILE = 12, 2_097_152, (256, 2048)
#: Bytes of all rows up to which they are broadcast to the cells instead of copied by a shuffle.
BROADCAST = 48_000_000
#: Scores are counted on a grid of so many decimal places, in bins of 2^SHIFT points; HALF bins on either side of 0.
PLACES, SHIFT, HALF = 9, 15, 30_520


def paired_similarity(
    df: DataFrame, artifacts: DataFrame, embedding_col: str, reference_condition: str, group_col: str = "group_id", condition_col: str = "condition",
    include_reference: bool = False, carry: Iterable[str] = (), validate: bool = True, **usable,
) -> DataFrame:
    """Cosine of every utterance to its group's row of the reference condition."""
    rows = usable_rows(df, artifacts, embedding_col, **usable).withColumn("__utt", F.col("utt_id").cast("string"))
    own = F.struct(F.col("__utt").alias("id"), F.col("__vector").alias("v"))
    met = resolve_reference(rows.withColumn("__own", own), reference_condition, "__own", group_col, condition_col, validate)
    if not include_reference:
        met = met.filter(F.coalesce(name(condition_col).cast("string") != str(reference_condition), F.lit(True)))
    ids = ["utt_id", group_col, condition_col]
    return met.select(
        *[name(c) for c in [*ids, *carried(df, carry, ids)]], F.lit(reference_condition).alias("reference_condition"),
        F.col("__reference.id").alias("reference_utt_id"), cosine(F.col("__vector"), F.col("__reference.v")).alias("cosine"),
    )


def dense_index(df: DataFrame, key: str, rows: int, within: Iterable[str] = ()) -> DataFrame:
    """``__i``: 0 to n - 1, of all rows or of each group of ``within``, by hashed bucket and then key. ``rows``: about
    how many there are; no window spans more than a bucket of about LANE_ROWS of them."""
    within = list(within)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(name(key)), F.lit(max(64, rows // LANE_ROWS))))
    sizes = df.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(name(key))) - 1
    found = df.withColumn("__p", place).join(sizes.select(*within, "__bucket", before.alias("__before")), [*within, "__bucket"])
    return found.withColumn("__i", (F.col("__before") + F.col("__p")).cast("long")).drop("__bucket", "__p", "__before")


#: Columns of one side of a pair: name in the result, name in the rows.
SIDE = {"utt": "utt_id", "speaker": "__speaker", "condition": "__condition", "group": "__group"}
TRIAL = [f"{c}_{s}" for c in SIDE for s in ("a", "b")]


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    keep = SIDE | {"v": "__unit", "i": "__i"}
    return rows.select(*[F.col(c).alias(f"{k}_{s}") for k, c in keep.items()], *more)


def _capped(pairs: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """A uniform choice of at most ``cap`` pairs, the same at every run."""
    if cap is None:
        return pairs
    return pairs.orderBy(F.xxhash64(F.lit(seed), "utt_a", "utt_b"), "utt_a", "utt_b").limit(cap)


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs of (.._a, .._b) with the smaller utterance as a, each once, with their cosine."""
    swap = F.col("utt_a") > F.col("utt_b")
    sides = [F.when(swap, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in SIDE for s, t in (("a", "b"), ("b", "a"))]
    return pairs.select(*sides, dot(F.col("v_a"), F.col("v_b")).alias("cosine")).dropDuplicates(["utt_a", "utt_b"])


def _cells(rows: DataFrame, n: int, run, schema: str) -> DataFrame:
    """run for each cell (x, y) of two blocks with the rows of both; every unordered pair of rows meets in one cell.
    Few rows are packed by block and broadcast, so that a row is shuffled once and not once for each block."""
    wide = max(1, rows.agg(F.max(F.size("__unit"))).first()[0])
    most = max(BLOCK_ROWS, BLOCK_NUMBERS // wide)
    blocks = max(1, min(-(-n // BLOCK_ROWS), max(BLOCKS, -(-n // most))))
    slim = rows.select(*SIDE.values(), "__unit", F.pmod("__i", F.lit(blocks)).cast("int").alias("__block"))
    cells, columns = blocks * (blocks + 1) // 2, slim.columns
    if n * (8 * wide + 200) <= BROADCAST:
        packed = written(slim.groupBy("__block").agg(F.collect_list(F.struct(*columns)).alias("__rows")))
        side = lambda c: F.broadcast(packed.select(F.col("__block").alias(c), F.col("__rows").alias(f"__{c}")))
        pairs = slim.sparkSession.range(0, blocks * blocks, 1, min(cells, 2000)).select((F.col("id") / blocks).cast("int").alias("x"), (F.col("id") % blocks).cast("int").alias("y"))
        met = pairs.filter("x <= y").join(side("x"), "x").join(side("y"), "y")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    key = tuple(b.column(b.schema.get_field_index(c))[k] for c in ("x", "y"))
                    sides = ("__x",) if key[0] == key[1] else ("__x", "__y")
                    held = [b.column(b.schema.get_field_index(c))[k].values for c in sides]
                    yield from run(key, (pa.RecordBatch.from_arrays(h.flatten(), names=columns) for h in held))

        return met.mapInArrow(each, schema)
    copied = slim.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copied = copied.withColumn("x", F.least("__block", "__other")).withColumn("y", F.greatest("__block", "__other")).drop("__other")
    return copied.repartition(min(cells, 2000), "x", "y").groupBy("x", "y").applyInArrow(run, schema)


def _tiles(table: pa.Table, x: int, y: int, exclude_same_group: bool):
    """For each tile of a cell: positions of its rows on both sides, cosines, whether of one speaker, whether a trial,
    whether in order."""
    block = table["__block"].to_numpy()
    units = table["__unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    coded = lambda c: pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
    speakers, groups = coded("__speaker"), coded("__group")
    place = np.unique(np.array(table["utt_id"].to_pylist(), dtype=object), return_inverse=True)[1]
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    for lo in range(0, len(left), TILE[0]):
        i = left[lo : lo + TILE[0]]
        for at in range(0, len(right), TILE[1]):
            j = right[at : at + TILE[1]]
            same, ordered = speakers[i][:, None] == speakers[j], place[i][:, None] < place[j]
            # A block with itself gives each pair in its order; of two blocks each pair is met once, in either order.
            wanted = ordered if x == y else place[i][:, None] != place[j]
            if exclude_same_group:
                wanted = wanted & ~(same & (groups[i][:, None] == groups[j]))
            yield i, j, units[i] @ units[j].T, same, wanted, ordered


def _all_pairs(rows: DataFrame, n: int, exclude_same_group: bool) -> DataFrame:
    """Every unordered pair, once."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in SIDE.values()}
    schema = ", ".join([*(f"{k}_{s} {kinds[c]}" for k, c in SIDE.items() for s in ("a", "b")), "cosine double", "label boolean"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        sides = [table[c].combine_chunks() for c in SIDE.values()]
        for i, j, cosines, same, wanted, ordered in _tiles(table, key[0].as_py(), key[1].as_py(), exclude_same_group):
            p, q = np.nonzero(wanted)
            first = ordered[p, q]
            a, b = pa.array(np.where(first, i[p], j[q])), pa.array(np.where(first, j[q], i[p]))
            yield pa.RecordBatch.from_arrays([*(c.take(t) for c in sides for t in (a, b)), pa.array(cosines[p, q]), pa.array(same[p, q])], names=[*TRIAL, "cosine", "label"])

    return _cells(rows, n, meet, schema)


def _counts(rows: DataFrame, n: int, exclude_same_group: bool, within: list[int] | None = None) -> DataFrame:
    """All pairs, counted where they meet: (part, speaker, at, t, f), t of targets and f of nontargets.

    part ``bin``: trials by bin of their score; ``l``, ``hl``, ``ll``: sums of a score's place in its bin, of that times
    the bin, and of its square; ``speaker``: who is in any trial. With ``within``: ``point``, trials by score in those
    bins only."""

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        bins, sums, heard, points = np.zeros((2, 2 * HALF), np.int64), np.zeros((3, 2), np.int64), np.zeros(table.num_rows, bool), ([], [])
        for i, j, cosines, same, wanted, _ in _tiles(table, key[0].as_py(), key[1].as_py(), exclude_same_group):
            if within is None:
                heard[i] |= wanted.any(axis=1)
                heard[j] |= wanted.any(axis=0)
            known = wanted & ~np.isnan(cosines)
            for c, own in enumerate((known & same, known & ~same)):
                far = cosines[own] * 10.0**PLACES
                k = np.copysign(np.floor(np.abs(far) + 0.5), far).astype(np.int64)
                h = k >> SHIFT
                if within is not None:
                    points[c].append(k[np.isin(h, within)])
                    continue
                low = k - (h << SHIFT)
                bins[c] += np.bincount(h + HALF, minlength=2 * HALF)
                sums[:, c] += low.sum(), (h * low).sum(), (low * low).sum()
        if within is None:
            at = np.flatnonzero(bins.any(axis=0))
            speakers = pc.unique(table["__speaker"].filter(pa.array(heard)).cast(pa.string())).to_pylist()
            out = [("bin", None, int(h) - HALF, int(bins[0, h]), int(bins[1, h])) for h in at]
            out += [(part, None, 0, int(t), int(f)) for part, (t, f) in zip(("l", "hl", "ll"), sums, strict=True)] + [("speaker", s, 0, 0, 0) for s in speakers]
        else:
            counted = [dict(zip(*(x.tolist() for x in np.unique(np.concatenate(p or [np.zeros(0, np.int64)]), return_counts=True)), strict=True)) for p in points]
            out = [("point", None, k, counted[0].get(k, 0), counted[1].get(k, 0)) for k in counted[0].keys() | counted[1].keys()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "speaker", "at", "t", "f"])

    found = _cells(rows, n, fold, "part string, speaker string, at long, t long, f long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return written(found.groupBy("part", "speaker", "at").agg(total("t"), total("f")))


def _drawn_targets(rows: DataFrame, sizes: DataFrame, n: int, same: int, cap: int, other_group: Column, seed: int) -> DataFrame:
    """Pairs of one speaker: every speaker is drawn from in proportion to its pairs, whatever its size."""
    draws = F.ceil(F.lit(DRAWS * cap) * F.col("pairs") / F.lit(same)).cast("long")
    own = sizes.filter("pairs > 0").select("__speaker", F.col("count").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), draws)).alias("j"))
    first = F.pmod(F.xxhash64(F.lit(seed + 3), "__speaker", "j"), F.col("k"))
    step = F.pmod(F.xxhash64(F.lit(seed + 4), "__speaker", "j"), F.col("k") - 1) + 1
    own = own.select("__speaker", first.alias("i_a"), F.pmod(first + step, F.col("k")).alias("i_b"))
    at = dense_index(rows.drop("__i"), "utt_id", n, ["__speaker"])
    a, b = _side(at, "a"), _side(at, "b")
    met = own.join(a, (F.col("__speaker") == F.col("speaker_a")) & (own["i_a"] == a["i_a"])).drop(own["i_a"], a["i_a"])
    met = met.join(b, (F.col("__speaker") == F.col("speaker_b")) & (met["i_b"] == b["i_b"]))
    return _in_order(met.filter(other_group))


def _trial_rows(df: DataFrame, artifacts: DataFrame, embedding_col: str, speaker_col: str, conditions, group_col: str, condition_col: str, usable: dict) -> tuple[DataFrame, int]:
    """The rows that trials are made of, numbered and written, and how many there are."""
    require(df, speaker_col)
    rows = in_conditions(usable_rows(df, artifacts, embedding_col, **usable), condition_col, conditions).filter(name(speaker_col).isNotNull())
    rows = rows.select(
        F.col("utt_id").cast("string").alias("utt_id"), name(speaker_col).alias("__speaker"), (name(condition_col) if condition_col in df.columns else F.lit(None).cast("string")).alias("__condition"),
        (name(group_col) if group_col in df.columns else F.col("utt_id").cast("string")).alias("__group"), unit(F.col("__vector")).alias("__unit"),
    )
    n = rows.count()
    if n < 2:
        raise ValueError(f"{n} usable utterances; trials need two")
    return written(dense_index(rows, "utt_id", n)), n


def verification_trials(
    df: DataFrame, artifacts: DataFrame, embedding_col: str, speaker_col: str = "subject_id", conditions: Iterable | None = None, group_col: str = "group_id", condition_col: str = "condition",
    exclude_same_group: bool = True, max_target: int | None = 50_000, max_nontarget: int | None = 50_000, seed: int = 0, **usable,
) -> DataFrame:
    """Unordered pairs of utterances with cosine and label (same speaker). Pairs of one group are left out of the
    targets only. Where there are more than DRAWS times a cap of pairs, pairs are drawn instead of listed."""
    rows, n = _trial_rows(df, artifacts, embedding_col, speaker_col, conditions, group_col, condition_col, usable)
    sizes = rows.groupBy("__speaker").count().withColumn("pairs", F.expr("count * (count - 1) div 2"))
    same = sizes.agg(F.sum("pairs")).first()[0]
    different = n * (n - 1) // 2 - same
    other_group = ~F.col("group_a").eqNullSafe(F.col("group_b")) if exclude_same_group else F.lit(True)
    listed = [cap is None or pairs <= DRAWS * cap for pairs, cap in ((same, max_target), (different, max_nontarget))]
    out = []
    if listed[1]:
        both = _all_pairs(rows, n, exclude_same_group)
        if max_target is None and max_nontarget is None:
            return both
        both = written(both)
        out.append(_capped(both.filter("not label"), max_nontarget, seed))
    else:
        draws = int(DRAWS * max_nontarget * (n * (n - 1) / 2) / different) + 1000
        drawn = rows.sparkSession.range(draws).select(*[F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(n)).alias(f"i_{s}") for k, s in ((1, "a"), (2, "b"))]).distinct()
        met = drawn.join(_side(rows, "a"), "i_a").join(_side(rows, "b"), "i_b").filter(F.col("speaker_a") != F.col("speaker_b"))
        out.append(_capped(_in_order(met).withColumn("label", F.lit(False)), max_nontarget, seed))
    if not listed[0]:
        targets = _drawn_targets(rows, sizes, n, same, max_target, other_group, seed).withColumn("label", F.lit(True))
    elif listed[1]:
        targets = both.filter("label")
    else:
        a, b = _side(rows, "a"), _side(rows, "b")
        targets = _in_order(a.join(b, (F.col("speaker_a") == F.col("speaker_b")) & (F.col("utt_a") < F.col("utt_b")) & other_group)).withColumn("label", F.lit(True))
    out.append(_capped(targets, max_target, seed))
    return out[1].unionByName(out[0])


def require_targets(trials: DataFrame) -> None:
    if trials.filter("label").limit(1).count() == 0:
        raise ValueError("no pair of utterances of one speaker")


def equal_error_rate(trials: DataFrame, score_col: str = "cosine", label_col: str = "label", bins: int = 1024) -> DataFrame:
    """One row: eer, threshold, far, frr, n_target, n_nontarget. Thresholds are the scores; of equally good ones the
    smallest. Scores are counted once each; running counts go by range of score, so no window holds all of them."""
    s = trials.select(name(score_col).cast("double").alias("s"), name(label_col).cast("boolean").alias("y")).filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("y").isNotNull())
    by = written(s.groupBy("s").agg(F.sum(F.col("y").cast("long")).alias("t"), F.sum((~F.col("y")).cast("long")).alias("f")))
    span = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("t").alias("nt"), F.sum("f").alias("nf")).first()
    if not span["nt"] or not span["nf"]:
        raise ValueError("targets and nontargets are both needed")
    width = (span["hi"] - span["lo"]) or 1.0
    by = by.withColumn("bin", F.least(F.floor((F.col("s") - span["lo"]) / width * bins), F.lit(bins - 1)))
    past = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("bin").agg(F.sum("t").alias("bt"), F.sum("f").alias("bf")).select("bin", F.coalesce(F.sum("bt").over(past), F.lit(0)).alias("bt"), F.coalesce(F.sum("bf").over(past), F.lit(0)).alias("bf"))
    within = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    run = by.withColumn("pt", F.coalesce(F.sum("t").over(within), F.lit(0))).withColumn("pf", F.coalesce(F.sum("f").over(within), F.lit(0))).join(sums, "bin")
    frr = (F.col("pt") + F.col("bt")) / F.lit(span["nt"])
    far = (F.lit(span["nf"]) - F.col("pf") - F.col("bf")) / F.lit(span["nf"])
    best = run.select(F.col("s").alias("threshold"), far.alias("far"), frr.alias("frr")).agg(F.min(F.struct(F.abs(F.col("far") - F.col("frr")).alias("gap"), "threshold", "far", "frr")).alias("m"))
    return best.select(((F.col("m.far") + F.col("m.frr")) / 2).alias("eer"), "m.threshold", "m.far", "m.frr", F.lit(span["nt"]).cast("long").alias("n_target"), F.lit(span["nf"]).cast("long").alias("n_nontarget"))


def calibrate(trials: DataFrame) -> DataFrame:
    """equal_error_rate with the moments of both classes, d_prime and n_speakers, in one row. Trials are made once."""
    trials = written(trials.select("speaker_a", "speaker_b", "cosine", "label"))
    c = F.when(~F.isnan("cosine"), F.col("cosine"))
    y = F.col("label")
    m = trials.agg(
        F.avg(F.when(y, c)).alias("mu_target"), F.stddev_pop(F.when(y, c)).alias("sd_target"), F.avg(F.when(~y, c)).alias("mu_nontarget"), F.stddev_pop(F.when(~y, c)).alias("sd_nontarget"),
    )
    n = trials.select(F.explode(F.array(F.col("speaker_a").cast("string"), F.col("speaker_b").cast("string"))).alias("s")).agg(F.count_distinct("s").alias("n_speakers"))
    spread = F.sqrt((F.col("sd_target") * F.col("sd_target") + F.col("sd_nontarget") * F.col("sd_nontarget")) / 2)
    m = m.withColumn("d_prime", F.try_divide(F.col("mu_target") - F.col("mu_nontarget"), spread))
    one = lambda d: d.withColumn("__one", F.lit(1))
    return one(equal_error_rate(trials)).join(one(m), "__one").join(one(n), "__one").drop("__one")


def calibrate_all(
    df: DataFrame, artifacts: DataFrame, embedding_col: str, speaker_col: str = "subject_id", conditions: Iterable | None = None, group_col: str = "group_id", condition_col: str = "condition",
    exclude_same_group: bool = True, **usable,
) -> DataFrame:
    """calibrate over every trial of verification_trials without caps, cosines rounded to PLACES, without listing them.

    Trials are counted where they meet, by bin of their score. Scores at which the rates cross lie in one bin or the
    next that holds any; the trials of these are counted by score. Counts and moments are whole numbers, so exact."""
    rows, n = _trial_rows(df, artifacts, embedding_col, speaker_col, conditions, group_col, condition_col, usable)
    counts = _counts(rows, n, exclude_same_group)
    read = {p: [] for p in ("bin", "l", "hl", "ll")}
    for r in counts.filter("part <> 'speaker'").collect():
        read[r["part"]].append((r["at"], int(r["t"]), int(r["f"])))
    bins = sorted(read["bin"])
    nt, nf = (sum(b[c] for b in bins) for c in (1, 2))
    if not nt or not nf:
        raise ValueError("targets and nontargets are both needed")
    # False acceptance exceeds false rejection up to some score: the last bin that starts so, and the one after it.
    pt = pf = last = 0
    for at, (_, t, f) in enumerate(bins):
        if (nf - pf) * nt < pt * nf:
            break
        last, before = at, (pt, pf)
        pt, pf = pt + t, pf + f
    pt, pf = before
    best = None
    points = _counts(rows, n, exclude_same_group, [b[0] for b in bins[last : last + 2]]).collect()
    for k, t, f in sorted((r["at"], int(r["t"]), int(r["f"])) for r in points):
        far, frr = (nf - pf) / nf, pt / nt
        best = min(best or (2.0,), (abs(far - frr), k / 10**PLACES, far, frr))
        pt, pf = pt + t, pf + f
    _, threshold, far, frr = best
    moments = []
    for c, total in ((1, nt), (2, nf)):
        low, cross, square = (sum(x[c] for x in read[p]) for p in ("l", "hl", "ll"))
        one = (sum(b[0] * b[c] for b in bins) << SHIFT) + low
        two = (sum(b[0] * b[0] * b[c] for b in bins) << 2 * SHIFT) + (cross << SHIFT + 1) + square
        moments += [float(Fraction(one, total * 10**PLACES)), math.sqrt(Fraction(total * two - one * one, (total * 10**PLACES) ** 2))]
    spread = math.sqrt((moments[1] ** 2 + moments[3] ** 2) / 2)
    d_prime = (moments[0] - moments[2]) / spread if spread else None
    speakers = counts.filter("part = 'speaker' AND speaker IS NOT NULL").count()
    kinds = [*((c, "double") for c in ("eer", "threshold", "far", "frr")), ("n_target", "long"), ("n_nontarget", "long"), *((c, "double") for c in ("mu_target", "sd_target", "mu_nontarget", "sd_nontarget", "d_prime")), ("n_speakers", "long")]
    row = ((far + frr) / 2, threshold, far, frr, nt, nf, *moments, d_prime, speakers)
    return df.sparkSession.createDataFrame([row], ", ".join(f"{c} {k}" for c, k in kinds))


def calibrated_similarity(similarity: Column, calibration: dict) -> Column:
    """0 for the mean of different speakers, 1 for that of the same speaker; not cut."""
    hi, lo = calibration["mu_target"], calibration["mu_nontarget"]
    if hi is None or lo is None or not abs(hi - lo) >= 1e-12 or abs(hi - lo) == float("inf"):
        raise ValueError("the calibration does not part targets from nontargets")
    return (similarity - lo) / (hi - lo)


def accept_rate(df: DataFrame, similarity_col: str, threshold: float) -> DataFrame:
    """accept_rate, n and threshold over known similarities."""
    s = F.when(~F.isnan(name(similarity_col)), name(similarity_col))
    return df.agg(F.avg((s >= threshold).cast("double")).alias("accept_rate"), F.count(s).alias("n"), F.lit(float(threshold)).alias("threshold"))


def _speaker_rows(df: DataFrame, artifacts: DataFrame, embedding_col: str, speaker_col: str, conditions, condition_col: str, usable: dict) -> DataFrame:
    rows = in_conditions(usable_rows(df, artifacts, embedding_col, **usable), condition_col, conditions)
    return rows.filter(name(speaker_col).isNotNull()).withColumn("__unit", unit(F.col("__vector")))


def speaker_centroids(
    df: DataFrame, artifacts: DataFrame, embedding_col: str, speaker_col: str = "subject_id", conditions: Iterable | None = None, condition_col: str = "condition", min_utterances: int = 2, validate: bool = True, **usable,
) -> tuple[DataFrame, DataFrame]:
    """Enrolment: (speaker, sum, centroid, n) and the members (speaker, utt_id)."""
    require(df, speaker_col)
    rows = _speaker_rows(df, artifacts, embedding_col, speaker_col, conditions, condition_col, usable)
    members = rows.select(name(speaker_col).alias("speaker"), F.col("utt_id").cast("string").alias("utt_id"), "__unit")
    parts = members.select("speaker", F.posexplode("__unit").alias("pos", "x")).groupBy("speaker", "pos").agg(F.sum("x").alias("x"))
    total = parts.groupBy("speaker").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("sum"))
    counts = members.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))
    enrolled = total.join(counts, "speaker").filter(F.col("n") >= min_utterances).withColumn("centroid", unit(F.col("sum"))).filter(F.exists("centroid", lambda x: x != 0))
    if validate and enrolled.limit(1).count() == 0:
        raise ValueError("no speaker could be enrolled")
    return enrolled.select("speaker", "sum", "centroid", "n"), members.join(enrolled.select("speaker"), "speaker", "left_semi").select("speaker", "utt_id")


def similarity_to_centroid(
    df: DataFrame, artifacts: DataFrame, embedding_col: str, enrolment: tuple[DataFrame, DataFrame], speaker_col: str = "subject_id", conditions: Iterable | None = None, condition_col: str = "condition",
    exclude_self: bool = True, carry: Iterable[str] = (), **usable,
) -> DataFrame:
    """Cosine of every utterance to its speaker's centroid, without its own part where it was enrolled."""
    centroids, members = enrolment
    rows = _speaker_rows(df, artifacts, embedding_col, speaker_col, conditions, condition_col, usable).withColumn("__s", name(speaker_col)).withColumn("__u", F.col("utt_id").cast("string"))
    own = members.select(F.col("speaker").alias("__s"), F.col("utt_id").alias("__u"), F.lit(True).alias("__member"))
    met = rows.join(centroids.select(F.col("speaker").alias("__s"), F.col("sum").alias("__sum"), F.col("n").alias("__n")), "__s").join(own, ["__s", "__u"], "left")
    out_of = F.coalesce(F.col("__member"), F.lit(False)) if exclude_self else F.lit(False)
    rest = F.when(out_of, F.zip_with("__sum", "__unit", lambda s, x: s - x)).otherwise(F.col("__sum"))
    met = met.withColumn("__rest", rest).withColumn("__left", F.col("__n") - out_of.cast("long"))
    near_zero = ~F.exists("__rest", lambda x: F.abs(x) > 1e-12)
    void = (F.col("__left") < 1) | near_zero
    ids = ["utt_id", *[c for c in ("group_id", condition_col, speaker_col) if c in df.columns]]
    return met.select(
        *[name(c) for c in [*ids, *carried(df, carry, ids)]], F.when(void, F.lit(0)).otherwise(F.col("__left")).cast("long").alias("n_enrolment"),
        F.when(~void, cosine(F.col("__vector"), F.col("__rest"))).alias("cosine"),
    )


def without_centroid(df: DataFrame, centroids: DataFrame, speaker_col: str = "subject_id") -> DataFrame:
    """Rows of speakers that are not enrolled."""
    return df.join(centroids.select(F.col("speaker").alias("__s")), name(speaker_col) == F.col("__s"), "left_anti")
