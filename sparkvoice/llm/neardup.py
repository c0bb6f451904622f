"""MinHash near-duplicate detection by a multi-index Hamming join.

A text's signature is ``CHUNKS * WIDTH`` MinHash symbols of 32 bits; its distance to another is the number of places
at which they differ. Signatures are split into chunks. Two signatures that differ at fewer than 2 * CHUNKS places
have, by pigeonhole, a chunk with at most one difference, so enumerating for each chunk the place of the error gives
``CHUNKS * WIDTH`` keys, and every pair under that threshold shares a key. For texts of similarity 0.8 the chance of
sharing no key is about 2e-9. Nodes that share a key are held against a longer signature of ``FILTER`` symbols of
8 bits and go on if it differs at ``FAR`` places at most, which texts of similarity 0.8 exceed about once in 1e7.

Texts with equal sets are one node from the start. The nodes with the same key are a bucket; of buckets that hold the
same nodes one is kept. A bucket's nodes are dealt into cells of bounded size so that every two of them meet in a cell,
and a cell gives the links by longer signature that connect its nodes, not all of them. The components of these links
are families; only texts of nodes in families are read again. A family's nodes are dealt into cells in the same way,
with their whole sets, and its cells give connecting links by exact set similarity. Components come from rounds
that contract links, all as tables. What is broadcast is counted first; beyond ``common.SMALL`` bytes it is
joined by a shuffle.

Defined cases: words are lower-cased in A-Z and compared as bytes; a text with fewer words than a shingle is one
shingle as a whole; null and empty texts are empty sets and linked with nothing; repeated rows are equal sets; null ids
take part, and a component's id is the smallest id that is not null; an empty table gives an empty table. Sets hold
64-bit hashes of shingles; equal sets are recognised by 128 bits and the size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small, table, tidy

CHUNKS, WIDTH = 15, 5
SYMBOLS = CHUNKS * WIDTH
FILTER, FAR = 128, 49
#: Nodes of a block and the numbers in their sets; two blocks at most meet in a cell.
BLOCK_NODES, BLOCK_NUMBERS = 4096, 6_000_000
MEMO = 400_000
#: Odd multipliers, fixed by a seed.
_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(0, 2**63, FILTER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _RNG.integers(0, 2**63, FILTER, dtype=np.uint64)
STEP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray, key: np.uint64 = LAST) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * key
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def shingles(raw: bytes | None, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    ws = (raw or b"").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), dtype=np.uint64, count=len(ws))
    if len(h) < width:
        width = len(h)
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = mix(out * STEP + h[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """FILTER symbols; the first SYMBOLS of them make keys."""
    best = np.full(FILTER, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 512):
        best = np.minimum(best, (MULTIPLIERS[:, None] * s[None, lo : lo + 512] + ADDENDS[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """Rows of signatures to rows of keys: for each chunk and place of the error, the other symbols."""
    out = np.empty((len(sigs), SYMBOLS), dtype=np.uint64)
    for c in range(CHUNKS):
        part = sigs[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for e in range(WIDTH):
            x = np.full(len(sigs), np.uint64(c * WIDTH + e + 1))
            for k in range(WIDTH):
                if k != e:
                    x = mix(x * STEP + part[:, k])
            out[:, c * WIDTH + e] = x
    return out.view(np.int64)


def _measured(width: int, with_set: bool):
    def run(batches):
        memo = _Words()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for raw in b.column(b.num_columns - 1).to_pylist():
                s = shingles(raw, width, memo)
                cols[0].append(len(s))
                cols[1].append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                cols[2].append(int(mix(s, STEP).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                if with_set:
                    cols[3].append(s.tobytes())
                else:
                    sig = signature(s) if len(s) else None
                    cols[3].append(sig[:SYMBOLS].tobytes() if len(s) else None)
                    cols[4].append(sig.astype(np.uint8).tobytes() if len(s) else None)
            names = ["n", "f1", "f2", "set"] if with_set else ["n", "f1", "f2", "sig", "low8"]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False)]], names=[*b.schema.names[:-1], *names])

    return run


def _keys(batches):
    for b in batches:
        if b.num_rows:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, SYMBOLS)
            k = keys_of(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), SYMBOLS)), pa.array(k.ravel())], names=["gid", "key"])


def _low(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, FILTER)


def _linked(x: np.ndarray, y: np.ndarray, limit: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= limit * (len(x) + len(y) - both)


def cell_links(gid: np.ndarray, n: np.ndarray, side: np.ndarray, low: np.ndarray, sets: list[np.ndarray] | None, limit: int) -> list[tuple[int, int]]:
    """Links that connect all linked nodes of a cell, by signature alone where there are no sets. With two blocks only
    pairs across them are looked at here."""
    root = np.arange(len(gid))
    two = len(np.unique(side)) > 1
    hub = -1
    out = []

    def link(i: int, j: int) -> None:
        out.append((int(min(gid[j], gid[i])), int(max(gid[j], gid[i]))))
        root[root == root[i]] = root[j]

    def near(i: int, among: np.ndarray) -> np.ndarray:
        return (low[among] != low[i]).sum(axis=1)

    for i in range(1, len(gid)):
        fit = np.flatnonzero((100 * np.minimum(n[:i], n[i]) >= limit * np.maximum(n[:i], n[i])) & ((side[:i] != side[i]) | (not two)))
        if sets is None:
            # The smallest node that is close, so that all buckets of a family give the same links.
            lo = 0
            while lo < len(fit):
                part = fit[lo : lo + 64]
                part = part[root[part] != root[i]]
                hit = part[near(i, part) <= FAR][:1]
                if len(hit):
                    link(i, int(hit[0]))
                lo = lo if len(hit) else lo + 64
            continue
        # The node that others were linked to last is asked first, which spares most of a large component a look.
        at = np.searchsorted(fit, hub)
        if at < len(fit) and fit[at] == hub and (low[hub] != low[i]).sum() <= FAR and _linked(sets[hub], sets[i], limit):
            link(i, hub)
        while len(fit):
            # The closest by signature first: once connected, the rest of a component needs no look.
            fit = fit[root[fit] != root[i]]
            far = near(i, fit)
            fit, far = fit[far <= FAR], far[far <= FAR]
            found = next((j for j in fit[np.argsort(far, kind="stable")] if _linked(sets[j], sets[i], limit)), None)
            if found is None:
                break
            link(i, found)
            hub = int(found)
    return out


def _cells(limit: int):
    """Rows (group, cell, side, gid, n, low8[, set]), those of a cell together -> links (a, b)."""

    def links(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        gid, n, side = (t[c].to_numpy() for c in ("gid", "n", "side"))
        sets = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in t["set"]] if "set" in t.column_names else None
        found = cell_links(gid, n, side, _low(t["low8"]), sets, limit)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != at and held:
                    yield from links(held)
                    held = []
                at = keys[start]
                held.append(b.slice(start, stop - start))
                start = stop
        if held:
            yield from links(held)

    return run


def _close(limit: int):
    """Rows (a, b, n, m, low_a, low_b) -> the links (a, b) that hold by signature and size."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                n, m = (t.column(i).to_numpy() for i in (2, 3))
                near = (_low(t.column(4)) != _low(t.column(5))).sum(axis=1) <= FAR
                near &= 100 * np.minimum(n, m) >= limit * np.maximum(n, m)
                yield t.select([0, 1]).filter(pa.array(near))

    return run


def _dealt(nodes: DataFrame, group: str, cells: list[str]) -> DataFrame:
    """nodes (group, blocks, gid, ...) -> rows (group, cell, side, ``cells``), those of a cell together.

    Cell (x, y) with x <= y holds blocks x and y, so every pair of blocks, and every block by itself, has one."""
    own = nodes.withColumn("side", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    return spread.select(group, cell.alias("cell"), "side", *cells).repartition(group, "cell").sortWithinPartitions(group, "cell", "gid")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links (a, b) -> gid, label: one node of each node's component.

    A round gives every node the first of itself and its neighbours, in order of ids and of round by round hashes by
    turns, and goes on with the links between what was given, so that links become fewer with every round."""
    edges = scratch.table(links.filter("a <> b").select("a", "b").distinct(), f"{name}-0")
    labels, i = edges.select(F.col("a").alias("gid"), F.col("a").alias("label")).limit(0), 0
    while edges.limit(1).count():
        rank = (lambda c, i=i: F.struct(F.xxhash64(F.lit(i), c).alias("h"), c.alias("node"))) if i % 2 else (lambda c: F.struct(F.lit(0).alias("h"), c.alias("node")))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(rank(F.col("a")), F.col("m"))["node"].alias("up"))
        up = scratch.table(up, f"{name}-up-{i}")
        labels = up.select(F.col("node").alias("gid"), F.col("up").alias("label")) if i == 0 else labels.join(up, F.col("label") == F.col("node"), "left").select("gid", F.coalesce("up", "label").alias("label"))
        moved = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").filter("x <> y")
        i += 1
        new = scratch.table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        edges = new
    labels = scratch.table(labels, name)
    for k in range(i):
        scratch.drop(f"{name}-up-{k}")
    return labels


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids that stand in several rows, and the null id."""
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))


def families_of(scratch: Scratch, groups: DataFrame, limit: int) -> DataFrame:
    """gid, family: nodes that may be linked, by signature, and what they may be linked with."""
    keyed = groups.select("gid", "sig").mapInArrow(tidy(_keys), "gid long, key long")
    buckets = scratch.table(keyed.groupBy("key").agg(F.min("gid").alias("a"), F.max("gid").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    large = scratch.table(buckets.filter("k > 2"), "large")
    members = scratch.table(keyed.join(small(large, 32), "key"), "members")
    same = members.groupBy("key", "a", "b", "k").agg(F.bit_xor(F.xxhash64("gid")).alias("nodes")).groupBy("a", "b", "k", "nodes").agg(F.min("key").alias("key"))
    kept = scratch.table(same.select("key", F.expr(f"cast((k - 1) div {BLOCK_NODES} + 1 as int)").alias("blocks")), "kept")
    low = groups.select("gid", "n", "low8")
    dealt = _dealt(members.select("key", "gid").join(small(kept, 12), "key").join(low, "gid"), "key", ["gid", "n", "low8"])
    links = dealt.mapInArrow(tidy(_cells(limit)), "a long, b long")
    pairs = buckets.filter("k = 2").select("a", "b").distinct()
    pairs = pairs.join(low.select(F.col("gid").alias("a"), "n", F.col("low8").alias("low_a")), "a").join(low.select(F.col("gid").alias("b"), F.col("n").alias("m"), F.col("low8").alias("low_b")), "b")
    links = links.unionByName(pairs.select("a", "b", "n", "m", "low_a", "low_b").mapInArrow(tidy(_close(limit)), "a long, b long")).distinct()
    links = scratch.table(links, "near")
    for name in ("buckets", "large", "members", "kept"):
        scratch.drop(name)
    families = components(scratch, links, "families").withColumnRenamed("label", "family")
    scratch.drop("near")
    return families


def groups_of(spark: SparkSession, docs: DataFrame, width: int, limit: int, text: str, doc_id: str, row=None) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n, f1, f2) and sets of equal rows (f1, f2, n, gid, low, label, component_id)."""
    scratch = Scratch(spark, "neardup")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("raw"))
    numbered = slim.select((F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", "raw")
    rows = scratch.table(numbered.mapInArrow(tidy(_measured(width, False)), "row long, doc_id long, n long, f1 long, f2 long, sig binary, low8 binary"), "rows")
    groups = rows.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("row").alias("gid"), F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("low8").alias("low8"))
    groups = scratch.table(groups, "groups")
    families = families_of(scratch, groups, limit)
    nodes = families.join(groups.select("gid", "low", "f1", "f2", "n", "low8"), "gid")
    blocks = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("numbers"))
    blocks = blocks.select("family", F.greatest(F.expr(f"(k - 1) div {BLOCK_NODES} + 1"), F.expr(f"(numbers - 1) div {BLOCK_NUMBERS} + 1")).cast("int").alias("blocks"))
    often = scratch.table(repeated_ids(rows), "often")
    nodes = nodes.join(blocks, "family").join(often, F.col("low").eqNullSafe(F.col("__id")), "left").withColumn("once", F.col("low").isNotNull() & F.col("__id").isNull())
    nodes = scratch.table(nodes.select("gid", "family", "blocks", "once", F.col("low").alias("__low"), "f1", "f2", "n", "low8"), "nodes")
    # Only texts of nodes in families are read again: by their id where that stands in one row, else by their sets.
    ids = scratch.table(nodes.filter("once").select("__low"), "ids")
    wanted = small(ids, 16)
    found = slim if wanted is ids else slim.join(wanted, slim["doc_id"] == ids["__low"], "left_semi")
    held = ["gid", "family", "blocks", "low8"]
    kinds = "gid long, family long, blocks int, low8 binary"
    found = found.join(small(nodes.filter("once").select(*held, "__low"), 180), F.col("doc_id") == F.col("__low")).select(*held, "raw")
    sets = found.mapInArrow(tidy(_measured(width, True)), f"{kinds}, n long, f1 long, f2 long, set binary").select(*held, "n", "set")
    if often.limit(1).count():
        again = slim.join(small(often, 16), slim["doc_id"].eqNullSafe(often["__id"]), "left_semi").select("raw").mapInArrow(tidy(_measured(width, True)), "n long, f1 long, f2 long, set binary")
        again = again.filter("n > 0").groupBy("f1", "f2", "n").agg(F.first("set").alias("set"))
        sets = sets.unionByName(again.join(nodes.filter("not once").select(*held, "f1", "f2", "n"), ["f1", "f2", "n"]).select(*held, "n", "set"))
    dealt = _dealt(sets, "family", ["gid", "n", "low8", "set"])
    links = scratch.table(dealt.mapInArrow(tidy(_cells(limit)), "a long, b long"), "links")
    labels = components(scratch, links, "labels")
    named = groups.join(labels, "gid", "left").select("f1", "f2", "n", "gid", "low", F.coalesce("label", "gid").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = scratch.table(named.join(lowest, "label"), "named")
    for name in ("groups", "nodes", "ids", "often", "links"):
        scratch.drop(name)
    return rows.select("row", "doc_id", "n", "f1", "f2"), named


def classes(spark: SparkSession, docs: DataFrame, width: int = 2, limit: int = 80, text: str = "text", doc_id: str = "doc_id", row=None) -> DataFrame:
    """row, doc_id, n_shingles, label, component_id and kept of every row; links need limit percent similarity."""
    rows, named = groups_of(spark, docs, width, limit, text, doc_id, row)
    out = rows.join(named.select("f1", "f2", "n", "label", "component_id"), ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "label", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, limit: int = 80) -> DataFrame:
    """One document of each component (that of the smallest id, then the first row), and all empty ones.

    The texts are not copied: documents are told apart by their ids, and only where an id stands in several rows or is
    null also by their sets, of which one row each stays."""
    scratch = Scratch(spark, "dedup")
    rows, named = groups_of(spark, docs, width, limit, "text", "doc_id")
    found = rows.join(named.select("f1", "f2", "n", "label"), ["f1", "f2", "n"], "left")
    best = found.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "f1", "f2", "n")).alias("m")).select("m.doc_id", "m.f1", "m.f2", "m.n", "m.row")
    often = scratch.table(repeated_ids(rows), "often")
    # Documents that go: all that are not the best of their component.
    gone = found.filter("label is not null").select("doc_id", "row").join(best.select("row"), "row", "left_anti")
    gone = scratch.table(gone.select(F.col("doc_id").alias("__id")).distinct().filter("__id is not null"), "gone")
    out = docs.join(small(gone, 16), docs["doc_id"] == gone["__id"], "left_anti")
    if often.limit(1).count():
        often_ids = small(often, 16)
        out = out.join(often_ids, out["doc_id"].eqNullSafe(often["__id"]), "left_anti")
        packed = docs.join(often_ids, docs["doc_id"].eqNullSafe(often["__id"]), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").cast("binary").alias("raw"))
        kind = packed.schema["__doc"].dataType.simpleString()
        packed = packed.mapInArrow(tidy(_measured(width, False)), f"__doc {kind}, n long, f1 long, f2 long, sig binary, low8 binary")
        keep = best.select("doc_id", "f1", "f2", "n").unionByName(found.filter("label is null").select("doc_id", "f1", "f2", "n"))
        keys = keep.select(F.col("doc_id").alias("__id"), "f1", "f2", "n").distinct()
        held = packed.join(keys, ["f1", "f2", "n"]).filter(F.col("__doc.doc_id").eqNullSafe(F.col("__id")))
        first = Window.partitionBy("__id", "f1", "f2", "n").orderBy(F.col("__doc.text"))
        held = held.withColumn("__nth", F.row_number().over(first)).filter("n = 0 or __nth = 1")
        out = out.unionByName(held.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: near-duplicate classes of all documents."""
    return classes(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                              ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""
