"""N-gram Jaccard join: MinHash buckets, Bayesian pruning, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, join_groups, minhash, multipliers, one_of_repeated, prepare, row_key, shingles, without_rows
from .components import connected_components, forest

#: Signature: BANDS buckets of ROWS hashes. At a similarity of 0.8 a pair shares no bucket with a probability of 3e-5.
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
FACTORS = multipliers(HASHES, 11)
#: Hashes compared at a time, and the posterior probability below which a pair is dropped. At a similarity of exactly 0.8
#: all five comparisons together drop 7e-6 of pairs, fewer than the buckets miss.
STEP, TOLERANCE = 16, 1e-6
#: Members of a block, and bytes of their shingle sets; two blocks meet in one unit of work.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Pairs compared at a time.
PAIRS = 1 << 17


def prune_limits(threshold: float = SIMILARITY, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m equal values among its first n is dropped.

    With a uniform prior the similarity after m of n equal values is Beta(m+1, n-m+1), and the
    probability that it is at least t is that of at most m successes of probability t in n+1 trials.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, least = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((n, least))
    return out


def surviving_pairs(left: np.ndarray, right: np.ndarray, limits, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose values, compared step by step, stay likely to reach the threshold; i < j if both sides are the same."""
    found, rows = [(np.zeros(0, np.int64),) * 2], max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + rows, len(left))), np.arange(len(right)), indexing="ij"))
        if same:
            i, j = i[i < j], j[i < j]
        equal, done = np.zeros(len(i), dtype=np.int32), 0
        for n, least in limits:
            equal = equal + (left[i, done:n] == right[j, done:n]).sum(axis=1, dtype=np.int32)
            keep = equal >= least
            i, j, equal, done = i[keep], j[keep], equal[keep], n
            if not len(i):
                break
        found.append((i, j))
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


def exact_intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at i with those at j."""
    sizes = np.array([len(s) for s in sets])
    members = np.unique(np.concatenate([i, j]))
    if len(i) * 40 < len(members) ** 2 or len(i) < 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    row = np.zeros(len(sets), dtype=np.int64)
    row[members] = np.arange(len(members))
    values, inverse = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(inverse, kind="stable")
    column, owner = inverse[order], owner[order]
    exact = np.float32 if sizes.max() < 1 << 24 else np.float64  # whole numbers that large stay exact
    product = np.zeros((len(members), len(members)), dtype=exact)
    columns = max(64, (1 << 23) // len(members))  # a block of the incidence matrix has 8 million cells
    for at in range(0, len(values), columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        block = np.zeros((len(members), min(columns, len(values) - at)), dtype=exact)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        product += block @ block.T
    return product[row[i], row[j]].astype(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x, key, sig, size)``: x tells rows of one id apart, key is 128 bits of the set of shingles, sig the MinHash values."""

    def run(batches):
        for batch in batches:
            keys, sigs, sizes = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), SHINGLE_WORDS)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sigs.append(minhash(own, FACTORS).tobytes())
                sizes.append(len(own))
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "key", "sig", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("x"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, x long, key binary, sig binary, size long")


def units(members: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Deals the members of each group into ``blocks`` blocks, and each member into a unit (bi, bj) for every block that its block meets."""
    return (
        members.withColumn("blk", F.pmod(F.xxhash64("node", *keys), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
        .drop("other", blocks)
    )


def per_unit(frame: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """Runs work(columns as lists) once per unit; a unit's rows lie together in a partition and are few (two blocks)."""
    dealt = frame.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
    nk = len(keys)

    def run(batches):
        held, key = [[] for _ in columns], None
        out = [[] for _ in names]

        def flush():
            for o, got in zip(out, work(*held), strict=True):
                o.extend(got)

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names)
            for o in out:
                o.clear()
            return batch

        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(nk)), strict=True))
            data = [batch.column(nk + k).to_pylist() for k in range(len(columns))]
            start = 0
            for at in range(1, len(ids) + 1):
                if at < len(ids) and ids[at] == ids[start]:
                    continue
                if ids[start] != key:
                    if key is not None:
                        flush()
                    key, held = ids[start], [[] for _ in columns]
                for h, d in zip(held, data, strict=True):
                    h.extend(d[start:at])
                start = at
            if len(out[0]) >= 20_000:
                yield emit()
        if key is not None:
            flush()
        yield emit()

    return dealt.mapInArrow(run, schema)


def _split(blk: list[int], bi: int, bj: int) -> tuple[np.ndarray, np.ndarray]:
    blk = np.array(blk)
    return np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)


def _unit_pairs(blk, bi, bj, sig, limits):
    """Pairs of a unit's rows, as row numbers, that pass the incremental comparison."""
    sigs = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(len(sig), HASHES)
    a, b = _split(blk, bi, bj)
    if bi == bj:
        i, j = surviving_pairs(sigs[a], sigs[a], limits, True)
        return sigs, a[i], a[j]
    i, j = surviving_pairs(sigs[a], sigs[b], limits, False)
    return sigs, a[i], b[j]


def _ranked_forest(node: list[int], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, their places in the list, and for each (in order) the place in order of the least node that links i-j connect it with."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), dtype=np.int64)
    rank[order] = np.arange(len(node))
    return np.array(node, dtype=np.int64)[order], order, forest(len(node), rank[i], rank[j])


def _joined(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, x, rep, copies, class_id, n_links, node, root)``, and the links between nodes."""
    prepare(docs.sparkSession)
    limits = prune_limits(threshold)
    sketch = sketches(docs, id_col, text_col).checkpoint()
    classes = (
        sketch.groupBy("key", "sig", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min(F.when(F.col("id").isNull(), F.col("x"))).alias("x"))
        .withColumn("node", F.monotonically_increasing_id()).checkpoint()
    )
    n_classes = classes.count()

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring("sig", b * 4 * ROWS + 1, F.lit(4 * ROWS)), b)))
    buckets = classes.select("node", band.alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = join_groups(buckets, crowded, "bucket", "m", n_classes * BANDS, ["node"]).select("node", "bucket", F.ceil(F.col("m") / F.lit(BLOCK)).alias("nb"))
    signed = units(members, ["bucket"], "nb").join(classes.select("node", "sig"), "node")

    def candidate_forest(bi, bj, blk, node, sig):
        _, i, j = _unit_pairs(blk, bi[0], bj[0], sig, limits)
        ids, _, root = _ranked_forest(node, i, j)
        linked = np.flatnonzero(root != np.arange(len(ids)))
        return ids[linked].tolist(), ids[root[linked]].tolist()

    unit_keys = ["bucket", "bi", "bj"]
    rough = per_unit(signed.withColumns({"i": F.col("bi"), "j": F.col("bj")}), unit_keys, ["i", "j", "blk", "node", "sig"], candidate_forest, "a long, b long")
    rough = connected_components(rough).checkpoint()

    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") * 8 / F.lit(BLOCK_BYTES)))
    groups = rough.join(classes.select("node", "size"), "node").groupBy("root").agg(blocks.alias("nb"), F.count("*").alias("m"))
    placed = join_groups(rough, groups, "root", "m", n_classes, ["node"]).drop("m").checkpoint()
    wanted = placed.join(classes.select("node", "sig", "copies", "key", "rep", "x"), "node")

    def with_sets(batches):
        for batch in batches:
            own = [shingles(t.as_py(), SHINGLE_WORDS) for t in batch.column("text")]
            keep = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == k.as_py() for s, k in zip(own, batch.column("key"), strict=True)], pa.bool_())
            kept = batch.drop_columns(["text", "key"]).append_column("set", pa.array([s.tobytes() for s in own], pa.binary()))
            yield kept.filter(keep)

    # A class is read from a row that has its least id; one of rows without ids, from a row with its least x.
    no_id = F.col("id").isNull()
    place = lambda i, x: [F.coalesce(F.col(i), F.lit(0)).alias("at"), F.col(i).isNull().alias("blank"), F.when(F.col(i).isNull(), F.col(x)).otherwise(0).alias("which")]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("x", F.when(no_id, row_key("text")))
    described = (
        texts.select("text", *place("id", "x"))
        .join(wanted.select("node", "root", "nb", "sig", "copies", "key", *place("rep", "x")), ["at", "blank", "which"])
        .select("node", "root", "nb", "sig", "copies", "key", "text")
        .mapInArrow(with_sets, "node long, root long, nb long, sig binary, copies long, set binary")
    )

    def verified(bi, bj, blk, node, sig, copies, sets):
        first = {}
        for k, r in enumerate(node):  # rows that repeat an id and the text
            first.setdefault(r, k)
        if len(first) < len(node):
            keep = sorted(first.values())
            bi, bj, blk, node, sig, copies, sets = ([x[k] for k in keep] for x in (bi, bj, blk, node, sig, copies, sets))
        _, i, j = _unit_pairs(blk, bi[0], bj[0], sig, limits)
        links = np.zeros(len(node), dtype=np.int64)
        if len(i):
            own = [np.frombuffer(s, dtype=np.uint64) for s in sets]
            size = np.array([len(s) for s in own])
            both = exact_intersections(own, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            weight = np.array(copies, dtype=np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
        ids, order, root = _ranked_forest(node, i, j)
        out = np.flatnonzero((links[order] > 0) | (root != np.arange(len(node))))
        return ids[out].tolist(), ids[root[out]].tolist(), links[order][out].tolist()

    found = per_unit(
        units(described, ["root"], "nb").withColumns({"i": F.col("bi"), "j": F.col("bj")}), ["root", "bi", "bj"], ["i", "j", "blk", "node", "sig", "copies", "set"], verified,
        "a long, b long, n long",
    ).checkpoint()
    links = found.where("a != b").select("a", "b")
    final = connected_components(links).checkpoint()
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    linked = final.join(counts, "node").join(classes.select("node", "rep"), "node")
    heads = linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("m"))
    linked = join_groups(linked, heads, "root", "m", n_classes, ["node"]).select("node", "root", "class_id", "near").checkpoint()
    described_classes = (
        classes.select("key", "node", "rep", "copies").join(linked, "node", "left")
        .select("key", "node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return join_groups(sketch.select("id", "x", "key"), described_classes, "key", "copies", sketch.count(), ["id", "x"]).drop("key"), links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> dict[str, DataFrame]:
    """The self-join of documents on the Jaccard similarity of their word 5-gram sets.

    Returns ``documents`` (one row per input row: id, ``rep_id``, ``copies``, ``class_id``,
    ``n_links``, ``node``) and ``links`` (``a, b``: a spanning forest of the verified links between
    nodes). Documents with equal shingle sets are one node with the smallest id as its
    representative; ``class_id`` is the least representative that verified links lead to, and
    ``n_links`` the number of other documents with a similarity of ``threshold`` or more, copies
    included. Nothing expands copies or a group into all its pairs.

    1. One pass over the texts gives each a set key and 80 MinHash values; equal keys collapse.
    2. Nodes that share one of 20 buckets of 4 values are compared in units of two blocks of 256
       members at most: values 16 at a time, and a pair goes when the posterior probability of
       reaching the threshold is below 1e-6. Only a spanning forest of the surviving pairs leaves a unit.
    3. Components of these forests are dealt into units again, now with their shingle sets (blocks of
       16 MB on average at most), and each pair that survives is verified exactly; units give link
       counts and a forest.
    4. Components of the verified forests are the classes.

    A bucket or component with very many members is many units, never one task's list, and keys that
    very many rows share are joined in pieces (:func:`join_groups`). Texts may be of any length that
    a row holds. Null and empty texts have one shingle (of no words) and so are copies of one another;
    texts under five words have one shingle of all their words. Rows that repeat an id are documents of
    their own. Rows with a null id take part like all others, but never represent a class unless it has
    no other row (their class_id is then null). An empty table gives no rows.
    """
    rows, links = _joined(docs, id_col, text_col, threshold)
    return {"documents": rows.select(F.col("id").alias(id_col), F.col("rep").alias("rep_id"), "copies", "class_id", "n_links", "node"), "links": links}


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class stays, with all its columns: that with the least id.

    Rows go by their own id and text: another row with the id of a near copy stays, and so does a row
    without an id that resembles no other. Of rows with the least id (or all without one) in a class,
    one stays. An empty table gives no rows.
    """
    rows = _joined(docs, id_col, text_col, threshold)[0].checkpoint()
    best = F.col("id").eqNullSafe(F.col("class_id"))
    # Rows that have the class's id: one each, unless a class holds several.
    ties = rows.where(best).groupBy("root").agg(F.min("x").alias("first"), F.count("*").alias("m")).where("m > 1").checkpoint()
    gone = rows.where(~best).select("id", "x")
    if ties.isEmpty():
        return without_rows(docs, gone.checkpoint(), id_col, text_col)
    tied = join_groups(rows.where(best).select("id", "x", "root"), ties, "root", "m", rows.count(), ["id", "x"])
    left = without_rows(docs, gone.union(tied.where("x != first").select("id", "x")).checkpoint(), id_col, text_col)
    return one_of_repeated(left, tied.where("x = first").select("id", "x"), id_col, text_col)
