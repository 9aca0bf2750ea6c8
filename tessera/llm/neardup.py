"""Near-duplicate detection with a MinHash LSH forest.

A text's set holds its distinct shingles of `width` words, hashed to 64 bits; texts with equal sets form one class and
take part once. A class has TREES sequences of MinHash values; the sequence of a tree goes on into the next tree's.

1. Every tree is a sorted order: (tree, sequence, node) is range-partitioned and sorted, so classes with a long common
   prefix are neighbours, and no partition grows with a hot prefix. A region is a run of the order with one prefix. Its
   depth adapts both ways: it starts at BASE values; a run of more than `region` classes is split by the next value, and
   the heads of its parts are compared with their neighbours at the shallower depth; a class alone at BASE values meets
   its neighbours on either side down to UP values; where LAST values are equal, windows of neighbours overlap by half.
   No region is capped and no class is dropped.
2. Within a region, signatures (a byte of each value) estimate similarities. Pairs near the threshold are candidates.
3. Links are confirmed on full sets, never by a task that holds a group. First each class is compared with two of its
   candidates, the nearest and the most central of its regions, as a join of pairs with sets. Then the classes of a
   region that have other candidates, not joined with them yet, bring their sets to the region, which is bounded, and
   the exact intersections of all of them link what is left. A candidate is passed over only where its ends are joined.

Defined results: null text counts as empty; a text without words has an empty set and is linked with nothing; rows that
repeat an id are documents of their own, the id standing for all of them; a null id can't name a component that has
another id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm import kernels as K
from tessera.llm.common import materialise, partitions
from tessera.llm.components import components

TREES, DEPTH = 16, 8
VALUES = TREES * DEPTH
#: Values of a prefix: where a region starts, where a lone class stops looking, and the most that are compared.
BASE, UP, LAST = 4, 3, 12
REGION = 256
#: Estimates below the threshold by more than this are no candidates: over four standard deviations at 0.8 and above.
SLACK = 0.15
#: Rows that a task holds at once: places in an order (33 bytes), and members of regions (about 300 bytes).
ORDER_ROWS, MEMBER_ROWS = 500_000, 20_000
#: Shingles that a task is meant to hold at once, 8 bytes each; one region may have more.
TASK_SHINGLES = 1_000_000
_rng = np.random.Generator(np.random.Philox(77))
FACTOR = _rng.integers(1 << 31, size=VALUES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _rng.integers(1 << 32, size=VALUES, dtype=np.int64).astype(np.uint32)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, and the documents' offsets in them."""
    buf = K.LOWER[buf]
    start, end, doc = K.words(buf, off)
    word = K.span_hash(K.prefix_hash(buf), start, end)
    n = len(off) - 1
    at = K.per_doc(doc, n)
    count = np.diff(at)
    many = len(word) - width + 1
    h = np.zeros(max(many, 0), np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + word[k : k + many] if many > 0 else h
    whole = doc[: max(many, 0)] == doc[width - 1 :] if many > 0 else np.zeros(0, bool)
    owners, values = [doc[: len(h)][whole]], [K.mix(h[whole])]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        total = np.full(len(short), 0, np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            step = (total[has] ^ (total[has] >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + word[at[short[has]] + k]
            total[has] = step
        owners.append(short)
        values.append(K.mix(total + count[short].astype(np.uint64)))
    doc, value = K.distinct_pairs(np.concatenate(owners), np.concatenate(values))
    return value, K.per_doc(doc, n)


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, VALUES) MinHash values; rows of empty sets are meaningless."""
    out = np.zeros((len(at) - 1, VALUES), np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        high = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            out[some, k] = np.minimum.reduceat((high ^ FLIP[k]) * FACTOR[k], at[some])
    return out


def set_keys(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits that name a set."""
    raw = value.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sign(docs: DataFrame, width: int) -> DataFrame:
    """id, text_hash, n, set_key, values (two bytes of each MinHash value, tree by tree)."""

    def run(batches):
        for batch in batches:
            for part, buf, off in K.chunks(batch, "text"):
                value, at = shingle_sets(buf, off, width)
                raw = (signatures(value, at) >> np.uint32(3)).astype(">u2").tobytes()
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.diff(at), pa.int64()), pa.array(set_keys(value, at), pa.binary()),
                    pa.array([raw[i * 2 * VALUES : (i + 1) * 2 * VALUES] for i in range(n)], pa.binary()),
                ], ["id", "text_hash", "n", "set_key", "values"])

    return docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(run, "id long, text_hash long, n long, set_key binary, values binary")


# --- candidates -----------------------------------------------------------------------------------------------------


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, TREES, DEPTH)


def _places(classes: DataFrame) -> DataFrame:
    """tree, a, b, c, node: the place of each class in each order, four values of the sequence in a number."""

    def run(batches):
        for batch in batches:
            node = np.asarray(batch.column(0), np.int64)
            v = _values(batch.column(1))
            pack = lambda x: pa.array(np.ascontiguousarray(x).view(">i8").ravel().astype(np.int64))
            arrays = [pack(v[:, :, :4]), pack(v[:, :, 4:]), pack(np.roll(v, -1, axis=1)[:, :, :4])]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int8), len(node))), *arrays, pa.array(np.repeat(node, TREES))], ["tree", "a", "b", "c", "node"])

    return classes.select("node", "values").mapInArrow(run, "tree byte, a long, b long, c long, node long")


def common_prefix(tree: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """For each place, the number of values it shares with the place before; -1 at the start of a tree."""
    out = np.full(len(tree), -1, np.int64)
    if len(tree) > 1:
        v = np.concatenate([x.astype(">i8").view(">u2").reshape(-1, 4) for x in columns], axis=1)
        same = (v[1:] == v[:-1]).cumprod(axis=1).sum(axis=1)
        out[1:] = np.where(tree[1:] == tree[:-1], same, -1)
    return out


def forest_regions(lcp: np.ndarray, region: int) -> list[np.ndarray]:
    """The regions of a sorted order as arrays of places, none larger than `region` (or 2)."""
    n, out = len(lcp), []
    if not n:
        return out
    region = max(region, 2)

    def windows(places: np.ndarray) -> None:
        step = max(region // 2, 1)
        for k in range(0, max(len(places) - step, 1), step):
            if len(places[k : k + region]) > 1:
                out.append(places[k : k + region])

    edge = np.append(np.flatnonzero(lcp < BASE), n)
    size = np.diff(edge)
    lone = edge[:-1][size == 1]
    after = np.append(lcp, -1)
    longest = np.maximum(after[lone], after[lone + 1])
    left = lone[(after[lone] >= UP) & (after[lone] == longest)] - 1
    right = lone[(after[lone + 1] >= UP) & (after[lone + 1] == longest)]
    out += list(np.stack([pairs := np.unique(np.concatenate([left, right])), pairs + 1], axis=1))
    fits = (size > 1) & (size <= region)
    out += [np.arange(x, x + m) for x, m in zip(edge[:-1][fits].tolist(), size[fits].tolist(), strict=True)]
    deeper = [(x, x + m, BASE + 1) for x, m in zip(edge[:-1][size > region].tolist(), size[size > region].tolist(), strict=True)]
    while deeper:
        first, last, depth = deeper.pop()
        if depth > LAST:
            windows(np.arange(first, last))
            continue
        heads = first + np.flatnonzero(np.append(True, lcp[first + 1 : last] < depth))
        ends = np.append(heads[1:], last)
        windows(heads)
        for x, y in zip(heads.tolist(), ends.tolist(), strict=True):
            if y - x > region:
                deeper.append((x, y, depth + 1))
            elif y - x > 1:
                out.append(np.arange(x, y))
    return out


def _regions(classes: DataFrame, region: int) -> DataFrame:
    """region, node: the members of all regions of all orders."""
    spark = classes.sparkSession
    parts = max(partitions(spark), -(-classes.count() * TREES // ORDER_ROWS))
    order = ["tree", "a", "b", "c", "node"]
    places = _places(classes).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        tree, a, b, c, node = (np.concatenate([np.asarray(x.column(i)) for x in held]) for i in range(5))
        found = forest_regions(common_prefix(tree, [a, b, c]), region)
        if found:
            number = (TaskContext.get().partitionId() << 40) + np.arange(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, [len(x) for x in found])), pa.array(node[np.concatenate(found)])], ["region", "node"])

    return places.mapInArrow(run, "region long, node long")


def _agree(sig: np.ndarray) -> np.ndarray:
    """Number of equal bytes for all pairs of a region's signatures."""
    m = len(sig)
    out = np.zeros((m, m), np.uint8)
    for column in np.ascontiguousarray(sig.T):
        out += column[:, None] == column[None, :]
    return out


def _by_region(table: pa.Table, columns: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The number columns sorted by (region, node), the order itself, and where regions begin and how many rows they have."""
    region, *rest = (np.asarray(table.column(c).combine_chunks().fill_null(-1), np.int64) for c in ("region", *columns))
    order = np.lexsort((rest[0], region))
    region = region[order]
    edge = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    return [region, *(x[order] for x in rest)], order, edge, np.diff(np.append(edge, len(region)))


def _near(sig: np.ndarray, n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Agreements of all pairs of a region, and which are near enough to be candidates."""
    agree = _agree(sig)
    near = (agree >= (threshold / 100 - SLACK) * VALUES) & (100 * np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n))
    np.fill_diagonal(near, False)
    return agree, near


def _near_twos(sig: np.ndarray, n: np.ndarray, a: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the regions of two that begin at a, those whose pair is a candidate, and the pairs' agreements."""
    agree = (sig[a] == sig[a + 1]).sum(axis=1)
    near = (agree >= (threshold / 100 - SLACK) * VALUES) & (100 * np.minimum(n[a], n[a + 1]) >= threshold * np.maximum(n[a], n[a + 1]))
    return a[near], agree[near]


def _choices(table: pa.Table, threshold: int) -> pa.Table:
    """For each class of many regions its nearest and its most central candidate: u, v, w, agree, centre."""
    (_, node, n), order, edge, size = _by_region(table, ("node", "n"))
    sig = _signatures(table)[order]
    a, agree = _near_twos(sig, n, edge[size == 2], threshold)
    out: list[tuple] = [(node[a + i], node[a + 1 - i], node[a + 1 - i], agree, agree * 500) for i in (0, 1)]
    for a, m in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = slice(a, a + m)
        agree, near = _near(sig[own], n[own], threshold)
        i = np.flatnonzero(near.any(axis=1))
        if len(i):
            # the classes that most are near to, and nearest, come first; the scale makes regions comparable
            centre = np.where(near, agree, 0).sum(axis=1, dtype=np.int64) * 1000 // m
            best, middle = np.where(near, agree, 0)[i].argmax(axis=1), np.where(near, centre[None, :], -1)[i].argmax(axis=1)
            out.append((node[own][i], node[own][best], node[own][middle], agree[i, best].astype(np.int64), centre[middle]))
    return pa.table(dict(zip(("u", "v", "w", "agree", "centre"), map(pa.array, map(np.concatenate, zip(*out, strict=True))), strict=True)))


def _open_members(table: pa.Table, threshold: int) -> pa.Table:
    """region, node of the classes that have a candidate whose label differs and that is not one of their choices."""
    (region, node, n, label, best, middle), order, edge, size = _by_region(table, ("node", "n", "label", "best", "middle"))
    sig = _signatures(table)[order]
    out = np.zeros(len(node), bool)
    a, _ = _near_twos(sig, n, edge[size == 2], threshold)
    known = (best[a] == node[a + 1]) | (middle[a] == node[a + 1]) | (best[a + 1] == node[a]) | (middle[a + 1] == node[a])
    a = a[~known & (label[a] != label[a + 1])]
    out[a] = out[a + 1] = True
    for a, m in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = slice(a, a + m)
        if (label[own] != label[a]).any():
            _, near = _near(sig[own], n[own], threshold)
            known = (best[own][:, None] == node[own]) | (middle[own][:, None] == node[own])
            near &= (label[own][:, None] != label[own]) & ~known & ~known.T
            out[own] = near.any(axis=1)
    return pa.table({"region": pa.array(region[out]), "node": pa.array(node[out])})


def _signatures(table: pa.Table) -> np.ndarray:
    return _values(table.column("values").combine_chunks()).reshape(-1, VALUES).astype(np.uint8)


# --- exact links ----------------------------------------------------------------------------------------------------


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set_key and shingles of the wanted set keys: one more pass over the texts, which passes on what hits a filter of
    bounded size, a set once for each batch."""
    spark = docs.sparkSession
    lead = bloom.leading_bits(partitions(spark))
    head = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")
    bits = spark.sparkContext.broadcast(bloom.of_column(wanted.select(head.alias("h")), lead))

    def run(batches):
        for batch in batches:
            seen: set[bytes] = set()
            for _, buf, off in K.chunks(batch, "text"):
                value, at = shingle_sets(buf, off, width)
                keys = set_keys(value, at)
                heads = np.frombuffer(b"".join(k[:8] for k in keys), ">u8").astype(np.uint64)
                hit = [i for i in np.flatnonzero(bloom.maybe(heads, bits.value) & (np.diff(at) > 0)).tolist() if keys[i] not in seen and not seen.add(keys[i])]
                off = np.concatenate([[0], np.cumsum([at[i + 1] - at[i] for i in hit])]).astype(np.int32)
                flat = np.concatenate([value[at[i] : at[i + 1]] for i in hit]) if hit else value[:0]
                sets = pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), sets], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(run, "set_key binary, shingles array<long>").dropDuplicates(["set_key"])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs u, v with 100 * intersection >= threshold * union. sets(node, n, shingles)."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")
    common = F.size(F.array_intersect("set_u", "set_v"))
    both = both.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("total"), common.cast("long").alias("common"))
    return both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * threshold).select("u", "v")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from the shingles that two or more have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    shared = ~new | ~np.append(new[1:], True)
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    out, block = np.zeros((len(sets), len(sets)), np.float64), 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        x, y = np.searchsorted(column, [a, a + block])
        has = np.zeros((len(sets), block), np.float32)
        has[owner[x:y], column[x:y] - a] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _region_links(table: pa.Table, threshold: int) -> pa.Table:
    """u, v: in each region the least class that a class is linked with over the region's exact links and its label."""
    (_, node, label), order, edge, size = _by_region(table, ("node", "label"))
    column = table.column("shingles").combine_chunks()
    flat, off = np.asarray(column.values, np.int64), np.asarray(column.offsets, np.int64)
    us, vs = [node[:0]], [node[:0]]
    for a, m in zip(edge.tolist(), size.tolist(), strict=True):
        own = slice(a, a + m)
        sets = [flat[off[i] : off[i + 1]] for i in order[own]]
        n, common = np.array([len(x) for x in sets]), common_counts(sets)
        joined = (100 * common >= threshold * (n[:, None] + n - common)) & (common > 0) | (label[own][:, None] == label[own])
        group = np.arange(m)
        while True:
            new = np.where(joined, group[None, :], m).min(axis=1)
            new = new[new]
            if (new == group).all():
                break
            group = new
        far = group != np.arange(m)
        us.append(node[own][far])
        vs.append(node[own][group[far]])
    return pa.table({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})


def _components(docs: DataFrame, classes: DataFrame, width: int, threshold: int, region: int) -> DataFrame:
    """node, label of every class that is linked with a lesser one."""
    spark = docs.sparkSession
    members = materialise(_regions(classes, region).join(classes.select("node", "n", "values"), "node"), "members")
    dealt = lambda rows, tasks: rows.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)).cast("int")).groupBy("task")
    tasks = max(partitions(spark), -(-members.count() // MEMBER_ROWS))
    chosen = dealt(members, tasks).applyInArrow(lambda table: _choices(table, threshold), "u long, v long, w long, agree long, centre long")
    best, middle = F.max_by("v", F.struct("agree", -F.col("v"))), F.max_by("w", F.struct("centre", -F.col("w")))
    chosen = materialise(chosen.groupBy(F.col("u").alias("node")).agg(best.alias("best"), middle.alias("middle")), "choices")
    # every class with a candidate has a choice, so these are all classes whose sets can be asked for
    wanted = materialise(chosen.select("node").join(classes.select("node", "n", "set_key"), "node"), "wanted")
    sets = wanted.join(_sets_of(docs, wanted.select("set_key"), width), "set_key").select("node", "n", "shingles")
    sets = materialise(sets, "sets")
    pairs = chosen.select("node", F.explode(F.array("best", "middle")).alias("other"))
    pairs = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    links = materialise(_confirmed(pairs, sets, threshold), "links")
    labels = components(links)
    labelled = lambda rows: rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = dealt(labelled(members.join(chosen, "node")), tasks).applyInArrow(lambda table: _open_members(table, threshold), "region long, node long")
    rest = materialise(rest, "open")
    if rest.isEmpty():
        return labels
    size = rest.join(sets.select("node", "n"), "node").agg(F.sum("n")).first()[0]
    tasks = max(partitions(spark), -(-size // TASK_SHINGLES))
    more = dealt(labelled(rest.join(sets, "node")), tasks).applyInArrow(lambda table: _region_links(table, threshold), "u long, v long")
    more = materialise(more, "more-links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and component for every row; texts with 100 * intersection >=
    threshold * union are linked, and a component is named by its least id. text_hash tells rows of one id apart, and
    component (null for an empty set) components that share a least id."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(_sign(docs, width), "signed")
    classes = signed.where("n > 0").groupBy("set_key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("values").alias("values"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = materialise(_components(docs, classes, width, threshold, region), "components")
    labelled = classes.select("node", "set_key", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "label").select("set_key", "component_id", F.col("label").alias("component"))
    out = signed.select("id", "text_hash", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash", "component")
