"""Removing byte strings that occur earlier, by a suffix sort that compares hashes.

Every string of `length` bytes that also starts earlier, in rising order of document and position, is covered; what is
covered goes. The suffixes to be sorted are dealt out by content: among the substrings of GRAM bytes within a string of
`length` bytes, the one with the least hash (the leftmost of equals) is its anchor, so equal strings have equal anchors
at equal places, wherever they stand. Consecutive starts with the same anchor make one segment.

1. One pass finds which anchors occur twice or more. A Bloom filter of them, bounded in size, goes out.
2. A second pass cuts the segments of such anchors. Equal segments of a batch are combined: the first is passed on, the
   others are covered already, so a passage in a third of all documents costs each batch one row.
3. Segments meet by anchor, in parts whose number follows the number of segments; a part is walked in slices of a few
   thousand segments, keys whole, so a task's memory is the same at any corpus size. There the suffix sort runs: suffixes are merge-sorted by their first `length` bytes; two are
   compared by a binary search for their common extension over prefix polynomial hashes, so a comparison takes the
   logarithm of `length`. Neighbours that are equal by hash are verified by their bytes; of equal ones the earliest
   stays. An anchor with more than HOT segments (the edge of a passage that stands in many contexts) is dealt out anew,
   string by string; a string that still has more than HOT rows is combined in salted groups, level by level.
4. The covered spans of a document are united and cut out of its text.

Defined results: null text counts as empty; rows that repeat an id are documents in the order of a hash of their text,
and rows equal in id and text are one document, so each of them gets its result; a null id sorts first; a text shorter
than `length` stays whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom as B
from tessera.llm import kernels as K
from tessera.llm.common import discard, materialise, partitions, text_bytes

GRAM = 32
HOT = 4096
#: Segments of a part, which one task holds at once (about 230 bytes each), and of a slice, which is sorted at once.
PART_SEGMENTS, SLICE = 1 << 15, 1 << 12
#: Anchors that a task holds before it passes them on, and that one part of their hashes is meant to have.
HELD_ANCHORS = 1 << 21
#: Hot anchors are broadcast up to this many (512 kB), else joined by a shuffle.
MAX_BROADCAST_KEYS = 1 << 16
ZSTD = {"compression": "zstd"}
BUCKET_BYTES = 16 << 20
SEGMENTS = "kind int, key long, id long, tie long, start long, stop long, anchor int, content binary"
_NAMES = ["kind", "key", "id", "tie", "start", "stop", "anchor", "content"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def segments(prefix: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor position, anchor hash) of every run of strings with the same anchor."""
    n = int(off[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - GRAM + 1)
    h = K.span_hash(prefix, at, at + GRAM)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    # strings that end within their document
    stop = np.repeat(off[1:], np.diff(off))
    start = np.flatnonzero(stop[: len(low)] - np.arange(len(low)) >= length)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    # the least hashes crowd near zero; mixed again they spread over all values
    return start[first], start[last], anchor[first], K.mix(h[anchor[first]] + np.uint64(1))


def _rows(bytes_: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A row of `size` bytes from each start, zeros beyond the end."""
    padded = np.concatenate([bytes_, np.zeros(size, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[start]


def combine(key, shape, content, id_, tie, start, stop) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): the earliest of the segments that are equal, and those that it covers. Equal are same key and
    shape, same bytes; content holds a row of bytes for each. A segment that has the place of the first too comes from a
    row equal in id and text: it is the same segment again, neither first nor covered."""
    order = np.lexsort((start, tie, id_, shape, key))
    same = (key[order][1:] == key[order][:-1]) & (shape[order][1:] == shape[order][:-1])
    same &= (content[order[1:]] == content[order[:-1]]).all(axis=1)
    first, later = np.ones(len(key), bool), np.zeros(len(key), bool)
    first[order[1:]] = ~same
    lead = order[np.maximum.accumulate(np.where(first[order], np.arange(len(order)), 0))]
    later[order] = (id_[order] != id_[lead]) | (tie[order] != tie[lead]) | (start[order] != start[lead])
    return first, later


def unite(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each owner; touching spans become one."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    shift = (np.int64(stop.max()) + 1) * np.unique(owner, return_inverse=True)[1]
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return owner[first], start[first], (reach - shift)[np.append(first[1:], len(owner)) - 1]


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at `at` by group, then by their first `length` bytes; returns the order, and for each place
    whether it holds the same bytes as the place before. Bottom-up mergesort: at each level every element finds its
    place in the sibling run by binary search; all elements of a level move together."""
    prefix = K.prefix_hash(data)
    inverse = K.powers(K.INVERSE, len(data) + 1)
    order = np.argsort(group, kind="stable")

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes x and y, at most `length`."""
        px, py, ix, iy = prefix[x], prefix[y], inverse[x], inverse[y]
        low = np.where((prefix[x + length] - px) * ix == (prefix[y + length] - py) * iy, length, 0)
        at = np.flatnonzero(low == 0)
        x, y, px, py, ix, iy = x[at], y[at], px[at], py[at], ix[at], iy[at]
        a, b = np.zeros(len(at), np.int64), np.full(len(at), length - 1)
        for _ in range(length.bit_length()):
            mid = (a + b + 1) >> 1
            same = (prefix[x + mid] - px) * ix == (prefix[y + mid] - py) * iy
            a, b = np.where(same, mid, a), np.where(same, b, mid - 1)
            b = np.maximum(a, b)
        low[at] = a
        return low

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = common(x, y)
        return np.where(k < length, data[np.minimum(x + k, len(data) - 1)] < data[np.minimum(y + k, len(data) - 1)], False)

    sorted_group = group[order]
    edge = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1]))
    size = np.diff(np.append(edge, len(order)))
    begin, end = np.repeat(edge, size), np.repeat(edge + size, size)
    place = np.arange(len(order))
    run = 1
    while run < (size.max() if len(size) else 0):
        live = np.flatnonzero(end - begin > run)
        local = place[live] - begin[live]
        block = local // (2 * run)
        left = local % (2 * run) < run
        a = begin[live] + block * 2 * run
        mid, stop = np.minimum(a + run, end[live]), np.minimum(a + 2 * run, end[live])
        low, high = np.where(left, mid, a), np.where(left, stop, mid)
        base, own = low.copy(), at[order[live]]
        while (open_ := np.flatnonzero(low < high)).size:
            m = (low[open_] + high[open_]) >> 1
            other = at[order[m]]
            # elements of the right run go behind equal ones of the left
            before = np.where(left[open_], less(other, own[open_]), ~less(own[open_], other))
            low[open_] = np.where(before, m + 1, low[open_])
            high[open_] = np.where(before, high[open_], m)
        target = np.where(left, place[live] + low - base, place[live] - (mid - a) + low - base)
        order[target] = order[live].copy()
        run *= 2
    x = at[order]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        near = np.flatnonzero(sorted_group[1:] == sorted_group[:-1]) + 1
        near = near[common(x[near], x[near - 1]) >= length]
        rows = near[(_rows(data, x[near], length) == _rows(data, x[near - 1], length)).all(axis=1)]
        same[rows] = True
    return order, same


def covered(key, id_, tie, start, stop, anchor, content: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): what earlier strings cover in the segments that share a key."""
    order = np.argsort(key, kind="stable")
    alone = np.ones(len(key), bool)
    k = key[order]
    twin = k[1:] == k[:-1]
    alone[order[1:][twin]] = alone[order[:-1][twin]] = False
    some = np.flatnonzero(~alone)
    if not len(some):
        return some, some, some
    data = np.frombuffer(b"".join(content[i] for i in some), np.uint8)
    size = (stop - start)[some]
    origin = np.cumsum(size) - size
    count = size - length + 1
    segment = np.repeat(np.arange(len(some)), count)
    shift = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    # equal strings have their anchor at the same place
    place = anchor[some][segment] - shift
    group = np.unique(np.stack([key[some][segment], place]), axis=1, return_inverse=True)[1].ravel() if len(segment) < 1000 else _pair_rank(key[some][segment], place)
    order, same = suffix_order(data, origin[segment] + shift, group, length)
    run = np.cumsum(~same) - 1
    own = some[segment[order]]
    rank = np.lexsort((start[own] + shift[order], tie[own], id_[own], run))
    later = np.ones(len(rank), bool)
    later[np.unique(run[rank], return_index=True)[1]] = False
    dup = order[rank[later]]
    seg, at = segment[dup], start[some][segment[dup]] + shift[dup]
    seg, a, b = unite(seg, at, at + length)
    return some[seg], a, b


def _pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


# --- the passes -----------------------------------------------------------------------------------------------------


def _anchors(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Distinct anchors by the leading bits of their hash, those that a task has seen twice apart. A task passes on what
    it holds whenever that is HELD_ANCHORS or more."""

    def passed_on(held: list[np.ndarray]) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(held), return_counts=True)
        parts, many_of, hashes = [], [], []
        for many, values in ((False, v), (True, v[n > 1])):
            part = (values >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            parts.append(some.astype(np.int32))
            many_of.append(np.full(len(some), many))
            hashes += [values[cut[i] : cut[i + 1]].tobytes() for i in some]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(many_of)), pa.array(hashes, pa.binary())], ["part", "many", "hashes"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for _, buf, off in K.chunks(batch, "text"):
                held.append(segments(K.prefix_hash(buf), off, length)[3])
                if sum(map(len, held)) >= HELD_ANCHORS:
                    yield passed_on(held)
                    held = []
        if held:
            yield passed_on(held)

    return docs.select("text").mapInArrow(run, "part int, many boolean, hashes binary")


def _repeated(anchors: DataFrame) -> DataFrame:
    """The anchors that occur twice or more, by part."""

    def run(table: pa.Table) -> pa.Table:
        many = np.asarray(table.column("many").to_numpy(), bool)
        blobs = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        once = [b for b, m in zip(blobs, many, strict=True) if not m]
        v, n = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, int))
        v = np.unique(np.concatenate([v[n > 1], *[b for b, m in zip(blobs, many, strict=True) if m]]))
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(v)]), "hashes": pa.array([v.tobytes()], pa.binary())})

    return anchors.groupBy("part").applyInArrow(run, "part int, n long, hashes binary")


def _emit(kind: int, columns: list, content: list[bytes | None]) -> pa.RecordBatch:
    arrays = [np.full(len(content), kind, np.int32), *columns]
    return pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(arrays, _KINDS, strict=False)], pa.array(content, pa.binary())], _NAMES)


def _split(key, id_, tie, start, stop, anchor, content: np.ndarray, length: int):
    """Batches of the segments to pass on (kind 0) and of the spans that are covered already (kind 1)."""
    shape = anchor.astype(np.int64) << 32 | (stop - start)
    first, later = combine(key, shape, content, id_, tie, start, stop)
    i = np.flatnonzero(first)
    yield _emit(0, [key[i], id_[i], tie[i], start[i], stop[i], anchor[i]], [content[j, : stop[j] - start[j]].tobytes() for j in i])
    i = np.flatnonzero(later)
    owner = _pair_rank(id_[i], tie[i]) if len(i) else i
    owners, a, b = unite(owner, start[i], stop[i])
    if len(owners):
        back = i[np.unique(owner, return_index=True)[1]][owners]
        zero = np.zeros(len(a), np.int64)
        yield _emit(1, [zero, id_[back], tie[back], a, b, zero.astype(np.int32)], [None] * len(a))


def _cut_segments(docs: DataFrame, bloom, length: int) -> DataFrame:
    most = 2 * length - GRAM

    def run(batches):
        for batch in batches:
            got = []
            for part, buf, off in K.chunks(batch, "text"):
                prefix = K.prefix_hash(buf)
                first, last, anchor, h = segments(prefix, off, length)
                some = B.maybe(h, bloom.value) if len(h) else np.zeros(0, bool)
                first, last, anchor, h = first[some], last[some], anchor[some], h[some]
                doc = np.searchsorted(off, first, "right") - 1
                rows = _rows(buf, first, most)
                rows[np.arange(most) >= (last - first + length)[:, None]] = 0
                ids, ties = (np.asarray(part.column(part.schema.get_field_index(c)), np.int64) for c in ("id", "tie"))
                got.append((h.view(np.int64), ids[doc], ties[doc], first - off[doc], last - off[doc] + length, (anchor - first).astype(np.int32), rows))
                if sum(len(x[0]) for x in got) > 200_000:
                    yield from _split(*(np.concatenate(x) for x in zip(*got, strict=True)), length)
                    got = []
            if got:
                yield from _split(*(np.concatenate(x) for x in zip(*got, strict=True)), length)

    return docs.select("id", "tie", "text").mapInArrow(run, SEGMENTS)


def _arrays(table: pa.Table | pa.RecordBatch):
    return [np.asarray(table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(table.schema.get_field_index(c))) for c in _NAMES[1:7]]


def _deal_anew(hot: DataFrame, length: int) -> DataFrame:
    """Hot anchors' segments string by string: the key is a hash of the whole string, and equal ones are combined."""

    def run(batches):
        for batch in batches:
            _, id_, tie, start, stop, anchor = _arrays(batch)
            for a in range(0, batch.num_rows, 1000):
                part = slice(a, a + 1000)
                content = batch.column(7).slice(a, 1000).to_pylist()
                data = np.frombuffer(b"".join(content), np.uint8)
                size = (stop - start)[part]
                count = size - length + 1
                own = np.repeat(np.arange(len(size)), count)
                shift = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                at = (np.cumsum(size) - size)[own] + shift
                key = K.span_hash(K.prefix_hash(data), at, at + length).view(np.int64)
                first = start[part][own] + shift
                yield from _split(key, id_[part][own], tie[part][own], first, first + length, anchor[part][own] * 0, _rows(data, at, length), length)

    return hot.select(*_NAMES).mapInArrow(run, SEGMENTS)


def _combined_again(dealt: DataFrame, length: int) -> DataFrame:
    """Strings that still have more than HOT rows, combined in salted groups of about HOT rows until none has: of each
    group the earliest goes on, the others are covered. A level leaves one row in HOT."""
    done, most = None, max(HOT, 8)
    while True:
        counts = dealt.where("kind = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        counts = materialise(counts, "still-hot")
        if counts.isEmpty():
            return dealt if done is None else dealt.unionByName(done)
        salted = dealt.where("kind = 0").join(counts, "key")
        salt = F.pmod(F.xxhash64("id", "tie", "start", F.lit(3)), F.ceil(F.col("n") / most))
        salted = salted.withColumn("salt", salt).groupBy("key", "salt")

        def run(table: pa.Table) -> pa.Table:
            key, id_, tie, start, stop, anchor = _arrays(table)
            rows = _rows(np.frombuffer(b"".join(table.column("content").to_pylist()), np.uint8), np.arange(len(key)) * length, length)
            return pa.Table.from_batches(list(_split(key, id_, tie, start, stop, anchor, rows, length)))

        fresh = materialise(salted.applyInArrow(run, SEGMENTS), "combined-again", options=ZSTD)
        cold = dealt.where("kind = 0").join(counts, "key", "left_anti").select(*_NAMES)
        known = dealt.where("kind = 1")
        done = known if done is None else done.unionByName(known)
        dealt = cold.unionByName(fresh)


def slices(key: np.ndarray, size: int = SLICE) -> list[np.ndarray]:
    """The rows in slices of about `size`, all rows of a key in one slice; keys that stand alone are left out."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(k)))
    rows = order[np.repeat(count > 1, count)]
    count = count[count > 1]
    cuts, at, used = [], 0, 0
    for n in count.tolist():
        if used and used + n > size:
            cuts.append(at)
            used = 0
        at, used = at + n, used + n
    return [x for x in np.split(rows, cuts) if len(x)]


def meet_part(key, id_, tie, start, stop, anchor, content: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): what earlier strings cover in the segments of a part."""
    most, found = 2 * length - GRAM, []
    for rows in slices(key):
        # equal segments of different tasks: all but the earliest are covered, and the suffix sort sees each once
        size = (stop - start)[rows]
        data = _rows(np.frombuffer(b"".join(content[i] for i in rows), np.uint8), np.cumsum(size) - size, most)
        data[np.arange(most) >= size[:, None]] = 0
        first, later = combine(key[rows], anchor[rows].astype(np.int64) << 32 | size, data, id_[rows], tie[rows], start[rows], stop[rows])
        own, rest = rows[first], rows[later]
        del data
        seg, a, b = covered(key[own], id_[own], tie[own], start[own], stop[own], anchor[own].astype(np.int64), [content[i] for i in own], length)
        found += [(own[seg], a, b), (rest, start[rest], stop[rest])]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_spans(docs: DataFrame, length: int = 100, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """Covered spans of docs(id, tie, text): id, tie, start, stop in bytes; spans of a document may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    # about one anchor in half a string's room
    anchors = 2 * text_bytes(docs, "text") // (length - GRAM)
    bits = max(B.leading_bits(partitions(spark)), (anchors // HELD_ANCHORS).bit_length())
    repeated = materialise(_repeated(_anchors(docs, length, bits)), "anchors")
    bloom = spark.sparkContext.broadcast(B.build(repeated, bits))
    cut = materialise(_cut_segments(docs, bloom, length), "segments", options=ZSTD)
    segs = cut.where("kind = 0")
    hot = segs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")
    hot = materialise(hot, "hot")
    if hot.count() <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    dealt = materialise(_deal_anew(segs.join(hot, "key", "left_semi"), length), "dealt-anew", options=ZSTD)
    anew = _combined_again(dealt, length)
    meet = segs.join(hot, "key", "left_anti").select(*_NAMES[1:]).unionByName(anew.where("kind = 0").select(*_NAMES[1:]))
    parts = max(partitions(spark), -(-(segs.count() + anew.where("kind = 0").count()) // part_segments))
    meet = meet.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        key, id_, tie, start, stop, anchor = _arrays(table)
        seg, a, b = meet_part(key, id_, tie, start, stop, anchor, table.column("content").to_pylist(), length)
        return pa.table({"id": pa.array(id_[seg]), "tie": pa.array(tie[seg]), "start": pa.array(a, pa.int64()), "stop": pa.array(b, pa.int64())})

    spans = meet.groupBy("part").applyInArrow(run, "id long, tie long, start long, stop long")
    known = cut.where("kind = 1").unionByName(anew.where("kind = 1")).select("id", "tie", "start", "stop")
    out = materialise(spans.unionByName(known), "spans", options=ZSTD)
    for done in (repeated, cut, dealt):
        discard(done)
    return out


def strip_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, and with_text the remaining bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    spans = repeated_spans(rows, length)
    buckets = max(partitions(spark), -(-text_bytes(rows, "text") // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64("id", "tie"), F.lit(buckets)).cast("int").alias("bucket")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ties, start, stop = (np.asarray(right.column(c).combine_chunks(), np.int64) for c in ("id", "tie", "start", "stop"))
        owner = _pair_rank(ids, ties) if len(ids) else ids
        which, a, b = unite(owner, start, stop)
        back = np.unique(owner, return_index=True)[1] if len(ids) else ids
        spans_of: dict = {}
        for w, x, y in zip(which.tolist(), a.tolist(), b.tolist(), strict=True):
            spans_of.setdefault((int(ids[back[w]]), int(ties[back[w]])), []).append((x, y))
        out: list[list] = [[], [], [], [], []]
        for i, t, s in zip(left.column("id").to_pylist(), left.column("tie").to_pylist(), left.column("text"), strict=True):
            raw = s.as_buffer().to_pybytes() if hasattr(s, "as_buffer") else s.as_py().encode()
            own = spans_of.get((i, t), ())
            kept, at = [], 0
            for x, y in own:
                kept.append(raw[at:x])
                at = y
            body = b"".join([*kept, raw[at:]])
            for column, value in zip(out, (len(raw), len(raw) - len(body), len(own), hashlib.sha256(body).hexdigest(), body if with_text else None), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + with_text]
        return pa.table([left.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)][: 4 + with_text]], names=["doc_id", *names])

    pairs = rows.select(bucket, "doc_id", "id", "tie", "text").groupBy("bucket").cogroup(spans.select(bucket, "id", "tie", "start", "stop").groupBy("bucket"))
    return pairs.applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text)
