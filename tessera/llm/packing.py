"""Packing documents into fixed-length token sequences: best-fit bin completion.

Texts become token ids (byte-level BPE, the vocabulary file is a parameter) plus an end id; documents over the capacity
are cut into pieces of it, of which the first may be shorter. Pieces of the full capacity are sequences of their own.
The rest is a bin packing instance whose lengths are integers below the capacity, so its histogram says everything:
at most `capacity` counts reach the driver, whatever the corpus. There bin completion searches: it takes the largest
length left, enumerates the undominated fillings around it, drops branches whose waste reaches the bound set by the
incumbent, and completes every node by best-fit decreasing to get new incumbents. A filling is applied to as many bins
as the counts allow at once. The search is bounded, at every size alike: `nodes` nodes, three fillings a node, 2,000
steps to enumerate them; the packing is whole whatever it finds. Pieces then find their place by their rank within their length; ranks come from cells of
bounded size, so a length shared by a third of all pieces is spread over many tasks.

Defined results: null text is empty, so it packs as the end id alone; rows that repeat a document are packed each; ties
in rank are broken by a row number that is stored before it is used. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The pre-tokenizer of the byte-level vocabularies, a fixed value of their format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with the Unicode property White_Space, a fixed value; runs of so many are cut out before splitting.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
_encoders: dict = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizer file in JSON, run by a faster engine; the ids are the same. A string of an added
    token in a text is that token's id, as the file's own engine has it; `added` holds them, `cuts` finds them."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        bpe = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        bpe.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        longest = sorted(bpe.added, key=len, reverse=True)
        bpe.cuts = re.compile("|".join(map(re.escape, longest))) if longest else None
        _encoders[path] = bpe
    return _encoders[path]


def encode(bpe, text: str) -> list[int]:
    """Ids of a text, cut at the added tokens in it."""
    if bpe.cuts is None or not any(x in text for x in bpe.added):
        return encode_plain(bpe, text)
    ids: list[int] = []
    at = 0
    for cut in bpe.cuts.finditer(text):
        ids += encode_plain(bpe, text[at : cut.start()])
        ids.append(bpe.added[cut.group()])
        at = cut.end()
    return ids + encode_plain(bpe, text[at:])


def encode_plain(bpe, text: str) -> list[int]:
    """Ids of a text without added tokens. The splitter's lookahead recurses on long white space, so such runs are split here by the same rule:
    all but the last character of a run, or the whole run at the end of the text, is one piece."""
    ids: list[int] = []
    at = 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += bpe.encode_ordinary(text[at : run.start()])
        ids += bpe._encode_single_piece(text[run.start() : stop])
        at = stop
    ids += bpe.encode_ordinary(text[at:] if at else text)
    return ids


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            out: list = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(bpe, text or "")
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                n = len(ids)
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    raw = ids[a:b].tobytes()
                    for column, x in zip(out, (doc, k, a, b - a, zlib.crc32(raw), raw), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


# --- the search, on a histogram -------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: [(filling as (length, times) pairs, number of bins)]. Equal bins move
    together, so the cost depends on the number of lengths, not of pieces."""
    open_bins: dict[int, list] = {}
    rooms: list[int] = []  # sorted

    def put(room: int, filling, bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append((filling, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, filling, bins = capacity, (), left
            else:
                room = rooms[k]
                filling, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            times = min(room // length, left)
            used = min(bins, left // times)
            put(room - times * length, (*filling, (length, times)), used)
            left -= used * times
            if bins > used and filling:
                put(room, filling, bins - used)
    return [x for group in open_bins.values() for x in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: pieces over half the capacity need a bin each, and what they leave unused counts."""
    total = sum(k * c for k, c in counts.items())
    best = -(-total // capacity)
    for small in sorted(k for k in counts if k <= capacity // 2):
        alone = sum(c for k, c in counts.items() if k > capacity - small)
        half = {k: c for k, c in counts.items() if capacity // 2 < k <= capacity - small}
        rest = sum(k * c for k, c in counts.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * c for k, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def _reachable(lengths: list[int], room: int) -> list[int]:
    """For each place in lengths, the sums up to room (as bits) that the lengths from there on can make."""
    mask, out, sums = (1 << (room + 1)) - 1, [1] * (len(lengths) + 1), 1
    for i in range(len(lengths) - 1, -1, -1):
        k = lengths[i]
        while k <= room:
            sums |= (sums << k) & mask
            k *= 2
        out[i] = sums
    return out


def dominated(chosen: tuple[int, ...], slack: int, left: dict[int, int]) -> bool:
    """Whether one length that is left could take the place of two or more of the chosen pieces, within the slack."""
    one, more = 0, 0
    for k in chosen:
        more |= (more << k) | (one << k)
        one |= 1 << k
    sums = more
    for _ in range(slack):
        sums |= more << 1
        more <<= 1
    return any(sums >> k & 1 for k, n in left.items() if n > chosen.count(k))


def fillings(counts: dict[int, int], room: int, waste: int, most: int, steps: int = 2000) -> list[tuple[int, ...]]:
    """Undominated ways to fill room, least waste first and longest pieces first: multisets of the lengths that are left,
    in falling order, that waste at most `waste`. Sums that the shorter lengths can't make are not entered. Ends with
    `most` results or after so many steps."""
    lengths = sorted((k for k in counts if k <= room and counts[k]), reverse=True)
    reach = _reachable(lengths, room)
    left = {k: counts[k] for k in lengths}
    kept: list[tuple[int, ...]] = []
    for lost in range(min(waste, room) + 1):
        if not reach[0] >> (room - lost) & 1:
            continue
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room - lost, ())]
        while stack and steps and len(kept) < most:
            at, need, chosen = stack.pop()
            steps -= 1
            if not need:
                if not dominated(chosen, lost, left):
                    kept.append(chosen)
                continue
            branches = []
            for i in range(at, len(lengths)):
                k = lengths[i]
                if not reach[i] >> need & 1:
                    break
                if k <= need and reach[i] >> (need - k) & 1 and left[k] > chosen.count(k):
                    branches.append((i, need - k, (*chosen, k)))
                    if len(branches) > 4 * most:
                        break
            stack.extend(reversed(branches))
        if len(kept) >= most or not steps:
            break
    return kept


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 3000, width: int = 3) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Branch and bound: around the largest length left, at most `width` undominated fillings, each for as many bins as the
    counts allow. A node is dropped if its waste reaches what the incumbent leaves; nodes are completed by best fit, which
    gives new incumbents. The search dives by the first filling; where a dive ends, the next begins at a filling put aside
    at about a third of those still waiting, so it isn't only the last choices that are tried anew. Ends when the
    incumbent meets the lower bound, or after `nodes` nodes."""
    counts = {k: c for k, c in counts.items() if c}
    size = lambda plan: sum(b for _, b in plan)
    best = best_fit(counts, capacity)
    bound, total = lower_bound(counts, capacity), sum(k * c for k, c in counts.items())
    least, visited = size(best), 0
    waiting: list = []
    node = (counts, None, 0, 0)
    while least > bound and visited < nodes and (node or waiting):
        left, plan, bins, waste = node or waiting.pop(len(waiting) // 3)
        node = None
        visited += 1
        allowed = (least - 1) * capacity - total - waste
        if allowed < 0 or not left:
            continue
        whole = best_fit(left, capacity)
        if bins + size(whole) < least:
            steps, at = [], plan
            while at:
                steps.append(at[0])
                at = at[1]
            best, least = [*reversed(steps), *whole], bins + size(whole)
            allowed = (least - 1) * capacity - total - waste
        top = max(left)
        branches = []
        for chosen in fillings(left | {top: left[top] - 1}, capacity - top, min(allowed, capacity - top), width):
            use: dict[int, int] = {top: 1}
            for k in chosen:
                use[k] = use.get(k, 0) + 1
            lost = capacity - sum(k * u for k, u in use.items())
            times = min(left[k] // u for k, u in use.items())
            times = max(1, min(times, allowed // lost if lost else times))
            after = {k: c for k in left if (c := left[k] - times * use.get(k, 0))}
            branches.append((after, ((tuple(sorted(use.items(), reverse=True)), times), plan), bins + times, waste + times * lost))
        if branches:
            node = branches[0]
            waiting += branches[1:]
    return best


def places(plan, capacity: int) -> dict[str, np.ndarray]:
    """For each length the ranks, and where they go: arrays sorted by (length, first rank)."""
    rows, sequence, used = [], 0, {}
    for filling, bins in plan:
        offset = 0
        for length, times in filling:
            first = used.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            used[length] = first + times * bins
            offset += length * times
        sequence += bins
    rows.sort()
    return dict(zip(("length", "first", "times", "sequence", "offset"), np.array(rows or [(capacity + 1, 0, 1, 0, 0)], np.int64).T, strict=True))


def _ranked(pieces: DataFrame, cell_rows: int) -> DataFrame:
    """Adds rank: the place of a piece among those of its length, from 0."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most `capacity` rows
    pieces = pieces.join(F.broadcast(counts), "length")
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / cell_rows))).drop("n")
    sums = pieces.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "cell").orderBy("row")
    return pieces.join(sums, ["length", "cell"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("first", "cell")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 2_000, nodes: int = 3000, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids."""
    pieces = tokenise(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(bin_completion(counts, capacity, nodes), capacity)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batches):
        keys = table["length"] << 44 | table["first"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            i = np.searchsorted(keys, length << 44 | rank, "right") - 1
            over = rank - table["first"][i]
            times = table["times"][i]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table["sequence"][i] + over // times), pa.array(table["offset"][i] + over % times * length)], [*columns, "sequence_id", "offset"])

    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long"
    part = _ranked(pieces.where(F.col("length") < capacity), cell_rows).mapInArrow(place, schema)
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return part.unionByName(full)
