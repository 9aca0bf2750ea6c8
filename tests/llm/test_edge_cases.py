"""Every operator over odd rows and empty tables, held against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import exactdup, langid, lm, mixing, neardup, packing, quality, repeats, topk, toxicity
from tessera.llm.common import id_bucket
from tessera.llm.queries import tokenizer_path

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return (t or "").translate(FOLD)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- 10 exact dedup


@pytest.mark.parametrize("bits", [256, 8])
def test_exact(odd, odd_rows, bits):
    groups = {}
    for r in odd_rows:
        groups.setdefault(fold(r[1]), []).append(r[0])
    got = rows_of(exactdup.exact_groups(odd, keep="max", digest_bits=bits))
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(r[0]), str(best[fold(r[1])]), len(groups[fold(r[1])])) for r in odd_rows)
    assert sorted((str(g["doc_id"]), str(g["keep_id"]), g["group_size"]) for g in got) == want
    if bits == 256:
        by_id = {g["doc_id"]: g["digest"] for g in got}
        assert by_id[103] == hashlib.sha256(fold(odd_rows[44][1]).encode()).hexdigest()


def test_exact_find(spark, odd, odd_rows):
    index = exactdup.MergeIndex(odd)
    index.flush()
    base = odd_rows[44][1]
    assert sorted(r["id"] for r in index.find([base.upper(), "not there"]).collect()) == [103, 104, 105]
    assert index.find([]).isEmpty()


def test_exact_empty(none):
    assert exactdup.exact_groups(none).isEmpty()


# --- 4 mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("cells", [20_000, 3])
def test_mix(odd, odd_rows, cells):
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = brute_targets(sizes)
    got = rows_of(mixing.mix_report(odd, cell_rows=cells))
    assert len(got) == len(odd_rows)
    want = sorted((str(r[0]), len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in odd_rows)
    assert sorted((str(g["doc_id"]), g["size"], g["source_size"]) for g in got) == want
    assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)
    assert sorted(round(g["target"], 6) for g in got) == sorted(round(target[r[3]], 6) for r in odd_rows)
    assert sum(g["taken"] for g in got) <= sum(sizes.values())
    assert got and sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix_report(odd.repartition(5), cell_rows=7))))


def test_mix_empty(none):
    assert mixing.mix_report(none).isEmpty() and mixing.mixed_documents(none).isEmpty()


def test_mixed_documents_keep_columns(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    ordered = mixing.mixed_documents(odd, ordered=True)
    assert Counter(out.collect()) == Counter(ordered.collect())


def test_mixed_documents_in_order_of_finish(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    _, mix = mixing.fair_queue(docs)
    want = [r["id"] for r in mix.orderBy("finish", "shuffled", "id", "epoch").collect()]
    assert [r["doc_id"] for r in mixing.mixed_documents(docs, ordered=True).collect()] == want
    assert len(want) > len({*want}) > 20


# --- 1 packing


def test_pack(odd, odd_rows):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokenizer_path())
    got = rows_of(packing.pack(odd, tokenizer_path(), capacity=64, cell_rows=5))
    want = Counter()
    for r in odd_rows:
        ids = ref.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r[0], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(g["length"] for g in got) // 64) * 1.03 + 1


def test_long_white_space_packs_as_the_reference_tokenizer_has_it():
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for text in ("x" + " " * 300 + "y z", " " * 300 + "\n\n  " + "\t" * 400, "a\n" + "\n" * 500 + "b", " " * 999 + "'s", "!" * 700 + " " * 256, "q" + " " * 256 + "\tq", "<|endoftext|> a", "a <|endoftext|><|endoftext|>\n\n b <|endoftext", "<|endoftext|>"):
        assert packing.encode(own, text) == ref.encode(text, add_special_tokens=False).ids
    assert len(packing.encode(own, " " * 1_000_000)) > 0


def test_pack_empty(none):
    assert packing.pack(none, tokenizer_path()).isEmpty()


def test_bin_completion_meets_the_bound_where_best_fit_does_not():
    """Lengths as texts have them: many, mostly short, some over half the capacity."""
    import numpy as np

    rng = np.random.default_rng(0)
    counts = Counter(np.clip(rng.lognormal(5.6, 0.9, 6000), 8, 1023).astype(int).tolist())
    n, first = (sum(b for _, b in f(dict(counts), 1024)) for f in (packing.bin_completion, packing.best_fit))
    assert packing.lower_bound(dict(counts), 1024) <= n <= first
    tight = Counter({1024 - k: 40 for k in range(300, 500)}) + Counter({k: 20 for k in range(100, 301)}) + Counter({k: 20 for k in range(150, 250)})
    n, first = (sum(b for _, b in f(dict(tight), 1024)) for f in (packing.bin_completion, packing.best_fit))
    assert packing.lower_bound(dict(tight), 1024) <= n <= first


def test_fillings_are_undominated():
    found = packing.fillings({5: 3, 4: 3, 3: 3, 2: 3, 1: 3}, 9, 1, 10)
    assert found[0] == (5, 4) and all(8 <= sum(f) <= 9 for f in found)
    assert not packing.dominated((5, 4), 0, {5: 3, 4: 3}) and packing.dominated((3, 2), 0, {5: 1, 3: 1, 2: 1})
    assert packing.dominated((3, 1), 1, {5: 1}) and not packing.dominated((3, 1), 0, {5: 1})


def test_bin_completion_beats_or_equals_best_fit():
    import random

    rng = random.Random(1)
    better = 0
    for _ in range(60):
        counts = Counter(rng.randint(20, 70) for _ in range(rng.randint(5, 40)))
        plan, first = packing.bin_completion(dict(counts), 100), packing.best_fit(dict(counts), 100)
        n, m = sum(b for _, b in plan), sum(b for _, b in first)
        assert packing.lower_bound(dict(counts), 100) <= n <= m
        better += n < m
        used = Counter()
        for filling, bins in plan:
            assert sum(k * t for k, t in filling) <= 100
            for k, t in filling:
                used[k] += t * bins
        assert used == counts
    assert better  # there are inputs on which the search finds fewer bins


# --- 7 top-k


def test_topk(spark):
    import random

    rng = random.Random(2)
    vecs = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(90)]
    vecs += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf")] * 4), (104, [1.0]), (105, []), (None, [1.0] * 4), (20, [0.5] * 4), (106, [1.0, 1.0, 1.0, 1.0]), (107, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1)).repartition(5)
    ok = [(i, [math.floor(64 * x) for x in struct32(v)]) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    queries = {}
    for i, v in ok:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)  # of rows that share an id the least vector is the query
    for q in queries:
        scored = sorted(((-sum(a * b for a, b in zip(queries[q], v, strict=False)), i) for i, v in ok if i != q))[:20]
        for k, (s, i) in enumerate(scored):
            want[q, k + 1] = (i, -s)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, tile_rows=16, block_rows=3, fan_in=2).collect()}
    assert got == want


def struct32(v):
    import struct

    return [struct.unpack("f", struct.pack("f", x))[0] for x in v]


def test_topk_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).isEmpty()


# --- 6 near duplicates


def shingles(t):
    w = WORD.findall(fold(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, threshold):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= threshold * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


@pytest.mark.parametrize("options", [{}, {"region": 2}, {"region": 5}])
def test_near(odd, odd_rows, options):
    sets, label = brute_components(odd_rows, 85)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_groups(odd, threshold=85, **options).collect())
    want = Counter()
    for r, s, c in zip(odd_rows, sets, label, strict=True):
        name = min((x[0] for x, y in zip(odd_rows, label, strict=True) if y == c and x[0] is not None), default=None) if s else r[0]
        want[r[0], len(s), name, r[0] == name] += 1
    assert got == want


def test_near_large_group(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 300)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"v{rng.randint(0, 500)}" for _ in range(80))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(df, threshold=85, region=16).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_recall_in_a_crowd(spark, threshold):
    """Documents that share 80 to 90 % of a template, too little to be linked, with near copies planted among them."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    template, rows = rng.choices(words, k=300), []
    for i in range(900):
        own = rng.randint(30, 60)
        text = template[: 300 - own] + rng.choices(words, k=own)
        text[rng.randrange(200)] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
        if i % 10 == 0:
            k = rng.randint(4, 20)
            at = rng.randrange(300 - k)
            text[at : at + k] = rng.choices(words, k=k)
            rows.append((len(rows), " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if 100 * (c := len(sets[i] & sets[j])) >= threshold * (len(sets[i]) + len(sets[j]) - c)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=threshold).collect()}
    assert len(links) > 50 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


def test_near_links_by_one_common_neighbour(spark):
    """Copies of a text that are near it but not near each other make one group, whatever its size."""
    import random

    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        text, at = list(base), rng.randrange(180)
        text[at : at + 16] = [f"e{i}x{k}" for k in range(16)]
        rows.append((i, " ".join(text)))
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=80).collect()
    sets = [shingles(t) for _, t in rows]
    near = [100 * (c := len(sets[0] & s)) >= 80 * (len(sets[0]) + len(s) - c) for s in sets]
    assert sum(near) > 290 and all(r["component_id"] == 0 for r in got if near[r["doc_id"]])


def test_forest_regions():
    import numpy as np

    rng = np.random.default_rng(3)
    lcp = np.append(-1, rng.choice([0, 1, 2, 3, 4, 5, 8, 12], 2000, p=[0.1, 0.1, 0.05, 0.05, 0.2, 0.2, 0.15, 0.15]))
    lcp[700:1500] = 12
    regions = neardup.forest_regions(lcp, 16)
    assert all(2 <= len(r) <= 16 for r in regions)
    inside = {i for r in regions for i in r.tolist()}
    after = np.append(lcp, -1)
    # whoever has a neighbour with a prefix of UP values or more meets someone
    assert inside >= {i for i in range(len(lcp)) if max(after[i], after[i + 1]) >= neardup.UP}
    # neighbours in a run of equal values meet each other
    pairs = {(a, b) for r in regions for a, b in zip(r.tolist()[:-1], r.tolist()[1:], strict=True)}
    assert all((i - 1, i) in pairs for i in range(705, 1495))
    assert neardup.forest_regions(np.zeros(0, int), 16) == [] and neardup.forest_regions(np.array([-1]), 16) == []


def test_near_empty(none):
    assert neardup.near_groups(none).isEmpty()


# --- 8 repeated strings


def test_repeats(odd, odd_rows):
    from tessera.llm import kernels as K

    def brute(length):
        seen, out = set(), Counter()
        rows = {(r[0], r[1] or "") for r in odd_rows}
        ties = {t: h for t, h in odd.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        times = Counter((r[0], r[1] or "") for r in odd_rows)
        for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]])):
            b = t.encode()
            mark = bytearray(len(b))
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                if w in seen:
                    mark[k : k + length] = b"\1" * length
                else:
                    seen.add(w)
            kept = bytes(x for x, y in zip(b, mark, strict=True) if not y)
            spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
            out[i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()] += times[i, t]
        return out

    assert K.CHUNK
    got = repeats.strip_repeats(odd, 100)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == brute(100)


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_of_whole_rows(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    text, other = " ".join(f"w{i}" for i in range(90)), " ".join(f"v{i}" for i in range(90))
    rows = [(1, text)] * 3 + [(2, text + " tail")] * 2 + [(3, other)] * 2 + [(None, other + " " + other)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    want = Counter([(1, 0, text)] * 3 + [(2, len(text), " tail")] * 2 + [(3, len(other), "")] * 2 + [(None, len(other), other + " ")] * 2)
    got = repeats.strip_repeats(df, 100, with_text=True).collect()
    assert Counter((r["doc_id"], r["n_removed"], bytes(r["kept_text"]).decode()) for r in got) == want


def test_repeats_dealt_anew(spark, odd, monkeypatch):
    from tessera.llm.common import documents  # noqa: F401

    a = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in repeats.strip_repeats(odd, 100).collect()}
    monkeypatch.setattr(repeats, "HOT", 1)
    b = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in repeats.strip_repeats(odd, 100).collect()}
    assert a == b


def test_repeats_parts_follow_the_segments(spark, odd):
    from tessera.llm.common import text_bytes

    rows = odd.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    assert text_bytes(rows, "text") == rows.agg(F.sum(F.octet_length("text"))).first()[0]
    spans = lambda n: Counter(tuple(r) for r in repeats.repeated_spans(rows, 100, part_segments=n).select("id", "tie", "start", "stop").collect())
    mark = lambda n: {(i, t, k) for i, t, a, b in spans(n) for k in range(a, b)}
    assert mark(1) == mark(1 << 15) != set()


def test_repeats_part_memory_is_bounded():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    n, length = 200_000, 100
    size = np.full(n, 168)
    raw = rng.integers(97, 123, (n, 168)).astype(np.uint8)
    content = [x.tobytes() for x in raw]
    del raw
    ids, zero = np.arange(n), np.zeros(n, np.int64)
    tracemalloc.start()
    try:
        repeats.meet_part(ids // 3, ids, zero, zero, size, np.full(n, 68, np.int32), content, length)
        assert tracemalloc.get_traced_memory()[1] < 400e6
    finally:
        tracemalloc.stop()


def test_slices_keep_keys_whole():
    import numpy as np

    key = np.random.default_rng(0).integers(0, 40, 300)
    got = repeats.slices(key, 20)
    assert [set(key[a]) & set(key[b]) for i, a in enumerate(got) for b in got[:i]] == [set()] * (len(got) * (len(got) - 1) // 2)
    assert sorted(np.concatenate(got).tolist()) == [i for i in range(300) if (key == key[i]).sum() > 1]


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    at = np.arange(480)
    group = at % 3
    order, same = repeats.suffix_order(data, at, group, 12)
    raw = data.tobytes()
    keys = [(group[i], raw[at[i] : at[i] + 12]) for i in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False] + [a == b for a, b in zip(keys[1:], keys[:-1], strict=True)]


def test_repeats_empty(none):
    assert repeats.strip_repeats(none).isEmpty()


# --- 9 language model


def test_lm(odd, odd_rows):
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter()
    for r in odd_rows:
        if train(r[0]):
            c.update(WORD.findall(fold(r[1])))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = lm.score(odd, F.coalesce(id_bucket("doc_id", 5) != 1, F.lit(False)), states=3, symbols=256, rounds=2, stretch=16)
    want = Counter()
    for r in odd_rows:
        w = [*WORD.findall(fold(r[1])), None]
        want[r[0], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    got = out.collect()
    assert Counter((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 4)) for g in got) == want
    assert all(g["score"] < 0 and math.isfinite(g["score"]) for g in got)


def test_hmm_likelihood_is_exact_and_sums_to_one():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit = rng.random((4, 2))
    m = lm.Hmm(emit / emit.sum(0), 0.7)
    m.start = np.array([0.3, 0.7])
    texts = list(itertools.product(range(4), repeat=3))
    off = np.arange(0, 3 * len(texts) + 1, 3)
    p = 10 ** m.log10_likelihood(np.array(texts).ravel(), off)
    assert p.sum() == pytest.approx(1)
    brute = sum(m.start[a] * m.emit[0, a] * m.move[a, b] * m.emit[1, b] * m.move[b, c] * m.emit[2, c] for a in range(2) for b in range(2) for c in range(2))
    assert p[texts.index((0, 1, 2))] == pytest.approx(brute)


def test_baum_welch_raises_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(0)
    s = np.concatenate([rng.integers(0, 3, 40) + 3 * (i % 2) for i in range(20)])
    off = np.arange(0, 801, 40)
    mass = np.ones(6)
    m = lm.Hmm.seeded([s[:40], s[40:80]], mass, 2)
    before = m.log10_likelihood(s, off).sum()
    for _ in range(3):
        m = m.update(*m.expect(s, off, 40), mass, 1e-6)
    assert m.log10_likelihood(s, off).sum() > before


def test_lm_empty_and_untrained(none, odd):
    assert lm.score(none, F.lit(True), states=2, symbols=256, rounds=1).isEmpty()
    got = lm.score(odd, F.lit(False), states=2, symbols=256, rounds=1).collect()
    assert all(g["train_tokens"] == 0 and g["n_known"] == 0 and math.isfinite(g["score"]) for g in got)


# --- 2, 3, 5 classifiers


def test_langid(odd, odd_rows, none):
    held = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    got = rows_of(langid.predict(odd, langid.fit(odd, ~held), also={"held_out": held}))
    assert len(got) == len(odd_rows)
    und = {str(g["doc_id"]) for g in got if g["lang_pred"] == "und"}
    assert und == {"100", "101", "102", "113"}
    assert all(0 <= g["score"] <= 1 for g in got)
    assert langid.predict(none, langid.fit(none, F.lit(True))).isEmpty()
    assert all(g["lang_pred"] == "und" for g in rows_of(langid.predict(odd, langid.fit(none, F.lit(True)))))


def test_langid_prior_counts_all_rows(spark):
    import numpy as np

    rows = [(i, f"some text {i}", "en" if i % 4 else "de") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), per_lang=50)
    assert model.langs == ["de", "en"]
    assert np.exp(model.prior) == pytest.approx([101 / 402, 301 / 402])


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(odd, odd_rows, none, some_labels, module, label):
    allowed = F.coalesce(id_bucket("doc_id", 5) != 0, F.lit(False))
    model = module.fit(odd, some_labels, allowed, label)
    got = rows_of(module.score(odd, model))
    assert len(got) == len(odd_rows) and all(0 <= g["score"] <= 1 and g["predicted"] in (0, 1) for g in got)
    again = module.fit(odd.repartition(6), some_labels, allowed, label)
    assert sorted((str(g["doc_id"]), g["score"]) for g in got) == sorted((str(g["doc_id"]), g["score"]) for g in rows_of(module.score(odd, again)))
    assert module.score(none, module.fit(none, some_labels, allowed, label)).isEmpty()


