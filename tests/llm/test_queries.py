"""The registered queries over whole tables: against their SQL, and learned operators by held-out accuracy and by
recomputing their scores in plain Python from what they have learnt."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import langid, lm, quality, toxicity
from tessera.llm.common import id_bucket, uniform
from tessera.llm.queries import ORACLE, QUERIES
from tessera.llm.training import labelled_parts, sparse, summed
from tests.llm.test_edge_cases import WORD, fold

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = Counter(tuple(map(plain, r)) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.select(names).collect()) == want


def test_near_duplicates_have_the_columns_and_rows_of_their_sql(spark, duck):
    df = QUERIES["op6_neardup"](spark, LARGER)
    duck.execute(f"CREATE SCHEMA larger; CREATE VIEW larger.documents AS SELECT * FROM '{LARGER}/documents.parquet'; SET schema = 'larger'")
    try:
        result = duck.execute(ORACLE["op6_neardup"])
        names, want = [c[0] for c in result.description], Counter(result.fetchall())
    finally:
        duck.execute("SET schema = 'main'")
    assert df.columns == names and Counter(map(tuple, df.collect())) == want


def test_sql_has_the_contracts_columns_only(spark):
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) == 10


def auc(rows):
    """Share of pairs of both labels that the score puts in order."""
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_langid_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op2_langid"](spark, LARGER).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got) and len(got) == len(langs)
    own = [r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"] and langs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(own) > 200 and np.mean(own) >= 0.97


@pytest.mark.parametrize(("name", "label", "threshold", "floor"), [("op3_toxicity", "toxic", 0.5, 0.95), ("op5_quality", "quality", 0.3, 0.95)])
def test_classifier_held_out(spark, name, label, threshold, floor):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = QUERIES[name](spark, LARGER).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and r["predicted"] == (r["score"] >= threshold) for r in got)
    rows = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert len(rows) > 30 and auc(rows) >= floor


def test_language_model_beats_its_base_on_held_out_texts(spark):
    got = QUERIES["op9_hmm"](spark, LARGER).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 1) for r in got)
    own = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


# --- scores recomputed one by one


def texts_of(odd_rows):
    return [r[1] or "" for r in odd_rows if len(r[1] or "") < 3000]


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_langid_scores_by_hand(spark, odd, odd_rows):
    m = langid.fit(odd, F.lit(True), bits=10)
    texts = texts_of(odd_rows)
    p = m.posterior(*chunk(texts))

    def bucket(gram):
        h, mask = ord(gram[0]) * int(langid.FACTORS[0]) + len(gram), 0xFFFFFFFF
        h &= mask
        for c in gram[1:]:
            h = ((h ^ (h >> 15)) * int(langid.FACTORS[1]) & mask) + (ord(c) * int(langid.FACTORS[2]) & mask) & mask
        h = (h ^ (h >> 13)) * int(langid.FACTORS[1]) & mask
        return h >> (32 - m.bits)

    for t, row in zip(texts, p, strict=True):
        s = m.prior.copy()
        for i, n in enumerate(langid.ORDERS):
            for k in range(len(fold(t)) - n + 1):
                s += m.table[i, :, bucket(fold(t)[k : k + n])]
        e = np.exp(s - s.max())
        assert row == pytest.approx(e / e.sum(), abs=1e-6)


def test_quality_scores_by_hand(spark, odd, odd_rows, some_labels):
    m = quality.fit(odd, some_labels, F.lit(True))
    for t in texts_of(odd_rows):
        x = quality.features(*chunk([t]))[0]
        b = [sum(v >= e for e in edges) for v, edges in zip(x, m.edges, strict=True)]
        z = m.intercept + sum(table[k] for table, k in zip(m.single, b, strict=True)) + sum(table[b[i]][b[j]] for i, j, table in m.pairs)
        assert m.score(*chunk([t]))[0] == pytest.approx(1 / (1 + math.exp(-z)))
    words = "Aa bb  bb 12!"
    named = dict(zip(quality.FEATURES, quality.features(*chunk([words]))[0], strict=True))
    assert named["log_words"] == pytest.approx(math.log(5)) and named["repeats"] == 0.25 and named["distinct"] == 0.75 and named["digits"] == pytest.approx(2 / 13)


def test_toxicity_scores_by_hand(spark, odd, odd_rows, some_labels):
    m = toxicity.fit(odd, some_labels, F.lit(True))
    texts = texts_of(odd_rows)[:20]
    rows, ends = toxicity.word_rows(*chunk(texts), m.bits)
    p = m.probability(rows, ends)
    for i in range(len(texts)):
        own = rows[:, ends[i] : ends[i + 1] + toxicity.PAD]
        x = np.where(own[0][:, None] == 0, 0, m.table[own].sum(axis=0))
        tops = []
        for w, kernel in zip(toxicity.WIDTHS, m.kernels, strict=True):
            spans = range(ends[i + 1] - ends[i])
            tops.append(np.max([sum(x[k + j] @ kernel[j] for j in range(w)) for k in spans], axis=0))
        z = np.maximum(np.concatenate(tops) + m.bias.ravel(), 0) @ m.out + m.base
        assert p[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_toxicity_calibrates_on_rows_held_back(spark, monkeypatch):
    rows = [(i, ("you foul rude thing " if i % 2 else "a calm kind note ") + f"w{i % 17} x{i % 5}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.98


@pytest.mark.parametrize("options", [{}, {"part_bytes": 1 << 15}])
def test_toxicity_learns_from_all_labelled_documents(spark, options):
    """A word that only those of 3,600 documents of a label have that a sample of 3,000 by the hash of their ids leaves out."""
    ids = spark.range(7200).select("id", (F.col("id") % 2).cast("int").alias("toxic"))
    order = [r["id"] for r in ids.where("toxic = 1").orderBy(uniform(F.col("id"), F.lit(11)), "id").collect()]
    rare = set(order[3000:])
    rows = [(i, f"note w{i % 17} x{i % 5} " + ("gronk" if i in rare else "foul" if i % 2 else "calm" if i % 3 else "plain"), "en") for i in range(7200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = toxicity.fit(docs, ids.withColumnRenamed("id", "doc_id"), F.lit(True), **options)
    got = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] for r in got if r["doc_id"] in rare]) > 0.99
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.99


def test_labelled_parts_hold_every_labelled_document_once(spark, odd, odd_rows, some_labels):
    for part_bytes in (1 << 24, 1 << 10):
        parts, n = labelled_parts(odd, some_labels, "toxic", F.lit(True), lambda t: t.select(["part", "id", "text", "label", "lang"]), "part long, id long, text string, label long, lang string", part_bytes, 1, "doc_id", "text", "lang")
        want = Counter((i, text, i % 2, lang) for i, text, lang, *_ in odd_rows if i is not None and i < 60)
        assert Counter((r["id"], r["text"], r["label"], r["lang"]) for r in parts.collect()) == want and (n > 1) == (part_bytes < 1 << 20)


def test_matrices_are_added_as_a_tree(spark):
    rng = np.random.default_rng(2)
    found = [rng.integers(0, 3, (9, 2)) * (rng.random((9, 1)) < 0.4) for _ in range(300)]
    rows = spark.createDataFrame([(i, *map(bytearray, sparse(m).values())) for i, m in enumerate(found)], "part long, at binary, v binary")
    assert (summed(rows, 300, (9, 2)) == sum(found)).all()


def test_threshold_from_counts():
    counts = np.zeros((1000, 2))
    counts[100:300, 0], counts[250, 1], counts[600:700, 1] = 3, 2, 5
    p = [(k + 0.5) / 1000 for k in range(1000)]
    errors = lambda t: sum(c[1] for x, c in zip(p, counts, strict=True) if x < t) / 502 + sum(c[0] for x, c in zip(p, counts, strict=True) if x >= t) / 600
    t = toxicity.best_threshold(counts)
    assert t == pytest.approx(0.45) and errors(t) == pytest.approx(min(errors(x) for x in (*p, 1)))


def test_lm_scores_by_hand(spark, odd, odd_rows):
    options = {"states": 3, "symbols": 256, "rounds": 2, "stretch": 16}
    train = F.coalesce(id_bucket("doc_id", 5) != 1, F.lit(False))
    found = lm.fit(odd, train, **options)
    counts = {r["word"]: r["n"] for r in found.counts.collect()}
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(odd, train, **options).collect()}
    m = found.model
    for r in odd_rows:
        words = [w.encode() for w in WORD.findall(fold(r[1]))]
        if len(words) > 2000:
            continue
        hashes = [int(lm.hashed_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in words]
        total, a = 0.0, None
        for h in [*hashes, None]:
            symbol = 256 if h is None else h & 255
            if h is not None:
                n = counts.get(h - (1 << 64) if h >> 63 else h, 0)
                total += math.log10((n + 0.5) / found.mass[symbol])
            a = (m.start if a is None else a @ m.move) * m.emit[symbol]
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[r[0], len(words) + 1] == pytest.approx(total)


def test_no_operator_hides_an_import_error():
    for name in ("corpus_pipeline.py", "tessera/llm"):
        top = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(__file__))), name)
        files = [top] if top.endswith(".py") else [os.path.join(top, f) for f in os.listdir(top) if f.endswith(".py")]
        for f in files:
            with open(f, encoding="utf-8") as text:
                assert not re.search(r"except (\(?ImportError|ModuleNotFound)", text.read())


assert K.CHUNK
