"""The pipeline's stages over odd rows, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_edge_cases import brute_components, fold


@pytest.fixture(scope="module")
def home(spark, odd, some_labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{d}/documents.parquet")
    some_labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_follow_the_contract():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]


def test_quality_stage_keeps_rows_as_they_are(spark, odd, home):
    out = P.filter_quality(spark, odd, home)
    assert out.columns == odd.columns
    rows = Counter(odd.collect())
    assert not Counter(out.collect()) - rows


def test_exact_stage(spark, odd, odd_rows, home):
    got = P.drop_exact_copies(spark, odd, home)
    assert got.columns == odd.columns
    texts = Counter(fold(r["text"]) for r in got.select("text").collect())
    best = {}
    for r in odd_rows:
        t = fold(r[1])
        best[t] = r[0] if best.get(t) is None else max(best[t], r[0]) if r[0] is not None else best[t]
    assert set(texts) == set(best)
    assert {(r["doc_id"], fold(r["text"])) for r in got.collect()} == set(zip(best.values(), best, strict=True))
    assert got.count() == len(best)


def test_exact_stage_matches_rows_and_not_ids_alone(spark, home):
    a, b = "first text of the id", "second text of the id"
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (9, b.upper(), "y"), (9, b, "y"), (9, b, "z")], "doc_id bigint, text string, place string")
    got = [tuple(r) for r in P.drop_exact_copies(spark, docs, home).collect()]
    assert sorted(got) == [(5, a, "x"), (9, b.upper(), "y")]


def test_near_stage_keeps_one_row_of_a_group(spark, home):
    words = [f"w{i}" for i in range(60)]
    a, b, other = " ".join(words), " ".join([*words, "tail"]), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (9, b + " end"), (5, other), (7, other), (3, " "), (4, "")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in P.drop_near_copies(spark, docs, home).collect())
    assert [i for i, _ in got] == [3, 4, 5, 5]
    assert sorted(t[:2] for i, t in got if i == 5) == ["v0", "w0"]


def test_near_stage(spark, odd, odd_rows, home):
    _, label = brute_components(odd_rows, 80)
    want = {min((r[0] for r, c in zip(odd_rows, label, strict=True) if c == k and r[0] is not None), default=None) for k in set(label)}
    got = P.drop_near_copies(spark, odd, home)
    assert got.columns == odd.columns and {r["doc_id"] for r in got.select("doc_id").collect()} == want


def test_mix_stage(spark, odd, odd_rows, home):
    got = P.mix_sources(spark, odd, home)
    assert got.columns == odd.columns
    rows = Counter(r[0] for r in odd_rows)
    assert all(n <= 3 * rows[i] for i, n in Counter(r["doc_id"] for r in got.select("doc_id").collect()).items())


def test_whole_pipeline(spark, home):
    out = P.run(spark, home)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_pipeline(spark, none, some_labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    some_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).isEmpty()
