"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exactdup, langid, lm, mixing, neardup, packing, quality, repeats, topk, toxicity
from tessera.llm.common import documents, id_bucket


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def _held_out(modulus: int, remainder: int):
    return F.coalesce(id_bucket("doc_id", modulus) == remainder, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), _held_out(3, 1)
    return langid.predict(docs, langid.fit(docs, ~held_out), also={"held_out": held_out})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), _held_out(5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels, ~held_out), also={"held_out": held_out})


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), _held_out(5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels, ~held_out), also={"held_out": held_out})


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(documents(spark, sf_dir), threshold=85).drop("text_hash", "component")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_strip_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_repeats(documents(spark, sf_dir))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _held_out(5, 1)
    return lm.score(documents(spark, sf_dir), ~held_out, also={"held_out": held_out})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(documents(spark, sf_dir), keep="max").withColumnRenamed("digest", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_langid": op2_langid,
    "op3_toxicity": op3_toxicity,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_neardup": op6_neardup,
    "op7_topk": op7_topk,
    "op8_strip_repeats": op8_strip_repeats,
    "op9_hmm": op9_hmm,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE: dict[str, str] = {
    "op4_mix": """
        WITH d AS (SELECT doc_id, source, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h,
                     CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
        o AS (SELECT *, sum(source_size * 3) OVER k - source_size * 3 AS used, sum(weight) OVER () - sum(weight) OVER k + weight AS rest,
                sum(source_size) OVER () AS total
              FROM w WINDOW k AS (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT max(CAST(total - used AS DOUBLE) / rest) FILTER (WHERE source_size * 3 >= CAST(total - used AS DOUBLE) / rest * weight) AS level FROM o),
        t AS (SELECT source, source_size, CASE WHEN source_size * 3 < level * weight THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target,
                sum(source_size) OVER () AS total FROM w, v),
        q AS (SELECT d.*, source_size, target, total, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT q.*, e, CAST(e * source_size + ahead AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) x(e) WHERE size > 0),
        m AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto FROM c),
        k AS (SELECT doc_id, sum(size) AS taken FROM m WHERE upto <= total GROUP BY doc_id)
        SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
        FROM q LEFT JOIN k ON q.doc_id = k.doc_id""",
    "op6_neardup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM w),
        s AS (SELECT doc_id, unnest(g) AS g FROM g), n AS (SELECT doc_id, len(g) AS n FROM g),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, n.doc_id = min(b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.e::DOUBLE[], b.e::DOUBLE[]) AS BIGINT) AS score
              FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_strip_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
        f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
        b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f),
        k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b),
        s AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY ALL),
        p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM s),
        g AS (SELECT p.doc_id, CAST(sum(z - a) AS BIGINT) AS r, count(*) AS c, max(z) AS z, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS t FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans,
          sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
