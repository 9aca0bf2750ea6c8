"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are taken as characters (A-Z in lower case); the n-grams of one to three characters fall into hash buckets. The
model is a matrix of log probabilities, languages by buckets, which is broadcast: at most MAX_CELLS numbers, as there are
fewer buckets where there are very many languages (over 340 at the default).
A batch is scored as a sparse product: the bucket of each n-gram picks the matrix's column, and runs of columns are
summed per document.

Fitted on a bounded sample: at most about per_lang documents a language, chosen by a hash of the id; every language is
learnt, and a column with more than MAX_LANGS values is refused as no language column. The prior is the share of all
rows, not of the sample. Defined results: null text, or one without a letter, is `und` with score 0; with nothing to
learn from, everything is `und`; repeated rows are scored each; ties go to the language that sorts first. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import uniform
from tessera.llm.training import fit_once

ORDERS = (1, 2, 3)
#: Numbers of the matrix (128 MB), and values of a language column.
MAX_CELLS, MAX_LANGS = 1 << 25, 1 << 14
FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def gram_buckets(chars: np.ndarray, off: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram that lies within its document, and the documents' offsets in them."""
    count = len(chars) - n + 1
    lengths = np.diff(off)
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    h = chars[:count] * FACTORS[0] + np.uint32(n)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * FACTORS[1] + chars[k : k + count] * FACTORS[2]
    h = (h ^ (h >> np.uint32(13))) * FACTORS[1]
    bucket = h >> np.uint32(32 - bits)
    if n > 1:
        whole = np.ones(count, bool)
        for k in range(1, n):
            at = off[1:-1] - k
            whole[at[(at >= 0) & (at < count)]] = False
        # a text shorter than n has no n-gram, even where the marks above leave one
        bucket = bucket[whole]
    per = np.maximum(lengths - n + 1, 0)
    out = np.zeros(len(off), np.int64)
    np.cumsum(per, out=out[1:])
    return bucket, out


def lower_chars(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.code_points(K.LOWER[buf], off)


class NgramModel:
    """Log probabilities: prior (languages), table (orders, languages, buckets)."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray, bits: int):
        self.langs, self.prior, self.table, self.bits = langs, prior, table, bits

    @classmethod
    def fit(cls, texts: pa.Table, of_lang: dict[str, int], bits: int, smoothing: float) -> NgramModel:
        """of_lang has the number of all rows of each language that may be learnt from; the prior is their share."""
        langs = sorted({x for x in texts.column("lang").to_pylist() if x is not None}) if texts.num_rows else []
        number = {x: i for i, x in enumerate(langs)}
        counts = np.zeros((len(ORDERS), len(langs), 1 << bits))
        rows = np.array([of_lang[x] for x in langs], float)
        for batch in texts.to_batches():
            for part, buf, off in K.chunks(batch, "text"):
                lang = np.array([number[x] for x in part.column(part.schema.get_field_index("lang")).to_pylist()])
                chars, ends = lower_chars(buf, off)
                for i, n in enumerate(ORDERS):
                    bucket, at = gram_buckets(chars, ends, n, bits)
                    own = np.repeat(lang, np.diff(at))
                    counts[i] += np.bincount(own * (1 << bits) + bucket, minlength=counts[i].size).reshape(counts[i].shape)
        counts += smoothing
        table = np.log(counts / counts.sum(axis=2, keepdims=True)) if langs else counts
        return cls(langs, np.log((rows + 1) / (rows.sum() + len(langs))) if langs else rows, table.astype(np.float32), bits)

    def posterior(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each language, a row for each document."""
        chars, ends = lower_chars(buf, off)
        score = np.repeat(self.prior[None, :], len(off) - 1, axis=0)
        for i, n in enumerate(ORDERS):
            bucket, at = gram_buckets(chars, ends, n, self.bits)
            for j in range(len(self.langs)):
                score[:, j] += K.segment_sum(self.table[i, j][bucket].astype(np.float64), at)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, allowed: Column, per_lang: int, seed: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, dict[str, int]]:
    """The chosen rows, and the number of all rows of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(allowed, F.lit(False)))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"{lang_col} has more than {MAX_LANGS} values")
    if not counts:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(0), {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["n"]))])
    chosen = rows.where(uniform(F.col(id_col), F.lit(seed)) < F.coalesce(F.element_at(share, F.col(lang_col)), F.lit(0.0)))
    return chosen.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), {r["lang"]: r["n"] for r in counts}


def fit(docs: DataFrame, allowed: Column, per_lang: int = 2000, bits: int = 15, smoothing: float = 0.5, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> NgramModel:
    chosen, of_lang = sample(docs, allowed, per_lang, seed, id_col, text_col, lang_col)
    while bits > 4 and len(of_lang) * len(ORDERS) << bits > MAX_CELLS:
        bits -= 1
    return fit_once(chosen, lambda t: NgramModel.fit(t, of_lang, bits, smoothing))


def predict(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of also, lang_pred and score, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col), *[c.alias(n) for n, c in (also or {}).items()], letters.alias("__letters"), F.col(text_col).alias("__text"))
    kept = rows.columns[:-2]

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, buf, off in K.chunks(batch, "__text"):
                known = np.asarray(part.column(part.schema.get_field_index("__letters")).to_numpy(zero_copy_only=False), bool)
                lang, score = np.full(len(known), "und", object), np.zeros(len(known))
                if m.langs:
                    p = m.posterior(buf, off)
                    best = p.argmax(axis=1)
                    lang[known] = np.array(m.langs, object)[best[known]]
                    score[known] = p[np.arange(len(p)), best][known]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
