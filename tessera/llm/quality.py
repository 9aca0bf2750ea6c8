"""Quality: a generalised additive model with pairwise interactions.

Each text gives a row of numbers about its characters, words and lines. Every feature has up to max_bins bins by the
sample's quantiles. Training boosts cyclically: a round visits each feature in turn and adds a small tree of that
feature alone (up to four leaves over its bins) to the feature's lookup table; then the pairs whose residual gains most
from a joint split are boosted the same way, with trees of one cut on either side. A text's score is the logistic
function of the sum of its bins' entries.

Fitted on a bounded sample of labelled documents: at most per_class of each label; the intercept is corrected for the
sampling of the labels. Defined results: null text counts as empty; empty texts get the score of their bins; with labels
of one kind only, the score is that label's constant; repeated rows are scored each. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.toxicity import score_texts
from tessera.llm.training import fit_once, labelled_sample


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars if isinstance(chars, bytes) else chars.encode())] = True
    return out


UPPER = _table(bytes(range(65, 91)))
LETTER = UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(128, 256)))
DIGIT = _table("0123456789")
STOP, SHOUT, BAR = _table(".,;:?"), _table("!"), _table("|")
SYMBOL = _table("#$%&*+/<=>@[]\\^_`{}~")
NEWLINE = _table("\n")
FEATURES = (
    "log_words", "mean_word", "upper", "digits", "stops", "shouts", "bars", "symbols", "repeats", "distinct",
    "symbol_words", "upper_words", "lone_marks", "mean_line", "repeated_lines", "letters",
)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    share = lambda table: K.segment_count(table[buf], off) / size
    start, end, doc = K.words(buf, off)
    at = K.per_doc(doc, n)
    count = np.diff(at)
    some = np.maximum(count, 1)
    prefix = K.prefix_hash(buf)
    word = K.span_hash(prefix, start, end)
    same = np.zeros(len(start), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    d, _ = K.distinct_pairs(doc, word)
    inside = lambda table: np.concatenate([[0], np.cumsum(table[buf])])
    marks, letters, upper = inside(SYMBOL | SHOUT | BAR), inside(LETTER), inside(UPPER)
    per_word = lambda mask: K.segment_count(mask, at) / some
    n_upper, n_letters = upper[end] - upper[start], letters[end] - letters[start]
    cuts = np.flatnonzero(NEWLINE[buf])
    line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], cuts + 1]))
    line_start = line_start[line_start < len(buf)]
    stop = np.unique(np.concatenate([off[1:], cuts]))
    line_end = stop[np.searchsorted(stop, line_start)] if len(line_start) else line_start
    line_doc = np.searchsorted(off, line_start, "right") - 1
    full = line_end > line_start
    lines = np.maximum(np.bincount(line_doc[full], minlength=n), 1)
    ld, _ = K.distinct_pairs(line_doc[full], K.span_hash(prefix, line_start[full], line_end[full]))
    return np.stack([
        np.log1p(count), K.segment_sum((end - start).astype(float), at) / some, share(UPPER), share(DIGIT), share(STOP),
        share(SHOUT), share(BAR), share(SYMBOL), per_word(same), np.bincount(d, minlength=n) / some,
        per_word(marks[end] > marks[start]), per_word((n_upper == n_letters) & (n_letters > 0)),
        per_word((n_letters == 0) & (end - start <= 2)), count / lines, 1 - np.bincount(ld, minlength=n) / lines, share(LETTER),
    ], axis=1)


class AdditiveModel:
    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.single: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept, self.constant = 0.0, None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def logit(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.intercept)
        for j, table in enumerate(self.single):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[b[:, i], b[:, j]]
        return z

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        return 1 / (1 + np.exp(-self.logit(self.bins(features(buf, off)))))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, max_bins: int, rounds: int, n_pairs: int, rate: float) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bins(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.single = [np.zeros(s) for s in sizes]
        share = np.average(y, weights=weight)
        self.intercept = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.intercept)

        def slopes():
            p = 1 / (1 + np.exp(-z))
            return (y - p) * weight, p * (1 - p) * weight

        for _ in range(rounds):
            for j, s in enumerate(sizes):
                g, h = slopes()
                leaf = line_tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), 2)
                self.single[j] += rate * leaf
                z += rate * leaf[b[:, j]]
        g, h = slopes()
        gains = []
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes)):
                flat = b[:, i] * sizes[j] + b[:, j]
                shape = (sizes[i], sizes[j])
                _, gain = square_tree(np.bincount(flat, g, sizes[i] * sizes[j]).reshape(shape), np.bincount(flat, h, sizes[i] * sizes[j]).reshape(shape))
                gains.append((-gain, i, j))
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(gains)[:n_pairs]]
        for _ in range(rounds // 4):
            for i, j, table in self.pairs:
                g, h = slopes()
                flat = b[:, i] * sizes[j] + b[:, j]
                leaf, _ = square_tree(np.bincount(flat, g, table.size).reshape(table.shape), np.bincount(flat, h, table.size).reshape(table.shape))
                table += rate * leaf
                z += rate * leaf[b[:, i], b[:, j]]


DAMP = 1.0


def line_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree of this depth over ordered bins, from the bins' slopes and curvatures."""
    total = g.sum() / (h.sum() + DAMP)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), total)
    a, c = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (c + DAMP) + (g.sum() - a) ** 2 / (h.sum() - c + DAMP)
    k = int(gain.argmax()) + 1
    return np.concatenate([line_tree(g[:k], h[:k], depth - 1), line_tree(g[k:], h[k:], depth - 1)])


def square_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best single cut on each of two features: the four quadrants' steps, and the gain over one step for all."""
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    a, c = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tl = lambda m: m[:-1, :-1]
    tr = lambda m: m[:-1, -1:] - m[:-1, :-1]
    bl = lambda m: m[-1:, :-1] - m[:-1, :-1]
    br = lambda m: m[-1, -1] - m[:-1, -1:] - m[-1:, :-1] + m[:-1, :-1]
    gain = sum(q(a) ** 2 / (np.maximum(q(c), 0) + DAMP) for q in (tl, tr, bl, br))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = np.empty(g.shape)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            leaf[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + DAMP)
    return leaf, float(gain[i, j] - a[-1, -1] ** 2 / (c[-1, -1] + DAMP))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = 4000, max_bins: int = 32, rounds: int = 60, n_pairs: int = 8, rate: float = 0.2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, allowed, per_class, seed, id_col, text_col)
    shares = dict(labels.where(F.col(label).isin(0, 1) & F.coalesce(allowed, F.lit(False))).groupBy(label).agg(F.count(F.lit(1))).collect())

    def train(table: pa.Table) -> AdditiveModel:
        model = AdditiveModel()
        y = np.asarray(table.column("label").combine_chunks()).astype(float) if table.num_rows else np.zeros(0)
        if len(set(y.tolist())) < 2:
            model.constant = float(y.mean()) if len(y) else 0.5
            return model
        x = np.concatenate([features(buf, off) for batch in table.to_batches() for _, buf, off in K.chunks(batch, "text")])
        # the sample holds as many of each label as it can; weights give back the shares among all labels
        own = np.bincount(y.astype(int), minlength=2)
        weight = np.array([shares.get(k, 0) / max(own[k], 1) for k in (0, 1)])[y.astype(int)]
        model.fit(x, y, weight / weight.mean(), max_bins, rounds, n_pairs, rate)
        return model

    return fit_once(sample, train)


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None, threshold: float = 0.3) -> DataFrame:
    """id, the columns of also, score and predicted, for every row of docs."""
    return score_texts(docs, model.score, id_col, text_col, also, threshold)


def accepted(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of the threshold or more, as they are. Only texts go to Python, only scores return."""
    shared = docs.sparkSession.sparkContext.broadcast(model.score)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            batch = pa.RecordBatch.from_arrays([text], ["text"])
            parts = [shared.value(buf, off) for _, buf, off in K.chunks(batch, "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.where(scored(F.col(text_col)) >= threshold)
