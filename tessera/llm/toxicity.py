"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of hashed rows for the word itself and for its first three, four and five characters, so
inflected forms share what their stem has learned. Filters of one, two and three words run over the text, each takes
its maximum over the whole text, and a logistic layer turns the maxima into a probability. Only the winning position of
a filter gets a gradient, so training touches few rows. Thresholds are calibrated by language: the language comes from
the text (naive Bayes over the same word hashes, fitted on the languages of the training documents), never from a
column, and each language's threshold is the probability that separates its labelled documents best. A fifth of the
labelled documents is held back from training and calibrates; where it has fewer than MIN_HELD_BACK documents of either
label, all of them do. The score is the probability stretched so that the threshold of the text's language becomes 0.5.

Fitted on all labelled documents. They are dealt by a hash of the id into parts of about PART_BYTES of text. In every
epoch each part goes on from the common filters over all of its documents, and the parts' changes are averaged, those of
an embedding row over the parts that changed it. Counts (of word rows, languages, and labels by probability in steps of
at most 2^-8) are exact sums over all parts. With one part this is training in one task.

Defined results: null text counts as empty; an empty text gets a score like any other, from the filters' value on
padding; with labels of one kind only, the score is that label's constant; a language column of more than MAX_LANGS
values names no languages, so the common threshold serves all texts; repeated rows are scored each. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import discard
from tessera.llm.training import labelled_parts, sparse, summed

WIDTHS = (1, 2, 3)
PAD = WIDTHS[-1] - 1
PARTS = 4  # word, and three prefixes
MIN_HELD_BACK = 20
#: Text of a part of the labelled documents: about 2,500 documents, and 10 MB of word rows.
PART_BYTES = 8 << 20
#: Values of a language column; numbers of the table of languages, and of the counts by probability.
MAX_LANGS, LANG_CELLS, STEP_CELLS = 1 << 14, 1 << 22, 1 << 22
#: Documents whose probabilities a task computes at once.
SLICE = 512
#: Characters that end a word's core; they are cut from both ends before hashing.
IS_EDGE = np.zeros(256, bool)
IS_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_rows(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(PARTS, n) rows of the embedding table, and the documents' offsets; every document begins with PAD empty words
    (row 0) and the last one is followed by as many, so no filter sees two documents at once."""
    buf = K.LOWER[buf]
    start, end, doc = K.words(buf, off)
    n_docs = len(off) - 1
    core = ~IS_EDGE[buf]
    at = np.flatnonzero(core)
    if len(start):
        i, j = np.searchsorted(at, start), np.searchsorted(at, end) - 1
        some = i <= j
        start, end, doc = at[i[some]], at[j[some]] + 1, doc[some]
    lead = (buf & 0xC0) != 0x80
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    char_at = np.append(np.flatnonzero(lead), len(buf))
    prefix = K.prefix_hash(buf)
    size = 1 << bits
    rows = np.empty((PARTS, len(start)), np.int64)
    for part, chars in enumerate((None, 3, 4, 5)):
        stop = end if chars is None else np.minimum(end, char_at[np.minimum(before[start] + chars, len(char_at) - 1)])
        rows[part] = part * size + 1 + (K.span_hash(prefix, start, stop) % np.uint64(size - 1)).astype(np.int64)
    counts = np.bincount(doc, minlength=n_docs)
    ends = np.zeros(n_docs + 1, np.int64)
    np.cumsum(counts + PAD, out=ends[1:])
    out = np.zeros((PARTS, ends[-1] + PAD), np.int64)
    if len(start):
        out[:, np.arange(len(start)) + PAD * (doc + 1)] = rows
    return out, ends


class TextCnn:
    def __init__(self, bits: int, dims: int, filters: int, seed: int):
        rng = np.random.Generator(np.random.Philox(seed))
        self.bits = bits
        self.table = (rng.standard_normal((PARTS << bits, dims)) * 0.05).astype(np.float32)
        self.table[:: 1 << bits] = 0
        self.kernels = [(rng.standard_normal((w, dims, filters)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), filters), np.float32)
        self.out, self.base = (rng.standard_normal(len(WIDTHS) * filters) * 0.1).astype(np.float32), np.float32(0)
        self.constant: float | None = None
        self.lang_table, self.langs, self.thresholds, self.threshold = np.zeros((0, 0), np.float32), [], np.zeros(0), 0.5

    def maxima(self, rows: np.ndarray, ends: np.ndarray, where: bool = False):
        """Largest value of each filter in each document; with where also its position."""
        x = self.table[rows[0]]
        for r in rows[1:]:
            x += self.table[r]
        x[rows[0] == 0] = 0
        best, place = [], []
        for w, kernel in zip(WIDTHS, self.kernels, strict=True):
            n = ends[-1]
            y = x[:n] @ kernel[0]
            for k in range(1, w):
                y += x[k : n + k] @ kernel[k]
            top = np.maximum.reduceat(y, ends[:-1])
            best.append(top)
            if where:
                doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                hit = np.full(top.shape, -1, np.int64)
                i, f = np.nonzero(y == top[doc])
                hit[doc[i[::-1]], f[::-1]] = i[::-1]
                place.append(hit)
        return np.concatenate(best, axis=1) + self.bias.ravel(), x, place

    def probability(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(ends) - 1, self.constant)
        z = np.maximum(self.maxima(rows, ends)[0], 0) @ self.out + self.base
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def language(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = rows[0, : ends[-1]] & (self.lang_table.shape[1] - 1)
        return np.stack([K.segment_sum(t[own].astype(np.float64), ends) for t in self.lang_table], axis=1).argmax(axis=1)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, ends = word_rows(buf, off, self.bits)
        p = self.probability(rows, ends)
        t = self.thresholds[self.language(rows, ends)] if len(self.langs) > 1 else np.full(len(p), self.threshold)
        return np.where(p >= t, 0.5 + 0.5 * (p - t) / np.maximum(1 - t, 1e-9), np.minimum(0.5 * p / np.maximum(t, 1e-9), 0.5 - 1e-9)).clip(0, 1)

    # --- training ---------------------------------------------------------------------------------------------------

    def start(self, seen: np.ndarray, n: np.ndarray) -> None:
        """The first embedding number of a row begins at the log odds of the documents that have it, so the first maxima
        already stand on telling words. seen: documents of each label that have the row; n: all of them."""
        neg, pos = seen
        at = np.flatnonzero(pos + neg)
        odds = np.log((pos[at] + 0.5) / (n[1] + 1)) - np.log((neg[at] + 0.5) / (n[0] + 1))
        weight = np.minimum(1, (pos[at] + neg[at]) / 8)
        self.table[at, 0] = (0.3 * odds * weight).astype(np.float32)
        self.table[:: 1 << self.bits] = 0
        self.kernels[0][0, 0, : self.kernels[0].shape[2] // 2] = 1
        self.base = np.float32(-1)

    def flat(self) -> np.ndarray:
        """All that is learned, in rows as wide as the table's."""
        dense = np.concatenate([*(k.ravel() for k in self.kernels), self.bias.ravel(), self.out, [self.base]]).astype(np.float32)
        width = self.table.shape[1]
        return np.concatenate([self.table, np.pad(dense, (0, -len(dense) % width)).reshape(-1, width)])

    def set_flat(self, flat: np.ndarray) -> None:
        n, flat = len(self.table), flat.astype(np.float32)
        self.table, dense = flat[:n].copy(), flat[n:].ravel()
        shapes = [*(k.shape for k in self.kernels), self.bias.shape, self.out.shape]
        *parts, rest = np.split(dense, np.cumsum([np.prod(x) for x in shapes]))
        *self.kernels, self.bias, self.out = [x.reshape(shape).copy() for x, shape in zip(parts, shapes, strict=True)]
        self.base = np.float32(rest[0])

    def epoch(self, squares: TextCnn, rows, ends, label, docs: np.ndarray, share: float, rate: float, batch: int, rng: np.random.Generator) -> None:
        """One pass over the given documents in random order. squares has the sums of squared gradients, laid out as what
        they belong to; both go on from what they are."""
        filters = self.bias.shape[1]
        cost = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))

        def step(a, s, g, at=None) -> None:
            if at is None:
                s += g * g
                a -= rate * g / (np.sqrt(s) + 1e-6)
            else:
                s[at] += g * g
                a[at] -= rate * g / (np.sqrt(s[at]) + 1e-6)

        order = rng.permutation(docs)
        for a in range(0, len(order), batch):
            docs = np.sort(order[a : a + batch])
            part, local = take(rows, ends, docs)
            m, x, place = self.maxima(part, local, where=True)
            act = np.maximum(m, 0)
            p = 1 / (1 + np.exp(-(act @ self.out + self.base)))
            d = ((p - label[docs]) * cost[docs] / len(docs)).astype(np.float32)
            g_act = d[:, None] * self.out * (m > 0)
            g_out, g_base = act.T @ d, float(d.sum())
            table_rows, table_grads, kernel_grads = [], [], []
            for i, w in enumerate(WIDTHS):
                g = g_act[:, i * filters : (i + 1) * filters]
                kernel = self.kernels[i]
                grad = np.zeros_like(kernel)
                for k in range(w):
                    at = place[i] + k
                    grad[k] = np.einsum("df,dfe->ef", g, x[at])
                    flow = (g[:, :, None] * kernel[k].T[None]).reshape(-1, kernel.shape[1])
                    for r in part:
                        table_rows.append(r[at].ravel())
                        table_grads.append(flow)
                kernel_grads.append(grad)
            step(self.bias, squares.bias, np.stack([g_act[:, i * filters : (i + 1) * filters].sum(0) for i in range(len(WIDTHS))]))
            step(self.out, squares.out, g_out)
            squares.base = np.float32(squares.base + g_base * g_base)
            self.base = np.float32(self.base - rate * g_base / (squares.base**0.5 + 1e-6))
            for kernel, square, g in zip(self.kernels, squares.kernels, kernel_grads, strict=True):
                step(kernel, square, g)
            at, where = np.unique(np.concatenate(table_rows), return_inverse=True)
            total = np.zeros((len(at), self.table.shape[1]), np.float32)
            np.add.at(total, where, np.concatenate(table_grads))
            live = at % (1 << self.bits) != 0
            step(self.table, squares.table, total[live], at[live])

    def set_languages(self, langs: list[str], counts: np.ndarray) -> None:
        """counts: words of each language by bucket; languages without a word are left out."""
        some = counts.any(axis=1) if len(langs) else np.zeros(0, bool)
        self.langs = [x for x, has in zip(langs, some.tolist(), strict=True) if has]
        counts = counts[some] + 0.5 if self.langs else np.ones((0, 1))
        counts[:, 0] = 1
        self.lang_table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.lang_table[:, 0] = 0

    def set_thresholds(self, counts: np.ndarray) -> None:
        """counts: documents by language, step of probability and label. Per language the threshold in the middle of the
        widest gap among those with the fewest errors; a language with few documents of either label uses the common one."""
        self.threshold = best_threshold(counts.sum(axis=0))
        self.thresholds = np.full(len(self.langs), self.threshold)
        for i in range(len(self.langs) if len(self.langs) > 1 else 0):
            if min(counts[i].sum(axis=0)) >= MIN_HELD_BACK:
                self.thresholds[i] = best_threshold(counts[i])


def take(rows: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows and offsets of some documents, with the empty words at the end."""
    lengths = np.diff(ends)[docs]
    local = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(ends[docs] - local[:-1], lengths) + np.arange(local[-1])
    return np.concatenate([rows[:, at].astype(np.int64), np.zeros((PARTS, PAD), np.int64)], axis=1), local


def best_threshold(counts: np.ndarray) -> float:
    """counts: documents of label 0 and 1 in each of equal steps of probability."""
    at = np.flatnonzero(counts.any(axis=1))
    s, (neg, pos) = (at + 0.5) / len(counts), counts[at].T
    share = max(pos.sum() / max(counts.sum(), 1), 1e-3)
    below, above = np.append(0, pos.cumsum()), neg.sum() - np.append(0, neg.cumsum())
    wrong = below * 0.5 / share + above * 0.5 / max(1 - share, 1e-3)
    edges = np.concatenate([[0], s, [1]])
    gap = edges[1:] - edges[:-1]
    k = np.lexsort((-gap, np.round(wrong, 6)))[0]
    return float(np.clip((edges[k] + edges[k + 1]) / 2, 0.02, 0.98))


def _part_of(table: pa.Table, bits: int) -> pa.Table:
    """The one row of a part: its documents' word rows, offsets, labels, languages, which of them are held back (every
    fifth in the order of labels and texts), and numbers of documents: by label, and by label of those held back."""
    kind = np.uint16 if PARTS << bits <= 1 << 16 else np.int32
    rows, ends, at = [np.zeros((PARTS, 0), kind)], [np.zeros(1, np.int64)], 0
    for batch in table.select(["text"]).to_batches():
        for _, buf, off in K.chunks(batch, "text"):
            r, e = word_rows(buf, off, bits)
            rows.append(r[:, : e[-1]].astype(kind))
            ends.append(e[1:] + at)
            at += e[-1]
    label = np.asarray(table.column("label").combine_chunks(), np.int64)
    texts = table.column("text").combine_chunks().fill_null("")
    order = np.asarray(pc.sort_indices(pa.table({"label": label, "text": texts}), [("label", "ascending"), ("text", "ascending")]))
    held = np.zeros(len(label), bool)
    held[order[::5]] = True
    some = slice(0, 1 if table.num_rows else 0)
    one = lambda x, kind: pa.array([x], kind)[some]
    return pa.table({
        "part": table.column("part").combine_chunks()[some], "rows": one(np.concatenate(rows, axis=1).tobytes(), pa.binary()),
        "ends": one(np.concatenate(ends).tobytes(), pa.binary()), "label": one(label.astype(np.int8).tobytes(), pa.binary()), "held": one(held.tobytes(), pa.binary()),
        "langs": one(table.column("lang").to_pylist(), pa.list_(pa.string())), "n": one(np.bincount(label, minlength=2).tolist(), pa.list_(pa.int64())),
        "n_held": one(np.bincount(label[held], minlength=2).tolist(), pa.list_(pa.int64())),
    })


PART = "part long, rows binary, ends binary, label binary, held binary, langs array<string>, n array<long>, n_held array<long>"


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", bits: int = 14, dims: int = 8, filters: int = 8, epochs: int = 6, rate: float = 0.1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part_bytes: int = PART_BYTES) -> TextCnn:
    spark = docs.sparkSession
    parts, n_parts = labelled_parts(docs, labels, label, allowed, lambda t: _part_of(t, bits), PART, part_bytes, seed, id_col, text_col, lang_col)
    n, held = ([int(x or 0) for x in r] for r in np.split(np.array(parts.agg(*[F.sum(F.col(c)[i]) for c in ("n", "n_held") for i in (0, 1)]).first(), object), 2))
    model = TextCnn(bits, dims, filters, seed)
    if not min(n):
        model.constant = float(n[1] > 0)
        discard(parts)
        return model
    split = min(held) >= MIN_HELD_BACK
    fitted = np.array(n) - np.array(held) if split else np.array(n)
    share = max(fitted[1] / fitted.sum(), 1e-3)
    kind = np.uint16 if PARTS << bits <= 1 << 16 else np.int32
    langs = [r["lang"] for r in parts.select(F.explode("langs").alias("lang")).where("lang is not null").distinct().limit(MAX_LANGS + 1).collect()]
    langs = sorted(langs) if len(langs) <= MAX_LANGS else []
    lang_bits = bits
    while len(langs) << lang_bits > LANG_CELLS:
        lang_bits -= 1

    def over(work, shape: tuple[int, int], shared=None) -> np.ndarray:
        """Adds the matrices that work(shared, part, rows, ends, label, documents to fit, others, langs) makes of the parts."""
        sent = spark.sparkContext.broadcast(shared)

        def run(batches):
            for batch in batches:
                for part, rows, ends, label, held, own, *_ in zip(*batch.columns, strict=True):
                    label, out = np.frombuffer(label.as_py(), np.int8).astype(np.int64), np.frombuffer(held.as_py(), bool)
                    rows, ends = np.frombuffer(rows.as_py(), kind).reshape(PARTS, -1), np.frombuffer(ends.as_py(), np.int64)
                    fit, rest = (np.flatnonzero(~out), np.flatnonzero(out)) if split else (np.arange(len(label)),) * 2
                    found = sparse(work(sent.value, part.as_py(), rows, ends, label, fit, rest, own))
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()]), *(pa.array([x], pa.binary()) for x in found.values())], ["part", *found])

        total = summed(parts.mapInArrow(run, "part long, at binary, v binary"), n_parts, shape)
        sent.unpersist()
        return total

    size, own_size = PARTS << bits, 1 << lang_bits

    def seen(_, part, rows, ends, label, fit, rest, own):
        """Documents of each label by row, then words of each language by bucket, one below the other."""
        number = {x: i for i, x in enumerate(langs)}
        lang = np.array([number.get(x, -1) for x in own.as_py()])
        out = np.zeros(2 * size + len(langs) * own_size)
        for a in range(0, len(fit), SLICE):
            some = fit[a : a + SLICE]
            r, local = take(rows, ends, some)
            doc = np.repeat(np.arange(len(some)), np.diff(local))
            for x in r[:, : local[-1]]:
                d, x = K.distinct_pairs(doc, x)
                out[: 2 * size] += np.bincount(label[some][d] * size + x, minlength=2 * size)
            has = lang[some][doc] >= 0
            np.add.at(out, 2 * size + lang[some][doc][has] * own_size + (r[0, : local[-1]][has] & (own_size - 1)), 1)
        return out[:, None]

    counts = over(seen, (2 * size + len(langs) * own_size, 1))[:, 0]
    model.start(counts[: 2 * size].reshape(2, size), fitted)
    model.set_languages(langs, counts[2 * size :].reshape(len(langs), own_size))
    squares = TextCnn(bits, dims, filters, seed)
    squares.set_flat(np.zeros_like(model.flat()))
    shape = (len(model.flat()), 2 * dims + 1)

    for k in range(epochs):

        def changes(shared, part, rows, ends, label, fit, rest, own, k=k):
            """The part's changes and their squares' by row, times its documents, and these where a row has changed."""
            model, squares = pickle.loads(shared)
            before = np.concatenate([model.flat(), squares.flat()], axis=1).astype(np.float64)
            model.epoch(squares, rows, ends, label, fit, share, rate, 64, np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, k, part]))))
            change = np.concatenate([model.flat(), squares.flat()], axis=1) - before
            return (np.concatenate([change, change.any(axis=1, keepdims=True)], axis=1) * len(fit)).astype(np.float32)

        total = over(changes, shape, pickle.dumps((model, squares)))
        change = total[:, :-1] / np.maximum(total[:, -1:], 1)
        model.set_flat(model.flat() + change[:, :dims])
        squares.set_flat(squares.flat() + change[:, dims:])

    steps = 1 << 16
    kinds = max(len(model.langs), 1)
    while kinds * steps * 2 > STEP_CELLS and steps > 1 << 8:
        steps //= 2

    def by_probability(model, part, rows, ends, label, fit, rest, own):
        out = np.zeros(kinds * steps * 2)
        for a in range(0, len(rest), SLICE):
            some = rest[a : a + SLICE]
            r, local = take(rows, ends, some)
            lang = model.language(r, local) if kinds > 1 else np.zeros(len(some), np.int64)
            step = np.minimum((model.probability(r, local) * steps).astype(np.int64), steps - 1)
            np.add.at(out, (lang * steps + step) * 2 + label[some], 1)
        return out[:, None]

    model.set_thresholds(over(by_probability, (kinds * steps * 2, 1), model)[:, 0].reshape(kinds, steps, 2))
    discard(parts)
    return model


def score(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """id, the columns of also, score and predicted, for every row of docs."""
    return score_texts(docs, model.score, id_col, text_col, also, threshold)


def score_texts(docs: DataFrame, scorer, id_col: str, text_col: str, also: dict[str, Column] | None, threshold: float) -> DataFrame:
    """Runs a scorer of (bytes, offsets) over all texts; the model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col), *[c.alias(n) for n, c in (also or {}).items()], F.col(text_col).alias("__text"))
    kept = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            for part, buf, off in K.chunks(batch, "__text"):
                s = shared.value(buf, off)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
