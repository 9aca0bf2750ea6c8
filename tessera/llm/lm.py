"""Language-model scoring with a hidden Markov model.

Words are told apart by a 64-bit hash of their bytes (A-Z in lower case) and fall into `symbols` classes by its low
bits; the end of a text is a class of its own. The hidden Markov model runs over the classes, and a word's share of its
class comes from the counts of all training texts, add-half smoothed with one unknown word a class:

    P(text) = P(classes under the model) * product of (c(w) + 1/2) / (sum over the class's known words of (c + 1/2) + 1/2)

Baum-Welch: each partition runs scaled forward and backward recursions over its training texts, in stretches of
`stretch` tokens, and adds up expected transitions and emissions; the partitions' sums are added as a tree, and the
model (states x symbols numbers, fixed in size) goes back out. All tokens of all training texts count, but a transition
over the border of two stretches doesn't: a stretch inside a text starts from the average state. Scoring runs the scaled
forward recursion over each whole text: the exact likelihood under the model, in one step a token of the longest text of
a chunk.

Word counts are as large as the vocabulary, so they are never broadcast: texts are dealt into buckets of bounded size,
each bucket asks for the counts of its own distinct words by a join, and meets its texts in a cogroup.

Defined results: null text counts as empty and has the end token alone; repeated rows are scored each, and each counts
in training; with no training text, N = V = 0 and every token is unknown. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import materialise, partitions, text_bytes

BUCKET_BYTES = 12 << 20
#: Tokens that a step of training takes at once, with about 200 bytes each, and that a scoring recursion takes at once.
PIECE_TOKENS, SCORED_TOKENS = 1 << 18, 1 << 18
#: New words after which a task sums up its counts, and distinct words that it holds before it passes them on.
FRESH_WORDS, HELD_WORDS = 1 << 19, 1 << 20


def hashed_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and the documents' offsets in them."""
    buf = K.LOWER[buf]
    start, end, doc = K.words(buf, off)
    return K.span_hash(K.prefix_hash(buf), start, end), K.per_doc(doc, len(off) - 1)


class Hmm:
    """start, rest (state shares where a stretch begins mid-text), move (states x states), emit (symbols + 1 x states)."""

    def __init__(self, emit: np.ndarray, stay: float):
        states = emit.shape[1]
        self.emit = emit
        self.start = self.rest = np.full(states, 1 / states)
        self.move = np.full((states, states), (1 - stay) / max(states - 1, 1))
        np.fill_diagonal(self.move, stay if states > 1 else 1)

    @classmethod
    def seeded(cls, seeds: list[np.ndarray], mass: np.ndarray, states: int) -> Hmm:
        """Each state begins near one of the seed texts, picked to be unlike those picked before."""
        share = mass / mass.sum()
        texts = [np.bincount(s, minlength=len(mass)) / len(s) for s in seeds if len(s)] or [share]
        root = np.sqrt(np.array(texts))
        picked, near = [0], root @ root[0]
        while len(picked) < states:
            picked.append(int(near.argmin()))
            near = np.maximum(near, root @ root[picked[-1]])
        emit = np.stack([0.5 * texts[i] + 0.5 * share for i in picked], axis=1)
        # states that share a seed must differ a little, or they stay the same
        emit *= 1 + 0.05 * np.random.Generator(np.random.Philox(3)).random(emit.shape)
        return cls(emit / emit.sum(axis=0), 0.98)

    def expect(self, symbols: np.ndarray, off: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected first states, states, transitions and emissions over texts given as symbols[off[i]:off[i+1]]."""
        states, n_symbols = self.emit.shape[1], self.emit.shape[0]
        lengths = np.diff(off)
        per = -(-lengths // stretch)
        doc = np.repeat(np.arange(len(lengths)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = off[:-1][doc] + k * stretch
        size = np.minimum(off[1:][doc] - begin, stretch)
        order = np.argsort(-size, kind="stable")
        begin, size, head = begin[order], size[order], (k == 0)[order]
        steps = int(size[0]) if len(size) else 0
        live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]
        alpha, scale, seen = [], [], []
        for t in range(steps):
            e = self.emit[symbols[begin[: live[t]] + t]]
            a = np.where(head[:, None], self.start, self.rest) * e if t == 0 else (alpha[-1][: live[t]] @ self.move) * e
            s = a.sum(axis=1, keepdims=True)
            alpha.append(a / s)
            scale.append(s)
            seen.append(e)
        first, rest, moves = np.zeros(states), np.zeros(states), np.zeros((states, states))
        emits = np.zeros((states, n_symbols))
        beta = np.zeros((0, states))
        gammas, symbols_seen = [], []
        for t in range(steps - 1, -1, -1):
            full = np.ones((live[t], states))
            if len(beta):
                weighted = seen[t + 1] * beta / scale[t + 1]
                moves += alpha[t][: len(beta)].T @ weighted
                full[: len(beta)] = weighted @ self.move.T
            beta = full
            gamma = alpha[t] * beta
            if t == 0:
                first += gamma[head].sum(axis=0)
            gammas.append(gamma)
            symbols_seen.append(symbols[begin[: live[t]] + t])
        if gammas:
            g, s = np.concatenate(gammas), np.concatenate(symbols_seen)
            rest = g.sum(axis=0)
            for j in range(states):
                emits[j] = np.bincount(s, g[:, j], n_symbols)
        return first, rest, moves * self.move, emits

    def update(self, first, rest, moves, emits, mass: np.ndarray, prior: float) -> Hmm:
        out = Hmm(self.emit, 0.5)
        share = mass / mass.sum()
        out.start = (first + 1) / (first + 1).sum()
        out.rest = (rest + 1) / (rest + 1).sum()
        out.move = (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True)
        emits = emits.T + prior * share[:, None]
        out.emit = emits / emits.sum(axis=0)
        return out

    def log10_likelihood(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text exactly: scaled forward recursion over all texts at once, longest first."""
        lengths = np.diff(off)
        order = np.argsort(-lengths, kind="stable")
        begin, size = off[:-1][order], lengths[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), "left")
        total, a = np.zeros(len(size)), None
        for t in range(steps):
            n = live[t]
            e = self.emit[symbols[begin[:n] + t]]
            a = self.start * e if t == 0 else (a[:n] @ self.move) * e
            s = a.sum(axis=1)
            a = a / s[:, None]
            total[:n] += np.log10(s)
        out = np.empty(len(size))
        out[order] = total
        return out


def _with_ends(symbols: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols with the end symbol after each."""
    return np.insert(symbols.astype(np.int64), at[1:], end), at + np.arange(len(at))


def encode(docs: DataFrame, train: Column, symbols: int, text_col: str) -> DataFrame:
    """One pass over the texts. Rows of kind 0: a chunk's training texts as symbols (two bytes each) with their lengths.
    Rows of kind 1: distinct training words with their counts, which a task passes on at the end or when they are many."""

    def run(batches):
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merge() -> None:
            w, n = np.concatenate(held), np.concatenate(counts)
            w, where = np.unique(w, return_inverse=True)
            held[:], counts[:] = [w], [np.bincount(where, n, len(w)).astype(np.int64)]

        def counted():
            for i in range(0, len(held[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([held[0][i : i + (1 << 17)].tobytes()], pa.binary()), pa.array([counts[0][i : i + (1 << 17)].tobytes()], pa.binary())], ["kind", "a", "b"])
            held.clear(), counts.clear()

        fresh = 0
        for batch in batches:
            for part, buf, off in K.chunks(batch, "text"):
                word, at = hashed_words(buf, off)
                use = np.asarray(part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False), bool)
                word = word[np.repeat(use, np.diff(at))]
                held.append(word)
                counts.append(np.ones(len(word), np.int64))
                fresh += len(word)
                if fresh > FRESH_WORDS:
                    fresh = 0
                    merge()
                    if len(held[0]) > HELD_WORDS:
                        yield from counted()
                lengths = np.diff(at)[use].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([(word & np.uint64(symbols - 1)).astype(np.uint16).tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())], ["kind", "a", "b"])
        if held:
            merge()
            yield from counted()

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, "kind long, a binary, b binary")


def word_counts(encoded: DataFrame) -> DataFrame:
    """word, n over all training texts."""

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a.as_py(), np.int64)), pa.array(np.frombuffer(b.as_py(), np.int64))], ["word", "n"])

    return encoded.where("kind = 1").select("a", "b").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(batches, symbols: int):
    """The training texts of a partition with their ends, some PIECE_TOKENS tokens at a time."""
    held, sizes = [], []

    def out():
        s, lengths = np.concatenate(held), np.concatenate(sizes)
        at = np.concatenate([[0], np.cumsum(lengths)])
        held.clear(), sizes.clear()
        return _with_ends(s, at, symbols)

    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            held.append(np.frombuffer(a.as_py(), np.uint16))
            sizes.append(np.frombuffer(b.as_py(), np.int32).astype(np.int64))
            if sum(map(len, held)) > PIECE_TOKENS:
                yield out()
    if sum(map(len, sizes)):
        yield out()


def _summed(parts: DataFrame, fan_in: int = 32) -> np.ndarray | None:
    """Adds the vectors of all tasks (task int, v binary) as a tree."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("v"))
        return pa.table({"task": table.column("task")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    levels = max(1, int(np.ceil(np.log(max(parts.rdd.getNumPartitions(), 2)) / np.log(fan_in))))
    for _ in range(levels):
        parts = parts.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy("task").applyInArrow(add, "task int, v binary")
    rows = parts.collect()  # fan_in vectors at most
    return sum(np.frombuffer(r["v"], np.float64) for r in rows) if rows else None


def baum_welch(encoded: DataFrame, model: Hmm, mass: np.ndarray, symbols: int, rounds: int, stretch: int, prior: float) -> Hmm:
    texts = encoded.where("kind = 0").select("a", "b")
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)  # a fixed number of states x symbols

        def run(batches, shared=shared):
            from pyspark import TaskContext

            total = None
            for s, off in _pieces(batches, symbols):
                got = np.concatenate([x.ravel() for x in shared.value.expect(s, off, stretch)])
                total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "v"])

        total = _summed(texts.mapInArrow(run, "task int, v binary"))
        if total is None:
            break
        k = len(model.start)
        first, rest, moves, emits = np.split(total, [k, 2 * k, 2 * k + k * k])
        model = model.update(first, rest, moves.reshape(k, k), emits.reshape(k, -1), mass, prior)
        shared.unpersist()
    return model


@dataclass
class Trained:
    """The model, the mass of each class (add-half smoothed counts), the counts of all words as a table, and the numbers of
    training tokens, their types, and training texts."""

    model: Hmm
    mass: np.ndarray
    counts: DataFrame
    tokens: int
    types: int
    texts: int


def fit(docs: DataFrame, train: Column, states: int = 8, symbols: int = 1 << 14, rounds: int = 3, stretch: int = 128, prior: float = 50.0, text_col: str = "text") -> Trained:
    encoded = materialise(encode(docs, train, symbols, text_col), "encoded")
    counts = materialise(word_counts(encoded), "counts")
    symbol = F.col("word").bitwiseAND(symbols - 1)
    by_symbol = counts.groupBy(symbol.alias("symbol")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()  # `symbols` rows at most
    mass, types = np.full(symbols + 1, 0.5), 0
    texts = docs.where(F.coalesce(train, F.lit(False))).count()
    for r in by_symbol:
        mass[r["symbol"]] += r["n"] + 0.5 * r["types"]
        types += r["types"]
    mass[symbols] += texts
    tokens, types = int(sum(r["n"] for r in by_symbol)) + texts, types + (texts > 0)

    seeds = []
    order = F.xxhash64("b", F.length("a"))
    first = encoded.where("kind = 0").select(order.alias("h")).distinct().orderBy("h").limit(4).collect()
    chosen = encoded.where("kind = 0").where(order.isin([x["h"] for x in first])).select("a", "b").distinct().collect() if first else []
    for r in sorted(chosen, key=lambda x: bytes(x["a"])):
        ends = np.cumsum(np.frombuffer(r["b"], np.int32))
        part = np.frombuffer(r["a"], np.uint16)
        seeds += [x for x in np.split(part, ends[:-1])[:64] if len(x) >= 20] if len(ends) else []
    model = baum_welch(encoded, Hmm.seeded(seeds, mass, states), mass, symbols, rounds, stretch, prior)
    return Trained(model, mass, counts, tokens, types, texts)


def score(docs: DataFrame, train: Column, states: int = 8, symbols: int = 1 << 14, rounds: int = 3, stretch: int = 128, prior: float = 50.0, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of also, n_tokens, n_known, train_tokens, base_score and score, for every row of docs."""
    spark = docs.sparkSession
    found = fit(docs, train, states, symbols, rounds, stretch, prior, text_col)
    model, mass, counts, tokens, types, texts = found.model, found.mass, found.counts, found.tokens, found.types, found.texts
    buckets = max(partitions(spark), -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(buckets)).cast("int")
    extra = list(also or {})
    texts_by = docs.select(bucket.alias("bucket"), F.col(id_col), *[c.alias(n) for n, c in (also or {}).items()], F.col(text_col).alias("text"))

    def ask(table: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.uint64)]
        for batch in table.to_batches():
            held += [np.unique(hashed_words(buf, off)[0]) for _, buf, off in K.chunks(batch, "text")]
        found = np.unique(np.concatenate(held))
        return pa.table({"bucket": pa.array(np.full(len(found), table.column("bucket")[0].as_py(), np.int32)), "word": pa.array(found.view(np.int64))})

    asked = texts_by.groupBy("bucket").applyInArrow(ask, "bucket int, word long")
    answers = asked.join(counts, "word").select("bucket", "word", "n")
    shared = spark.sparkContext.broadcast((model, mass))
    level = np.log10(tokens + 0.5 * (types + 1))
    kept = [id_col, *extra]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hmm, masses = shared.value
        known, n = np.asarray(right.column("word").combine_chunks(), np.int64).view(np.uint64), np.asarray(right.column("n").combine_chunks(), np.int64)
        order = np.argsort(known)
        known, n = np.append(known[order], np.uint64(0)), np.append(n[order], 0)
        out: list[list] = [[] for _ in range(5)]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def recursion() -> None:
            ends = np.cumsum([0, *(at[-1] for _, at in waiting)])
            at = np.concatenate([[0], *(at[1:] + e for (_, at), e in zip(waiting, ends, strict=False))])
            out[4].append(hmm.log10_likelihood(*_with_ends(np.concatenate([s for s, _ in waiting]), at, symbols)))
            waiting.clear()

        for batch in left.to_batches():
            for _, buf, off in K.chunks(batch, "text"):
                word, at = hashed_words(buf, off)
                i = np.searchsorted(known[:-1], word)
                c = np.where(known[i] == word, n[i], 0) if len(known) > 1 else np.zeros(len(word), np.int64)
                part = (word & np.uint64(symbols - 1)).astype(np.int64)
                has = (texts > 0) * 1
                top = np.log10(c + 0.5)
                base = K.segment_sum(top, at) - np.diff(at) * level + np.log10(texts + 0.5) - level
                own = K.segment_sum(top - np.log10(masses[part]), at)
                out[0].append(np.diff(at) + 1)
                out[1].append(K.segment_sum((c > 0).astype(np.int64), at) + has)
                out[2].append(base)
                out[3].append(own)
                waiting.append((part.astype(np.uint16), at))
                if sum(len(s) for s, _ in waiting) > SCORED_TOKENS:
                    recursion()
        if waiting:
            recursion()
        cols = [np.concatenate(x) for x in out]
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
        values = [cols[0], cols[1], np.full(len(cols[0]), tokens), cols[2], cols[3] + cols[4]]
        return pa.table([*[left.column(c) for c in kept], *map(pa.array, values)], names=[*kept, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts_by.schema.fields[1:-1])
    pairs = texts_by.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    return pairs.applyInArrow(run, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
