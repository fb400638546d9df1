"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The most frequent words of the whole corpus have ids of their own; a rarer word is
predicted as a class, its first byte, and then spelled byte by byte with counts from all
rare words of the corpus, so every word has a probability of its own and all words
together have one. The network predicts each id from the words on both sides: embeddings
of the window, one for each distance, are summed, passed through tanh, and give a softmax
over groups of ids and one over the ids of a group. Texts are dealt to shards by a hash
of their content; each round trains a part of the corpus, every shard from the same
weights, which are then averaged, weighed by words and summed in parts by a shuffle. So
the weights do not depend on how the table is stored. A document's score is the sum of
the log-probabilities of all its words, each with the word itself masked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import stored


END = 256  # the symbol after a word's last byte


class WordIds(dict):
    """For each word its id as context and as target, in one number: ``context << 16 | target``.

    Rare words have a hashed id as context, and as target that of their first byte.
    """

    def __init__(self, vocabulary: dict[bytes, int], hashed: int):
        super().__init__((w, i << 16 | i) for w, i in vocabulary.items())
        self.vocabulary, self.hashed, self.known = vocabulary, hashed, len(vocabulary)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self.__init__(self.vocabulary, self.hashed)
        self[word] = i = (self.known + xxhash.xxh64_intdigest(word) % self.hashed) << 16 | (self.known + word[0])
        return i


class Spelling:
    """Probabilities of bytes after the two bytes before them, from counts of ``cells``, smoothed by those after one byte.

    A cell is (byte before last * 256 + last byte) * 257 + next byte or END; there are
    256 * 256 * 257 at most. The byte before a word is 0.
    """

    def __init__(self, cells: np.ndarray, counts: np.ndarray, steady: float = 5.0):
        order = np.argsort(cells)
        self.cells, n = cells[order], counts[order].astype(np.float64)
        two, one = self.cells // 257, self.cells % 65792
        after_one = np.bincount(one, n, 65792)
        base = ((after_one.reshape(256, 257) + steady / 257) / (after_one.reshape(256, 257).sum(axis=1, keepdims=True) + steady)).ravel()
        totals = np.bincount(two, n, 65536)
        self.own = np.log((n + steady * base[one]) / (totals[two] + steady)).astype(np.float32)
        self.base, self.least = np.log(base).astype(np.float32), np.log(steady / (totals + steady)).astype(np.float32)
        self.seen: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each two bytes, and in a row the values of all next symbols; row 0 is of two bytes never seen. Made where it is used, not sent."""
        if self.seen is None:
            pairs = np.unique(self.cells // 257)
            row = np.zeros(65536, np.int32)
            row[pairs] = np.arange(1, len(pairs) + 1)
            values = np.zeros((len(pairs) + 1, 257), np.float32)
            values[1:] = self.least[pairs, None] + self.base.reshape(256, 257)[pairs % 256]
            values[row[self.cells // 257], self.cells % 257] = self.own
            self.seen = row, values
        return self.seen

    @staticmethod
    def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The cells of all words' bytes after the first one, with END, and where each word's begin."""
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = stops - sizes
        last, nxt = data[:-1].copy(), data[1:].copy()
        before = np.concatenate([[0], data[:-2]]) if len(data) > 1 else np.zeros(0, np.int64)
        before[starts] = 0
        nxt[stops - 1] = END
        inside = np.ones(len(last), bool)
        inside[stops[:-1]] = False  # what follows a word's end is no part of a word
        first = starts - np.arange(len(words))
        return ((before * 256 + last) * 257 + nxt)[inside], first

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of each word (not empty) the log-probability of its bytes after the first one, and its end."""
        if not words:
            return np.zeros(0, np.float32)
        row, values = self.table()
        cells, first = self.cells_of(words)
        pairs = cells // 257
        rows = row[pairs]
        value = values[rows, cells - pairs * 257]
        unseen = rows == 0
        value[unseen] = self.base[cells[unseen] % 65792]
        return np.add.reduceat(value, first)


class SpelledWords(dict):
    """Log-probabilities of spelling, kept as they come; words with ids of their own are not asked for."""

    def __init__(self, spelling: Spelling):
        super().__init__()
        self.spelling = spelling

    def of(self, rows: list[list[bytes]], rare: np.ndarray) -> np.ndarray:
        """For each word of ``rows`` its value where ``rare`` says that it is spelled, else 0."""
        if len(self) > 300_000:
            self.clear()
        asked = list(compress(chain.from_iterable(rows), rare.tolist()))
        new = [w for w in set(asked) if w not in self]
        self.update(zip(new, self.spelling.log_probabilities(new).tolist(), strict=True))
        out = np.zeros(len(rare))
        out[rare] = np.fromiter(map(self.__getitem__, asked), np.float64, len(asked))
        return out


@dataclass(frozen=True)
class WindowModel:
    """``known`` most frequent words have ids of their own; others have one of ``hashed`` ids as
    context, and as target the id of their first byte, after which they are spelled.

    ``classes`` softmax groups of equally many ids, ``side`` words on either side,
    ``size`` numbers in an embedding, ``rounds`` equal parts of the corpus after each of
    which weights are averaged, ``rate`` the learning rate, ``batch`` words in a step,
    ``shard_words`` about as many words in a shard, ``parts`` pieces of the weights in
    the averaging shuffle.
    """

    known: int = 1792
    hashed: int = 256
    classes: int = 46
    side: int = 2
    size: int = 16
    rounds: int = 2
    rate: float = 0.15
    batch: int = 4096
    shard_words: int = 2_000_000
    parts: int = 64
    seed: int = 3

    def __post_init__(self) -> None:
        if self.known + max(self.hashed, 256) >= 1 << 15:
            raise ValueError("ids must fit 15 bits")

    @property
    def ids(self) -> int:
        """Ids as targets, and at least as many as contexts."""
        return self.known + max(self.hashed, 256)

    @property
    def each(self) -> int:
        return -(-self.ids // self.classes)

    def counted(self, documents: DataFrame) -> DataFrame:
        """(word, n) of every word of the whole corpus."""

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter[bytes] = Counter()

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
                return made

            for batch in batches:
                for x in batch.column(0):
                    counts.update((x.as_py() or b"").split())
                if len(counts) > 200_000:
                    yield out()
            if counts:
                yield out()

        found = documents.select(F.col("text").cast("binary")).mapInArrow(words, "word binary, n bigint")
        return stored(found.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")

    def vocabulary(self, counted: DataFrame) -> dict[bytes, int]:
        """The most frequent words (ties by the word), at most ``known`` of them."""
        top = counted.orderBy(F.desc("n"), "word").limit(self.known)
        return {bytes(r.word): i for i, r in enumerate(top.collect())}

    def spelling(self, counted: DataFrame, vocabulary: dict[bytes, int]) -> Spelling:
        """Counts of byte cells over all words of the corpus without an id of their own; what is collected is bounded by the number of cells."""

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w and w not in vocabulary]
                if rows:
                    words, counts = zip(*rows, strict=True)
                    found, first = Spelling.cells_of(list(words))
                    sizes = np.diff(np.append(first, len(found)))
                    keys, at = np.unique(found, return_inverse=True)
                    sums = np.bincount(at, np.repeat(np.array(counts, np.float64), sizes))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums.astype(np.int64))], names=["cell", "n"])

        found = counted.select("word", "n").mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return Spelling(found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.int64))

    def start(self) -> list[np.ndarray]:
        """Fresh weights: embeddings by distance, class and word outputs."""
        r = np.random.default_rng(self.seed)
        small = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        return [small(2 * self.side, self.ids + 1, self.size), small(self.size + 1, self.classes), small(self.classes, self.size + 1, self.each)]

    def windows(self, rows: list[list[bytes]], ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as lists of words: all words as targets, the contexts around each (``self.ids`` beyond a text's ends), and the texts' word counts."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        both = np.fromiter(map(ids.__getitem__, chain.from_iterable(rows)), np.int32)
        gaps = np.repeat(np.arange(1, len(rows) + 1) * self.side, sizes)
        at = np.arange(len(both)) + gaps
        flat = np.full(len(both) + (len(rows) + 1) * self.side, self.ids, np.int16)
        flat[at] = both >> 16
        around = [flat[at + d] for d in range(-self.side, self.side + 1) if d]
        return (both & 0xFFFF).astype(np.int16), np.stack(around), sizes

    def hidden(self, weights: list[np.ndarray], around: np.ndarray) -> np.ndarray:
        """Hidden values of each window, and a constant 1."""
        out = np.ones((around.shape[1], self.size + 1), np.float32)
        total = weights[0][0].take(around[0], axis=0)
        for k in range(1, 2 * self.side):
            total += weights[0][k].take(around[k], axis=0)
        np.tanh(total, out=out[:, :-1])
        return out

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The order of targets by class, and each class with its places in that order."""
        group = targets // self.each
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, slice(ends[c], ends[c + 1])) for c in range(self.classes) if ends[c] < ends[c + 1]]

    def word_values(self, to_word: np.ndarray, own: np.ndarray, places: list[tuple[int, slice]]) -> np.ndarray:
        """A row of a class's outputs for each row of ``own``, hidden values by class."""
        out = np.empty((len(own), self.each), np.float32)
        for c, at in places:
            np.matmul(own[at], to_word[c], out=out[at])
        return out

    def log_probabilities(self, weights: list[np.ndarray], targets: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target given what is around it."""
        hidden = self.hidden(weights, around)
        out = chosen(weights[1].T @ hidden.T, targets // self.each, bounded(weights[1]))
        order, places = self.by_class(targets)
        x = self.word_values(weights[2], hidden.take(order, axis=0), places)
        if not bounded(weights[2]):
            x -= x.max(axis=1, keepdims=True)
        value = x[np.arange(len(x)), (targets % self.each)[order]]
        out[order] += value - np.log(row_sums(np.exp(x, out=x)))
        return out

    def step(self, weights: list[np.ndarray], targets: np.ndarray, around: np.ndarray) -> None:
        """One step of gradient descent, in place."""
        embed, to_class, to_word = weights
        hidden = self.hidden(weights, around)
        n = len(targets)
        rate = np.float32(self.rate)
        error = to_class.T @ hidden.T
        if not bounded(to_class):
            error -= error.max(axis=0)
        np.exp(error, out=error)
        error /= error.sum(axis=0)
        error[targets // self.each, np.arange(n)] -= 1
        back = error.T @ to_class[:-1].T
        order, places = self.by_class(targets)
        own = hidden.take(order, axis=0)
        e = self.word_values(to_word, own, places)
        if not bounded(to_word):
            e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= row_sums(e)[:, None]
        e[np.arange(n), (targets % self.each)[order]] -= 1
        more = np.empty((n, self.size), np.float32)
        to_class -= rate * (error @ hidden).T / n * 4
        for c, at in places:
            np.matmul(e[at], to_word[c][:-1].T, out=more[at])
            to_word[c] -= own[at].T @ e[at] * (rate * 4 / np.float32(max(at.stop - at.start, 32)))
        place = np.empty_like(order)
        place[order] = np.arange(n)
        back += more.take(place, axis=0)
        back *= 1 - hidden[:, :-1] ** 2
        for k in range(2 * self.side):
            order = np.argsort(around[k], kind="stable")
            key = around[k][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[first, n])
            embed[k][key[first]] -= np.add.reduceat(back.take(order, axis=0), first, axis=0) * (rate * 4 / np.sqrt(counts * 32 + 1)).astype(np.float32)[:, None]

    def train(self, documents: DataFrame, vocabulary: dict[bytes, int], total_words: int) -> list[np.ndarray]:
        """Weights after all texts, averaged over the shards after each round's part of them."""
        spark = documents.sparkSession
        weights = self.start()
        shapes = [w.shape for w in weights]
        total = sum(w.size for w in weights)
        width = -(-total // self.parts)
        shards = 1 << max(0, math.ceil(math.log2(max(1, total_words / self.rounds / self.shard_words))))
        texts = documents.select(F.xxhash64("text", "doc_id").alias("h"), F.col("text").cast("binary"))
        for turn in range(self.rounds):
            shared = spark.sparkContext.broadcast((vocabulary, weights))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                known, sent = shared.value
                own, ids, seen = [w.copy() for w in sent], WordIds(known, self.hashed), 0
                for batch in batches:
                    for some in chunks([x.as_py() or b"" for x in batch.column(1)]):
                        targets, around, _ = self.windows([t.split() for t in some], ids)
                        for at in range(0, len(targets), self.batch):
                            self.step(own, targets[at : at + self.batch], around[:, at : at + self.batch])
                        seen += len(targets)
                if seen:
                    flat = np.concatenate([w.ravel() for w in own])
                    flat = np.pad(flat, (0, width * self.parts - total)).reshape(self.parts, width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(self.parts, dtype=np.int32)), pa.array(np.full(self.parts, seen, np.int64)), pa.array(list(flat), pa.list_(pa.float32()))], names=["part", "words", "sums"])

            def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                words, sums = 0, np.zeros(width)
                for batch in batches:
                    for n, s in zip(batch.column("words"), batch.column("sums"), strict=True):
                        words += n.as_py()
                        sums += s.values.to_numpy().astype(np.float64) * n.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([words], pa.int64()), pa.array([(sums / words).astype(np.float32)], pa.list_(pa.float32()))], names=["part", "words", "sums"])

            kinds = "part int, words bigint, sums array<float>"
            dealt = texts.where(F.pmod("h", F.lit(self.rounds)) == turn).repartition(shards, "h").sortWithinPartitions("h")
            rows = dealt.mapInArrow(run, kinds).groupBy("part").applyInArrow(lambda key, t: pa.Table.from_batches(summed(key, t.to_batches())), kinds).collect()
            if not rows:
                continue
            flat = np.concatenate([np.array(r.sums, np.float32) for r in sorted(rows, key=lambda r: r.part)])[:total]
            weights, at = [], 0
            for shape in shapes:
                n = int(np.prod(shape))
                weights.append(flat[at : at + n].reshape(shape))
                at += n
        return weights

    def score(self, documents: DataFrame) -> DataFrame:
        """One row per row of ``documents``: doc_id, n_words, log_p (sum), mean_log_p.

        Input columns doc_id and text; others are ignored. A null or blank text has no
        words, log_p 0 and a null mean; repeated rows have equal scores; a text of any
        length is scored whole; an empty table gives no rows. The words with ids of their
        own, the weights and the counts of spelling are the only things that reach the
        driver; their size is bounded by the parameters.
        """
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        counted = self.counted(docs)
        vocabulary = self.vocabulary(counted)
        total = counted.agg(F.sum("n")).first()[0] or 0
        return self.scored(docs, vocabulary, self.spelling(counted, vocabulary), self.train(docs, vocabulary, total))

    def scored(self, documents: DataFrame, vocabulary: dict[bytes, int], spelling: Spelling, weights: list[np.ndarray]) -> DataFrame:
        """Scores (see :meth:`score`) under a given vocabulary, spelling and weights."""
        shared = documents.sparkSession.sparkContext.broadcast((vocabulary, spelling, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, spelled, sent = shared.value
            ids, words = WordIds(known, self.hashed), SpelledWords(spelled)
            for batch in batches:
                counts, sums = [], []
                for some in chunks([x.as_py() or b"" for x in batch.column(1)]):
                    rows = [t.split() for t in some]
                    targets, around, sizes = self.windows(rows, ids)
                    logs = words.of(rows, targets >= len(known))
                    for at in range(0, len(targets), 8 * self.batch):
                        part = slice(at, at + 8 * self.batch)
                        logs[part] += self.log_probabilities(sent, targets[part], around[:, part])
                    run_sums = np.concatenate([[0.0], np.cumsum(logs)])
                    ends = np.cumsum(sizes)
                    counts += sizes.tolist()
                    sums += (run_sums[ends] - run_sums[ends - sizes]).tolist()
                means = [s / n if n else None for s, n in zip(sums, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_words", "log_p", "mean_log_p"])

        kind = documents.schema["doc_id"].dataType.simpleString()
        return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_words bigint, log_p double, mean_log_p double")


def bounded(weights: np.ndarray) -> bool:
    """Whether outputs are so small that their exponentials need no largest one taken off first: hidden values are 1 at most."""
    return float(np.abs(weights).sum(axis=-2).max()) < 60


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums along short rows, as a product, which is faster."""
    return x @ np.ones(x.shape[1], np.float32)


def chosen(x: np.ndarray, at: np.ndarray, bounded: bool = False) -> np.ndarray:
    """Logarithm of the softmax of each column at one place; sums down long columns side by side are faster than along short rows."""
    if not bounded:
        x -= x.max(axis=0)
    value = x[at, np.arange(x.shape[1])]
    return value - np.log(np.exp(x, out=x).sum(axis=0))


def chunks(texts: list[bytes], least: int = 300_000) -> Iterator[list[bytes]]:
    """Texts in lists of about ``least`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held
