"""Words, their runs of two and three, and counts and sums over them, as arrays of 64-bit hashes in Arrow batches.

What is shuffled are byte strings of whole blocks of texts, dealt by hash, so a word
costs the shuffle no row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

from umbra.llm.batches import slices

BLOCK_BYTES, BLOCK_ROWS = 3 << 20, 1 << 13
OWN, AFTER, FIRST = np.uint16(1 << 13), np.uint16(1 << 14), np.uint16(1 << 15)


class WordHashes(dict):
    """64-bit hashes of words, kept as they come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of ``x`` before ``y``."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


#: The word before a text, and two of them.
EMPTY = np.array([xxhash.xxh64_intdigest(b"")], np.uint64)
START = mixed(EMPTY, EMPTY)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of bounded size, or a single row."""
    for batch in batches:
        for some in slices(batch, column, BLOCK_BYTES):
            for at in range(0, some.num_rows, BLOCK_ROWS):
                yield some.slice(at, BLOCK_ROWS)


def runs(texts: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of ``texts`` (binary) the word before the one before it, the one before it, itself, whether it is its text's last, and the texts' word counts."""
    rows = [(x or b"").split() for x in texts.to_pylist()]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    c = np.fromiter(map(hashes.__getitem__, chain.from_iterable(rows)), np.uint64, int(sizes.sum()))
    stops = np.cumsum(sizes)[sizes > 0]
    starts = stops - sizes[sizes > 0]
    a, b, last = np.empty_like(c), np.empty_like(c), np.zeros(len(c), np.uint8)
    for out, before in ((b, c), (a, b)):
        out[1:] = before[:-1]
        out[starts] = EMPTY
    last[stops - 1] = 1
    return a, b, c, last, sizes


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def dealt_runs(part: int, parts: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts (column 0) the runs of three whose last two words fall into ``part`` of ``parts``, dealt to 2 ** ``bits`` shards by these two words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches, 0):
            a, b, c, last, _ = runs(block.column(0), hashes)
            two = mixed(b, c)
            shard = (two >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
            own = np.flatnonzero(two % np.uint64(parts) == part)
            own = own[np.argsort(shard[own], kind="stable")]
            a, b, c, last, shard = (x[own] for x in (a, b, c, last, shard))
            first = heads(shard)
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True)) if len(first) else []
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (a, b, c, last))], names=["shard", "a", "b", "c", "last"])

    return deal


def counted_runs(least: int) -> Callable[[pa.Table], pa.Table]:
    """Rows (kind, x, y, z, n, w) of what a shard of :func:`dealt_runs` holds.

    kind 3: x the run of three, y its first two words, z its last two, n its count, if it is ``least`` or more;
    kind 2: x the run of two, y and z its words, n the number of words seen before it, w how often a word follows, if any count needs it;
    kind 1: x a word, n the runs of three that it is the middle of, w the runs of two that it ends;
    kind 0: n runs of x words with count y (1 to 4; for two the words before), and for x = 0 the texts.
    """

    def count(table: pa.Table) -> pa.Table:
        a, b, c = (joined(table.column(k), np.uint64) for k in "abc")
        last = joined(table.column("last"), np.uint8)
        texts = int((b == EMPTY).sum())
        two = mixed(b, c)
        three = mixed(a, two)
        order = np.argsort(three)
        first = heads(three[order])
        n = np.diff(np.append(first, len(order)))
        followed = np.add.reduceat((1 - last[order]).astype(np.int64), first)
        at = order[first]
        a, b, c, two, three = (x[at] for x in (a, b, c, two, three))
        order = np.argsort(two)
        first = heads(two[order])
        k = np.diff(np.append(first, len(order)))
        after = np.add.reduceat(followed[order], first)
        most = np.maximum.reduceat(n[order], first)
        at = order[first]
        out = []

        def put(kind: int, *columns: np.ndarray) -> None:
            size = len(columns[0])
            full = [np.zeros(size, np.int64) if x is None else np.asarray(x).view(np.int64) for x in columns]
            out.append(pa.table([pa.array(np.full(size, kind, np.int32)), *map(pa.array, full)], names=["kind", "x", "y", "z", "n", "w"]))

        t = n >= least
        put(3, three[t], mixed(a[t], b[t]), two[t], n[t], None)
        t = (k >= least) | (after >= least) | (most >= least)
        put(2, two[at][t], b[at][t], c[at][t], k[t], after[t])
        for words, sums in ((b[at], k), (c[at], None)):
            o = np.argsort(words)
            h = heads(words[o])
            put(1, words[o][h], None, None, *((np.add.reduceat(sums[o], h), None) if sums is not None else (None, np.diff(np.append(h, len(o))))))
        small = np.arange(1, 5)
        for x, counts in ((3, n), (2, k)):
            put(0, np.full(4, x), small, None, np.bincount(np.minimum(counts, 5), minlength=6)[1:5], None)
        put(0, np.zeros(1, np.int64), None, None, np.array([texts]), None)
        return pa.concat_tables(out)

    return count


def packed(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's values in the order of their grams, as byte strings."""
    gram = table.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    values = [table.column(k).to_numpy()[order].tobytes() for k in ("own", "after")]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (gram[order].tobytes(), *values))], names=["shard", "grams", "own", "after"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each gram of packed shards."""
    for batch in batches:
        for row in batch.select(["grams", "own", "after"]).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[k], kind)) for k, kind in (("grams", np.int64), ("own", np.float64), ("after", np.float64))], names=["gram", "own", "after"])


def dealt_blocks(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of texts (key, text) as rows (shard, block, grams, who): for each shard its different grams in order, and for each place the text, what is asked, and whether a gram begins.

    Asked is a gram's own value, that of what comes after it, or both. A row without
    ``who`` holds the block's keys, word counts and numbers of words equal to the one before.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        lowest = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for block in blocks(batches, 1):
            a, b, c, last, sizes = runs(block.column(1), hashes)
            text = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            again = np.bincount(text[b == c], minlength=len(sizes)).astype(np.int64)
            two = mixed(b, c)
            some = np.flatnonzero(sizes).astype(np.uint16)
            both = text | OWN | np.where(last, np.uint16(0), AFTER)
            gram = np.concatenate([c, two, mixed(a, two), np.repeat(EMPTY, len(some)), np.repeat(START, len(some))])
            who = np.concatenate([both, both, text | OWN, some | AFTER, some | AFTER])
            order = np.argsort(gram)
            gram, who = gram[order], who[order]
            first = heads(gram)
            who[first] |= FIRST
            gram = gram[first]
            i = np.append(np.searchsorted(gram, lowest), len(gram))
            j = np.append(first, len(who))[i]
            held = [s for s in range(1 << bits) if i[s] < i[s + 1]]
            keys = block.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [(s, gram[i[s] : i[s + 1]].tobytes(), who[j[s] : j[s + 1]].tobytes()) for s in held]
            rows.append((number % (1 << bits), np.concatenate([keys, sizes, again]).tobytes(), None))
            shard, grams, whose = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(grams, pa.binary()), pa.array(whose, pa.binary())], names=["shard", "block", "grams", "who"])
            number += 1

    return deal


def looked_up(blocks: pa.Table, model: pa.Table) -> pa.Table:
    """(block, shard, sums): for each block of a shard the sums of what its texts asked; keys and counts go through as shard -1."""
    gram = joined(model.column("grams"), np.uint64)
    values = np.zeros((2, len(gram) + 1))
    values[0, :-1], values[1, :-1] = (joined(model.column(k), np.float64) for k in ("own", "after"))
    out = []
    for shard, block, grams, who in zip(*(blocks.column(k).to_pylist() for k in ("shard", "block", "grams", "who")), strict=True):
        if who is None:
            out.append((block, -1, grams))
            continue
        asked, places = np.frombuffer(grams, np.uint64), np.frombuffer(who, np.uint16)
        at = np.searchsorted(gram, asked)
        at[np.append(gram, np.uint64(0))[at] != asked] = len(gram)
        own, after = values[:, at[np.cumsum(places >> 15) - 1]]
        sums = np.bincount(places & 8191, own * (places >> 13 & 1) + after * (places >> 14 & 1))
        out.append((block, shard, sums.tobytes()))
    block, shard, sums = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(sums, pa.binary())], names=["block", "shard", "sums"])


def added(table: pa.Table) -> pa.Table:
    """(body, n_words, value, n_again) of each text of a block: the sums of its shards, in their order."""
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("sums").to_pylist(), strict=True))
    keys, sizes, again = np.frombuffer(rows[0][1], np.int64).reshape(3, -1)
    total = np.zeros(len(keys))
    for _, sums in rows[1:]:
        x = np.frombuffer(sums, np.float64)
        total[: len(x)] += x
    return pa.table([pa.array(keys), pa.array(sizes), pa.array(total), pa.array(again)], names=["body", "n_words", "value", "n_again"])
