"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each text becomes its set of hashed word shingles; equal sets form a class, whose
   smallest doc_id stands for it from here on.
2. One permutation deals the set into bins; an empty bin borrows from a bin that a
   hash of its own picks (optimal densification). Bands of bins are bucket keys.
3. In each bucket every member is paired with one centre only (a star), so pairs grow
   with bucket sizes and not with their squares. The centre is the member that shares
   most over all its buckets: the original, where there are variants of one. Pairs are
   confirmed on the full sets.
4. Members of one bucket that these links leave in different components are compared
   with each other too, so that a link that no star held is found as well. Inside that
   join stand a one-bit sketch and an exact upper bound of what two members can share:
   inside the centre's set, what neither lacks (by counts, and a 64-part map of what
   each lacks); outside it, shingles that any other such member has as well. Variants
   of one original differ from each other more than from it, which the bound sees.
5. Components of the confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.batches import slices
from umbra.llm.common import small, stored
from umbra.llm.components import components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@dataclass(frozen=True)
class NearDedup:
    """Parameters: words in a shingle, the similarity as percent, bands and rows in a band."""

    words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    seed: int = 7
    broadcast_ids: int = 4_000_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_limit(self) -> int:
        """Differing sketch bits that a linked pair exceeds with a chance of about 1e-9."""
        p = (100 - self.percent) / 200
        return math.ceil(self.bins * p + 6 * math.sqrt(self.bins * p * (1 - p)))

    def shingles(self, data: bytes, hashes: WordHashes) -> np.ndarray:
        """The sorted distinct shingle hashes of a UTF-8 text; A-Z count as a-z."""
        words = data.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        total = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return np.unique(total)

    def _probes(self) -> np.ndarray:
        """For each attempt and bin, the bin to borrow from."""
        return np.random.default_rng(self.seed).integers(0, self.bins, (64, self.bins))

    def signature(self, found: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """The densified minima of all bins; ``found`` is sorted and not empty."""
        where = ((found >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        bins, first = np.unique(where, return_index=True)
        out = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        full[bins], out[bins] = True, found[first]
        empty = np.flatnonzero(~full)
        step = 0
        while len(empty):
            tried = (probes[:, empty] + step) % self.bins
            hit = full[tried]
            any_hit, at = hit.any(axis=0), hit.argmax(axis=0)
            got = empty[any_hit]
            out[got] = mixed(out[tried[at[any_hit], np.flatnonzero(any_hit)]])
            empty = empty[~any_hit]
            step += 1
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        total = np.arange(self.bands, dtype=np.uint64) + np.uint64(self.seed)
        for column in signature.reshape(self.bands, self.rows).T:
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
        return total

    def _signed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, probes, words = WordHashes(), self._probes(), -(-self.bins // 64)
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            counts, one, two, keys, bits = [], [], [], [], []
            for x in batch.column(1):
                found = self.shingles(x.as_py() or b"", hashes)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                a, b = np.frombuffer(digest, np.int64)
                counts.append(len(found))
                one.append(int(a))
                two.append(int(b))
                if len(found):
                    signature = self.signature(found, probes)
                    keys.append(self.band_keys(signature).view(np.int64))
                    parity = np.zeros(words * 64, np.uint8)
                    parity[: self.bins] = (mixed(signature) >> np.uint64(63)).astype(np.uint8)
                    bits.append(np.packbits(parity).view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
                    bits.append(np.zeros(words, np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, longs), pa.array(bits, longs)],
                names=["doc_id", "n_shingles", "h1", "h2", "keys", "bits"],
            )

    def _sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            rows = [self.shingles(x.as_py() or b"", hashes).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "found"])

    def sets_of(self, ids: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, found) of the texts with these doc_ids; the ids are broadcast up to ``broadcast_ids`` of them."""
        return texts.join(small(ids, self.broadcast_ids), "doc_id", "left_semi").mapInArrow(self._sets, "id bigint, found array<bigint>")

    def compared(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with common, na, nb: the sizes of the full sets and of what they share; and what b lacks of a.

        ``lacks`` has a bit for each of 64 parts of a in which b lacks something, ``over``
        the number of further shingles lacked.
        """
        sets = self.sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), texts)
        left = sets.select(F.col("id").alias("a"), F.col("found").alias("fa"))
        right = sets.select(F.col("id").alias("b"), F.col("found").alias("fb"))
        both = pairs.join(left, "a").join(right, "b")
        both = both.select("a", "b", F.size("fa").alias("na"), F.size("fb").alias("nb"), F.array_except("fa", "fb").alias("missing"))
        parts = F.array_distinct(F.transform("missing", lambda h: F.pmod(h, F.lit(64)).cast("int")))
        both = both.select("a", "b", "na", "nb", F.size("missing").alias("gone"), parts.alias("parts"))
        bits = F.aggregate("parts", F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
        return both.select("a", "b", (F.col("na") - F.col("gone")).alias("common"), "na", "nb", bits.alias("lacks"), (F.col("gone") - F.size("parts")).alias("over"))

    def alike(self, compared: DataFrame) -> DataFrame:
        """The compared pairs that are similar enough, as links (a, b)."""
        union = F.col("na") + F.col("nb") - F.col("common")
        return compared.where(100 * F.col("common").cast("long") >= self.percent * union.cast("long")).select("a", "b")

    def links(self, signed: DataFrame, texts: DataFrame) -> DataFrame:
        """Confirmed links (a, b) between the smallest doc_ids of different classes; enough for the components."""
        classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("doc_id", "keys", "bits")).alias("r"))
        nodes = stored(classes.select(F.col("r.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("r.keys").alias("keys"), F.col("r.bits").alias("bits")), "nodes")
        rows = nodes.select("id", F.explode("keys").alias("key"))
        full = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "n")
        shared = stored(rows.join(full, "key"), "buckets")
        weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
        heavy = shared.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("centre"))
        shared = stored(shared.join(heavy, "key").select("key", "id", "centre"), "stars")
        pairs = stored(shared.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "star-candidates")
        checked = stored(self.compared(pairs, texts), "star-pairs")
        first = stored(self.alike(checked), "star-links")

        of = components(first, "star-components").select("id", "component")
        member = shared.where("id != centre").join(of, "id", "left").select("key", "id", "centre", F.coalesce("component", "id").alias("c"))
        mixed_keys = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        rest = stored(member.join(mixed_keys, "key"), "rest")
        alone = rest.select(F.col("id").alias("doc_id")).union(rest.select("centre")).distinct()
        found = stored(self.sets_of(alone, texts).select("id", F.explode("found").alias("s")), "rest-shingles")
        met = found.groupBy("s").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("s")
        shares = found.join(met, "s").groupBy("id").agg(F.count("*").alias("s"))
        near_centre = checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), F.col("na").alias("nc"), "common", "lacks", "over")
        rest = rest.join(near_centre, ["centre", "id"]).join(nodes.select("id", "n", "bits").join(shares, "id"), "id")
        rest = stored(rest.drop("centre").withColumn("outside", F.col("s") - F.col("common")), "rest-nodes")
        x, y = rest.alias("x"), rest.alias("y")
        f = lambda n: (F.col(f"x.{n}"), F.col(f"y.{n}"))
        (xb, yb), (xn, yn), (xc, yc), (xo, yo) = f("bits"), f("n"), f("common"), f("outside")
        apart: Column = sum((F.bit_count(xb[i].bitwiseXOR(yb[i])) for i in range(-(-self.bins // 64))), F.lit(0))
        sketched = (F.least(xn, yn) < 64) | (apart <= self.sketch_limit)
        both_lack = F.bit_count(F.col("x.lacks").bitwiseAND(F.col("y.lacks"))) + F.least(*f("over"))
        inside = F.least(xc, yc, xc + yc - F.col("x.nc") + both_lack)
        most = inside + F.least(xo, yo)
        bound = 100 * most >= self.percent * (xn + yn - most)
        more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & sketched & bound)
        more = stored(more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "rest-pairs")
        return first.union(self.alike(self.compared(more, texts)))

    def dedup(self, documents: DataFrame) -> DataFrame:
        """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

        Input columns doc_id and text; others are ignored. A null, empty or blank text
        has no shingles and is linked with nothing. Rows with a null doc_id join the
        component of an equal text that has an id, else have a null component_id, and
        are never kept. Repeated rows stay and have equal results. Of rows with one doc_id and
        different texts each is a document of its own. An empty table gives no rows.
        """
        return self._components(documents).drop("h1", "h2")

    def _components(self, documents: DataFrame) -> DataFrame:
        """What :meth:`dedup` gives, with the hashes of the text's set of shingles."""
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        signed = stored(docs.mapInArrow(self._signed, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>, bits array<bigint>"), "signed")
        links = stored(self.links(signed, docs.where("doc_id IS NOT NULL")), "links")
        found = components(links, "components").withColumnRenamed("id", "rep")
        classes = signed.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
        named = classes.join(found, "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("class_component"))
        rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["n_shingles", "h1", "h2"], "left")
        component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", "n_shingles", "h1", "h2", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

    def _named(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch without its last column, a text, and with the hashes of its set of shingles in its place."""
        hashes = WordHashes()
        for batch in (piece for whole in batches for piece in slices(whole, 2)):
            digests = [np.frombuffer(xxhash.xxh3_128_digest(self.shingles(x.as_py() or b"", hashes).tobytes()), np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([int(d[k]) for d in digests], pa.int64()) for k in (0, 1))], names=["id", "body", "h1", "h2"])

    def keep_one(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` that are kept, with their columns as they are; of equal rows of one doc_id one stays.

        Rows go by doc_id and text. Of rows with a null doc_id and one set of shingles (one
        text, where it is blank) one stays if no row with an id has that set.
        """
        body = F.xxhash64(F.coalesce("text", F.lit("")))
        found = stored(self._components(documents), "kept")
        gone = found.where("doc_id IS NOT NULL AND NOT kept").select("doc_id", "h1", "h2").distinct()
        # few rows share an id with one that goes, or have none: only their texts are read again
        ids = small(stored(gone.select(F.col("doc_id").alias("__id")).distinct(), "gone-ids"))
        asked = documents.withColumn("__body", body)
        asked = asked.where("doc_id IS NULL").unionByName(asked.join(ids, F.col("doc_id") == F.col("__id"), "left_semi"))
        named = asked.select("doc_id", "__body", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(self._named, "id bigint, body bigint, h1 bigint, h2 bigint")
        named = stored(named.distinct(), "gone-texts")
        out = named.join(gone.withColumnRenamed("doc_id", "id"), ["id", "h1", "h2"]).select("id", "body")
        alone = named.where("id IS NULL").groupBy("h1", "h2").agg(F.min("body").alias("body"))
        alone = alone.join(found.where("doc_id IS NOT NULL AND n_shingles > 0").select("h1", "h2").distinct(), ["h1", "h2"], "left_anti").select("body").withColumn("stays", F.lit(True))
        others = named.where("id IS NULL").select("id", "body").join(alone, "body", "left").where("stays IS NULL").select("id", "body")
        out = small(stored(out.unionByName(others).select(F.col("id").alias("__id"), F.col("body").alias("__gone")), "gone"))
        rows = documents.withColumn("__body", body)
        rows = rows.join(out, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__gone")), "left_anti")
        twice = rows.groupBy("doc_id", "__body").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("__body").alias("__twice"))
        twice = small(stored(twice, "twice"))
        again = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__twice"))
        once = rows.join(twice, again, "left_anti")
        more = rows.join(twice, again, "left_semi").dropDuplicates(["doc_id", "__body"])
        return once.unionByName(more).drop("__body")
