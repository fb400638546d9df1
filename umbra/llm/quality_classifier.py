"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams of the trusted texts are counted by hash; the counts of each order are joined
with those of the order below it (continuation counts, discounts, weights of the lower
order), which gives a table of values whose sum is a word's log-probability. The n-grams
of every document are joined with that table, shard by shard, and summed to a perplexity.
Documents above the quantiles of trusted texts in their language, which are scored by
a model of the other half of them, are rejected. Counts and lookups are made in Python
in shards of bounded size, the rest by joins; no whole model reaches the driver or a process.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from umbra.llm.common import discard, small, stored
from umbra.llm.ngrams import START, WordHashes, added, blocks, counted_runs, dealt_blocks, dealt_runs, looked_up, mixed, packed, signed, unpacked
from umbra.llm.ngrams import runs as word_runs


def characters(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


@dataclass(frozen=True)
class KneserNey:
    """Trigrams. Parameters:

    All trusted text is fitted, and all trusted texts give the limits (see
    :meth:`cross_scores`). Only a caller that sets ``sample_chars`` bounds the trusted text
    that the model is fitted on: so many characters for all languages together, in equal
    parts, from texts that a hash picks; then limits are those of the other trusted texts.
    N-grams of two or three words that count less than ``least`` are cut off: their whole
    count goes to the lower order. ``quantile`` is that of the figures of trusted texts
    under a model that did not see them; ``slack`` is added to that of the perplexity's logarithm and
    ``repeat_slack`` to that of the share of words that repeat the word before them,
    which an n-gram model cannot tell from common words. ``prior_words`` words of the
    language's mean steady the figures of short texts. ``open_words`` is the number of
    words an unseen word may be one of. A model of more than ``broadcast_rows`` n-grams
    is joined word by word by shuffle. N-grams are counted in ``slices`` and texts scored in
    ``rounds``, fewer where one would have less than ``part_chars`` characters: all are
    taken, one part after the other, so that less is on disk at once.
    """

    sample_chars: int | None = None
    least: int = 2
    quantile: float = 0.995
    slack: float = 0.15
    repeat_slack: float = 0.05
    prior_words: int = 20
    open_words: int = 1 << 20
    broadcast_rows: int = 1_500_000
    slices: int = 3
    rounds: int = 8
    part_chars: int = 8_000_000

    def runs(self, chars: int, most: int) -> int:
        """Number of parts to take texts of so many characters in: ``most``, or fewer where they would be short."""
        return max(1, min(most, -(-chars // self.part_chars)))

    def counted(self, texts: DataFrame, slices: int, chars: int) -> tuple[list[DataFrame], DataFrame, Counter]:
        """Stored (kind, x, y, z, n, w) of runs of two and three words, (x, n, w) of words, and numbers (see :func:`counted_runs`) of ``texts`` (text).

        Runs are counted in ``slices`` by a hash, each of which reads all texts; so the
        shuffle of one slice at a time is on disk.
        """
        slices = self.runs(chars, slices)
        bits = max(4, math.ceil(math.log2(max(1, chars / slices / 4e6))))
        kept, words, tallies = [], None, Counter()
        for part in range(slices):
            dealt = texts.select(F.col("text").cast("binary")).mapInArrow(dealt_runs(part, slices, bits), "shard int, a binary, b binary, c binary, last binary")
            found = stored(dealt.groupBy("shard").applyInArrow(counted_runs(self.least), "kind int, x bigint, y bigint, z bigint, n bigint, w bigint"), "kn-slice")
            grams = stored(found.where("kind > 1"), "kn-grams")
            own = found.where("kind = 1").select("x", "n", "w")
            sums = stored((own.union(words) if words is not None else own).groupBy("x").agg(F.sum("n").alias("n"), F.sum("w").alias("w")), "kn-words")
            for r in found.where("kind = 0").groupBy("x", "y").agg(F.sum("n").alias("n")).collect():
                tallies[r.x, r.y] += r.n
            discard(found, *([] if words is None else [words]))
            kept.append(grams)
            words = sums
        return kept, words, tallies

    def fit(self, texts: DataFrame, slices: int | None = None, chars: int | None = None) -> DataFrame:
        """The stored model of ``texts`` (text) in shards by hash: (shard, bits, base, grams, own, after), by sharded count joins.

        The logarithm of a word's probability is a sum over ``base``, the values ``own`` of
        the word, of the two and the three words that end with it, and the values ``after``
        of the one and the two words before it; values that are not there are 0. ``own`` of
        a word is what it has beyond ``base``, a new word's; of a run what it has beyond
        the shorter run and the weight of that; ``after`` is the logarithm of the lower
        order's weight.
        """
        spark = texts.sparkSession
        parts, words, tallies = self.counted(texts, slices or self.slices, characters(texts) if chars is None else chars)
        for r in words.where("w BETWEEN 1 AND 4").groupBy("w").count().collect():
            tallies[1, r.w] = r["count"]
        discounts = {}
        for n in (1, 2, 3):
            m = [0, *(max(tallies[n, c], 1) for c in range(1, 5))]
            y = m[1] / (m[1] + 2 * m[2])
            discounts[n] = [min(max(c - (c + 1) * y * m[c + 1] / m[c], 0.1), c - 0.05) for c in (1, 2, 3)]

        def cut(n: int, c: str) -> Column:
            d = discounts[n]
            none = F.when(F.lit(n > 1) & (F.col(c) < self.least), F.col(c).cast("double"))
            return none.when(F.col(c) == 1, F.lit(d[0])).when(F.col(c) == 2, F.lit(d[1])).otherwise(F.lit(d[2]))

        log_weight = F.log((F.col("total") - F.col("kept")) / F.col("total"))
        every, lost = words.where("w > 0").agg(F.sum("w"), F.sum(cut(1, "w"))).first()
        floor = (lost / every if every else 1.0) / self.open_words
        kept = parts[0]
        for part in parts[1:]:
            kept = kept.union(part)
        two = kept.where("kind = 2").select(F.col("x").alias("gram"), F.col("y").alias("b"), F.col("z").alias("c"), F.col("n").alias("k"), F.col("w").alias("after"))
        sums = two.where(F.col("k") >= self.least).groupBy(F.col("b").alias("x")).agg(F.sum(F.col("k") - cut(2, "k")).alias("kept"))
        known = F.when(F.col("w") > 0, (F.col("w") - cut(1, "w")) / F.lit(every or 1)).otherwise(F.lit(0.0))
        ones = stored(words.withColumn("log_p", F.log(known + F.lit(floor))).withColumnRenamed("n", "total").join(sums, "x", "left").select("x", "total", "log_p", F.coalesce(log_weight, F.lit(0.0)).alias("log_w")), "kn-ones")
        lower = two.join(ones.select(F.col("x").alias("b"), "total", "log_w"), "b").join(ones.select(F.col("x").alias("c"), F.col("log_p").alias("log_u")), "c")
        seen = F.col("k") >= self.least
        log_p = F.log(F.when(seen, (F.col("k") - cut(2, "k")) / F.col("total")).otherwise(F.lit(0.0)) + F.exp(F.col("log_w") + F.col("log_u")))
        own = F.when(seen, F.col("log_p") - F.col("log_u") - F.col("log_w")).otherwise(F.lit(0.0))
        twos = stored(lower.withColumn("log_p", log_p).select("gram", "after", "log_p", own.alias("own")), "kn-twos")
        three = kept.where("kind = 3").select(F.col("x").alias("gram"), F.col("y").alias("history"), F.col("z").alias("two"), F.col("n").alias("k"))
        # what comes after no words at all is the start of a text
        start = int(START.view(np.int64)[0])
        totals = twos.where("after > 0").select(F.col("gram").alias("history"), F.col("after").alias("total")).union(spark.range(1).select(F.lit(start).alias("history"), F.lit(tallies[0, 0]).alias("total")))
        sums = three.groupBy("history").agg(F.sum(F.col("k") - cut(3, "k")).alias("kept"))
        weights = stored(sums.join(totals, "history").select("history", "total", log_weight.alias("log_w")), "kn-weights")
        higher = three.join(weights, "history").join(twos.select(F.col("gram").alias("two"), "log_p"), "two")
        below = F.col("log_w") + F.col("log_p")
        threes = stored(higher.select("gram", (F.log((F.col("k") - cut(3, "k")) / F.col("total") + F.exp(below)) - below).alias("own")), "kn-threes")
        discard(*parts, words)
        zero, base = F.lit(0.0), math.log(floor)
        first = weights.where(F.col("history") == start).first()
        rows = ones.select(F.col("x").alias("gram"), (F.col("log_p") - base).alias("own"), F.col("log_w").alias("after"))
        rows = rows.union(twos.join(weights, F.col("gram") == F.col("history"), "left").select("gram", "own", F.coalesce("log_w", zero).alias("after")).where("own != 0 OR after != 0"))
        rows = rows.union(threes.select("gram", "own", zero.alias("after"))).union(spark.range(1).select(F.lit(start).alias("gram"), zero.alias("own"), F.lit(first.log_w if first else 0.0).alias("after")))
        bits = max(4, math.ceil(math.log2(max(1, (ones.count() + twos.count() + threes.count()) / 150_000))))
        shards = rows.withColumn("shard", F.shiftrightunsigned("gram", 64 - bits).cast("int")).groupBy("shard").applyInArrow(packed, "shard int, grams binary, own binary, after binary")
        model = stored(shards.select("shard", F.lit(bits).alias("bits"), F.lit(base).alias("base"), "grams", "own", "after"), "kn-model")
        discard(ones, twos, threes, weights)
        return model

    def word_log_probabilities(self, documents: DataFrame, model: DataFrame, *columns: str) -> DataFrame:
        """``columns``, log_p (natural) and again (whether it equals the word before it) of each word of ``documents`` (text); ``model`` is a stored table of :meth:`fit`.

        A row for each word, joined with the n-grams by broadcast where the model has
        ``broadcast_rows`` of them at most, else by shuffle; :meth:`scores` sums the same values in blocks.
        """
        size, base = model.agg(F.sum(F.length("grams")) / 8, F.first("base")).first()
        grams = model.mapInArrow(unpacked, "gram bigint, own double, after double")
        rows = documents.select(*columns, F.col("text").cast("binary").alias("__text"))
        keys = ("g1", "g2", "g3", "h1", "h2")
        kind = StructType([*rows.drop("__text").schema.fields, *(StructField(k, LongType()) for k in keys), StructField("again", BooleanType())])

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for block in blocks(batches, len(columns)):
                a, b, c, _, sizes = word_runs(block.column(len(columns)), hashes)
                two = mixed(b, c)
                own = block.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *map(signed, (c, two, mixed(a, two), b, mixed(a, b))), pa.array(b == c)], names=[f.name for f in kind.fields])

        out = rows.mapInArrow(words, kind)
        for key in keys:
            side = grams.select(F.col("gram").alias(key), F.col("after" if key[0] == "h" else "own").alias(f"value_{key}"))
            out = out.join(F.broadcast(side) if size <= self.broadcast_rows else side, key, "left")
        total = F.lit(base)
        for key in keys:
            total = total + F.coalesce(f"value_{key}", F.lit(0.0))
        return out.select(*columns, total.alias("log_p"), "again")

    def scores(self, documents: DataFrame, model: DataFrame, rounds: int | None = None, chars: int | None = None) -> DataFrame:
        """doc_id, lang, body, n_words, log_p (sum over the words), n_again of each row.

        Texts are taken in ``rounds`` by a hash; a round's n-grams are dealt in blocks of
        texts to the model's shards, and what they sum to there comes back by block. So
        the shuffle of one round at a time is on disk, and no model leaves the executors.
        """
        rounds = self.runs(characters(documents) if chars is None else chars, rounds or self.rounds)
        bits, base = model.select("bits", "base").first()
        texts = documents.select(F.xxhash64("text").alias("body"), F.col("text").cast("binary").alias("text"))
        out = None
        for turn in range(rounds):
            dealt = texts.where(F.pmod("body", F.lit(rounds)) == turn).mapInArrow(dealt_blocks(bits), "shard int, block bigint, grams binary, who binary")
            sums = dealt.groupBy("shard").cogroup(model.select("shard", "grams", "own", "after").groupBy("shard")).applyInArrow(looked_up, "block bigint, shard int, sums binary")
            part = stored(sums.groupBy("block").applyInArrow(added, "body bigint, n_words bigint, value double, n_again bigint"), "kn-sums")
            out = part if out is None else out.union(part)
        # copies have equal figures
        sums = out.groupBy("body").agg(F.max("n_words").alias("n_words"), (F.min("value") + F.max("n_words") * F.lit(base)).alias("log_p"), F.max("n_again").alias("n_again"))
        return documents.select("doc_id", "lang", F.xxhash64("text").alias("body")).join(small(sums), "body").select("doc_id", "lang", "body", "n_words", "log_p", "n_again")

    def trusted_sample(self, trusted: DataFrame) -> DataFrame:
        """With ``sample_chars``: of ``trusted`` (doc_id, lang, n_chars) the texts that the model is fitted on, four fifths of a language's at most."""
        sums = trusted.groupBy("lang").agg(F.sum("n_chars").alias("all"))
        each = self.sample_chars / max(1, sums.count())
        share = F.least(F.lit(0.8), F.lit(float(each)) / F.greatest("all", F.lit(1)))
        rank = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 32)) / F.lit(float(1 << 32))
        return trusted.join(sums, "lang").where(rank < share).select("doc_id")

    def cross_scores(self, documents: DataFrame, trusted: DataFrame) -> DataFrame:
        """:meth:`scores` of ``documents``: of texts in ``trusted`` (doc_id) under the model of the other half of them, of all others under the model of all.

        Halves are dealt by a hash of doc_id. So each trusted text has the figure of a text
        not seen, and limits may be taken from all of them; a model of half the text knows
        less, which makes limits a little wider, never narrower.
        """
        half = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)).cast("int")
        ids = stored(trusted.select("doc_id", half.alias("__half")), "kn-halves")
        rows = documents.join(small(ids), "doc_id", "left")
        chars = {r["__half"]: r.n or 0 for r in rows.groupBy("__half").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()}
        parts = []
        for half in (None, 0, 1):
            of, fitted = (rows["__half"].isNull(), rows["__half"].isNotNull()) if half is None else (rows["__half"] == half, rows["__half"] == 1 - half)
            seen = sum(n for h, n in chars.items() if h is not None and h != half)
            # halves are short: one slice, and rounds by their share
            model = self.fit(rows.where(fitted).select("text"), None if half is None else max(1, self.slices // 2), seen)
            parts.append(stored(self.scores(rows.where(of), model, None if half is None else max(1, self.rounds // 4), chars.get(half, 0)), "kn-scores"))
            discard(model)
        return parts[0].union(parts[1]).union(parts[2])

    def limits(self, held_out: DataFrame) -> DataFrame:
        """lang, high, most_again: limits from the steadied figures (lang, h, again) of trusted texts under models that did not see them."""
        at = lambda c: F.percentile_approx(c, F.lit(self.quantile), F.lit(10_000))
        return held_out.where("h IS NOT NULL").groupBy("lang").agg((at("h") + self.slack).alias("high"), (at("again") + self.repeat_slack).alias("most_again"))

    @staticmethod
    def passes(h: Column, again: Column) -> Column:
        """Whether figures are within high and most_again; nulls pass."""
        return F.coalesce(h <= F.col("high"), F.lit(True)) & F.coalesce(again <= F.col("most_again"), F.lit(True))

    def classify(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        """One row per row of ``documents``: doc_id, lang, n_words, body, perplexity, limit, repeats, most_repeats, kept.

        A text goes if its perplexity is above ``limit`` or its share of words equal to the
        word before them above ``most_repeats``; figures equal to a limit are kept. There
        is no lower limit: copies of texts that the model was fitted on have low perplexities.
        Trusted are the texts that ``labels`` calls good (quality 1) and not toxic; toxic wording
        that is fluent is not seen by perplexity. Input columns doc_id, text, lang and doc_id, quality, toxic; others are
        ignored. A null or blank text has no words, a null perplexity and is kept, as is
        any text of a language (null counts as one) without trusted texts; null labels
        are not trusted; repeated rows have equal results; a text of any length is read
        whole, its words one by one; an empty table gives no rows.
        """
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
        good = labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct()
        sized = docs.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))
        trusted = stored(sized.join(good, "doc_id").dropDuplicates(["doc_id"]), "trusted")
        if self.sample_chars is None:
            scored, unseen = self.cross_scores(docs, trusted), trusted.select("doc_id")
        else:
            sample = stored(self.trusted_sample(trusted), "kn-sample")
            model = self.fit(docs.join(small(sample), "doc_id", "left_semi"))
            scored, unseen = stored(self.scores(docs, model), "kn-scores"), trusted.select("doc_id").join(small(sample), "doc_id", "left_anti")
        full = scored.where("n_words > 0").groupBy("lang").agg((F.sum("log_p") / F.sum("n_words")).alias("mean"), (F.sum("n_again") / F.sum("n_words")).alias("usual"))
        # a row for each language
        rows = scored.join(F.broadcast(full) if full.count() < 100_000 else full, "lang", "left")
        steady = lambda s, m: (F.col(s) + self.prior_words * F.col(m)) / (F.col("n_words") + self.prior_words)
        some = F.col("n_words") > 0
        rows = rows.withColumns({"h": F.when(some, -steady("log_p", "mean")), "again": F.when(some, steady("n_again", "usual"))})
        held_out = rows.join(unseen, "doc_id", "left_semi")
        limits = stored(self.limits(held_out), "kn-limits")
        out = rows.join(small(limits), "lang", "left")
        return out.select(
            "doc_id", "lang", "n_words", "body", F.exp("h").alias("perplexity"), F.exp("high").alias("limit"),
            F.col("again").alias("repeats"), F.col("most_again").alias("most_repeats"), self.passes(F.col("h"), F.col("again")).alias("kept"),
        )

    def keep_good(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of ``documents`` that :meth:`classify` keeps, with their columns as they are.

        Rows go by text and language, so copies share their fate; null and blank texts,
        null ids and repeated rows stay; an empty table gives none.
        """
        bad = self.classify(documents, labels).where(~F.col("kept")).select(F.col("body").alias("__bad"), F.col("lang").alias("__lang")).distinct()
        rows = documents.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
        same = (F.col("__own") == F.col("__bad")) & (F.coalesce(rows["lang"], F.lit("")) == F.col("__lang"))
        rows = rows.join(small(stored(bad, "bad")), same, "left_anti")
        return rows.drop("__own")
