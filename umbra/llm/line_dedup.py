"""Line dedup by a segment-partition edit join, with Spark expressions only.

Of lines within ``edits`` edits of each other one is equal to the other in at least
one of ``edits + 1`` segments. Each different line enters its segments in an index keyed by
length, segment number and content, and probes, for every length that is no larger
than its own by more than ``edits``, those of its substrings that can be such a
segment. What meets is verified with a bit-parallel edit distance on a band.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import small, stored


#: Characters whose counts, modulo 8, are packed into two numbers of a line; any choice is right.
PACKED = ("etaoinshrdlcumfpgwybv", "kxjqz .,0123456789éñä")
_LOW = sum(1 << 3 * k for k in range(21))


def packed(line: Column, characters: str) -> Column:
    """How often each of the characters stands in a line, three bits each."""
    some = F.array(*map(F.lit, reversed(characters)))
    count = lambda c: (F.length(line) - F.length(F.replace(line, c, F.lit("")))).cast("long").bitwiseAND(F.lit(7))
    return F.aggregate(some, F.lit(0).cast("long"), lambda s, c: s * 8 + count(c))


def apart(a: Column, b: Column) -> Column:
    """The sum of the differences of packed counts; those that wrapped are nearer than they are, never farther.

    All counts are subtracted at once: the borrow of a count is kept from the next one
    by its highest bit, which is put right afterwards.
    """
    low, high = F.lit(_LOW), F.lit(4 * _LOW)
    rest = F.lit(3 * _LOW)
    less = (a.bitwiseOR(high) - b.bitwiseAND(rest)).bitwiseXOR(a.bitwiseXOR(b).bitwiseXOR(high).bitwiseAND(high))
    # 5, 6 and 7 are 3, 2 and 1 the other way round
    minus = F.shiftright(less, 2).bitwiseAND(low)
    least = less.bitwiseXOR(minus * 7) + minus
    ones = lambda at: F.bit_count(F.shiftright(least, at).bitwiseAND(low))
    return ones(0) + 2 * ones(1) + 4 * ones(2)


def packed_allow(a: tuple[Column, ...], b: tuple[Column, ...], edits: int) -> Column:
    """Whether packed counts are near enough; an edit changes two counts by one at most."""
    return sum((apart(x, y) for x, y in zip(a, b, strict=True)), F.lit(0)) <= 2 * edits


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, found by halving steps."""
    most = F.least(F.length(a), F.length(b))
    same = lambda n: (n <= most) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))


def line_distance(a: Column, b: Column, edits: int) -> Column:
    """min(edit distance, edits + 1) of two lines, length(a) <= length(b) <= length(a) + edits, edits <= length(a).

    What both begin and end with is left out, but for as many characters as the band is wide to each side.
    """

    def of(s: Column) -> Column:
        head = F.greatest(s["head"] - edits, F.lit(0))
        tail = F.greatest(F.least(s["tail"], F.least(F.length(s["a"]), F.length(s["b"])) - s["head"]) - edits, F.lit(0))
        core = lambda t: F.split(F.substring(t, head + 1, F.length(t) - head - tail), "")
        return band_distance(core(s["a"]), core(s["b"]), edits)

    both = F.struct(a.alias("a"), b.alias("b"), common_prefix(a, b).alias("head"), common_prefix(F.reverse(a), F.reverse(b)).alias("tail"))
    return F.transform(F.array(both), of)[0]


def band_distance(a: Column, b: Column, edits: int) -> Column:
    """min(edit distance of a and b, edits + 1), for array<string> characters and length(a) <= length(b) <= length(a) + edits.

    A column of the table is kept as bits for 2 * edits + 1 cells around the diagonal:
    vertical steps up and down, moved along with the diagonal for each character of b.
    Bit ``2 * edits - d`` is the cell that is d rows above the band's lower end.
    """
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: _walk(s["a"], s["b"], edits))[0]


def _walk(a: Column, b: Column, edits: int) -> Column:
    """The walk along the band; ``a`` and ``b`` are bound, so they are not worked out at each step."""
    top, full = 2 * edits, (1 << (2 * edits + 1)) - 1
    lit = lambda v: F.lit(v).cast("long")
    flip = lambda x: x.bitwiseXOR(lit(full))
    bit = lambda x, n: F.shiftright(x, n).bitwiseAND(lit(1))

    def step(s: Column, j: Column) -> Column:
        c = F.element_at(b, j + 1)
        match = lit(0)
        for k in range(top + 1):
            i = j - edits + k
            match = match.bitwiseOR(F.when((i >= 0) & (F.get(a, i) == c), lit(1 << k)).otherwise(lit(0)))
        x = match
        up, down = s["up"], s["down"]
        d0 = ((x.bitwiseAND(up) + up).bitwiseAND(lit(full)).bitwiseXOR(up)).bitwiseOR(x).bitwiseOR(down)
        hp = down.bitwiseOR(flip(d0.bitwiseOR(up)))
        hn = d0.bitwiseAND(up)
        # rows of a below the band's lower end: the score walks the diagonal, then along the last row
        rows = F.size(a)
        diagonal = j + edits < rows
        over = j + edits + 1 - rows
        edge = lit(0)
        for k in range(top + 1):
            edge = F.when(over == k, bit(hp, top - k) - bit(hn, top - k)).otherwise(edge)
        score = s["score"] + F.when(diagonal, lit(1) - bit(d0, top)).otherwise(edge)
        half = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(flip(half.bitwiseOR(hp))).alias("up"),
            half.bitwiseAND(hp).alias("down"),
            score.alias("score"),
        )

    raise_by = lit(edits)
    start = F.struct(lit(((1 << (edits + 1)) - 1) << edits).alias("up"), lit(0).alias("down"), raise_by.alias("score"))
    # the score falls by one at most for each character after the diagonal ends
    lost = 2 * raise_by + F.size(b) - F.size(a)
    walked = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, lambda s, j: F.when(s["score"] > lost, s).otherwise(step(s, j)), lambda s: s["score"])
    return F.least(walked, lit(edits + 1))


@dataclass(frozen=True)
class LineDedup:
    """``edits`` allowed between lines; lines of fewer than ``min_chars`` characters are never near
    another, and equal to one only with ``short_repeats``; blank lines are left alone."""

    edits: int = 2
    min_chars: int = 20
    short_repeats: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.edits < 16 or self.min_chars < 4 * self.edits:
            raise ValueError("edits must be 1 to 15, min_chars four times as many")

    def lines(self, documents: DataFrame) -> DataFrame:
        """doc_id, body (hash of the text), pos, line (normalised), chars, line_id, check: two hashes of a line that may go.

        Blank lines, and short ones without ``short_repeats``, are left out.
        """
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
        rows = docs.select("doc_id", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
        rows = rows.select("doc_id", "body", "pos", F.lower(F.trim("raw", F.lit(" \t\r"))).alias("line"))
        rows = rows.withColumn("chars", F.length("line")).where(F.col("chars") >= (1 if self.short_repeats else self.min_chars))
        return rows.withColumns({"line_id": F.xxhash64("line"), "check": F.xxhash64(F.lit(5), "line")})

    def probes(self) -> list[tuple[int, int, int]]:
        """(less, segment, shift): which substrings to look for among lines shorter by ``less`` characters.

        Of the substrings of a segment's length only those are taken whose place lets
        the edits before and behind it fit into ``edits`` (multi-match-aware bounds).
        """
        out = []
        for less in range(self.edits + 1):
            for k in range(self.edits + 1):
                low, high = max(-k, less - (self.edits - k)), min(k, less + (self.edits - k))
                out += [(less, k, shift) for shift in range(low, high + 1)]
        return out

    def keyed(self, texts: DataFrame, wanted: list[tuple[int, int, int]]) -> DataFrame:
        """key, longer, line_id of each line of ``texts`` (line_id, line, chars) for each (less, segment, shift) in ``wanted``.

        The key is a hash of the length, segment number and content; ``longer`` says that
        it is for lines shorter than the line itself.
        """
        n = self.edits + 1
        each = F.array(*(F.struct(*(F.lit(v).alias(name) for name, v in zip(("less", "k", "shift"), w, strict=True))) for w in wanted))

        def of(p: Column) -> Column:
            length = F.col("chars") - p["less"]
            size, extra = F.call_function("div", length, F.lit(n)).cast("int"), length % n
            # the last segments take the remainder
            start = p["k"] * size + F.greatest(F.lit(0), extra - (n - p["k"])) + p["shift"] + 1
            own = size + F.when(extra >= n - p["k"], 1).otherwise(0)
            return F.struct(F.xxhash64(length, p["k"], F.substring(F.col("line"), start, own)).alias("key"), (p["less"] > 0).alias("longer"))

        return texts.select(F.inline(F.transform(each, of)), "line_id")

    def near_links(self, texts: DataFrame) -> DataFrame:
        """(a, b), each struct<line_id, check>: different lines of ``texts`` (line_id, check, line, chars) within ``edits`` edits.

        Keys that lines meet in are found first, on keys alone; the few lines that meet get
        packed counts, which are compared inside the join of those keys.
        """
        own = [(0, k, 0) for k in range(self.edits + 1)]
        index = self.keyed(texts, own).select("key", "line_id").repartition("key")
        probes = self.keyed(texts, [w for w in self.probes() if w not in own])
        met = stored(probes.join(index.select("key").hint("shuffle_hash"), "key", "left_semi"), "line-probes")
        # a line's own segments are its probes for lines of its own length that share them in place
        level = index.groupBy("key").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high")).where("low < high").select("key")
        keys = small(stored(level.union(met.select("key")).distinct(), "line-keys"))
        shared = stored(index.join(keys, "key", "left_semi"), "line-index")
        ids = small(shared.select("line_id").union(met.select("line_id")).distinct())
        counts = [packed(F.col("line"), c).alias(f"c{k}") for k, c in enumerate(PACKED)]
        asked = stored(texts.join(ids, "line_id", "left_semi").select("line_id", "check", "line", *counts), "line-texts")
        named = lambda rows, n: rows.join(asked.select("line_id", *(F.col(f"c{k}").alias(f"{n}{k}") for k in range(len(PACKED)))), "line_id").withColumnRenamed("line_id", n)
        x, same, longer = named(shared, "a"), named(shared, "b").withColumn("longer", F.lit(False)), named(met, "b")
        near = packed_allow(*(tuple(F.col(f"{n}{k}") for k in range(len(PACKED))) for n in "ab"), self.edits)
        meets = lambda y: (x["key"] == y["key"]) & ((y["longer"] & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))) & near
        pairs = (x.hint("shuffle_hash").join(y, meets(y)).select("a", "b") for y in (same, longer))
        pairs = stored(next(pairs).union(next(pairs)).distinct(), "line-pairs")
        side = lambda n: asked.select(F.col("line_id").alias(n), F.struct("line_id", "check").alias(f"id_{n}"), F.col("line").alias(f"l{n}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(line_distance(F.col("la"), F.col("lb"), self.edits) <= self.edits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    def flags(self, documents: DataFrame) -> DataFrame:
        """doc_id, body, flags: for each text with lines that go the fate of its lines, '.', 'x' (equal) or 'n' (near), up to the last that goes.

        A line goes if an equal line, or one within ``edits`` edits, stands earlier; the
        order is by doc_id (null first) and place. Lines are equal if they are so in lower
        case without blanks around them; a line is known by 128 bits of hashes. Copies of a
        row keep or lose the same lines. Texts that keep all their lines have no row.
        """
        lines = self.lines(documents)
        at = F.struct("doc_id", "pos")
        each = lines.groupBy("line_id", "check").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(F.when(F.col("chars") >= self.min_chars, F.col("line"))).alias("line"))
        each = stored(each.withColumn("chars", F.length("line")), "lines")
        links = stored(self.near_links(each.where("line IS NOT NULL").select("line_id", "check", "line", "chars")), "line-links")
        linked = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id.line_id", "id.check")
        ends = each.join(small(linked), ["line_id", "check"], "left_semi").select(F.struct("line_id", "check").alias("id"), "first")
        x, y = ends.select(F.col("id").alias("a"), F.col("first").alias("fa")), ends.select(F.col("id").alias("b"), F.col("first").alias("fb"))
        later = links.join(x, "a").join(y, "b").select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
        later = later.select("id.line_id", "id.check", F.lit(True).alias("near"))
        marked = each.where("first < last").select("line_id", "check", "first").join(later, ["line_id", "check"], "full")
        marked = small(stored(marked.select("line_id", "check", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-marks"), 1_000_000)
        fate = F.when(F.col("first").isNotNull() & ~at.eqNullSafe(F.col("first")), "x").when(F.col("near"), "n")
        hits = lines.select("doc_id", "body", "pos", "line_id", "check").join(marked, ["line_id", "check"]).select("doc_id", "body", "pos", fate.alias("fate")).where("fate IS NOT NULL")
        # copies of a row hit the same places
        sparse = hits.distinct().groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("pos", "fate"))).alias("hits"))
        gaps = F.transform("hits", lambda h, i: F.concat(F.repeat(F.lit("."), h["pos"] - F.when(i > 0, F.get("hits", i - 1)["pos"] + 1).otherwise(0)), h["fate"]))
        return sparse.select("doc_id", "body", F.array_join(gaps, "").alias("flags"))

    def _joined(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` with __flags, null for texts that keep all their lines."""
        flags = self.flags(documents).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("flags").alias("__flags"))
        flags = small(stored(flags, "line-flags"), 200_000)
        rows = documents.withColumn("__own", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
        return rows.join(flags, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body")), "left")

    def marks(self, documents: DataFrame) -> DataFrame:
        """One row per row of ``documents``: doc_id, n_lines, n_equal, n_near, flags.

        Input columns doc_id and text; others are ignored. A null text counts as empty, one empty
        line; repeated rows have equal results; lines of any length are compared whole;
        an empty table gives no rows.
        """
        rows = self._joined(documents.select("doc_id", "text"))
        n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        rows = rows.withColumn("n_lines", F.coalesce(n_lines, F.lit(1)).cast("long"))
        rows = rows.select("doc_id", "n_lines", F.rpad(F.coalesce("__flags", F.lit("")), F.col("n_lines").cast("int"), F.lit(".")).alias("flags"))
        count = lambda c: (F.length("flags") - F.length(F.replace("flags", F.lit(c), F.lit("")))).cast("long")
        return rows.select("doc_id", "n_lines", count("x").alias("n_equal"), count("n").alias("n_near"), "flags")

    def dedup(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` with the repeated lines taken out of text; other columns stay as they are.

        A document whose lines all go keeps its row with an empty text; a null text stays
        null; of repeated rows each loses the same lines; an empty table gives no rows.
        """
        rows = self._joined(documents).withColumn("__keep", F.split("__flags", ""))
        # lines beyond the last one that goes have no flag
        kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.coalesce(F.get("__keep", i), F.lit(".")) == "."), "\n")
        return rows.withColumn("text", F.when(F.col("__flags").isNull(), F.col("text")).otherwise(kept)).select(*documents.columns)
