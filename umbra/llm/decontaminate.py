"""Benchmark decontamination by template canonicalisation, with Spark expressions only.

Numbers, names and units become typed placeholders, so a question whose values were
changed keeps its template. Hashed windows of template tokens are joined between
benchmark and documents; windows of little but placeholders by the words they stand for.
Each hit fixes an alignment, along which the whole item is compared: a long enough run
of equal template tokens is a leak if the placeholders' values in it agree one to one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import small, stored

#: Units that follow a number; fixed values.
UNITS = "kg g mg lb km m cm mm mi ft l ml s ms h min kmh mph kw kwh w v hz mb gb kb tb percent meters metres miles hours minutes seconds days weeks years grams kilograms liters litres dollars euros pounds cents"
#: Words that are no names though they begin a sentence; fixed values.
STARTERS = (
    "A An The If When While How What Which Who Whose Why Where In On At Of For To And Or But It Its Is Are Was Were Do Does Did Has Have Had Can Will This That These Those There Then After Before Each Every "
    "Find Given Let Suppose Calculate Compute Some All Any Both One Two Three No Not By With From As So He She They We You I His Her Their Our Your My "
    "Der Die Das Ein Eine Und Ist Wenn Wie Was Le La Les Un Une Des Du De Et Est Si El Los Las Una Es En Que Por Con"
)
NAME, NUMBER, UNIT = "<name>", "<num>", "<unit>"


def canonical(text: Column) -> Column:
    """The template of a text: one token for each token, white space as it was.

    A capitalised word is a name wherever it stands, unless it is one that often begins
    a sentence, so a passage has one template whatever stands before it.
    """
    names = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}'’-])(?!(?:{'|'.join(STARTERS.split())})(?![\p{{L}}'’-]))[\p{{L}}'’-]+", NAME)
    numbers = F.regexp_replace(names, r"\d+(?:[.,:/]\d+)*", NUMBER)
    units = F.regexp_replace(numbers, rf"({NUMBER}\s?)(?i:{'|'.join(UNITS.split())})(?!\p{{L}})|({NUMBER})[%€$£°]", f"$1$2{UNIT}")
    return F.lower(F.regexp_replace(units, r"[^\p{L}\p{N}<>\s]+", ""))


def template(text: Column) -> Column:
    """The template's tokens."""
    return F.array_remove(F.split(canonical(text), r"\s", -1), "")


def aligned(text: Column) -> Column:
    """array<struct<token, value>>: template tokens with the words they stand for."""
    values = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,:/%€$£°]+|[.,:/]+(?=\s|$)", ""), r"\s", -1)
    both = F.zip_with(F.split(canonical(text), r"\s", -1), values, lambda t, v: F.struct(t.alias("token"), F.lower(v).alias("value")))
    return F.filter(both, lambda x: x["token"] != "")


def is_slot(token: Column) -> Column:
    return token.contains("<") & (token.contains(NAME) | token.contains(NUMBER) | token.contains(UNIT))


@dataclass(frozen=True)
class Decontamination:
    """``width`` tokens in a window, every ``step``-th window of a document, and the
    least run of equal tokens, which is ``width + step - 1`` or more so that every
    such run holds a window. Windows with fewer than ``literals`` tokens that are no
    placeholders are looked for word by word, so only as they are. A benchmark of more than ``broadcast_rows`` windows is joined by
    shuffle instead of broadcast."""

    width: int = 8
    step: int = 1
    run: int = 11
    literals: int = 4
    broadcast_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if self.run < self.width + self.step - 1:
            raise ValueError("run must be width + step - 1 at least")

    def _windows(self, rows: DataFrame, step: int) -> DataFrame:
        """``rows`` with a row for each window (``at``, its place, and ``hash``) of the tokens of ``text``.

        Windows are made by doubling: the mark of 2n tokens is that of two neighbours of n, so
        a window costs a few steps and not one a token.
        """
        others = [c for c in rows.columns if c != "text"]
        tokens = F.transform("template", lambda t: F.xxhash64(t)).alias("tokens")
        plain = F.transform("template", lambda t: F.when(is_slot(t), 0).otherwise(1)).alias("plain")
        df = rows.withColumn("template", template(F.col("text"))).select(*others, "text", tokens, plain)
        hashed, added = (lambda x, y: F.xxhash64(x, y)), (lambda x, y: x + F.coalesce(y, F.lit(0)))
        df = self._spans(df, "plain", added)
        # words count only where some window is short of literals
        words = F.transform(aligned(F.col("text")), lambda t: F.xxhash64(F.coalesce(t["value"], F.lit(""))))
        df = df.withColumn("words", F.when(F.exists(F.slice("plain", F.lit(1), F.greatest(F.size("plain") - (self.width - 1), F.lit(0))), lambda n: n < self.literals), words)).drop("text")
        df = self._spans(self._spans(df, "tokens", hashed), "words", hashed)
        pick = F.transform("tokens", lambda h, i: F.when(F.get("plain", i) >= self.literals, h).otherwise(F.xxhash64(F.lit("words"), F.get("words", i))))
        whole = F.slice(F.when(F.col("words").isNull(), F.col("tokens")).otherwise(pick), F.lit(1), F.greatest(F.size("tokens") - (self.width - 1), F.lit(0)))
        out = df.select(*others, F.posexplode(whole).alias("at", "hash"))
        return out if step == 1 else out.where(F.col("at") % step == 0)

    def _spans(self, df: DataFrame, name: str, joined: Callable[[Column, Column], Column]) -> DataFrame:
        """``df`` with the array ``name`` of marks of one token replaced by marks of ``width`` tokens from each place on.

        Marks that reach beyond the end are there but mean nothing.
        """
        beside = lambda left, right, by: F.transform(left, lambda x, i: joined(x, F.get(right, i + by)))
        done, rest, n, span = "", self.width, 1, 0
        df = df.withColumn("__one", F.col(name))
        while rest:
            if rest % 2:
                df = df.withColumn("__done", beside("__done", "__one", span) if done else F.col("__one"))
                done, span = "__done", span + n
            rest //= 2
            if rest:
                df, n = df.withColumn("__one", beside("__one", "__one", n)), n * 2
        return df.withColumn(name, F.col(done)).drop("__one", "__done")

    def index(self, benchmark: DataFrame) -> DataFrame:
        """hash, item_id, item_at of the benchmark's windows."""
        items = benchmark.where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        rows = self._windows(items, 1)
        return rows.select("hash", "item_id", F.col("at").alias("item_at")).distinct()

    def leaks(self, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
        """doc_id, item_id, longest_run, n_equal, coverage, changed: one row for each row of ``documents`` and item it leaks.

        ``longest_run`` is the longest run whose placeholders agree one to one within it;
        ``changed`` says that a placeholder's value differs in such a run. Input columns doc_id, text
        and item_id, text; others are ignored. Null or short texts leak nothing; a
        null item_id is ignored; a null doc_id keeps its rows; repeated rows have equal
        results; of rows with one item_id each text counts. Either table may be empty.
        Texts of any length are read whole, window by window. Of items with fewer than
        ``run`` tokens all must stand in the document; those with fewer than ``width``
        are too short to be evidence.
        """
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
        index = self.index(benchmark)
        index = small(index, self.broadcast_rows)
        windows = self._windows(docs.select("body", "text"), self.step)
        hits = windows.join(index, "hash")
        places = stored(hits.select("body", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "places")

        items = benchmark.select("item_id", aligned(F.coalesce("text", F.lit(""))).alias("item"))
        wanted = docs.join(small(places.select("body").distinct()), "body", "left_semi").select("body", "doc_id", aligned(F.col("text")).alias("doc"))
        both = wanted.join(places, "body").join(items, "item_id")
        pairs = F.transform(
            "item",
            lambda t, j: F.struct(t.alias("item"), F.when((j + F.col("shift") >= 0) & (j + F.col("shift") < F.size("doc")), F.get("doc", j + F.col("shift"))).alias("doc")),
        )
        same = lambda p: F.coalesce(p["item"]["token"] == p["doc"]["token"], F.lit(False))
        # runs of equal tokens, as places after their ends and lengths
        none = F.array().cast("array<struct<stop:int,length:int>>")
        need = F.least(F.lit(self.run), F.size("item"))
        ended = lambda a: F.when(a["now"] >= a["need"], F.concat(a["all"], F.array(F.struct(a["at"].alias("stop"), a["now"].alias("length"))))).otherwise(a["all"])
        runs = F.aggregate(
            "pairs",
            F.struct(F.lit(0).alias("at"), F.lit(0).alias("now"), none.alias("all"), need.alias("need")),
            lambda a, p: F.struct((a["at"] + 1).alias("at"), F.when(same(p), a["now"] + 1).otherwise(0).alias("now"), F.when(same(p), a["all"]).otherwise(ended(a)).alias("all"), a["need"].alias("need")),
            ended,
        )
        slots = lambda r: F.array_distinct(
            F.transform(
                F.filter(F.slice("pairs", r["stop"] - r["length"] + 1, r["length"]), lambda p: is_slot(p["item"]["token"])),
                lambda p: F.struct(p["item"]["token"].alias("kind"), p["item"]["value"].alias("was"), p["doc"]["value"].alias("now")),
            )
        )
        ends = lambda r, side: F.size(F.array_distinct(F.transform(r["slots"], lambda s: F.struct(s["kind"], s[side]))))
        found = both.select("doc_id", "body", "item_id", F.size("item").alias("n_item"), "item", pairs.alias("pairs"))
        found = found.select("doc_id", "body", "item_id", "n_item", F.size(F.filter("pairs", same)).alias("n_equal"), F.transform(runs, lambda r: F.struct(r["length"].alias("length"), slots(r).alias("slots"))).alias("runs"))
        found = found.withColumn("runs", F.filter("runs", lambda r: (F.size(r["slots"]) == ends(r, "was")) & (F.size(r["slots"]) == ends(r, "now"))))
        good = found.where(F.size("runs") > 0).withColumn("longest_run", F.array_max(F.transform("runs", lambda r: r["length"]))).withColumn("slots", F.flatten(F.transform("runs", lambda r: r["slots"])))
        # several alignments, or copies of a row: the best one of each row counts
        best = good.groupBy("doc_id", "body", "item_id").agg(
            F.max("longest_run").alias("longest_run"),
            F.max("n_equal").alias("n_equal"),
            F.max(F.col("n_equal") / F.col("n_item")).alias("coverage"),
            F.min(F.exists("slots", lambda s: s["was"] != s["now"])).alias("changed"),
        )
        return best.drop("body")

    def clean(self, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
        """The rows of ``documents`` that leak no item, with their columns as they are.

        Rows go by their text, so copies share their fate; null and blank texts, null ids
        and repeated rows stay; an empty table gives none.
        """
        bad = self.leaks(documents.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__body")).distinct()
        rows = documents.withColumn("__body", F.xxhash64(F.coalesce("text", F.lit(""))))
        return rows.join(small(stored(bad, "leaks")), "__body", "left_anti").drop("__body")
