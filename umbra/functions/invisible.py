"""Inspection of invisible Unicode: tag runs, zero-width encodings, direction controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import let, nfkc, trim

#: Code points by role; fixed values.
FLAG, CANCEL = "\U0001f3f4", "\U000e007f"
TAGS = "[\U000e0000-\U000e007f]"
TAG_ASCII = "".join(chr(0xE0000 + c) for c in range(0x20, 0x7F))
ASCII = "".join(chr(c) for c in range(0x20, 0x7F))
TAG_OTHER = "".join(chr(0xE0000 + c) for c in (*range(0x20), 0x7F))
BITS = "​‌‍"
OBFUSCATORS = "­᠎​‌‍⁠﻿"
OPENERS, CLOSER = "‪‫‭‮", "‬"
ISOLATES, ISOLATE_END = "⁦⁧⁨", "⁩"
OVERRIDES = "‭‮"
MARKS = "‎‏؜"
DIRECTION = OPENERS + CLOSER + ISOLATES + ISOLATE_END + MARKS
STRIPPED = "­؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Scores of the kinds of signal found here.
TAG_SCORE, ZERO_WIDTH_SCORE, DIRECTION_SCORE = 50, 40, 35
LATIN_1 = "".join(map(chr, range(256)))
SIGNALS = "array<struct<kind:string,score:int>>"


def contains_invisible(text: Column) -> Column:
    """The cheap gate: any tag, obfuscator or direction control."""
    return F.coalesce(F.rlike(text, F.lit(f"{TAGS}|[{OBFUSCATORS}{DIRECTION}]")), F.lit(False))


def only(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[^{characters}]", "")


def tag_payloads(text: Column) -> Column:
    """Decoded payloads of suspicious tag runs: those with two tag letters or more that are no flag sequence."""
    runs = F.regexp_extract_all(text, F.lit(f"{FLAG}?{TAGS}+"), F.lit(0))
    odd = F.filter(runs, lambda r: ~(F.startswith(r, F.lit(FLAG)) & F.endswith(r, F.lit(CANCEL))))
    return F.filter(F.transform(odd, lambda r: F.translate(only(r, TAG_ASCII[0] + "-" + TAG_ASCII[-1]), TAG_ASCII, ASCII)), lambda d: F.length(d) >= 2)


def decoded_bits(text: Column) -> Column:
    """The best reading of zero-width characters as bits, or null.

    Two symbols are the bits; of three, each may be a separator. Both polarities are
    read as bytes in Latin-1, readings less than 85 % printable are dropped, and the one
    with most letters is taken, the earlier one on ties.
    """
    names = F.translate(only(text, BITS), BITS, "012")
    return F.when(F.rlike(text, F.lit(f"(?:[{BITS}][^{BITS}]*){{16}}")), let(names, lambda n: let(F.array_distinct(F.split(n, "")), lambda s: _best_reading(n, s))))


def _best_reading(names: Column, symbols: Column) -> Column:
    """``names`` has a digit 0 to 2 for each zero-width character, ``symbols`` those that occur, as met."""

    def reading(order: int, zero: Column, one: Column) -> Column:
        digits = F.call_function("translate", F.regexp_replace(names, F.concat(F.lit("[^"), zero, one, F.lit("]")), F.lit("")), F.concat(zero, one), F.lit("01"))

        def of(d: Column) -> Column:
            letters = F.transform(
                F.sequence(F.lit(0), F.greatest((F.length(d) / 8).cast("int") - 1, F.lit(0))),
                lambda i: F.substring(F.lit(LATIN_1), F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 2, 10).cast("int") + 1, F.lit(1)),
            )
            read = lambda t: F.struct(F.length(F.regexp_replace(t, "[^A-Za-z]", "")).alias("letters"), F.lit(-order).alias("order"), t.alias("text"))
            return F.when((F.length(d) >= 16) & (F.length(d) % 8 == 0), let(F.array_join(letters, ""), read))

        return let(digits, of)

    at = lambda k: F.get(symbols, F.lit(k))
    pairs = lambda found: [x for a, b in found for x in ((a, b), (b, a))]
    choices = lambda found: F.array_compact(F.array(*(reading(k, a, b) for k, (a, b) in enumerate(pairs(found)))))
    three = [tuple(at(k) for k in range(3) if k != apart) for apart in range(3)]
    every = F.when(F.size(symbols) == 2, choices([(at(0), at(1))])).when(F.size(symbols) == 3, choices(three))
    printable = F.filter(every, lambda r: F.length(F.regexp_replace(r["text"], "[^\x20-\x7e\n\r\t]", "")) / F.length(r["text"]) >= 0.85)
    return F.array_max(printable)["text"]


def _depth(controls: Column, up: str, down: str) -> Column:
    """Final and least depth of nesting."""
    step = lambda c: F.when(F.lit(up).contains(c), 1).when(c == down, -1).otherwise(0)
    return F.aggregate(
        controls,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, c: F.struct((a["now"] + step(c)).alias("now"), F.least(a["least"], a["now"] + step(c)).alias("least")),
    )


def inspect(df: DataFrame, column: str, prefix: str = "u_", normalise: bool = True) -> DataFrame:
    """Add the inspection of ``column`` as columns with ``prefix``.

    tag_runs (payloads), tag_count, tag_decoded, zw_count, zw_longest, zw_decoded,
    bidi_count, bidi_overrides, bidi_unbalanced, signals, semantic, display. All but the
    semantic text are worked out only where the gate finds something. A null text
    counts as empty. ``normalise`` turns the NFKC step on.
    """
    p = lambda name: prefix + name
    col = lambda name: F.col(p(name))
    text = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumn(p("gate"), contains_invisible(text))
    where = lambda value, other: F.when(col("gate"), value).otherwise(F.lit(other))
    df = df.withColumns(
        {
            p("tag_runs"): F.when(col("gate"), tag_payloads(text)).otherwise(F.array().cast("array<string>")),
            p("zw_count"): where(F.length(only(text, OBFUSCATORS)), 0),
            p("zw_longest"): where(F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"[{OBFUSCATORS}]+"), F.lit(0)), F.length)), F.lit(0)), 0),
            p("zw_decoded"): F.when(col("gate"), decoded_bits(text)),
            p("controls"): F.when(col("gate"), F.array_remove(F.split(only(text, DIRECTION), ""), "")).otherwise(F.array().cast("array<string>")),
        }
    )
    df = df.withColumns(
        {
            p("tag_count"): F.aggregate(p("tag_runs"), F.lit(0), lambda a, r: a + F.length(r)),
            p("tag_decoded"): F.when(F.size(p("tag_runs")) > 0, F.array_join(p("tag_runs"), " ")),
            p("bidi_count"): F.size(p("controls")),
            p("bidi_overrides"): F.size(F.filter(p("controls"), lambda c: F.lit(OVERRIDES).contains(c))),
            p("embeds"): _depth(col("controls"), OPENERS, CLOSER),
            p("isolates"): _depth(col("controls"), ISOLATES, ISOLATE_END),
        }
    )
    crooked = lambda d: (col(d)["least"] < 0) | (col(d)["now"] != 0)
    df = df.withColumn(p("bidi_unbalanced"), crooked("embeds") | crooked("isolates"))
    signal = lambda when, kind, score: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score")))
    dense = (col("zw_count") >= 4) & (col("zw_count") / F.greatest(F.length(text), F.lit(1)) >= 0.2)
    bare = F.translate(F.regexp_replace(text, f"{FLAG}{TAGS}*{CANCEL}(?!{TAGS})", FLAG), TAG_ASCII + TAG_OTHER + STRIPPED, ASCII)
    df = df.withColumns(
        {
            p("signals"): F.array_compact(
                F.array(
                    signal(F.size(p("tag_runs")) > 0, "unicode-tags", TAG_SCORE),
                    signal(col("zw_decoded").isNotNull() | (col("zw_longest") >= 8) | dense, "zero-width-encoding", ZERO_WIDTH_SCORE),
                    signal((col("bidi_overrides") > 0) | col("bidi_unbalanced") | (col("bidi_count") >= 6), "bidi-control", DIRECTION_SCORE),
                )
            ),
            p("bare"): F.when(col("gate"), bare).otherwise(text),
        }
    )
    if normalise:
        df = df.withColumn(p("bare"), nfkc(col("bare")))
    new = col("zw_decoded").isNotNull() & ~F.contains(F.lower(col("bare")), F.lower(F.coalesce(col("zw_decoded"), F.lit(""))))
    df = df.withColumn(p("semantic"), F.when(new, trim(F.concat(col("bare"), F.lit(" "), col("zw_decoded")))).otherwise(col("bare")))
    # fixed value
    nothing = F.concat(F.lit("（不可視Unicode "), F.length(text), F.lit("文字）"))
    df = df.withColumn(p("display"), F.coalesce(F.nullif(trim(col("semantic")), F.lit("")), col("tag_decoded"), col("zw_decoded"), nothing))
    return df.drop(*(p(x) for x in ("gate", "controls", "embeds", "isolates", "bare")))
