"""Line dedup against brute force."""

import random
import re
import time

from pyspark.sql import functions as F

from umbra.llm.common import CLEANUP, stored
from umbra.llm.line_dedup import PACKED, LineDedup, band_distance, line_distance, packed, packed_allow


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("abcé"))
        elif s and at < len(s):
            s[at : at + 1] = [] if kind == 1 else [r.choice("abcé")]
    return "".join(s)


def test_band_distance_is_exact_up_to_the_limit(spark):
    r = random.Random(4)
    for edits in (1, 2, 3):
        rows = []
        for _ in range(600):
            a = "".join(r.choice("abcé") for _ in range(r.randint(4 * edits, 30)))
            b = edited(r, a, r.randint(0, edits + 2))
            a, b = sorted((a, b), key=len)
            if 0 <= len(b) - len(a) <= edits and len(a) >= edits:
                rows.append((a, b, min(distance(a, b), edits + 1)))
        df = spark.createDataFrame(rows, "a string, b string, want int")
        out = df.select("a", "b", "want", band_distance(F.split("a", ""), F.split("b", ""), edits).alias("got"))
        assert out.where("got != want").collect() == []
        trimmed = df.select("want", line_distance(F.col("a"), F.col("b"), edits).alias("got"), packed_allow(*(tuple(packed(F.col(c), x) for x in PACKED) for c in "ab"), edits).alias("may"))
        assert trimmed.where(f"got != want OR (want <= {edits} AND NOT may)").collect() == []


def brute(rows, edits, least):
    """Flags of each row (doc_id, text), by comparing all lines."""
    places = []
    for i, t in rows:
        for p, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r").lower()
            if len(line) >= least:
                places.append(((i is not None, i or 0, p), line))
    first = {}
    for at, line in sorted(places):
        first.setdefault(line, at)
    near = {x for x in first for y in first if x != y and first[y] < first[x] and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits}
    out = []
    for i, t in rows:
        flags = ""
        for p, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r").lower()
            flags += "." if len(line) < least else "x" if first[line] != (i is not None, i or 0, p) else "n" if line in near else "."
        out.append((i, flags))
    return sorted(out, key=str)


def test_flags_match_brute_force(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abc é") for _ in range(r.randint(20, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 5])) for _ in range(r.randint(0, 6))] + r.choice([[], ["short"], [""]])
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(None, base[0] + "\n" + base[1].upper()), (77, None), (78, ""), (5, rows[5][1]), (79, "x" * 500 + "\n" + "x" * 501)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, body string")
    d = LineDedup()
    got = sorted(((x.doc_id, x.flags) for x in d.marks(docs).collect()), key=str)
    assert got == brute(rows, 2, 20)
    kept = {(i, "\n".join(x for x, f in zip((t or "").split("\n"), fl, strict=True) if f == ".")) for (i, t), fl in zip(sorted(rows, key=lambda x: str((x[0], ""))), [f for _, f in got], strict=True) if i not in (None, 5)}
    out = {(x.doc_id, x.text or "") for x in d.dedup(docs).collect() if x.doc_id not in (None, 5)}
    assert out == kept and d.dedup(docs).columns == docs.columns


def test_empty_table(spark):
    assert LineDedup().marks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_repeat(spark):
    docs = spark.createDataFrame([(1, "Menu\n\nabc"), (2, " menu\n\nabd"), (3, "abc\nown line")], "doc_id long, text string")
    got = {x.doc_id: x.flags for x in LineDedup(short_repeats=True).marks(docs).collect()}
    assert got == {1: "...", 2: "x..", 3: "x."}


def test_packed_counts_are_compared_all_at_once(spark):
    r = random.Random(9)
    rows = [tuple("".join(r.choice("etaoinshrdlcumfpgwybvxq") for _ in range(r.randint(0, n))) for _ in range(2)) for n in (3, 6, 40, 200) for _ in range(100)]
    rows += [(a, edited(r, a, 2)) for a, _ in rows] + [("e" * 7, ""), ("e" * 8, ""), ("v" * 4, ""), ("v" * 5, "e" * 5), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *(packed_allow(*(tuple(packed(F.col(c), x) for x in PACKED) for c in "ab"), e).alias(f"m{e}") for e in (1, 2, 3)))
    for x in df.collect():
        apart = sum(min(d := abs(x.a.count(c) - x.b.count(c)) % 8, 8 - d) for c in "".join(PACKED))
        assert (x.m1, x.m2, x.m3) == (apart <= 2, apart <= 4, apart <= 6)


def test_stored_tables_leave_no_shuffles(spark):
    """op2 keeps tables of lines; the shuffles they came from must not stay beside them."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+", blocks.getAllFiles().mkString(" ")))
    before, setting = held(), spark.conf.get(CLEANUP)
    for _ in range(3):
        df = stored(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.count("*").alias("n")), "test")
    end = time.monotonic() + 20
    while held() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(CLEANUP) == setting and df.where("n = 4").limit(9).toArrow().num_rows == 9
