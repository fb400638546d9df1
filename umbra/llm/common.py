"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in the quality rules and in near-duplicate shingles.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table with Spark's reader, whatever store the path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Whether shuffle files are removed at the end of the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a fresh temporary folder; on a cluster that
    is an error, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="umbra-shared-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId].removeprefix("file://"), ignore_errors=True)
    return _OWN[context.applicationId]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with files that survive the loss of any executor. The shuffles of the
    write, which nothing reads again, go at its end, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from :func:`stored` that nothing reads again."""
    for df in tables:
        spark, path = df.sparkSession, _PATHS.pop(df)
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` (short) rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def states_before(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """For each item of an array the state (of type ``kind``) that ``step`` makes of the items before it.

    ``merge`` joins the states of neighbouring runs of items. Runs of ``size`` items are
    walked alone and then joined, so that appending to arrays costs no more than ``size``
    copies an item, however many there are.
    """
    none = F.array().cast(f"array<{kind}>")
    put = lambda a, after: F.struct(after.alias("state"), F.concat(a["out"], F.array(a["state"])).alias("out"))
    start = F.struct(zero.alias("state"), none.alias("out"))

    def of(xs: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / size).cast("int") - 1, F.lit(0))),
            lambda c: F.aggregate(F.slice(xs, c * size + 1, F.lit(size)), start, lambda a, x: put(a, step(a["state"], x))),
        )
        shift = lambda rs: F.zip_with(rs, F.aggregate(rs, start, lambda a, r: put(a, merge(a["state"], r["state"])))["out"], lambda r, o: F.transform(r["out"], lambda b: merge(o, b)))
        return F.flatten(let(runs, shift))

    return let(items, of)


def match_spans(text: Column, pattern: Column | str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,stop,hit>>, in code points, end exclusive.

    The pattern is split away once for the gaps and extracted once for the hits;
    positions are the running sums of both, in time in proportion to the matches. The
    pattern must not match the empty string.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    length = lambda t: F.length(t).cast("long")
    both = F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, h: F.struct(length(g).alias("gap"), length(h).alias("len"), h.alias("hit")))

    def of(steps: Column) -> Column:
        before = states_before(steps, "bigint", F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["len"], lambda a, b: a + b)
        return F.zip_with(steps, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("stop"), x["hit"].alias("hit")))

    return let(F.filter(both, lambda x: x["hit"].isNotNull()), of)
