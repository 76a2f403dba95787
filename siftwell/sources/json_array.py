"""JSON arrays of objects: one file read by many tasks, and one file written from many.

Reading: the text source cuts a file into byte ranges, and these at every closing brace, wherever it stands. Whether a
segment begins within a string is the parity of the quotes before it, how deep it begins is the sum of the brackets before
it that are outside of strings, and an element's number is the count of the braces before it that close an element. These
three prefix sums are taken within each range and over the ranges' totals, so no task sees more than a range or an element.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import cache

SEPARATOR = ",\n"
NO_ARRAY = "the file must hold a JSON array"


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """range, pos, value, quotes, and d0, d1: the change of depth by a segment that begins outside or within a string.

    The brace that ends the segment counts; the last segment of the file has none.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def depth(start: int) -> Column:
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == start), "")
        return _count(outside, "[{") - _count(outside, "]")

    rows = raw.select("file", "range", "pos", "value", (F.size(parts) - 1).cast("long").alias("quotes"), depth(0).cast("long").alias("d0"), depth(1).cast("long").alias("d1"))
    return cache.written(rows)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0) and value (its JSON text) of each element of the array in one file.

    Anything but an array of objects is an error, as is more than one file. Strings may hold brackets, quotes and line
    breaks; white space may stand wherever JSON allows it. An element has to fit a task, the file doesn't.
    """
    rows = segments(spark, path)
    here = Window.partitionBy("range").orderBy("pos")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # within a range, for both states that it may begin in
    local = rows.withColumn("q", upto("quotes", before))
    odd = F.col("q") % 2 == 1
    ends_odd = (F.col("q") + F.col("quotes")) % 2 == 1
    closing = lambda within: F.when(within, 0).otherwise(-1)
    local = local.withColumn("c0", F.when(odd, F.col("d1")).otherwise(F.col("d0")) + closing(ends_odd)).withColumn("c1", F.when(odd, F.col("d0")).otherwise(F.col("d1")) + closing(~ends_odd))
    totals = local.groupBy("range").agg(F.sum("quotes").alias("quotes"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    # a row per range: their number is the file's size by that of a split
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("within", upto("quotes", ranges) % 2 == 1).withColumn("depth_base", upto(F.when(F.col("within"), F.col("c1")).otherwise(F.col("c0")), ranges)).select("range", "within", "depth_base")
    placed = local.join(F.broadcast(starts), "range")
    change = F.when(F.col("within"), F.col("c1")).otherwise(F.col("c0"))
    placed = placed.withColumn("depth", F.col("depth_base") + F.sum(change).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    outside = (F.when(F.col("within"), 1).otherwise(0) + F.col("q") + F.col("quotes")) % 2 == 0
    placed = cache.written(placed.select("file", "range", "pos", "value", (outside & (F.col("depth") == 1)).alias("ends")))
    last = placed.orderBy(F.desc("range"), F.desc("pos")).select("ends").first()
    if last is None or last["ends"]:  # the array's bracket has to follow the last element
        raise ValueError(NO_ARRAY)
    counts = placed.groupBy("range").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    bases = counts.select("range", upto("n", ranges).alias("base"))
    numbered = placed.join(F.broadcast(bases), "range").withColumn("element", F.col("base") + upto(F.col("ends").cast("long"), before))
    texts = numbered.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("range", "pos", "value"))).alias("s"), F.max("ends").alias("whole"), F.min("file").alias("file"), F.max("file").alias("last"))
    text = F.array_join(F.transform("s", lambda x: x["value"]), "}")
    # what stands before an element: the array's bracket, or a comma; after the last one, the closing bracket alone
    opening = F.when(F.col("element") == 0, F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    body = F.concat(F.regexp_replace("t", opening, ""), F.lit("}"))
    after = F.when(F.col("element") == 0, F.lit(r"^\s*\[\s*\]\s*$")).otherwise(F.lit(r"^\s*\]\s*$"))
    bad = F.raise_error(F.lit(NO_ARRAY)).cast("string")
    # a bracket or comma that isn't there leaves the text as it was, so its length tells
    good = (F.col("file") == F.col("last")) & F.when(F.col("whole"), body.startswith("{") & (F.length(body) <= F.length("t"))).otherwise(F.regexp_like("t", after))
    checked = texts.withColumn("t", text).select(F.col("element").alias("pos"), "whole", F.when(F.coalesce(good, F.lit(False)), F.when(F.col("whole"), body)).otherwise(bad).alias("value"))
    # what follows the last element is checked, too, and gives no row
    return checked.where(F.col("whole") | F.col("value").isNotNull()).select("pos", "value")


def read_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """pos and item of each element, as read by the element's type; an element that isn't valid JSON is an error."""
    item = F.from_json("value", element)
    bad = F.raise_error(F.lit("an element isn't valid JSON")).cast(element)
    return elements(spark, path).select("pos", F.when(F.col("value").isNull() | F.try_parse_json("value").isNotNull(), item).otherwise(bad).alias("item"))


def indented(rows: DataFrame, order: list[str], fields: str | list[str] = "*", out: str = "text") -> DataFrame:
    """Each row as an element of an indented array: two spaces a level, letters of any script as they are, null fields
    kept, in the order of the columns that fields names; with the columns of order, renamed o0, o1 and so on."""
    ship_package(rows.sparkSession)
    packed = rows.select(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.to_json(F.struct(*([fields] if isinstance(fields, str) else fields)), {"ignoreNullFields": "false"}).alias(out))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spelt = [json.dumps(json.loads(x), ensure_ascii=False, indent=2).replace("\n", "\n  ") for x in batch[out]]
            yield batch.assign(**{out: spelt})

    kinds = ", ".join(f"`{n}` {t}" for n, t in packed.dtypes)
    return packed.mapInPandas(spell, kinds)


def write_array(rows: DataFrame, path: str, order: list[str], fields: str | list[str] = "*") -> None:
    """One file with an indented JSON array of the rows in the order of the given columns, and a line break at its end.

    Tasks spell and sort the rows and write fragments; these are then put one after another by a stream of small pieces
    on the driver, which holds none of them whole. No rows give an empty array. A file at path is replaced by a whole one.
    """
    spark = rows.sparkSession
    names = [f"o{k}" for k in range(len(order))]
    spelt = indented(rows, order, fields).repartitionByRange(*names).sortWithinPartitions(*names)
    folder = f"{cache.shared_dir(spark)}/siftwell/{spark.sparkContext.applicationId}/array-{uuid.uuid4().hex}"
    spelt.select(F.concat(F.lit("  "), "text").alias("value")).write.option("lineSep", SEPARATOR).text(folder)
    fs, source = cache._file(spark, folder)
    jvm = spark.sparkContext._jvm
    parts = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen())
    target_fs, aside = cache._file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = target_fs.create(aside, True)
    try:
        stream.write(bytearray(b"[\n" if parts else b"[]\n"))
        for k, (name, size) in enumerate(parts, 1):
            fragment = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:  # nothing parts the last element from the bracket
                held = jvm.org.apache.hadoop.util.LimitInputStream(fragment, size - (len(SEPARATOR) if k == len(parts) else 0))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, stream, 1 << 16, False)
            finally:
                fragment.close()
        if parts:
            stream.write(bytearray(b"\n]\n"))
    finally:
        stream.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target_fs.delete(target, False)
    target_fs.rename(aside, target)
    cache.delete(spark, folder)
