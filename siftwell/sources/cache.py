"""Index and embedding tables that are kept by the content they were made from, and resumed where they are partial.

A folder of tables is valid only through its manifest, a small JSON file that is written after the tables that it names.
What a run that was cut off leaves behind is named by no manifest, so nothing reads it. No file is renamed, so this holds
in object stores as well.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
#: Rows of doc_index that one committed range of a vector store covers.
RANGE = 1_000_000
#: Passes over the documents in which a vector store's missing ranges are encoded, at most.
PASSES = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's; one under /tmp where all is local."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints/siftwell"
    return root


def written(df: DataFrame, **options: str) -> DataFrame:
    """The table, written to the application's folder and read back, so that what uses it often computes it once.
    options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(docs: DataFrame, columns: list[str], **settings) -> str:
    """16 hex digits over the settings and all rows with their doc_index, so their order counts; summed in Spark."""
    row = F.xxhash64("doc_index", *columns).cast("decimal(38,0)")
    n, total, mixed = docs.agg(F.count("*"), F.sum(row), F.sum(F.xxhash64(F.lit(1), "doc_index", *columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([n, str(total), str(mixed), settings], sort_keys=True).encode()).hexdigest()[:16]


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a folder; None where there is none, or one that was cut off."""
    fs, p = _file(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    except Py4JJavaError as e:
        if "ChecksumException" in e.java_exception.getClass().getName():
            return None
        raise
    finally:
        stream.close()
    return found if isinstance(found, dict) else None


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(content, sort_keys=True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def stored(spark: SparkSession, root: str, key: str, build: Callable[[], dict]) -> dict[str, DataFrame]:
    """The tables kept under root/key by name; built and written where no manifest names them.

    Each build writes to a folder of its own, so two at once don't disturb each other: the later manifest counts. A table
    may be a function of the tables before it, which it gets as they were written.
    """
    read = lambda name, schema, folder: spark.read.schema(schema).parquet(f"{path}/{folder}/{name}")
    path = f"{root}/{key}"
    manifest = read_manifest(spark, path)
    if not manifest or manifest.get("key") != key:
        folder = f"build-{uuid.uuid4().hex}"
        tables: dict[str, DataFrame] = {}
        for name, table in build().items():
            table = table if isinstance(table, DataFrame) else table(tables)
            table.write.parquet(f"{path}/{folder}/{name}")
            tables[name] = read(name, table.schema, folder)
        manifest = {"key": key, "folder": folder, "tables": {name: table.schema.json() for name, table in tables.items()}}
        write_manifest(spark, path, manifest)
    from pyspark.sql.types import StructType

    return {name: read(name, StructType.fromJson(json.loads(schema)), manifest["folder"]) for name, schema in manifest["tables"].items()}


def cached(build: Callable[[], DataFrame], root: str, key: str) -> DataFrame:
    """The table under root/key, built and written where it isn't there, or isn't whole."""
    return stored(SparkSession.getActiveSession(), root, key, lambda: {"table": build()})["table"]


def resume(docs: DataFrame, encode, path: str) -> DataFrame:
    """Encode the documents that the table at path lacks, append them, and return the table."""
    spark = docs.sparkSession
    try:
        todo = docs.join(spark.read.parquet(path).select("doc_index"), "doc_index", "left_anti")
    except AnalysisException:
        todo = docs
    encode(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def vector_store(docs: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, key: str, rows: int = RANGE) -> DataFrame:
    """doc_index and vector of all docs, encoded range by range and kept at path.

    A range has the documents whose doc_index divided by rows gives its number. The missing ranges are encoded in PASSES
    passes at most, one range or more each, so that the work is in proportion to the documents whatever their ranges. A
    pass writes to a folder of its own, where its ranges are counted and measured, and only then named by the manifest;
    a run that stops in between begins with the first range that isn't named. encode takes rows of docs and gives
    doc_index and vector, one each.

    Another key (see fingerprint) or rows gives a new store in the same place. A vector that is null, missing, or of
    another width than the store's is an error, and its pass isn't committed; so are two documents of one doc_index.
    No documents give an empty table. The driver holds the ranges' numbers: one for each `rows` documents.
    """
    spark = docs.sparkSession
    number = F.floor(F.col("doc_index") / F.lit(rows)).cast("long")
    counts = {str(r[0]): r[1] for r in docs.groupBy(number.alias("number")).agg(F.count("*")).orderBy("number").collect()}
    manifest = read_manifest(spark, path)
    if not manifest or manifest.get("key") != key or manifest.get("rows") != rows:
        manifest = {"key": key, "rows": rows, "width": None, "texts": sum(counts.values()), "ranges": {}}
        write_manifest(spark, path, manifest)
    missing = [name for name in counts if name not in manifest["ranges"]]
    step = max(1, -(-len(missing) // PASSES))
    for at in range(0, len(missing), step):
        names = missing[at : at + step]
        folder = f"range-{names[0]}-{uuid.uuid4().hex}"
        out = encode(docs.where(number.isin([int(name) for name in names]))).select(F.col("doc_index").cast("long").alias("doc_index"), F.col("vector").cast("array<float>").alias("vector"))
        out.write.parquet(f"{path}/{folder}")
        size = F.coalesce(F.size("vector"), F.lit(-1))
        found = spark.read.schema("doc_index long, vector array<float>").parquet(f"{path}/{folder}").groupBy(number.alias("number")).agg(F.count("*"), F.countDistinct("doc_index"), F.min(size), F.max(size), F.sum(F.exists("vector", lambda x: x.isNull()).cast("int")))
        got = {str(r[0]): tuple(r[1:]) for r in found.collect()}
        width = manifest["width"] or got.get(names[0], (0, 0, 0))[2]
        wrong = {name: got.get(name) for name in dict.fromkeys([*names, *got]) if got.get(name) != (counts.get(name), counts.get(name), width, width, 0) or name not in names or width < 1}
        if wrong:
            delete(spark, f"{path}/{folder}")
            name, values = next(iter(wrong.items()))
            raise ValueError(f"range {name}: {counts.get(name, 0)} documents of width {manifest['width']} wanted; rows, different documents, least and most width, vectors with gaps: {values}")
        manifest = manifest | {"width": width, "ranges": manifest["ranges"] | dict.fromkeys(names, folder)}
        write_manifest(spark, path, manifest)
    return read_store(spark, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The committed vectors of the store at path."""
    manifest = read_manifest(spark, path)
    if not manifest:
        raise ValueError(f"no vector store at {path}")
    folders = [f"{path}/{f}" for f in dict.fromkeys(manifest["ranges"].values())]
    schema = "doc_index long, vector array<float>"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
