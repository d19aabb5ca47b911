"""JSON-lines and separated-value records: typed and torn-tolerant reads,
canonical writes, manifests of content hashes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed records; a line that doesn't fit fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_journal(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed records of a journal that may be torn: blank lines and lines that
    don't parse are left out."""
    wide = StructType([*schema.fields, StructField("_torn", StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    first = F.coalesce(*(F.col(f.name).cast("string") for f in schema.fields), F.col("_torn"))
    return df.where(F.col("_torn").isNull() & first.isNotNull()).drop("_torn")


def _ordered(c: Column, t: DataType, name: str) -> Column:
    """A value with the fields of all its structs in order; floats are refused."""
    if isinstance(t, FloatType | DoubleType):
        raise ValueError(f"{name}: a canonical record holds no floats")
    if isinstance(t, StructType):
        fields = sorted(t.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(_ordered(c[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in fields)))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _ordered(x, t.elementType, name))
    if isinstance(t, MapType):
        items = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(items, lambda e: F.struct(e["key"], _ordered(e["value"], t.valueType, name))))
    return c


def canonical(df: DataFrame) -> DataFrame:
    """One `value` a row: compact JSON, keys in order at every depth, nulls
    written out. Floats at any depth are an error."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    made = F.struct(*(_ordered(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in fields))
    return df.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("value"))


def write_canonical(df: DataFrame, path: str) -> None:
    """canonical() as text files; the job commits them together or not at all."""
    canonical(df).write.mode("errorifexists").text(path)


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of records and a hash that doesn't depend on their
    order: the sum of 64-bit prefixes of each record's SHA-256."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.sum(digest).cast("string").alias("digest"))


def verify(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Keys whose records and `expected` manifest differ, from either side."""
    a, b = manifest(df, keys), expected.withColumnsRenamed({"records": "expected_records", "digest": "expected_digest"})
    return a.join(b, keys, "full_outer").where(~F.col("digest").eqNullSafe(F.col("expected_digest")))


class TornPublish(ValueError):
    """What was published isn't there in whole."""


#: The sidecar's folder within a published one; Spark reads no names that begin so.
SIDECAR = "_sidecar"


def _digest(df: DataFrame) -> dict[str, str]:
    """Number, hash and schema of the records of a table."""
    r = manifest(df, []).first()
    return {"records": str(r["records"]), "digest": r["digest"] or "0", "schema": df.schema.json()}


def publish(df: DataFrame, path: str, upstream: dict[str, str] | None = None) -> dict[str, str]:
    """Writes a table so that it appears at once and in whole, or not at all:
    files go to a folder beside `path`, are read back, and described by a sidecar
    (number, hash and schema of the records, and the digests of what they were
    made from); then one rename publishes both. A path that exists is refused."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    told = _digest(spark.read.parquet(staged)) | {f"upstream.{k}": v for k, v in (upstream or {}).items()}
    spark.createDataFrame(sorted(told.items()), "name string, value string").coalesce(1).write.json(f"{staged}/{SIDECAR}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), to):
        raise TornPublish(f"{path}: the rename failed")
    return told


def sidecar(spark: SparkSession, path: str) -> dict[str, str]:
    """The sidecar of a published table."""
    try:
        rows = spark.read.schema("name string, value string").json(f"{path}/{SIDECAR}").collect()
    except AnalysisException as e:
        raise TornPublish(f"{path}: no sidecar") from e
    return {r["name"]: r["value"] for r in rows}


def read_published(spark: SparkSession, path: str, upstream: dict[str, str] | None = None) -> DataFrame:
    """A published table, after its records were counted and hashed anew; refused
    where they, its schema, or the digests of what it was made from aren't those
    of the sidecar."""
    told, df = sidecar(spark, path), spark.read.parquet(path)
    want = _digest(df) | {f"upstream.{k}": v for k, v in (upstream or {}).items()}
    unlike = sorted(k for k, v in want.items() if told.get(k) != v)
    if unlike:
        raise TornPublish(f"{path}: {', '.join(unlike)} differ from the sidecar")
    return df


#: Columns of the fingerprint matcher's separated output (fixed values).
MATCH_COLUMNS = ["index", "total", "query_path", "query_start_s", "query_stop_s", "match_path", "match_id", "match_start_s", "match_stop_s", "match_score", "time_factor_pct", "frequency_factor_pct", "seconds_with_match_pct"]


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The matcher's `;`-separated file with a header, times in milliseconds."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in MATCH_COLUMNS)).option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    ms = {c.removesuffix("_s") + "_ms": F.round(F.col(c).try_cast("double") * 1000).cast("long") for c in MATCH_COLUMNS if c.endswith("_s")}
    return raw.withColumns({"match_score": F.col("match_score").try_cast("long"), **ms})
