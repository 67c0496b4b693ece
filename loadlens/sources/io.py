"""Reading and writing tables with explicit schemas, and manifests of what was written.

Data stays in Spark's readers and writers, so any store that Spark knows works; only small JSON documents pass through the driver.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def read_csv(spark: SparkSession, path: str, schema: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, read by the schema's order; a byte-order mark before the first name is no part of it. aliases rename columns."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.withColumnsRenamed(aliases) if aliases else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file only for report tables of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def json_safe(x):
    """Numbers that aren't finite become null, keys strings."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x.item() if hasattr(x, "item") else x


def dumps(x) -> str:
    return json.dumps(json_safe(x), sort_keys=True, ensure_ascii=False, allow_nan=False)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """To a temporary name beside the path, then renamed over it in one step, so that readers see the old file or the new one."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = next(x for x in kind.getEnumConstants() if x.name() == "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, over)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def write_json(spark: SparkSession, path: str, x) -> None:
    write_text(spark, path, dumps(x))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs in one process, one in the warehouse.

    On a cluster the warehouse may lie in a folder of the driver's machine, which no other sees, so there the setting must be given.
    """
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; master is {master!r}")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/loadlens-intermediate"


#: Paths written by materialize() in the blocks of intermediates() that are open, the innermost last.
_open: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession):
    """What materialize() writes within the block is deleted when it ends, so the block's result must be written by then.

    Gives the list of the paths; what is taken off it stays.
    """
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for path in _open.pop():
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again, so that lost executors cost no more than their tasks.

    The table stays until the enclosing intermediates() ends, if there is one; a lasting one stays in any case.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open and not lasting:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("d")).first()
    return {"rows": r["n"], "digest": r["d"], "schema": df.schema.simpleString()}


def write_snapshot(tables: dict[str, DataFrame], path: str) -> dict:
    """Each table as Parquet, and a manifest with schemas, row counts and digests of what is read back."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest[name] = digest(spark.read.schema(df.schema).parquet(f"{path}/{name}"))
    manifest = {"tables": manifest}
    manifest["sha256"] = hashlib.sha256(dumps(manifest["tables"]).encode()).hexdigest()
    write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables, after their digests are found to be the manifest's."""
    manifest = read_json(spark, f"{path}/manifest.json")
    if hashlib.sha256(dumps(manifest["tables"]).encode()).hexdigest() != manifest["sha256"]:
        raise ValueError("the manifest was changed")
    out = {}
    for name, want in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if digest(df) != want:
            raise ValueError(f"table {name} isn't what was written")
        out[name] = df
    return out


def rows_to_frame(spark: SparkSession, rows: list[dict], schema: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A request's rows as a table; names that the schema lacks are refused."""
    names = {aliases.get(k, k) if aliases else k for r in rows for k in r}
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)
    if extra := names - set(want.names):
        raise ValueError(f"unknown columns: {sorted(extra)}")
    return spark.createDataFrame([tuple({(aliases or {}).get(k, k): v for k, v in r.items()}.get(c) for c in want.names) for r in rows], want)


def holidays(spark: SparkSession, path: str | None = None, days: list[str] | None = None) -> DataFrame:
    """day: from a JSON document {"holidays": [...]} or a list."""
    listed = read_json(spark, path)["holidays"] if path else days or []
    return spark.createDataFrame([(d,) for d in listed], "d string").select(F.to_date("d").alias("day")).distinct()
