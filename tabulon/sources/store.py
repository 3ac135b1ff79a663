"""Reading and writing tables by file extension, on any file system that Spark reaches."""

from __future__ import annotations

import io
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

READS = ("csv", "json", "parquet", "xlsx", "xls", "geojson")
WRITES = ("csv", "json", "parquet", "xlsx", "xls", "geojson")
SHEET_NAME = 31  # characters that a sheet's name may have
SHEET_ROWS = 1_048_575  # rows that a sheet can hold under its header
PACKAGES = ("boto3", "s3fs")


def extension(path: str, known: tuple[str, ...]) -> str:
    """The text after the last dot; one that isn't known raises ValueError. Pickles are refused, as reading one runs code."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in known:
        raise ValueError(f"the extension must be one of {list(known)}, not {ext!r}")
    return ext


def s3_options(package: str = "boto3", endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None, token: str | None = None, verify: bool | str = True) -> dict[str, str]:
    """Spark settings for an object store, from arguments or AWS_S3_ENDPOINT, AWS_ACCESS_KEY_ID, AWS_SECRET_ACCESS_KEY and AWS_SESSION_TOKEN.
    Certificates are always checked: the store's client has no switch for that, so verify=False only warns. Put a private authority into a trust store and
    name its file as verify; that sets options of the JVMs, which must be there before the session starts."""
    if package not in PACKAGES:
        raise ValueError(f"package must be one of {list(PACKAGES)}")
    told = {
        "endpoint": endpoint or os.environ.get("AWS_S3_ENDPOINT"),
        "access.key": access_key or os.environ.get("AWS_ACCESS_KEY_ID"),
        "secret.key": secret_key or os.environ.get("AWS_SECRET_ACCESS_KEY"),
        "session.token": token or os.environ.get("AWS_SESSION_TOKEN"),
    }
    out = {f"spark.hadoop.fs.s3a.{k}": v for k, v in told.items() if v}
    if out.get("spark.hadoop.fs.s3a.session.token"):
        out["spark.hadoop.fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    if told["endpoint"]:
        out["spark.hadoop.fs.s3a.path.style.access"] = "true"
    out["spark.hadoop.fs.s3a.connection.ssl.enabled"] = "true" if not (told["endpoint"] or "").startswith("http://") else "false"
    if isinstance(verify, str):
        out |= {f"spark.{who}.extraJavaOptions": f"-Djavax.net.ssl.trustStore={verify}" for who in ("driver", "executor")}
    elif not verify:
        logging.getLogger(__name__).warning("certificates are checked all the same; name a trust store as verify")
    return out


class _Store:
    def __init__(self, package: str = "boto3"):
        if package not in PACKAGES:
            raise ValueError(f"package must be one of {list(PACKAGES)}")
        self.package, self.connected = package, False

    def connect(self, spark: SparkSession, **kwargs):
        """Put the settings of the store into the running session."""
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in s3_options(self.package, **kwargs).items():
            if k.startswith("spark.hadoop."):
                conf.set(k.removeprefix("spark.hadoop."), v)
        self.connected = True
        return self


class S3Loader(_Store):
    def load(self, spark: SparkSession, bucket: str, key: str, **options) -> DataFrame:
        if not self.connected:
            self.connect(spark)
        return load(spark, f"s3a://{bucket}/{key}", **options)


class S3Saver(_Store):
    def save(self, bucket: str, key: str, obj, **options) -> None:
        if not self.connected:
            self.connect(next(iter(obj.values())).sparkSession if isinstance(obj, dict) else obj.sparkSession)
        save(obj, f"s3a://{bucket}/{key}", **options)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table from csv, json (a record a line, or whole files), parquet, geojson (a row per feature: geometry and properties as JSON text) or a spreadsheet."""
    ext = extension(path, READS)
    if ext == "parquet":
        return spark.read.options(**options).parquet(path)
    if ext == "csv":
        return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)
    if ext == "json":
        return spark.read.options(**({"multiLine": not _by_lines(spark, path)} | options)).json(path)
    if ext == "geojson":
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<features: array<string>>")["features"]).alias("feature"))
        part = F.from_json("feature", "struct<geometry: string, properties: string>")
        return whole.select(part["geometry"].alias("geometry"), part["properties"].alias("properties"))
    import pandas as pd  # a spreadsheet fits on one machine

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return spark.createDataFrame(pd.read_excel(io.BytesIO(content), engine="openpyxl" if ext == "xlsx" else "xlrd", **options))


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line with text is JSON by itself, as where each line is a record; else a whole file is one."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    if first is None:
        return True
    try:
        json.loads(first[0])
    except ValueError:
        return False
    return True


def save(obj: DataFrame | dict[str, DataFrame], path: str, mode: str = "overwrite", **options) -> None:
    """A table (for spreadsheets also a dict of tables, one a sheet) to csv, json, parquet, geojson or a spreadsheet."""
    ext = extension(path, WRITES)
    if isinstance(obj, dict) and ext not in ("xlsx", "xls"):
        raise ValueError("only spreadsheets take several tables")
    if ext == "parquet":
        obj.write.mode(mode).options(**options).parquet(path)
    elif ext == "csv":
        obj.write.mode(mode).options(**({"header": True} | options)).csv(path)
    elif ext == "json":
        obj.write.mode(mode).options(**options).json(path)
    elif ext == "geojson":
        feature = F.concat(F.lit('{"type": "Feature", "geometry": '), F.coalesce(col("geometry"), F.lit("null")), F.lit(', "properties": '), F.coalesce(col("properties"), F.lit("{}")), F.lit("}"))
        obj.select(feature).coalesce(1).write.mode(mode).text(path)
    else:
        import pandas as pd

        sheets = obj if isinstance(obj, dict) else {"Sheet1": obj}
        made = io.BytesIO()
        with pd.ExcelWriter(made, engine="openpyxl") as writer:
            for name, df in sheets.items():
                rows = df.limit(SHEET_ROWS + 1).toPandas()
                if len(rows) > SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows, and {name} has more")
                rows.to_excel(writer, sheet_name=name[:SHEET_NAME], **options)
        write_bytes(next(iter(sheets.values())).sparkSession, path, made.getvalue())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, on any file system that Spark reaches; what was there is replaced."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def save_json(obj, path: str) -> None:
    """A plain object as JSON text (not a table)."""
    with open(path, "w") as f:
        json.dump(obj, f)


def init_logger(filename: str) -> logging.Logger:
    """The root logger at INFO, to the console and a file, whose folder is made."""
    os.makedirs(os.path.dirname(os.path.abspath(filename)), exist_ok=True)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s - %(levelname)s - %(message)s", handlers=[logging.StreamHandler(), logging.FileHandler(filename)], force=True)
    return logging.getLogger()
