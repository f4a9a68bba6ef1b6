"""Reading and writing tables: CSV, JSON, Parquet, Excel and databases."""

from __future__ import annotations

import io
import json
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVERS = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{db}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{db}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={db}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
}
LISTING = {
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = 'public'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = DATABASE()",
    "sqlserver": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
}


def distinct_names(names: list[str]) -> list[str]:
    """Names with repeated ones numbered: a, a.1, a.2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(n if n not in seen else f"{n}.{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")
#: Suffixes of files that can be loaded.
UPLOADS = {"csv", "json", "parquet", "xls", "xlsx"}


#: The signs of windows-1252 where Latin-1 has control characters, and what those are in Latin-1.
_PAIRS = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_WINDOWS = tuple("".join(x) for x in zip(*[p for p in _PAIRS if p[1]], strict=True))


def csv_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding without undecodable bytes: UTF-8, else windows-1252 if its own signs (0x80 to 0x9F) occur, else Latin-1.

    All lines are looked at, by the executors; the driver gets two flags.
    """
    lines = spark.read.text(path)  # the bytes as they are
    broken = lines.where(~F.is_valid_utf8("value"))
    if not broken.limit(1).count():
        return ENCODINGS[0]
    own_signs = F.hex(F.col("value").cast("binary")).rlike("^(?:..)*[89].")
    return ENCODINGS[2] if broken.where(own_signs).limit(1).count() else ENCODINGS[1]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = False, delimiter: str | None = None) -> DataFrame:
    """All columns as strings under distinct names, RFC quoting; rows that don't fit the header are dropped, and so are empty ones.

    Strategies in order: the given encoding, or the first that fits; then, where
    a comma leaves one column, semicolon, tab and bar as delimiters.
    ``multi_line`` allows line breaks in quotes; such files can't be split
    among tasks, so it is off unless asked for.
    """
    encoding = encoding or csv_encoding(spark, path)
    windows = encoding.lower() in ("windows-1252", "cp1252")
    if windows:  # Spark reads Latin-1; the signs that differ are put right below
        encoding = "ISO-8859-1"
    options = {"header": True, "encoding": encoding, "mode": "DROPMALFORMED", "quote": '"', "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    for sep in [delimiter] if delimiter else [",", ";", "\t", "|"]:
        df = spark.read.options(**options).option("sep", sep).csv(path)
        if len(df.columns) > 1:
            break
    else:
        df = spark.read.options(**options).csv(path)
    header = spark.read.options(**options | {"header": False}).option("sep", sep).csv(path).schema if df.columns else None
    names = _header_names(spark, path, options, sep) if header is not None and len(header) == len(df.columns) else df.columns
    if windows:
        names = [n.encode("latin-1").decode("cp1252", "replace") for n in names]
        df = df.select(*[F.translate(F.col(f"`{c}`"), *_WINDOWS).alias(c) for c in df.columns])
    return df.na.drop("all").toDF(*distinct_names(names))


def _header_names(spark: SparkSession, path: str, options: dict, sep: str) -> list[str]:
    """The first line's names as they are written (Spark renames repeated ones)."""
    first = spark.read.options(**options | {"header": False, "mode": "PERMISSIVE"}).option("sep", sep).csv(path).first()
    return [x if x is not None and x.strip() else f"Unnamed: {i}" for i, x in enumerate(first or [])]


def read_table(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """Reader by extension: csv, json (a record a line, or one document with ``multi_line``), parquet, xls or xlsx."""
    kind = suffix(path)
    if kind == "csv":
        return read_csv(spark, path, encoding, multi_line)
    if kind == "json":
        return spark.read.json(path, multiLine=multi_line)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in {"xls", "xlsx"}:
        return read_excel(spark, path)
    raise ValueError(f"no reader for .{kind}")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of Excel files as strings; each file is read in the task that gets it, and all must have the first one's columns."""
    import pandas as pd

    def parsed(content: bytes) -> pd.DataFrame:
        try:
            return pd.read_excel(io.BytesIO(content), dtype=str)
        except ImportError as e:
            raise RuntimeError("Excel files need the package openpyxl or xlrd") from e

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise ValueError(f"no file at {path}")
    names = [str(c) for c in parsed(first[0]["content"]).columns]

    def sheets(batches):
        for batch in batches:
            for content in batch["content"]:
                yield parsed(content).set_axis(names, axis=1)

    return files.mapInPandas(sheets, ", ".join(f"`{n}` string" for n in names))


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def is_upload(name: str) -> bool:
    """Whether a file's name has a suffix that can be loaded, and no folder in it."""
    return "." in name and "/" not in name and "\\" not in name and suffix(name) in UPLOADS


def inside(folder: str, name: str) -> str:
    """The path of ``name`` in a folder; names that lead out of it are refused."""
    if name.startswith("/") or ":" in name or ".." in re.split(r"[\\/]", name):
        raise ValueError(f"{name!r} leads out of {folder}")
    return f"{folder.rstrip('/')}/{name}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, folder: str, name: str) -> bool:
    """Delete a file or folder within ``folder``, on any file system that Spark knows; whether it was there."""
    files, target = _file_system(spark, inside(folder, name))
    return files.delete(target, True)


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, such as sessions."""
    files, target = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()) if files.exists(target) else []


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON document, such as a plan or a dashboard."""
    spark.createDataFrame([(json.dumps(document, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def patch_document(spark: SparkSession, path: str, changes: dict) -> dict:
    """The document with its keys changed, written and given back; keys set to none are removed."""
    document = {k: v for k, v in {**read_document(spark, path), **changes}.items() if v is not None}
    write_document(spark, path, document)
    return document


def template(spark: SparkSession, features: list[str], rows: int = 0) -> DataFrame:
    """An empty table of string columns to be filled in for a batch prediction."""
    return spark.createDataFrame([("",) * len(features)] * rows, ", ".join(f"`{f}` string" for f in features))


def with_row_id(df: DataFrame, name: str = "__row_id") -> DataFrame:
    """A number in the order of the files' rows (increasing, with gaps): no shuffle, no single task."""
    return df.withColumn(name, F.monotonically_increasing_id())


def database_options(kind: str, host: str, db: str, user: str, password: str, port: int | None = None) -> dict[str, str]:
    url, driver, default = DRIVERS[kind]
    return {"url": url.format(host=host, port=port or default, db=db), "driver": driver, "user": user, "password": password, "loginTimeout": "10"}


def list_tables(spark: SparkSession, kind: str, options: dict[str, str]) -> list[str]:
    rows = spark.read.format("jdbc").options(**options).option("query", LISTING[kind]).load().collect()
    return sorted(r[0] for r in rows)


def read_database(
    spark: SparkSession, options: dict[str, str], table: str, known: list[str], partition: tuple[str, int, int, int] | None = None
) -> DataFrame:
    """One listed table with its types; ``partition`` is (column, lowest, highest, parts) for parallel reading.

    Names that aren't listed are refused.
    """
    if table not in known or not re.fullmatch(r"[\w.$ -]+", table):
        raise ValueError(f"unknown table {table!r}")
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def whole_floats_to_long(df: DataFrame) -> DataFrame:
    """Complete double columns of whole numbers as long; one aggregate tests them all."""
    doubles = [c for c, t in df.dtypes if t in {"double", "float"}]
    if not doubles:
        return df
    test = df.agg(*[F.bool_and(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") % 1 == 0)).alias(f"t{i}") for i, c in enumerate(doubles)]).first()
    whole = {c: F.col(f"`{c}`").cast("long") for i, c in enumerate(doubles) if test[f"t{i}"]}
    return df.withColumns(whole) if whole else df


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size and time of files under a folder, of any file system that Spark knows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")


def preview(df: DataFrame, order: str | None = None, n: int = 500) -> DataFrame:
    """The first rows as strings, nulls empty."""
    first = (df.orderBy(order) if order else df).limit(n)
    return first.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def sessions(spark: SparkSession, folder: str) -> list[dict]:
    """The sessions in a folder, newest first: session_id, datetime (told from names such as 20240131094500, else the name) and input_files."""

    def label(name: str) -> str:
        try:
            return datetime.strptime(name, "%Y%m%d%H%M%S").strftime("%B %d, %Y  %H:%M:%S")
        except ValueError:
            return name

    def files(name: str) -> list[str]:
        system, target = _file_system(spark, inside(folder, name))
        return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isFile())

    return [{"session_id": s, "datetime": label(s), "input_files": files(s)} for s in sorted(list_folders(spark, folder), reverse=True)]
