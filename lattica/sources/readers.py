"""Sources of tables: connections of datasources, files, rows, and files of office formats.

Everything Spark can read is read by Spark, lazily. Workbooks, HTML tables and SQLite files have no
reader in Spark; they are small by nature and are parsed on the driver.
"""

from __future__ import annotations

import html.parser
import os
import re
import sqlite3
import time
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.errors import ConfigError
from lattica.functions import types

Tables = dict[str, Callable[[], DataFrame]]


# Connections


class Connection:
    """A datasource's tables by name."""

    def __init__(self, load: Callable[[str], DataFrame], names: Callable[[], list[str]]):
        self.load, self.names = load, names


def _in_folder(spark: SparkSession, folder: str, kind: str, options: dict) -> Connection:
    def load(name: str) -> DataFrame:
        bare = name.rpartition(".")[2]
        return spark.read.format(kind).options(**options).load(f"{folder}/{bare}.{kind}" if "{table}" not in folder else folder.replace("{table}", bare))

    def names() -> list[str]:
        path = Path(folder.removeprefix("file://"))
        return sorted(p.stem for p in path.glob(f"*.{kind}")) if path.is_dir() else []

    return Connection(load, names)


def connect(spark: SparkSession, name: str, spec: str | dict, contexts: dict | None = None) -> Connection:
    """The connection that a datasource's ``connect`` describes.

    "parquet:/folder" (also csv, json, orc): a file or folder named after each table; "jdbc:…"; "sqlite:///file";
    "catalog:database"; {"format", "path", "options"}; or {"func", "params"}: a function of (spark, name, **params) that returns
    {table: DataFrame}. {name} in a text stands for the datasource's context.
    """
    if isinstance(spec, str):
        spec = re.sub(r"\{(\w+)\}", lambda m: str((contexts or {}).get(name, {}).get(m[1], m[0])), spec)
        kind, _, rest = spec.partition(":")
        if kind == "jdbc":
            return jdbc(spark, {"url": spec})
        if kind == "sqlite":
            return sqlite_file(spark, rest.removeprefix("///"))
        if kind == "catalog":
            return Connection(lambda t: spark.table(f"{rest}.{t.rpartition('.')[2]}"), lambda: [t.name for t in spark.catalog.listTables(rest)])
        if kind in ("parquet", "csv", "json", "orc"):
            return _in_folder(spark, rest, kind, {"header": True, "inferSchema": True} if kind == "csv" else {})
        raise ConfigError(f"datasource {name}: can't connect to {spec!r}")
    if "func" in spec:
        from lattica.config import imported

        found = (imported(spec["func"]) if isinstance(spec["func"], str) else spec["func"])(spark, name, **(spec.get("params") or {}))
        return found if isinstance(found, Connection) else Connection(lambda t: found[t] if t in found else found[t.rpartition(".")[2]], lambda: list(found))
    if spec.get("format") == "jdbc":
        return jdbc(spark, spec.get("options") or {})
    return _in_folder(spark, spec["path"], spec.get("format", "parquet"), spec.get("options") or {})


def jdbc(spark: SparkSession, options: dict) -> Connection:
    return Connection(lambda t: spark.read.format("jdbc").options(**options | {"dbtable": t}).load(), lambda: [])


def url_connect(spark: SparkSession, name: str, connect_url: str | None = None, data_url: str | None = None, if_exists: str = "replace", replace_after: str | None = None, folder: str | None = None) -> Connection:
    """A connection by URL, or to a database file that is fetched first."""
    if bool(connect_url) == bool(data_url):
        raise ConfigError("either connect_url or data_url is needed")
    if connect_url:
        return connect(spark, name, connect_url)
    return sqlite_file(spark, fetched(data_url, folder or "lattica-adhoc", if_exists, replace_after))


def parse_age(text: str) -> float:
    """Seconds in "10 minutes", "2 days" and the like."""
    m = re.match(r"^\s*(\d+)\s*(second|minute|hour|day|week)s?\s*$", text)
    if not m:
        raise ConfigError(f"invalid age {text!r}")
    return int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[m[2]]


def fetched(url: str, folder: str, if_exists: str = "replace", replace_after: str | None = None) -> str:
    """The local path of a file; remote ones are fetched, by age if if_exists is replace_after."""
    if "://" not in url or url.startswith("file://"):
        return url.removeprefix("file://")
    path = Path(folder) / re.sub(r"\W+", "_", url)
    if path.exists():
        if if_exists == "fail":
            raise ValueError(f"{path} exists")
        if if_exists == "ignore" or if_exists == "replace_after" and time.time() - path.stat().st_mtime < parse_age(replace_after or "0 seconds"):
            return str(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    with urllib.request.urlopen(url, timeout=60) as f, part.open("wb") as out:
        while piece := f.read(1 << 20):
            out.write(piece)
    os.replace(part, path)
    return str(path)


def sqlite_file(spark: SparkSession, path: str) -> Connection:
    """Tables and views of an SQLite file, read on the driver."""

    def rows(sql: str) -> tuple[list[str], list[tuple]]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            cur = con.execute(sql)
            return [c[0] for c in cur.description], cur.fetchall()

    def load(name: str) -> DataFrame:
        bare = name.rpartition(".")[2].replace('"', "")
        names, data = rows(f'SELECT * FROM "{bare}"')
        declared = {r[1]: (r[2] or "text") for r in rows(f'PRAGMA table_info("{bare}")')[1]}
        kinds = [types.NAMES.get(re.sub(r"\W.*", "", declared.get(n, "text")).lower(), types.NAMES["text"]).simpleString() for n in names]
        text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in data], ", ".join(f"`{n}` string" for n in names))
        return text.select(*[F.col(f"`{n}`").try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])

    return Connection(load, lambda: [r[0] for r in rows("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY 1")[1]])


# Files


class _TableParser(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None


def _frame(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A frame from a header and rows of texts; columns of numbers become numbers."""
    if not rows:
        raise ValueError("no header")
    names, data = [str(x) for x in rows[0]], [[*r, *[None] * len(rows[0])][: len(rows[0])] for r in rows[1:]]
    text = spark.createDataFrame([tuple(None if v in (None, "") else str(v) for v in r) for r in data], ", ".join(f"`{n}` string" for n in names))
    out = []
    for i, n in enumerate(names):
        values = [str(r[i]) for r in data if r[i] not in (None, "")]
        kind = "bigint" if values and all(re.match(r"^-?(0|[1-9]\d{0,17})$", v) for v in values) else "double" if values and all(re.match(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", v) and not re.match(r"^-?0\d", v) for v in values) else "string"
        out.append(F.col(f"`{n}`").cast(kind).alias(n))
    return text.select(*out)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """The only table of an HTML file."""
    p = _TableParser()
    p.feed(Path(path).read_text())
    if len(p.tables) != 1:
        raise ValueError(f"{path} has {len(p.tables)} tables, not 1")
    return _frame(spark, [r for r in p.tables[0] if r])


def read_excel(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A sheet of an xlsx workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for r in root.iter(f"{{{ns['m']}}}row"):
        row: list = []
        for c in r.findall("m:c", ns):
            letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            row += [None] * (max(at, len(row) + 1) - 1 - len(row))
            v = c.find("m:v", ns)
            if c.get("t") == "s":
                row.append(strings[int(v.text)])
            elif c.get("t") == "inlineStr":
                row.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
            else:
                row.append(None if v is None else re.sub(r"\.0$", "", v.text))
        rows.append(row)
    return _frame(spark, rows)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file: an array of records, or an object whose ``data`` is one."""
    df = spark.read.option("multiLine", True).json(path)
    if "data" in df.columns and df.schema["data"].dataType.typeName() == "array":
        df = df.select(F.explode("data").alias("r")).select("r.*")
    return df


def sheet_csv_url(url: str) -> str:
    """The CSV address of a shared spreadsheet."""
    return url if "format=csv" in url else re.sub(r"/edit.*$", "/export?format=csv", url)


def read_file(spark: SparkSession, url: str, folder: str = "lattica-adhoc", if_exists: str = "replace", **options) -> DataFrame:
    """A table from a file, by the suffix of its name."""
    if "docs.google.com" in url:
        return read_file_csv(spark, fetched(sheet_csv_url(url), folder, if_exists), options)
    suffix = url.split("?")[0].rpartition(".")[2].lower()
    if suffix in ("parquet", "orc"):
        return spark.read.format(suffix).load(url)
    local = fetched(url, folder, if_exists)
    if suffix == "csv":
        return read_file_csv(spark, local, options)
    readers = {"xlsx": read_excel, "xls": read_excel, "json": read_json_table, "html": read_html}
    if suffix not in readers:
        raise AssertionError(f"no reader for {url!r}")
    return readers[suffix](spark, local)


def read_file_csv(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    return spark.read.options(**{"header": True, "inferSchema": True} | (options or {})).csv(path)


# Ad hoc tables


def adhoc_frame(
    spark: SparkSession,
    data: DataFrame | Iterable,
    columns: list[str] | None = None,
    primary_key: list[str] | None = None,
    convert_types: dict[str, str] | None = None,
    drop_dupes: bool = False,
    fillna_value: object = None,
    schema: str | None = None,
) -> DataFrame:
    """A frame from rows, a pandas frame or a Spark frame: nulls in the key filled, types converted, the first row of each key kept."""
    if isinstance(data, DataFrame):
        df = data
    elif hasattr(data, "columns") and hasattr(data, "iloc"):
        df = spark.createDataFrame(data, schema)
    else:
        rows = list(data)
        if rows and isinstance(rows[0], dict):
            names = columns or list(dict.fromkeys(k for r in rows for k in r))
            rows = [tuple(r.get(n) for n in names) for r in rows]
            df = spark.createDataFrame(rows, schema or names)
        else:
            df = spark.createDataFrame(rows, schema or columns)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    keys = [k for k in primary_key or [] if k in df.columns]
    for name, kind in (convert_types or {}).items():
        df = df.withColumn(name, F.col(f"`{name}`").try_cast(types.spark_type(kind)))
    if fillna_value is not None and keys:
        df = df.fillna(fillna_value, subset=keys)
    if drop_dupes and keys:
        at = "row_at"
        while at in df.columns:
            at += "_"
        first = Window.partitionBy(*keys).orderBy(at)
        df = df.withColumn(at, F.monotonically_increasing_id()).withColumn(f"{at}_n", F.row_number().over(first)).where(F.col(f"{at}_n") == 1).drop(at, f"{at}_n")
    return df


def save_table(df: DataFrame, name: str, if_exists: str = "fail") -> None:
    """df as a table of the catalog; if_exists is fail, ignore or replace."""
    modes = {"fail": "error", "ignore": "ignore", "replace": "overwrite"}
    if if_exists not in modes:
        raise ConfigError(f"if_exists is one of {sorted(modes)}")
    if if_exists == "fail" and df.sparkSession.catalog.tableExists(name):
        raise ValueError(f"table {name} exists")
    df.write.mode(modes[if_exists]).saveAsTable(name)
