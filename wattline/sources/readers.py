"""Scans and sinks: file layouts, column aliases, encodings, dated files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import shared_folder

# Output columns and source-name aliases of the load, temperature,
# heat-index and holiday files.
LOAD_COLUMNS = ["timestamp", "cod_area", "carga_mwh"]
TEMPERATURE_COLUMNS = ["timestamp", "cod_area", "temp_celsius", "source"]
HEAT_COLUMNS = ["timestamp", "cod_area", "heat_index"]
HOLIDAY_COLUMNS = ["date", "holiday_name", "holiday_type", "id_tipodiaespecial"]
TIME_ALIASES = {
    "timestamp": ["data_hora", "datahora", "dt_timestamp"],
    "cod_area": ["area", "codigo_area"],
}
LOAD_ALIASES = {**TIME_ALIASES, "carga_mwh": ["carga", "val_cargaglobalcons", "valor", "load"]}
TEMPERATURE_ALIASES = {**TIME_ALIASES, "temp_celsius": ["temperatura", "temperatura_celsius", "temp"]}
HEAT_ALIASES = {**TIME_ALIASES, "heat_index": ["indice_calor", "hi"]}
HOLIDAY_ALIASES = {
    "date": ["data", "dt_feriado", "data_feriado"],
    "holiday_name": ["nome", "nome_feriado", "descricao"],
    "holiday_type": ["tipo", "tipo_feriado"],
    "id_tipodiaespecial": ["id_tipo", "tipo_dia_especial"],
}
CSV_ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "cp1252"]


def standardize(df: DataFrame, alias_map: Mapping[str, Sequence[str]], out_cols: Sequence[str]) -> DataFrame:
    """Rename by the first alias present; output columns without a source are left out."""
    picked = []
    for name in out_cols:
        source = next((c for c in [name, *alias_map.get(name, [])] if c in df.columns), None)
        if source:
            picked.append(F.col(source).alias(name))
    return df.select(*picked)


def _day(start: date | str) -> str:
    return str(start)


def _named_files(spark: SparkSession, root: str, prefix: str, areas: Sequence[str], start, end) -> DataFrame:
    """Files ``{prefix}_{area}_{yyyymmdd}.parquet`` below ``root``; others are not opened."""
    name = F.col("_metadata.file_name")
    pattern = rf"^{prefix}_(.+)_(\d{{8}})\.parquet$"
    day = F.regexp_extract(name, pattern, 2)
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}_*.parquet")
        .option("mergeSchema", "true").parquet(root)
    )
    lo, hi = _day(start).replace("-", ""), _day(end).replace("-", "")
    return raw.where(F.regexp_extract(name, pattern, 1).isin(list(areas)) & day.between(lo, hi))


def _partitioned(spark: SparkSession, root: str, areas: Sequence[str], start, end, t: str) -> DataFrame:
    """Layout ``year=/month=/area=``: partition filters first, then the exact time range."""
    lo, hi = _day(start), _day(end)
    ym = F.col("year") * 100 + F.col("month")
    return spark.read.parquet(root).where(
        F.col("area").isin(list(areas))
        & ym.between(int(lo[:4]) * 100 + int(lo[5:7]), int(hi[:4]) * 100 + int(hi[5:7]))
        & F.to_date(t).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    )


def scan_load(spark, root, areas, start, end, layout: str = "partitioned", t: str = "ts") -> DataFrame:
    if layout == "partitioned":
        return _partitioned(spark, root, areas, start, end, t)
    return standardize(_named_files(spark, root, "carga", areas, start, end), LOAD_ALIASES, LOAD_COLUMNS)


def scan_temperature(spark, root, areas, start, end, horizon: int, layout: str = "partitioned", t: str = "ts") -> DataFrame:
    if horizon not in (1, 2):
        raise ValueError(f"horizon must be 1 or 2, got {horizon}")
    if layout == "partitioned":
        df = _partitioned(spark, root, areas, start, end, t)
    else:
        df = standardize(
            _named_files(spark, root, f"temperatura_d{horizon}", areas, start, end),
            TEMPERATURE_ALIASES, TEMPERATURE_COLUMNS[:3],
        )
    return df.withColumn("source", F.lit(f"D+{horizon}"))


def _area_files(spark, root: str, areas: Sequence[str], fmt: str, aliases, columns) -> DataFrame:
    reader = spark.read.option("header", "true").option("inferSchema", "true") if fmt == "csv" else spark.read
    df = reader.format(fmt).load(root).withColumn("__file", F.col("_metadata.file_name"))
    area_of_file = F.regexp_extract("__file", r"([^_.]+)\.[A-Za-z]+$", 1)
    out = standardize(df, aliases, [*columns, "__file"])
    if "cod_area" not in out.columns:
        out = out.withColumn("cod_area", area_of_file)
    return out.where(F.col("cod_area").isin(list(areas))).select(*[c for c in columns if c in out.columns])


def scan_heat_index(spark, root, areas, fmt: str = "parquet") -> DataFrame:
    return _area_files(spark, root, areas, fmt, HEAT_ALIASES, HEAT_COLUMNS)


def scan_ecmwf(spark, root, areas, fmt: str = "parquet") -> DataFrame:
    df = _area_files(spark, root, areas, fmt, TEMPERATURE_ALIASES, TEMPERATURE_COLUMNS[:3])
    return df.withColumn("source", F.lit("ECMWF"))


def scan_holidays(spark, root, years: Sequence[int]) -> DataFrame:
    df = standardize(spark.read.parquet(root), HOLIDAY_ALIASES, HOLIDAY_COLUMNS)
    return df.where(F.year("date").isin(list(years)))


def csv_encoding(spark, path: str) -> str:
    """utf-8 if every line of the files is valid, else latin-1, in which every byte is a character."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "utf-8" if bad.isEmpty() else "latin-1"


def scan_any(spark, path: str, fmt: str | None = None, encoding: str | None = None) -> DataFrame:
    """Format by extension; without an encoding a CSV file is read once more to find it."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        encoding = encoding or csv_encoding(spark, path)
        if encoding.lower() not in CSV_ENCODINGS:
            raise ValueError(f"encoding {encoding!r} not in {CSV_ENCODINGS}")
        names = {"latin-1": "ISO-8859-1", "cp1252": "windows-1252"}
        return (
            spark.read.option("header", "true").option("inferSchema", "true")
            .option("encoding", names.get(encoding.lower(), encoding)).csv(path)
        )
    raise ValueError(f"unsupported format {fmt!r}")


def read_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    if partition_by:
        df = df.hint("rebalance", *partition_by)  # parts of the advisory size, at any size of a partition value
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_forecasts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode).format(fmt)
    (w.option("header", "true") if fmt == "csv" else w).save(path)


def file_date(name: Column) -> Column:
    """Date in a file name: yyyy-mm-dd, yyyy_mm_dd or yyyymmdd."""
    d = F.regexp_extract(name, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", 0)
    return F.try_to_timestamp(F.regexp_replace(d, "[-_]", ""), F.lit("yyyyMMdd")).cast("date")


def scan_dated_files(spark, root: str, start, end, fmt: str = "parquet") -> DataFrame:
    """Files, or folders that Spark wrote, below ``root`` whose name carries a date from ``start``
    to ``end``; others are not opened. Folders without a date in their name are looked into. Adds ``file_date``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    lo, hi = (date.fromisoformat(str(d)[:10]) for d in (start, end))
    paths, todo = [], [target]
    while todo:
        for x in fs.listStatus(todo.pop()):
            m = re.search(r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", x.getPath().getName())
            try:
                if m and lo <= date(*map(int, m.groups())) <= hi:
                    paths.append(x.getPath().toString())
            except ValueError:  # digits that are no date
                m = None
            if not m and x.isDirectory():
                todo.append(x.getPath())
    if not paths:
        raise ValueError(f"no file of {lo} to {hi} in {root}")
    # the first dated part of the path below the root
    below = F.substring_index(F.col("_metadata.file_path"), f"/{target.getName()}/", -1)
    return spark.read.option("recursiveFileLookup", "true").format(fmt).load(paths).withColumn("file_date", file_date(below))


def append_importance(df: DataFrame, path: str) -> None:
    df.select("feature", "score", "type", "model_id", "timestamp").write.mode("append").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return shared_folder(spark, name)
