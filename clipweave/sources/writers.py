"""Writers. Text forms for people are one file, ordered; tables stay partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells are written as they are: no trimming, empty ones without quotes.
AS_IS = {"header": True, "mode": "overwrite", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tracker_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.csv(path, **AS_IS)


def write_excel_csv(df: DataFrame, path: str) -> None:
    """Byte order mark, 'sep=;' line, semicolons, CRLF: one ordered text file."""
    quote = lambda c: F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(";", *(quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    rows = df.coalesce(1).select(line.alias("value"), (F.monotonically_increasing_id() + 1).alias("n"))
    head = df.sparkSession.createDataFrame([("﻿sep=;", -1), (";".join(df.columns), 0)], "value string, n long")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path, lineSep="\r\n")


def write_excel_tsv(df: DataFrame, path: str) -> None:
    """UTF-16 with a byte order mark, tabs."""
    df.coalesce(1).write.csv(path, sep="\t", encoding="UTF-16", **AS_IS)


def write_progress(df: DataFrame, path: str) -> None:
    columns = ["index", "filename", "status", "instagram_post_url", "published_at", "notes"]
    df.select(*columns).coalesce(1).sortWithinPartitions("index").write.csv(path, **AS_IS)


def write_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path, mode="overwrite")


def write_eval_tsv(df: DataFrame, path: str, four: list[str], two: list[str]) -> None:
    """Fixed decimals, halves to even; cells of rows that are not ok are blank."""
    cell = lambda c, n: F.when((F.col("status") == "ok") & F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.bround(F.col(c).cast("double"), n))).otherwise(F.lit(""))
    out = df.withColumns({**{c: cell(c, 4) for c in four}, **{c: cell(c, 2) for c in two}})
    out.coalesce(1).write.csv(path, sep="\t", **AS_IS)


def write_text(df: DataFrame, path: str, text: str, lines: str = "\n") -> None:
    """One text column as files, a row per record (SRT, ASS)."""
    df.select(text).write.mode("overwrite").text(path, lineSep=lines)


def clip_manifest(cands: DataFrame, key: str, stem: str) -> DataFrame:
    """key, n, files: numbered output names in order of start."""
    from pyspark.sql import Window as W

    from ..functions.text import clip_file_name
    from ..functions.timecode import seconds_to_timestamp

    n = F.row_number().over(W.partitionBy(key).orderBy("start_ms", "end_ms"))
    rows = cands.withColumn("_n", n)
    name = clip_file_name(F.col(stem), F.col("_n"), seconds_to_timestamp(F.col("start_ms") / 1000.0), seconds_to_timestamp(F.col("end_ms") / 1000.0))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_n", name.alias("name")))), lambda x: x["name"]).alias("files"))
