"""Readers: JSON, CSV and WAV files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timecode import number

WORD = "struct<start:double,end:double,word:string,probability:double>"
TRANSCRIPT = f"video_path string, language string, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>, meta map<string,string>"
PLAN = "id string, sources map<string,struct<video:string,audio:string,advance:double,crop:string>>, clips array<array<string>>, cues array<array<string>>, insets array<array<string>>, clip_gains array<double>, accent array<string>"


def _json(spark: SparkSession, paths, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def read_transcripts(spark: SparkSession, paths) -> DataFrame:
    """path, seg_idx, start, end, text, words."""
    return _json(spark, paths, TRANSCRIPT).select("path", F.posexplode("segments").alias("seg_idx", "s")).select("path", "seg_idx", "s.*")


def read_words(spark: SparkSession, paths) -> DataFrame:
    """path, seg_idx, word_idx, start, end, word, probability; a segment without words has one row of nulls."""
    segs = read_transcripts(spark, paths)
    return segs.select("path", "seg_idx", F.posexplode_outer("words").alias("word_idx", "w")).select("path", "seg_idx", "word_idx", "w.*")


def read_plans(spark: SparkSession, paths, root: str = "", ids: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables sources, clips, cues, insets by plan id; relative media paths are put under root; an asked id without a plan is an error."""
    plans = _json(spark, paths, PLAN)
    if ids is not None:
        plans = plans.filter(F.col("id").isin(ids))
        lost = set(ids) - {r["id"] for r in plans.select("id").distinct().collect()}  # at most the asked ids
        if lost:
            raise ValueError(f"no plan for {sorted(lost)}")
    full = lambda c: F.when(c.startswith("/") | (F.lit(root) == ""), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
    sources = plans.select("id", F.explode("sources").alias("source", "s")).select("id", "source", full(F.col("s.video")).alias("video"), full(F.col("s.audio")).alias("audio"), F.coalesce("s.advance", F.lit(0.0)).alias("advance"), "s.crop")
    items = lambda c: plans.select("id", F.posexplode(c).alias("idx", "x"))
    num = lambda i: F.col("x")[i].cast("double")
    return {
        "sources": sources,
        "clips": items("clips").select("id", "idx", F.col("x")[0].alias("source"), num(1).alias("start"), num(2).alias("end")),
        "cues": items("cues").select("id", "idx", F.col("x")[0].alias("source"), num(1).alias("start"), num(2).alias("end"), F.col("x")[3].alias("text")),
        "insets": items("insets").select("id", "idx", num(0).alias("start"), num(1).alias("end"), full(F.col("x")[2]).alias("path"), num(3).alias("x"), num(4).alias("y")),
    }


def read_csv(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """All columns as strings, null as ''; a file without a header is an error."""
    df = spark.read.csv(paths, header=True, inferSchema=False, sep=sep)
    if not df.columns:
        raise ValueError(f"{paths}: no header")
    return df.fillna("")


read_tracker = read_csv


def read_upload_list(spark: SparkSession, paths) -> DataFrame:
    """index, filename, camera, start, end, by index; rows without a whole index are skipped, the first named file column counts."""
    df = read_csv(spark, paths)
    col = lambda c: F.nullif(F.trim(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    rows = df.select(F.trim("index").try_cast("int").alias("index"), F.coalesce(col("symlink_name"), col("filename"), col("basename")).alias("filename"), col("camera").alias("camera"), number(col("start")).alias("start"), number(col("end")).alias("end"))
    return rows.filter("index IS NOT NULL").orderBy("index")


def read_caption_overrides(spark: SparkSession, path: str) -> DataFrame:
    """index, caption from a JSON object or CSV rows; keys that are no numbers are skipped, the last of equals wins."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "caption")).withColumn("n", F.lit(0).cast("long"))
    else:
        rows = read_csv(spark, path).select(F.col("index").alias("k"), "caption", F.monotonically_increasing_id().alias("n"))
    rows = rows.select(F.trim("k").try_cast("int").alias("index"), "caption", "n").filter("index IS NOT NULL")
    return rows.groupBy("index").agg(F.max_by("caption", "n").alias("caption"))


def read_progress(spark: SparkSession, paths) -> DataFrame:
    """The latest row per index."""
    rows = read_csv(spark, paths).withColumns({"index": F.trim("index").try_cast("int"), "_n": F.monotonically_increasing_id()}).filter("index IS NOT NULL")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("index").orderBy(F.desc("_n")))).filter("_r = 1").drop("_r", "_n")


def read_candidates(spark: SparkSession, paths) -> DataFrame:
    """path, transcript_path, cand_idx, start, end, title, reason, score; items without times are dropped."""
    schema = "transcript_path string, video_path string, llm_model string, candidates array<struct<start:double,end:double,title:string,reason:string,score:double>>"
    return _json(spark, paths, schema).select("path", "transcript_path", F.posexplode("candidates").alias("cand_idx", "c")).select("path", "transcript_path", "cand_idx", "c.*").filter("start IS NOT NULL AND end IS NOT NULL")


def read_offsets(spark: SparkSession, paths) -> DataFrame:
    """ref, other, offset_start, slope, intercept; the drift fit is optional."""
    schema = "ref string, other string, offset_start double, fit_drift struct<slope_per_sec:double,intercept_seconds:double>"
    return _json(spark, paths, schema).select("ref", "other", "offset_start", F.col("fit_drift.slope_per_sec").alias("slope"), F.col("fit_drift.intercept_seconds").alias("intercept"))


def read_cut_list(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, label, start, end; an end not after its start is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<struct<label:string,start:double,end:double>>>")).alias("file", "xs"))
    rows = rows.select("file", F.posexplode("xs").alias("idx", "x")).select("file", "idx", "x.*")
    bad = F.raise_error(F.concat(F.lit("empty cut in "), "file")).cast("double")
    return rows.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(bad))


def read_speaker_samples(spark: SparkSession, path: str) -> DataFrame:
    """label, video, start, end from a list or an object with samples, refs or segments; a missing field is an error."""
    item = "array<struct<label:string,video:string,start:double,end:double>>"
    text = spark.read.text(path, wholetext=True)
    from_object = F.from_json("value", f"samples {item}, refs {item}, segments {item}")
    xs = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.coalesce(from_object["samples"], from_object["refs"], from_object["segments"]))
    rows = text.select(F.explode(xs).alias("x")).select("x.*")
    ok = F.col("label").isNotNull() & F.col("video").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    return rows.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("a speaker sample lacks a field"))))


def read_run_records(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema("run_id string, type string, status string, rc int, attempts int, seconds double, count int, count_raw int, index int, start double, end double, title string, output string").json(paths)
