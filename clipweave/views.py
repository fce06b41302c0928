"""Input views over the driver's tables, as Spark DataFrames and as DuckDB CTEs (integer milliseconds)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: <table> stands for a base table, {MS} for epoch milliseconds of ts. Later views may use earlier ones by name.
VIEWS = {
    "segments": """
      SELECT recording_id, seg_idx, speaker, text,
        CAST(sum(gap_ms + dur_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - dur_ms AS BIGINT) AS start_ms,
        CAST(sum(gap_ms + dur_ms) OVER (PARTITION BY recording_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ms
      FROM (SELECT conv_id AS recording_id, turn AS seg_idx, role AS speaker, text,
              CAST(greatest(1000, length(text) * 60) AS BIGINT) AS dur_ms,
              CAST(((conv_id * 7 + turn * 13) % 10) * 300 AS BIGINT) AS gap_ms FROM <conversations>) b""",
    "intervals": """
      SELECT user_id AS recording_id, event_id AS interval_id, event_type AS kind, {MS} AS start_ms,
        {MS} + CAST(round(value * 60000) AS BIGINT) AS end_ms FROM <events>""",
    "levels": """
      SELECT user_id AS recording_id, event_type AS camera, CAST(floor(({MS} - 1704067200000) / 3600000) AS BIGINT) AS hop_idx,
        CAST(round(max(value) * 100) AS BIGINT) AS level
      FROM <events> GROUP BY user_id, event_type, CAST(floor(({MS} - 1704067200000) / 3600000) AS BIGINT)""",
    "candidates": """
      SELECT o_custkey AS recording_id, o_orderkey AS cand_idx, CAST(((o_orderkey * 37) % 600) * 1000 AS BIGINT) AS start_ms,
        CAST(((o_orderkey * 37) % 600 + 10 + (o_orderkey * 13) % 85) * 1000 AS BIGINT) AS end_ms,
        CAST(floor(o_totalprice) AS BIGINT) % 1000 AS score_milli FROM <orders>""",
    "clips": """
      SELECT recording_id AS reel_id, seg_idx AS clip_idx, speaker AS source, start_ms, end_ms,
        CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 500 ELSE -250 END AS advance_ms FROM segments""",
    "cues": """
      SELECT recording_id AS reel_id, speaker AS source, seg_idx * 2 + h AS cue_idx,
        CASE h WHEN 0 THEN start_ms + 200 ELSE CAST(floor((start_ms + end_ms) / 2) AS BIGINT) END AS start_ms,
        CASE h WHEN 0 THEN CAST(floor((start_ms + end_ms) / 2) AS BIGINT) ELSE end_ms + 400 END AS end_ms,
        substr(text, 1, 24) AS text
      FROM segments CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) x""",
    "tracker": """
      SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE substr(CAST(o_orderdate AS VARCHAR(64)), 1, 10) END AS date,
        CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR(64)) END AS file_index,
        o_orderpriority AS title,
        CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE '' END AS posted,
        CASE WHEN o_orderstatus = 'P' THEN 'posted' ELSE 'planned' END AS status,
        CASE WHEN o_orderkey % 7 = 0 THEN ''
             WHEN o_orderkey % 5 = 0 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(64)), ',5')
             ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(64)) END AS views_24h,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR(64)) END AS likes_24h,
        CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_orderkey % 100 AS VARCHAR(64)) END AS comments_24h
      FROM <orders>""",
    "media": """
      SELECT p_partkey AS file_index,
        concat(p_name, CASE p_partkey % 6 WHEN 0 THEN '.avi' WHEN 1 THEN '.mp4' ELSE '.mov' END) AS filename,
        CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'vp9' WHEN 2 THEN 'hevc' ELSE 'h264' END AS video_codec,
        CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'alac' ELSE 'aac' END AS audio_codec,
        CASE p_partkey % 10 WHEN 0 THEN 2160 ELSE 1080 END AS width, CASE p_partkey % 10 WHEN 0 THEN 3840 ELSE 1920 END AS height,
        CASE p_partkey % 12 WHEN 0 THEN '15/1' WHEN 1 THEN '30000/1001' WHEN 2 THEN '0/0' ELSE '30/1' END AS r_frame_rate,
        CASE p_partkey % 13 WHEN 0 THEN NULL ELSE (p_size - 1) * 20 END AS duration_s,
        CAST(floor(p_retailprice * 250000) AS BIGINT) AS size_bytes FROM <part>""",
    "llm_answers": """
      SELECT o_orderkey AS answer_id, o_custkey AS recording_id, CASE o_orderkey % 4
        WHEN 0 THEN concat('[{"start": ', CAST((o_orderkey * 37) % 600 AS VARCHAR(64)), ', "end": ', CAST((o_orderkey * 37) % 600 + 30 AS VARCHAR(64)), ', "title": "t", "score": "0.5"}]')
        WHEN 1 THEN concat('Here it is: [{"start": "00:0', CAST(o_orderkey % 10 AS VARCHAR(64)), ':10.500", "end": 00:0', CAST(o_orderkey % 10 AS VARCHAR(64)), ':50, "score": 0.7}] thanks')
        WHEN 2 THEN '[]' ELSE 'no strong moments' END AS answer FROM <orders>""",
}
_NEEDS = {"clips": ["segments"], "cues": ["segments"]}


def with_views(*names: str) -> str:
    """'WITH ...,' prefix for DuckDB: the named views and those they use."""
    wanted = list(dict.fromkeys(n for name in names for n in [*_NEEDS.get(name, []), name]))
    one = lambda n: f"{n} AS ({re.sub(r'<(\w+)>', r'\1', VIEWS[n]).replace('{MS}', '(epoch_us(ts) // 1000)')})"
    return "WITH RECURSIVE " + ",\n".join(map(one, wanted))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of sf_dir; only the tables it uses are read."""
    text = VIEWS[name]
    tables = set(re.findall(r"<(\w+)>", text))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    frames |= {n: view(spark, sf_dir, n) for n in _NEEDS.get(name, [])}
    # Braces of JSON text are doubled for the formatter; table marks become its fields.
    text = text.replace("{MS}", "unix_millis(CAST(ts AS TIMESTAMP))").replace("{", "{{").replace("}", "}}")
    text = re.sub(r"<(\w+)>", r"{\1}", text)
    for n in _NEEDS.get(name, []):
        text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
    return spark.sql(text, **frames)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="clipweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/clipweave/{name}-{uuid.uuid4().hex}"
