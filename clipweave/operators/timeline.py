"""Plans to reel time: clips, cues, insets, joins, spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import END, START, overlap_join

#: Least overlap of a cue with a clip, and frames per second; fixed values.
LEAST_CUE_MS, FPS = 70, 30


def build_clips(clips: DataFrame, reel: str = "reel_id") -> DataFrame:
    """reel, clip_idx, source, source times on the frame grid, in milliseconds of thirtieths, and the place in the reel.

    Times become frames round((t - advance) * 30), half to even; frame columns are exact, _ms columns are frames * 100 / 3 floored.
    """
    frame = lambda c: F.bround((F.col(c) - F.col("advance_ms")) * FPS / 1000).cast("long")
    rows = clips.select(reel, "clip_idx", "source", frame(START).alias("start_frame"), frame(END).alias("end_frame"))
    order = W.partitionBy(reel).orderBy("clip_idx").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("at_frame", F.coalesce(F.sum(F.col("end_frame") - F.col("start_frame")).over(order), F.lit(0)).cast("long"))


def to_reel_time(clips: DataFrame, items: DataFrame, keys: list[str], ids: list[str], least: int = LEAST_CUE_MS, width: int = 60_000) -> DataFrame:
    """Items (cues by reel and source, insets by reel) clipped to each clip and moved to reel time.

    clips: reel_id, clip_idx, start_ms, end_ms (source time), at_ms; items: start_ms, end_ms in
    source time. Kept where more than `least` is left.
    """
    right = items.withColumnsRenamed({START: "r_start_ms", END: "r_end_ms"})
    pairs = overlap_join(clips, right, keys, width).filter(F.col("overlap_ms") > least)
    shift = F.col("at_ms") - F.col(START)
    return pairs.select(*keys, "clip_idx", *ids, (F.col("clip_start_ms") + shift).alias("reel_start_ms"), (F.col("clip_end_ms") + shift).alias("reel_end_ms"))


def laid_out(clips: DataFrame, reel: str = "reel_id") -> DataFrame:
    """clips with at_ms, the running offset of the clips before, without a frame grid; source times less the advance."""
    rows = clips.withColumns({START: F.col(START) - F.col("advance_ms"), END: F.col(END) - F.col("advance_ms")})
    order = W.partitionBy(reel).orderBy("clip_idx").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("at_ms", F.coalesce(F.sum(F.col(END) - F.col(START)).over(order), F.lit(0)).cast("long"))


def seamless_joins(clips: DataFrame, reel: str, audio: str, tolerance: int = 20) -> DataFrame:
    """clips with `seamless`: the sound goes on from the clip before."""
    order = W.partitionBy(reel).orderBy("clip_idx")
    same = (F.lag(audio).over(order) == F.col(audio)) & (F.abs(F.lag(END).over(order) - F.col(START)) < tolerance)
    return clips.withColumn("seamless", F.coalesce(same, F.lit(False)))


def graphic_edges(items: DataFrame, key: str) -> DataFrame:
    """Elementary intervals between change points with the sorted ids of the items active there."""
    edges = items.select(key, F.explode(F.array(START, END)).alias("a")).distinct()
    cells = edges.withColumn("b", F.lead("a").over(W.partitionBy(key).orderBy("a"))).filter("b IS NOT NULL").select(key, F.col("a").alias(START), F.col("b").alias(END))
    right = items.select(key, "item_id", F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms"))
    return overlap_join(cells, right, [key]).groupBy(key, START, END).agg(F.array_sort(F.collect_set("item_id")).alias("active"))


def heard_vs_planned(cues: DataFrame, heard: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Each planned cue with the overlapping heard texts in order, joined by ' / '; empty where none."""
    right = heard.select(key, F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms"), F.col("text").alias("heard"))
    got = overlap_join(cues, right, [key]).groupBy(key, *ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start_ms", "r_end_ms", "heard"))), lambda x: x["heard"]), " / ").alias("heard"))
    return cues.join(got, [key, *ids], "left").withColumn("heard", F.coalesce("heard", F.lit("")))


def snippets(windows: DataFrame, segments: DataFrame, key: str, ids: list[str], most: int) -> DataFrame:
    """Text of the segments that overlap each window, in order; longer than `most` is cut and ends in an ellipsis."""
    right = segments.select(key, F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms"), F.col("text").alias("t"))
    got = overlap_join(windows, right, [key]).groupBy(key, *ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start_ms", "r_end_ms", "t"))), lambda x: F.trim(x["t"])), " ").alias("s"))
    s = F.when(F.length("s") > most, F.concat(F.rtrim(F.substring("s", 1, most - 1)), F.lit("…"))).otherwise(F.col("s"))
    return got.select(key, *ids, s.alias("snippet"))


def cue_spots(cues: DataFrame, key: str, part: str, pads=(300, 1500)) -> DataFrame:
    """Cues with the substring, a listening window per pad, from 0 on."""
    rows = cues.filter(F.col("text").contains(part)).withColumn("pad", F.explode(F.array(*map(F.lit, pads))))
    return rows.select(key, "cue_idx", "pad", F.greatest(F.lit(0), F.col(START) - F.col("pad")).alias(START), (F.col(END) + F.col("pad")).alias(END))


def slice_words(words: DataFrame, lo: int, hi: int) -> DataFrame:
    """Words inside [lo, hi), rebased to lo."""
    return words.filter((F.col(END) > lo) & (F.col(START) < hi)).withColumns({START: F.greatest(F.lit(0), F.col(START) - lo), END: F.least(F.lit(hi), F.col(END)) - lo})


def slice_transcript(segments: DataFrame, start: float, length: float) -> DataFrame:
    """segments (start, end, words, seconds) of a fragment: words that begin in [start, start + length], rebased to it and rounded to hundredths; segments left without words go."""
    inside = F.filter("words", lambda w: (w["start"] >= start) & (w["start"] <= start + length))
    move = lambda c: F.bround(c - start, 2)
    words = F.transform(inside, lambda w: w.withField("start", move(w["start"])).withField("end", move(w["end"])))
    rows = segments.filter((F.col("end") >= start) & (F.col("start") <= start + length)).withColumn("words", words)
    return rows.filter(F.size("words") > 0).withColumns({"start": move(F.col("start")), "end": move(F.col("end"))})


def show_words(segments: DataFrame, lo: float = 0.0, hi: float = 1e9) -> DataFrame:
    """segments that meet [lo, hi] with `shown`: times and text in a line, the words with their starts in the next."""
    head = F.concat(F.format_string("[%7.2f-%7.2f] ", "start", "end"), F.trim("text"))
    words = F.array_join(F.transform(F.coalesce("words", F.array().cast("array<struct<start:double,end:double,word:string,probability:double>>")), lambda w: F.concat(F.trim(w["word"]), F.lit("·"), F.format_string("%.2f", w["start"]))), "  ")
    return segments.filter((F.col("end") >= lo) & (F.col("start") <= hi)).withColumn("shown", F.concat(head, F.lit("\n   "), words))


def auto_title(windows: DataFrame, segments: DataFrame, key: str, ids: list[str], enough: int = 260, rules: list | None = None) -> DataFrame:
    """key, ids, title: from the squeezed texts of the segments that overlap a window, in order, up to the one that makes `enough` characters; null without text."""
    from ..functions.text import squeeze, title_of

    right = segments.select(key, "seg_idx", F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms"), squeeze(F.col("text")).alias("t")).filter("t <> ''")
    got = overlap_join(windows, right, [key])
    before = W.partitionBy(key, *ids).orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)
    got = got.withColumn("_before", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)) - 1).filter(F.col("_before") < enough)
    text = got.groupBy(key, *ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "t"))), lambda x: x["t"]), " ").alias("_t"))
    return windows.select(key, *ids).join(text, [key, *ids], "left").select(key, *ids, title_of(F.col("_t"), rules).alias("title"))


def find_cached_chunk(asked: DataFrame, chunks: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """The first chunk that holds the whole asked range, and the offset inside it."""
    right = chunks.select(key, "chunk_idx", F.col(START).alias("r_start_ms"), F.col(END).alias("r_end_ms"))
    rows = overlap_join(asked, right, [key]).filter((F.col("r_start_ms") <= F.col(START)) & (F.col("r_end_ms") >= F.col(END)))
    return rows.groupBy(key, *ids).agg(F.min(F.struct("chunk_idx", (F.col(START) - F.col("r_start_ms")).alias("offset_ms"))).alias("c")).select(key, *ids, "c.chunk_idx", "c.offset_ms")


def srt(cues: DataFrame, key: str) -> DataFrame:
    """key, srt: numbered blocks in time order."""
    from ..functions.timecode import srt_time

    n = F.row_number().over(W.partitionBy(key).orderBy(START, END, "text"))
    block = F.concat(n.cast("string"), F.lit("\n"), srt_time(F.col(START)), F.lit(" --> "), srt_time(F.col(END)), F.lit("\n"), "text", F.lit("\n"))
    rows = cues.select(key, n.alias("n"), block.alias("b"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n").alias("srt"))


def parse_srt(files: DataFrame, key: str) -> DataFrame:
    """key, n, start_ms, end_ms, text from SRT text."""
    from ..functions.timecode import parse_clock_ms

    blocks = files.select(key, F.explode(F.split(F.col("srt"), r"\n\s*\n")).alias("b"))
    part = lambda i: F.regexp_extract("b", r"(?s)^\s*(\d+)\s*\n([\d:,]+) --> ([\d:,]+)[^\n]*\n(.*?)\s*$", i)
    return blocks.filter(part(1) != "").select(key, part(1).cast("int").alias("n"), parse_clock_ms(part(2)).alias(START), parse_clock_ms(part(3)).alias(END), part(4).alias("text"))


def ass(events: DataFrame, key: str) -> DataFrame:
    """key, ass: Dialogue lines in time order; line breaks as \\N."""
    from ..functions.text import sanitize_ass
    from ..functions.timecode import ass_time

    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col(START)), F.lit(","), ass_time(F.col(END)), F.lit(",Default,,0,0,0,,"), F.replace(sanitize_ass(F.col("text")), F.lit("\n"), F.lit("\\N")))
    rows = events.select(key, F.struct(START, END, line.alias("line")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("ass"))


def parse_ass(files: DataFrame, key: str) -> DataFrame:
    """key, start_ms, end_ms, text from Dialogue lines; the text is the tenth field, commas and all."""
    from ..functions.timecode import parse_clock_ms

    lines = files.select(key, F.explode(F.split("ass", "\n")).alias("line")).filter(F.col("line").startswith("Dialogue:"))
    p = F.split("line", ",", 10)
    return lines.select(key, parse_clock_ms(p[1]).alias(START), parse_clock_ms(p[2]).alias(END), F.replace(p[9], F.lit("\\N"), F.lit("\n")).alias("text"))
