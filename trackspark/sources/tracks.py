"""Track documents: JSON files in and out, and the Parquet store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_RING
from ..functions.ids import ring_or_default


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, doc (whole JSON text) of every file under a path or glob."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def header(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """video_id, source_url, created_at, generator, width, height, fps, fields, segments of each document."""
    v = docs.withColumn("_v", F.try_parse_json(doc))
    get = lambda p, t: F.try_variant_get("_v", p, t)
    return v.select(
        get("$.video_id", "string").alias("video_id"), get("$.source_url", "string").alias("source_url"), get("$.created_at", "string").alias("created_at"), F.to_json(get("$.generator", "variant")).alias("generator"),
        get("$.video.width", "int").alias("width"), get("$.video.height", "int").alias("height"), get("$.video.fps", "double").alias("fps"), get("$.fields", "array<string>").alias("fields"), get("$.segments", "array<struct<start:double,end:double>>").alias("segments"),
    )


def segments(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """video_id, start, end, without those of no length."""
    return header(docs, doc).select("video_id", F.explode("segments").alias("s")).select("video_id", "s.start", "s.end").where("end > start")


def rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """video_id, pos and the named columns of every row, tolerantly: columns are found by name in any order, others ignored.

    A missing or odd ring is the default, flags keep their low 8 bits or are 0, streaks are 0 unless positive, their angles 0
    unless finite. pos is the row's place in the file.
    """
    v = docs.withColumn("_v", F.try_parse_json(doc))
    fields = F.try_variant_get("_v", "$.fields", "array<string>")
    v = v.select(F.try_variant_get("_v", "$.video_id", "string").alias("video_id"), fields.alias("_f"), F.posexplode(F.try_variant_get("_v", "$.frames", "array<array<variant>>")).alias("pos", "_row"))

    def cell(name: str, kind: str) -> Column:
        at = F.array_position("_f", name)
        return F.when(at > 0, F.try_variant_get(F.get(F.col("_row"), (at - 1).cast("int")), "$", kind))

    number = lambda name: cell(name, "double")
    flags, sl, sa = cell("flags", "bigint"), number("sl"), number("sa")
    return v.select(
        "video_id", "pos", number("t").alias("t"), *(number(c).alias(c) for c in ("x", "y", "r", "conf")), F.coalesce(ring_or_default(cell("ring", "string"), DEFAULT_RING), F.lit(DEFAULT_RING)).alias("ring"),
        F.coalesce(flags.bitwiseAND(255), F.lit(0)).cast("int").alias("flags"), F.when(sl > 0, sl).otherwise(0.0).alias("sl"), F.coalesce(F.when(~F.isnan(sa), sa), F.lit(0.0)).alias("sa"),
    )


def numbered(track_rows: DataFrame) -> DataFrame:
    """track_rows with pos, each row's place in its track in order of time."""
    return track_rows.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("t")) - 1)


def rounded(track_rows: DataFrame) -> DataFrame:
    """Rows as files hold them: times to 3 digits, lengths to 5, confidence to 2, angles to 3."""
    digits = {"t": 3, "x": 5, "y": 5, "r": 5, "conf": 2, "sl": 5, "sa": 3}
    return track_rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


def normalised(points: DataFrame, width: float, height: float, min_conf: float) -> DataFrame:
    """Pixels to fractions of the frame; points outside the frame or below min_conf go."""
    p = points.withColumns({"x": F.col("x") / width, "y": F.col("y") / height, "r": F.col("r") / width, "sl": F.col("sl") / width})
    return p.where(F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("conf") >= min_conf))


def documents(track_rows: DataFrame, heads: DataFrame) -> DataFrame:
    """video_id, doc: one JSON document for each video of heads (video_id, source_url, created_at, width, height, fps, segments)."""
    r = rounded(track_rows).select("video_id", F.struct("t", F.to_json(F.struct("t", "x", "y", "r", "conf", "ring", "flags", "sl", "sa")).alias("j")).alias("e"))
    cells = F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat(F.lit("["), F.regexp_replace(F.substring(e["j"], F.lit(2), F.length(e["j"]) - 2), r'"(?:t|x|y|r|conf|ring|flags|sl|sa)":', ""), F.lit("]")))
    body = r.groupBy("video_id").agg(F.array_join(cells, ",\n").alias("_rows"))
    h = heads.join(body, "video_id", "left")
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), "video_id", "source_url", "created_at", F.struct("width", "height", "fps").alias("video"), "segments", F.array(*map(F.lit, ("t", "x", "y", "r", "conf", "ring", "flags", "sl", "sa"))).alias("fields")))
    return h.select("video_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"frames":['), F.coalesce("_rows", F.lit("")), F.lit("]}")).alias("doc"))


def save(track_rows: DataFrame, path: str) -> None:
    """The Parquet store by video: videos in track_rows are replaced as a whole, others stay."""
    track_rows.repartition("video_id").sortWithinPartitions("video_id", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def candidates(docs: DataFrame, doc: str = "doc", key: str = "path") -> DataFrame:
    """key, frame, cand_idx, x, y, score of cached candidates: {"candidates": {frame: [[x, y, score]]}}."""
    m = F.from_json(F.get_json_object(doc, "$.candidates"), "map<string, array<array<double>>>")
    c = docs.select(key, F.explode(m).alias("f", "cs")).select(key, F.col("f").cast("int").alias("frame"), F.posexplode("cs").alias("cand_idx", "c"))
    return c.select(key, "frame", "cand_idx", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), F.col("c")[2].alias("score"))


def cache(cands: DataFrame, key: str = "path") -> DataFrame:
    """key, doc of candidates(), values rounded to 2 digits, frames without any left out."""
    one = F.array(*(F.round(c, 2) for c in ("x", "y", "score")))
    f = cands.groupBy(key, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", one.alias("c")))), lambda e: e["c"]).alias("cs"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("string"), "cs"))))
    return f.groupBy(key).agg(F.to_json(F.struct(m.alias("candidates"))).alias("doc"))
