"""Validation of track rows and documents: every violated rule, or the first by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range(c: Column, lo: float, hi: float, open_lo: bool = False, open_hi: bool = False) -> Column:
    inside = ((c > lo) if open_lo else (c >= lo)) & ((c < hi) if open_hi else (c <= hi))
    return ~F.coalesce(inside & ~F.isnan(c), F.lit(False))


def row_rules() -> list[tuple[str, Column]]:
    """Rules of one row in the order in which they are told; a null or NaN breaks them."""
    col = F.col
    return [
        ("t must be a number", col("t").isNull() | F.isnan("t")), ("rows must be sorted by t", F.coalesce(col("t") < col("_prev"), F.lit(False))), ("x/y out of 0..1", _range(col("x"), 0, 1) | _range(col("y"), 0, 1)),
        ("r out of range", _range(col("r"), 0, 0.5, True, True)), ("conf out of 0..1", _range(col("conf"), 0, 1)), ("ring must be #rrggbb", ~F.coalesce(col("ring").rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))),
        ("flags must be an int bitmask 0..7", ~F.coalesce(col("flags").between(0, 7), F.lit(False))), ("sl out of range", _range(col("sl"), 0, 0.5, False, True)), ("sa must be an angle in radians", _range(col("sa"), -7, 7)),
    ]


def violations(rows: DataFrame, key: str = "video_id", pos: str = "pos") -> DataFrame:
    """key, pos, rule for every rule that a row breaks."""
    w = Window.partitionBy(key).orderBy(pos)
    r = rows.withColumn("_prev", F.lag("t").over(w))
    found = F.array_compact(F.array(*(F.when(bad, rule) for rule, bad in row_rules())))
    return r.select(key, pos, F.explode(found).alias("rule"))


def first_violation(rows: DataFrame, key: str = "video_id", pos: str = "pos") -> DataFrame:
    """key, pos, rule of the first broken rule of the first bad row; valid keys are absent."""
    w = Window.partitionBy(key).orderBy(pos)
    r = rows.withColumn("_prev", F.lag("t").over(w))
    rule = F.coalesce(*(F.when(bad, text) for text, bad in row_rules()))
    return r.withColumn("_rule", rule).where("_rule IS NOT NULL").groupBy(key).agg(F.min(F.struct(pos, "_rule")).alias("_f")).select(key, F.col(f"_f.{pos}").alias(pos), F.col("_f._rule").alias("rule"))


def document_errors(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs (JSON text in `doc`) with `error`, the structural rule that fails first, or null: strings are not numbers, nor are booleans."""
    d = docs.withColumn("_v", F.try_parse_json(doc))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit(False))
    fields = get("$.fields", "array<string>")
    missing = F.filter(F.array(*(F.lit(f) for f in ("t", "x", "y", "r", "conf", "ring", "flags"))), lambda f: ~F.array_contains(fields, f))
    segs, frames = get("$.segments", "array<struct<start:double,end:double>>"), get("$.frames", "array<variant>")
    error = (
        F.when(F.col("_v").isNull() | ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "track must be an object")
        .when(~F.coalesce(number("$.schema_version") & (get("$.schema_version", "double") == 1), F.lit(False)), "schema_version must be 1")
        .when(kind("$.video_id").isNull() | (kind("$.video_id") != "STRING"), "video_id must be a string")
        .when(~F.coalesce(number("$.video.fps") & (get("$.video.fps", "double") > 0), F.lit(False)), "video.fps must be a positive number")
        .when(segs.isNull(), "segments must be a list").when(F.exists(segs, lambda s: ~F.coalesce(s["end"] >= s["start"], F.lit(False))), "bad segment")
        .when(fields.isNull(), "fields must be a list of strings").when(F.size(missing) > 0, F.concat(F.lit("fields missing: "), F.array_join(missing, ", ")))
        .when(frames.isNull(), "frames must be a list")
    )
    return d.withColumn("error", error).drop("_v")
