"""What a video's probe says: sizes, rates and lengths with their fallbacks, and counters from logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.settings import frame_rate, interlace_vote

#: Field orders that a stream states of interlaced video. Fixed values.
FIELD_ORDERS = ("tt", "bb", "tb", "bt")
COUNTERS = ("tff", "bff", "progressive", "undetermined")
_COUNTS = r"Multi frame detection: TFF:\s*(\d+) BFF:\s*(\d+) Progressive:\s*(\d+) Undetermined:\s*(\d+)"


def probes(docs: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """keys, codec, width, height, fps, duration, n_frames, field_order of probe documents (JSON with streams and format).

    The average rate unless it is zero, else the base rate; the stream's length, else the file's, else 0; the stated number of frames, else
    length times rate, rounded half to even.
    """
    at = lambda p, kind: F.get_json_object(doc, p).try_cast(kind)
    stream = "$.streams[0]"
    nonzero = lambda c: F.when(c != 0, c)
    fps = frame_rate(at(f"{stream}.avg_frame_rate", "string"), at(f"{stream}.r_frame_rate", "string"))
    length = F.coalesce(nonzero(at(f"{stream}.duration", "double")), nonzero(at("$.format.duration", "double")), F.lit(0.0))
    p = docs.select(*keys, F.coalesce(at(f"{stream}.codec_name", "string"), F.lit("?")).alias("codec"), at(f"{stream}.width", "int").alias("width"), at(f"{stream}.height", "int").alias("height"), F.coalesce(fps, F.lit(0.0)).alias("fps"), length.alias("duration"), at(f"{stream}.nb_frames", "int").alias("_n"), F.coalesce(at(f"{stream}.field_order", "string"), F.lit("unknown")).alias("field_order"))
    return p.select(*keys, "codec", "width", "height", "fps", "duration", F.coalesce(nonzero(F.col("_n")), F.bround(F.col("duration") * F.col("fps"), 0).cast("int")).alias("n_frames"), "field_order")


def field_counts(logs: DataFrame, keys: list[str], log: str = "log") -> DataFrame:
    """keys, COUNTERS of each log: those of its last report, null where it has none."""
    every = [F.regexp_extract_all(log, F.lit(_COUNTS), F.lit(k + 1)) for k in range(len(COUNTERS))]
    return logs.select(*keys, *(F.try_element_at(e, F.lit(-1)).cast("int").alias(c) for e, c in zip(every, COUNTERS, strict=True)))


def interlacing(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, interlaced, parity (tff or bff, null if not interlaced) from field_order and COUNTERS.

    Counters decide; where they do not say so, a stream that states a field order is taken at its word, unless at least half as many frames are progressive as not. The
    stated order gives the parity, else the counters.
    """
    c = {k: F.col(k) for k in COUNTERS}
    known, stated = c["tff"].isNotNull(), F.col("field_order").isin(*FIELD_ORDERS)
    vote = interlace_vote(c["tff"], c["bff"], c["progressive"])
    trusted = stated & (c["progressive"] < 0.5 * (c["tff"] + c["bff"] + c["undetermined"]))
    interlaced = F.coalesce(known & (vote["interlaced"] | trusted), F.lit(False))
    parity = F.when(stated, F.when(F.col("field_order").isin("bb", "bt"), "bff").otherwise("tff")).otherwise(vote["parity"])
    return counted.select(*keys, interlaced.alias("interlaced"), F.when(interlaced, parity).alias("parity"))


def is_local(url, exists, allowed: bool = True):
    """Whether a source names a file on the spot: no scheme, the file is there (exists, a Column), and local files are allowed."""
    return F.lit(allowed) & ~F.contains(url, F.lit("://")) & exists
