"""Frames of videos from packed files, as a data source: only the frames that are asked for are read.

A packed file holds one video: MAGIC, the length of a JSON header, the header (video_id, width, height, fps, n, and pts, the packets'
times, or null), and n frames of width * height * 3 bytes. Every frame's place follows from its number, so a scan is planned as
ranges of frames, and a range is one seek and one read after the other.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MAGIC = b"tsframe1"
SCHEMA = "video_id string, frame int, t double, h int, w int, rgb binary"
#: Bytes of frames in a partition, and in a batch on its way to Spark.
PART_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Tolerance of times at both ends of a range.
EPS = 1e-6


@dataclass(frozen=True)
class Header:
    video_id: str
    width: int
    height: int
    fps: float
    n: int
    pts: list[float] | None
    begin: int

    def frame_bytes(self) -> int:
        return self.width * self.height * 3

    def time(self, frame: int) -> float:
        """By the packets' times where the file has one for each frame, else evenly spaced."""
        return self.pts[frame] if self.pts and len(self.pts) >= self.n else frame / self.fps


def packed(video_id: str, width: int, height: int, fps: float, frames: list[bytes], pts: list[float] | None = None) -> bytes:
    """The bytes of a packed file; pts are sorted, as packets may come in another order than they are shown."""
    if any(len(f) != width * height * 3 for f in frames):
        raise ValueError("a frame has another size")
    head = json.dumps({"video_id": video_id, "width": width, "height": height, "fps": fps, "n": len(frames), "pts": sorted(pts) if pts else None}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(frames)


def read_header(store: fs.FileSystem, path: str) -> Header:
    with store.open_input_file(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} holds no packed frames")
        size = struct.unpack("<I", f.read(4))[0]
        h = json.loads(f.read(size))
    return Header(h["video_id"], h["width"], h["height"], float(h["fps"]), h["n"], h["pts"], len(MAGIC) + 4 + size)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Part(InputPartition):
    """Frames first to last (not included) of one file."""

    path: str
    head: Header
    first: int
    last: int


@dataclass(frozen=True)
class Asked:
    """Bounds that filters set: frames and times, ends included, and whose videos (None: all)."""

    first: float = -math.inf
    last: float = math.inf
    after: float = -math.inf
    until: float = math.inf
    videos: frozenset | None = None


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.asked = Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on frame and t and a choice of videos narrow the plan; Spark still sees to every filter, so bounds may be rounded outwards."""
        a = self.asked
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            value = getattr(f, "value", None)
            if name in ("frame", "t") and isinstance(value, (int, float)) and not isinstance(value, bool):
                low, high = ("first", "last") if name == "frame" else ("after", "until")
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    a = replace(a, **{low: max(getattr(a, low), value)})
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    a = replace(a, **{high: min(getattr(a, high), value)})
            elif name == "video_id" and isinstance(f, (EqualTo, In)):
                own = frozenset([value] if isinstance(f, EqualTo) else f.value)
                a = replace(a, videos=own if a.videos is None else a.videos & own)
            yield f
        self.asked = a

    def _range(self, h: Header) -> range:
        """The frames of a file that are asked for: its times lie in [start, end) with EPS at both ends."""
        a, o = self.asked, self.options
        first, last = math.ceil(max(0, min(a.first, h.n))), math.floor(max(-1, min(a.last, h.n - 1))) + 1
        start = float(o["start"]) - EPS if "start" in o else -math.inf
        end = float(o["end"]) - EPS if "end" in o else math.inf
        lo, hi = max(start, a.after), a.until
        own = [k for k in range(first, last) if lo <= h.time(k) <= hi and h.time(k) < end] if max(lo, -hi, -end) > -math.inf else range(first, last)
        return range(own[0], own[-1] + 1) if len(own) else range(0)

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.options["path"])
        info = store.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith((".", "_")))
        parts, known = [], 0
        for file in files:
            h = read_header(store, file)
            if self.asked.videos is not None and h.video_id not in self.asked.videos:
                continue
            own, step = self._range(h), max(1, int(self.options.get("partbytes", PART_BYTES)) // max(1, h.frame_bytes()))
            known += len(own)
            parts += [Part(file, h, k, min(k + step, own.stop)) for k in range(own.start, own.stop, step)]
        if not known and ("start" in self.options or "end" in self.options):
            raise ValueError(f"no frames in [{self.options.get('start', '')}, {self.options.get('end', '')})")
        return parts or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Part):
            return
        h, size = part.head, part.head.frame_bytes()
        step = max(1, BATCH_BYTES // max(1, size))
        store, _ = opened(self.options["path"])
        with store.open_input_file(part.path) as f:
            f.seek(h.begin + part.first * size)
            for k in range(part.first, part.last, step):
                own = range(k, min(k + step, part.last))
                raw = [f.read(size) for _ in own]
                if any(len(x) != size for x in raw):
                    raise ValueError(f"{part.path} ends before its last frame")
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h.video_id] * n), pa.array(own, pa.int32()), pa.array([h.time(j) for j in own], pa.float64()), pa.array([h.height] * n, pa.int32()), pa.array([h.width] * n, pa.int32()), pa.array(raw, pa.binary())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )


class FrameSource(DataSource):
    """format("packed_frames"): options path (a file or folder), start and end (seconds, half-open), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "packed_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def read_frames(spark: SparkSession, path: str, start: float | None = None, end: float | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """video_id, frame, t, h, w, rgb of packed files under path with start <= t < end; where a bound is given and no frame lies within, reading raises ValueError.

    Filters on video_id, frame and t narrow what is read. A partition is a range of frames of one file.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    r = spark.read.format("packed_frames").option("partBytes", part_bytes)
    for name, bound in (("start", start), ("end", end)):
        r = r.option(name, bound) if bound is not None else r
    return r.load(path)


def write_frames(frames: DataFrame, folder: str, fps: float, times: bool = False) -> DataFrame:
    """Packs frames (video_id, frame from 0 without holes, t, h, w, rgb) as one file for each video in a folder that all executors share; gives video_id, path, n.

    A file gets its name when it is whole. A video's frames pass one task, in order, one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, str, int]] = []
        now = None  # (video_id, part file, stream, h, w, times)

        def finish() -> None:
            video, part, out, h, w, at = now
            out.close()
            head = json.dumps({"video_id": video, "width": w, "height": h, "fps": fps, "n": len(at), "pts": at if times else None}).encode()
            with store.open_output_stream(f"{root}/.{video}.whole") as whole, store.open_input_file(part) as body:
                whole.write(MAGIC + struct.pack("<I", len(head)) + head)
                while piece := body.read(BATCH_BYTES):
                    whole.write(piece)
            store.move(f"{root}/.{video}.whole", f"{root}/{video}.frames")
            store.delete_file(part)
            done.append((video, f"{root}/{video}.frames", len(at)))

        for b in batches:
            for row in b.to_pylist():
                if now is None or now[0] != row["video_id"]:
                    if now:
                        finish()
                    part = f"{root}/.{row['video_id']}.part"
                    now = (row["video_id"], part, store.open_output_stream(part), row["h"], row["w"], [])
                if row["frame"] != len(now[5]) or len(row["rgb"]) != now[3] * now[4] * 3:
                    raise ValueError(f"{row['video_id']}: frame {row['frame']} is out of turn or of another size")
                now[2].write(row["rgb"])
                now[5].append(row["t"])
        if now:
            finish()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["video_id", "path", "n"])

    ordered = frames.select("video_id", "frame", "t", "h", "w", "rgb").repartition("video_id").sortWithinPartitions("video_id", "frame")
    return ordered.mapInArrow(run, "video_id string, path string, n bigint")


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """video_id, path, width, height, fps, n of the packed files under path; their headers are read in tasks."""
    store, root = opened(path)
    names = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and not x.base_name.startswith((".", "_"))]
    scheme = path.split("://")[0] + "://" if "://" in path else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [(uri, read_header(*opened(uri))) for uri in b.column(0).to_pylist()]
            cols = [[h.video_id for _, h in known], [u for u, _ in known], [h.width for _, h in known], [h.height for _, h in known], [h.fps for _, h in known], [h.n for _, h in known]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32()), strict=True)], names=["video_id", "path", "width", "height", "fps", "n"])

    listed = spark.createDataFrame([(scheme + n if scheme else n,) for n in sorted(names)], "path string").repartition(max(1, min(len(names), 1000)))
    return listed.mapInArrow(run, "video_id string, path string, width int, height int, fps double, n int")
