"""A store of tracks whose saves are all or nothing: data first, in folders of their own, then one manifest that names them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, jobs, merge
from ..sources import tracks as documents
from .save import InvalidTrackError, check, refuse_bad_segments

VIDEOS = "video_id string, url string, status string, segments array<struct<start: double, end: double>>, track_path string, created_at string, updated_at string"


class StaleStoreError(RuntimeError):
    """Somebody else saved in between; nothing of this save can be seen, and it may be tried again."""


class TrackStore:
    """Tracks under one path. Its versions are folders versions/<number>, each a whole table of videos, whose track_path names the save that holds the video's rows.

    A save writes its rows to data/save=<name>, then its table of videos to a hidden folder, and renames that to the next number: until
    then readers see the version before, from then on this one. Two savers cannot take the same number. Rows of saves that
    no version names are never read (see vacuum()).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The newest version's number, 0 for an empty store."""
        root = self._at(f"{self.path}/versions")
        if not self._fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def videos(self, version: int | None = None) -> DataFrame:
        """The table of videos as of a version, by default the newest."""
        version = self.version() if version is None else version
        return self.spark.read.schema(VIDEOS).parquet(f"{self.path}/versions/{version}") if version else self.spark.createDataFrame([], VIDEOS)

    def rows(self, version: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The rows of all tracks as of a version, or of the videos in `of` (video_id) alone.

        Which saves are read is known before the scan: folders of other saves are not opened, and within a save rows lie in order of video_id.
        """
        named = self.videos(version).where("track_path IS NOT NULL").select("video_id", F.col("track_path").alias("save"))
        named = named.join(of.select("video_id").distinct(), "video_id", "left_semi") if of is not None else named
        saves = [r.save for r in named.select("save").distinct().collect()]  # one short name for each save that is still in use
        if not saves:
            raise InvalidTrackError("the store has no tracks")
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/save={s}" for s in sorted(saves)))
        return data.join(named, ["video_id", "save"], "left_semi").drop("save")

    def save(self, rows: DataFrame, segments: DataFrame, heads: DataFrame, replace: bool = False) -> int:
        """Saves the tracks of heads (video_id, url, at): rows (with pos, their place in the track) and segments (video_id, start, end). Gives the new version.

        A video that has a track keeps its rows and segments outside the new segments, unless `replace`. Everything is judged before anything can be seen: rows and
        segments of videos that heads does not name, broken rules before or after the merge, segments that end before they start, tracks
        without rows. What comes between the read and the rename of another saver is StaleStoreError.
        """
        at = self.version()
        mine = heads.select("video_id")
        for part, what in ((rows, "rows"), (segments, "segments")):
            other = part.join(mine, "video_id", "left_anti").orderBy("video_id").first()
            if other:
                raise InvalidTrackError(f"{other.video_id}: {what} of another video than those saved")
        refuse_bad_segments(segments)
        check(rows)
        new = {"rows": rows.drop("pos"), "segments": segments.select("video_id", "start", "end")}
        videos = self.videos(at)
        known = videos.where("track_path IS NOT NULL").join(mine, "video_id", "left_semi")
        both = {"rows": new["rows"], "segments": intervals.union(new["segments"], eps=0.0)}
        if not replace and not known.isEmpty():
            spans = known.select("video_id", F.explode("segments").alias("s")).select("video_id", "s.start", "s.end")
            both = merge.merge_tracks({"rows": self.rows(at, known), "segments": spans}, new, eps=0.0)
        name = f"s{uuid.uuid4().hex}"
        folder = f"{self.path}/data/save={name}"
        both["rows"].repartition("video_id").sortWithinPartitions("video_id", "t").write.parquet(folder)
        kept = self.spark.read.schema(both["rows"].schema).parquet(folder)
        check(documents.numbered(kept))
        left = mine.join(kept, "video_id", "left_anti").orderBy("video_id").first()
        if left:
            raise InvalidTrackError(f"{left.video_id}: no rows are left")
        spans = both["segments"].groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))
        saved = heads.join(spans, "video_id", "left").withColumn("track_path", F.lit(name))
        self._commit(jobs.upsert_tracks(videos, saved), at)
        return at + 1

    def remove(self, ids: DataFrame) -> int:
        """Takes the videos of ids (video_id) and their tracks away; gives the new version."""
        at = self.version()
        self._commit(self.videos(at).join(ids.select("video_id"), "video_id", "left_anti"), at)
        return at + 1

    def _commit(self, videos: DataFrame, at: int) -> None:
        hidden, final = f"{self.path}/versions/.{uuid.uuid4().hex}", f"{self.path}/versions/{at + 1}"
        videos.select(*self.videos(0).columns).sortWithinPartitions("video_id").write.parquet(hidden)
        if self._fs.exists(self._at(final)) or not self._fs.rename(self._at(hidden), self._at(final)) or self._fs.exists(self._at(f"{final}/{hidden.rsplit('/', 1)[1]}")):
            raise StaleStoreError(f"version {at + 1} is there already")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all versions but the last `keep`, and the data of saves that none of those names; gives the names of those saves.

        No save may be at work meanwhile: its data are not named yet.
        """
        last = self.version()
        root = self._at(f"{self.path}/versions")
        old = [s.getPath() for s in self._fs.listStatus(root) if not s.getPath().getName().isdigit() or int(s.getPath().getName()) <= last - keep]
        for p in old:
            self._fs.delete(p, True)
        named = {r.track_path for v in range(max(1, last - keep + 1), last + 1) for r in self.videos(v).select("track_path").distinct().collect()}
        gone = [s.getPath() for s in self._fs.listStatus(self._at(f"{self.path}/data")) if s.getPath().getName().removeprefix("save=") not in named]
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName().removeprefix("save=") for p in gone)
