import os

import pytest
from pyspark.sql import functions as F

from trackspark.operators import merge
from trackspark.plans import save
from trackspark.plans.store import StaleStoreError, TrackStore

ROW = "video_id string, t double, x double, y double, r double, conf double, ring string, flags int, sl double, sa double, pos int"


def rows(spark, *at, x=0.5):
    return spark.createDataFrame([(v, t, x, 0.5, 0.004, 0.9, "#101010", 0, 0.0, 0.0, k) for k, (v, t) in enumerate(at)], ROW)


def spans(spark, *of):
    return spark.createDataFrame(list(of), "video_id string, start double, end double")


def heads(spark, *ids, at="1"):
    return spark.createDataFrame([(v, "u" + v, at) for v in ids], "video_id string, url string, at string")


def seen(store, version=None):
    return sorted((r.video_id, r.t, r.x) for r in store.rows(version).collect())


@pytest.fixture
def store(spark, tmp_path):
    s = TrackStore(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.videos().isEmpty()
    s.save(rows(spark, ("a", 10.0), ("a", 11.0), ("a", 14.0), ("b", 1.0)), spans(spark, ("a", 10.0, 14.0), ("b", 0.0, 2.0)), heads(spark, "a", "b"))
    return s


def test_saves_merge_and_old_versions_stay(spark, store):
    assert store.save(rows(spark, ("a", 12.0), x=0.7), spans(spark, ("a", 11.0, 15.5)), heads(spark, "a", at="2")) == 2
    assert seen(store) == [("a", 10.0, 0.5), ("a", 12.0, 0.7), ("b", 1.0, 0.5)] and len(seen(store, 1)) == 4
    a = store.videos().where("video_id = 'a'").first()
    assert [tuple(s) for s in a.segments] == [(10.0, 15.5)] and (a.status, a.created_at, a.updated_at) == ("ready", "1", "2")
    store.save(rows(spark, ("a", 20.0)), spans(spark, ("a", 20.0, 21.0)), heads(spark, "a", at="3"), replace=True)
    assert seen(store) == [("a", 20.0, 0.5), ("b", 1.0, 0.5)]
    assert store.remove(spark.createDataFrame([("b",)], "video_id string")) == 4 and seen(store) == [("a", 20.0, 0.5)]
    assert len(store.vacuum(1)) == 2 and seen(store) == [("a", 20.0, 0.5)]


def test_a_crash_between_data_and_manifest_changes_nothing(spark, store, monkeypatch):
    before, videos = seen(store), store.videos().collect()

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(TrackStore, "_commit", crash)
    with pytest.raises(RuntimeError, match="lost"):
        store.save(rows(spark, ("a", 12.0)), spans(spark, ("a", 0.0, 50.0)), heads(spark, "a"))
    monkeypatch.undo()
    assert len(os.listdir(f"{store.path}/data")) == 2  # the data are there, but nobody reads them
    assert seen(store) == before and store.videos().collect() == videos and store.version() == 1
    store.save(rows(spark, ("a", 12.0)), spans(spark, ("a", 0.0, 50.0)), heads(spark, "a"))
    assert seen(store) == [("a", 12.0, 0.5), ("b", 1.0, 0.5)] and len(store.vacuum()) == 1


def test_two_savers_cannot_take_one_version(spark, store, monkeypatch):
    inner = merge.merge_tracks

    def meanwhile(*a, **k):
        monkeypatch.undo()
        TrackStore(spark, store.path).save(rows(spark, ("c", 1.0)), spans(spark, ("c", 0.0, 2.0)), heads(spark, "c"))
        return inner(*a, **k)

    monkeypatch.setattr(merge, "merge_tracks", meanwhile)
    with pytest.raises(StaleStoreError):
        store.save(rows(spark, ("a", 12.0)), spans(spark, ("a", 0.0, 50.0)), heads(spark, "a"))
    assert store.version() == 2 and [x[0] for x in seen(store)] == ["a", "a", "a", "b", "c"]


def test_bad_saves_are_refused(spark, store):
    before = seen(store)
    for r, s, said in (
        (rows(spark, ("a", 12.0, )), spans(spark, ("a", 14.0, 13.0)), "bad segment"), (rows(spark, ("z", 12.0)), spans(spark, ("a", 0.0, 50.0)), "z: rows of another video"), (rows(spark, ("a", 12.0)), spans(spark, ("y", 0.0, 50.0)), "y: segments of another video"),
        (rows(spark, ("a", 12.0), x=7.0), spans(spark, ("a", 0.0, 50.0)), "x/y out of"), (rows(spark).limit(0), spans(spark, ("a", 0.0, 50.0)), "no rows are left"),
    ):
        with pytest.raises(save.InvalidTrackError, match=said):
            store.save(r, s, heads(spark, "a"))
    assert store.version() == 1 and seen(store) == before


def test_only_named_saves_are_read(spark, store):
    store.save(rows(spark, ("c", 1.0)), spans(spark, ("c", 0.0, 2.0)), heads(spark, "c"))
    one = store.rows(of=spark.createDataFrame([("c",)], "video_id string"))
    assert sum("/data/" in f for f in one.inputFiles()) == 1 and [r.video_id for r in one.collect()] == ["c"]


def test_merging_different_videos_is_an_error(spark):
    old = {"rows": rows(spark, ("a", 1.0)).drop("pos"), "segments": spans(spark, ("a", 0.0, 2.0))}
    new = {"rows": rows(spark, ("a", 1.5)).drop("pos"), "segments": spans(spark, ("a", 1.4, 3.0))}
    got = merge.merge_tracks(old, new, strict=True)
    assert sorted(r.t for r in got["rows"].collect()) == [1.0, 1.5]
    with pytest.raises(ValueError, match="different videos: a"):
        merge.merge_tracks(old, {"rows": new["rows"], "segments": spans(spark, ("b", 1.4, 3.0))}, strict=True)
    with pytest.raises(ValueError, match="lack the column x"):
        merge.merge_tracks({**old, "rows": old["rows"].drop("x")}, new, strict=True)
    assert merge.merge_tracks({**old, "rows": old["rows"].drop("sl")}, new, strict=True)["rows"].where(F.col("sl") == 0).count() == 2
