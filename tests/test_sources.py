import json

import numpy as np
import pytest

from trackspark.sources import expand, frames, tracks

FIELDS = ["t", "x", "y", "r", "conf", "ring", "flags", "sl", "sa", "note"]
DOCS = [
    {"video_id": "a", "fields": FIELDS, "frames": [[k / 25, 0.5, 0.25, 0.004, 0.9, "#F5f5F5", k, 0.1, -1.5, {"x": [1, "]"]}] for k in range(300)]},
    {"frames": [[1, 2], [], [None, None, None], [3, "0.5", 1.5, 9]], "fields": ["y", "t", "flags"], "video_id": "b"},
    {"video_id": "c", "fields": ["t", "ring", "sl"], "frames": [[1, "red", -1], [2, None, 0.5], [3, 7, None]]},
    {"video_id": "d", "fields": ["t"], "frames": []},
    {"video_id": "e", "fields": None, "frames": [[1]]},
    {"video_id": "f", "frames": [[1]]},
    {"video_id": "g", "fields": ["t", "t"], "frames": [[1, 2]], "other": {"frames": [[5]], "s": 'a "quoted" ]}'}},
    {"video_id": "h", "fields": ["flags", "t"], "frames": [[257, 1e3], [-1, -2.5], [2.0, 1]]},
]
ODD = [None, "", "{", "[]", "nonsense", '{"fields": ["t"], "frames": [[1],]}']


def test_table_function_equals_the_scan(spark):
    docs = spark.createDataFrame([(json.dumps(d, indent=k % 3 or None),) for k, d in enumerate(DOCS)] + [(d,) for d in ODD], "doc string")
    docs = docs.selectExpr("doc", "try_variant_get(try_parse_json(doc), '$.video_id', 'string') AS video_id")
    got = sorted(map(tuple, expand.expanded(docs, ["video_id"]).select("video_id", "pos", *FIELDS[:-1]).collect()), key=str)
    want = sorted(map(tuple, tracks.rows(docs).select("video_id", "pos", *FIELDS[:-1]).collect()), key=str)
    assert got == want and len(got) > 300


def test_table_function_in_sql(spark):
    expand.register(spark)
    spark.createDataFrame([(json.dumps(DOCS[0]),)], "doc string").createOrReplaceTempView("some_docs")
    assert spark.sql("SELECT count(*) FROM some_docs, LATERAL expand_track(doc) r").first()[0] == 300


def test_table_function_keeps_no_rows():
    assert list(expand.ExpandTrack().eval('{"fields": ["t"], "frames": [[1]]} x')) == []  # more than one document
    doc = '{"fields": ["t"], "frames": [' + ", ".join(f"[{k}]" for k in range(50_000)) + "]}"
    rows = expand.ExpandTrack().eval(doc)
    assert [next(rows)[1] for _ in range(3)] == [0.0, 1.0, 2.0] and sum(1 for _ in rows) == 49_997


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("frames")
    r = np.random.default_rng(1)
    for name, n, pts in (("a", 50, None), ("b", 30, [0.5 + k * 0.08 for k in range(30)][::-1]), ("c", 10, [1.0])):
        (out / f"{name}.frames").write_bytes(frames.packed(name, 6, 4, 25.0, [r.bytes(72) for _ in range(n)], pts))
    return str(out)


def test_frames_and_times(spark, folder):
    got = {(x.video_id, x.frame): x for x in frames.read_frames(spark, folder, part_bytes=72 * 7).collect()}
    assert len(got) == 90 and got["a", 49].t == 49 / 25 and got["b", 0].t == 0.5 and got["b", 29].t == pytest.approx(0.5 + 29 * 0.08) and got["c", 9].t == 9 / 25
    raw = open(f"{folder}/b.frames", "rb").read()
    assert got["b", 17].rgb == raw[-72 * 13 : -72 * 12] and (got["b", 17].h, got["b", 17].w) == (4, 6)


def planned(folder, *filters, **options):
    r = frames.FrameReader({"path": folder, "partBytes": str(72 * 7), **options})
    assert list(r.pushFilters(list(filters))) == list(filters)
    return [(p.head.video_id, p.first, p.last) for p in r.partitions() if isinstance(p, frames.Part)]


def test_only_asked_ranges_are_read(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

    assert planned(folder, EqualTo(("video_id",), "a"), GreaterThanOrEqual(("frame",), 10), LessThan(("frame",), 20)) == [("a", 10, 17), ("a", 17, 21)]
    assert planned(folder, In(("video_id",), ("c", "x")), GreaterThan(("t",), 0.31)) == [("c", 8, 10)]
    assert planned(folder, EqualTo(("frame",), 70)) == []
    assert planned(folder, start="0.5", end="0.58") == [("a", 13, 15), ("b", 0, 1)]
    # half-open, with a tolerance at both ends
    assert planned(folder, EqualTo(("video_id",), "a"), start=str(0.2 + 5e-7), end=str(0.4 + 5e-7)) == [("a", 5, 10)]


def test_filters_reach_the_source(spark, folder):
    df = frames.read_frames(spark, folder, part_bytes=72 * 7).where("video_id = 'a' AND frame BETWEEN 10 AND 19")
    assert sorted(x.frame for x in df.collect()) == list(range(10, 20)) and df.rdd.getNumPartitions() == 2


def test_empty_range_is_an_error(spark, folder):
    with pytest.raises(Exception, match="no frames in"):
        frames.read_frames(spark, folder, 90.0, 95.0).collect()
    assert frames.read_frames(spark, folder).where("frame > 1000").collect() == []


def test_written_files_read_back(spark, folder, tmp_path):
    whole = frames.read_frames(spark, folder)
    got = frames.write_frames(whole.repartition(5), str(tmp_path / "out"), 25.0, times=True).collect()
    assert sorted((x.video_id, x.n) for x in got) == [("a", 50), ("b", 30), ("c", 10)]
    again = frames.read_frames(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(Exception, match="out of turn"):
        frames.write_frames(whole.where("frame <> 3"), str(tmp_path / "bad"), 25.0).collect()
