import re

from pyspark.sql import types as T

from trackspark.llm.license_scan import PHRASES, license_scan

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("h", T.LongType())])
GPL = "this work is licensed under the GNU General Public License, version 3."
ROWS = [
    (1, "Released under the MIT License. x y z", None, 1),
    (2, "The MIT license; the mit-license! APACHE License, Version 2.0 and CC BY-NC", None, None),
    (3, None, "clash", 3), (None, "", None, 3), (4, "nothing at all stands here", None, 3),
    (5, "lead in " * 40 + GPL + " tail", None, 3),
    (6, "lead " + GPL.replace("licensed", "now licensed").replace("General", ""), None, 3),
    (7, "the MIT licenſe, the mït license, the MIT lıcense, thé mit license, İ the mit license", None, 3),
    (8, "the mit license", None, 1), (8, "the mit license", None, 1), (8, "other text", None, 1),
    (9, "the mit " * 5 + "the mit license " * 3000, None, 0),
    (10, "general public license and permission is hereby", None, 0),
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({b for _, b in at}))


def test_base_equals_brute_force(spark):
    got = license_scan(spark.createDataFrame(ROWS, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)) == sorted(key((i, *brute(t))) for i, t, _, _ in ROWS)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notices(spark):
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[5].labels == "gpl-3" and got[5].score == 1.0
    assert got[6].labels in ("gpl-3", "") and got[4].labels == "" and got[4].score == 0.0
    assert got[10].labels == "" and got[1].labels == "mit"


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_phrases_are_the_contracts(spark):
    rows = [(1, "the MIT license", None, 0), (2, "x under the mit license, under the MIT-license", None, 0), (3, "under mit license", None, 0)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    key = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
    assert key(got[1]) == (3, 0, None, None, "", "mit")  # only the method's own label
    assert key(got[2]) == (9, 2, 1, 5, "mit", "mit")
    assert key(got[3]) == (3, 0, None, None, "", "")


def test_repeated_notice_keeps_its_label(spark):
    rows = [(1, "the mit license " * 20, None, 0)]
    assert [(r.n_base, r.labels, r.score) for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()] == [(0, "mit", 1.0)]
