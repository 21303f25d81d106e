import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from trackspark.llm import exact_dedup as E

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("g", T.LongType())])
LOW = str.maketrans(E.UPPER, E.LOWER)


def rows():
    r = random.Random(3)
    base = ["", "A", "a", "é", "É", "x" * E.WIDTH, "x" * (E.WIDTH + 1), "X" * E.WIDTH, "long words " * 4000, "Long words " * 4000, "long words " * 3999 + "long wordz ", "é" * 200 + "a", "é" * 200 + "b", "İ", "tail " * 60 + "A", "tail " * 60 + "b"]
    out = [(k, r.choice(base), "x", k % 3) for k in range(300)]
    out += [(1000 + k, "hot text " * 30, None, None) for k in range(200)]
    out += [(5, "same id", None, None), (5, "SAME ID", None, None), (5, "other", None, None), (None, "null id", None, None), (None, "null id", "", 1), (None, "a", None, None), (10**15, None, None, None), (10**15, None, None, None)]
    return out + [(2000 + k, "".join(r.choice("aAbB") for _ in range(r.randrange(6))), None, None) for k in range(300)]


def brute(data):
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[(t or "").translate(LOW)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        kept = ids.index(keep)
        out += [(d, keep, len(ids), k == kept, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    data = rows()
    got = E.exact_groups(spark.createDataFrame(data, SCHEMA).repartition(parts)).collect()
    assert Counter(map(tuple, got)) == Counter(brute(data))


def test_digits_beyond_the_first_tell_texts_apart(spark, monkeypatch):
    monkeypatch.setattr(E, "WIDTH", 2)
    monkeypatch.setattr(E, "GROW", 2)
    data = rows()
    assert Counter(map(tuple, E.exact_groups(spark.createDataFrame(data, SCHEMA)).collect())) == Counter(brute(data))


def test_keeps_rows_as_they_were(spark):
    data = [(1, "A b", "r1", 1), (2, "a B", "r2", 2), (3, None, None, None), (4, "c", "r4", 4)]
    got = E.without_copies(spark.createDataFrame(data, SCHEMA))
    assert got.schema == SCHEMA and sorted(map(tuple, got.collect())) == data[1:]


def test_empty_table(spark):
    assert E.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert E.without_copies(spark.createDataFrame([], SCHEMA)).columns == SCHEMA.names


def test_sql_twin(spark, tmp_path):
    data = [x for x in rows() if x[0] is not None and x[0] not in (5, 10**15)]
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = E.exact_groups(docs)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({E.SQL})").fetchall())
