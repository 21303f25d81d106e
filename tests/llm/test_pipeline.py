import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import norm
from test_jaccard_join import SCHEMA, data, shingle_set

import corpus_pipeline as P
from trackspark.llm.decontaminate import edit_distance
from trackspark.llm.jaccard_join import one_of_each
from trackspark.llm.queries import public_tokenizer

SF = "/root/testdata/sf0.001"


def test_one_of_each(spark):
    rows = data(1, groups=6)
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    left = one_of_each(df)
    got = left.collect()
    assert left.columns == df.columns
    own = [(r.doc_id, shingle_set(r.text)) for r in got]
    assert sum(not s for _, s in own) == sum(not shingle_set(r[1]) for r in rows)
    full = [s for _, s in own if s]
    assert not any(100 * len(a & b) >= 85 * len(a | b) for k, a in enumerate(full) for b in full[k + 1 :])
    # whatever went has a relative that stayed, and the smallest identifier of all stays
    assert 0 in {i for i, _ in own} and len(got) < len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    state = docs
    seen = []
    for name, stage in P.STAGES:
        state = P.storage.table(stage(spark, state, SF))
        seen.append(state)
        if name != P.STAGES[-1][0]:
            assert state.columns == docs.columns
    kept = {r.doc_id for r in seen[0].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    assert set(texts) <= kept
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen[2].collect()}
    assert clean <= set(texts) and not any(x in (texts[i] or "") for i in clean for x in items)
    own = [(x, int(0.1 * len(x))) for x in map(norm, items)]
    for i in set(texts) - clean:  # whatever went holds an item within its edits
        assert any(edit_distance(x, norm(texts[i]), most) <= most for x, most in own), i
    copies = collections.Counter(r.doc_id for r in seen[3].collect())
    assert set(copies) <= clean and max(copies.values()) <= 2
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(public_tokenizer()), 0, []
    for i in sorted(copies):
        for _ in range(copies[i]):
            ids = tok.encode(texts[i], add_special_tokens=False).ids + [2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, seen[4].collect())) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_run_equals_the_stages(spark):
    assert P.run(spark, SF).agg(F.count("*")).first()[0] > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_stages_keep_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated and empty rows, and columns named like those that operators add meanwhile."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(None,) * 5, (7, None, None, None, 0), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "same words here " * 9, None, None, 0), (8, "same words here " * 9, None, None, 0)]
    names = ("stays", "x_v", "rate", "copies", "_key", "size", "quality", "item_id")
    state = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(c) for c in names})
    columns = state.columns
    for name, stage in P.STAGES:
        out = P.storage.table(stage(spark, state, SF))
        if name != P.STAGES[-1][0]:
            assert out.columns == columns and out.where(" OR ".join(f"{c} <> '{c}'" for c in names)).count() == 0
            state = out
    assert out.count() == state.count() > 0
    empty = state.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
