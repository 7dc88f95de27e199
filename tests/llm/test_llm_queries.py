"""The numbered queries next to their SQL on the smallest tables."""

import zlib
from pathlib import Path

import pytest
from compare import compare, duck

from tapeline.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name, remainder, of, kinds", [
    ("op4_toxicity", 1, 3, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op5_langid", 0, 5, {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
])
def test_held_out_rows_of_the_registered_query(spark, name, remainder, of, kinds):
    """Columns, types, one row a document, the held-out mark by checksum of the id."""
    out = QUERIES[name](spark, SF)
    assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == kinds
    rows = out.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == remainder) and 0 <= r.score <= 1 for r in rows)
    if name == "op4_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    else:
        assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}
