import hashlib

import pytest

from clipweave import (
    queries,
    questions_media,  # noqa: F401 - registers its queries
    questions_records,  # noqa: F401 - registers the others
)
from clipweave.sources.tables import table
from tests.oracle import differences

EVERY = sorted(queries.ORACLE)


@pytest.mark.parametrize("name", EVERY)
def test_query_equals_its_sql(spark, tiny, name):
    more, less = differences(queries.QUERIES[name](spark, tiny), queries.ORACLE[name], tiny)
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, tiny, name):
    assert queries.QUERIES[name](spark, tiny).count() > 0


def test_fingerprints_of_documents_of_any_length(spark, tmp_path):
    mib = 1 << 20
    texts = [None, "", "short é", "a" * mib, "é" * (mib // 2) + "b", "a" * (2 * mib), "a" * mib + "é" * (mib // 2) + "c", "xé" * mib]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")

    def want(t):
        b = t.encode()
        return hashlib.sha256(str(len(b)).encode() + b[:mib] + (b[-mib:] if len(b) > 2 * mib else b"")).hexdigest()

    q = queries.QUERIES["content_sha256"](spark, str(tmp_path))
    assert {r["doc_id"]: r["print"] for r in q.collect()} == {i: None if t is None else want(t) for i, t in enumerate(texts)}
    more, less = differences(q, queries.ORACLE["content_sha256"], str(tmp_path))
    assert not more and not less


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_signatures_and_tags_use_more_than_one_part(spark, tiny):
    signatures = [r["signature"] for r in queries.QUERIES["signature_text"](spark, tiny).collect()]
    assert max(len(s.split(" | ")) for s in signatures) == 7
    types = {r["type"] for r in table(spark, tiny, "clip_events").select("type").distinct().collect()}
    tags = [set(r["tags"].split(",")) for r in queries.QUERIES["local_tags"](spark, tiny).collect()]
    assert any(t & types for t in tags)
