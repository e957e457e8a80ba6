import pytest

from treelens.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE[name])


def test_report_is_json(spark):
    import json

    from conftest import SF_DIR

    rows = queries.QUERIES["report_json"](spark, SF_DIR).collect()
    assert rows and all(set(json.loads(r.json)) >= {"project_id", "total_files"} for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
