"""Every query of the library proper, against its SQL on the smallest tables, and what the README promises of their plans."""

import pytest

from lamina.plans import catalogue


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, data, oracle, name):
    got = catalogue.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    rel = oracle.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0 or name == "residual_base64"  # nothing of the kind need be left there; residual_blobs_generated has some


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "type", "value", "severity", "mitre", "defanged_value"]


def test_scan_prunes_columns(spark, data):
    plan = catalogue.QUERIES["severity_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<analysis_id:bigint,severity:string>" in plan
    plan = catalogue.QUERIES["retention_beyond"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
