"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import difference
from conftest import FOLDER

import __spark_entry__ as entry
from workload.oracle import ORACLES
from workload.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    rows = QUERIES[name](spark, FOLDER).toPandas()
    assert len(rows)
    assert difference(rows, con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "pos", "decode_pre", "encode", "decode_post"]
    assert found.count()


def test_outline_sums_in_order():
    import pyarrow as pa

    from workload.queries import _outline_sums

    rows = [[1.0, 2.0, 3.0], None, [1.0, None], [], [0.1] * 20]
    found = _outline_sums(pa.array(rows, pa.list_(pa.float64()))).to_pylist()
    assert found[0] == {"square": 14.0, "weighted": 14.0} and found[3] == {"square": 0.0, "weighted": 0.0}
    assert found[1] == found[2] == {"square": None, "weighted": None}
    total = 0.0
    for i, x in enumerate(rows[4]):
        total += x * (i % 7 + 1)
    assert found[4]["weighted"] == total
