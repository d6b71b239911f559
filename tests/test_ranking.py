import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clickloom.operators.ranking import Score, _tile_ends, add_ntiles
from frames import rows


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (5, 5), (7, 5), (12, 5), (13, 10), (100, 10), (101, 10), (1000, 7)])
def test_tile_ends_match_ntile(n, k):
    tiles = [t for (t,) in duckdb.sql(f"SELECT ntile({k}) OVER (ORDER BY i) FROM range({n}) r(i) ORDER BY i").fetchall()]
    ends = _tile_ends(n, k)
    assert tiles == [1 + sum(end < rank for end in ends) for rank in range(1, n + 1)]


@pytest.mark.parametrize("n,k,distinct", [(4, 5, 2), (12, 5, 3), (1003, 5, 1), (1003, 10, 40), (2000, 5, 5000)])
def test_ntiles_with_ties(spark, n, k, distinct):
    random.seed(n * k)
    data = [(i, float(random.randrange(distinct)), random.randrange(distinct)) for i in range(n)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "id long, a double, b long").repartition(5)
    got = add_ntiles(df, [Score("ta", F.col("a")), Score("tb", -F.col("b"))], "id", k)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, a DOUBLE, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", data)
    want = con.execute(
        f"SELECT id, ntile({k}) OVER (ORDER BY a, id), ntile({k}) OVER (ORDER BY b DESC, id) FROM t"
    ).fetchall()
    assert sorted(rows(got.select("id", "ta", "tb"))) == sorted(want)


def test_ntiles_with_text_ids(spark):
    df = spark.createDataFrame([(f"s{i}", 0.5) for i in range(25)], "id string, p double")
    got = dict(rows(add_ntiles(df, [Score("tile", -F.col("p"))], "id", 10).select("id", "tile")))
    for position, name in enumerate(sorted(got)):
        assert got[name] == (position // 3 + 1 if position < 15 else 6 + (position - 15) // 2)


def test_ntiles_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert add_ntiles(df, [Score("t", F.col("a"))], "id", 5).count() == 0
