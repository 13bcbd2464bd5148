"""The corpus-wide leak search looks for every customer's name."""

from textveil.plans import queries


def test_all_names_are_searched(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}", k % 5) for k in range(1, 24)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["corpus_leaks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, name) for k, name, _ in rows]
