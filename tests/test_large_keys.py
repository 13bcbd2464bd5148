"""Records whose numbers have thirteen digits: some are cards by their check digit."""

from test_queries import plain

from textveil.plans import queries


def test_numbers_that_are_cards(spark, tmp_path):
    import duckdb

    spark.range(200_000, 200_200).selectExpr("id as c_custkey", "'Customer#' || lpad(cast(id as string), 9, '0') as c_name", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.sql(queries.ORACLES["mask_records"]).df()
    assert 5 < want["masked_text"].str.contains("<CREDIT_CARD_001>").sum() < 50
    assert plain(queries.QUERIES["mask_records"](spark, str(tmp_path)).toPandas()) == plain(want)
