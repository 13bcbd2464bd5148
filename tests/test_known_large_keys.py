"""One vault for records whose numbers have thirteen digits: cards by their check digit and national ids are numbered apart."""

import re

from textveil.plans import queries


def is_card(number):
    d = [int(c) for c in number]
    luhn = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d), 1)) % 10 == 0
    rest = 11 - sum(x * w for x, w in zip(d, [7, 6, 5, 4, 3, 2] * 2)) % 11
    return number[0] in "123456" and luhn and (rest if rest < 10 else 0) != d[12]


def test_cards_and_national_ids_are_numbered_apart(spark, tmp_path):
    spark.range(200_000, 200_200).selectExpr("id as c_custkey", "'Customer#' || lpad(cast(id as string), 9, '0') as c_name", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(200_000, 200_200).where("id % 3 <> 0").selectExpr("id as o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    want, top = {}, {"CREDIT_CARD": 0, "NATIONAL_ID": 0}
    for key in sorted(range(200_000, 200_200), key=lambda k: (k % 3 == 0, k)):
        kind = "CREDIT_CARD" if is_card(f"{key * 7654321 + 1234567:013d}") else "NATIONAL_ID"
        top[kind] += 1
        want[key] = f"<{kind}_{top[kind]:03d}>"
    got = queries.QUERIES["mask_corpus_known"](spark, str(tmp_path)).collect()
    assert {r.doc_id: re.search(r"ID number: (\S+)", r.masked_text)[1] for r in got} == want and len(got) == 200
    assert top["CREDIT_CARD"] > 5 and not any(r.n_leaks for r in got)
