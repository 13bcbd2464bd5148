"""Masking documents whose ids are missing or repeat."""

from textveil.operators import mask, restore
from textveil.plans import jobs

ROWS = [
    (None, "Name: Vorin Meklic\nmail vorin@example.com"),
    (None, "Name: Dara Pohl\nmail dara@example.com"),
    (None, None),
    (None, ""),
    (5, "Name: Ana Kovac\nmail ana@example.com"),
    (5, "Name: Bo Lindt\nmail bo@example.com"),
    (5, "Name: Ana Kovac\nmail ana@example.com"),
    (6, "plain words"),
]
NAMES = ("Vorin", "Dara", "Ana", "Bo Lindt", "example.com")


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_null_and_repeated_ids(spark):
    out, minted, _ = mask.mask_documents(frame(spark))
    released, held = mask.guard(out)
    got = released.collect()
    assert held.isEmpty() and sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, ROWS))
    for r in got:
        assert (r.masked_text or "").count("\n") == (r.text or "").count("\n")
        assert (r.masked_text is None) == (r.text is None) and not any(n in (r.masked_text or "") for n in NAMES)
        if r.doc_id is None and r.text:
            assert r.masked_text == "Name: <PERSON_001>\nmail <EMAIL_ADDRESS_001>"
    five = released.where("doc_id = 5").select("doc_id", "text", "masked_text")
    back = restore.restore(five, minted, ["doc_id"], text="masked_text").collect()
    assert len(back) == 3 and all(r.restored == r.text for r in back)


def test_round_trip_of_null_and_repeated_ids(spark):
    got = jobs.round_trip(frame(spark).where("text is not null")).collect()
    assert len(got) == len(ROWS) - 1 and {r.verdict for r in got} == {"identical"}


def test_guard_holds_rows_without_a_masked_text(spark):
    rows = [(1, "Ana", None, []), (2, None, None, []), (3, "", "", []), (4, "a", "a", None), (5, "a", "a", [])]
    released, held = mask.guard(spark.createDataFrame(rows, "i int, text string, masked_text string, leaks array<string>"))
    assert sorted(r.i for r in released.collect()) == [2, 3, 5] and sorted(r.i for r in held.collect()) == [1, 4]
