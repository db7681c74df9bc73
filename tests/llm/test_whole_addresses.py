"""Archive records over whole addresses: every spelling of a page meets its captures."""

from noticework.llm.queries import captures
from noticework.llm.revisits import resolve_revisits


def test_spellings_of_one_page_meet(spark):
    pages = [(2, "http://A.example/x/?q=1#part", "<p>two"), (7, "https://b.example/y", "<p>seven"), (8, None, None), (9, "no address", "x"), (12, "http://c.example?z=%20", "<p>twelve")]
    made = captures(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["url"] for r in made.filter("record_id BETWEEN 8 AND 11").collect()} == {
        "http://A.example/x/?q=1&b=2&a=1#part", "HTTP://A.EXAMPLE/x/?q=1&a=1&b=2#again", "http://A.example/x/?q=1&a=1&utm_campaign=x&b=2", "http://A.example:443/x/?q=1&ref=home&b=2&a=1"}
    rows = {r["record_id"]: r for r in resolve_revisits(made).collect()}
    assert len(rows) == 20
    assert {rows[8 + i]["canonical_url"] for i in range(4)} == {"a.example/x?a=1&b=2&q=1"}
    assert (rows[9]["referred_id"], rows[9]["outcome"]) == (8, "validated") and (rows[11]["referred_id"], rows[11]["outcome"]) == (10, "validated")
    assert {rows[28 + i]["canonical_url"] for i in range(4)} == {"b.example/y"}
    assert all(rows[32 + i]["canonical_url"] is None for i in range(4)) and rows[33]["outcome"] == rows[35]["outcome"] == "orphan"
    # The changed page is asked for with the tag of its first capture.
    assert rows[51]["outcome"] == "mismatch" and rows[51]["referred_id"] == 50 and rows[49]["outcome"] == "validated"


def test_no_pages(spark):
    assert resolve_revisits(captures(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
