import datetime as dt

from glossmeter.llm import url_lists as U

D = dt.date


def test_entries_active_at_fetch_time(spark):
    entries = spark.createDataFrame([
        ("bad", "d:a.com", D(2023, 1, 10), True), ("bad", "d:a.com", D(2023, 2, 1), False), ("bad", "d:a.com", D(2023, 3, 1), True),
        ("bad", "d:a.com", D(2023, 3, 1), False),            # the entry wins on a day with both
        ("path", "p:www.b.org/x/y", D(2023, 1, 1), True), ("other", "d:com", D(2023, 6, 1), True), (None, "d:c.net", D(2020, 1, 1), True),
        ("bad", "d:c.net", None, True)], "list string, pattern string, day date, active boolean")
    rows = [(1, "http://a.com/", D(2023, 1, 9)), (2, "http://www.A.com:80/q", D(2023, 1, 10)), (3, "https://a.com", D(2023, 2, 1)),
            (4, "http://u:p@a.com/?x=1", D(2023, 3, 1)), (5, "http://nota.com/", D(2023, 1, 15)), (6, "http://www.b.org//x/y/z#f", D(2023, 5, 1)),
            (7, "http://www.b.org/x", D(2023, 5, 1)), (8, "http://a.com/1", D(2023, 7, 1)), (9, None, D(2023, 7, 1)), (10, "http://a.com", None),
            (11, "not a url", D(2023, 7, 1)), (12, "http://c.net/", D(2023, 7, 1)), (2, "http://www.A.com:80/q", D(2023, 1, 10)),
            (13, "http://a.com/" + "p/" * 20_000, D(2023, 1, 11))]
    captures = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, fetch_day date, pattern string")
    got = [(r["page_id"], r["blocked"], r["n_entries"], r["lists"]) for r in U.judge(captures, entries).collect()]
    want = {1: (False, 0, ""), 2: (True, 1, "bad"), 3: (False, 0, ""), 4: (True, 1, "bad"), 5: (False, 0, ""), 6: (True, 1, "path"),
            7: (False, 0, ""), 8: (True, 2, "bad,other"), 9: (False, 0, ""), 10: (False, 0, ""), 11: (False, 0, ""), 12: (False, 0, ""),
            13: (True, 1, "bad")}
    assert sorted(got) == sorted([(i, *v) for i, v in want.items()] + [(2, *want[2])])
    assert U.judge(captures.limit(0), entries).count() == 0
    assert {r["blocked"] for r in U.judge(captures, entries.limit(0)).collect()} == {False}
