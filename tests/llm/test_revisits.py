from procframe.llm import revisits

RECORDS = "record_id long, url string, time long, revisit boolean, etag string, date long, status int, digest string, headers map<string,string>"
PAGE = {"Content-Type": "text/html", "Content-Length": "7", "Last-Modified": "Mon", "Date": "d1", "Cache-Control": "no-store"}


def resolved(spark, rows):
    return {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}


def test_headers_are_merged(spark):
    again = {"DATE": "d2", "Cache-control": "max-age=1", "Content-Length": "0", "Content-Type": "text/plain", "X-New": "1", "Expires": "e"}
    got = resolved(spark, [(1, "a.example", 1, False, "e", 1, 200, "sha", PAGE), (2, "a.example", 9000, True, 'e', 2, 304, None, again), (3, "a.example", 9001, True, "other", 3, 304, None, again)])
    assert (got[2].source_id, got[2].status, got[2].digest, got[2].etag, got[2].date) == (1, 200, "sha", "e", 2)
    assert got[2].headers == {"content-type": "text/html", "content-length": "7", "last-modified": "Mon", "date": "d2", "cache-control": "max-age=1", "expires": "e"}
    assert (got[3].source_id, got[3].resolved, got[3].status) == (None, False, 304)
    assert got[3].headers == {k.lower(): v for k, v in again.items()}


def test_every_validator_counts(spark):
    first = (1, "a.example", 1, False, "W/e", 1, 200, "sha", PAGE)
    asked = [
        ("e", None, None, True), (None, None, {"last-modified": "Mon"}, True), (None, "sha", None, True), (None, None, {"ETag": "e"}, True), ("e", "sha", {"Last-Modified": "Mon"}, True),
        (None, None, {"last-modified": "Tue"}, False), (None, "other", None, False), ("e", "other", None, False), ("e", None, {"Last-Modified": "Tue"}, False), (None, None, None, False), (None, None, {}, False), ("f", "sha", None, False),
    ]
    got = resolved(spark, [first] + [(i, "a.example", i, True, etag, i, 304, digest, headers) for i, (etag, digest, headers, _) in enumerate(asked, 2)])
    assert [got[i].resolved for i in range(2, len(asked) + 2)] == [x[-1] for x in asked]
    assert got[3].etag == "W/e"


def test_no_validator_on_either_side_is_no_agreement(spark):
    got = resolved(spark, [(1, "a.example", 1, False, None, 1, 200, None, None), (2, "a.example", 2, True, None, 2, 304, None, None)])
    assert (got[2].source_id, got[2].resolved, got[2].headers) == (None, False, None)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, "a.example", None, False, "e", 1, 200, None, None), (2, "a.example", 5, True, "e", 2, 304, None, None), (3, "a.example", None, True, "e", 3, 304, None, None),
        (4, "b.example", 7, None, "e", 4, 200, None, None), (5, "b.example", 7, True, "e", 5, 304, None, None), (5, "b.example", 7, True, "e", 5, 304, None, None), (None, "b.example", 7, True, "e", 6, 304, None, None),
    ]
    got = sorted((-1 if r.record_id is None else r.record_id, r.revisit, r.source_id, r.resolved) for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect())
    assert got == [(-1, True, None, False), (1, False, None, True), (2, True, None, False), (3, True, None, False), (4, False, None, True), (5, True, 4, True), (5, True, 4, True)]


def test_the_latest_earlier_response_by_brute_force(spark):
    """A hot URL over many blocks of time, by a walk through its records."""
    import random

    pick = random.Random(4)
    rows = [(i, pick.choice(["http://hot.example/", "hot.example", "x.example/a"]), pick.randrange(40_000), pick.random() < 0.7, pick.choice(["a", "b", None]), i, 200, pick.choice(["d", None]), None) for i in range(300)]
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        place = r[1].removeprefix("http://").rstrip("/")
        if not r[3]:
            want[r[0]], last[place] = None, r
            continue
        s = last.get(place)
        known = [(x, y) for x, y in ((r[4], s[4]), (r[7], s[7])) if x is not None and y is not None] if s else []
        want[r[0]] = s[0] if known and all(x == y for x, y in known) else None
    got = resolved(spark, rows)
    assert {i: got[i].source_id for i in got} == want


def test_the_query_meets_every_outcome(spark):
    pages = spark.createDataFrame([(i, f"http://{'hot' if i % 3 else 'b'}.example/{i}", "é" * i) for i in range(400)], "page_id long, url string, html string")
    got = [r for r in revisits.resolve(revisits.captures(pages)).collect() if r.revisit]
    own = [r for r in got if r.source_id == r.record_id // 4 * 4]
    others = [r for r in got if r.source_id is not None and r.source_id != r.record_id // 4 * 4]
    assert len(own) > 100 and [r for r in got if not r.resolved] and all(r.status == 200 for r in own + others)
    assert all(r.headers["content-length"] == str(r.source_id // 2) for r in own + others)
