"""Archives: appended and overwritten writes, pushed predicates, and revisits without any payload meeting another."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith

from ledgerline.llm import warc
from ledgerline.llm.common import new_path

PAGES = "page_id long, url string, html string"


def pages(spark, first, n):
    return spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}") for k in range(first, first + n)], PAGES)


def ids(spark, path):
    return sorted(r["record_id"] for r in warc.read(spark, path, "headers").filter("record_type = 'response'").collect())


def test_appended_archives_add_up_and_overwritten_ones_go(spark):
    path = new_path(spark, "warc")
    warc.write(warc.records(pages(spark, 0, 10)), path)
    warc.write(warc.records(pages(spark, 10, 10)), path)
    assert ids(spark, path) == sorted(f"<urn:page:{k}>" for k in range(20))
    warc.write(warc.records(pages(spark, 50, 3)), path, "overwrite")
    assert ids(spark, path) == sorted(f"<urn:page:{k}>" for k in range(50, 53))
    warc.write(warc.records(pages(spark, 0, 0)), path)
    assert len(ids(spark, path)) == 3


HEADERS = [{"warc-type": "response", "warc-target-uri": "http://b", "warc-date": "2020"}, {"warc-type": "revisit"}, {"warc-type": "warcinfo", "warc-target-uri": "ftp://a", "warc-date": "2021"}]


@pytest.mark.parametrize(("test", "want"), [
    (EqualTo(("record_type",), "revisit"), [1]), (Not(EqualTo(("target_uri",), "http://b")), [2]), (In(("record_type",), ("revisit", "warcinfo")), [1, 2]),
    (StringStartsWith(("target_uri",), "http"), [0]), (GreaterThan(("warc_date",), "2020"), [2]), (IsNull(("target_uri",)), [1]), (IsNotNull(("target_uri",)), [0, 2]),
])
def test_predicates_decide_by_headers(test, want):
    reader = warc.WarcReader("x", "headers")
    assert list(reader.pushFilters([test])) == []
    assert [k for k, h in enumerate(HEADERS) if reader.wanted(h)] == want


def test_other_predicates_stay_with_spark():
    reader = warc.WarcReader("x", "headers", {"content-type": "a/b"})
    tests = [EqualTo(("payload_bytes",), 1), EqualTo(("headers", "x"), "y"), Not(EqualTo(("payload_digest",), "z"))]
    assert list(reader.pushFilters(tests)) == tests
    assert reader.wanted({"content-type": "a/b"}) and not reader.wanted({"content-type": "c"}) and not reader.wanted({})


def test_any_header_may_be_asked_for(spark, tmp_path):
    records = [warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<r:{k}>", "Content-Type": t, "X-Own": "é 1"}, b"z") for k, t in enumerate(("text/plain", "image/png", "text/plain"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    warc.register(spark)
    got = spark.read.format("warc").option("content", "headers").option("header.Content-Type", "text/plain").option("header.x-own", "é 1").load(f"file://{tmp_path}")
    assert sorted(r["record_id"] for r in got.collect()) == ["<r:0>", "<r:2>"]
    plan = got.filter("record_id >= '<r:1>' and target_uri is null")
    assert [r["record_id"] for r in plan.collect()] == ["<r:2>"]


@pytest.mark.parametrize("most", [0, 10**6])
def test_revisits_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
    big, other = "x" * 1500, "é" * 500
    rows = [(k, f"u{k % 7}", (big, other, "small", big + str(k % 3), None)[k % 5]) for k in range(60)] + [(None, "n", big), (None, "n", big), (None, None, "y" * 2000), (None, None, "y" * 2000), (59, "u", big), (55, "v", big), (55, "v", big)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("of", F.lit(1)).withColumn("top", F.lit(2)))
    top = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in rows:
        again = h in top and (i is None or i < top[h])
        want.append((i, len((h or "").encode()), "revisit" if again else "response", top[h] if again else None))
    assert sorted(map(str, [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()])) == sorted(map(str, want))
