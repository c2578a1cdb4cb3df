from __future__ import annotations

import hashlib
import io
import os
import re

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from framewright.llm import warc

SCHEMA = "page_id long, url string, html string, first int, payload string, shared int"
LONG = "<p>ü</p>" * 40
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (None, "http://a/n", LONG),
    (1, "http://a/1", "short"), (2, "http://a/2", "short"), (4, "http://a/4", None), (6, "http://a/6", ""),
    (7, "http://a/7 x\r\nWARC-Type: fake", "x" * 99), (8, "http://a/8", "x" * 99), (10, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "y" * 100),
    (12, "http://a/12", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5), (13, "http://a/13", "z" * 3_000_000), (14, "http://a/14", "z" * 3_000_000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)


def expected(rows):
    least = {}
    for page, _, html in rows:
        if html and page is not None:
            least[html] = min(page, least.get(html, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html)
        again = len(raw) >= 100 and first is not None and first != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("zipped", [True, False])
def test_pages_round_trip(spark, tmp_path, zipped):
    path = f"file://{tmp_path}/archives"
    warc.write_warc(warc.page_records(pages(spark).repartition(3)), path, zipped, file_bytes=2000)
    names = [n for n in os.listdir(tmp_path / "archives") if not n.startswith((".", "_"))]
    assert len(names) >= 3 and all(n.endswith(".warc.gz" if zipped else ".warc") for n in names)
    got = warc.read_pages(spark, path).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(ROWS)
    # Whole payloads, and headers that no url can forge.
    whole = warc.read_warc(spark, path).collect()
    assert {r.payload.decode() for r in whole if r.record_type == "response"} == {h or "" for _, _, h in ROWS}
    assert all(r.payload is None and r.headers["warc-profile"] for r in whole if r.record_type == "revisit")
    assert {r.record_type for r in whole} == {"response", "revisit"}
    assert {r.target_uri for r in whole} >= {None, "http://a/7%20x%0D%0AWARC-Type:%20fake"}


def test_predicates_reach_the_source(spark, tmp_path):
    path, columns = f"file://{tmp_path}/archives", "record_id string, record_type string, content_length long"
    warc.write_pages(pages(spark), path)
    where = "record_type = 'revisit' AND content_length > 10 AND record_id IN ('urn:page:5', 'urn:page:9', 'urn:page:1')"
    chosen = warc.read_warc(spark, path, columns, where)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Filter (monotonically_increasing_id() >= 0)" in plan and "revisit)" not in plan  # the source has taken all of it
    assert sorted(r.record_id for r in chosen.collect()) == ["urn:page:5", "urn:page:9"]


def test_one_reader_for_many_queries(spark, tmp_path):
    """What one query filters by is nothing to another of the same table, nor to the other side of a join."""
    path = f"file://{tmp_path}/archives"
    warc.write_pages(pages(spark), path)
    found = warc.read_warc(spark, path, "record_id string, record_type string, refers_to string")
    again = len([r for r in expected(ROWS) if r[3] == "revisit"])
    for _ in range(2):
        assert found.filter("record_id = 'urn:page:5'").count() == 1
        assert found.count() == len(ROWS)
        assert found.filter("record_type = 'revisit' OR record_id = 'x'").count() == again
    first = found.filter("record_type = 'response'").select("record_id").distinct()
    assert found.filter("record_type = 'revisit'").join(first.withColumnRenamed("record_id", "refers_to"), "refers_to").count() == again


def archive(zipped=False):
    records = [warc.record_bytes("response", f"urn:page:{k}", f"http://a/{k}", warc.DATE, None, "d", 50, b"p" * 50) for k in range(10)]
    return b"".join(records)


def test_unwanted_payloads_are_not_read():
    tests = [warc.header_test(EqualTo(("record_id",), "urn:page:7"))]
    seen = {}
    rows = list(warc.records(io.BytesIO(archive()), True, ["record_id", "payload"], tests, seen))
    assert rows == [{"record_id": "urn:page:7", "payload": b"p" * 50}]
    assert seen == {"records": 10, "payload_bytes": 50}
    seen = {}
    rows = list(warc.records(io.BytesIO(archive()), True, ["record_id", "payload_bytes"], [], seen))
    assert [r["payload_bytes"] for r in rows] == [50] * 10 and "payload_bytes" not in seen


def test_which_predicates_are_taken():
    taken = [In(("record_type",), ("revisit",)), StringStartsWith(("target_uri",), "http"), GreaterThan(("content_length",), 5)]
    assert all(warc.header_test(f) for f in taken)
    left = [EqualTo(("payload_digest",), "x"), EqualTo(("headers", "warc-type"), "x"), GreaterThan(("payload_bytes",), 5)]
    assert not any(warc.header_test(f) for f in left)
    assert not warc.header_test(taken[1])({"warc-type": "response"})


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("columns", [["record_id"], ["payload"]])
def test_cut_off_file_fails(zipped, columns):
    whole = archive()
    with pytest.raises(ValueError, match="cut off|no record"):
        list(warc.records(io.BytesIO(whole[: len(whole) // 2 - 30]), not zipped, columns, []))


def test_folded_and_foreign_headers():
    raw = b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:x:1>\nX-Note: one\n  two\nContent-Type: text/plain\nContent-Length: 3\n\nabc\n\n"
    (row,) = warc.records(io.BytesIO(raw), True, ["record_type", "headers", "payload"], [])
    assert (row["record_type"], row["headers"]["x-note"], row["payload"]) == ("resource", "one two", b"abc")


def test_plan_keeps_files_whole():
    parts = warc.planned([(f"f{k}", 10) for k in range(7)] + [("big", 1000)], 30)
    assert sorted(p for part in parts for p in part.paths) == sorted([*(f"f{k}" for k in range(7)), "big"])
    assert all(len(p.paths) <= 3 for p in parts) and ("big",) in [p.paths for p in parts]


def test_empty_table_and_unfinished_files(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_pages(pages(spark, []), path)
    assert warc.read_pages(spark, path).collect() == []
    (tmp_path / "none" / "_pending-1").write_bytes(archive()[:100])
    assert warc.read_pages(spark, path).collect() == []


def test_unknown_column_is_named(spark, tmp_path):
    with pytest.raises(Exception, match=re.escape("['nothing']")):
        warc.read_warc(spark, f"file://{tmp_path}", "nothing string").collect()
