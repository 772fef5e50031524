import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lattico.llm import warc

PAGES = [
    (1, "http://a/x y", "<p>hi</p>"), (2, "http://a/2", "<p>hi</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://b", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (6, None, "same"), (None, "http://n", "same"), (7, "http://long", "z" * 300_000), (5, "http://b2", "other"), (8, "u", "twice"), (8, "u", "twice"),
]


def expected(pages):
    newest = {}
    for i, _, h in pages:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in pages:
        h = (h or "").encode()
        first = newest[h.decode()]
        mine = i == first or (i is None and first == -1)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if mine else "revisit", None if mine else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, copies string")
    warc.write_archive(warc.captures(df), str(tmp_path / "w"), compression)
    records = warc.read_archive(spark, str(tmp_path / "w"))
    assert records.groupBy("warc_type").count().count() == 4 and records.select("record_id").distinct().count() == records.count()
    captured = warc.assemble(records)
    rows = captured.collect()
    assert len(rows) == len(PAGES) and records.count() == 3 * len(PAGES)  # equal rows too are records of their own
    assert all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in rows)
    responses = {r["record_id"]: r["payload_digest"] for r in rows if r["record_type"] == "response"}
    assert all(responses[r["refers_to"]] == r["payload_digest"] for r in rows if r["record_type"] == "revisit")
    payloads = {bytes(r["response"]).split(b"\r\n\r\n", 1)[1] for r in rows if r["record_type"] == "response"}
    assert payloads == {(h or "").encode() for _, _, h in PAGES}
    assert all(r["read_digest"] == r["payload_digest"] for r in rows if r["record_type"] == "response")
    assert sorted((tuple(r) for r in warc.page_digests(captured).collect()), key=repr) == expected(PAGES)


def test_a_crowd_of_equal_pages(spark, tmp_path):
    df = spark.range(3000).select(F.lit(7).alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html")).unionByName(spark.createDataFrame([(9, "v", "same"), (3, "w", None)], "page_id long, url string, html string"))
    warc.write_archive(warc.captures(df.repartition(13)), str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    assert records.select("record_id").distinct().count() == records.count() == 3 * 3002
    got = {tuple(r): n for *r, n in warc.page_digests(warc.assemble(records)).groupBy("page_id", "record_type", "refers_to").count().collect()}
    assert got == {(7, "revisit", 9): 3000, (9, "response", None): 1, (3, "response", None): 1}


def test_least_size(spark):
    got = {(r["id"], r["kind"]) for r in warc.captures(spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "yyyy"), (4, "a", "yyyy")], "page_id long, url string, html string"), least=3).collect()}
    assert got == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def record(kind, id_, block=b"", **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    parts = [
        record("warcinfo", "<i>", b"software: x"), record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Concurrent_To="<q1>"), record("request", "<q1>", b"GET"),
        record("metadata", "<m1>", b"a: b", WARC_Concurrent_To="<q1>"), record("response", "<r2>", b"no http"), record("request", "<lost>", b"GET"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:3]))
    (tmp_path / "w" / "part-1.warc").write_bytes(b"".join(parts[3:]))
    got = {r["record_id"]: r for r in warc.assemble(warc.read_archive(spark, str(tmp_path / "w"))).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert [x["record_id"] for x in got["<r1>"]["requests"]] == ["<q1>"] and [x["record_id"] for x in got["<r1>"]["metadata"]] == ["<m1>"]
    assert got["<r1>"]["read_bytes"] == 4 and got["<r2>"]["read_bytes"] == 7 and got["<r2>"]["requests"] == []


def test_broken_archives():
    whole = record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert len(list(warc.parse(whole * 3))) == 3 and list(warc.parse(b"")) == [] and list(warc.parse(b"\r\n\r\n")) == []
    for bad in (whole[:-10], whole[:30], b"nonsense\r\n\r\n", gzip.compress(whole)[:-12]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_empty_table(spark, tmp_path):
    warc.write_archive(warc.captures(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "w"))
    assert warc.page_digests(warc.assemble(warc.read_archive(spark, str(tmp_path / "w")))).collect() == []
