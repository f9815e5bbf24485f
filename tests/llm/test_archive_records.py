from __future__ import annotations

import gzip
import re
from pathlib import Path

from lexloom.llm import warc
from lexloom.llm.shared import Workspace


def records(path):
    """The records of each file, by hand."""
    out = []
    for p in sorted(Path(path).rglob("part-*")):
        data, one = gzip.decompress(p.read_bytes()), []
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            one.append((fields, rest[:n]))
            data = rest[n + 4 :]
        out.append(one)
    return out


def test_ids_are_unique_and_links_lead_to_responses(spark, tmp_path):
    rows = [(i, f"http://h/{i}", None if i % 3 == 0 else f"page {i % 7}") for i in range(200)] + [(5, "http://h/5", "page 5")] * 4 + [(None, "http://n/", None)] * 3 + [(0, "http://again/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    warc.write_archives(pages, f"file://{tmp_path}/a", file_bytes=300, work=Workspace(spark, "t"))
    files = records(tmp_path / "a")
    every = [r for f in files for r in f]
    ids = [f["WARC-Record-ID"] for f, _ in every]
    assert len(set(ids)) == len(ids) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    assert len(files) > 3 and all([f["WARC-Type"] for f, _ in one].count("warcinfo") == 1 and one[0][0]["WARC-Type"] == "warcinfo" for one in files)
    held = {f["WARC-Record-ID"]: f for f, _ in every if f["WARC-Type"] == "response"}
    urls = {(f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Payload-Digest"]) for f in held.values()}
    revisits = [f for f, _ in every if f["WARC-Type"] == "revisit"]
    assert len(every) - len(files) == len(rows) and revisits
    for f in revisits:
        assert (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"], f["WARC-Payload-Digest"]) in urls
        assert "WARC-Refers-To" not in f or held[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    assert any("WARC-Refers-To" in f for f in revisits) and any("WARC-Refers-To" not in f for f in revisits)


def test_long_payloads_and_extra_columns(spark):
    long = "<p>é</p>" * 200_000
    pages = spark.createDataFrame([(1, "u", long, "x"), (2, "v", long, "y"), (None, None, "", "z")], "page_id long, url string, html string, n string").selectExpr("*", "'c' as refers_to", "'d' as payload_digest")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (1_800_000, "response", None), 2: (1_800_000, "revisit", 1), None: (0, "response", None)}


def test_files_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, f"http://h/{i}", ("%06d" % i) * (25_000 if 100 <= i < 140 else 20)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(pages, f"file://{tmp_path}/a", file_bytes=1 << 20, work=Workspace(spark, "t"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in Path(tmp_path / "a").rglob("part-*")]
    assert max(sizes) <= 2 << 20 and sum(sizes) > 40 * 150_000
    got = warc.read_archives(spark, f"file://{tmp_path}/a", payloads=True).collect()
    assert sorted((r.page_id, r.payload) for r in got) == [(i, t) for i, _, t in rows]


def test_ids_of_other_types(spark):
    pages = spark.createDataFrame([("a b+c", "u", "x"), ("é\r\nX: 1", "v", "x"), ("b", "w", "y"), (None, "z", "x")], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {"a b+c": ("response", None), "é\r\nX: 1": ("revisit", "a b+c"), "b": ("response", None), None: ("revisit", "a b+c")}
    small = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id int, url string, html string")
    assert dict(warc.round_trip(small).dtypes)["page_id"] == "int" and {r.refers_to for r in warc.round_trip(small).collect()} == {None, 1}
