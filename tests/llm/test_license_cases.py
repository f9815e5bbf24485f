from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import licenses


def test_a_text_is_the_sum_of_its_lines(spark):
    texts = ["Copyright (c) 2020 X\r\nfoo, bar\n\n  © me\nbaz", "(c) 2001\rnext\nend", "", "\n\n", None, "One Copyright 1999 Y\nTwo", "ΟΔΟΣ\nΟΔΟΣ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r.doc_id: r.d for r in df.select("doc_id", F.sha2(licenses.respelled(licenses.canonical(F.col("text"))), 256).alias("d")).collect()}
    assert {r.doc_id: r.text_digest for r in licenses.scan_licenses(df).collect()} == whole


def test_long_texts_repeated_rows_and_names(spark):
    long = "some words of a line\n" * 60_000 + "Released under the MIT License.\n" + "x " * 500_000
    rows = [("a", long, "c"), ("a", long, "c"), (None, licenses.TEXTS["ISC"], "c")]
    df = spark.createDataFrame(rows, "doc_id string, text string, license string").withColumns({"digest": F.lit(1), "mark": F.lit(2), "__id": F.lit(3)})
    got = sorted((r.doc_id or "", r.license, r.notices, r.n_notice_lines) for r in licenses.scan_licenses(df).collect())
    assert got == [("", "ISC", None, 0), ("a", None, "MIT", 1), ("a", None, "MIT", 1)]
