"""Licence lookup against SQL, canonical forms, odd rows."""

import duckdb

from panelwright.llm import licences
from panelwright.llm.queries import ORACLES, QUERIES
from tools.check import compare


def test_sql_agrees_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op2_licences"](spark, sf)
    assert compare(df, con, ORACLES["op2_licences"]) is None
    assert df.where("licenses <> ''").count() == con.execute("SELECT count(*) FROM documents WHERE text ILIKE '%licensed under%' OR text ILIKE '%MIT License%'").fetchone()[0]


def test_canonical_forms_and_odd_rows(spark):
    mit = licences.KNOWN[-1][1]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ,"), "x"), (2, "  RELEASED under the MIT licence!!", "x"),
        (3, "first\nReleased under the MIT License.\nlast\nLicensed under CC BY-NC 4.0", None), (3, "plain", None), (4, None, None), (5, "", None),
        (None, "Released under the MIT License", "z"), (6, "w " * 100_000 + "\nReleased under the MIT License", "z"), (7, "Not released under the MIT License today", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    out = licences.scan(df)
    assert out.columns == ["doc_id", "license", "n_license_lines", "licenses"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([
        (1, "MIT", 0, "MIT"), (2, "MIT", 1, "MIT"), (3, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""),
        (None, "MIT", 1, "MIT"), (6, None, 1, "MIT"), (7, None, 0, ""),
    ], key=str)
    assert licences.scan(df.limit(0)).count() == 0
