import csv

from shelfwise.sources import imports as I


def test_records_and_lines_over_files_and_blocks(spark, tmp_path):
    body = "".join(f'"n{i}{chr(10) if i % 5 == 0 else ""} ""q""",{i}.5,S{i},WAFER\n' + ("\n" if i % 7 == 0 else "") + (", ,,\n" if i % 11 == 0 else "") for i in range(400))
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("﻿Name,Regular_Price,sku,category\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        rows = I.read_catalogue_csv(spark, str(tmp_path))
        got = sorted((r.source_file[-5:], r.line, r.Name, r.sku) for r in rows.collect())
        errors = [(r.source_file[-5:], r.line, r.file_line) for r in I.import_errors(I.parse_catalogue(rows)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(tmp_path / "a.csv", encoding="utf-8-sig", newline="") as f:
        want = [(n, r["Name"] or None, r["sku"] or None) for n, r in enumerate(csv.DictReader(f), start=2)]
    assert got == sorted(((name, *r) for name in ("a.csv", "b.csv") for r in want), key=lambda r: (r[0], r[1]))
    assert errors == []


def test_an_error_names_file_and_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,regular_price,category\n"two\nlines",5,WAFER\n\nx,0,WAFER\n')
    (tmp_path / "b.csv").write_text("name,regular_price,category\ny,,WAFER\n")
    got = [(r.source_file[-5:], r.line, r.file_line, r.error) for r in I.import_errors(I.parse_catalogue(I.read_catalogue_csv(spark, str(tmp_path)))).collect()]
    assert [g[:3] for g in got] == [("a.csv", 3, 5), ("b.csv", 2, 2)] and got[1][3] == "price is empty"
