"""Licenses that differ from a template by the word that tells them apart."""

from quarry.llm import license_scan


def test_siblings(spark, tmp_path):
    grant = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cases = {
        "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0", "Licensed under\nCC BY 4.0": "cc-by",
        "This work is licensed under the GNU General Public License, version 2": "gpl", "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "Released under the BSD License": "", "Released under\nthe BSD License": "", "Released under the MIT License": "mit", "Licensed under the Apache License, Version 1.0": "",
        grant.format(""): "gpl", grant.format("Lesser "): "gpl,lgpl"}
    spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in license_scan.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(cases.values()))
