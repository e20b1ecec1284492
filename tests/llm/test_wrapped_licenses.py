"""License statements that are wrapped over several lines, with comment marks and other text around."""

import pytest

from quarry.llm import license_scan

MIT = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ACME DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""


def test_whole_notices(spark, tmp_path):
    spark.createDataFrame([(1, "Copyright ACME\n" + ISC), (2, ISC.replace("fee", "charge")), (3, ISC.split("THE SOFT")[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got[1][0] == "isc" and 0.8 <= got[1][1] < 1 and got[2] == got[3] == ("", 0.0)


def test_wrapped_statements(spark, tmp_path):
    filler = "some words that stand\nbefore and after it\n" * 30
    spread = "\n".join(["released", *["x"] * 20, "under the", *["y"] * 20, "MIT", *["z"] * 20, "license"])
    rows = [(1, MIT), (2, filler + BSD + "\n" + filler), (3, MPL), (4, "Released\nunder the\nMIT License"), (5, spread), (6, filler), (7, None), (8, "Released under the MIT License")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.op7_license_scan(spark, str(tmp_path)).collect()}
    want = {1: "mit", 2: "bsd", 3: "mpl-2.0", 4: "mit", 5: "", 6: "", 7: "", 8: "mit"}
    assert got == {i: (label, pytest.approx(1.0 if label else 0.0)) for i, label in want.items()}
