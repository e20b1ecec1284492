"""Identifiers in tags, and licenses beyond the most common ones; the SQL has the same labels."""

import duckdb
import pytest

from quarry.llm import license_scan

TEXTS = {
    "// SPDX-License-Identifier: MIT": "mit", "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "lgpl-2.1", "# SPDX-License-Identifier: GPL-3.0-only": "gpl-3.0", "# SPDX-License-Identifier: LGPL-3.0": "lgpl-3.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by,cc-by-4.0,cc-by-sa-4.0", "SPDX-License-Identifier: CC0-1.0": "cc0-1.0",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0-1.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-4.0", "you may use it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
    "Licensed under the European Union Public Licence (EUPL)": "eupl", "It is distributed under the terms of the Artistic License 2.0": "artistic", "The license identifier of this file isn't known to the author": "", "the terms of the lease as published by the foundation": "", "SPDX-License-Identifier: Foo-2.0": "",
}


def test_labels(spark, tmp_path):
    rows = [(i, f"first line\n{t}\nlast line") for i, t in enumerate(TEXTS)] + [(100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in license_scan.op7_license_scan(spark, str(tmp_path)).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(TEXTS)} == TEXTS
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.sql(license_scan.ORACLE).fetchall()}
    assert {i: tuple(r)[:7] for i, r in got.items()} == {i: r[:7] for i, r in want.items()}
    assert all(r["score"] == pytest.approx(want[i][7]) for i, r in got.items())
