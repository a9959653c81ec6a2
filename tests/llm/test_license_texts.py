"""Whole licence texts beyond MIT, under a copyright line and wrapped anew."""

from pathlib import Path

from tidemart.llm import licenses

NAMES = ("Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 MPL-2.0 Unlicense Zlib").split()


def test_whole_texts(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    rows = [(name, "Copyright (c) 2020 A. Writer\n\n" + (folder / f"{name}.txt").read_text("utf-8").replace("\n\n", "\n \n"))
            for name in NAMES]
    rows += [("Apache-2.0", licenses._APACHE_HEADER), ("MPL-2.0", licenses._MPL_HEADER), (None, rows[0][1] + " more")]
    docs = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id BIGINT, text STRING")
    found = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == [name for name, _ in rows]
