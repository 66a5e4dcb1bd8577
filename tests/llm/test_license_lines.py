"""Short license lines, and those of the test tables."""

import pytest

from loamcast.llm import license_scan


@pytest.mark.parametrize(("line", "label"), [
    ("Released under the MIT License.", "mit"), ("Licensed under the MIT license", "mit"), ("Licensed under the Apache License.", "apache-2.0"),
    ("Released under the BSD License", "bsd"), ("Licensed under the Mozilla Public License", "mpl-2.0"),
])
def test_short_notices(line, label):
    _, _, spans = license_scan.scan_text(f"some words. {line} more words".encode())
    assert {s.label for s in spans} == {label}


def test_short_notices_tell_licenses_apart():
    for line in (b"released under the gpl license", b"released under the isc license", b"released under the same law"):
        assert not license_scan.scan_text(line)[2]


def test_license_lines_of_the_tables_have_labels(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held = docs.where("lower(text) like '%released under the mit license%'")
    got = license_scan.scan(held).collect()
    assert len(got) > 0 and all("mit" in r.labels.split(",") and r.score > 0 for r in got)
