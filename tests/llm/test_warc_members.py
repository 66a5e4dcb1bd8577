"""Records around a bad one in the same gzip member."""

import gzip
import random

from loamcast.llm import warc


def test_a_bad_record_leaves_its_member_the_others():
    good = [warc.record(k, f"https://x.org/{k}", f"payload {k}".encode(), None, False) for k in range(5)]
    bad = good[2].replace(b"payload 2", b"pAyload 2")
    member = gzip.compress(b"".join([*good[:2], bad, *good[3:]]))
    tail = gzip.compress(warc.record(9, "https://x.org/9", b"last", None, False))
    got = list(warc.salvage(member + tail))
    assert [x["page_id"] for kind, x in got if kind == "record"] == [0, 1, 3, 4, 9]
    assert [x for kind, x in got if kind == "gap"] == [(0, len(member))]


def test_records_before_the_damage_of_a_member():
    """One member of six records, torn before its end; and one whose checksum fails."""
    plain = [warc.record(k, None, random.Random(k).randbytes(5000), None, False) for k in range(6)]
    whole = gzip.compress(b"".join(plain), mtime=0)
    ids = lambda data: [x["page_id"] for kind, x in warc.salvage(data) if kind == "record"]
    torn = whole[:-40]
    assert ids(torn) == [0, 1, 2, 3, 4] and [x for kind, x in warc.salvage(torn) if kind == "gap"] == [(0, len(torn))]
    unchecked = whole[:-8] + bytes(8)
    assert ids(unchecked) == [0, 1, 2, 3, 4, 5] and [x for kind, x in warc.salvage(unchecked) if kind == "gap"] == [(0, len(whole))]
    after = gzip.compress(warc.record(9, None, b"later", None, False), mtime=0)
    assert ids(b"junk" + torn + after) == [0, 1, 2, 3, 4, 9]
    middle = bytearray(whole)
    middle[len(whole) // 2] ^= 0xFF
    assert set(ids(bytes(middle) + after)) >= {0, 1, 9}


def test_archives_are_bounded_by_bytes(spark):
    rows = [(k, f"http://h/{k}", random.Random(k).randbytes(1500).hex()) for k in range(30)]
    where = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), archive=5_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).collect()]
    assert len(sizes) >= 4 and max(sizes) < 10_000
    assert sorted(r.page_id for r in warc.read(spark, where).collect()) == list(range(30))
