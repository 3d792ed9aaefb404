import hashlib
import os

from lodestar.llm import warc

ROWS = [(5, "http://a/5", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (7, "http://a/7\r\nX: y", ""), (3, "u", "é" * 50_000), (None, "n", "<p>x</p>"), (11, "http://a/11", "<p>x</p>"), (11, "http://a/11", "<p>x</p>")]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")


def test_round_trip_and_revisits(spark, tmp_path):
    files = warc.write_archive(_pages(spark, ROWS), str(tmp_path / "a"), roll_bytes=300, partitions=3)
    assert files.agg({"records": "sum"}).first()[0] == len(ROWS)
    got = sorted((r.page_id or -1, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload) for r in warc.read_archive(spark, str(tmp_path / "a")).collect())
    first = {}
    for p, _, h in ROWS:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in ROWS:
        data = (h or "").encode()
        old = p is not None and first[h or ""] != p
        want.append((p or -1, "revisit" if old else "response", len(data), warc.sha1_base32(data), first[h or ""] if old else None, None if old else data))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))


def test_same_pages_same_bytes_and_no_temporary_names(spark, tmp_path):
    for name, rows in (("a", ROWS), ("b", ROWS[::-1])):
        warc.write_archive(_pages(spark, rows), str(tmp_path / name), roll_bytes=300, partitions=2)
    files = lambda n: {x: hashlib.sha256((tmp_path / n / x).read_bytes()).hexdigest() for x in os.listdir(tmp_path / n) if x[0] != "."}
    assert files("a") == files("b")
    assert not any(x.startswith("_tmp") for x in files("a"))


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    warc.write_archive(_pages(spark, ROWS), str(tmp_path / "a"))
    (tmp_path / "a" / "part-000099-0000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == len(ROWS)


def test_a_second_attempt_replaces_the_first(spark, tmp_path):
    """As when an executor is lost: files of the final and of temporary names are there already."""
    warc.write_archive(_pages(spark, ROWS), str(tmp_path / "a"), partitions=2)
    before = (tmp_path / "a" / warc.MANIFEST).read_bytes()
    (tmp_path / "a" / "_tmp-000000-17-part-000000-0000.warc.gz").write_bytes(b"half a file")
    warc.write_archive(_pages(spark, ROWS), str(tmp_path / "a"), partitions=2)
    assert (tmp_path / "a" / warc.MANIFEST).read_bytes() == before
    assert not [x for x in os.listdir(tmp_path / "a") if x.startswith("_tmp")]


def test_empty_table(spark, tmp_path):
    warc.write_archive(_pages(spark, ROWS).limit(0), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
