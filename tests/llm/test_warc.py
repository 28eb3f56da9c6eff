import hashlib

import duckdb
import pytest
import zstandard

from logspark.llm import warc
from logspark.llm.queries import QUERIES


def brute(rows, least=1000):
    best = {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= least and p is not None:
            best[b] = max(p, best.get(b, p))
    out = []
    for p, h in rows:
        b = (h or "").encode()
        first = best.get(b, p)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if first == p else "revisit", None if first == p else first))
    return sorted(out, key=str)


def test_query_agrees_with_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall()
    got = QUERIES["op9_warc"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_round_trip_of_odd_rows(spark, tmp_path):
    long = "<p>" + "long é " * 300_000
    rows = [(1, "http://a/\r\n x", "é" * 600), (2, "http://b/", "é" * 600), (9, None, "é" * 600), (3, None, None), (4, "u", ""),
            (5, "u", "same"), (6, "u", "same"), (None, "n", "é" * 600), (7, "l", long), (2**60 + 1, "z", "z" * 3000), (2**60 + 3, "z", "z" * 3000), (8, "r", "r" * 2000), (8, "r", "r" * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, size string")
    done = warc.write(df, f"{tmp_path}/w", target_bytes=1 << 20).collect()
    assert sum(r.n_records for r in done) == len(rows)
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted((tuple(r)[0], *tuple(r)[2:6]) for r in back if r.page_id is not None) == sorted(
        x for x in brute([(p, h) for p, _, h in rows]) if x[0] is not None)
    assert {(r.page_id, bytes(r.payload).decode()) for r in back if r.record_type == "response"} == {
        (p, h or "") for p, _, h in rows if p not in (1, 2, 2**60 + 1, None)}
    assert [(r.record_type, r.refers_to) for r in back if r.page_id is None] == [("revisit", 9)]
    assert warc.write(df.limit(0), f"{tmp_path}/e").count() == 0


def test_archive_is_plain_zstandard_with_its_dictionary_in_front(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body><p>page number {i} of many</p></body></html>" * 5) for i in range(500)],
                               "page_id long, url string, html string")
    [row] = warc.write(df, str(tmp_path)).collect()
    data = open(row.file, "rb").read()
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = reader.decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC/1.1") == 1
    with pytest.raises(ValueError):
        list(warc.records_of(data[8 + size :]))


def test_small_repeated_pages_fill_many_archives(spark, tmp_path):
    """Records count with their headers: pages of one small payload, and revisits, are dealt to archives too."""
    pages = [(i, f"http://h/{i}", "12345678") for i in range(3000)] + [(10_000 + i, f"http://r/{i}", "r" * 2000) for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    done = warc.write(df, f"{tmp_path}/w", target_bytes=200_000).collect()
    assert len(done) > 15 and max(r.n_records for r in done) < 6000 / len(done) * 1.5
    assert sum(r.n_records for r in done) == 6000 and warc.read(spark, f"{tmp_path}/w").count() == 6000
