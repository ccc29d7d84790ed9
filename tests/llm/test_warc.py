import hashlib
import random

import pytest
from helpers import words

from tidepool.llm import warc


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as segment", "'x' as record_id", "2 as total")


def pages(seed=1):
    rng = random.Random(seed)
    long = " ".join(words(rng, 9000))
    rows = [(5, "http://a/\r\nX: y", None), (1, None, ""), (2, "u", "short"), (3, "u", "short"), (4, "ü", "é" * 49), (6, "u", "é" * 50), (0, "u", "é" * 50), (7, "u", "é" * 50)]
    rows += [(20, "u", "a\r\n\r\nb\r\n\r\n\r\n\r\r\n\r\nWARC/1.1\r\n\r\n" * 30), (21, "u", "\r\n\r\n" * 60), (22, "u", long), (23, "u", long), (24, "u", long + "x")]
    return rows + [(100 + k, "http://b/", " ".join(words(rng, rng.randrange(3000)))) for k in range(30)]


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None, True))
    return sorted(out)


def test_round_trip(spark):
    found = warc.archive_round_trip(table(spark, pages())).collect()
    assert sorted(tuple(r) for r in found) == expected(pages())


def test_payloads_and_shuffled_segments(spark, tmp_path):
    warc.write_pages(table(spark, pages(2)), f"file://{tmp_path}/w", segment=500)
    records = warc.read_records(spark, f"file://{tmp_path}/w").orderBy("block").repartition(5)
    found = {r.record_id.split(":")[2]: r for r in warc.reassemble(records).collect() if r.kind == "response"}
    assert all(bytes(r.payload).decode() == next(h or "" for i, _, h in pages(2) if str(i) == k) for k, r in found.items())
    assert records.filter("kind = 'continuation'").count() > 100


@pytest.mark.parametrize("broken", ["segment <> 2", "total is null", "segment <> 1"])
def test_missing_segments_are_noticed(spark, tmp_path, broken):
    warc.write_pages(table(spark, [(1, "u", "x" * 3000)]), f"file://{tmp_path}/w", segment=500)
    rows = warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/w").filter(broken)).collect()
    assert [(r.complete, r.payload) for r in rows] == [(False, None)]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "y" * 200), (1, "u", "y" * 200), (None, "u", "y" * 200)]
    found = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_round_trip(table(spark, rows)).collect())
    assert found == [("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1)]


def test_empty_table(spark):
    assert warc.archive_round_trip(table(spark, [])).collect() == []


def test_chunk_framing():
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.dechunked(warc.chunked(b"ab" * 5000)) == b"ab" * 5000
    assert warc.dechunked(b"5\r\nhell") is None and warc.dechunked(b"zz\r\n") is None


def test_blocks_that_end_in_line_ends():
    block = b"a\r\nbc\r\n\r\nd\r\n\r\n\r\n\r\re\r\n"
    blocks = [block[:k] for k in range(len(block) + 1)]
    blocks = [*blocks, *reversed(blocks), b"\r\n", b"\r\n\r\n", b"\r\n\r\n\r\n", b"\r\n"]
    stream = b"".join(warc._record({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>"}, x) + b"\r\n\r\n" for k, x in enumerate(blocks))
    reader = warc.Reader()
    found = [(f["warc-record-id"], x) for piece in stream.split(b"\r\n\r\n") for f, x in reader.feed(piece)]
    assert found == [(f"<{k}>", x) for k, x in enumerate(blocks)]


def test_pages_cut_behind_line_ends(spark, tmp_path):
    html = "".join(f"<p>{k}</p>\r\n" for k in range(12)) + "\r\n\r\n\r\nx\r\n"
    rows = [(k, "u", "x" * k + html) for k in range(60)]
    warc.write_pages(table(spark, rows).coalesce(1), f"file://{tmp_path}/w", segment=40)
    found = warc.page_table(warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/w"))).collect()
    assert sorted(tuple(r) for r in found) == expected(rows)


def test_pages_in_another_order_each_time(spark):
    """A page keeps its name, though each reading of the input gives another order: no revisit loses its response."""
    given = spark.createDataFrame([(i, f"https://a.example/{i}", f"<p>{i % 7}</p>" * 40) for i in range(140)], "page_id long, url string, html string")
    shuffled = given.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), given.schema)
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(shuffled).collect()}
    assert found == {i: ("revisit", i % 7) if i >= 7 else ("response", None) for i in range(140)}
