"""What a parse holds at once doesn't grow with the batches that Spark hands over."""

import pyarrow as pa

from tidepool.sources import dom


def test_parts_come_in_slices(spark):
    page = "<html><body><nav><a href='/a'>One</a></nav><section><p>" + "word " * 200 + "</p></section></body></html>"
    pages = [page] * 500 + [None, ""] + [page * 3000] + [page] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["page_id", "_html"])
    out = list(dom._parsed(("blocks",), [dom._arrow(f"array<{dom.BLOCK}>")], dom.KEPT)([batch]))
    assert max(b.num_rows for b in out) <= 64 and [i for b in out for i in b.column("page_id").to_pylist()] == list(range(len(pages)))
    assert [len(x) for b in out for x in b.column("blocks").to_pylist()][:503] == [2] * 500 + [0, 0, 2]
    empty = list(dom._parsed(("blocks",), [dom._arrow(f"array<{dom.BLOCK}>")], dom.KEPT)([batch.slice(0, 0)]))
    assert sum(b.num_rows for b in empty) == 0


def test_unseen_characters_take_no_room():
    assert dom.shown("a​‌ b﻿ é‍") == "a b é"
