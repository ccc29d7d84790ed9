"""Pages with more blocks and texts than any fixed number are told whole, a batch at a time."""

import pyarrow as pa

from tidepool.plans.catalogue import QUERIES
from tidepool.sources import dom

CARDS = "".join(f'<div class="card"><h3>Card {k}</h3><p>Monthly plan {k}</p><button>Get {k % 20}</button></div>' for k in range(400))
NESTED = "".join(f'<section><h2>Part {k}</h2><a href="/{k}">Go {k}</a><button>Try {k % 9}</button>' for k in range(300))
ROWS = "".join(f"<table><tr><td>{k}</td></tr><tr><td>b<table><tr><td>c</td></tr></table></td></tr></table>" for k in range(90))


def _query(spark, path, name, *pages):
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"file://{path}/pages.parquet")
    return QUERIES[name](spark, f"file://{path}")


def test_every_block_is_in_a_group(spark, tmp_path):
    got = {(r.page_id, r.sibling_group): (r.blocks, r.roles) for r in _query(spark, tmp_path, "block_groups", f"<body><main class='all'>{CARDS}</main></body>", f"<body>{NESTED}</body>", None, "").collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, "BODY"): (1, "pricing_card=1"), (0, "all"): (400, "pricing_card=400")}
    assert {k: n for k, (n, _) in got.items() if k[0] > 0} == {(1, "BODY"): 1, (1, "SECTION"): 299}


def test_late_blocks_hold_what_is_inside_them():
    found = list(dom.Blocks(dom.tree_of(f"<body>{NESTED}</body>")).rows_of())
    assert len(found) == 300 and [b["inside"] for b in found] == [None, *range(299)]
    for k in (0, 150, 250, 290, 299):
        b = found[k]
        assert b["text"] == "\n".join(x for j in range(k, 300) for x in (f"Part {j}", f"Go {j}", f"Try {j % 9}")) and b["heading"] == f"Part {k}"
        assert b["link_urls"] == [f"/{j}" for j in range(k, 300)][:20] and b["heading_chain"] == [f"Part {j}" for j in range(k + 1)][-4:]
        assert b["buttons"] == list(dict.fromkeys(x for j in range(k, 300) for x in (f"Go {j}", f"Try {j % 9}")))[:16]
    found = list(dom.Blocks(dom.tree_of(f"<body><section class='outer'>{ROWS}<section>{ROWS[:-8]}")).rows_of())
    assert (found[0]["table_rows"], found[-1]["tag"]) == (540, "section") and [b["table_rows"] for b in found if b["tag"] == "section"][1] == 270


def test_a_deep_page_goes_out_in_batches(spark):
    page = "<body>" + "".join(f"<section>{'word ' * 20}{k} " for k in range(1500))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([page, None, "", "<nav>Home"])], ["page_id", "_html"])
    out = list(dom._rows("blocks", dom._arrow(dom.BLOCK))([batch]))
    assert sum(b.num_rows for b in out) == 1501 and sum(b.nbytes for b in out) > 100_000_000 and max(b.nbytes for b in out) < 4_000_000
    assert [i for b in out for i in b.column("page_id").to_pylist()] == [1] * 1500 + [4] and sum(b.num_rows for b in dom._rows("blocks", dom._arrow(dom.BLOCK))([batch.slice(0, 0)])) == 0


def test_every_block_has_a_context(spark, tmp_path):
    late = '<div class="card"><h3>Pro</h3><p>Our plans: $9 a month</p></div>'
    got = _query(spark, tmp_path, "block_price_contexts", f"<body><main>{CARDS}{late}</main></body>", "<body>Nothing</body>", None).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.place) for r in got] == [(0, k) for k in range(402)] + [(1, 0)]
    assert {(r.classification, r.accepted) for r in got[1:401]} == {("billing_toggle", True)}
    assert [(r.classification, r.accepted) for r in got[401:]] == [("plan_card", True), ("unknown", False)]


def test_every_text_is_told(spark, tmp_path):
    parts = "".join(f'<div class="plan">Plan {k}<br>has<span> all </span>of it</div><div role="button">Act {k}</div>' for k in range(300))
    rows = "".join(f"<tr><td>Cell {k}</td><td>{k} more</td></tr>" for k in range(300))
    deep = "".join(f"<details>Deep {k} " for k in range(250))
    got = {}
    for r in _query(spark, tmp_path, "page_texts", f"<body>{parts}</body>", f"<body><table>{rows}</table></body>", f"<body>{deep}</body>", None).orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[0] == [x for k in range(300) for x in (f"Plan {k} has all of it", f"Act {k}")]
    assert got[1] == [x for k in range(300) for x in (f"Cell {k} {k} more", f"Cell {k}", f"{k} more")]
    assert got[2] == [" ".join(f"Deep {j}" for j in range(k, 250)) for k in range(250)] and set(got) == {0, 1, 2}


def test_texts_are_cleaned_once(spark, tmp_path):
    plan = _query(spark, tmp_path, "page_texts", "<p>One</p>")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("am|pm") == 1 + plan.split("Generate explode")[0].count("am|pm")
