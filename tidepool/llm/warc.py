"""Web archives: writing pages as WARC records, and reading records with their segments put together."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import attach_groups, bounded_batches, materialize, shared_dir

#: What ends a record, and so the line separator of the files.
END = "\r\n\r\n"
#: Payloads that are at least so long are stored once; blocks beyond SEGMENT are cut; a chunk of the
#: transfer coding.
LEAST_SHARED, SEGMENT, CHUNK = 100, 16384, 4096
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, kind string, uri string, digest string, refers_to string, origin string, segment int, total bigint, block binary"
FIELDS = ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Segment-Origin-ID", "WARC-Segment-Number", "WARC-Segment-Total-Length")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """What chunked framing holds, with chunk extensions and trailers left out; None if it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]+)\s*(;|$)", body[at:line]) if line >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def page_records(name: str, url: str | None, payload: bytes, digest: str, response: str | None, date: str, segment: int = SEGMENT):
    """The records of one page without their ends: a revisit if it has a response to refer to, else a
    response and its continuations."""
    shared = {"WARC-Target-URI": url, "WARC-Date": date}
    content = {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if response is not None:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>"} | shared | content | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{response}>"}, HTTP)
        return
    block = HTTP + chunked(payload)
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    number = {"WARC-Segment-Number": 1} if len(cuts) > 1 else {}
    yield _record({"WARC-Type": "response", "WARC-Record-ID": f"<{name}>"} | shared | content | number, cuts[0])
    for k, cut in enumerate(cuts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if k == len(cuts) else {}
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>"} | shared | {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k} | total, cut)


def _write_batches(date: str, segment: int):
    def run(batches):
        for batch in batches:
            rows = zip(*[batch.column(c) for c in ("name", "url", "payload", "digest", "response")])
            out = [r for n, u, p, d, x in rows for r in page_records(n.as_py(), u.as_py(), p.as_py(), d.as_py(), x.as_py(), date, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Write a record per page to gzipped WARC files at a path, through Spark's own writer.

    The payload is the html in UTF-8 (null: empty), framed in chunks. Of equal payloads of at least
    LEAST_SHARED bytes the one with the smallest id (nulls last, any one of ties) is a response, to which
    the others refer as revisits. Blocks longer than `segment` become a response and continuations.
    Named pages are written once first, so that a page keeps its name when tasks of lost executors run
    again over rows in another order.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("_row"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_row").cast("string"))
    rows = materialize(rows.select("page_id", "url", "payload", name.alias("name"), F.sha2("payload", 256).alias("digest"), "_row"), "warc-named")
    least = F.min(F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("i"), F.col("_row").alias("r"), F.col("name").alias("name")))
    groups = rows.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(least.alias("_l"), F.count("*").alias("_n"))
    groups = materialize(groups.filter("_n > 1").select("digest", F.col("_l.name").alias("response"), "_n"), "warc-groups")
    facts = groups.agg(F.sum("_n")).first()[0] or 0
    rows = attach_groups(rows, groups, "digest", "_n", max(1, facts), F.col("_row").cast("string"))
    rows = rows.withColumn("response", F.when(F.col("response") != F.col("name"), F.col("response")))
    records = rows.select("name", "url", "payload", "digest", "response").mapInArrow(_write_batches(date, segment), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Reader:
    """Takes a stream apart into records, however it is cut into pieces."""

    def __init__(self):
        self.rest = None

    def feed(self, piece: bytes):
        """A piece is what stands before the next END; yields (fields, block) of finished records.

        A block that ends in a line end and the END behind it are cut two bytes early; what follows
        the block's length and its END is then the next record's header.
        """
        if self.rest is None:
            if piece.strip(b"\r\n"):
                self.fields = dict(self._field(x) for x in piece.decode("utf-8", "surrogateescape").split("\r\n") if ":" in x)
                self.rest, self.block, self.first = int(self.fields.get("content-length", 0)), bytearray(), True
            return
        if not self.first:
            self.block += END.encode()
        self.first = False
        self.block += piece
        if len(self.block) >= self.rest:
            behind = bytes(self.block[self.rest :])
            yield self.fields, bytes(self.block[: self.rest])
            self.rest = None
            if behind.startswith(END.encode()):
                yield from self.feed(behind[len(END) :])

    @staticmethod
    def _field(line: str) -> tuple[str, str]:
        name, _, value = line.partition(":")
        return name.strip().lower(), value.strip()


def _read_batches(batches):
    reader = Reader()
    for batch in batches:
        rows = []
        for piece in batch.column("piece"):
            for fields, block in reader.feed(piece.as_py()):
                own = [fields.get(f.lower()) for f in FIELDS]
                own = [x.strip("<>") if x is not None and i in (0, 4, 5) else x for i, x in enumerate(own)]
                rows.append([*own[:6], *[int(x) if x is not None else None for x in own[6:]], block])
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        names = ["record_id", "kind", "uri", "digest", "refers_to", "origin", "segment", "total", "block"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as they stand: ids, type, digest, segment fields and block.

    Files are gzipped, so each goes through one task in order; records are found by their lengths, and
    may hold the separator themselves.
    """
    bounded_batches(spark)
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_read_batches, RECORD)


def _payload(block: bytes) -> bytes | None:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _decode_batches(batches):
    for batch in batches:
        out = []
        for blocks, complete in zip(batch.column("blocks").to_pylist(), batch.column("complete").to_pylist()):
            out.append(_payload(b"".join(blocks)) if complete else None)
        keep = [c for c in batch.schema.names if c != "blocks"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.binary())], [*keep, "payload"])


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, kind, uri, digest, refers_to, complete, payload.

    Only segmented records are shuffled: those of an origin are ordered by number and must run from 1
    without a gap or a repeat, end with the one that states the total length, and add up to it. What
    doesn't is not complete and has no payload, nor has a broken chunk framing. Revisits have no
    payload of their own. No records give no rows.
    """
    head = ["record_id", "kind", "uri", "digest", "refers_to"]
    whole = records.filter("segment is null").select(*head, F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    parts = records.filter("segment is not null").withColumn("_of", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = parts.groupBy("_of").agg(*[first(c) for c in head], F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("_s"))
    numbers = F.transform("_s", lambda x: x["segment"])
    total = F.get("_s", F.size("_s") - 1)["total"]
    length = F.aggregate("_s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    good = (numbers == F.sequence(F.lit(1), F.size("_s"))) & F.coalesce(total == length, F.lit(False))
    parts = parts.select(F.coalesce("record_id", "_of").alias("record_id"), *head[1:], F.transform("_s", lambda x: x["block"]).alias("blocks"), good.alias("complete"))
    rows = whole.unionByName(parts)
    rows = rows.mapInArrow(_decode_batches, "record_id string, kind string, uri string, digest string, refers_to string, complete boolean, payload binary")
    return rows.withColumn("complete", F.col("complete") & F.col("payload").isNotNull()).withColumn("payload", F.when(F.col("kind") != "revisit", F.col("payload")))


def _page_id(name: Column) -> Column:
    return F.split(name, ":").getItem(2).try_cast("bigint")


def page_table(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page that reassemble() found,
    and whether its payload has the digest that its record states (verified)."""
    own = found.select(
        "record_id", "kind", F.col("refers_to").alias("_to"), F.octet_length("payload").cast("long").alias("_bytes"),
        F.sha2("payload", 256).alias("_sha"), F.regexp_replace("digest", "^sha256:", "").alias("_stated"), "complete",
    )
    own = materialize(own, "warc-pages")
    revisits = own.filter("kind = 'revisit'").select("record_id", "_to", "_stated")
    wanted = revisits.groupBy("_to").agg(F.count("*").alias("_n"))
    answer = own.filter("kind = 'response'").select(F.col("record_id").alias("_to"), F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("payload_digest")).join(wanted, "_to")
    seen = attach_groups(revisits, answer, "_to", "_n", max(1, revisits.count()), F.col("record_id"))
    seen = seen.select(_page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), _page_id(F.col("_to")).alias("refers_to"), F.coalesce(F.col("payload_digest") == F.col("_stated"), F.lit(False)).alias("verified"))
    plain = own.filter("kind = 'response'").select(_page_id(F.col("record_id")).alias("page_id"), F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.coalesce(F.col("complete") & (F.col("_sha") == F.col("_stated")), F.lit(False)).alias("verified"))
    return plain.unionByName(seen)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page_table() of all of them.

    Repeated rows have a record each; an empty table gives an empty result; further columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, **columns)
    return page_table(reassemble(read_records(spark, path)))
