"""WARC archives: written with revisit records, read back, and put together into one nested row per capture.

Writing. Every capture becomes three records: its ``response`` (or ``revisit``, when an equal payload of at least
``least`` bytes is archived under a larger page id), its ``request`` and its ``metadata``; the latter two name the first through
``WARC-Concurrent-To``. Records are strings made by SQL expressions and written by Spark's text writer with the two line ends
that close a WARC record as separator, so files appear through Spark's committer and a lost executor leaves none behind.

Reading. Whole files go to a parser that walks from record to record by ``Content-Length``. Transaction assembly then
groups the records of a capture, by concurrent-to identifiers, into one nested row; a revisit finds its payload's
size and digest through the record that it refers to.

Ids are of any type that has an order and a text. Null html is an empty payload, null url an empty target; control characters in a url are percent-encoded in headers,
and the metadata block has it as it was. Rows that repeat an id and all else are written as often as they occur and come
back as often. Of several rows with the same largest id and equal payloads the one with the least url is the response.
An empty table gives an archive without records. Columns other than the three named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import arrow_rows, cut, matched
from lexmill.sources.scratch import Folder, fresh_path

LEAST = 1000
#: Captures in one file at most, and bytes of payload at their mean size; a file is read as one value.
CAPTURES_A_FILE, BYTES_A_FILE = 2000, 64 << 20
#: Tasks that the revisits of one response are spread over.
TURNS = 16
END = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts)).cast("binary"))
    cutting = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cutting)), F.lit(">"))


def _record(kind: str | Column, rid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends. Fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _base32(column: Column) -> Column:
    """Hexadecimal SHA-1 as base 32, five hexadecimal digits to four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        n = F.conv(F.substring(column, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """What the archive will hold of each page: its payload, digest, and whether it is a response or revisits one."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "same": F.sha2(F.col("payload"), 256)})
    groups = rows.where(F.col("size") >= least).groupBy("same").agg(F.max(F.struct("page_id", F.expr("-octet_length(url)").alias("short"), "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.where("copies > 1").select(F.col("same").alias("same_as"), "first"), "payloads")
    # as long as the payloads that occur again are few, their rows stay where they are, however many have one of them
    rows = matched(rows, groups, [F.col("same") == F.col("same_as"), F.col("size") >= least], "left")
    again = F.col("first").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")))
    return rows.withColumns({
        "kind": F.when(again, "revisit").otherwise("response"),
        "rid": _uuid(F.lit("r"), F.col("page_id"), F.col("url"), F.col("same")),
        "refers": F.when(again, _uuid(F.lit("r"), F.col("first.page_id"), F.col("first.url"), F.col("same"))),
    })


def records(found: DataFrame) -> DataFrame:
    """One string per record, without its closing line ends."""
    digest = F.concat(F.lit("sha1:"), _base32(F.col("sha1")))
    bare = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    target = ("WARC-Target-URI", bare)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    answer = _record(
        F.col("kind"), F.col("rid"),
        [target, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("refers")), ("WARC-Profile", F.when(F.col("refers").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(F.col("kind") == "response", F.concat(head, F.col("payload"))).otherwise(head),
    )
    joined = ("WARC-Concurrent-To", F.col("rid"))
    asked = _record("request", _uuid(F.lit("q"), F.col("rid")), [target, joined, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), bare, F.lit(" HTTP/1.1\r\nAccept: text/html" + END)))
    notes = F.to_json(F.struct(F.col("page_id").cast("string").alias("page_id"), "url"))
    about = _record("metadata", _uuid(F.lit("m"), F.col("rid")), [target, joined, ("Content-Type", F.lit("application/json"))], notes)
    return found.select(F.explode(F.array(asked, answer, about)).alias("value"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Archives under ``path``, compressed with gzip; a file holds a bounded number of records, less where payloads are large."""
    mean = pages.agg(F.avg(F.octet_length(columns.get("html_col", "html")))).first()[0] or 0
    held = int(max(1, min(CAPTURES_A_FILE, BYTES_A_FILE // max(mean, 1))))
    records(captures(pages, **columns)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * held).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        lines = data[at:top].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = top + 4
        end = begin + int(headers["content-length"])
        yield headers, data[begin:end]
        at = end + 4


_SCHEMA = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, content_type string, http_status int, payload_bytes long, payload_sha1 string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; the payload is the block without its HTTP head."""

    def run(it: Iterator) -> Iterator[pa.RecordBatch]:
        import gzip

        kinds = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for files in it:
            for i in range(files.num_rows):
                data, rows, size = files.column(0)[i].as_py(), [], 0
                for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    head, payload = b"", block
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    status = head.split(b" ", 2)[1] if head.startswith(b"HTTP/") else None
                    whole = h["warc-type"] == "response"
                    digest = h.get("warc-payload-digest")
                    sha1 = hashlib.sha1(payload).hexdigest() if whole else None
                    if whole and digest and base64.b32decode(digest.removeprefix("sha1:")).hex() != sha1:
                        raise ValueError(f"the payload of {h['warc-record-id']} does not have its digest")
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, h.get("content-type"), int(status) if status else None, len(payload), sha1, payload if payloads or h["warc-type"] == "metadata" else None))
                    size += len(payload)
                    if len(rows) == 256 or size > BYTES_A_FILE:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    with arrow_rows(spark, 8):  # a file is a value here: few of them in a batch
        return cut(files.mapInArrow(run, _SCHEMA), "records")


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id, copies, response, request, metadata, original``.

    Records meet under the identifier that they are concurrent to, or their own. Records written several times are
    counted; the payload travels in the answer's struct where read() kept it.
    """
    key = F.coalesce("concurrent_to", "record_id")
    pick = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct("record_id", "type", "uri", "refers_to", "digest", "http_status", "payload_bytes", "payload_sha1", "payload")), ignorenulls=True)
    rows = found.groupBy(key.alias("capture_id")).agg(
        F.count(F.when(F.col("type").isin("response", "revisit"), 1)).alias("copies"),
        pick("response", "revisit").alias("response"),
        pick("request").alias("request"),
        pick("metadata").alias("metadata"),
    )
    about = F.struct(F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha1").alias("payload_sha1"), F.col("metadata.payload").alias("notes"))
    revisit = F.col("response.type") == "revisit"
    # only responses that are revisited are looked up; the revisits of one are spread over several tasks
    asked = rows.where(revisit).select(F.col("response.refers_to").alias("asked")).distinct()
    originals = rows.where(~revisit).select(F.col("capture_id").alias("original_id"), about.alias("found")).join(asked, F.col("original_id") == F.col("asked"), "left_semi")
    originals = originals.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))
    met = rows.join(originals, (F.col("response.refers_to") == F.col("original_id")) & (F.pmod(F.xxhash64("capture_id"), F.lit(TURNS)) == F.col("turn")), "left")
    return met.withColumn("original", F.coalesce("found", F.when(~revisit, about))).drop("original_id", "found", "turn")


def transactions(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url``, one row per capture in the archives."""
    rows = assemble(read(spark, path, payloads=False)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    note = lambda c, k: F.get_json_object(c.cast("string"), f"$.{k}")
    return rows.select(
        note(F.col("metadata.payload"), "page_id").cast(id_type).alias("page_id"),
        F.col("original.payload_bytes").alias("payload_bytes"),
        F.col("original.payload_sha1").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", note(F.col("original.notes"), "page_id").cast(id_type)).alias("refers_to"),
        note(F.col("metadata.payload"), "url").alias("url"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns) -> DataFrame:
    """transactions() of the archives that write() makes of ``pages``; the archives are removed again."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, id_col=id_col, **columns)
    out = cut(transactions(spark, path, pages.schema[id_col].dataType.simpleString()), "transactions")
    Folder(spark, path).remove()
    return out
