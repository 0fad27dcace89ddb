"""WARC archives: writing captures and assembling them again.

Each capture is a transaction of three records: ``request``, ``response`` (or
``revisit``) and ``metadata``. The records of one transaction name each other
through ``WARC-Concurrent-To``; :func:`assemble` joins them through that field
and emits one nested row per capture.

Archives are gzipped WARC/1.1 files that Spark's own text writer puts into a
shared folder, so they can live in any store that Spark writes to, and a task
that is run again replaces its own file. The rows are dealt into files of about
``file_bytes`` bytes and at most ``records_per_file`` records. They are read back
as binary files that are unpacked record by record, so that a task holds a
packed file and one record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import arrow_schema, counted, cut, map_batches, shared_folder, table, written

#: Records in an archive file at most (three make a capture), and its bytes before it is packed, about.
RECORDS_PER_FILE = 6_000
FILE_BYTES = 32 << 20
#: Bytes of headers of a capture, about.
HEAD_BYTES = 1_500
#: Copies of a response's name in the join that resolves references, so that a payload that most captures share is dealt out.
SALTS = 16
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, "
    "digest string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
)
_CRLF = "\r\n"


def base32(digits: Column) -> Column:
    """A SHA-1 given as hexadecimal digits, in upper-case base 32 without padding."""
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, min_bytes: int = 0, part_bytes: int = FILE_BYTES) -> DataFrame:
    """Adds ``sha1``, ``size``, ``id`` and ``first`` to pages of k (key), u (URL, not null) and b (payload, not null).

    ``id`` names the capture by its key, URL and digest; ``first`` is the id of
    the capture that has the payload first, null where that is the row itself:
    the least key of a digest, a null key being larger than any other. Rows that
    share that key, rows whose payload has no key at all and payloads below
    ``min_bytes`` have no ``first``. Digests, sizes and names are written once,
    and only these are shuffled for this; minima are combined before the shuffle
    and join back in a join whose large partitions Spark can split, so one
    payload may hold any share of the rows. Payloads are shuffled once, by
    ``id`` into partitions of about ``part_bytes``; an id whose rows are more than
    one partition holds is dealt over as many as it needs.
    """
    rows = pages.withColumns({"sha1": F.sha1("b"), "size": F.octet_length("b").cast("long")})
    named = F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit(""))
    rows = rows.withColumn("id", F.md5(F.concat_ws("/", named, "sha1", "u")))
    narrow = written(rows.select("k", "id", "sha1", "size"))
    total = narrow.agg(F.sum(F.col("size") + HEAD_BYTES)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    keyed = F.when(F.col("k").isNotNull(), F.struct("k", "id"))
    first = narrow.groupBy("sha1").agg(F.min(keyed).alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and least is not null").select("sha1", "least")
    again = narrow.where(F.col("size") >= min_bytes).join(first, "sha1").where(~F.col("k").eqNullSafe(F.col("least.k")))
    again = again.groupBy("id").agg(F.first("least.id").alias("first"))
    # No more ids need several partitions than there are partitions.
    wide = narrow.groupBy("id").agg(F.ceil(F.sum(F.col("size") + HEAD_BYTES) / part_bytes).alias("deals")).where("deals > 1")
    wide = counted(cut(wide))
    deals = F.coalesce("deals", F.lit(1))
    dealt = rows.join(wide, "id", "left").withColumn("deal", F.pmod(F.monotonically_increasing_id(), deals)).drop("deals")
    again = again.join(wide, "id", "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("deals")
    return dealt.repartition(parts, "id", "deal").join(again.repartition(parts, "id", "deal"), ["id", "deal"], "left").drop("deal")


def record_id(kind: str, capture: Column) -> Column:
    """The same name for the same record on every run: a name-based identifier."""
    h = F.md5(F.concat(F.lit(f"{kind}/"), capture))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One WARC record without the two line ends that follow it; null headers are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in headers]
    head = F.concat_ws(_CRLF, F.lit("WARC/1.1"), *lines)
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(head, F.lit(_CRLF), size, F.lit(_CRLF * 2), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the three records of each page to gzipped archives below ``path``.

    A payload is the text in UTF-8 (null: empty). A page whose payload another
    page with a smaller key has already is a revisit and has no payload itself.
    Rows with a null key have no page id in their metadata. Rows that repeat key,
    URL and payload are written each, under the same names. Other columns of
    ``pages`` are not looked at.
    """
    clean = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    pages = pages.select(F.col(key).alias("k"), clean.alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("b"))
    rows = mark_revisits(pages, min_bytes, file_bytes)
    again = F.col("first").isNotNull()
    response, request, meta = (record_id(kind, F.col("id")) for kind in ("response", "request", "metadata"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF * 2))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("u"))]
    records = F.array(
        _record([("WARC-Type", "request"), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("u"), F.lit(f" HTTP/1.1{_CRLF * 2}"))),
        _record(
            [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
             ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(again, record_id("response", F.col("first")))), ("Content-Type", "application/http; msgtype=response")],
            F.when(again, http).otherwise(F.concat(http, F.col("b"))),
        ),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta), *common, ("WARC-Concurrent-To", response), ("Content-Type", "application/warc-fields")], F.concat(F.lit("via: "), F.col("u"), F.coalesce(F.concat(F.lit(f"{_CRLF}pageId: "), F.col("k").cast("string")), F.lit("")), F.lit(_CRLF))),
    )
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, unpacked one by one; a broken tail raises ValueError."""
    file = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    count = 0
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record after {count} records")
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", -1))
        block = file.read(size) if size >= 0 else b""
        if len(block) != size or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record after {count} records is cut off")
        yield headers, block
        count += 1


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. ``payloads=False`` leaves bodies out once they are hashed.

    ``payload_bytes`` and ``payload_digest`` of a response are counted from its
    body. A revisit has no body: its digest is the one in its header, its size
    the length which the kept HTTP header states.
    """
    schema = arrow_schema(RECORD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out: list[dict] = []
                held = 0
                for h, block in parse(content.as_py()):
                    kind, body, row = h.get("warc-type"), block, {}
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        row = {"digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:")}
                        row |= {"payload_bytes": len(body), "payload_digest": b32encode(hashlib.sha1(body).digest()).decode()}
                        if kind == "revisit":
                            size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                            row |= {"payload_digest": row["digest"], "payload_bytes": int(size[1]) if size else None}
                    elif kind == "metadata":
                        row = {"headers": dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(_CRLF) if ": " in x)}
                    out.append({"record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload": body if payloads else None} | row)
                    held += len(body) if payloads else 0
                    if len(out) >= 500 or held >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return map_batches(files, work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``request``, ``metadata``, ``copies``.

    Requests and metadata name their response in ``concurrent_to``; a response
    or revisit stands for itself. All records of a transaction meet in a grouped
    aggregate keyed by the response's identifier (three rows a key, however
    often a payload occurs). A transaction without a response or revisit is
    left out; a missing request or metadata record is null. Of records that
    repeat an identifier the least stays, and ``copies`` counts the responses.
    """
    lead = F.col("type").isin("response", "revisit")
    rows = records.where(lead | F.col("type").isin("request", "metadata")).withColumn("capture_id", F.when(lead, F.col("record_id")).otherwise(F.col("concurrent_to")))
    body = F.struct("record_id", "type", "uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload")
    side = F.struct("record_id", "uri", "date", "payload")
    note = F.struct("record_id", F.col("headers")["pageId"].alias("page_id"))
    out = rows.groupBy("capture_id").agg(
        F.min(F.when(lead, body)).alias("response"),
        F.min(F.when(F.col("type") == "request", side)).alias("request"),
        F.min(F.when(F.col("type") == "metadata", note)).alias("metadata"),
        F.count(F.when(lead, 1)).alias("copies"),
    )
    return out.where(F.col("response").isNotNull())


def resolved(captures: DataFrame) -> DataFrame:
    """Adds ``refers_to_page``: the page id of the response that a revisit names in WARC-Refers-To.

    Null for responses and for revisits whose response is not there. A response
    that is referred to joins in :data:`SALTS` copies, so that the revisits of
    one response are dealt out. ``captures`` are read several times (a table).
    """
    named = F.col("response.refers_to")
    asked = captures.select(named.alias("_of")).where("_of is not null").distinct()
    heads = captures.where("response.type = 'response'").select(F.col("capture_id").alias("_of"), F.col("metadata.page_id").alias("refers_to_page"))
    heads = heads.join(asked, "_of", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = captures.where(named.isNotNull()).withColumns({"_of": named, "_salt": F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")})
    joined = revisits.join(heads, ["_of", "_salt"], "left").select(*captures.columns, "refers_to_page")
    return captures.where(named.isNull()).withColumn("refers_to_page", F.lit(None).cast("string")).unionByName(joined)


def captures(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, assemble, resolve."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes=min_bytes)
    return resolved(written(assemble(read(spark, path, payloads=False))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's payload as archived and read back; the least page of a payload is its response.

    A row for each row of ``pages``. Rows with a null page_id are revisits of the
    least page that has their payload, and responses where none has.
    """
    c = captures(spark, table(spark, sf_dir, "pages"))
    return c.select(
        F.col("metadata.page_id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _sql32() -> str:
    parts = " || ".join(f"lpad(to_base(('0x' || substr(h, {at}, 10))::BIGINT, 32), 8, '0')" for at in (1, 11, 21, 31))
    return f"translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


OP10_SQL = f"""
with p as (select page_id, strlen(coalesce(html, ''))::BIGINT as payload_bytes, sha1(coalesce(html, '')) as h from pages),
     d as (select page_id, payload_bytes, {_sql32()} as payload_digest, min(page_id) over (partition by h) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first_id then first_id end as refers_to
from d
"""
