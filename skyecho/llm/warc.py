"""Web archives: writing captures as WARC records and assembling them back.

A capture is written as three records: the request, the response (or a revisit
of an earlier payload) and metadata, the first and last concurrent to the
second. Records are complete strings ended by the text writer's separator, so
the files need nothing but Spark's own writer and can go to any store; they are
gzip files of about FILE_BYTES each. Which captures are revisits is found without
moving payloads. Reading takes files through Spark's binary source, inflates them
piece by piece, follows each record's Content-Length, and joins the records of a
transaction through their concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho.llm.common import written

EOL = "\r\n"
#: Bytes of records in a file, about, and bytes inflated at once.
FILE_BYTES, PIECE = 64 << 20, 1 << 20
#: Rows of two numbers and an id that may be broadcast.
BROADCAST_ROWS = 400_000
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1 (five bytes make eight digits)."""
    digest = F.sha1(content)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*of: Column) -> Column:
    h = F.md5(F.concat_ws("/", *(F.coalesce(c.cast("string"), F.lit("-")) for c in of)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record but for the two line ends behind it; headers of null are left out."""
    head = [F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{EOL}WARC-Record-ID: "), record_id, F.lit(f"{EOL}WARC-Date: {DATE}{EOL}")]
    head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")) for name, value in headers]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block)


def write(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Writes every row of ``pages`` as a capture with the UTF-8 ``html`` (null: empty) as payload.

    Of the captures with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is the response (of rows that repeat an id, the last read) and
    the others revisit it; smaller payloads are all responses. Null ids sort first.
    Other columns are left out. Rows are numbered as they are read: what isn't a plain scan, and so might come in
    another order the second time, is stored first.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    if "Exchange" in pages._jdf.queryExecution().executedPlan().toString():
        rows = written(rows, "pages")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"digest": base32_sha1(F.col("body")), "bytes": F.octet_length("body").cast("long")})
    # The decisions need no payload: only numbers and digests are shuffled.
    light = written(rows.select("id", "row", "digest", "bytes"), "digests")
    several = light.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = written(several, "keepers")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    again = light.join(few(several), "digest").where(~F.struct("id", "row").eqNullSafe(F.col("keeper")))
    again = written(again.select("row", "keeper"), "revisits")
    all_ = rows.join(few(again), "row", "left")
    revisit = F.col("keeper").isNotNull()
    total = light.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    per_file = max(1, int(file_bytes / (1500 + total[1] / max(1, total[0]))))
    capture, request, metadata = (_urn(F.lit(kind), F.col("id"), F.col("row")) for kind in ("capture", "request", "metadata"))
    uri = ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f\x7f]", "%20"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    refers = F.when(revisit, _urn(F.lit("capture"), F.col("keeper.id"), F.col("keeper.row")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]*([^\s]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL))
    fields = F.coalesce(F.concat(F.lit(f"{id_col}: "), F.col("id").cast("string"), F.lit(EOL)), F.lit(""))
    records = (
        _record("request", request, [uri, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        _record(F.when(revisit, "revisit").otherwise("response"), capture, [uri, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(revisit, "").otherwise(F.col("body")))),
        _record("metadata", metadata, [uri, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    between = EOL + EOL
    all_.select(F.concat_ws(between, *records).alias("value")).write.option("lineSep", between).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http string, payload binary, payload_sha1 string, fields string"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive (plain, or gzip of one or many members), piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        one = zlib.decompressobj(31)
        rest = content
        while not one.eof and rest:
            yield one.decompress(rest, PIECE)
            rest = one.unconsumed_tail
        while not one.eof:
            if not (more := one.decompress(b"", PIECE)):
                raise ValueError("the archive ends within a gzip member")
            yield more
        content = one.unused_data.lstrip(b"\0")


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive. Holds one record and a piece of what follows beside the archive itself."""
    pieces = _inflated(content)
    held, done, ended = bytearray(), 0, False

    def more(size: int) -> bool:
        """Reads on until so many bytes are held; False at the end."""
        nonlocal ended
        while len(held) < size and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= size

    while True:
        while more(2) and held[:2] == b"\r\n":
            del held[:2]
            done += 2
        if not more(1):
            return
        end = -1
        size = 1 << 12
        while end < 0 and (more(size) or not end + 1):
            end = held.find(b"\r\n\r\n")
            if ended:
                break
            size = max(size, len(held)) + (1 << 12)
        if end < 0 or held[:5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {done}")
        head = {}
        for line in held[:end].decode("utf-8", "replace").split(EOL)[1:]:
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), value.strip())
        begin = end + 4
        stop = begin + int(head["content-length"])
        more(stop)
        kind, block = head.get("warc-type"), bytes(held[begin:stop])
        del held[:stop]
        done += stop
        http = payload = fields = None
        if head.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            http, payload = (block[: cut + 2].decode("utf-8", "replace"), block[cut + 4 :]) if cut >= 0 else (block.decode("utf-8", "replace"), b"")
        elif kind == "metadata":
            fields = block.decode("utf-8", "replace")
        else:
            payload = block
        own = kind in ("response", "resource")
        yield {"type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "payload_digest": head.get("warc-payload-digest"), "http": http, "payload": payload if own else None, "payload_sha1": base64.b32encode(hashlib.sha1(payload or b"").digest()).decode() if own else None, "fields": fields}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``payload_sha1`` is computed from the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                size = 0
                for r in parse(content.as_py()):
                    size += len(r["payload"] or b"") + 1000
                    if not with_payload:
                        r["fields"] = r["fields"] or (None if r["payload"] is None else f"payload_bytes: {len(r['payload'])}{EOL}")
                        r["payload"] = None
                    rows.append(r)
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response`` (the response, revisit or
    resource record), ``requests`` and ``metadata`` (arrays by record id).

    Requests and metadata belong to the record that they are concurrent to; a
    response that itself names a request belongs with that one. Records whose
    partner is missing make a capture of their own with null or empty parts; of a
    record that occurs twice one copy stays.
    """
    fields = [n for n in _NAMES if n not in ("payload", "payload_sha1", "payload_digest", "refers_to", "concurrent_to")]
    main = F.col("type").isin("response", "revisit", "resource")
    side = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.struct(*fields))))
    return (
        records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(F.first(F.when(main, F.struct(*_NAMES)), ignorenulls=True).alias("response"), side("request").alias("requests"), side("metadata").alias("metadata"))
    )


def captures(assembled: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Of each assembled capture that ``write`` made: its id, payload size and digest,
    record type and the id of the capture that it refers to."""
    number = lambda text, name: F.nullif(F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(-?[0-9]+)", 1), F.lit("")).cast("long")
    flat = assembled.where(F.col("response").isNotNull()).select(
        number(F.get(F.col("metadata"), F.lit(0))["fields"], id_col).alias(id_col),
        F.coalesce(F.octet_length(F.col("response.payload")).cast("long"), number(F.col("response.http"), "Content-Length")).alias("payload_bytes"),
        F.coalesce("response.payload_sha1", F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.record_id").alias("_own"),
        F.col("response.refers_to").alias("_to"),
    )
    return flat


def with_targets(flat: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Adds ``refers_to``, the id of the capture that a revisit names (null: none, or not in these archives)."""
    targets = flat.where(F.col("record_type") == "response").select(F.col("_own").alias("_to"), F.col(id_col).alias("refers_to"))
    # Responses name none; they stay out of the join, where they would be one key.
    revisits = flat.where(F.col("_to").isNotNull()).join(targets, "_to", "left").drop("_own", "_to")
    rest = flat.where(F.col("_to").isNull()).drop("_own", "_to").withColumn("refers_to", F.lit(None).cast(flat.schema[id_col].dataType))
    return rest.unionByName(revisits)
