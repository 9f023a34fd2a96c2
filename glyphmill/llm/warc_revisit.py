"""WARC: revisits resolved by payload digest, and archives written without repeated payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, pick, small

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = (
    "page_id long, record_type string, record_id string, target_uri string, payload_digest string, refers_to string,"
    " refers_to_uri string, content_length long, block binary"
)
_NL = "\r\n"


def _uuid(page_id: str, url: str, digest: str) -> F.Column:
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.col(digest)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _line(name: str, value: F.Column) -> F.Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(_NL)))


def resolve(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    record_type: str | None = None,
    payload_digest: str | None = None,
    date: str = DATE,
) -> DataFrame:
    """A row (page_id, url, record_type, payload_digest, refers_to_id, refers_to_uri, record) for every capture.

    Of the responses with one payload, that of the least id is the original; others, and the rows whose ``record_type`` is
    ``revisit``, become revisits that refer to it. ``record`` is a whole record with fresh headers: new identifier, digest,
    lengths and ``date``. A revisit has the digest of ``payload_digest`` and no payload.

    Only headers are shuffled by digest; payloads stay where they are read unless the list of revisits is too large for a broadcast. A null
    payload counts as empty. Captures with a null id are never originals for others but may be revisits of them. Rows that share id and
    payload are captures alike: all are responses, if they are the original. A revisit whose original isn't there refers to
    nothing. Line breaks in addresses become spaces, a null address has no header. Other columns are not read.
    """
    wanted = {"page_id": page_id, "url": url, "payload": payload, "kind": record_type, "given": payload_digest}
    pages = pick(pages, **{k: v for k, v in wanted.items() if v is not None})
    kind = F.lit("response") if record_type is None else F.coalesce(F.lower(F.col("kind")), F.lit("response"))
    given = F.lit(None).cast("string") if payload_digest is None else F.col("given").cast("string")
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]+", " ").alias("url"),
        F.when(kind == "revisit", F.lit("")).otherwise(body).alias("payload"),
        (kind == "revisit").alias("again"),
        F.when(kind == "revisit", F.coalesce(given, F.lit("unknown"))).otherwise(F.concat(F.lit("sha256:"), F.sha2(body, 256))).alias("digest"),
    )
    heads = rows.select("page_id", "url", "again", "digest")
    first = heads.where("not again and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("o"), F.count("*").alias("n"))
    named = heads.where("not again").join(first.select("digest", F.col("o").alias("page_id")), ["digest", "page_id"])
    origin = named.groupBy("digest", "page_id").agg(F.min("url").alias("o_url")).withColumnRenamed("page_id", "o")
    others = heads.join(origin, "digest").where("again or page_id is null or page_id <> o")
    links = cut(others.select("digest", F.col("page_id").alias("p"), "again", "o", "o_url").distinct())
    same = (
        (F.col("r.digest") == F.col("l.digest"))
        & F.col("r.page_id").eqNullSafe(F.col("l.p"))
        & (F.col("r.again") == F.col("l.again"))
    )
    joined = rows.alias("r").join(small(links).alias("l"), same, "left").select("r.*", "l.o", "l.o_url")
    revisit = F.col("again") | F.col("o").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(f"{_NL}{_NL}"),
        F.col("payload"),
    )
    made = joined.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("digest").alias("payload_digest"),
        F.col("o").alias("refers_to_id"),
        F.col("o_url").alias("refers_to_uri"),
        F.when(revisit, "").otherwise(http).alias("block"),
        _uuid("page_id", "url", "digest").alias("id"),
        F.when(F.col("o").isNotNull(), _uuid("o", "o_url", "digest")).alias("o_id"),
    )
    record = F.concat(
        F.lit(f"WARC/1.1{_NL}WARC-Type: "),
        F.col("record_type"),
        F.lit(_NL),
        _line("WARC-Record-ID", F.col("id")),
        F.lit(f"WARC-Date: {date}{_NL}"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.col("payload_digest")),
        F.when(F.col("record_type") == "revisit", f"WARC-Profile: {PROFILE}{_NL}").otherwise(""),
        _line("WARC-Refers-To", F.col("o_id")),
        _line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{_NL}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(f"{_NL}{_NL}"),
        F.col("block"),
    )
    return made.select("page_id", "url", "record_type", "payload_digest", "refers_to_id", "refers_to_uri", record.alias("record"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Writes ``record`` as WARC files under ``path``: what separates lines of the text files is what ends a record."""
    out = records.select("record").write.option("lineSep", f"{_NL}{_NL}").option("maxRecordsPerFile", records_per_file)
    out.text(path)


def _parse(stream: pa.NativeFile) -> Iterator[tuple]:
    def line() -> bytes:
        nonlocal buffer
        while (at := buffer.find(b"\r\n")) < 0:
            more = stream.read(1 << 20)
            if not more:
                out, buffer = buffer, b""
                return out
            buffer += more
        out, buffer = buffer[:at], buffer[at + 2 :]
        return out

    buffer = b""
    while True:
        head = line()
        if not head:
            if not buffer and not (buffer := stream.read(1 << 20)):
                return
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {head[:40]!r}")
        fields: dict[str, str] = {}
        while text := line():
            name, _, value = text.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        parts, have = [buffer[:length]], min(length, len(buffer))
        buffer = buffer[length:]
        while have < length:
            more = stream.read(length - have)
            if not more:
                raise ValueError("a record is cut off")
            parts.append(more)
            have += len(more)
        page = fields.get("x-page-id")
        yield (
            int(page) if page else None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
            fields.get("warc-payload-digest"), fields.get("warc-refers-to"), fields.get("warc-refers-to-target-uri"), length, b"".join(parts),
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under ``path``: headers and ``block``. Each file is read as a stream by one task, which has no more of them than their sizes allow."""
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in INDEX.split(","))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with fs.open_input_stream(name) as stream:
                    for row in _parse(stream):
                        rows.append(row)
                        size += row[7] + 500
                        if size > 8 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # Only names are read here, but Spark packs them into tasks by the sizes of the files.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(parse, INDEX)
