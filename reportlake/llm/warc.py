"""WARC archives with revisit resolution.

Archives are written by Spark's own text writer, so a lost task leaves no half file: a row is a record,
and the line separator is the blank lines that end one. They are read back by the lengths their headers
state. Duplicates are found among headers alone, which are shuffled by payload digest; every record with
an equal payload but one becomes a revisit record that names the original response, and the archives
are written anew with fresh headers. Reading such archives joins revisits to their originals again.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm.common import HOT_SHARE, attach, stored, table
from reportlake.session import shared_folder

#: Payload bytes from which on equal payloads are told apart by reference.
SHORTEST = 1000
#: Bytes of payload of one archive file, on average.
FILE_BYTES = 16 << 20
#: Records of one file are at most so many times as long as their mean; longer ones get files of their own.
SPREAD = 16
#: Revisits that are broadcast at most (about 300 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION, _END = "WARC/1.1\r\n", "\r\n\r\n"
#: Every row is written as it is, then the end of a record.
_WRITER = {"lineSep": _END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

_TEXT_FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "id": "page-id", "uri": "warc-target-uri",
    "date": "warc-date", "digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "refers_uri": "warc-refers-to-target-uri", "refers_date": "warc-refers-to-date",
}


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends in a value would end the line, so they are encoded."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes rows of record_id, record_type, id, uri, date, digest, refers_to, refers_uri, refers_date
    and payload (string; null for a revisit) as gzipped WARC files below a folder.

    Files hold about ``file_bytes`` of payload on average and SPREAD times as much at most, unless one
    record is longer: records of like length go together, so that a count of records bounds a file.
    """
    size = F.octet_length(F.coalesce("payload", F.lit("")))
    above, level = -1, 0
    while True:
        stats = records.where(size > above).agg(F.avg(size), F.max(size)).first()
        mean, most = max(float(stats[0] or 0), 1.0), stats[1] or 0
        upto = max(int(mean * SPREAD), above + 1)
        rows = records.where((size > above) & (size <= upto))
        options = {**_WRITER, "maxRecordsPerFile": max(1, int(file_bytes / (mean + 500)))}
        _texts(rows).write.options(**options).text(f"{folder}/lengths{level}")
        if most <= upto:
            return
        above, level = upto, level + 1


def _texts(records: DataFrame) -> DataFrame:
    """Each record as text, but for the blank lines that end it."""
    payload = F.coalesce("payload", F.lit(""))
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(response, F.concat(F.lit("Content-Length: "), F.octet_length(payload), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("\r\n"),
    )
    head = F.concat(
        F.lit(_VERSION),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        _field("WARC-Refers-To-Date", F.col("refers_date")),
        _field("WARC-Profile", F.when(response, F.lit(None)).otherwise(F.lit(PROFILE))),
        _field("Page-ID", F.col("id")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(response, F.octet_length(payload)).otherwise(F.lit(0)),
        F.lit(_END),
    )
    text = F.concat(head, http, F.when(response, payload).otherwise(F.lit("")))
    return records.select(text.alias("value"))


def _records(file):
    """Header fields and block of every record of an unpacked file, one at a time."""
    while line := file.readline():
        if line != _VERSION.encode():
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError("a header is cut short")
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip(b" \t\r\n").decode()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) < length or file.read(len(_END)) != _END.encode():
            raise ValueError("a record is cut short")
        yield fields, block


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all archives below a folder: record_id, record_type, id, uri, date, digest, refers_to,
    refers_uri, refers_date, payload_bytes and actual, with the payload (string) if asked for.

    payload_bytes and actual (the digest) are worked out from the bytes that are there; a revisit has
    none, so they are null. A file that does not hold whole records raises an error. A packed file is one
    row, unpacked a record at a time.
    """
    types = [(n, pa.string()) for n in _TEXT_FIELDS] + [("payload_bytes", pa.int64()), ("actual", pa.string())]
    schema = pa.schema(types + [("payload", pa.string())] * payload)
    blank = [None] * (2 + payload)

    def parse(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                file = gzip.open(io.BytesIO(content.as_buffer()))
                for fields, block in _records(file):
                    row = [fields.get(k) for k in _TEXT_FIELDS.values()]
                    row[5] = row[5] and row[5].removeprefix("sha1:")
                    if row[1] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        row += [len(body), hashlib.sha1(body).hexdigest(), *[body.decode()] * payload]
                        size += payload * len(body)
                    else:
                        row += blank
                    rows.append(row)
                    if len(rows) == 2000 or size >= 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    names = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in zip(schema.names, schema.types))
    return files.select("content").mapInArrow(parse, names)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """Writes a response record for every row: payload the html in UTF-8 (null: empty), headers with its
    digest, the url and the id (none for a null). Repeated rows are records of their own; an empty table
    gives an empty folder. Other columns are not read."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    none = F.lit(None).cast("string")
    records = pages.select(
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(id_col).cast("string").alias("id"),
        F.col(url_col).cast("string").alias("uri"),
        (F.lit(date) if date else now).alias("date"),
        F.sha1(payload).alias("digest"),
        none.alias("refers_to"), none.alias("refers_uri"), none.alias("refers_date"),
        payload.alias("payload"),
    )
    write_archives(records, folder)


def find_revisits(headers: DataFrame, shortest: int = SHORTEST, id_type: str = "bigint") -> DataFrame:
    """Which records say nothing that another does not: record_id, refers_to, refers_uri, refers_date.

    Of responses with equal payloads of at least ``shortest`` bytes the one with the largest id (of
    ``id_type``, null least; then the largest record id) is the original of all others. Revisits that are
    there already and state that digest are pointed to it as well.
    """
    rows = headers.select("record_id", "record_type", F.coalesce("actual", "digest").alias("digest"), "payload_bytes", "id", "uri", "date")
    rows = rows.where("record_type = 'revisit' OR payload_bytes >= {}".format(int(shortest)))
    place = F.struct(F.col("id").cast(id_type).alias("id"), "record_id", "uri", "date")
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("__count"), F.max(F.when(F.col("record_type") == "response", place)).alias("__best")
    )
    groups = groups.where("__count > 1 AND __best IS NOT NULL")
    met = attach(rows.select("record_id", "digest"), groups, ["digest"], "__count", headers.count())
    return met.where(F.col("record_id") != F.col("__best.record_id")).select(
        "record_id", F.col("__best.record_id").alias("refers_to"),
        F.col("__best.uri").alias("refers_uri"), F.col("__best.date").alias("refers_date"),
    )


def deduplicate(spark: SparkSession, source: str, target: str, shortest: int = SHORTEST, id_type: str = "bigint") -> None:
    """Reads archives and writes them again with revisit records in the place of repeated payloads.

    Only headers are shuffled; payloads move only if there are more than BROADCAST_ROWS revisits.
    Record ids, dates and uris stay; type, reference, profile and lengths are written afresh.
    """
    headers = stored(read_archives(spark, source), "headers")
    revisits = stored(find_revisits(headers, shortest, id_type), "revisits")
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    side = side.select(F.col("record_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in ("refers_to", "refers_uri", "refers_date")])
    records = read_archives(spark, source, payload=True)
    met = records.join(side, records["record_id"] == F.col("__id"), "left")
    again = F.col("__id").isNotNull()
    met = met.select(
        "record_id", F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"), "id", "uri", "date",
        F.coalesce("actual", "digest").alias("digest"),
        *[F.coalesce(f"__{c}", c).alias(c) for c in ("refers_to", "refers_uri", "refers_date")],
        F.when(~again, F.col("payload")).alias("payload"),
    )
    write_archives(met, target)


def resolved(headers: DataFrame) -> DataFrame:
    """Headers with what a revisit refers to: payload_bytes and actual of the original, and its id as
    refers_id. A revisit whose original is not there keeps nulls."""
    own = headers.select("record_id", "id", "payload_bytes", "actual").where("payload_bytes IS NOT NULL")
    wanted = headers.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count(F.lit(1)).alias("__count"))
    groups = wanted.join(own, F.col("refers_to") == F.col("record_id")).select(
        "refers_to", "__count", F.col("id").alias("refers_id"), F.col("payload_bytes").alias("__bytes"), F.col("actual").alias("__actual")
    )
    groups = stored(groups, "originals")
    few = groups.where(F.col("__count") * HOT_SHARE > headers.count())
    rest = headers.join(F.broadcast(few.select("refers_to")), "refers_to", "left_anti")
    met = headers.join(F.broadcast(few), "refers_to").unionByName(
        rest.join(groups.join(F.broadcast(few.select("refers_to")), "refers_to", "left_anti"), "refers_to", "left")
    )
    return met.select(
        *[c for c in headers.columns if c not in ("payload_bytes", "actual")],
        F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), F.coalesce("actual", "__actual").alias("actual"), "refers_id",
    )


def op12_revisits(spark, sf_dir):
    folder = shared_folder(spark)
    archive(table(spark, sf_dir, "pages"), f"{folder}/warc")
    deduplicate(spark, f"{folder}/warc", f"{folder}/revisits")
    found = resolved(stored(read_archives(spark, f"{folder}/revisits"), "headers"))
    return found.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("actual").alias("payload_digest"),
        "record_type", F.col("refers_id").cast("long").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN best IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS DISTINCT FROM page_id THEN best END AS refers_to
FROM b
"""
