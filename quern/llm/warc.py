"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a member as its bytes arrive, takes as many bytes of content as the header promises, and
checks block and payload digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, session, table

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    content: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def encode_record(headers: list[tuple[str, str]], content: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    head += f"WARC-Block-Digest: sha1:{digest(content)}\r\nContent-Length: {len(content)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8")) + z.compress(content) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: str | None, url: str | None, html: str | None, refers_to: str | None) -> bytes:
    """A response with the payload, or, where refers_to is given, a revisit without it. Both have the digest
    and, in their HTTP header, the length of the full payload. A null html is an empty payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{RECORD}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{RECORD}{refers_to}>")]
    return encode_record(headers, block if revisit else block + payload)


def info_record() -> bytes:
    body = b"software: quern\r\nformat: WARC File Format 1.1\r\n"
    return encode_record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", "<urn:x-info:0>"), ("Content-Type", "application/warc-fields")], body)


def _take(buffer: bytearray, n: int) -> bytes:
    out = bytes(buffer[:n])
    del buffer[:n]
    return out


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive given as pieces of its bytes. Raises ValueError on broken framing, on a cut-off
    archive and on a block digest that does not hold."""
    plain, z, head = bytearray(), None, None
    need = 0

    def parsed(flush: bool) -> Iterator[Record]:
        nonlocal head, need
        while True:
            if head is None:
                end = plain.find(b"\r\n\r\n")
                if end < 0:
                    if flush and plain.strip():
                        raise ValueError("archive ends within a header")
                    return
                lines = _take(plain, end + 4).decode("utf-8").strip("\r\n").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a record: {lines[0][:40]!r}")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not head.get("content-length", "").isdigit():
                    raise ValueError("a record without a content length")
                need = int(head["content-length"])
            if len(plain) < need + 4:
                if flush:
                    raise ValueError("archive ends within a record")
                return
            content = _take(plain, need)
            if _take(plain, 4) != b"\r\n\r\n":
                raise ValueError("content is longer than its header says")
            if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest(content):
                raise ValueError(f"block digest of {head.get('warc-record-id')} does not hold")
            yield Record(head, content)
            head = None

    for chunk in chunks:
        while chunk:
            z = z or zlib.decompressobj(31)
            plain += z.decompress(chunk)
            chunk = b""
            if z.eof:
                chunk, z = z.unused_data, None
            yield from parsed(False)
    if z is not None:
        raise ValueError("archive ends within a gzip member")
    yield from parsed(True)


def _page_of(urn: str) -> int | None:
    """The page id of a record id that page_record() wrote; null for a null page id and for other writers' ids."""
    n = urn.strip("<>").removeprefix(RECORD)
    return int(n) if re.fullmatch(r"-?\d{1,19}", n) else None


def describe(r: Record) -> dict:
    """What a page's record says, of any writer. The payload of a response is checked against its digest, where
    that is a SHA-1, and against its HTTP length, where it has one and no transfer coding. Of a revisit, which has
    no payload, the digest and length are those that its headers state; null where they state none."""
    http, _, payload = r.content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    said, record_id = r.headers.get("warc-payload-digest", ""), r.headers.get("warc-record-id", "")
    length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() and "transfer-encoding" not in fields else None
    sha = said[5:].upper() if said.lower().startswith("sha1:") else None
    if r.kind == "response":
        own = digest(payload)
        if length not in (None, len(payload)) or sha not in (None, own):
            raise ValueError(f"payload of {record_id} does not match its digest or length")
        length, sha = len(payload), own
    return {
        "page_id": _page_of(record_id), "payload_bytes": length, "payload_digest": sha, "record_type": r.kind,
        "refers_to": _page_of(r.headers.get("warc-refers-to", "")) if r.kind == "revisit" else None,
    }


def archive(pages: DataFrame, least_bytes: int = 0, most_bytes: int = 8 << 20, id_col: str = "page_id") -> DataFrame:
    """Archives of pages (page_id, url, html), a row (name, content) for each; content is a whole .warc.gz
    file of about most_bytes at most, or of one record more.

    Of payloads of at least least_bytes that are equal, the one with the smallest page_id is a response and
    the others revisit it; rows that repeat that id are responses too. A null page_id neither is referred to
    nor refers. The digest table of repeated payloads is broadcast only while it has at most 200,000 rows.
    """
    session(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    data = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.when(F.col("page_id").isNotNull() & (F.octet_length(data) >= least_bytes), F.sha1(data)))
    again = cut(rows.where("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n"))
    again = F.broadcast(again) if again.count() <= 200_000 else again
    rows = rows.join(again, "sha", "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    # as text, ids keep their nulls and all their digits in pandas
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, bytearray()
        for pdf in batches:
            for page_id, url, html, ref in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                held += page_record(page_id, url, html, ref)
                if len(held) >= most_bytes:
                    yield pd.DataFrame({"name": [f"part-{part:05d}-{k:05d}.warc.gz"], "content": [info_record() + bytes(held)]})
                    held, k = bytearray(), k + 1
        if held:
            yield pd.DataFrame({"name": [f"part-{part:05d}-{k:05d}.warc.gz"], "content": [info_record() + bytes(held)]})

    return rows.mapInPandas(run, "name string, content binary")


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _described(chunks: Iterable[bytes]) -> pd.DataFrame:
    found = [describe(r) for r in read_records(chunks) if r.kind in ("response", "revisit")]
    return pd.DataFrame(found, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read(archives: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The page records of archives (content): page_id, payload_bytes, payload_digest, record_type, refers_to, a
    row for each response and revisit. Other kinds of records are passed over; a null or empty content has no
    records. An archive with broken framing, a cut-off one and one whose digests do not hold raise ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                content = content or b""
                yield _described(content[k : k + chunk] for k in range(0, len(content), chunk))

    return archives.select("content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """read() of the files at path. Files that workers can open (file: paths) are read piece by piece, of any
    size; from other stores Spark's reader brings each file whole, up to 2 GB."""
    files = session(spark).read.format("binaryFile").load(path)
    if not files.where("path not like 'file:%'").select("path").isEmpty():
        return read(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with open(unquote(urlparse(name).path), "rb") as f:
                    yield _described(iter(lambda: f.read(chunk), b""))  # noqa: B023

    return files.select("path").mapInPandas(run, SCHEMA)


def unresolved(records: DataFrame) -> DataFrame:
    """Of records that read() gave, what revisits refer to (refers_to, payload_digest, payload_bytes) that is no
    response's page id, digest and length. Equal references count once before anything is joined."""
    keys = ["payload_digest", "payload_bytes"]
    wanted = records.where("record_type = 'revisit'").select("refers_to", *keys).distinct()
    given = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *keys).distinct()
    return wanted.join(given, ["refers_to", *keys], "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, reads the archives back and returns what they hold, once every revisit has been found
    to refer to a response of equal digest and length."""
    found = cut(read(cut(archive(table(spark, sf_dir, "pages")))))
    if bad := unresolved(found).head(1):
        raise ValueError(f"no response for {bad[0]}")
    return found


#: op9 in DuckDB. Base 32 of a SHA-1: four letters of 5 bits for each 5 hexadecimal digits.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)
      FOR k IN range(32)], '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
