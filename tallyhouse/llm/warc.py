"""Derived WARC records: metadata and plain-text conversions of response records.

Each response gives one ``metadata`` and one ``conversion`` record. Both refer
to it by its record id, keep its target and date, and carry digests of their own
block; the metadata record keeps the source's headers and digests. Record ids
are made from the source's id, so a task that runs again makes the same ones.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.staging import ship

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)")
_BREAK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*(?:>|\Z)")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def html_text(page: str) -> str:
    """Visible text of a page: a line per block, entities decoded."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(page))).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def header(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> str:
    """A WARC/1.1 header; line ends inside a value would break it, so they become spaces."""
    own = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in own if v is not None) + "\r\n"


RECORD = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, header string, block string, block_digest string, payload_digest string, content_length long"
_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RECORD.split(", ")])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _respond(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for page_id, url, page in zip(*(batch.column(i).slice(low, 256).to_pylist() for i in range(3)), strict=True):
                    payload = (page or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                    own = record_id("response", str(page_id), url or "", digest(payload))
                    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
                    out.append({"page_id": page_id, "type": "response", "record_id": own, "refers_to": None, "target_uri": url, "date": date, "header": header("response", fields, block), "block": block.decode(), "block_digest": digest(block), "payload_digest": digest(payload), "content_length": len(block)})
                yield _rows(out)

    return run


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, url, html, ...) -> response records, a row per row.

    A null page is an empty payload, a null url gives a record without a target.
    Repeated rows give records with equal ids. Other columns are not read.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_respond(date), RECORD)


def _derived(source: dict) -> Iterator[dict]:
    block = source["block"] or ""
    http, gap, payload = block.partition("\r\n\r\n")
    if not gap:
        http, payload = "", block
    refers, target, date = source["record_id"], source["target_uri"], source["date"]
    kept = [("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date)]
    text = html_text(payload)
    notes = {"source-record-id": refers, "source-block-digest": source["block_digest"], "source-payload-digest": source["payload_digest"], "source-content-length": source["content_length"], "text-digest": digest(text.encode())}
    lines = [f"{k}: {v}" for k, v in notes.items() if v is not None]
    lines += [f"source-{line}" for line in (source["header"] or "").split("\r\n")[1:] if line] + [f"http-{line}" for line in http.split("\r\n")[1:] if line]
    for kind, mime, content in (("metadata", "application/warc-fields", "".join(f"{line}\r\n" for line in lines)), ("conversion", "text/plain", text)):
        data = content.encode()
        own = record_id(kind, refers or "", source["block_digest"] or "")
        fields = [("WARC-Record-ID", own), *kept, ("WARC-Payload-Digest", digest(data)), ("Content-Type", mime)]
        yield {"page_id": source["page_id"], "type": kind, "record_id": own, "refers_to": refers, "target_uri": target, "date": date, "header": header(kind, fields, data), "block": content, "block_digest": digest(data), "payload_digest": digest(data), "content_length": len(data)}


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 128):
            yield _rows([x for source in batch.slice(low, 128).to_pylist() for x in _derived(source)])


def derived_records(responses: DataFrame) -> DataFrame:
    """Response records -> a metadata and a conversion record each.

    A null block is empty; a block without an HTTP header is all payload.
    Records of other types are left out. An empty table gives an empty result.
    """
    ship(responses.sparkSession)
    columns = [x.split()[0] for x in RECORD.split(", ")]
    return responses.filter("type = 'response'").select(*columns).mapInArrow(_derive, RECORD)


def record_text(records: DataFrame) -> DataFrame:
    """Records as they stand in a WARC file: write it with the text sink, one line end apart."""
    return records.select(F.concat("header", "block", F.lit("\r\n\r\n")).alias("value"))
