"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

``responses`` makes response records of the rows of a page table; ``derive`` turns any response records into linked
records that name the response in WARC-Refers-To and keep its target, date, HTTP headers and digests.  Record ids are
derived from the response's id, so a task that runs again makes the same records.

Pages are read in one pass, in time that grows with their length.  Defined cases: a null page is an empty one and a null
url an empty target; blanks, line ends and control characters of a target, a record id or a date are percent-encoded,
and line ends in source headers folded, so none can make a header; a tag or comment that isn't closed takes the rest of
the page; a page without text gives an empty conversion record; pages repeated with one id and url share their record
ids; without pages there are no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm.common import table

SPACE = uuid.UUID("9e3779b9-7f4a-5c15-8ebc-6af09c88c6e3")
DATE = "2020-01-01T00:00:00Z"
#: Elements that begin a line of their own.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul title body html".split())
#: Elements whose content isn't text.
HIDDEN = frozenset("script style noscript template svg".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in [*HIDDEN, "title"]}
_BLANK = re.compile(r"[^\S\n]+")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, block string, record binary"


def _tag_end(page: str, at: int) -> int:
    """Place after the tag whose inside begins at ``at``; quoted values may hold '>'; a tag that isn't closed takes the rest."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    return len(page)


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """(visible text, one line for each block element, blanks folded; title; link targets), in one pass over the page."""
    out, links, title, at, n = [], [], None, 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        out.append(page[at:i])
        if i == n:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(page, i):
            at, name, opens = _tag_end(page, m.end()), m[1].lower(), page[i + 1] != "/"
            if name in BLOCKS:
                out.append("\n")
            if opens and name == "a":
                links += [b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(page[m.end() : at - 1]) if a.lower() == "href"][:1]
            if opens and (name in HIDDEN or name == "title" and title is None):
                close = _CLOSING[name].search(page, at)
                if name == "title":
                    title = page[at : close.start()] if close else ""
                else:
                    at = _tag_end(page, close.end()) if close else n
        else:
            out.append("<")
            at = i + 1
    lines = (_BLANK.sub(" ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    one_line = lambda x: " ".join(html.unescape(x).split())
    return "\n".join(x for x in lines if x), None if title is None else one_line(title), [one_line(x) for x in links]


def plain_text(page: str) -> str:
    return read_page(page)[0]


def header_uri(uri: str) -> str:
    """A target without blanks, line ends and control characters: they are percent-encoded."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", uri)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and block of one record; the inverse of record_bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, warc_date, http_headers, payload of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads = [], []
            page_ids, urls, bodies = (c.to_pylist() for c in batch.columns)
            for i, url, body in zip(page_ids, urls, bodies, strict=True):
                ids.append(f"<urn:uuid:{uuid.uuid5(SPACE, f'response {i} {url}')}>")
                heads.append(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body.encode())}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), batch.column(1), pa.array([date] * len(ids), pa.string()), pa.array(heads, pa.string()), batch.column(2)], names=["page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload"])

    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string")


def derived(page_id: int | None, record_id: str, uri: str, date: str, http: str, payload: str) -> list[tuple]:
    """The two records (rows of SCHEMA) of one response."""
    raw = payload.encode()
    source_block, source_payload = digest(http.encode() + b"\r\n\r\n" + raw), digest(raw)
    text, title, links = read_page(payload)
    uri, record_id, date = header_uri(uri), header_uri(record_id), header_uri(date)
    pairs = [(" ".join(k.split()), " ".join(v.split())) for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:]) if v]
    fields = [f"source-{k.lower()}: {v}" for k, v in pairs]
    fields = [f"source-status: {' '.join(http.split(chr(13))[0].split())}", *fields, f"source-block-digest: {source_block}", f"source-payload-digest: {source_payload}"]
    if title is not None:
        fields.append("title: " + title)
    fields += ["outlink: " + x for x in links]
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in fields)), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode()
        own, mark = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {record_id}')}>", digest(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", mark)]
        headers += [("WARC-Payload-Digest", source_payload), ("Content-Type", content), ("Content-Length", str(len(data)))]
        out.append((page_id, kind, own, record_id, uri, date, content, len(data), mark, source_payload, block, record_bytes(headers, data)))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records, as rows that hold the record's bytes too."""
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(first, 500).columns), strict=True) for r in derived(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return records.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(run, SCHEMA)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages"))).drop("record")
