"""WARC derivatives (operator 3): each response gives a metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To and carry its URI, date, payload and block digests and HTTP headers as they were
(extension fields WARC-Refers-To-...); the metadata record's block holds those too, and title, declared character set and
outlinks. Record ids are made from the response's id and the record's type, so a second run gives the same ids; where a
table has no ids of its responses, one is made from the row's key, URI and payload, so two captures of a URL differ. A record is a header and a block;
`write` puts them out as WARC files through Spark's text writer, whose line separator is the end of a WARC record.

Cases: a null payload counts as empty (its conversion is empty and its digest that of no bytes); a null or empty URI
leaves the URI out of the headers; a null id gets one from the URI and payload; repeated rows give equal records; a very long page is read whole, in time in proportion to its length; an empty
table gives an empty result; further columns don't pass. Line ends within header values become spaces.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm.common import lean, table
from cellsift.llm.markup import INNER, OPEN, TEXT, attributes, scan

DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
RECORDS = "key {key}, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, block_digest string, source_payload_digest string, source_block_digest string, source_headers string, header string, block string"

CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"'/>;]+)", re.I)
HTTP_CHARSET = re.compile(r"^content-type:.*?charset\s*=\s*\"?([^\s\";]+)", re.I | re.M)
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
# Elements that begin a new line.
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body html head option".split())
RAW = frozenset("script style noscript template textarea svg iframe title".split())
#: Elements that link, each with the attribute that holds the link, and L for what a reader follows, E for what a page embeds.
LINKS = {"a": ("href", "L"), "area": ("href", "L"), "form": ("action", "L"), "link": ("href", "E"), "img": ("src", "E"), "iframe": ("src", "E"), "script": ("src", "E")}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


class Page:
    """What the records need of a page, read in one pass: plain text (a line a block, without scripts, styles and comments), links, title, character set."""

    def __init__(self, page: str, base: str):
        parts, found, self.title, self.charset = [], {}, None, None
        for kind, tag, value in scan(page, RAW):
            if kind == TEXT:
                parts.append(value.replace("\r", " ").replace("\n", " "))
                continue
            if kind == INNER:
                if tag == "title" and self.title is None:
                    self.title = one_line(html.unescape(value))
                continue
            if tag in BREAKS:
                parts.append("\n")
            if kind == OPEN and (tag in LINKS or tag == "meta" and self.charset is None):
                held = dict(reversed(attributes(value)))  # the first of a name counts
                if tag == "meta":
                    self.charset = held.get("charset") or next((m[1] for m in [CHARSET.search(held.get("content") or "")] if m), None)
                elif link := absolute(held.get(LINKS[tag][0]), base):
                    found.setdefault(f"{link} {LINKS[tag][1]} {tag}/@{LINKS[tag][0]}", None)
        self.text = LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(parts)))).strip()
        self.links = list(found)


def absolute(link: str | None, base: str) -> str | None:
    """The link as an absolute address; None for what isn't one."""
    link = html.unescape(link or "").strip()
    if not link or link.lower().startswith(("#", "javascript:", "data:", "mailto:")):
        return None
    try:
        return one_line(urljoin(base, link))
    except ValueError:
        return None


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def header(fields: list[tuple[str, str | None]]) -> str:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in fields if v)])


def derive(record_id: str | None, uri: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    """The two records of a response."""
    uri, date, http, payload = uri or "", date or DATE, (http or "").strip("\r\n"), payload or ""
    body = payload.encode("utf-8", "surrogatepass")
    of_payload, of_block = digest(body), digest((http + "\r\n\r\n").encode("utf-8", "surrogatepass") + body)
    source = record_id or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri + of_payload)}"
    ids = {kind: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}" for kind in ("metadata", "conversion")}
    page, stated = Page(payload, uri), HTTP_CHARSET.search(http)
    charset = stated[1] if stated else page.charset
    fields = [f"via-record: <{source}>", f"source-payload-digest: {of_payload}", f"source-block-digest: {of_block}", f"source-length: {len(body)}"]
    fields += [f"http-header: {line}" for line in http.split("\r\n") if line]
    if page.title:
        fields.append(f"title: {page.title}")
    if charset:
        fields.append(f"charset: {charset.lower()}")
    fields += [f"outlink: {x}" for x in page.links]
    out = []
    for kind, other, content, block in (("metadata", "conversion", "application/warc-fields", "\r\n".join(fields) + "\r\n"), ("conversion", "metadata", "text/plain; charset=utf-8", page.text)):
        raw = block.encode("utf-8", "surrogatepass")
        d = digest(raw)
        head = header([("WARC-Type", kind), ("WARC-Record-ID", f"<{ids[kind]}>"), ("WARC-Refers-To", f"<{source}>"), ("WARC-Concurrent-To", f"<{ids[other]}>" if kind == "metadata" else None), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Payload-Digest", of_payload), ("WARC-Refers-To-Block-Digest", of_block), *(("WARC-Refers-To-HTTP-Header", line) for line in http.split("\r\n")), ("WARC-Block-Digest", d), ("Content-Type", content), ("Content-Length", str(len(raw)))])
        out.append((kind, ids[kind], source, uri or None, date, content, len(raw), d, of_payload, of_block, http, head, block))
    return out


def derivatives(responses: DataFrame, key: str = "key") -> DataFrame:
    """Two rows for each row of responses (key, record_id, target_uri, warc_date, http_headers, payload)."""
    schema = RECORDS.format(key=responses.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                rows = [derive(*row) for row in zip(*(part.column(c).to_pylist() for c in range(1, 6)), strict=True)]
                keys = part.column(0).take(pa.array([i for i in range(len(rows)) for _ in range(2)], pa.int64()))
                flat = [r for pair in rows for r in pair]
                columns = [pa.array([r[c] for r in flat], pa.int64() if c == 6 else pa.string()) for c in range(13)]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_block_digest", "source_headers", "header", "block"])

    text = [F.col(c).cast("string") for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")]
    return responses.select(F.col(key).alias("key"), *text).mapInArrow(lean(run), schema)


def responses_of(pages: DataFrame, date: str = DATE, http: str = HTTP) -> DataFrame:
    """Pages as responses; a record id is a hash of page_id, url and payload. The table has no headers and dates: they are parameters, the same for all."""
    seed = F.md5(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.sha1(F.coalesce("html", F.lit("")))))
    name = F.concat(F.lit("urn:uuid:"), F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return pages.select(F.col("page_id").alias("key"), name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(http).alias("http_headers"), F.col("html").alias("payload"))


def write(records: DataFrame, path: str) -> None:
    """WARC files, a record after the other."""
    records.select(F.concat("header", F.lit("\r\n\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses_of(table(spark, sf_dir, "pages")))
    return made.withColumnRenamed("key", "page_id")


QUERIES = {"op3_warc_derivatives": op3_warc_derivatives}
SQL: dict[str, str] = {}
