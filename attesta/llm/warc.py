"""WARC derivatives: metadata and plain-text conversion records out of response records.

A record is a row: its header fields in order, its block as bytes, and the fields most asked for as columns.  Ids of
derived records follow from the id of the response, so a repeated run gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from html import unescape
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import slices

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, " \
         "content_type string, block_digest string, payload_digest string, content_length long, " \
         "headers array<struct<name:string,value:string>>, block binary"
_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("content_type", pa.string()), ("block_digest", pa.string()),
    ("payload_digest", pa.string()), ("content_length", pa.int64()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])

# elements whose text is not shown (beside scripts and styles), and elements that end a line
_HIDDEN = {"noscript", "template", "head"}
_IN_HEAD = {"html", "head", "title", "meta", "link", "base", "noscript", "template"}   # scripts, styles: see _MARKUP
_LINES = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "main",
          "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "aside", "form", "dd", "dt"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id, kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> tuple:
    """A record in the order of ``RECORD``, its header fields as pairs."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *[(n, v) for n, v in fields if v is not None],
               ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    of = dict(headers)
    return (page_id, kind, record_id, of.get("WARC-Refers-To"), of.get("WARC-Target-URI"), of.get("Content-Type"),
            of["WARC-Block-Digest"], of.get("WARC-Payload-Digest"), len(block), headers, block)


def _batch(records: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*records))
    fields = [f for headers in columns[9] for f in headers]
    pairs = pa.StructArray.from_arrays([pa.array([n for n, _ in fields], pa.string()),
                                        pa.array([v for _, v in fields], pa.string())], ["name", "value"])
    ends = pa.array([0, *accumulate(map(len, columns[9]))], pa.int32())
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA) if f.name != "headers"]
    arrays.insert(9, pa.ListArray.from_arrays(ends, pairs))
    return pa.RecordBatch.from_arrays(arrays, _SCHEMA.names)


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _one_line(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\r\n\x00]+", " ", value)


def _response(page, url: str | None, html: str | None, date: str) -> tuple:
    payload = (html or "").encode()
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
             % len(payload)) + payload
    of_payload = digest(payload)
    return _record(page, "response", _urn(f"{page} {url} {of_payload}"), [
        ("WARC-Target-URI", _one_line(url)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", of_payload)], block)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (``page_id, url, html``).  A missing page is an empty one, a missing address
    gives no target; equal rows give equal records.  An empty table gives no rows."""
    def make(batches):
        for batch in slices(batches, "html"):
            rows = zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")])
            yield _batch([_response(*row, date) for row in rows])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(make, RECORD)


def page_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``derivatives(responses(pages))`` in one pass: a page goes to a task's Python worker once."""
    def make(batches):
        for batch in slices(batches, "html"):
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")]):
                page, *_, headers, block = _response(*row, date)
                out += _derived(page, dict(headers), block)
            yield _batch(out)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(make, RECORD)


# comments, elements that hold no markup (up to their end tag), tags and declarations; a tag's end is the first ``>``
# outside quotes
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*>""", re.I | re.S)
# the tags that tell whether a title, noscript or template is closed: the first one after it is its end tag
_CLOSING = {"title": re.compile(r"<(?:(/title)|title|/?(?:head|body))(?=[\s/>])", re.I),
            "noscript": re.compile(r"<(?:(/noscript)|noscript|/?(?:head|body))(?=[\s/>])", re.I),
            "template": re.compile(r"<(?:(/template)|/?(?:head|body))(?=[\s/>])", re.I)}
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# where joining addresses is putting them one after the other
_ROOT = re.compile(r"https?://[\w.:-]+(?=/|\Z)")
_PLAIN_PATH = re.compile(r"(?:/[\w-]+)+")
_BLANKS = re.compile(r"[\t\x0b\x0c\r\x20\xa0]+")


def plain_text(html: str) -> tuple[str, str, list[str]]:
    """(text, title, links): lines without surrounding blanks, runs of blanks as one, empty lines dropped.

    A head without its end tag ends at the first text or start tag that cannot stand in it, a title without one at the
    next tag; a noscript or template without one hides nothing."""
    text, titles, links, hidden, in_title, closed, at = [], [], [], [], False, False, 0

    def has_end(tag: str, after: int) -> bool:
        found = _CLOSING[tag].search(html, after)
        return found is not None and found[1] is not None

    def shown(piece: str) -> None:
        if in_title:
            titles.append(unescape(piece))
            return
        if hidden == ["head"] and not piece.isspace():
            hidden.clear()
        if not hidden:
            text.append(unescape(piece) if "&" in piece else piece)

    for m in _MARKUP.finditer(html, 0, html.rfind(">") + 1):
        begin, end = m.span()
        if begin > at:
            shown(html[at:begin])
        at = end
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if in_title and not closed:
            in_title = False
        if hidden == ["head"] and not m[2] and tag not in _IN_HEAD:
            hidden.clear()
        if tag == "title":
            in_title = not m[2]
            closed = in_title and has_end(tag, end)
        elif tag in _HIDDEN:
            if not m[2]:
                if tag == "head" or has_end(tag, end):
                    hidden.append(tag)
            elif tag in hidden:
                del hidden[hidden.index(tag):]
        elif tag == "body":
            hidden.clear()
        elif tag == "a" and not m[2]:
            found = _HREF.search(m[4])
            link = found and next((x for x in found.groups() if x), None)
            if link:
                links.append(unescape(link))
        if tag in _LINES:
            text.append("\n")
    if at < len(html):
        shown(html[at:])
    lines = map(str.strip, _BLANKS.sub(" ", "".join(text)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(titles).split()), links


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of an HTTP response; compressed payloads are unpacked.  A block without
    an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    fields = [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines) if n]
    if any(n.lower() == "content-encoding" and v.lower() in ("gzip", "x-gzip", "deflate") for n, v in fields):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    return status, fields, payload


def _charset(fields: list[tuple[str, str]]) -> str:
    kind = next((v for n, v in fields if n.lower() == "content-type"), "")
    found = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        return "".encode(found.group(1)) is not None and found.group(1) if found else "utf-8"
    except LookupError:
        return "utf-8"


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: ``metadata`` (title, links, fields of the HTTP head, source digests) and
    ``conversion`` (plain text).  Both refer to the response by ``WARC-Refers-To``, keep its target, date and payload
    digest, and carry digests of their own blocks.  Records of other types are passed over; every page is handled in
    its own row and nothing is exchanged."""
    def make(batches):
        for batch in slices(batches, "block"):
            out = []
            for page, headers, block in zip(*[batch.column(c).to_pylist() for c in ("page_id", "headers", "block")]):
                out += _derived(page, {h["name"]: h["value"] for h in headers}, block or b"")
            yield _batch(out)

    return records.where("record_type = 'response'").select("page_id", "headers", "block").mapInArrow(make, RECORD)


def _derived(page, source: dict[str, str], block: bytes) -> list[tuple]:
    status, fields, payload = http_parts(block)
    text, title, links = plain_text(payload.decode(_charset(fields), "replace"))
    response, target = source["WARC-Record-ID"], source.get("WARC-Target-URI")
    common = [("WARC-Refers-To", response), ("WARC-Refers-To-Target-URI", target),
              ("WARC-Refers-To-Date", source.get("WARC-Date")), ("WARC-Target-URI", target),
              ("WARC-Date", source.get("WARC-Date"))]
    facts = [("http-status", status), *[(f"http-{n.lower()}", v) for n, v in fields], ("title", title),
             ("source-block-digest", source.get("WARC-Block-Digest")),
             ("source-payload-digest", source.get("WARC-Payload-Digest"))]
    root = _ROOT.match(target or "")
    for link in links:
        try:
            plain = root and _PLAIN_PATH.fullmatch(link)
            facts.append(("outlink", root[0] + link if plain else urljoin(target or "", link)))
        except ValueError:
            facts.append(("outlink", link))
    about = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in facts if v).encode()
    shown = text.encode()
    return [
        _record(page, "metadata", _urn(response + " metadata"), [*common, ("Content-Type", "application/warc-fields")],
                about),
        _record(page, "conversion", _urn(response + " conversion"), [
            *common, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(shown)),
            ("WARC-Source-Payload-Digest", source.get("WARC-Payload-Digest"))], shown)]


def serialised(headers: list[dict], block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    head = b"".join(f"{h['name']}: {h['value']}\r\n".encode() for h in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def write_files(records: DataFrame, path: str) -> DataFrame:
    """Write ``.warc.gz`` files below ``path``, one per partition and one compressed member per record, and return the
    index ``record_id, file, offset, length``.  A file appears under its name only when it is whole, and a repeated
    task writes the same name."""
    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        partial = f"{folder}/.{name}.{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        index, at = [], 0
        with store.open_output_stream(partial, compression=None) as out:
            for batch in slices(batches, "block"):
                for i, headers, block in zip(*[batch.column(c).to_pylist() for c in ("record_id", "headers", "block")]):
                    member = gzip.compress(serialised(headers, block), mtime=0)
                    out.write(member)
                    index.append({"record_id": i, "file": name, "offset": at, "length": len(member)})
                    at += len(member)
        store.move(partial, f"{folder}/{name}")
        yield pa.RecordBatch.from_pylist(index, schema=pa.schema([
            ("record_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return records.select("record_id", "headers", "block").mapInArrow(
        write, "record_id string, file string, offset long, length long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``headers`` and ``block`` of every record in the files below ``path``, through Spark's own reader."""
    schema = pa.schema([("headers", _SCHEMA.field("headers").type), ("block", pa.binary())])

    def parse(batches):
        for batch in slices(batches, "content"):
            for content in batch.column("content").to_pylist():
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))
                while line := stream.readline():
                    if not line.strip():
                        continue
                    headers = []
                    while (line := stream.readline()).strip():
                        name, _, value = line.decode().partition(":")
                        headers.append({"name": name.strip(), "value": value.strip()})
                    length = int(next(h["value"] for h in headers if h["name"].lower() == "content-length"))
                    yield pa.RecordBatch.from_pylist([{"headers": headers, "block": stream.read(length)}],
                                                     schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content") \
        .mapInArrow(parse, "headers array<struct<name:string,value:string>>, block binary")
