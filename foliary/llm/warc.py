"""WARC derivatives: response records become linked metadata and plain-text conversion records.

For each response record two records are made, as a web archive's metadata and text files hold them:

* ``metadata`` (application/json): the source record's headers in their order, the HTTP status line and headers, the
  payload's length and digest and whether the stated digest agrees (null if there is none that can be told), the page's
  title, language and links;
* ``conversion`` (text/plain): the visible text of an HTML or plain-text payload in UTF-8.

A payload is what a response's chunks hold; gzip, deflate and zstd codings are undone for its text. ``read_files`` reads
records from WARC files, ``responses`` makes them of a table of pages.

Both refer to the source record by WARC-Refers-To, carry its target URI, date and payload digest, name each other in
WARC-Concurrent-To, and have ids derived from the source id, so that a repeated run makes the same records.

Defined cases: records of other types, such as requests, make none; a record that is null or cannot be parsed makes a metadata
record that says so and refers to nothing; a payload that is neither HTML nor plain text, or whose content coding cannot
be undone, makes no conversion record, and the metadata record names the fault; an empty one makes an empty one; a
response without an id gets one of its digest; repeated rows make equal records; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.markup import attributes, tokens
from foliary.llm.scratch import open_fs

VERSION = "WARC/1.0"
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)

# fixed values: elements that begin a new line, and attributes that hold links
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table td th tr ul".split())
LINKS = {"a": "href", "link": "href", "area": "href", "img": "src", "iframe": "src", "script": "src"}
#: Bytes that a reader of files takes at a time.
CHUNK = 1 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def agrees(stated: str, data: bytes) -> bool | None:
    """Whether a stated digest, in base 32 or hexadecimal digits, is that of the data; None if it cannot be told."""
    name, _, value = stated.partition(":")
    if not value or name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    found = hashlib.new(name.lower().replace("-", ""), data).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record's bytes; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}" for k, v in headers if v), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"\s*[\r\n]+\s*", " ", value).strip()


def _headers(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the headers; a line that begins with white space continues the one before."""
    first, *lines = re.split(rb"\r?\n", head)
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            k, _, v = text.partition(":")
            out.append((k.strip(), v.strip()))
    return first.decode("utf-8", "replace").strip(), out


def _get(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), "")


def read_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record, which may be gzipped; ValueError if it is none."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    m = _HEAD_END.search(data)
    if not data.startswith(b"WARC/") or not m:
        raise ValueError("not a WARC record")
    _, headers = _headers(data[: m.start()])
    length = _get(headers, "Content-Length")
    if not length.isdigit() or m.end() + int(length) > len(data):
        raise ValueError("block shorter than its Content-Length")
    return headers, data[m.end() : m.end() + int(length)]


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of a file's bytes, gzipped by record or as a whole, or plain."""
    if data[:2] == b"\x1f\x8b":
        rest = data
        while rest[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            yield from read_records(d.decompress(rest) + d.flush())
            rest = d.unused_data.lstrip(b"\r\n")
        return
    while data.startswith(b"WARC/"):
        m = _HEAD_END.search(data)
        length = _get(_headers(data[: m.start()])[1], "Content-Length") if m else ""
        end = m.end() + int(length) if length.isdigit() else len(data)
        yield data[:end]
        data = data[end:].lstrip(b"\r\n")


def read_stream(file: BinaryIO) -> Iterator[bytes]:
    """The records of an open WARC file, plain or gzipped; it holds one record at a time."""
    first = file.read(2)
    plain = _gunzipped(file, first) if first == b"\x1f\x8b" else itertools.chain([first], iter(lambda: file.read(CHUNK), b""))
    held = bytearray()

    def more() -> bool:
        part = next(plain, b"")
        held.extend(part)
        return bool(part)

    while True:
        while held[:1] in (b"\r", b"\n") or (not held and more()):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        while not (m := _HEAD_END.search(held)) and more():
            pass
        if not held:
            return
        length = _get(_headers(bytes(held[: m.start()]))[1], "Content-Length") if m else ""
        end = m.end() + int(length) if length.isdigit() else 0
        while (not end or len(held) < end) and more():
            pass
        yield bytes(held[: end or len(held)])  # what cannot be parsed is handed on as it stands
        del held[: end or len(held)]


def _gunzipped(file: BinaryIO, data: bytes) -> Iterator[bytes]:
    """The bytes of all members of a gzipped file, of a broken one those before the fault."""
    d = zlib.decompressobj(31)
    while data or (data := file.read(CHUNK)):
        try:
            out = d.decompress(data, CHUNK)
        except zlib.error:
            return
        if out:
            yield out
        data = d.unconsumed_tail or d.unused_data
        if d.eof:
            data = data.lstrip(b"\0")
            d = zlib.decompressobj(31)


def _payload(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response, its chunks joined."""
    m = _HEAD_END.search(block)
    if not block.startswith(b"HTTP/") or not m:
        raise ValueError("not an HTTP response")
    status, headers = _headers(block[: m.start()])
    return status, headers, block[m.end() :]


def _joined(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without its chunks' sizes; as it stands if it has none."""
    if "chunked" not in _get(headers, "Transfer-Encoding").lower():
        return body
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        if int(size, 16) == 0:
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def _decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body with its content codings undone; ValueError for one that cannot be."""
    for coding in reversed([c.strip().lower() for c in _get(headers, "Content-Encoding").split(",")]):
        try:
            if coding in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
                body = zlib.decompressobj(31).decompress(body)
            elif coding == "deflate" and body:
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:  # some servers leave out the zlib header
                    d = zlib.decompressobj(-15)
                    body = d.decompress(body)
                    if not d.eof:
                        raise
            elif coding == "zstd" and body:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif coding not in ("", "identity", "gzip", "x-gzip", "deflate", "zstd"):
                raise ValueError(f"the content coding {coding} is not known")
        except (zlib.error, zstandard.ZstdError) as e:
            raise ValueError(f"the content coding {coding} is broken: {e}") from e
    return body


def _text(content_type: str, body: bytes) -> str:
    named = _CHARSET.search(content_type) or None
    found = named[1] if named else (m[1].decode("ascii", "replace") if (m := _META_CHARSET.search(body[:4096])) else "utf-8")
    try:
        return body.decode(found, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def read_page(source: str) -> tuple[str, str, list[dict[str, str]], str]:
    """Title, language, links and the visible text of a page, a line per block."""
    title, language, links, parts = None, "", [], []
    for kind, tag, value in tokens(source):
        if kind == "text":
            parts.append(value.replace("\n", " "))
        elif kind == "raw":
            if tag == "title" and title is None:
                title = value
        else:
            if tag in BREAKS:
                parts.append("\n")
            if kind == "open" and (tag in LINKS or (tag == "html" and not language)):
                have = attributes(value)
                if tag == "html":
                    language = have.get("lang", "")
                elif LINKS[tag] in have:
                    links.append({"tag": tag, "url": have[LINKS[tag]].strip()})
    lines = (" ".join(html.unescape(x).split()) for x in "".join(parts).split("\n"))
    return " ".join(html.unescape(title or "").split()), language, links, "\n".join(x for x in lines if x)


def derive(record: bytes | None) -> list[tuple[str, str, str, list[tuple[str, str]], bytes]]:
    """(type, id, refers-to, headers, block) of the records made from one record."""
    try:
        headers, block = read_record(record or b"")
    except (ValueError, OSError, EOFError, zlib.error) as e:
        own = derived_id(digest(record or b""), "metadata")
        made = json.dumps({"error": str(e)}).encode()
        return [("metadata", own, "", [("WARC-Type", "metadata"), ("WARC-Record-ID", own), ("WARC-Block-Digest", digest(made)), ("Content-Type", "application/json")], made)]
    if _get(headers, "WARC-Type").lower() != "response":
        return []
    source = _get(headers, "WARC-Record-ID") or derived_id(digest(record), "response")
    error = ""
    try:
        status, http, body = _payload(block)
    except ValueError as e:
        status, http, body, error = "", [], block, str(e)
    whole = _joined(http, body)
    stated, found = _get(headers, "WARC-Payload-Digest"), digest(whole)
    # a payload is what the chunks hold; some crawlers take the digest of the chunks themselves
    same = agrees(stated, whole) or (agrees(stated, body) if whole != body else agrees(stated, whole))
    plain: bytes | None = None
    try:
        plain = _decoded(http, whole)
    except ValueError as e:
        error = error or str(e)
    kind = _get(http, "Content-Type").split(";")[0].strip().lower()
    is_html, is_text = kind in ("text/html", "application/xhtml+xml"), kind == "text/plain"
    readable = (is_html or is_text) and plain is not None
    text = _text(_get(http, "Content-Type"), plain) if readable else ""
    about = {"Envelope": {"WARC-Headers": headers, "Payload": {"HTTP-Status": status, "HTTP-Headers": http, "Length": len(whole), "Digest": found, "Digest-Agrees": same}}}
    shown = text
    if is_html and readable:
        title, language, links, shown = read_page(text)
        about["HTML"] = {"Title": title, "Language": language, "Links": links}
    if error:
        about["Error"] = error
    blocks = [("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "surrogatepass"))]
    if readable:
        blocks.append(("conversion", "text/plain; charset=utf-8", shown.encode("utf-8", "surrogatepass")))
    ids = [derived_id(source, t) for t, _, _ in blocks]
    out = []
    for n, (t, content_type, data) in enumerate(blocks):
        own = [("WARC-Type", t), ("WARC-Record-ID", ids[n]), ("WARC-Refers-To", source), ("WARC-Target-URI", _get(headers, "WARC-Target-URI")), ("WARC-Date", _get(headers, "WARC-Date"))]
        own += [("WARC-Concurrent-To", i) for i in ids if i != ids[n]]
        own += [("WARC-Payload-Digest", stated or found), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type)]
        out.append((t, ids[n], source, [(k, v) for k, v in own if v], data))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (id, record) of a table of pages, as a crawler would have written them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, url, page in zip(*(batch[c].to_pylist() for c in ("id", "url", "html")), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id(f"{i}|{url}", "response")), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                made.append(write_record(headers, block))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(made, pa.binary())], ["id", "record"])

    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(rows, "id long, record binary")


def build(records: DataFrame, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """A row per derived record: id, warc_type, record_id, refers_to, target_uri, warc_date, payload_digest, block_digest, content_type, n_bytes, headers, block."""
    names = ["id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "block_digest", "content_type", "n_bytes", "headers", "block"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, record in zip(batch["id"].to_pylist(), batch["record"].to_pylist(), strict=True):
                for t, own, source, headers, block in derive(record):
                    have = [_get(headers, k) or None for k in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type")]
                    out.append((i, t, own, source or None, *have, len(block), [{"name": k, "value": v} for k, v in headers], block))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_type string, n_bytes long, headers array<struct<name: string, value: string>>, block binary"
    return records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("binary").alias("record")).mapInArrow(rows, schema)


def record_bytes(headers: list, block: bytes) -> bytes:
    """The bytes of a row of ``build``, to be written into a WARC file."""
    return write_record([(h["name"], h["value"]) for h in headers], bytes(block))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records (id, path, number, record) of the WARC files under a path or glob; each file is streamed by one task."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                store, inside = open_fs(name)
                with store.open_input_stream(inside, compression=None) as file:
                    for n, record in enumerate(read_stream(file)):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([record], pa.binary())], ["path", "number", "record"])

    found = files.repartition(max(1, files.count())).mapInArrow(rows, "path string, number long, record binary")
    return found.select(F.xxhash64("path", "number").alias("id"), "path", "number", "record")
