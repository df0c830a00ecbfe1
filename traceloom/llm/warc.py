"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it by its identifier. The metadata record keeps the
source's headers and digests and lists what the page says about itself; the conversion record holds
its text. Identifiers are hashed from the source, so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from bisect import bisect_left
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import pieces

DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"

_BLOCK = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|"
          "main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul")
_DROPPED = ("script", "style", "noscript", "template", "head", "svg")
_DROP_OPEN = re.compile(rf"<!--|<({'|'.join(_DROPPED)})\b", re.I)
_DROP_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _DROPPED}
_TAG_OPEN = re.compile(rf"</?(?:(?P<block>{_BLOCK})(?=[\s/>])|[a-zA-Z!?])", re.I)
#: What follows a tag's name, to its end: a quote holds everything up to the next one like it.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARKS = re.compile(r"[>\"']")
_TITLE_OPEN = re.compile(r"<title\b", re.I)
_TITLE_CLOSE = re.compile(r"</title\s*+>", re.I)
_HTML_OPEN, _META_OPEN = re.compile(r"<html\b", re.I), re.compile(r"<meta\b", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"\bcharset\s*+=\s*+[\"']?([\w-]+)", re.I)
_LINK_OPEN = re.compile(r"<a\s", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+", re.I)
_VALUE = re.compile(r"\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)")
_SPACE = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Ends:
    """End of the tag whose name ends at a place, or None; linear over all places of a page.

    A match costs what it consumes. The first tag without an end makes a table of the ends from every
    ``>`` and quote, filled from the back, so that a page of unclosed tags is not read once per tag.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.places: list[int] | None = None
        self.ends: list[int | None] = []

    def __call__(self, at: int) -> int | None:
        if self.places is None:
            if m := _REST.match(self.page, at):
                return m.end()
            self._fill()
        own = bisect_left(self.places, at)
        return self.ends[own] if own < len(self.places) else None

    def _fill(self) -> None:
        self.places = [m.start() for m in _MARKS.finditer(self.page)]
        self.ends = [None] * len(self.places)
        later: dict[str, int] = {}
        for i in range(len(self.places) - 1, -1, -1):
            mark = self.page[self.places[i]]
            if mark == ">":
                self.ends[i] = self.places[i] + 1
                continue
            closing = later.get(mark)
            if closing is not None and closing + 1 < len(self.places):
                self.ends[i] = self.ends[closing + 1]
            later[mark] = i


def _without_dropped(page: str) -> str:
    """The page without comments, scripts, styles and the like; what is never closed goes to the end."""
    ends, kept, from_, at = _Ends(page), [], 0, 0
    while m := _DROP_OPEN.search(page, at):
        if m.group(1) is None:
            close = page.find("-->", m.end())
            upto = len(page) if close < 0 else close + 3
        else:
            inside = ends(m.end())
            if inside is None:
                at = m.end()
                continue
            close = _DROP_CLOSE[m.group(1).lower()].search(page, inside)
            upto = close.end() if close else len(page)
        kept.append(page[from_ : m.start()])
        from_ = at = upto
    return "".join([*kept, page[from_:]])


def _without_tags(page: str, line: str = "\n") -> str:
    """The page without tags, with ``line`` in the place of those that end a line."""
    ends, kept, from_, at = _Ends(page), [], 0, 0
    while m := _TAG_OPEN.search(page, at):
        upto = ends(m.end())
        if upto is None:
            at = m.end()
            continue
        kept.append(page[from_ : m.start()])
        if m.group("block"):
            kept.append(line)
        from_ = at = upto
    return "".join([*kept, page[from_:]])


def plain_text(page: str) -> str:
    """Text of a page: no scripts, styles or head, one line per block, single spaces."""
    bare = _without_tags(_without_dropped(page))
    lines = (_SPACE.sub(" ", line).strip() for line in entities.unescape(bare).split("\n"))
    return "\n".join(line for line in lines if line)


def _one_line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _tags(page: str, opening: re.Pattern):
    """(begin, end) of what a tag's name is followed by up to the next ``>``; openings inside count once."""
    at = 0
    while m := opening.search(page, at):
        close = page.find(">", m.end())
        at = len(page) if close < 0 else close
        yield m.end(), at


def _title(page: str) -> str | None:
    m = _TITLE_OPEN.search(page)
    begin = page.find(">", m.end()) + 1 if m else 0
    close = _TITLE_CLOSE.search(page, begin) if begin else None
    return _without_tags(page[begin : close.start()], "") if close else None


def _attribute(page: str, opening: re.Pattern, pattern: re.Pattern) -> str | None:
    found = (pattern.search(page, begin, end) for begin, end in _tags(page, opening))
    return next((m.group(1) for m in found if m), None)


def _links(page: str):
    """Values of the first ``href`` of every anchor that has one."""
    past = 0
    for begin, end in _tags(page, _LINK_OPEN):
        at = max(begin, past)
        while at < end and (m := _HREF.search(page, at, end)):
            if value := _VALUE.match(page, m.end()):
                yield next(g for g in value.groups() if g is not None)
                past = value.end()
                break
            at = m.end()


def page_facts(page: str, uri: str | None) -> list[tuple[str, str]]:
    """Title, language, charset and outlinks of a page, as named fields."""
    said = (("title", _title(page)), ("language", _attribute(page, _HTML_OPEN, _LANG)),
            ("charset", _attribute(page, _META_OPEN, _CHARSET)))
    facts = [(name, _one_line(value)) for name, value in said if value is not None]
    for value in _links(page):
        link = _one_line(value)
        try:
            facts.append(("outlink", urljoin(uri, link) if uri else link))
        except ValueError:
            facts.append(("outlink", link))
    return facts


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, uri, date, http_header, payload: response records of a table of fetched pages.

    A null url or page is an empty one.
    """
    body = F.coalesce("html", F.lit(""))
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("uri"), F.lit(date).alias("date"),
                        header.alias("http_header"), body.alias("payload"))


_KIND = ("warc_type string, record_id string, refers_to string, target_uri string, content_type string, "
         "block_digest string, content_length long, source_payload_digest string, header string, body string")


def _header(fields: list[tuple[str, str]]) -> str:
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields if v)]) + "\r\n\r\n"


def derived(key: str, uri: str, date: str, http_header: str, payload: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    raw = payload.encode()
    payload_digest, block = digest(raw), digest(http_header.encode() + raw)
    source = record_id("response", key, uri, payload_digest)
    uri = " ".join(uri.split())
    text = plain_text(payload)
    conversion = record_id("conversion", source)
    facts = [("source-record-id", source), ("source-block-digest", block),
             ("source-payload-digest", payload_digest), ("conversion-record-id", conversion)]
    lines = http_header.rstrip("\r\n").split("\r\n")
    facts += [("source-status", lines[0]), *(("source-header", line) for line in lines[1:])]
    facts += page_facts(payload, uri)
    meta = "".join(f"{k}: {v}\r\n" for k, v in facts)
    out = []
    for kind, own, content, body in (
        ("metadata", record_id("metadata", source), "application/warc-fields", meta),
        ("conversion", conversion, "text/plain; charset=utf-8", text),
    ):
        data = body.encode()
        header = _header([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Block-Digest", digest(data)), ("Content-Type", content), ("Content-Length", str(len(data)))])
        out.append((kind, own, source, uri, content, digest(data), len(data), payload_digest, header, body))
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: page_id, the record's fields, its header and its body.

    Every response is handled where it is read; nothing is shuffled. Repeated responses give repeated
    records with the same identifiers, an empty or null page an empty conversion record, an empty
    table no rows. Other columns are not carried along. Markup is scanned in time linear in the page.
    """

    def run(batches):
        for batch in pieces(batches):
            ids = batch.column("page_id").to_pylist()
            columns = (batch.column(c).to_pylist() for c in ("uri", "date", "http_header", "payload"))
            made = [derived("" if i is None else str(i), *rest) for i, *rest in zip(ids, *columns, strict=True)]
            rows = [row for pair in made for row in pair]
            fields = list(zip(*rows, strict=True)) or [()] * 10
            types = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").take(pa.array([r for r in range(len(ids)) for _ in (0, 1)], pa.int64())),
                 *[pa.array(f, t) for f, t in zip(fields, types, strict=True)]],
                names=["page_id", *(x.split()[0] for x in _KIND.split(", "))])

    kind = f"page_id {dict(records.dtypes)['page_id']}, {_KIND}"
    return records.mapInArrow(run, kind)


def record_text() -> Column:
    """A whole record as it stands in a WARC file."""
    return F.concat("header", "body", F.lit("\r\n\r\n"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files with UTF-8 records, one per task; the writer's line end is each record's last byte."""
    lines = records.select(F.concat("header", "body", F.lit("\r\n\r")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").text(path)
