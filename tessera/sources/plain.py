"""Plain text and article XML to blocks with byte offsets, and stored originals of any kind to documents."""

from __future__ import annotations

import codecs
import re
from typing import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.passages import _LABEL, entry_heading, split_passages
from tessera.sources import html

# The largest original, byte-order marks, and charsets by the names they go under.
LARGEST = 10 << 20
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "windows-1252": "cp1252", "cp1252": "cp1252", "iso-8859-1": "latin-1", "latin1": "latin-1"}
SAME = {"utf-8": ("utf-8", "utf8"), "utf-16-le": ("utf-16", "utf-16le"), "utf-16-be": ("utf-16", "utf-16be")}
_HTML = re.compile(rb"^\s*(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body)[\s>]|<(?:article|main|section|div|h[1-6]|p|table|ul|ol|li|blockquote)\b[^\r\n>]{0,256}>", re.I | re.S)
_ARTICLE = re.compile(rb"^\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*(?:<!doctype\s+article[^>]*>\s*)?<article[\s>]", re.I | re.S)


def _mime(content_type: str) -> tuple[str, str]:
    """A content type without its parameters, and its charset."""
    kind, _, rest = content_type.partition(";")
    m = re.search(r"charset\s*=\s*\"?([^\s;\"]+)", rest, re.I)
    return kind.strip().lower(), m[1].lower() if m else ""


def detect(raw: bytes, content_type: str = "") -> str:
    """jats, html or txt, by the bytes before the declared type; other kinds are refused."""
    if not raw.strip() or len(raw) > LARGEST:
        raise ValueError("the document is empty or too large")
    head, kind = raw.removeprefix(codecs.BOM_UTF8), _mime(content_type)[0]
    bare = head.lstrip()
    if bare.startswith(b"%PDF-"):
        raise ValueError("PDF files are read elsewhere")
    if _ARTICLE.match(head) and kind != "text/html" and not (kind == "" and _HTML.match(head) and not bare.startswith(b"<?xml") and b"<front" not in head):
        return "jats"
    if bare.startswith(b"<?xml") or kind in ("application/xml", "text/xml"):
        raise ValueError("unknown XML")
    if _HTML.search(head) or kind == "text/html":
        return "html"
    if kind not in ("", "text/plain", "application/octet-stream"):
        raise ValueError(f"unknown content type {kind}")
    if re.search(rb"<[/!?][A-Za-z][^>]*>", head):
        raise ValueError("unknown markup")
    return "txt"


def decode(raw: bytes, declared: str = "", markup: bool = False, override: str = "") -> tuple[str, str, int]:
    """Text, charset and the length of the byte-order mark. What a reviewer chose comes before what is declared; either must
    agree with a mark. The head's own word comes next, then UTF-8; unlabelled markup that is not UTF-8 is Windows-1252."""
    label = (override or declared).strip().lower()
    for mark, name in MARKS:
        if raw.startswith(mark):
            if label and label not in SAME[name]:
                raise ValueError("the charset contradicts the byte-order mark")
            return _plain(raw[len(mark) :].decode(name)), name, len(mark)
    if not label and (m := re.search(rb"<meta\s+[^>]*charset\s*=\s*[\"']?([a-z0-9_-]+)", raw[:1024], re.I)):
        label = m[1].decode().lower()
    if not label and markup:
        try:
            return _plain(raw.decode("utf-8")), "utf-8", 0
        except UnicodeDecodeError:
            label = "windows-1252"
    name = CHARSETS.get(label or "utf-8")
    if name is None:
        raise ValueError(f"unknown charset {label}")
    try:
        return _plain(raw.decode(name)), name, 0
    except UnicodeDecodeError as e:
        raise ValueError("the bytes are not text of their charset") from e


def _plain(text: str) -> str:
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text):
        raise ValueError("control characters in text")
    return text


def text_blocks(raw: bytes, limit: int = 1800, declared: str = "", override: str = "") -> list[tuple[str, str, str, int, int]]:
    """(kind, heading, text, start, end): paragraphs between blank lines, headings that stand alone; bytes of the original."""
    text, charset, place = decode(raw, declared, override=override)
    out, heading, at = [], "", 0
    for m in re.finditer(r"\S(?:.*\S)?(?:\r?\n(?=[^\S\r\n]*\S).*)*", text):
        body = m[0].rstrip()
        if "\n" not in body and (entry_heading(body) or _LABEL.match(body) and len(body) < 40):
            heading, spans, kind = body, [(0, len(body))], "heading"
        else:
            spans, kind = split_passages(body, limit), "paragraph"
        for a, b in spans:
            place += len(text[at : m.start() + a].encode(charset))
            own = body[a:b]
            size = len(own.encode(charset))
            out.append((kind, "" if kind == "heading" else heading, own, place, place + size))
            place, at = place + size, m.start() + b
    return out


# Elements of an article that make blocks, and why some of them take no part in retrieval.
ARTICLE = {
    "title": "heading", "article-title": "heading", "p": "paragraph", "list-item": "list", "caption": "caption", "table-wrap-foot": "table_footnote", "ref": "reference", "ack": "acknowledgment",
    "funding-group": "funding", "fn": "footnote", "table": "table", "fig": "figure",
}
LEFT_OUT = {"reference": "reference", "figure": "figure"}
UNREAD = ("graphic", "inline-graphic", "supplementary-material", "disp-formula")


def article_blocks(raw: bytes, deepest: int = 64) -> list[tuple[str, str, str, int, int, str | None]]:
    """(kind, heading, text, start, end, exclusion) of an article; offsets are bytes, as the parser counts them. Each element's
    text holds that of the elements in it; a table's rows are lines and its cells are divided by bars; headings of sections are
    paths; within a list of references only references count, and a figure only with its image."""
    if b"<!ENTITY" in raw.upper():
        raise ValueError("entity declarations are not read")
    parser, out, stack = expat.ParserCreate(), [], []
    tidy = lambda x: " ".join(x.split())

    def start(name: str, attributes: dict) -> None:
        name = name.rpartition(":")[2]
        if not stack and name != "article":
            raise ValueError("not an article")
        if len(stack) >= deepest:
            raise ValueError("nested too deeply")
        if name in ("graphic", "inline-graphic"):
            figure = next((f for f in reversed(stack) if f["name"] == "fig"), None)
            if figure is not None:
                figure["image"] = next((v for k, v in attributes.items() if k.rpartition(":")[2] == "href"), figure["image"])
        above = stack[-1] if stack else {"heading": "", "listed": False}
        stack.append({"name": name, "at": parser.CurrentByteIndex, "text": [], "heading": above["heading"], "listed": above["listed"] or name == "ref-list", "image": ""})

    def end(name: str) -> None:
        f = stack.pop()
        stop = raw.index(b">", parser.CurrentByteIndex) + 1
        within = any(x["name"] == "table" for x in stack)
        if within and f["name"] in ("td", "th", "tr"):
            for x in stack:
                if x["name"] == "table":
                    x["text"].append("\n" if f["name"] == "tr" else "\t")
        kind = ARTICLE.get(f["name"])
        text = "".join(f["text"])
        if kind == "table":
            lines = (" | ".join(tidy(c) for c in line.split("\t")).strip() for line in text.split("\n"))
            text = "\n".join(filter(None, lines))
        else:
            text = tidy(text)
        shut = f["listed"] and f["name"] != "ref" or f["name"] == "p" and within or kind == "figure" and not f["image"]
        if kind and not shut and (text or kind == "figure"):
            if kind == "figure":
                text = f"{text} [image reference: {f['image']}]".strip()
            out.append((kind, text if kind == "heading" else f["heading"], text, f["at"], stop, LEFT_OUT.get(kind)))
        if f["name"] == "title" and stack and stack[-1]["name"] == "sec":
            stack[-1]["heading"] = " / ".join(filter(None, (stack[-1]["heading"], text)))

    def characters(data: str) -> None:
        for f in stack:
            f["text"].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.buffer_text = True
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise ValueError("not well-formed XML") from e
    if not out:
        raise ValueError("the article has no text")
    return out


def extract(raw: bytes, content_type: str = "", override: str = "") -> tuple[str, str, str, list[str], list[tuple]]:
    """(format, charset, title, warnings, blocks: key, kind, heading, text, start, end, exclusion) of an original."""
    form, declared = detect(raw, content_type), _mime(content_type)[1]
    warnings: list[str] = []
    if form == "jats":
        rows = article_blocks(raw)
        title = next((text for kind, _, text, *_ in rows if kind == "heading"), "")
        warnings += [f"{name} needs a review of its own" for name in UNREAD if f"<{name}".encode() in raw]
        return form, "utf-8", title, warnings, [(f"jats-{n:05d}", *r) for n, r in enumerate(rows, 1)]
    if form == "txt":
        text_rows = text_blocks(raw, declared=declared, override=override)
        if not text_rows:
            raise ValueError("the document has no text")
        return form, decode(raw, declared, override=override)[1], "", warnings, [(f"block-{n}", *r, None) for n, r in enumerate(text_rows, 1)]
    source, charset, mark = decode(raw, declared, True, override)
    found = html.page_blocks(source)
    if not found:
        raise ValueError("the document has no text")
    places = _original(source, charset, mark, sorted({x for b in found for x in (b.start, b.end)}))
    warnings.append("block boundaries need a review before exact citations")
    if re.search(r"<table\b", source, re.I):
        warnings.append("rows and columns of tables are not verified")
    return form, charset, html.page_title(source), warnings, [(b.key, b.kind, b.heading, b.text, places[b.start], places[b.end], b.exclusion) for b in found]


def _original(source: str, charset: str, mark: int, offsets: list[int]) -> dict[int, int]:
    """Offsets in the original's bytes of ascending offsets in the UTF-8 form of its text."""
    if charset == "utf-8":
        return {x: x + mark for x in offsets}
    whole, out, at, place = source.encode("utf-8", "surrogatepass"), {}, 0, mark
    for x in offsets:
        place += len(whole[at:x].decode("utf-8", "surrogatepass").encode(charset, "surrogatepass"))
        out[x], at = place, x
    return out


def documents(files: DataFrame) -> DataFrame:
    """(path, format, charset, title, warnings, blocks, problem) of originals (path, content, and if they are known content_type
    and charset); what cannot be read says why and has no blocks."""
    from pyspark.sql import functions as F

    given = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in files.columns else F.lit("").alias(c) for c in ("content_type", "charset")]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "kind", "heading", "text", "start", "end", "exclusion"]
        for frame in frames:
            for path, raw, kind, chosen in zip(*(frame[c] for c in ("path", "content", "content_type", "charset"))):
                try:
                    form, charset, title, warnings, rows = extract(bytes(raw), kind, chosen)
                    row = (path, form, charset, title, warnings, [dict(zip(names, r)) for r in rows], None)
                except ValueError as e:
                    row = (path, None, None, None, [], [], str(e))
                yield pd.DataFrame([row], columns=["path", "format", "charset", "title", "warnings", "blocks", "problem"])

    block = "array<struct<key:string,kind:string,heading:string,text:string,start:int,end:int,exclusion:string>>"
    return files.select("path", "content", *given).mapInPandas(task, f"path string, format string, charset string, title string, warnings array<string>, blocks {block}, problem string")
