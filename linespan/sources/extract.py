"""Files of document formats as lines with sections: mail, books, Word and OpenDocument texts, slides, RTF, pages of HTML.

Spark reads the files and spreads them; a small function turns one file's bytes into lines, the markers
that stand between them (`--- page 3 ---`, at: lines ahead) and the sections that the markers open (first and
last line).  Marker i opens section i, so `operators.sections` shows the chain of every line.  Formats that need
a parser that isn't here are refused with a reason, as rows, so a job goes on without them.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

REFUSED = {
    "pdf": "PDF needs a parser that isn't installed", "doc": "old Word files need a parser that isn't installed", "ppt": "old slides need a parser that isn't installed",
    "msg": "Outlook mail needs a parser that isn't installed", "xlsx": "spreadsheets are not read", "xls": "spreadsheets are not read", "ods": "spreadsheets are not read",
} | {k: f"unsupported format: image ({v}), no OCR" for k, v in {"png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "gif": "GIF", "bmp": "BMP", "webp": "WebP", "tif": "TIFF", "tiff": "TIFF"}.items()}
LIMIT = 50 << 20
_BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "title", "hr", "blockquote", "pre"}


class _Text(HTMLParser):
    """Text of HTML, a line a block, cells of a row joined by a bar."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.hidden += 1
        elif tag in _BREAK:
            self.out.append("")
        elif tag in ("td", "th") and self.out[-1].strip():
            self.out[-1] += " | "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BREAK:
            self.out.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1] += data


def _html(text: str) -> list[str]:
    p = _Text()
    p.feed(text)
    return [x for x in map(_plain, p.out) if x]


class Doc:
    """Lines, markers and sections of one document, as they are read."""

    def __init__(self):
        self.lines: list[str] = []
        self.markers: list[dict] = []
        self.sections: list[dict] = []

    def add(self, *lines: str) -> None:
        self.lines += lines

    def open(self, text: str, kind: str, num: int | None = None, label: str | None = None) -> dict:
        """A section from the next line on; `close` ends it, or drops it with its marker if it has no line."""
        self.markers.append({"at": len(self.lines), "text": f"--- {text} ---"})
        self.sections.append({"kind": kind, "num": num, "label": label, "start": len(self.lines) + 1, "end": 0})
        return self.sections[-1]

    def close(self, section: dict) -> None:
        section["end"] = len(self.lines)
        if section["end"] < section["start"]:
            k = next(i for i, s in enumerate(self.sections) if s is section)
            del self.sections[k], self.markers[k]

    def nest(self, other: Doc) -> None:
        """Another document's lines here, its sections moved along."""
        by = len(self.lines)
        self.lines += other.lines
        self.markers += [m | {"at": m["at"] + by} for m in other.markers]
        self.sections += [s | {"start": s["start"] + by, "end": s["end"] + by} for s in other.sections]


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\u00ad", "")).strip()


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ElementTree.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _inner(e: ElementTree.Element, skip: set[str]) -> str:
    """Text of an element, tabs and breaks as blanks."""
    name = _local(e)
    if name in skip:
        return e.tail or ""
    own = " " if name in ("tab", "br", "line-break", "s") else ""
    return own + (e.text or "") + "".join(_inner(x, skip) for x in e) + (e.tail or "")


def _walk(e: ElementTree.Element, doc: Doc, blocks: set[str], rows: set[str], cells: set[str], skip: set[str] = frozenset()) -> None:
    """A line for each block, and for each row of a table with a bar between its cells."""
    for x in e:
        name = _local(x)
        if name in skip:
            continue
        if name in rows:
            parts = [_plain(_inner(c, skip)) for c in x if _local(c) in cells]
            doc.add(*([" | ".join(parts)] if any(parts) else []))
        elif name in blocks:
            text = _plain(_inner(x, skip).removesuffix(x.tail or "") if x.tail else _inner(x, skip))
            doc.add(*([text] if text else []))
        else:
            _walk(x, doc, blocks, rows, cells, skip)


_ODF = ({"p", "h"}, {"table-row"}, {"table-cell", "covered-table-cell"})


def _word(data: bytes) -> Doc:
    z, doc = zipfile.ZipFile(io.BytesIO(data)), Doc()
    for part in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml"):  # notes follow the body
        if part == "word/document.xml" or part in z.namelist():
            _walk(ElementTree.fromstring(z.read(part)), doc, {"p"}, {"tr"}, {"tc"}, {"del", "instrText"})
    return doc


def _odt(data: bytes) -> Doc:
    root, doc = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml")), Doc()
    body = next((e for e in root.iter() if _local(e) == "text" and e.tag.startswith("{urn:oasis:names:tc:opendocument:xmlns:office")), root)
    _walk(body, doc, *_ODF, {"note", "annotation", "tracked-changes"})
    for kind in ("footnote", "endnote"):
        notes = [n for n in root.iter() if _local(n) == "note" and _attr(n, "note-class") == kind]
        if notes:
            section = doc.open(kind + "s", kind + "s")
            for n in notes:
                _walk(n, doc, *_ODF, {"note-citation"})
            doc.close(section)
    return doc


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Of a part's relations: id -> (last word of the type, target part)."""
    folder, name = posixpath.split(part)
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return {}
    found = {}
    for r in ElementTree.fromstring(z.read(at)):
        target = r.get("Target", "")
        whole = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        found[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], whole)
    return found


def _slides(data: bytes) -> Doc:
    """Slides in the order of the presentation, each with its notes."""
    z, doc = zipfile.ZipFile(io.BytesIO(data)), Doc()
    where = _relations(z, "ppt/presentation.xml")
    order = [_relation_id(s) for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(s) == "sldId"]
    for k, part in enumerate((where[i][1] for i in order), 1):
        slide = ElementTree.fromstring(z.read(part))
        _section(doc, f"slide {k}" + (" (hidden)" if slide.get("show") in ("0", "false") else ""), "slide", k, slide)
        for kind, notes in _relations(z, part).values():
            if kind == "notesSlide":
                root = ElementTree.fromstring(z.read(notes))
                for tree in [e for e in root.iter() if _local(e) == "spTree"]:
                    for shape in list(tree):
                        if any(_local(p) == "ph" and p.get("type") in ("sldNum", "sldImg", "dt", "hdr", "ftr") for p in shape.iter()):
                            tree.remove(shape)
                _section(doc, f"notes {k}", "notes", k, root)
    return doc


def _relation_id(e: ElementTree.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if k.startswith("{") and k.endswith("}id")), None)


def _section(doc: Doc, text: str, kind: str, num: int, root: ElementTree.Element) -> None:
    section = doc.open(text, kind, num)
    _walk(root, doc, {"p"}, {"tr"}, {"tc"})
    doc.close(section)


def _odp(data: bytes) -> Doc:
    root, doc = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml")), Doc()
    hidden = {_attr(s, "name") for s in root.iter() if _local(s) == "style" and any(_attr(p, "visibility") == "hidden" for p in s)}
    for k, page in enumerate((e for e in root.iter() if _local(e) == "page"), 1):
        section = doc.open(f"slide {k}" + (" (hidden)" if _attr(page, "style-name") in hidden else ""), "slide", k)
        _walk(page, doc, *_ODF, {"notes", "annotation"})
        doc.close(section)
        notes = doc.open(f"notes {k}", "notes", k)
        for n in (e for e in page if _local(e) == "notes"):
            _walk(n, doc, *_ODF)
        doc.close(notes)
    return doc


def _epub(data: bytes) -> Doc:
    """Chapters in the order of the spine, not of their file names."""
    z, doc = zipfile.ZipFile(io.BytesIO(data)), Doc()
    package = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
    root, folder = ElementTree.fromstring(z.read(package)), posixpath.dirname(package)
    items = {e.get("id"): e for e in root.iter() if _local(e) == "item"}
    doc.add(*[_plain("".join(e.itertext())) for e in root.iter() if _local(e) == "creator" and "".join(e.itertext()).strip()])
    number = 0
    for ref in (e.get("idref") for e in root.iter() if _local(e) == "itemref"):
        item = items.get(ref)
        if item is None or "nav" in (item.get("properties") or "").split():
            continue
        page = z.read(posixpath.normpath(posixpath.join(folder, unquote(item.get("href", ""))))).decode("utf-8", "replace")
        lines = _html(re.sub(r"(?is)<head\b.*?</head\s*>", "", page))
        title = re.search(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", page) or re.search(r"(?is)<title\b[^>]*>(.*?)</title>", page)
        if lines:
            number += 1
            label = " ".join(_html(title[1])) if title else ""
            section = doc.open(f"chapter {number}" + (f": {label}" if label else ""), "chapter", number, label or None)
            doc.add(*lines)
            doc.close(section)
    return doc


def _fb2(data: bytes) -> Doc:
    root, doc, number = ElementTree.fromstring(data), Doc(), 0
    blocks = ({"p", "v", "subtitle", "text-author"}, {"tr"}, {"td", "th"})
    for info in (e for e in root.iter() if _local(e) == "title-info"):
        doc.add(*[_plain("".join(e.itertext())) for e in info if _local(e) == "book-title"])
        doc.add(*[_plain(" ".join(e.itertext())) for e in info if _local(e) == "author"])
    for body in (e for e in root if _local(e) == "body"):
        if body.get("name") in ("notes", "comments"):
            section = doc.open("notes", "notes")
            _walk(body, doc, *blocks)
            doc.close(section)
            continue
        for part in body:
            if _local(part) != "section":
                _walk(part, doc, *blocks) if _local(part) not in blocks[0] else doc.add(_plain("".join(part.itertext())))
                continue
            number += 1
            label = _plain(" ".join("".join(t.itertext()) for t in part if _local(t) == "title"))
            section = doc.open(f"chapter {number}" + (f": {label}" if label else ""), "chapter", number, label or None)
            _walk(part, doc, *blocks)
            doc.close(section)
    return doc


# Code pages of RTF character sets, and groups that hold no text.
_CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
_NO_TEXT = {"colortbl", "stylesheet", "info", "pict", "object", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "listtable", "listoverridetable", "xmlnstbl", "themedata", "fldinst"}
_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "cell": " | ", "nestcell": " | ", "nestrow": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")


def _rtf(data: bytes) -> Doc:
    """A stack of group states: whether the group is text, its font, how many characters stand in for one of Unicode."""
    state = {"text": True, "into": "body", "font": None, "stand_in": 1}
    stack: list[dict] = []
    fonts: dict[int, str] = {}
    out: dict[str, list[str]] = {"body": [], "footnotes": []}
    default, default_font, held, skip, fresh = "cp1252", None, bytearray(), 0, False

    def flush() -> None:
        if held:
            font = state["font"] if state["font"] is not None else default_font
            out[state["into"]].append(bytes(held).decode(fonts.get(font, default), "replace"))
            held.clear()

    def put(text: str) -> None:
        flush()
        if state["text"]:
            out[state["into"]].append(text)

    for m in _RTF.finditer(data):
        word, number, code, sign, brace, text = m.groups()
        if brace == b"{":
            flush()
            stack.append(dict(state))
            skip, fresh = 0, True
            continue
        if brace == b"}":
            flush()
            state, skip = stack.pop() if stack else state, 0
            continue
        if word is not None:
            w, n = word.decode(), int(number) if number else None
            if w in _NO_TEXT and fresh:
                state["text"] = False
            elif w == "fonttbl":
                state["text"], state["into"] = False, "body"
                state["fonts"] = True
            elif w in ("footnote", "annotation"):
                flush()
                state["into"] = "footnotes"
                out["footnotes"].append("\n")
            elif w == "ansicpg" and n:
                default = f"cp{n}"
            elif w == "deff":
                default_font = n
            elif w == "f":
                flush()
                state["font"] = n
            elif w == "fcharset" and state.get("fonts"):
                fonts[state["font"]] = default if n == 1 else _CHARSETS.get(n, default)
            elif w == "plain":
                flush()
                state["font"] = None
            elif w == "uc":
                state["stand_in"] = n or 0
            elif w == "u" and n is not None:
                put(chr(n & 0xFFFF))
                skip = state["stand_in"]
            elif w == "bin" and n:
                pass
            elif w in _SIGNS:
                put(_SIGNS[w])
            fresh = False
            continue
        if sign == b"*":
            state["text"] = state["text"] and not fresh
        elif sign is not None and sign in b"\\{}":
            held += sign if state["text"] else b""
        elif sign is not None:
            put({b"~": "\u00a0", b"_": "-", b"\n": "\n", b"\r": "\n"}.get(sign, ""))
        elif code is not None or text is not None:
            got = bytes.fromhex(code.decode()) if code else text
            got, skip = got[skip:], max(0, skip - len(got))
            held += got if state["text"] else b""
        fresh = fresh and sign == b"*"
    flush()
    doc = Doc()
    lines = lambda which: [x for x in (re.sub(r"( \|)+$", "", _plain(y)) for y in re.split("\n", _paired("".join(out[which])))) if x]
    doc.add(*lines("body"))
    if notes := lines("footnotes"):
        section = doc.open("footnotes", "footnotes")
        doc.add(*notes)
        doc.close(section)
    return doc


def _paired(text: str) -> str:
    """Two halves of a character beyond 16 bits as one."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _mail(data: bytes, depth: int = 1) -> Doc:
    """Head and body; attachments listed and, in the outer message, read, each in a section of its own."""
    m, doc = message_from_bytes(data, policy=policy.default), Doc()
    doc.add(*[f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k]])
    body = m.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        doc.add(*(_html(text) if body.get_content_type() == "text/html" else [x.rstrip() for x in text.rstrip().splitlines()]))
    parts = []
    for a in m.iter_attachments():
        inner = a.get_content_type() == "message/rfc822"
        raw = a.get_payload(0).as_bytes() if inner else a.get_payload(decode=True) or b""
        parts.append((a.get_filename() or ("message.eml" if inner else "unnamed"), a.get_content_type(), raw))
    if parts:
        section = doc.open("attachments", "attachments")
        doc.add(*[f"{name} ({kind}, {len(raw)} bytes)" for name, kind, raw in parts])
        doc.close(section)
    for name, kind, raw in parts if depth else []:
        section = doc.open(f"attachment: {_plain(name)}", "attachment", None, name)
        if kind == "message/rfc822":
            doc.nest(_mail(raw, depth - 1))
        else:
            found, why = _read(name, raw)
            doc.nest(found) if found else doc.add(f"(not extracted: {why})")
        doc.close(section)
    return doc


_READERS = {
    "eml": _mail, "mbox": _mail, "fb2": _fb2, "rtf": _rtf, "docx": _word, "docm": _word, "dotx": _word, "odt": _odt, "ott": _odt, "epub": _epub,
    "pptx": _slides, "pptm": _slides, "ppsx": _slides, "potx": _slides, "odp": _odp, "otp": _odp,
}


def _read(path: str, data: bytes) -> tuple[Doc | None, str | None]:
    """A document, or the reason for none."""
    kind = path.rpartition(".")[2].lower()
    if len(data) > LIMIT:
        return None, f"larger than {LIMIT} bytes"
    if kind in REFUSED:
        return None, REFUSED[kind]
    doc = Doc()
    try:
        if kind in _READERS:
            return _READERS[kind](data), None
        text = data.decode("utf-8-sig", "replace")
        if kind in ("html", "htm", "xhtml"):
            doc.add(*_html(text))
        elif b"\0" in data[:8192]:
            return None, "binary file"
        elif text:
            doc.add(*text.replace("\r", "").removesuffix("\n").split("\n"))
        return doc, None
    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, LookupError, StopIteration) as e:
        return None, f"unreadable {kind}: {e}"


def lines_of(path: str, data: bytes) -> tuple[list[str] | None, str | None]:
    """Lines, or the reason for none."""
    doc, why = _read(path, data)
    return (doc.lines if doc else None), why


_OUT = "path string, lines array<string>, markers array<struct<at:int,text:string>>, sections array<struct<kind:string,num:int,label:string,start:int,end:int>>, reason string"


def read_documents(spark, *paths: str) -> DataFrame:
    """(path, lines, markers, sections, reason) of files of any of the formats; lines or a reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_read(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            part = lambda name: [getattr(d, name) if d else None for d, _ in made]
            yield pd.DataFrame({"path": b["path"], "lines": part("lines"), "markers": part("markers"), "sections": part("sections"), "reason": [why for _, why in made]})

    return files.mapInPandas(run, _OUT)
