"""Formats that need a parser: each function takes bytes and gives (page, text) pairs.

They run inside Arrow batches on the executors; errors carry the engine's codes.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.sax
import zipfile
from xml.etree import ElementTree

from ..schema import EngineError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def utf8(data: bytes, what: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise EngineError(404, f"{what} is not UTF-8") from None


def zip_entry(data: bytes, name: str) -> bytes:
    """An entry of a zip archive, stored or deflated."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            info = z.getinfo(name)
            if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise EngineError(405, f"{name} is compressed or encrypted in an unsupported way")
            return z.read(info)
    except KeyError:
        raise EngineError(406, f"the archive has no {name}") from None
    except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, OSError, ValueError):
        raise EngineError(405, "the archive is malformed") from None


def docx(data: bytes) -> list[tuple[int, str]]:
    """Text of a word-processing document: runs, breaks, tabs, paragraphs and table cells."""
    try:
        root = ElementTree.fromstring(zip_entry(data, "word/document.xml"))
    except ElementTree.ParseError:
        raise EngineError(406, "word/document.xml is malformed") from None
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        tag = node.tag
        start = len(out)
        if tag == _W + "t":
            out.append(node.text or "")
        elif tag in (_W + "br", _W + "cr"):
            out.append("\n")
        elif tag == _W + "tab":
            out.append("\t")
        for child in node:
            walk(child)
        if tag == _W + "p":
            out.append("\n\n" if "".join(out[start:]).strip() else "\n")
        elif tag == _W + "tc":
            out.append("\t")

    walk(root)
    return [(0, "".join(out).strip())]


def _table(text: str, delimiter: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]


def delimited(data: bytes, delimiter: str) -> list[tuple[int, str]]:
    """A page for each data row, from 1: ``header: value`` pairs; extra fields are ``colN``."""
    rows = _table(utf8(data, "the table"), delimiter)
    if not rows:
        return []
    header = [h.strip() for h in rows[0]]
    return [(i, ", ".join(f"{header[j] if j < len(header) else f'col{j + 1}'}: {v.strip()}" for j, v in enumerate(row))) for i, row in enumerate(rows[1:], 1)]


def _scalar(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def flat_json(data: bytes) -> list[tuple[int, str]]:
    """``path: value`` lines, depth first, keys sorted; any JSON value may be the root."""
    try:
        root = json.loads(utf8(data, "the JSON"))
    except ValueError:
        raise EngineError(405, "the JSON is malformed") from None
    out: list[str] = []
    stack: list[tuple[str, object]] = [("", root)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}" if path else k, value[k]) for k in sorted(value, reverse=True)]
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
        else:
            out.append(f"{path}: {_scalar(value)}" if path else _scalar(value))
    return [(0, "\n".join(out))]


class _Elements(xml.sax.ContentHandler):
    def __init__(self) -> None:
        self.path: list[str] = []
        self.out: list[str] = []
        self.text: list[str] = []

    def startElement(self, name, attrs) -> None:  # noqa: N802
        self.path.append(name)
        self.text = []
        at = ".".join(self.path)
        self.out += [f"{at}.@{k}: {attrs[k]}" for k in sorted(attrs.keys())]

    def characters(self, content) -> None:
        self.text.append(content)

    def endElement(self, name) -> None:  # noqa: N802
        text = "".join(self.text).strip()
        if text:
            self.out.append(f"{'.'.join(self.path)}: {text}")
        self.text = []
        self.path.pop()


def flat_xml(data: bytes) -> list[tuple[int, str]]:
    """``path: text`` and ``path.@attribute: value`` lines in document order."""
    handler = _Elements()
    try:
        parser = xml.sax.make_parser()
        parser.setFeature(xml.sax.handler.feature_external_ges, False)
        parser.setContentHandler(handler)
        parser.parse(io.BytesIO(data))
    except (xml.sax.SAXException, ValueError):
        raise EngineError(405, "the XML is malformed") from None
    return [(0, "\n".join(handler.out))]


# RTF groups that hold no text of the document.
_RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable", "listoverridetable"}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def rtf(data: bytes) -> list[tuple[int, str]]:
    """Plain text of rich text."""
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise EngineError(404, "not rich text")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip, fallback = False, 0, 1
    for word, number, code, symbol, brace, plain in _RTF.findall(text):
        if brace == "{":
            stack.append((silent, fallback))
        elif brace == "}":
            silent, fallback = stack.pop() if stack else (False, 1)
        elif symbol == "*":
            silent = True
        elif word in _RTF_SILENT:
            silent = True
        elif silent:
            continue
        elif word in ("par", "line", "sect", "page"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u":
            out.append(chr(int(number) & 0xFFFF))
            skip = fallback
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif symbol == "~":
            out.append(" ")
        elif plain:
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
    return [(0, "".join(out).strip())]


def numeric_entities(text: str) -> str:
    """Numeric character references become characters; those of no character vanish."""

    def one(m: re.Match) -> str:
        n = int(m[2], 16 if m[1] else 10) if len(m[2]) < 9 else -1
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else ""

    return re.sub(r"&#([xX]?)([0-9a-fA-F]+);", one, text)


def named_entities(text: str) -> str:
    return html.unescape(text)
