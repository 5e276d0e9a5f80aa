"""Strict parsers of single documents and records, for the workers."""

from __future__ import annotations

import codecs
import json
import re
import xml.parsers.expat as expat
from collections.abc import Iterable, Iterator

from ..errors import IntegrityError, ResourceError

MOST_XML_DEPTH = MOST_JSON_DEPTH = 512
#: Of an XML document, what is parsed before its complete rows are given on.
XML_STEP = 1 << 16


class BadRow(Exception):
    """One record is malformed."""


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):  # of equal keys the first that is no empty container counts
        out = {}
        for k, v in pairs:
            if k not in out or (isinstance(out[k], (list, dict)) and not out[k]):
                out[k] = v
    return out


def _constant(_):
    raise ValueError("not a JSON number")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+"|([\[{])|[\]}]', re.S)


def _check_depth(text: str) -> None:
    """Refuse documents that are nested too deeply; few have brackets enough to be looked at."""
    if text.count("{") + text.count("[") <= MOST_JSON_DEPTH:
        return
    depth = 0
    for m in _BRACKETS.finditer(text):
        if m[0][0] != '"':
            depth += 1 if m[1] else -1
            if depth > MOST_JSON_DEPTH:
                raise ResourceError("a JSON document is nested too deeply")


def json_value(text: str):
    _check_depth(text)
    try:
        return _DECODER.decode(text)
    except RecursionError:
        raise ResourceError("a JSON document is nested too deeply") from None
    except ValueError:
        raise BadRow("malformed JSON") from None


def json_row(text: str, scalar_key: str) -> dict:
    v = json_value(text)
    return v if isinstance(v, dict) else {scalar_key: v}


def json_document(text: str, scalar_key: str) -> Iterator[dict]:
    """A whole document: one row, or the elements of an array."""
    v = json_value(text)
    for x in v if isinstance(v, list) else [v]:
        yield x if isinstance(x, dict) else {scalar_key: x}


def json_array(text: str) -> Iterator[dict]:
    try:
        v = json_value(text)
    except BadRow as e:
        raise IntegrityError(str(e)) from None
    if not isinstance(v, list):
        raise IntegrityError("the document is no JSON array")
    for x in v:
        if not isinstance(x, dict):
            raise IntegrityError("an element of the array is no object")
        yield x


class Csv:
    """The strict CSV dialect: doubled quotes, an optional escape in quoted cells, unquoted cells trimmed of blanks."""

    def __init__(self, delimiter: str, escape: str | None):
        self.delimiter, self.escape = delimiter, escape

    def records(self, text: str) -> Iterator[list[str]]:
        """The cells of each record; blank records are skipped."""
        n, i, d = len(text), 0, self.delimiter
        cells: list[str] = []
        if text.startswith("﻿"):
            i = 1
        while i < n:
            j = i
            while j < n and text[j] in " \t" and text[j] != d:
                j += 1
            if j < n and text[j] == '"':
                cell, i = self._quoted(text, j + 1)
                while i < n and text[i] in " \t" and text[i] != d:
                    i += 1
                if i < n and text[i] not in d + "\r\n":
                    raise IntegrityError("CSV: text after a closing quote")
            else:
                j = i
                while j < n and text[j] not in d + '\r\n"':
                    j += 1
                if j < n and text[j] == '"':
                    raise IntegrityError("CSV: a quote inside an unquoted cell")
                cell, i = text[i:j].strip(" \t"), j
            cells.append(cell)
            if i < n and text[i] == d:
                i += 1
                if i < n and text[i] not in "\r\n":
                    continue
                cells.append("")
            if i < n and text[i] == "\r":
                i += 1
            if i < n and text[i] == "\n":
                i += 1
            if cells != [""]:
                yield cells
            cells = []
        if cells:
            yield cells

    def _quoted(self, text: str, i: int) -> tuple[str, int]:
        out = []
        while True:
            j = text.find('"', i)
            if j < 0:
                raise IntegrityError("CSV: a quoted cell is not closed")
            if self.escape and 0 <= (k := text.find(self.escape, i)) < j:
                if k + 1 >= len(text):
                    raise IntegrityError("CSV: a quoted cell is not closed")
                out += [text[i:k], text[k + 1]]
                i = k + 2
                continue
            out.append(text[i:j])
            if text[j + 1 : j + 2] != '"':
                return "".join(out), j + 1
            out.append('"')
            i = j + 2


def csv_keys(header: list[str]) -> list[str]:
    """The column names of a header; a blank cell is named by its index."""
    keys = [h or str(i) for i, h in enumerate(header)]
    if len({h for h in header if h}) < sum(map(bool, header)):
        raise IntegrityError("CSV: a header names a column twice")
    return keys


class _Element:
    __slots__ = ("attrs", "children", "name", "text")

    def __init__(self, name, attrs):
        self.name, self.attrs, self.children, self.text = name, attrs, [], []

    def value(self):
        text = "".join(self.text).strip(" \t\r\n")
        if not self.attrs and not self.children:
            return text or None
        out: dict = {"@" + k: v for k, v in self.attrs.items()}
        seen: dict[str, int] = {}
        for c in self.children:
            v = c.value()
            seen[c.name] = seen.get(c.name, 0) + 1
            if seen[c.name] == 1:
                out[c.name] = v
            elif seen[c.name] == 2:
                out[c.name] = [out[c.name], v]
            else:
                out[c.name].append(v)
        if text:
            out["#text"] = text
        return out


def xml_rows(data: str | bytes | Iterable[str], row_tag: str | None) -> Iterator[dict]:
    """The document as one row, or a row for each direct child of the root named ``row_tag``; no DTD, no own entities.

    ``data`` may come in pieces. With a row tag only the rows of a step are held, and nothing of what is outside of rows.
    """
    stack: list[_Element | None] = []  # None: not part of a row
    rows: list[_Element] = []
    root = 0 if row_tag is None else 1  # elements around a row
    p = expat.ParserCreate()
    p.buffer_text = True

    def refuse(*_):
        raise IntegrityError("XML: document type declarations and entities are refused")

    def start(name, attrs):
        if len(stack) >= MOST_XML_DEPTH:
            raise ResourceError("an XML document is nested too deeply")
        inside = bool(stack) and stack[-1] is not None
        e = _Element(name, attrs) if inside or len(stack) == root and row_tag in (None, name) else None
        if inside:
            stack[-1].children.append(e)
        stack.append(e)

    def end(_):
        e = stack.pop()
        if e is not None and len(stack) == root:
            rows.append(e)

    def text(t):
        if stack and stack[-1] is not None:
            stack[-1].text.append(t)

    p.StartDoctypeDeclHandler = p.EntityDeclHandler = refuse
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = text

    def parse(step, last):
        try:
            p.Parse(step, last)
        except expat.ExpatError as e:
            raise IntegrityError(f"XML: {expat.errors.messages[e.code]}") from None
        for e in rows:
            v = e.value()
            yield v if isinstance(v, dict) else {"#text": v}
        rows.clear()

    for piece in (data,) if isinstance(data, (str, bytes)) else data:
        for i in range(0, len(piece), XML_STEP):
            yield from parse(piece[i : i + XML_STEP], False)
    yield from parse(b"", True)


def decoded(data: bytes, encoding: str) -> str:
    try:
        return codecs.decode(bytes(data), encoding.lower())
    except UnicodeDecodeError:
        raise IntegrityError(f"the input is not valid {encoding}") from None
