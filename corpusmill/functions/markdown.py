"""Blocks of a Markdown text: containers (quotes, lists) opened and closed line by line, and the leaves inside them.

A line is first matched against the open containers, outermost first, each taking its
prefix; what is left may open further ones and ends in a leaf. A paragraph goes on over
lines that lack the prefixes (lazy lines). The result is a text's top blocks in order,
with the lines that they come from; a container is one prose block, its leaves' texts
joined by spaces.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*)$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
QUOTE = re.compile(r" {0,3}>[ \t]?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)(.*)$")
DEFINITION = re.compile(r""" {0,3}\[[^\]\s][^\]]*\]:[ \t]*\S+(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\)))?[ \t]*$""")
HTML_START = re.compile(r" {0,3}<(?:(script|pre|style|textarea)\b|!--|\?|![A-Za-z]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))", re.I)
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
EMPHASIS = re.compile(r"(?<!\\)(?:\*{1,3}|(?<![^\W_])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![^\W_])|~~)(?:(?=\S)|(?<=\S.))")
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
#: Containers inside containers that are looked into; what lies deeper is plain text.
DEPTH = 32


class Block(NamedTuple):
    """``kind``: heading, code, table, html or prose; ``first``, ``last``: its lines, from 0."""

    kind: str
    level: int
    text: str
    first: int
    last: int


def inline(text: str) -> str:
    """Plain text of inline Markdown: links and images become their text, emphasis and escapes go; code stays as it is."""
    if "`" not in text:
        return unmarked(text)
    out, at = [], 0
    for m in CODE_SPAN.finditer(text):
        out += [unmarked(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, unmarked(text[at:])])


def unmarked(text: str) -> str:
    for _ in range(2 if "[" in text else 0):  # an image inside a link
        text = LINK.sub(lambda m: m[1], text)
    if "<" in text:
        text = AUTOLINK.sub(lambda m: m[1], text)
    if "*" in text or "_" in text or "~~" in text:
        text = EMPHASIS.sub("", text)
    return html.unescape(ESCAPE.sub(r"\1", text) if "\\" in text else text)


def cells(row: str) -> list[str]:
    """The cells of a table's row; an escaped bar is text."""
    inner = row.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [inline(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", inner)]


def width(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def plain(line: str) -> bool:
    """Whether a line can only be text, or code by its indent: it begins with a letter, as no mark does, and has no bar."""
    return line.lstrip(" ")[:1].isalpha() and "|" not in line


def opens(line: str, in_paragraph: bool) -> bool:
    """Whether a line begins a block that ends a paragraph before it."""
    if plain(line):
        return False
    item = ITEM.match(line)
    listed = item and not (in_paragraph and (not item[4].strip() or (item[2][-1] in ".)" and item[2][:-1] != "1")))
    return bool(QUOTE.match(line) or FENCE.match(line) or HEADING.match(line) or BREAK.match(line) or listed)


def flattened(inner: list[str], first: int, depth: int) -> str:
    return " ".join(b.text for b in parse(inner, first, depth + 1))


def parse(lines: list[str], first: int = 0, depth: int = 0) -> Iterator[Block]:
    """The blocks of some lines, of which the first has the number ``first``."""
    at, para, since = 0, [], 0

    def closed() -> Iterator[Block]:
        if para:
            yield Block("prose", 0, inline(" ".join(para)), first + since, first + at - 1)
            para.clear()

    while at < len(lines):
        line = lines[at]
        begin, after = at, lines[at + 1] if at + 1 < len(lines) else ""
        if not line.strip():
            yield from closed()
            at += 1
        elif plain(line) and (para or width(line) < 4) and "|" not in after:
            since = since if para else at
            para.append(line.strip())
            at += 1
        elif fence := FENCE.match(line):
            yield from closed()
            inside, end = [], re.compile(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            at += 1
            while at < len(lines) and not end.match(lines[at]):
                inside.append(lines[at][min(width(lines[at]), len(fence[1])) :])
                at += 1
            at = min(at + 1, len(lines))
            yield Block("code", 0, "\n".join([f"```{fence[3].strip()}", *inside, "```"]), first + begin, first + at - 1)
        elif heading := HEADING.match(line):
            yield from closed()
            at += 1
            yield Block("heading", len(heading[1]), inline((heading[2] or "").strip()), first + begin, first + begin)
        elif para and (under := UNDERLINE.match(line)):
            text = inline(" ".join(para))
            para.clear()
            at += 1
            yield Block("heading", 1 if "=" in under[1] else 2, text, first + since, first + begin)
        elif BREAK.match(line):
            yield from closed()
            at += 1
        elif "|" in line and "|" in after and DELIMITERS.match(after) and len(cells(line)) == len(cells(after)):
            yield from closed()
            rows = [cells(line)]
            at += 2
            while at < len(lines) and lines[at].strip() and not opens(lines[at], False):
                rows.append(cells(lines[at]))
                at += 1
            yield Block("table", 0, "\n".join(" ".join(r) for r in rows), first + begin, first + at - 1)
        elif QUOTE.match(line) and depth < DEPTH:
            yield from closed()
            inner: list[str] = []
            while at < len(lines):
                if mark := QUOTE.match(lines[at]):
                    inner.append(lines[at][mark.end() :])
                elif lines[at].strip() and inner[-1].strip() and not opens(lines[at], True) and not opens(inner[-1], False):
                    inner.append(lines[at].lstrip())  # a lazy line
                else:
                    break
                at += 1
            yield Block("prose", 0, flattened(inner, first + begin, depth), first + begin, first + at - 1)
        elif (item := ITEM.match(line)) and not (para and not opens(line, True)) and depth < DEPTH:
            yield from closed()
            texts, kind = [], item[2][-1]
            while at < len(lines) and (item := ITEM.match(lines[at])) and item[2][-1] == kind and not BREAK.match(lines[at]):
                gap = len(item[3]) if 1 <= len(item[3]) <= 4 and item[4] else 1
                room = len(item[1]) + len(item[2]) + gap
                inner, start = [(item[3][gap:] + item[4]) if item[4] else ""], at
                at += 1
                while at < len(lines):
                    if not lines[at].strip():
                        ahead = next((x for x in lines[at:] if x.strip()), "")
                        if width(ahead) < room:
                            break
                        inner.append("")
                    elif width(lines[at]) >= room:
                        inner.append(lines[at][room:])
                    elif inner[-1].strip() and not opens(lines[at], True) and not ((more := ITEM.match(lines[at])) and more[2][-1] == kind):
                        inner.append(lines[at].lstrip())  # a lazy line
                    else:
                        break
                    at += 1
                texts.append(flattened(inner, first + start, depth))
                ahead = next((i for i in range(at, len(lines)) if lines[i].strip()), len(lines))
                if ahead < len(lines) and ITEM.match(lines[ahead]):
                    at = ahead  # blank lines between items
            yield Block("prose", 0, " ".join(t for t in texts if t), first + begin, first + at - 1)
        elif width(line) >= 4 and not para:
            inside = []
            while at < len(lines) and (width(lines[at]) >= 4 or not lines[at].strip()):
                inside.append(lines[at][4:])
                at += 1
            while not inside[-1].strip():
                inside.pop()
                at -= 1
            yield Block("code", 0, "\n".join(["```", *inside, "```"]), first + begin, first + at - 1)
        elif not para and (tag := HTML_START.match(line)):
            end = rf"</{tag[1]}>" if tag[1] else "-->" if "<!--" in tag[0] else r"\?>" if "<?" in tag[0] else None
            while at < len(lines) and (lines[at].strip() if end is None else not re.search(end, lines[at], re.I)):
                at += 1
            at = min(at + (end is not None), len(lines))
            yield Block("html", 0, " ".join(x.strip() for x in lines[begin:at]), first + begin, first + at - 1)
        elif not para and DEFINITION.match(line):
            at += 1
        else:
            since = since if para else at
            para.append(line.strip())
            at += 1
    yield from closed()


def blocks(text: str) -> Iterator[Block]:
    """The top blocks of a text. Tabs count as up to four columns."""
    yield from parse([x.expandtabs(4) for x in re.split(r"\r\n|\r|\n", text)])
