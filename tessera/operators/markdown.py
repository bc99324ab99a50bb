"""Markdown files to sections: blocks by their lines, inside the containers that hold them.

Each line first goes through the open containers (quotes and list items), which take their marks off it; a line that does
not carry them on closes them, unless it goes on with a paragraph inside (a *lazy* line). What is left opens new containers
and then is part of a block: a heading, code, HTML, a thematic break or a paragraph.

A heading ends the section before it and opens the next, inside a container too; its path is the stack of headings above
it, cut to its level less one and joined by `` > ``. Its text belongs to the path and not to the section. Paragraphs and code
give their lines, in quotes too; a list item gives ``- `` and its first paragraph. HTML blocks and thematic breaks give nothing. Blank lines
stay inside code only. A section's ordinal is the byte offset of its heading's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
QUOTE = re.compile(r" {0,3}>[ \t]?(.*)$")
BREAK = re.compile(r" {0,3}([-_*])[ \t]*(?:\1[ \t]*){2,}$")
HTML = re.compile(r" {0,3}</?[A-Za-z!?]")
CODE = re.compile(r"(?: {4}|\t| {1,3}\t)(.*)$")


@dataclass
class Section:
    heading_path: str
    text: str
    ordinal: int


@dataclass
class Container:
    """A quote (indent 0), or an item, whose lines are indented by ``indent``."""

    indent: int = 0
    items: list = field(default_factory=list)  # words of the item's first paragraph, until it is given
    mark: str = ""
    empty: bool = False  # an item that has had no text so far


class _Reader:
    def __init__(self):
        self.title, self.stack, self.buffer, self.ordinal = "", [], [], 0
        self.sections: list[Section] = []
        self.open: list[Container] = []
        self.paragraph: list[tuple[str, int]] = []  # lines of the open paragraph, with their offsets
        self.fence: tuple[str, int, int] | None = None  # sign, length, containers about it
        self.code: list[str] | None = None
        self.html = False

    # sections

    def flush(self) -> None:
        body = "".join(x + "\n" for x in self.buffer).strip()
        if body:
            self.sections.append(Section(" > ".join(self.stack), body, self.ordinal))
        self.buffer = []

    def heading(self, level: int, words: str, at: int) -> None:
        self.end_block()
        self.flush()
        if level == 1 and not self.title:
            self.title = words
        del self.stack[level - 1 :]
        self.stack.append(words)
        if words:
            self.ordinal = at

    # blocks

    def end_paragraph(self) -> None:
        if not self.paragraph:
            return
        words = [t for t, _ in self.paragraph]
        self.paragraph = []
        if self.open and self.open[-1].mark and self.open[-1].empty:
            self.open[-1].empty = False
            self.buffer.append("- " + " ".join(w for w in words if w))
        else:
            self.buffer.extend(words)

    def end_code(self) -> None:
        if self.code is not None:
            while self.code and not self.code[-1].strip():
                self.code.pop()
            self.buffer.extend(self.code)
            self.code = None

    def end_block(self) -> None:
        self.end_paragraph()
        self.end_code()
        self.fence, self.html = None, False

    def close(self, n: int) -> None:
        """Close all containers but the first n."""
        if len(self.open) > n:
            self.end_block()
            while len(self.open) > n:
                gone = self.open.pop()
                if gone.mark and gone.empty:
                    self.buffer.append("- ")

    # lines

    def carried(self, line: str, at: int) -> tuple[int, str, int]:
        """How many open containers the line carries on, and what is left of it and where that begins."""
        for n, c in enumerate(self.open):
            if not c.mark:
                m = QUOTE.match(line)
                if not m:
                    return n, line, at
                at += len(line[: m.start(1)].encode())
                line = m[1]
            elif not line.strip():
                if c.empty and not self.paragraph and n == len(self.open) - 1:
                    return n, line, at  # an item cannot begin with two blank lines
            else:
                indent = len(line) - len(line.lstrip(" \t"))
                width = len(line[:indent].expandtabs(4))
                if width < c.indent:
                    return n, line, at
                flat = line[:indent].expandtabs(4)[c.indent :] + line[indent:]
                at += len(line.encode()) - len(flat.encode())
                line = flat
        return len(self.open), line, at

    def line(self, raw: str, at: int) -> None:
        raw = raw.rstrip("\r")
        n, line, at = self.carried(raw, at)
        if n == len(self.open) and self.fence:
            mark, size, _ = self.fence
            if re.match(rf" {{0,3}}{re.escape(mark)}{{{size},}}[ \t]*$", line):
                self.fence = None
            else:
                self.buffer.append(line)
            return
        if n == len(self.open) and self.html:
            self.html = bool(line.strip())
            return
        if n == len(self.open) and self.code is not None:
            if not line.strip() or CODE.match(line):
                more = CODE.match(line)
                self.code.append(more[1] if more else "")
                return
            self.end_code()
        if n < len(self.open) and self.paragraph and line.strip() and not self.starts(line, lazy=True):
            self.paragraph.append((line.strip(), at))  # a lazy line
            return
        self.close(n)
        self.opened(line, at)

    def starts(self, line: str, lazy: bool = False) -> bool:
        """Whether a line begins a block of its own where a paragraph is open."""
        if HEADING.match(line) or FENCE.match(line) or QUOTE.match(line) or BREAK.match(line):
            return True
        item = ITEM.match(line)
        if item is None:
            return False
        # an empty item, or a number other than 1, does not break into a paragraph, but where items go on
        inside = lazy and any(c.mark for c in self.open) or bool(self.open and self.open[-1].mark)
        return bool(inside or ((item[4] or "").strip() and (not item[2][0].isdigit() or item[2][:-1] == "1")))

    def opened(self, line: str, at: int) -> None:
        """Containers that the rest of a line opens, then its block."""
        while True:
            if CODE.match(line) and not self.paragraph and line.strip():
                break
            if quote := QUOTE.match(line):
                self.end_block()
                self.filled()
                self.open.append(Container())
                at += len(line[: quote.start(1)].encode())
                line = quote[1]
            elif (item := ITEM.match(line)) and not BREAK.match(line) and (not self.paragraph or self.starts(line)):
                self.end_block()
                self.filled()
                pad = len((item[3] or " ").expandtabs(4))
                words = item[4] or ""
                code = pad > 4 or not words.strip()
                indent = len(item[1]) + len(item[2]) + (1 if code else pad)
                self.open.append(Container(indent, mark=item[2][-1], empty=True))
                rest = (" " * (pad - 1) + words) if code and words.strip() else words
                at += len(line.encode()) - len(rest.encode())
                line = rest
                if not words.strip():
                    return
            else:
                break
        self.block(line, at)

    def block(self, line: str, at: int) -> None:
        if not line.strip():
            self.end_paragraph()
        elif self.paragraph and (under := UNDERLINE.match(line)):
            above, self.paragraph = self.paragraph, []
            if self.open and self.open[-1].mark:
                self.open[-1].empty = False
            self.heading(1 if under[1][0] == "=" else 2, " ".join(t for t, _ in above), above[0][1])
        elif not self.paragraph and (code := CODE.match(line)):
            self.filled()
            self.code = [code[1]]
        elif fence := FENCE.match(line):
            self.end_block()
            self.filled()
            self.fence = (fence[1][0], len(fence[1]), len(self.open))
        elif heading := HEADING.match(line):
            words = (heading[2] or "").strip()
            words = "" if set(words) == {"#"} else words
            before = line[: heading.start(2)] if heading[2] else ""
            self.end_block()
            self.filled()
            self.heading(len(heading[1]), words, at + len(before.encode()))
        elif BREAK.match(line):
            self.end_block()
        elif not self.paragraph and HTML.match(line):
            self.filled()
            self.html = True
        else:
            self.paragraph.append((line.strip(), at + len(line.encode()) - len(line.lstrip().encode())))

    def filled(self) -> None:
        """The innermost item has something that is no paragraph."""
        if self.open and self.open[-1].mark:
            self.open[-1].empty = False


def parse(text: str) -> tuple[str, list[Section]]:
    """Title (the first heading of level 1, or empty) and sections."""
    r, at = _Reader(), 0
    for line in text.split("\n"):
        r.line(line, at)
        at += len(line.encode("utf-8", "surrogatepass")) + 1
    r.close(0)
    r.end_block()
    r.flush()
    return r.title, r.sections
