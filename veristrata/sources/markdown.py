"""Markdown as a stack of container blocks: quotes, lists and fences nest as they stand in the text.

Each line first continues the open containers (a quote by its mark, an item by its indent), may then open further ones,
and what is left of it goes to the leaf block at their end. A paragraph takes further lines also where their containers'
marks are left out. The blocks that count are then read from the tree in its order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_BREAK = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_MARK = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


class NoText(ValueError):
    """A list item that holds no text at all."""


@dataclass
class Node:
    kind: str
    first: int
    last: int
    level: int = 0  # of a heading; the indent of an item's content; the length of a fence
    mark: str = ""
    lines: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node) -> Node:
        self.children.append(child)
        return child


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _cells(row: str) -> list[str]:
    inner = re.sub(r"^\||(?<!\\)\|$", "", row.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


class _Reader:
    """Reads lines one by one; ``open`` is the stack of containers, ``leaf`` the block at its end, if one is open."""

    def __init__(self) -> None:
        self.root = Node("document", 1, 1)
        self.open: list[Node] = [self.root]
        self.leaf: Node | None = None

    def close(self, depth: int | None = None) -> None:
        self.leaf = None
        if depth is not None:
            del self.open[depth:]

    def start(self, kind: str, n: int, **more) -> Node:
        self.leaf = self.open[-1].add(Node(kind, n, n, **more))
        return self.leaf

    def line(self, n: int, line: str) -> None:
        rest, depth = line.expandtabs(4), 1
        for node in self.open[1:]:
            if node.kind == "quote":
                if _indent(rest) > 3 or not rest.lstrip(" ").startswith(">"):
                    break
                rest = rest.lstrip(" ")[1:]
                rest = rest[1:] if rest.startswith(" ") else rest
            elif node.kind == "item":
                if rest.strip() and _indent(rest) < node.level:
                    break
                if not rest.strip() and not node.children and node.last < n - 1:
                    break  # an item begins with one blank line at most
                rest = rest[node.level :] if rest.strip() else ""
            depth += 1
        matched = depth == len(self.open)
        if matched and self.leaf is not None and self.leaf.kind == "fence":
            return self._fenced(n, rest)
        lazy = self.leaf if not matched and self.leaf is not None and self.leaf.kind == "paragraph" else None
        if not rest.strip():
            if not matched:
                self.close(depth)
            elif self.leaf is not None and self.leaf.kind != "indented":
                self.close()
            return
        if not matched:
            held = self.leaf
            fresh = self._opens(rest, lazy is not None)
            if lazy is not None and not fresh:
                self._extend(lazy, n, rest)
                return
            self.leaf = held
            self.close(depth)
        rest = self._containers(n, rest)
        if rest.strip():
            self._leaf(n, rest)

    def _opens(self, rest: str, paragraph: bool) -> bool:
        """Whether the rest of a line begins a block of its own."""
        own = rest.lstrip(" ")
        if _indent(rest) > 3:
            return not paragraph
        return own.startswith(">") or bool(_BREAK.match(own) or _FENCE.match(own) or _HEADING.match(own)) or self._item(own, paragraph) is not None

    def _item(self, own: str, paragraph: bool) -> re.Match | None:
        m = _MARK.match(own)
        if not m or _BREAK.match(own):
            return None
        empty = not own[m.end() :].strip()
        if paragraph and (empty or (m[1][0].isdigit() and m[1][:-1] != "1")):
            return None  # these do not break into a paragraph
        return m

    def _containers(self, n: int, rest: str) -> str:
        while _indent(rest) <= 3:
            own, before = rest.lstrip(" "), _indent(rest)
            paragraph = self.leaf is not None and self.leaf.kind == "paragraph"
            if own.startswith(">"):
                self.close()
                self.open.append(self.open[-1].add(Node("quote", n, n)))
                rest = own[2:] if own.startswith("> ") else own[1:]
                continue
            m = self._item(own, paragraph)
            if not m:
                break
            if paragraph and _UNDERLINE.match(own):
                break
            self.close()
            after = own[m.end() :]
            gap = _indent(after) if after.strip() else 1
            gap = gap if 1 <= gap <= 4 else 1
            self.open.append(self.open[-1].add(Node("item", n, n, level=before + m.end() + gap)))
            rest = after[gap:]
        return rest

    def _extend(self, leaf: Node, n: int, text: str) -> None:
        leaf.lines.append(text.strip())
        leaf.last = n
        for node in self.open:
            node.last = n

    def _fenced(self, n: int, rest: str) -> None:
        leaf = self.leaf
        m = _FENCE.match(rest.strip()) if _indent(rest) <= 3 else None
        ends = m and (m[1] or m[3])[0] == leaf.mark and len(m[1] or m[3]) >= leaf.level and not (m[2] or m[4] or "").strip()
        self._extend(leaf, n, rest)
        if ends:
            self.close()

    def _leaf(self, n: int, rest: str) -> None:
        own, leaf = rest.strip(), self.leaf
        for node in self.open:
            node.last = n
        if leaf is not None and leaf.kind == "paragraph":
            if _indent(rest) <= 3:
                under = _UNDERLINE.match(own)
                if under:
                    leaf.kind, leaf.level, leaf.last = "heading", 1 if under[1][0] == "=" else 2, n
                    return self.close()
                if len(leaf.lines) == 1 and "|" in leaf.lines[0] + own and _DELIMITERS.match(own) and len(_cells(leaf.lines[0])) == len(_cells(own)):
                    leaf.kind, leaf.last = "table", n
                    return
                if not self._opens(rest, True):
                    return self._extend(leaf, n, rest)
            else:
                return self._extend(leaf, n, rest)
        elif leaf is not None and leaf.kind == "table" and not self._opens(rest, False):
            return self._extend(leaf, n, rest)
        elif leaf is not None and leaf.kind == "indented" and _indent(rest) > 3:
            return self._extend(leaf, n, rest)
        self.close()
        heading, fence = (_HEADING.match(own), _FENCE.match(own)) if _indent(rest) <= 3 else (None, None)
        if _indent(rest) > 3:
            self.start("indented", n)
        elif _BREAK.match(own):
            self.start("break", n)
            self.close()
        elif heading:
            self.start("heading", n, level=len(heading[1])).lines.append(heading[2] or "")
            self.close()
        elif fence:
            self.start("fence", n, level=len(fence[1] or fence[3]), mark=(fence[1] or fence[3])[0])
        else:
            self.start("paragraph", n).lines.append(own)


def _flat(lines: list[str]) -> str:
    return " ".join(" ".join(lines).split())


def _first_text(node: Node) -> str | None:
    """The first inline text below a node, in the order of the text."""
    for child in node.children:
        if child.kind in ("paragraph", "heading"):
            return _flat(child.lines)
        if child.kind == "table":
            return _flat(_cells(child.lines[0])[:1])
        found = _first_text(child)
        if found is not None:
            return found
    return None


def _paragraph_kind(path: list[str], text: str) -> str:
    section = path[-1].casefold() if path else ""
    if section in ("abstract", "references"):
        return {"abstract": "abstract", "references": "reference"}[section]
    if re.match(r"table\s+\d", text, re.I):
        return "table_caption"
    return "figure_caption" if re.match(r"(?:figure|fig\.)\s+\d", text, re.I) else "paragraph"


def tree(text: str) -> Node:
    reader = _Reader()
    for n, line in enumerate(text.split("\n"), 1):
        reader.line(n, line)
    return reader.root


def blocks(text: str) -> list[tuple]:
    """``(index, kind, heading path, text, first line, last line)`` of the title, paragraphs, list items and tables of a
    document. The first heading of level one is the title, headings of other levels form the path, and code is no text.
    Items, also nested ones, show their first text; further paragraphs of an item do not count. An item without any text
    is an error."""
    out: list[tuple] = []
    levels: dict[int, str] = {}
    titled = False

    def emit(kind: str, path: list[str], value: str, node: Node) -> None:
        if value.strip():
            out.append((len(out), kind, path, value, node.first, node.last))

    def walk(node: Node, in_item: bool) -> None:
        nonlocal titled, levels
        for child in node.children:
            path = [levels[k] for k in sorted(levels) if k > 1]
            if child.kind == "heading":
                value = _flat(child.lines)
                levels = {k: v for k, v in levels.items() if k < child.level}
                if child.level == 1 and not titled:
                    titled = True
                    emit("title", [], value, child)
                else:
                    levels[child.level] = value
            elif child.kind == "item":
                value = _first_text(child)
                if value is None:
                    raise NoText("a list item holds no text")
                emit("list_item", path, value, child)
                walk(child, True)
            elif child.kind == "table":
                emit("table", path, " | ".join(c for row in child.lines for c in map(lambda x: " ".join(x.split()), _cells(row)) if c), child)
            elif child.kind == "paragraph" and not in_item:
                value = _flat(child.lines)
                emit(_paragraph_kind(path, value), path, value, child)
            else:
                walk(child, in_item)

    walk(tree(text), False)
    return out
