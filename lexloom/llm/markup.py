"""Markup residue: which markup a text carries, and the text without it.

A text is parsed to a tree: the document, its blocks (iframes, sections, escaped documents), the elements in them, and as leaves the
signs that may be markup of HTML, Markdown, wiki or LaTeX, or may be plain text (an asterisk, a price, a path, ``x < y``). Every
node has a hidden label: the language it is written in, or ``content``. Potentials connect a node's label with its parent's and
with the kind of sign it is; sum-product messages go up to the document and down again, and give each node's marginal. A sign two
languages share is thereby read in the language of what it stands in. Potentials are estimated from labelled pages: a bounded
sample (``SAMPLE`` texts) whose unambiguous signs label themselves and, where a block has one language only, its other signs.

A text carries a language if one of its nodes has more than half of its marginal there. ``clean`` draws the tree as text, and the
same marginals decide it node by node: a sign or tag whose label is a language is drawn, one whose label is content stays as it is.
Headings come out as ``#`` lines, list items as ``-`` lines, code in fences, tables as ``|`` rows, formulas as they are; links,
emphasis, comments, styles and scripts leave their text or nothing. Nothing is changed inside code and formulas.

Elements left open end where HTML says they do (an item at the next item, a paragraph at the next block), and all passes over a tree
are loops, so its depth has no bound. Null texts carry nothing and stay null; texts without markup stay as they are, empty ones
included; redirect records (``@@@LINK=``) are judged and drawn after their prefix.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from itertools import groupby
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("content", "html", "markdown", "wiki", "latex")
CONTENT, HTML, MARKDOWN, WIKI, LATEX = range(5)
SAMPLE = 2000

_comment = r"<!--.*?(?:-->|$)"
_tag = re.compile(_comment + r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[^<>\"'=\s/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?|\s*/|\s)*)\s*>|<!DOCTYPE[^>]*>", re.S)
_half = re.compile(r"<(/?)(a|b|i|p|br|div|span|li|ul|ol|td|tr|th|table|font|img|h[1-6]|em|strong|sup|sub|script|style|section|iframe)\b[^<>\n]{0,80}$|(?:^|\s)(?:class|href|style|src)=[\"'][^\"'<>]*[\"']\s*/?>", re.I)
_entity = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_srcdoc = re.compile(r"\bsrcdoc\s*=\s*(\"[^\"]*\"|'[^']*')", re.S)
# Elements by how they are rendered.
VOID = set("br img hr link meta input area base col embed source track wbr".split())
BLOCKS = set("p div table tr ul ol dl section article header footer pre blockquote iframe body html head form center".split())

#: Signs: name, the language it belongs to (None where two share it or it is plain text), pattern.
SIGNS: tuple[tuple[str, int | None, re.Pattern], ...] = (
    ("fence", MARKDOWN, re.compile(r"^[ \t]*(```|~~~)[^\n]*$", re.M)),
    ("atx", None, re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(?=\S)", re.M)),
    ("atx deep", MARKDOWN, re.compile(r"^[ \t]{0,3}(#{2,6})[ \t]+(?=\S)", re.M)),
    ("setext", MARKDOWN, re.compile(r"^(?=[^\n]*\w)[^\n|]+\n[ \t]*(={3,}|-{3,})[ \t]*$", re.M)),
    ("dash item", MARKDOWN, re.compile(r"^[ \t]*[-+][ \t]+(?=\S)", re.M)),
    ("number item", MARKDOWN, re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", re.M)),
    ("star item", None, re.compile(r"^[ \t]*\*[ \t]+(?=\S)", re.M)),
    ("stars item", WIKI, re.compile(r"^\*{2,}[ \t]+(?=\S)", re.M)),
    ("quote", MARKDOWN, re.compile(r"^[ \t]{0,3}>[ \t]+(?=\S)", re.M)),
    ("rule row", MARKDOWN, re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M)),
    ("bold", MARKDOWN, re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]+?)(?<=\S)\*\*(?![\w*])")),
    ("under bold", MARKDOWN, re.compile(r"(?<!\w)__(?=[^\s_])([^_\n]+?)(?<=\S)__(?!\w)")),
    ("italic", MARKDOWN, re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])")),
    ("under italic", MARKDOWN, re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)")),
    ("code", MARKDOWN, re.compile(r"(?<!`)`([^`\n]+)`(?!`)")),
    ("link", MARKDOWN, re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)(?:[ \t]+\"[^\"]*\")?\)")),
    ("strike", MARKDOWN, re.compile(r"~~(?=\S)([^~\n]+)~~")),
    ("wiki heading", WIKI, re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)),
    ("wiki bold", WIKI, re.compile(r"'''(?=\S)(.+?)(?<=\S)'''")),
    ("wiki italic", WIKI, re.compile(r"(?<!')''(?=[^\s'])(.+?)(?<=[^\s'])''(?!')")),
    ("wiki link", WIKI, re.compile(r"\[\[([^\[\]\n|]*)(?:\|([^\[\]\n]*))?\]\]")),
    ("template", WIKI, re.compile(r"\{\{([^{}\n]*)\}\}")),
    ("wiki table", WIKI, re.compile(r"^[ \t]*(\{\|[^\n]*|\|\}|\|-+[^\n|]*)[ \t]*$", re.M)),
    ("wiki cells", WIKI, re.compile(r"^[ \t]*[|!](?![-}|])[^|\n]*(?:\|\||!!)[^\n]*$", re.M)),
    ("command", LATEX, re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")),
    ("environment", LATEX, re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}")),
    ("item", LATEX, re.compile(r"^[ \t]*\\item\b", re.M)),
    ("display", LATEX, re.compile(r"\\\[.+?\\\]|\$\$[^$]+\$\$", re.S)),
    ("inline", LATEX, re.compile(r"\\\(.+?\\\)", re.S)),
    ("dollar", LATEX, re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_{=])[^$\n]*?(?<=[^\s\\$])\$(?![\w$])")),
    ("price", None, re.compile(r"\$\d")),
    ("lone star", None, re.compile(r"(?<!\S)\*(?=\w)|(?<=\d) \* (?=\d)")),
    ("snake", None, re.compile(r"(?<=\w)_(?=\w)")),
    ("bracket", None, re.compile(r"(?<!\[)\[[^\[\]\n]{1,12}\](?![\](])")),
    ("path", None, re.compile(r"\b[A-Za-z]:\\\w")),
    ("number sign", None, re.compile(r"#\d")),
    ("compare", None, re.compile(r"<(?=[\s=\d])|(?<=\s)>(?=[\s=])")),
)
NAMES = ("document", "block", "element", "comment", "entity", "half tag", *(n for n, *_ in SIGNS))
OWN = {n: g for n, g, _ in SIGNS} | {"element": HTML, "comment": HTML, "entity": HTML, "half tag": HTML}
PLAIN = {"price", "lone star", "snake", "bracket", "path", "number sign", "compare"}
_any_sign = re.compile(r"[#*_`|\[\]{}\\$'=<>~]|^[ \t]*(?:[-+]|\d{1,3}[.)])[ \t]", re.M)


class Node:
    __slots__ = ("kind", "children", "up", "belief")

    def __init__(self, kind: str) -> None:
        self.kind, self.children = kind, []


class Block(Node):
    """A node with text of its own: ``plain`` is that without tags, ``edits`` says how those are drawn, ``kept`` are its stretches of code.

    Where the text turns out to hold escaped tags, ``inner`` is the block that stands for it.
    """

    __slots__ = ("pieces", "size", "plain", "edits", "signs", "kept", "inner", "depth", "since", "escapes")

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.pieces, self.size, self.plain, self.edits, self.signs, self.kept, self.inner = [], 0, "", [], [], [], None
        self.depth, self.since, self.escapes = 0, 0, False

    def put(self, piece: str) -> None:
        if piece:
            self.pieces.append(piece)
            self.size += len(piece)

    def mark(self, edit: Edit, shown: str) -> None:
        """An edit at this place, of so much text; code begins after it or ends before it."""
        if edit.code < 0 and self.depth:
            self.depth -= 1
            if not self.depth:
                self.kept.append((self.since, self.size))
        edit.start = self.size
        if shown:
            self.pieces.append(shown)
            self.size += len(shown)
        edit.end = self.size
        self.edits.append(edit)
        if edit.code > 0:
            self.depth += 1
            if self.depth == 1:
                self.since = self.size

    def close(self) -> None:
        if self.depth:
            self.kept.append((self.since, self.size))
        self.plain = "".join(self.pieces)
        self.pieces = []


class Edit:
    """A stretch of a block's text and what is drawn for it, if ``node`` under ``parent`` is no content; ``raw`` is drawn if it is."""

    __slots__ = ("start", "end", "drawn", "raw", "parent", "node", "block", "code")

    def __init__(self, drawn: str, raw: str, parent: Node, node: Node, block: Block | None = None, code: int = 0) -> None:
        self.start = self.end = 0
        self.drawn, self.raw, self.parent, self.node, self.block, self.code = drawn, raw, parent, node, block, code


#: A character without which a sign cannot stand.
NEEDS = {
    "fence": "`~", "atx": "#", "atx deep": "##", "setext": "=-", "star item": "*", "stars item": "**", "quote": ">", "rule row": "--",
    "bold": "**", "under bold": "__", "italic": "*", "under italic": "_", "code": "`", "link": "](", "strike": "~~", "wiki heading": "==",
    "wiki bold": "'''", "wiki italic": "''", "wiki link": "[[", "template": "{{", "wiki table": "|", "wiki cells": "|!", "command": "\\", "environment": "\\begin{\\end{",
    "item": "\\item", "display": "\\$", "inline": "\\(", "dollar": "$", "price": "$", "lone star": "*", "snake": "_", "bracket": "[", "path": ":\\",
    "number sign": "#", "compare": "<>",
}
_EITHER = {"fence", "setext", "wiki cells", "display", "compare"}
_NEEDS = [(n, rx, tuple(NEEDS[n]) if n in _EITHER else ("\\begin{", "\\end{") if n == "environment" else (NEEDS[n],) if n in NEEDS else ("",)) for n, _, rx in SIGNS]


def _signs(into: Block) -> None:
    """Leaves of a stretch of text without tags."""
    text = into.plain
    if not _any_sign.search(text):
        return
    for name, rx, need in _NEEDS:
        if need[0] not in text and (len(need) == 1 or need[1] not in text):
            continue
        for m in rx.finditer(text):
            if name == "atx" and len(m[1]) > 1:
                continue
            into.children.append(Node(name))
            into.signs.append((name, m))


def _valid(m: re.Match) -> bool:
    return m[1] is None or m[1] + ";" in html5


# Elements an element ends that were left open before it, and those it does not look beyond.
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS |= {n: {"p"} for n in BLOCKS | {f"h{k}" for k in range(1, 7)} if n not in ENDS}
SCOPE = {"ul", "ol", "dl", "table", "select", "div", "section", "blockquote", "iframe", "article", "body", "form", "center"}
CODE = {"pre", "code", "samp", "kbd", "tt", "nowiki", "math", "textarea"}


def _drawn(name: str, end: bool) -> str:
    """What a tag is drawn as."""
    if name[0] == "h" and name[1:] in ("1", "2", "3", "4", "5", "6"):
        return "\n" if end else "\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if end else "\n- "
    if name in ("td", "th"):
        return " |" if end else " "
    if name == "tr":
        return "\n" if end else "\n|"
    if name == "pre":
        return "\n```\n"
    return "\n" if name == "br" or name in BLOCKS else ""


def parse(text: str) -> Block:
    """The tree of a text, with the documents inside it to any depth (each is shorter than the text it stands in)."""
    root = Block("document")
    waiting: list[tuple[str, Block, Block | None]] = [(text, root, None)]
    while waiting:
        waiting.extend(_parse_one(*waiting.pop()))
    return root


def _parse_one(text: str, root: Block, outside: Block | None) -> list[tuple[str, Block, Block | None]]:
    """Hangs a document's nodes under ``root``; the documents inside it are returned with their blocks.

    ``outside`` is the block whose text this is, if that had tags and code of its own: they keep their places.
    """
    inside: list[tuple[str, Block, Block | None]] = []
    if outside is None and text.startswith(("@@@LINK=", "\ufeff@@@LINK=")):
        text = text.split("=", 1)[1]
    stack: list[tuple[str, Node]] = [("", root)]
    opened: dict[str, int] = {}
    blocks, all_blocks = [root], [root]
    last, skip = 0, None
    marks = outside.edits if outside else []
    code = outside.kept if outside else []
    at = 0

    def add(a: int, b: int) -> None:
        """The text from a to b, with what stands in it from outside."""
        nonlocal at
        if skip and not marks:
            return
        while at < len(marks) and marks[at].start < b:
            e = marks[at]
            at += 1
            if e.start > a:
                piece(text[a : e.start], a)
            blocks[-1].mark(Edit(e.drawn, e.raw, e.parent, e.node, e.block, e.code), text[max(e.start, a) : e.end] if not skip else "")
            a = max(a, e.end)
        if a < b:
            piece(text[a:b], a)

    def in_code(pos: int) -> bool:
        return any(s <= pos < e for s, e in code)

    def piece(t: str, pos: int) -> None:
        if skip:
            return
        block, under = blocks[-1], stack[-1][1]
        if "&" in t and not (code and in_code(pos)):
            n = sum(1 for m in _entity.finditer(t) if _valid(m))
            if n:
                under.children.extend(Node("entity") for _ in range(n))
                t = html.unescape(t)
                block.escapes = True
        if (">" in t or "<" in t) and (half := _half.search(t)):
            node = Node("half tag")
            under.children.append(node)
            block.put(t[: half.start()])
            block.mark(Edit("", half[0], under, node), half[0])
            t = t[half.end() :]
        block.put(t)

    def leave(left_open: bool = True) -> None:
        """Ends the innermost element."""
        name, node = stack.pop()
        opened[name] -= 1
        if node is blocks[-1] and len(blocks) > 1:
            blocks.pop()
        if left_open and (name in CODE or name in ("td", "th", "tr")):
            blocks[-1].mark(Edit(_drawn(name, True), "", stack[-1][1], node, None, -(name in CODE)), "")

    if "<" in text:
        for m in _tag.finditer(text):
            add(last, m.start())
            last = m.end()
            raw = m[0]
            if code and in_code(m.start()):  # escaped tags are the code itself
                node = Node("element")
                stack[-1][1].children.append(node)
                blocks[-1].mark(Edit(raw, raw, stack[-1][1], node), "")
                continue
            if m[2] is None:
                node = Node("comment")
                stack[-1][1].children.append(node)
                if not skip:
                    blocks[-1].mark(Edit("", raw, stack[-1][1], node), "")
                continue
            name = m[2].lower()
            if skip:
                if m[1] and name == skip:
                    skip = None
                    leave(False)
                continue
            shown = "\n" if name in BLOCKS or name in ("br", "li") else " " if name in ("td", "th") else ""
            if m[1]:
                if not opened.get(name):
                    node = Node("element")  # an end without a beginning
                    stack[-1][1].children.append(node)
                    blocks[-1].mark(Edit(_drawn(name, True), raw, stack[-1][1], node), "")
                    continue
                while stack[-1][0] != name:
                    leave()
                node = stack[-1][1]
                leave(False)
                blocks[-1].mark(Edit(_drawn(name, True), raw, stack[-1][1], node, None, -(name in CODE)), shown if name != "br" else "")
                continue
            if name in ENDS and any(opened.get(n) for n in ENDS[name]):
                k = len(stack) - 1
                deepest = None
                while k and stack[k][0] not in SCOPE:
                    if stack[k][0] in ENDS[name]:
                        deepest = k
                    k -= 1
                while deepest and len(stack) > deepest:
                    leave()
            node = Node("element")
            under = stack[-1][1]
            under.children.append(node)
            block = doc = None
            if name in ("section", "iframe"):
                block = Block("block")
                node.children.append(block)
                doc = _srcdoc.search(m[3]) if name == "iframe" else None
                if doc is None:
                    all_blocks.append(block)
            blocks[-1].mark(Edit(_drawn(name, False), raw, under, node, block, int(name in CODE)), shown)
            if doc:
                inner = html.unescape(doc[1][1:-1])
                inside.append((inner, block, None))
                if inner != doc[1][1:-1]:
                    node.children.append(Node("entity"))
            elif name == "section":
                blocks.append(block)
                stack.append((name, block))
                opened[name] = opened.get(name, 0) + 1
                continue
            if name not in VOID and not raw.rstrip(">").endswith("/"):
                stack.append((name, node))
                opened[name] = opened.get(name, 0) + 1
                if name in ("script", "style"):
                    skip = name
        add(last, len(text))
    else:
        add(0, len(text))
    skip = None
    for e in marks[at:]:  # at the end of the text
        root.mark(Edit(e.drawn, e.raw, e.parent, e.node, e.block, e.code), "")
    for b in all_blocks:
        b.close()
        # tags that were escaped, or escapes of escapes, are a document of their own
        if ("<" in b.plain and _tag.search(b.plain)) or (b.escapes and "&" in b.plain and any(map(_valid, _entity.finditer(b.plain)))):
            b.inner = Block("block")
            b.children.append(b.inner)
            inside.append((b.plain, b.inner, b))
        else:
            _signs(b)
    return inside


def _downwards(root: Node) -> list[Node]:
    """All nodes that have children, and the root, each before those under it."""
    out = [root]
    for n in out:
        out.extend(c for c in n.children if c.children)
    return out


class Model:
    """Log potentials: a label's sign (emission) and a parent's label with a child's (edge)."""

    def __init__(self, edge: list[list[float]], emission: dict[str, list[float]], prior: list[float]) -> None:
        self.edge, self.emission, self.prior = edge, emission, prior
        self.across = [[edge[p][k] for p in range(5)] for k in range(5)]
        # what a leaf of each kind tells its parent
        self.leaf = {k: self._tell([1.0] * 5, e) for k, e in emission.items()}
        self.leaf_log = {k: [log(x) for x in m] for k, m in self.leaf.items()}
        # what a leaf's label is, given its parent's belief: that without the leaf's own part, over the edge
        self.back = {k: [[emission[k][c] * edge[p][c] / m[p] for p in range(5)] for c in range(5)] for k, m in self.leaf.items()}

    def _tell(self, below: list[float], emission: list[float]) -> list[float]:
        o0, o1, o2, o3, o4 = below[0] * emission[0], below[1] * emission[1], below[2] * emission[2], below[3] * emission[3], below[4] * emission[4]
        out = [r[0] * o0 + r[1] * o1 + r[2] * o2 + r[3] * o3 + r[4] * o4 for r in self.edge]
        top = max(out) or 1.0
        return [x / top for x in out]

    def marginals(self, root: Node) -> list[tuple[str, list[float]]]:
        """(kind, marginal) of all nodes; leaves of one kind under one parent are computed once."""
        return [(kind, m) for _, kind, m in self.beliefs(root)]

    def labels(self, root: Node) -> dict[tuple[int, str] | int, int]:
        """The likeliest label of every node with children, by its id, and of leaves by their parent's id and their kind."""
        return {key: max(range(5), key=m.__getitem__) for key, _, m in self.beliefs(root)}

    def beliefs(self, root: Node) -> list[tuple[tuple[int, str] | int, str, list[float]]]:
        out: list[tuple[tuple[int, str] | int, str, list[float]]] = []
        nodes = _downwards(root)
        for n in reversed(nodes):
            leaves: dict[str, int] = {}
            inner = []
            # in logarithms, as there may be any number of equal leaves
            l0 = l1 = l2 = l3 = l4 = 0.0
            for c in n.children:
                if c.children:
                    inner.append(c)
                    u = c.up
                    l0, l1, l2, l3, l4 = l0 + log(u[0]), l1 + log(u[1]), l2 + log(u[2]), l3 + log(u[3]), l4 + log(u[4])
                else:
                    leaves[c.kind] = leaves.get(c.kind, 0) + 1
            for k, k_n in leaves.items():
                u = self.leaf_log[k]
                l0, l1, l2, l3, l4 = l0 + k_n * u[0], l1 + k_n * u[1], l2 + k_n * u[2], l3 + k_n * u[3], l4 + k_n * u[4]
            top = max(l0, l1, l2, l3, l4)
            below = [exp(l0 - top), exp(l1 - top), exp(l2 - top), exp(l3 - top), exp(l4 - top)]
            n.belief = (below, leaves, inner)
            if n is not root:
                n.up = self._tell(below, self.emission[n.kind])
        above = {id(root): self.prior}
        for n in nodes:
            below, leaves, inner = n.belief
            p, e = above.pop(id(n)), self.emission[n.kind]
            o0, o1, o2, o3, o4 = p[0] * below[0] * e[0], p[1] * below[1] * e[1], p[2] * below[2] * e[2], p[3] * below[3] * e[3], p[4] * below[4] * e[4]
            total = o0 + o1 + o2 + o3 + o4 or 1.0
            o0, o1, o2, o3, o4 = o0 / total, o1 / total, o2 / total, o3 / total, o4 / total
            key = id(n)
            out.append((key, n.kind, [o0, o1, o2, o3, o4]))
            for k in leaves:
                got = [r[0] * o0 + r[1] * o1 + r[2] * o2 + r[3] * o3 + r[4] * o4 for r in self.back[k]]
                total = sum(got) or 1.0
                out.append(((key, k), k, [x / total for x in got]))
            for c in inner:
                m = c.up
                c0, c1, c2, c3, c4 = o0 / (m[0] or 1e-30), o1 / (m[1] or 1e-30), o2 / (m[2] or 1e-30), o3 / (m[3] or 1e-30), o4 / (m[4] or 1e-30)
                top = max(c0, c1, c2, c3, c4) or 1.0
                above[id(c)] = [(c0 * r[0] + c1 * r[1] + c2 * r[2] + c3 * r[3] + c4 * r[4]) / top for r in self.across]
        return out


def _label(root: Node, rows: list[tuple[int, int, str]]) -> int:
    """Labels of a labelled page: appends (parent label, label, kind) and returns the root's own label."""

    def leaf(n: Node, context: int | None) -> int:
        own = OWN.get(n.kind)
        if n.kind in PLAIN or n.kind in ("document", "block"):
            return CONTENT
        return own if own is not None else (context if context in (MARKDOWN, WIKI) else MARKDOWN)

    if not root.children:
        return leaf(root, None)
    nodes = _downwards(root)
    context: dict[int, int | None] = {id(root): None}
    texts: dict[int, dict[int, int]] = {}
    for n in nodes:
        votes = Counter(OWN[c.kind] for c in n.children if OWN.get(c.kind) is not None)
        texts[id(n)] = own = {k: v for k, v in votes.items() if k in (MARKDOWN, WIKI)}
        # what holds for the node's children
        here = context[id(n)] = max(own, key=own.get) if own else context[id(n)]
        context |= {id(c): here for c in n.children if c.children}
    mine: dict[int, int] = {}
    for n in reversed(nodes):
        here = context[id(n)]
        labels = [mine[id(c)] if c.children else leaf(c, here) for c in n.children]
        own = HTML if n.kind == "element" else Counter(labels).most_common(1)[0][0]
        if texts[id(n)] and n.kind != "element":
            own = here
        mine[id(n)] = own
        rows.extend((own, k, c.kind) for c, k in zip(n.children, labels))
    return mine[id(root)]


def train(texts: list[str]) -> Model:
    """Potentials by counting over labelled pages, with a little of everything added."""
    rows: list[tuple[int, int, str]] = []
    roots: Counter = Counter()
    for t in texts:
        root = parse(t)
        k = _label(root, rows)
        roots[k] += 1
        rows.append((k, k, "document"))
    edge = [[1.0] * 5 for _ in range(5)]
    emission = {k: [0.05] * 5 for k in NAMES}
    for p, k, kind in rows:
        if kind != "document":
            edge[p][k] += 1
        emission[kind][k] += 1
    for k in NAMES:  # what a sign is must not rest on a small sample alone
        own = OWN.get(k)
        if own is not None:
            emission[k][own] += 20
        elif k in PLAIN:
            emission[k][CONTENT] += 20
        elif k in ("document", "block"):
            emission[k] = [x + 20 for x in emission[k]]
        else:
            emission[k][MARKDOWN] += 20
            emission[k][WIKI] += 10
    totals = [sum(emission[k][c] for k in NAMES) for c in range(5)]
    emission = {k: [e / t for e, t in zip(v, totals)] for k, v in emission.items()}
    edge = [[x / sum(r) for x in r] for r in edge]
    return Model(edge, emission, [(roots[c] + 1) / (sum(roots.values()) + 5) for c in range(5)])


def carried(text: str, model: Model) -> list[str]:
    """Languages a text carries."""
    root = parse(text)
    if not root.children:
        return []
    found = set()
    for kind, m in model.marginals(root):
        if kind in ("document", "block"):
            continue
        best = max(range(5), key=m.__getitem__)
        if best != CONTENT and m[best] > 0.5:
            found.add(LABELS[best])
    return sorted(found)


# ---------------------------------------------------------------- rendering


#: Signs of which only what they enclose is drawn.
ENCLOSING = {"bold", "under bold", "italic", "under italic", "strike", "code", "link", "wiki bold", "wiki italic"}
# Environments whose text is a formula, and whose text is code.
FORMULAS = {"equation", "align", "displaymath", "math", "gather", "multline", "eqnarray", "cases", "array", "matrix", "pmatrix"}
LISTINGS = {"verbatim", "lstlisting", "Verbatim"}
Change = tuple[int, int, str]


def _braces(text: str) -> dict[int, int]:
    """Where each opening brace is closed."""
    out, open_ = {}, []
    for m in re.finditer(r"\\.|[{}]", text, re.S):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "}" and open_:
            out[open_.pop()] = m.start()
    return out


def _line_after(text: str, e: int) -> int:
    return e + 1 if text[e : e + 1] == "\n" else e


def _command(text: str, s: int, e: int, braces: dict[int, int]) -> Iterator[Change]:
    """A LaTeX command from s to its opening brace before e."""
    name = re.match(r"\\([A-Za-z]+)", text[s:e])[1]
    close = braces.get(e - 1)
    if name in ("begin", "end"):
        return
    if close is None:
        yield s, e, ""
        return
    more = braces.get(close + 1)
    if name == "href" and more is not None:
        yield s, close + 2, ""
        yield more, more + 1, ""
        return
    level = 1 + name.count("sub") if name.endswith("section") else 1 if name == "chapter" else 0
    yield s, e, "#" * level + " " if level else "(" if name == "footnote" else ""
    if name == "entry" and more is not None:
        yield close, close + 2, " ("
        yield more, more + 1, ")"
    else:
        yield close, close + 1, ")" if name == "footnote" else ""


_row_end = re.compile(r"\\\\(?:\[[^\]\n]*\])?|\Z")
_rules = re.compile(r"(?:\s|\\hline\b|\\(?:top|mid|bottom)rule\b)*")
_cell = re.compile(r"(?<!\\)[ \t]*&[ \t]*")
_options = re.compile(r"\[[^\]\n]*\]|\{[^{}\n]*\}")


def _rows(text: str, s: int, e: int) -> Iterator[Change]:
    """The rows of a LaTeX table between s and e."""
    first = s
    for m in _row_end.finditer(text, s, e):
        lead = _rules.match(text, s, m.start()).end()
        if lead < m.start():
            yield s, lead, "| " if s == first else "\n| "
            for x in _cell.finditer(text, lead, m.start()):
                yield x.start(), x.end(), " | "
            yield lead + len(text[lead : m.start()].rstrip()), m.end(), " |"
        else:
            yield s, m.end(), "\n"
        s = m.end()


def _environments(text: str, found: list[re.Match], changes: list[Change], kept: list[tuple[int, int]]) -> None:
    open_: list[tuple[str, re.Match]] = []
    for m in sorted(found, key=lambda m: m.start()):
        name = m[0][m[0].index("{") + 1 : -1].rstrip("*")
        if m[0].startswith("\\begin"):
            open_.append((name, m))
            continue
        begin = None
        if any(n == name for n, _ in open_):
            while open_ and begin is None:
                n, b = open_.pop()
                begin = b if n == name else None
        if begin is None:
            changes.append((m.start(), _line_after(text, m.end()), ""))
        elif name in FORMULAS:
            kept.append((begin.start(), m.end()))
        elif name in LISTINGS:
            kept.append((begin.end(), m.start()))
            changes += [(begin.start(), begin.end(), "```"), (m.start(), m.end(), "```")]
        else:
            e = begin.end()
            if name.startswith("tabular"):
                while extra := _options.match(text, e):
                    e = extra.end()
                changes.extend(_rows(text, e, m.start()))
                changes.append((begin.start(), e, ""))
            else:
                changes.append((begin.start(), _line_after(text, e), ""))
            changes.append((m.start(), _line_after(text, m.end()), ""))
    changes.extend((m.start(), _line_after(text, m.end()), "") for n, m in open_ if n not in FORMULAS)


def _changes(b: Block, labels: dict) -> tuple[list[Change], list[tuple[int, int]]]:
    """What the signs of a block change in its text, and the stretches of code and formulas in which nothing is changed."""
    text, out, kept = b.plain, [], list(b.kept)
    fences: list[re.Match] = []
    environments: list[re.Match] = []
    braces = None
    for kind, m in b.signs:
        label = labels[id(b), kind]
        s, e = m.span()
        if kind in ("display", "inline", "dollar"):
            kept.append((s, e))
        elif kind == "fence":
            fences.append(m)
        if label == CONTENT or kind in PLAIN:
            continue
        if kind in ENCLOSING:
            out += [(s, m.start(1), ""), (m.end(1), e, "")]
            if kind == "code":
                kept.append(m.span(1))
        elif kind == "atx":
            if label == WIKI:
                out.append((s, e, "- "))
        elif kind == "setext":
            line = text.index("\n", s)
            out += [(s, s, "# " if m[1][0] == "=" else "## "), (line, e, "")]
        elif kind in ("dash item", "star item", "stars item", "item"):
            out.append((s, e + len(text[e:]) - len(text[e:].lstrip(" \t")) if kind == "item" else e, "- "))
        elif kind == "quote":
            out.append((s, e, ""))
        elif kind == "rule row" or kind == "wiki table":
            out.append((s, _line_after(text, e), ""))
        elif kind == "wiki heading":
            out += [(s, m.start(2), "#" * max(len(m[1]), 2) + " "), (m.end(2), e, "")]
        elif kind == "wiki link":
            k = 1 if m[2] is None else 2
            out += [(s, m.start(k), ""), (m.end(k), e, "")]
        elif kind == "template":
            out += [(s, m.start(1) + m[1].find("|") + 1, ""), (m.end(1), e, "")]
        elif kind == "wiki cells":
            a = re.compile(r"[ \t]*[|!][ \t]*").match(text, s).end()
            out += [(s, a, "| "), (s + len(text[s:e].rstrip()), e, " |")]
            out += [(x.start(), x.end(), " | ") for x in re.compile(r"[ \t]*(?:\|\||!!)[ \t]*").finditer(text, a, e)]
        elif kind == "command":
            braces = _braces(text) if braces is None else braces
            out.extend(_command(text, s, e, braces))
        elif kind == "environment":
            environments.append(m)
    begin = None
    for m in fences:
        if begin is None:
            begin = m
        elif m[1] == begin[1]:
            kept.append((begin.start(), m.end()))
            begin = None
    if begin is not None:
        kept.append((begin.start(), len(text)))
    if environments:
        _environments(text, environments, out, kept)
    return out, kept


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _draw(b: Block, labels: dict, drawn: dict[int, str]) -> str:
    """A block as text; what stands inside it has been drawn."""
    if b.inner is not None:
        return drawn[id(b.inner)]
    changes, kept = _changes(b, labels)
    kept = _merged(kept)
    begins = [s for s, _ in kept]

    def free(s: int, e: int) -> bool:
        """Outside of all code and formulas."""
        k = bisect_right(begins, s) - 1
        if k >= 0 and s < kept[k][1] and (e > s or s > kept[k][0]):
            return False
        return k + 1 >= len(kept) or e <= kept[k + 1][0] or s == e

    edits: list[tuple[int, int, int, str, Block | None]] = [(s, 1, e, r, None) for s, e, r in changes if free(s, e)]
    for x in b.edits:
        label = labels[id(x.node)] if x.node.children else labels.get((id(x.parent), x.node.kind), HTML)
        edits.append((x.start, 0, x.end, x.drawn if label != CONTENT else x.raw, x.block))
    edits.sort(key=lambda x: (x[0], x[1]))
    parts: list[tuple[str, bool]] = []
    pos = 0

    def copy(to: int) -> None:
        """The text up to a place; code and formulas apart."""
        nonlocal pos
        k = max(bisect_right(begins, pos) - 1, 0)
        while pos < to:
            while k < len(kept) and kept[k][1] <= pos:
                k += 1
            inside = k < len(kept) and kept[k][0] <= pos
            upto = min(to, kept[k][1] if inside else kept[k][0] if k < len(kept) else to)
            parts.append((b.plain[pos:upto], inside))
            pos = upto

    for s, sign, e, r, block in edits:
        if s < pos and sign:
            continue  # inside another one
        copy(max(s, pos))
        if r == "\n|" and parts and parts[-1][0][-1:] == "\n":
            r = "|"  # rows stand one below the other
        parts.append((r, False))
        if block is not None:
            parts += [(drawn[id(block)], True), ("\n", False)]
        pos = max(pos, e)
    copy(len(b.plain))
    return _together(parts)


def _together(parts: list[tuple[str, bool]]) -> str:
    """Parts one after the other; outside of those that stay as they are no blanks at line ends and no more than one empty line."""
    out = ""
    for as_it_is, group in groupby(parts, key=lambda p: p[1]):
        piece = "".join(p for p, _ in group)
        if not as_it_is:
            piece = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", piece))
        before, after = len(out) - len(out.rstrip("\n")), len(piece) - len(piece.lstrip("\n"))
        if before + after > 2 and not as_it_is:
            piece = piece[min(after, before + after - 2) :]
        out += piece
    return out


def clean(text: str | None, model: Model) -> str | None:
    """The text without markup, its structure kept."""
    if text is None:
        return None
    prefix = re.match("\ufeff?@@@LINK=|", text)[0]
    root = parse(text)
    if not root.children:
        return text
    labels = model.labels(root)
    blocks, todo = [], [root]
    while todo:
        n = todo.pop()
        if isinstance(n, Block):
            blocks.append(n)
        todo.extend(c for c in n.children if c.children or isinstance(c, Block))
    drawn: dict[int, str] = {}
    for b in reversed(blocks):  # what stands inside comes after what it stands in
        drawn[id(b)] = _draw(b, labels, drawn)
    if all(k == CONTENT for key, k in labels.items() if isinstance(key, tuple)):
        return text
    return prefix + drawn[id(root)].strip("\n")


# ---------------------------------------------------------------- Spark


def labelled_pages(texts: DataFrame, sample: int = SAMPLE) -> list[str]:
    """A bounded sample of texts(src, row_id, text), the same for the same rows: those of the lowest hashes.

    Only hashes below a threshold set by the number of rows are looked at, so that hardly more rows than asked for reach the driver.
    """
    rows = texts.count()
    lowest = F.xxhash64("src", "row_id")
    share = min(1.0, 2.0 * sample / max(rows, 1))
    found = texts.where("text is not null")
    if share < 1.0:
        found = found.where(lowest < int(-(1 << 63) + share * (1 << 64)))
    picked = found.orderBy(lowest, "src", "row_id").limit(sample)
    return [r["text"] for r in picked.select("text").collect()]


def find_markup(texts: DataFrame, model: Model) -> DataFrame:
    """src, row_id, markup of texts(src, row_id, text): one row per language a text carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, row, kind = [], [], []
            for s, r, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                for k in carried(t, model):
                    src.append(s)
                    row.append(r)
                    kind.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(row, pa.int64()), pa.array(kind, pa.string())], names=["src", "row_id", "markup"])

    source = texts.select("src", F.col("row_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return source.mapInArrow(run, "src string, row_id long, markup string")


def clean_texts(texts: DataFrame, model: Model) -> DataFrame:
    """src, row_id, text with the text cleaned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([clean(t, model) for t in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], names=["src", "row_id", "text"])

    source = texts.select("src", F.col("row_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "src string, row_id long, text string")
