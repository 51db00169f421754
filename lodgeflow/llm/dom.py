"""HTML pages as trees of elements and pieces of text, in flat lists."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Fixed by the language: names of elements and what they close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea noscript iframe noembed noframes template svg math object video audio canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var label ruby rt rp wbr img nobr".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An element that begins ends an open one of these, unless one of those stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
_SCOPE = frozenset("table td th caption button html body".split())


class _Blocks:
    """All names but those of inline elements."""

    def __contains__(self, name: str) -> bool:
        return name not in INLINE


_BLOCKS = _Blocks()
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TOLD = ("class", "id=", "role", "itemprop", "hidden", "display", "data-content", "CLASS", "ID=")


def told(tag: str, attrs: str) -> tuple[list[str], int | None]:
    """Feature words of an element: its name, the words of class, id, role and
    itemprop and their beginnings; and the label that ``data-content`` gives it."""
    words, label = ["t:" + tag], None
    if any(x in attrs for x in _TOLD):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next(filter(None, values), "")
            if name in ("class", "id", "role", "itemprop"):
                for w in map(str.lower, _WORD.findall(value)):
                    words += ["c:" + w] + ["c5:" + w[:5]] * (len(w) >= 5)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                words.append("hidden")
            elif name == "data-content":
                label = int(value == "1")
    return list(dict.fromkeys(words)), label


class Forest:
    """Trees of many pages. Nodes are block elements, inline ones that are named by an
    attribute, and pieces of text; a parent stands before its children. A page's
    first node is its root."""

    def __init__(self):
        self.parent, self.depth, self.words, self.label = [], [], [], []
        self.text: list[list[str] | None] = []  # parts of a piece; None for an element
        self.linked: list[int] = []             # characters of links in a piece
        self.broken: list[bool] = []            # whether a block begins or ends before a piece
        self.roots: list[int] = []
        self._told: dict[tuple[str, str], tuple[list[str], int | None]] = {}

    def _node(self, parent: int, words: list[str], label: int, text: list[str] | None = None, linked: int = 0, broken: bool = True) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.words.append(words)
        self.label.append(label)
        self.text.append(text)
        self.linked.append(linked)
        self.broken.append(broken)
        return len(self.parent) - 1

    def _of(self, tag: str, attrs: str) -> tuple[list[str], int | None]:
        key = tag, attrs if any(x in attrs for x in _TOLD) else ""
        if key not in self._told:
            if len(self._told) > 10_000:
                self._told.clear()
            self._told[key] = told(*key)
        return self._told[key]

    def add(self, html: str) -> None:
        """One page. Tags need not be closed or nested well; comments, scripts, styles
        and the like have no text; character references are decoded."""
        root = self._node(-1, ["t:#page"], 0)
        self.roots.append(root)
        stack: list[tuple[str, int, int]] = [("#page", root, 0)]           # name, node, links open
        is_open: Counter = Counter()
        piece, broken, pos, end = None, True, 0, len(html)

        def cut(names, scope) -> None:
            """Close the nearest open element of these names, with all inside it."""
            if not any(is_open[x] for x in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    is_open.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    return
                if stack[i][0] in scope:
                    return

        while pos < end:
            m = _TOKEN.search(html, pos)
            at = m.start() if m else end
            if at > pos:
                raw = html[pos:at]
                _, node, links = stack[-1]
                if not raw.isspace():
                    raw = unescape(raw) if "&" in raw else raw
                    if piece is None or piece[0] != node:
                        piece = (node, self._node(node, self.words[node][:1], self.label[node], [], 0, broken))
                        broken = False
                    k = piece[1]
                    self.text[k].append(raw)
                    self.linked[k] += len(raw) if links else 0
                elif piece is not None and piece[0] == node:
                    self.text[piece[1]].append(" ")
                else:
                    broken = True
            if not m:
                break
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            if m[1]:
                if inline:
                    cut((tag,), _BLOCKS)
                elif tag not in VOID:
                    cut((tag,), () if tag in ("article", "main", "table", "body", "html") else _SCOPE - {tag})
                    piece, broken = None, True
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    if tag == "hr":
                        cut(("p",), _SCOPE)
                        piece = None
                    if piece is not None:
                        self.text[piece[1]].append(" ")
                    broken = True
                continue
            if tag in UNREAD:
                closing = re.compile(f"</{tag}(?=[\\s/>])[^>]*>|\\Z", re.I).search(html, pos)
                pos = closing.end()
                if tag not in ("script", "style", "title"):
                    piece, broken = None, True
                continue
            words, label = self._of(tag, m[3])
            if inline:
                name, node, links = stack[-1]
                if len(words) > 1 or label is not None:
                    node = self._node(node, words, self.label[node] if label is None else label)
                stack.append((tag, node, links + (tag == "a")))
                is_open[tag] += 1
                continue
            if tag in ("html", "body", "head"):
                piece, broken = None, True
                continue
            if tag in CLOSE_P:
                cut(("p",), _SCOPE)
            if tag in ENDS:
                cut(*ENDS[tag])
            _, node, links = stack[-1]
            stack.append((tag, self._node(node, words, self.label[node] if label is None else label), links))
            is_open[tag] += 1
            piece, broken = None, True
