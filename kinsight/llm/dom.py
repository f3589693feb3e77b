"""A forgiving HTML tree: enough structure for block-level decisions on any markup."""

from __future__ import annotations

import re
from html import unescape

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas audio video select button option datalist xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr ins li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag closes an open element of these kinds, up to the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ENDS_P = BLOCK - {"ins", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NAMING = frozenset(("class", "id", "role", "aria-label", "itemprop", "data-k"))


#: Elements nested deeper become siblings at this depth.
DEEPEST = 400


class Node:
    __slots__ = ("tag", "parent", "items", "tokens", "depth", "mark")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list = []
        self.tokens: frozenset[str] = frozenset()
        self.depth = parent.depth + 1 if parent else 0
        self.mark: str | None = None

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(html: str) -> Node:
    """The tree of block elements. Items are nodes, text, or (text, True) for the text of links."""
    root = Node("#root", None)
    node, links, at = root, 0, 0

    def say(text: str) -> None:
        if text:
            text = unescape(text)
            node.items.append((text, True) if links else text)

    while True:
        m = TAG.search(html, at)
        if m is None:
            say(html[at:])
            return root
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not m.group(1) and not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                # an element of this kind that is never closed holds no more than itself
                at = end.end() if end else (len(html) if name in ("script", "style", "title", "textarea") else at)
            continue
        if m.group(1):
            if name == "a":
                links = max(links - 1, 0)
            elif name in BLOCK:
                up = node
                while up.parent is not None and up.tag != name:
                    up = up.parent
                if up.parent is not None:
                    node, links = up.parent, 0
            continue
        if name == "br":
            say(" ")
        elif name == "a":
            links = 1
        elif name in BLOCK:
            if name in ENDS_P:
                up = node
                while up.parent is not None and up.tag not in ("p", "li", "td", "th", "div", "section", "article", "body", "main", "aside", "blockquote", "dd"):
                    up = up.parent
                if up.tag == "p":
                    node = up.parent
            if name in CLOSES:
                closing, bounds = CLOSES[name]
                up = node
                while up.parent is not None and up.tag not in closing and up.tag not in bounds:
                    up = up.parent
                if up.tag in closing:
                    node = up.parent
            links = 0
            if node.depth >= DEEPEST:
                node = node.parent
            child = Node(name, node)
            if m.group(3):
                tokens: set[str] = set()
                for a in ATTRIBUTE.finditer(m.group(3)):
                    key = a.group(1).lower()
                    if key in NAMING:
                        value = a.group(2) or a.group(3) or a.group(4) or ""
                        if key == "data-k":
                            child.mark = value
                        else:
                            tokens.update(w.lower() for w in WORDS.findall(value))
                child.tokens = frozenset(tokens)
            node.items.append(child)
            if name not in VOID:
                node = child
