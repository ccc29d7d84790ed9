"""One linear parse of a page: elements, blocks, evidence and structures as nested columns that every extractor reads.

Elements carry their pre-order number and that of the last element inside them, so containment is an interval test,
and the interval of text pieces that they cover. Nothing is gathered on all open elements, so work is linear in a page.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end, whose text isn't shown, and that stand for places on a page; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg".split())
PLACES = frozenset("nav footer header main aside form dialog table button section article".split())
HEADINGS = frozenset("h1 h2 h3 h4".split())
#: What ends an open element when it begins, and what an open element is not looked for behind; fixed values.
BLOCK_LEVEL = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"p": BLOCK_LEVEL, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "a": {"a"}, "button": {"button"}}
SCOPES = {"p": {"button", "table", "td", "th", "caption"}, "li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}, "a": {"table"}, "button": {"table"}}
ENDED = {tag: [open_ for open_, tags in ENDS.items() if tag in tags] for tag in set().union(*ENDS.values())}
#: Elements behind whose end a new line of a block's text begins; fixed values.
LINES = frozenset("br p h1 h2 h3 h4 li button a summary td th label span".split())
#: Of these the ones that stand inside a line of a page's meaningful text; fixed values.
INSIDE = frozenset("label span".split())
#: Elements, and words of classes and ids, whose text means something, and what is noise; fixed values.
MEANINGFUL = frozenset("title h1 h2 h3 h4 p li summary details button a tr th td".split())
MEANINGFUL_WORDS = ("faq", "hero", "pricing", "price", "plan", "feature", "changelog", "release", "announcement", "cta")
NOISE, NOISE_WORDS = frozenset("script style noscript svg canvas iframe template".split()), ("cookie", "consent", "newsletter", "tracking")
#: Elements that are blocks, words of classes and ids that make one, and words whose elements are removed; fixed values.
BLOCKS = frozenset("nav header main footer section article aside form dialog table ul ol".split())
BLOCK_CLASS = ("hero", "pricing", "price", "plan", "tier", "feature", "card", "grid", "changelog", "release", "update", "modal")
BLOCK_ID = ("hero", "pricing", "price", "plan", "tier", "feature", "changelog", "release", "update", "modal")
REMOVED = frozenset("script style noscript canvas iframe template".split())
REMOVED_WORDS = ("cookie", "consent", "tracking")
#: Headings, links and buttons that are told with a block; fixed values.
MOST_HEADINGS, MOST_LINKS, MOST_BUTTONS = 4, 20, 16
#: Elements whose text and attributes are kept one by one; a block's text is in blocks.
KEPT = frozenset("title meta h1 h2 h3 h4 h5 h6 p li a button td th summary blockquote article section nav footer header aside table div form dialog script".split())

ELEMENT = "struct<ord:int,last:int,parent:int,tag:string,path:string,classes:string,attrs:map<string,string>,text:string,own_text:string>"
BLOCK = (
    "struct<block_hash:string,ord:int,last:int,place:int,inside:int,tag:string,dom_path:string,classes:string,id_attribute:string,aria_label:string,role_attribute:string,visibility:string,text:string,heading:string,heading_chain:array<string>,"
    "sibling_group:string,sibling_index:int,child_count:int,link_urls:array<string>,link_texts:array<string>,buttons:array<string>,table_rows:int,table_columns:int,list_items:int>"
)
EVIDENCE = "struct<ord:int,tag:string,path:string,classes:string,heading:string,lines:array<string>,buttons:array<string>>"
STRUCTURE = "struct<source:string,ord:int,cells:array<string>,heading:string>"
PARTS = {"elements": ELEMENT, "blocks": BLOCK, "evidence": EVIDENCE, "structures": STRUCTURE, "meaningful": "struct<ord:int,kind:string,text:string>", "block_places": "int"}


class Node:
    __slots__ = ("tag", "parent", "attrs", "first", "end", "last", "index", "children", "items", "heading", "own", "path", "removed", "row", "card", "block", "line", "below")

    def __init__(self, tag, parent, attrs):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children = self.items = 0
        self.heading, self.own, self.below = None, [], set()


class Tree(HTMLParser):
    """Nodes in the order in which they begin, and the page's pieces of shown text; None is the end of a
    line, False the end of what stands inside one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.pieces: list[str | bool | None] = []
        self.hidden = 0
        self.text: dict[int, list[str]] = {}
        self.wanted: dict[str, list[int]] = {}

    def _pop_to(self, size: int) -> None:
        while len(self.open) > size:
            node = self.nodes[self.open.pop()]
            self.places[node.tag].pop()
            if node.tag in KEPT:
                self.wanted[node.tag].pop()
            self.hidden -= node.tag in HIDDEN
            node.last, node.end = len(self.nodes) - 1, len(self.pieces)
            if node.tag in LINES:
                self.pieces.append(False if node.tag in INSIDE else None)

    def handle_starttag(self, tag, attrs):
        for ended in ENDED.get(tag, ()):
            at = self.places.get(ended)
            if at and at[-1] > max((self.places[s][-1] for s in SCOPES[ended] if self.places.get(s)), default=-1):
                self._pop_to(at[-1])
        attrs = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        node, i = Node(tag, parent, attrs), len(self.nodes)
        up = self.nodes[parent] if parent >= 0 else None
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower() if attrs else ""
        node.removed = bool(up and up.removed) or tag in REMOVED or any(w in named for w in REMOVED_WORDS)
        node.first = node.end = len(self.pieces)
        node.index = up.children if up else 0
        known = up.path if up else ""
        node.path = known + tag + ">" if tag in PLACES and f">{tag}>" not in f">{known}" else known
        node.last = i
        if up:
            up.children += 1
            up.items += tag == "li"
            up.below.add(tag)
            if tag in HEADINGS and up.heading is None:
                up.heading = i
        self.nodes.append(node)
        if tag in VOID:
            if tag in LINES:
                self.pieces.append(None)
            return
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in KEPT:
            self.wanted.setdefault(tag, []).append(i)
        self.open.append(i)
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.nodes[self.open[-1]].own.append(data)
            self.pieces.append(data)
            for at in self.wanted.values():
                if at:
                    self.text.setdefault(at[-1], []).append(data)

    def close(self):
        super().close()
        self._pop_to(0)


#: Characters that take no room; fixed values.
UNSEEN = re.compile("[\u200b\u200c\u200d\ufeff]")


def squeezed(parts) -> str:
    return " ".join("".join(parts).split())


def shown(text: str) -> str:
    return " ".join((text if text.isascii() else UNSEEN.sub("", text)).split())


def tree_of(markup: str) -> Tree:
    tree = Tree()
    tree.feed(markup)
    tree.close()
    return tree


def elements_of(tree: Tree, tags: frozenset = KEPT) -> list[dict]:
    """Kept elements: text is that inside without what further elements of the same tag inside hold."""
    out = []
    for i, n in enumerate(tree.nodes):
        if n.tag in tags:
            path = n.path if n.tag in PLACES else n.path + n.tag + ">"
            out.append(dict(ord=i, last=n.last, parent=n.parent, tag=n.tag, path=path[:-1], classes=n.attrs.get("class", ""), attrs=list(n.attrs.items()), text=squeezed(tree.text.get(i, ())), own_text=squeezed(n.own)))
    return out


def _is_block(n: Node) -> bool:
    if n.tag in BLOCKS or not n.attrs:
        return n.tag in BLOCKS
    classes, ident, role = n.attrs.get("class", ""), n.attrs.get("id", ""), n.attrs.get("role")
    return role in ("dialog", "table") or any(w in classes for w in BLOCK_CLASS) or any(w in ident for w in BLOCK_ID)


def _visibility(n: Node) -> str:
    style = n.attrs.get("style", "")
    if n.attrs.get("aria-expanded") == "false" or (n.tag == "details" and "open" not in n.attrs):
        return "collapsed"
    if n.tag == "dialog" or n.attrs.get("role") == "dialog" or "modal" in n.attrs.get("class", "") or "modal" in n.attrs.get("id", ""):
        return "modal"
    if n.attrs.get("aria-hidden") == "true":
        return "aria_hidden"
    return "hidden_but_in_dom" if "hidden" in n.attrs or "display: none" in style or "visibility: hidden" in style else "visible"


class Joined:
    """The shown text of pieces as one string, in which that of any interval of pieces is a slice: what stands between two
    shown characters is the same wherever the interval begins and ends. Ends of lines show, or take no room."""

    def __init__(self, pieces: list, lines: bool):
        out, size, gap = [], 0, ""
        self.begin, self.end, self.gaps = [-1] * len(pieces), [0] * (len(pieces) + 1), [""] * len(pieces)
        for k, p in enumerate(pieces):
            self.end[k] = size
            if not p:
                gap = "\n" if lines else gap
                continue
            p = p if p.isascii() else UNSEEN.sub("", p)
            found = "\n".join(x for x in (" ".join(x.split()) for x in p.split("\n")) if x) if lines else " ".join(p.split())
            gap += p[: len(p) - len(p.lstrip())]
            gap = "\n" if lines and "\n" in gap else " " if gap else ""
            if found:
                self.gaps[k] = gap = gap if size else ""
                out += (gap, found)
                self.begin[k], size = size + len(gap), size + len(gap) + len(found)
                gap = p[len(p.rstrip()) :]
        self.all, self.end[-1] = "".join(out), size
        self.begin.append(size)
        for k in range(len(pieces) - 1, -1, -1):
            if self.begin[k] < 0:
                self.begin[k] = self.begin[k + 1]

    def between(self, first: int, end: int) -> str:
        return self.all[self.begin[first] : self.end[end]]


#: What doesn't count when blocks are compared.
UNLIKE = re.compile("[^a-z0-9$€£]+")


def _like(text: str) -> str:
    return UNLIKE.sub(" ", text.lower())


class Blocks:
    """The blocks of a page: candidates in order, each with what lies in its interval. Nothing is gathered anew for a
    block: texts and their comparable forms are slices, counts are differences of places."""

    def __init__(self, tree: Tree):
        self.tree, nodes = tree, tree.nodes
        kept = [i for i, n in enumerate(nodes) if not n.removed]
        where = lambda test: [i for i in kept if test(nodes[i])]
        self.found = where(_is_block) or [i for i, n in enumerate(nodes) if n.tag == "body"][:1]
        if not self.found:
            return
        self.headings = where(lambda n: n.tag in HEADINGS)
        self.links = where(lambda n: n.tag == "a" and n.attrs.get("href") and not re.match(r"(?i)#|mailto:|tel:|javascript:", n.attrs["href"]))
        self.tables = where(lambda n: n.tag == "table" or n.attrs.get("role") == "table")
        self.rows = where(lambda n: n.tag == "tr" or n.attrs.get("role") == "row")
        self.cells = where(lambda n: n.tag in ("td", "th") or n.attrs.get("role") in ("cell", "columnheader"))
        self.lists = where(lambda n: n.tag in ("ul", "ol"))
        self.lands = [i for i, n in enumerate(nodes) if n.tag in ("section", "article", "main")]
        self.flat, self.lined = Joined(tree.pieces, False), Joined(tree.pieces, True)
        self._compare()
        self._label(where(lambda n: n.tag in ("a", "button") or n.attrs.get("role") == "button" or (n.tag == "input" and n.attrs.get("type") == "submit")))
        self._inside_tables()
        self.steps: dict[int, str] = {}

    def _compare(self) -> None:
        """The comparable form of the page's text, and where that of each piece begins and ends in it."""
        own, pieces, out, size, gap = self.lined, len(self.tree.pieces), [], 0, False
        self.like_begin, self.like_end = [-1] * pieces, [0] * (pieces + 1)
        for k in range(pieces):
            self.like_end[k] = size
            if found := own.between(k, k + 1):
                whole = _like(found)
                core = whole.strip(" ")
                gap = gap or bool(own.gaps[k]) or whole[0] == " "
                if core:
                    between = " " if gap and size else ""
                    out += (between, core)
                    self.like_begin[k], size = size + len(between), size + len(between) + len(core)
                    gap = whole[-1] == " "
        self.like, self.like_end[-1] = "".join(out), size
        self.like_begin.append(size)
        for k in range(pieces - 1, -1, -1):
            if self.like_begin[k] < 0:
                self.like_begin[k] = self.like_begin[k + 1]

    def _label(self, buttons: list[int]) -> None:
        """Buttons with labels, and from each one on the first that differ."""
        labels = []
        for b in buttons:
            node = self.tree.nodes[b]
            if self.flat.end[node.end] - self.flat.begin[node.first] <= 80:
                label = self.text(b) or shown(node.attrs.get("value") or node.attrs.get("aria-label") or "")
                if 2 <= len(label) <= 80:
                    labels.append((b, label))
        self.buttons, self.ahead, ahead = [b for b, _ in labels], [()], ()
        for b, label in reversed(labels):
            ahead = ((b, label), *[x for x in ahead if x[1] != label][: MOST_BUTTONS - 1])
            self.ahead.append(ahead)
        self.ahead.reverse()

    def _inside_tables(self) -> None:
        """The innermost table around each place, and rows by it."""
        around, open_, tables, rows = {}, [], set(self.tables), set(self.rows)
        self.rows_in: dict[int, list[int]] = {}
        for i in sorted({*self.found, *tables, *rows}) if tables else ():
            while open_ and self.tree.nodes[open_[-1]].last < i:
                open_.pop()
            around[i] = open_[-1] if open_ else -1
            if i in rows:
                self.rows_in.setdefault(around[i], []).append(i)
            if i in tables:
                open_.append(i)
        self.around = around

    def first(self, places: list[int], n: Node, i: int) -> int | None:
        k = bisect_right(places, i)
        return places[k] if k < len(places) and places[k] <= n.last else None

    def count(self, places: list[int], n: Node, i: int) -> int:
        return bisect_right(places, n.last) - bisect_right(places, i)

    def text(self, i: int) -> str:
        """Text of an element, without line ends."""
        n = self.tree.nodes[i]
        return self.flat.between(n.first, n.end)

    def key(self, n: Node, heading: str, lines: str) -> str:
        """The comparable form of a block's tag, heading and text."""
        before = _like(shown(f"{n.tag}\n{heading}"))
        if not lines:
            return before
        core = self.like[self.like_begin[n.first] : self.like_end[n.end]]
        return f"{before.rstrip(' ')} {core}" + (" " if core and _like(lines[-1])[-1] == " " else "")

    def button_texts(self, n: Node, i: int) -> list[str]:
        return [label for b, label in self.ahead[bisect_right(self.buttons, i)] if b <= n.last]

    def link_pairs(self, n: Node, i: int) -> list[tuple[str, str]]:
        k = bisect_right(self.links, i)
        own = [a for a in self.links[k : k + MOST_LINKS] if a <= n.last]
        return [(self.tree.nodes[a].attrs["href"], self.text(a) or shown(self.tree.nodes[a].attrs.get("aria-label", ""))) for a in own]

    def table_shape(self, n: Node, i: int) -> tuple[int, int]:
        """Rows and columns of a table; of another block the rows of the tables in it: all but those that the table around
        the block, or none, has itself."""
        if n.tag == "table" or n.attrs.get("role") == "table":
            first = self.first(self.rows, n, i)
            return self.count(self.rows, n, i), self.count(self.cells, self.tree.nodes[first], first) if first is not None else 0
        if not self.tables:
            return 0, 0
        return self.count(self.rows, n, i) - self.count(self.rows_in.get(self.around[i], []), n, i), 0

    def step(self, i: int) -> str:
        if i not in self.steps:
            n = self.tree.nodes[i]
            classes = ".".join(n.attrs.get("class", "").split()[:2])
            self.steps[i] = n.tag + (f"#{n.attrs['id']}" if n.attrs.get("id") else "") + (f".{classes}" if classes else "") + f":nth({n.index + 1})"
        return self.steps[i]

    def path(self, i: int) -> str:
        parts = []
        while i >= 0 and len(parts) < 6:
            parts.insert(0, self.step(i))
            i = self.tree.nodes[i].parent
        return " > ".join(parts)

    def chains(self):
        """Each candidate with the headings of the elements around it that have one, outermost first, each once."""
        nodes, open_, chain, k = self.tree.nodes, [], {}, 0
        for i in self.found:
            while k < len(self.lands) and self.lands[k] < i:
                land, k = self.lands[k], k + 1
                while open_ and open_[-1][0] < land:
                    chain.pop(open_.pop()[1], None)
                heading = nodes[land].heading
                text = self.text(heading) if heading is not None and nodes[land].last >= i else ""
                if text and text not in chain:
                    chain[text] = None
                    open_.append((nodes[land].last, text))
            while open_ and open_[-1][0] < i:
                chain.pop(open_.pop()[1], None)
            yield i, chain

    def rows_of(self):
        """Every block, one by one. Of blocks with the same comparable form the first counts; only digests of those are kept."""
        nodes, seen, open_, place = self.tree.nodes, set(), [], 0
        for raw, (i, chain) in enumerate(self.chains() if self.found else ()):
            n = nodes[i]
            lines, first = self.lined.between(n.first, n.end), self.first(self.headings, n, i)
            heading = self.text(first) if first is not None else ""
            key = self.key(n, heading, lines)
            digest = hashlib.blake2b(key.encode(), digest_size=32).digest()
            if len(key) < 4 or digest in seen:
                continue
            seen.add(digest)
            while open_ and open_[-1][0] < i:
                open_.pop()
            up, links, (rows, columns) = nodes[n.parent] if n.parent >= 0 else None, self.link_pairs(n, i), self.table_shape(n, i)
            items = n if n.tag in ("ul", "ol") else nodes[k] if (k := self.first(self.lists, n, i)) is not None else None
            last = [x for x, _ in zip(reversed(chain), range(MOST_HEADINGS))][::-1]
            if heading and heading not in chain:
                last = [*last, heading][-MOST_HEADINGS:]
            yield dict(
                block_hash=hashlib.sha1(f"{raw}:{key}".encode()).hexdigest()[:12], ord=i, last=n.last, place=place, inside=open_[-1][1] if open_ else None, tag=n.tag, dom_path=self.path(i), classes=" ".join(n.attrs.get("class", "").split()),
                id_attribute=n.attrs.get("id"), aria_label=n.attrs.get("aria-label"), role_attribute=n.attrs.get("role"), visibility=_visibility(n), text=lines, heading=heading or None, heading_chain=last,
                sibling_group=(up.attrs.get("class") or up.tag.upper()) if up else None, sibling_index=n.index, child_count=n.children, link_urls=[u for u, _ in links], link_texts=[t for _, t in links],
                buttons=self.button_texts(n, i), table_rows=rows, table_columns=columns, list_items=items.items if items else 0,
            )
            open_.append((n.last, place))
            place += 1


#: Elements that make up evidence: the innermost of these holds a line; and elements within a line.
EVIDENCE_TAGS = frozenset("section article nav footer header aside table div form dialog tr".split())
INLINE = frozenset("b i em strong span br a small sup".split())


def evidence_of(tree: Tree) -> list[dict]:
    """Sectioning elements that hold text of their own, with heading, lines and buttons."""
    nodes, inside = tree.nodes, {}
    for i, n in enumerate(nodes):
        up = nodes[n.parent] if n.parent >= 0 else None
        n.block = (n.parent if up.tag in EVIDENCE_TAGS else up.block) if up else -1
        #: Whether the element lies in a line already, or in a button.
        n.line = bool(up) and (up.line or up.tag in ("p", "li", "a", "button", *HEADINGS))
        if n.tag in EVIDENCE_TAGS:
            inside[i] = {"heading": None, "lines": [], "buttons": [], "blocks": 0}
            n.line = False
        if n.block < 0:
            continue
        own = inside[n.block]
        own["blocks"] += n.tag in EVIDENCE_TAGS
        text = lambda n=n: squeezed(p for p in tree.pieces[n.first : n.end] if p)
        if n.tag in HEADINGS and own["heading"] is None:
            own["heading"] = text()
        if n.tag in ("a", "button") and (label := text()):
            own["buttons"].append(label)
        if n.tag not in EVIDENCE_TAGS and n.below <= INLINE and not n.line and (line := text()):
            own["lines"].append(line)
            n.line = True
    out = []
    for i, own in inside.items():
        n = nodes[i]
        lines = own["lines"] or ([squeezed(p for p in tree.pieces[n.first : n.end] if p)] if not own["blocks"] else [])
        if lines := [x for x in lines if x]:
            path = n.path if n.tag in PLACES else n.path + n.tag + ">"
            out.append(dict(ord=i, tag=n.tag, path=path[:-1], classes=n.attrs.get("class", ""), heading=own["heading"] or "", lines=lines, buttons=own["buttons"]))
    return out


CARD = re.compile(r"(?i)\b(?:plan|pric|tier|package)")
CARD_TAGS, CARD_LINES = frozenset("article section div li".split()), frozenset("p li span strong button a".split())


def structures_of(tree: Tree) -> list[dict]:
    """Rows of tables, cards (the innermost ones) and what stands under headings, with their cells or lines.

    What stands under a heading reaches to the next heading of the same or a higher level, and not out of the
    element that the heading stands in; headings inside cards and tables have none of their own.
    """
    nodes, rows, cards = tree.nodes, {}, {}
    under: list[dict] = []
    open_: list[dict] = []
    for i, n in enumerate(nodes):
        up = nodes[n.parent] if n.parent >= 0 else None
        n.row, n.card = (up.row, up.card) if up else (None, None)
        while open_ and i > open_[-1]["until"]:
            open_.pop()
        if n.tag == "tr":
            n.row, rows[i] = i, []
        elif n.tag in CARD_TAGS and CARD.search(n.attrs.get("class", "")):
            n.card, cards[i] = i, [None, []]
        text = lambda i=i: squeezed(tree.text.get(i, nodes[i].own))
        if n.tag in ("td", "th") and n.row is not None:
            rows[n.row].append(text())
        elif n.card is not None and n.card != i and n.row is None:
            if n.tag in HEADINGS and cards[n.card][0] is None:
                cards[n.card][0] = text() or None
            elif n.tag in CARD_LINES and (line := text()):
                cards[n.card][1].append(line)
        elif n.row is None and n.card is None:
            if n.tag in HEADINGS:
                while open_ and open_[-1]["level"] >= n.tag:
                    open_.pop()
                open_.append({"ord": i, "level": n.tag, "until": up.last if up else len(nodes), "heading": text(), "cells": []})
                under.append(open_[-1])
            elif n.tag in CARD_LINES and open_ and (line := text()):
                open_[-1]["cells"].append(line)
    out = [dict(source="table", ord=i, cells=cells, heading="") for i, cells in rows.items() if len(cells) > 1]
    out += [dict(source="card", ord=i, cells=lines, heading=heading or "") for i, (heading, lines) in cards.items() if lines]
    return out + [dict(source="heading", ord=h["ord"], cells=h["cells"], heading=h["heading"]) for h in under if h["cells"] and h["heading"]]


def meaningful_of(tree: Tree):
    """Texts that mean something, one by one in document order, and at the end that of the whole body; noise is left out.
    An element that its class or id picks is read whole, others end where further elements of their tag begin."""
    noise, pieces = bytearray(len(tree.nodes)), tree.pieces
    full = [0, *accumulate(bool(p) for p in pieces)]
    shown_ = [p or ("" if p is False else " ") for p in pieces]
    every, at = "".join(shown_), [0, *accumulate(map(len, shown_))]
    spaced = lambda n: every[at[n.first] : at[n.end]]
    for i, n in enumerate(tree.nodes):
        named = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}" if n.attrs else ""
        hidden = bool(n.attrs) and ("hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or n.attrs.get("role") == "dialog")
        noise[i] = (n.parent >= 0 and noise[n.parent]) or n.tag in NOISE or hidden or any(w in named for w in NOISE_WORDS)
        if noise[i]:
            continue
        if n.tag in MEANINGFUL and n.tag in KEPT:
            inner = tree.text.get(i)
            nested = len(inner or ()) != full[n.end] - full[n.first]
            yield dict(ord=i, kind="segment", text="".join(inner or ()) if nested else spaced(n))
        elif n.tag in MEANINGFUL or n.attrs.get("role") == "button" or any(w in named for w in MEANINGFUL_WORDS):
            yield dict(ord=i, kind="segment", text=spaced(n))
    body = next((n for i, n in enumerate(tree.nodes) if n.tag in ("main", "article", "section", "body") and not noise[i]), None)
    if body:
        yield dict(ord=len(tree.nodes), kind="body", text="".join(p for p in pieces[body.first : body.end] if p))


STREAMS = {"blocks": lambda tree: Blocks(tree).rows_of(), "meaningful": meaningful_of}
READERS = {"elements": elements_of, "evidence": evidence_of, "structures": structures_of, "block_places": lambda tree: [b["ord"] for b in Blocks(tree).rows_of()]} | {name: lambda tree, read=read: list(read(tree)) for name, read in STREAMS.items()}


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


#: Pages whose parts are held at once, or rows: so many at most, and so many bytes of markup or text unless one has more; fixed values.
MOST_PAGES, MOST_ROWS, MOST_BYTES = 64, 4096, 1 << 20


def _few(batch: pa.RecordBatch):
    """A batch in slices whose parts fit, however many pages it has and however long they are."""
    first, held = 0, 0
    for i, markup in enumerate(batch.column("_html")):
        more = markup.as_buffer().size if markup.is_valid else 0
        if i > first and (i - first == MOST_PAGES or held + more > MOST_BYTES):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += more
    yield batch.slice(first)


def _weight(row: dict) -> int:
    return sum(len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) else 0 for x in row.values())


def _rows(name: str, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            keep, at, found, held = batch.drop_columns(["_html"]), [], [], 0

            def told():
                own = pa.array(found, kind)
                return pa.RecordBatch.from_arrays([*keep.take(pa.array(at, pa.int32())).columns, *own.flatten()], [*keep.schema.names, *[f.name for f in kind]])

            for i, markup in enumerate(batch.column("_html")):
                for row in STREAMS[name](tree_of(markup.as_py() or "")):
                    if found and (len(found) == MOST_ROWS or held + _weight(row) > MOST_BYTES):
                        yield told()
                        at, found, held = [], [], 0
                    at.append(i)
                    found.append(row)
                    held += _weight(row)
            yield told()

    return run


def rows(pages: DataFrame, name: str, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of one part (one of STREAMS) straight from the parse, all fields or those asked for, with the id and the columns carried along. As
    what is nested is told with each element around it, a page can say far more than it is long: that goes out in batches
    of 4,096 rows or 1 MB (one row if that is longer) and is never held at once."""
    keep = [id_col, *(carry or [])]
    source = pages.select(*keep, F.col(html_col).alias("_html"))
    own = ", ".join(x for x in PARTS[name][7:-1].split(",") if fields is None or x.split(":")[0] in fields)
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(_rows(name, _arrow(f"struct<{own}>")), f"{kept}, {own}")


def _parsed(parts: tuple[str, ...], kinds: list[pa.DataType], tags: frozenset):
    def run(batches):
        for batch in (few for whole in batches for few in _few(whole)):
            keep, columns = [c for c in batch.schema.names if c != "_html"], {p: [] for p in parts}
            for markup in batch.column("_html"):
                tree = tree_of(markup.as_py() or "")
                for p in parts:
                    columns[p].append(elements_of(tree, tags) if p == "elements" else READERS[p](tree))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(columns[p], k) for p, k in zip(parts, kinds)]], [*keep, *parts])

    return run


def parsed(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None, parts: tuple[str, ...] = ("elements", "blocks", "evidence", "structures"), tags=KEPT) -> DataFrame:
    """One row per page with the id, the columns carried along and the parts asked for, each an array of structs:
    the one Python stage of page analysis. Null pages have empty parts; of elements those with one of the tags."""
    keep = [id_col, *(carry or [])]
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_parsed(parts, [_arrow(f"array<{PARTS[p]}>") for p in parts], frozenset(tags)), f"{kept}, " + ", ".join(f"{p} array<{PARTS[p]}>" for p in parts))


def part(pages: DataFrame, name: str) -> DataFrame:
    """The rows of one part, with the columns that were carried along."""
    keep = [c for c in pages.columns if c not in PARTS]
    return pages.select(*keep, F.explode(name).alias("_part")).select(*keep, "_part.*")
