"""Web pages as arrays of nodes in document order.

The only Python here turns a page into a flat array; every rule about cards, titles and links is a
column expression over it. A node knows its position (from 1) and the position of its last
descendant, so a subtree is a slice.
"""

import re
import sys
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import let, strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("pos", "last", "parent")]
    + [
        T.StructField("tag", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
    ]
)
NODE_NAMES = NODE.names
SELECTED = ("pos", "last", "tag", "classes", "attrs", "text")  # what `select`, `below` and `text_of` look at
BATCH_NODES = 20_000  # a batch of rows is handed on when it holds this many
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
# a start tag ends an open one of these, up to the given container
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
BLOCKS = (
    "address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
)
CLOSES.update({tag: ({"p"}, {"div", "article", "section", "li", "dd", "td", "body"}) for tag in BLOCKS.split()})

ATTRIBUTE = r"""[ \n]+([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:="([^"]*)"|='([^']*)')?"""
ATTRIBUTES = re.compile(ATTRIBUTE)
REMEMBERED, SHORT = 4_096, 1_000  # marks that a task remembers, if they are shorter than this
NONE = ((), {})  # classes and attributes of a node without any
PLAIN_MARK = (
    r"<(?:/([a-zA-Z][-a-zA-Z0-9]*)|([a-zA-Z][-a-zA-Z0-9]*)((?:" + re.sub(r"\((?!\?)", "(?:", ATTRIBUTE) + r")*)[ \n]*(/?)"
    r"|!--(?:[^->]|-(?![->]))*--|![dD][oO][cC][tT][yY][pP][eE][^<>\[]*)>"
)
# end tag, or start tag, attributes and slash, or none of them: comment or type of document
MARK = re.compile(PLAIN_MARK)
# a mark with the text behind it, or what is none
MARKS = re.compile("(" + re.sub(r"\((?!\?)", "(?:", PLAIN_MARK) + ")([^<]*)|(<)")
OTHER, END, SINGLE, OPEN = range(4)


class _Page:
    """The nodes of a page, column by column; as a sequence, node by node.

    `marks`: classes and attributes. Plain columns cost a fraction of a list for each node, and no garbage collection.
    """

    def __init__(self):
        self.last, self.parent, self.tag, self.marks, self.text = [], [], [], [], []

    def __len__(self):
        return len(self.tag)

    def __getitem__(self, i):
        """`NODE` as a list."""
        return [i + 1, self.last[i], self.parent[i], self.tag[i], *self.marks[i], self.text[i]]


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.silent = _Page(), [], 0

    def updatepos(self, start, end):
        return end  # lines and columns of tags are not asked for

    def _add(self, tag, marks, text):
        nodes = self.nodes
        nodes.last.append(len(nodes) + 1)
        nodes.parent.append(self.open[-1] if self.open else 0)
        nodes.tag.append(tag)
        nodes.marks.append(marks)
        nodes.text.append(text)

    def _close(self, depth):
        for i in self.open[depth:]:
            self.nodes.last[i - 1] = len(self.nodes)
            self.silent -= self.nodes.tag[i - 1] in SILENT
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            ends, inside = CLOSES[tag]
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.nodes.tag[self.open[depth] - 1]
                if name in ends:
                    self._close(depth)
                    break
                if name in inside:
                    break
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(len(self.nodes))
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        self._add(tag, (attrs.get("class", "").split(), attrs), None)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes.tag[self.open[depth] - 1] == tag:
                self._close(depth)
                break

    def handle_data(self, data):
        if data and not self.silent:
            self._add("#text", NONE, data)


def _mark(mark, known):
    """Kind, tag, classes and attributes, what it closes, and whether its content is raw.

    Never changed, so that nodes may share them. `known` remembers some.
    """
    end, tag, attributes, slash = MARK.fullmatch(mark).groups()
    if tag:
        tag, marks = tag.lower(), NONE
        if attributes:
            attrs = {}
            for name, double, single in ATTRIBUTES.findall(attributes):
                value = double or single
                attrs[name.lower()] = unescape(value) if "&" in value else value
            marks = attrs.get("class", "").split(), attrs
        raw = not slash and tag in HTMLParser.CDATA_CONTENT_ELEMENTS
        found = SINGLE if slash or tag in VOID else OPEN, tag, marks, None if slash else CLOSES.get(tag), raw
    else:
        found = END if end else OTHER, (end or "").lower(), NONE, None, False
    if len(mark) < SHORT:
        if len(known) >= REMEMBERED:
            known.clear()
        known[mark] = found
    return found


def _plain(page, known):
    """`_Flat` for pages of plain marks, several times as fast; None for all others.

    Only marks are taken that HTMLParser reads the same way: quoted attribute values, no script with a `<`.
    """
    start = page.find("<")
    nodes, up, names, silent, raw = _Page(), [], [], 0, None
    last, tags = nodes.last, nodes.tag
    add_last, add_parent, add_tag, add_marks, add_text = (
        c.append for c in (last, nodes.parent, tags, nodes.marks, nodes.text)
    )

    def close(depth):
        nonlocal silent
        end = len(tags)
        for i in up[depth:]:
            last[i - 1] = end
            silent -= tags[i - 1] in SILENT
        del up[depth:], names[depth:]

    before = page if start < 0 else page[:start]
    if before:
        add_last(1), add_parent(0), add_tag("#text"), add_marks(NONE)
        add_text(unescape(before) if "&" in before else before)
    pos = len(tags)
    for mark, text, other in MARKS.findall(page, start) if start >= 0 else ():
        if other:
            return None
        kind, tag, marks, closes, is_raw = known.get(mark) or _mark(mark, known)
        if raw and (kind != END or tag != raw):
            return None
        raw = None
        if kind >= SINGLE:
            if closes:
                ends, inside = closes
                for depth in range(len(names) - 1, -1, -1):
                    if names[depth] in ends:
                        close(depth)
                        break
                    if names[depth] in inside:
                        break
            pos += 1
            add_last(pos), add_parent(up[-1] if up else 0), add_tag(tag), add_text(None), add_marks(marks)
            if kind == OPEN:
                up.append(pos)
                names.append(tag)
                silent += tag in SILENT
            if is_raw:
                raw = tag
        elif kind == END:
            if names and names[-1] == tag:
                names.pop()
                last[up.pop() - 1] = pos
                silent -= tag in SILENT
            elif tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
        if text and not silent:
            pos += 1
            add_last(pos), add_parent(up[-1] if up else 0), add_tag("#text"), add_marks(NONE)
            add_text(unescape(text) if "&" in text else text)
    if raw:
        return None
    close(0)
    return nodes


def _parse(page, known=None):
    nodes = _plain(page or "", {} if known is None else known)
    return _flat(page) if nodes is None else nodes


def _flat(page):
    parser = _Flat()
    parser.feed(page or "")
    parser.close()
    parser._close(0)
    return parser.nodes


def _meeting(nodes, tag=None, cls=None, attr=None, **has):
    """`is_el` for parsed nodes: the places of those that meet it."""
    marks = nodes.marks
    if tag:
        tags = tag.split()
        met = [i for i, t in enumerate(nodes.tag) if t in tags]
    else:
        met = [i for i, t in enumerate(nodes.tag) if t != "#text"]
    if cls:
        met = [i for i in met if cls in marks[i][0]]
    if attr:
        met = [i for i in met if attr in marks[i][1]]
    for name, part in has.items():
        met = [i for i in met if part in marks[i][1].get(name, "")]
    return met


def _on_path(nodes, path):
    """Places of nodes that meet the last step and lie within nodes that meet the ones before, in one pass a step.

    Subtrees nest, so a node lies within an earlier one if the farthest end among these reaches it.
    """
    picked = _meeting(nodes, **path[0])
    for step in path[1:]:
        held, end, holders = [], 0, iter([*picked, len(nodes)])
        h = next(holders)
        for i in _meeting(nodes, **step):
            while h < i:
                end, h = max(end, nodes.last[h]), next(holders)
            if i < end:
                held.append(i)
        picked = held
    return picked


def _holders(nodes, i):
    """Places of a node's holders, nearest first, by the way up."""
    while i := nodes.parent[i]:
        i -= 1
        yield i


def _below(nodes, i):
    return range(0) if i is None else range(i + 1, nodes.last[i])


class _Runs:
    """Runs of nodes on their way into an Arrow array of arrays, with some of the fields of `NODE`."""

    def __init__(self, fields=NODE_NAMES):
        self.fields, self.nodes, self.pos, self.ends = fields, _Page(), [], [0]
        asked = {"marks" if f in ("classes", "attrs") else f for f in fields} - {"pos"}
        self.held = [(name, getattr(self.nodes, name)) for name in sorted(asked)]

    def add(self, page, places):
        """`places`: a range or list of places in the page, or the page itself for all."""
        if places is page:
            places = range(len(page))
        whole = isinstance(places, range)
        for name, held in self.held:
            of = getattr(page, name)
            held.extend(of[places.start : places.stop] if whole else [of[i] for i in places])
        self.pos.extend(range(places.start + 1, places.stop + 1) if whole else [i + 1 for i in places])
        self.ends.append(len(self.pos))

    def array(self):
        nodes = self.nodes
        marked = [(i, m) for i, m in enumerate(nodes.marks) if m is not NONE]

        def ends(which):
            counts = np.zeros(len(self.pos) + 1, "int32")
            counts[[i + 1 for i, _ in marked]] = [len(m[which]) for _, m in marked]
            return pa.array(np.cumsum(counts, dtype="int32"))

        flat = lambda lists: pa.array(list(chain.from_iterable(lists)), pa.string())
        made = {
            "pos": lambda: pa.array(self.pos, pa.int32()),
            "last": lambda: pa.array(nodes.last, pa.int32()),
            "parent": lambda: pa.array(nodes.parent, pa.int32()),
            "tag": lambda: pa.array(nodes.tag, pa.string()),
            "classes": lambda: pa.ListArray.from_arrays(ends(0), flat(m[0] for _, m in marked)),
            "attrs": lambda: pa.MapArray.from_arrays(ends(1), flat(m[1] for _, m in marked), flat(m[1].values() for _, m in marked)),
            "text": lambda: pa.array(nodes.text, pa.string()),
        }
        columns = pa.StructArray.from_arrays([made[f]() for f in self.fields], self.fields)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), columns)


def _rows(pages: DataFrame, html: str, names, runs_of, fields=None) -> DataFrame:
    """Rows made from pages: `runs_of(nodes of a page)` yields a run of their places for each name, as often as it likes.

    Pages are parsed one by one and rows handed on as soon as they hold `BATCH_NODES`, so a worker keeps one page
    and one batch, whatever the number and the size of the pages. No shuffle. `fields` of a name are those of `NODE` that its
    nodes have, in their order; all, unless given.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    fields = {n: [f for f in NODE_NAMES if fields is None or f in fields[n]] for n in names}
    of = {n: T.StructType([NODE[f] for f in fields[n]]) for n in names}
    schema = T.StructType(kept + [T.StructField(n, T.ArrayType(of[n])) for n in names])

    kept = [f.name for f in kept]
    return pages.mapInArrow(lambda batches: _parse_batches(batches, html, kept, names, runs_of, fields), schema)


def _parse_batches(batches, html, kept, names, runs_of, fields=None):
    def fresh():
        return [_Runs(fields[n]) if fields else _Runs() for n in names]

    def made(batch, origins, runs):
        rest = batch.select(kept).take(pa.array(origins, pa.int64())).columns if kept else []
        return pa.RecordBatch.from_arrays([*rest, *[r.array() for r in runs]], [*kept, *names])

    known = {}
    for batch in batches:
        pages, origins, runs, held = batch.column(html), [], fresh(), 0
        for i in range(batch.num_rows):
            page = _parse(pages[i].as_py(), known)
            for row in runs_of(page):
                origins.append(i)
                for r, places in zip(runs, row):
                    r.add(page, places)
                    held += len(places)
                if held >= BATCH_NODES:
                    yield made(batch, origins, runs)
                    origins, runs, held = [], fresh(), 0
        if origins:
            yield made(batch, origins, runs)


def with_nodes(pages: DataFrame, html="html") -> DataFrame:
    """Replaces the page text by `nodes`, the whole page."""
    return _rows(pages, html, ["nodes"], lambda nodes: [(nodes,)])


def cards(pages: DataFrame, *path, html="html", item: str | None = None, around=True, fields=None) -> DataFrame:
    """One row per node on the path: `card`; `sub`, the nodes below it; `around`, if asked for, its holders, nearest first.

    With `item`, also `within`: the nodes below the nearest holder of that tag. Nothing else of a page leaves its parser.
    `fields` names what is asked for, as every node costs time on its way: for each column the fields of its nodes; a column that
    is not in it is left out. All by default.
    """
    names = ["card", "sub"] + (["around"] if around else []) + (["within"] if item else [])
    names = [n for n in names if fields is None or n in fields]

    def runs(nodes):
        for card in _on_path(nodes, path):
            own = []
            if "card" in names:
                own.append(range(card, card + 1))
            if "sub" in names:
                own.append(_below(nodes, card))
            if "around" in names:
                own.append(list(_holders(nodes, card)))
            if "within" in names:
                own.append(_below(nodes, next((h for h in _holders(nodes, card) if nodes.tag[h] == item), None)))
            yield own

    rows = _rows(pages, html, names, runs, fields)
    return rows.withColumn("card", first(F.col("card"))) if "card" in names else rows


def once(df: DataFrame, **columns) -> DataFrame:
    """`df` with columns that are computed once a row: behind a generator, a filter on them does not compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ---------------------------------------------------------------- selecting


def is_el(node, tag=None, cls=None, attr=None, **has) -> Column:
    """Test for an element: tag (or several), class, attribute present or containing a text."""
    tests = [node["tag"].isin(tag.split()) if tag else node["tag"] != "#text"]
    if cls:
        tests.append(F.array_contains(node["classes"], cls))
    if attr:
        tests.append(F.map_contains_key(node["attrs"], attr))
    for name, part in has.items():
        tests.append(F.coalesce(attr_of(node, name).contains(part), F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def attr_of(node, name) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def select(nodes, *path, **last) -> Column:
    """Nodes that meet the last test of the path and lie within nodes that meet the ones before.

    Each step is a dict for `is_el`; keywords stand for one single step.
    """
    steps = list(path) or [last]
    picked = _pick(nodes, steps[0])
    for step in steps[1:]:
        picked = _pick_within(nodes, picked, step)
    return picked


def _pick(nodes, step) -> Column:
    return F.filter(nodes, lambda n: is_el(n, **step))


def _pick_within(nodes, holders, step) -> Column:
    def held(n, hs):
        return F.exists(hs, lambda h: (h["pos"] < n["pos"]) & (h["last"] >= n["pos"]))

    return let(
        F.struct(holders.alias("h"), nodes.alias("n")),
        lambda v: F.filter(v["n"], lambda n: is_el(n, **step) & held(n, v["h"])),
    )


def first(nodes) -> Column:
    return F.get(nodes, F.lit(0))


def texts(nodes) -> Column:
    """Stripped text pieces, empty ones left out."""
    pieces = F.transform(F.filter(nodes, lambda n: n["tag"] == "#text"), lambda n: strip(n["text"]))
    return F.filter(pieces, lambda t: t != "")


def segments(nodes) -> Column:
    """Text pieces, also split at vertical bars."""
    pieces = F.filter(nodes, lambda n: n["tag"] == "#text")
    parts = F.flatten(F.transform(pieces, lambda n: F.split(n["text"], r"\|")))
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def below(nodes, node) -> Column:
    """Descendants of a node. `nodes` is a whole page or any slice of it, so they are a slice too."""

    def of(e):
        start = e["pos"] - first(nodes)["pos"] + 2
        return F.slice(nodes, start, e["last"] - e["pos"])

    return let(node, of)


def text_of(nodes, node) -> Column:
    """All text of a node run together; null if there is no node."""
    return F.array_join(texts(below(nodes, node)), "")


def texts_of(nodes, picked) -> Column:
    return let(
        F.struct(picked.alias("p"), nodes.alias("n")),
        lambda v: F.transform(v["p"], lambda e: text_of(v["n"], e)),
    )


def raw_length(nodes, node) -> Column:
    """Characters of a node's text, surrounding space included."""
    pieces = F.filter(below(nodes, node), lambda n: n["tag"] == "#text")
    return F.aggregate(pieces, F.lit(0), lambda a, n: a + F.length(n["text"]))


def holders(nodes, node, most: int) -> Column:
    """The nearest `most` holders of a node, nearest first, by the way up. `nodes` is a whole page."""

    def up(found, _):
        above = F.get(nodes, F.element_at(found, -1)["parent"] - 1)
        return F.when(above.isNull(), found).otherwise(F.concat(found, F.array(above)))

    way = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(F.get(nodes, node["pos"] - 1)), up)
    return F.slice(way, F.lit(2), F.lit(most))
