"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree of its block elements; items of one kind below a parent share a node, as
a wrapper holds a list once. The trees of a host are aligned by simple tree matching and laid over one
another: the host's wrapper. A node whose text is the same on all different pages is template, the
others are slots. Slots whose place in the wrapper is that of a menu, a header, a footer, a sidebar, a
notice, an advert, a form or of reader comments are left out; the rest is content.

Only different trees are aligned, each with the numbers of all its pages: Spark counts these before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.storage import stored

#: Elements deeper than this hang on their ancestor of this depth.
DEPTH = 100
#: Containers of one kind below a parent that keep a node of their own; further ones share the last.
RUN = 8
#: Different pages that must hold the same text in a node before it is template, outside and inside of an article.
PAGES = 3
PAGES_INSIDE = 8
#: Different trees of a host that one task lays over one another in a round.
FAN_IN = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
_SILENT = frozenset("script style title textarea".split())
_ITEMS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption".split())
#: An item ends where another one of these begins, up to the nearest of the containers.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_NOISE_TAGS = frozenset(
    "nav footer aside form dialog menu noscript template iframe object svg canvas select button option datalist".split()
)
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe signup comment comments reply replies discussion sidebar "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer masthead share sharing social "
    "related recommended widget toolbar login search complementary contentinfo".split()
)
_READERS = frozenset("comment comments reply replies teaser related ad ads promo sponsored".split())
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url: str | None) -> str:
    """Host of an address in lower case, without user and port; empty if there is none."""
    found = _HOST.match(url.strip()) if url else None
    return found.group(1).rsplit("@", 1)[-1].split(":")[0].lower() if found else ""


class _Page(HTMLParser):
    """Blocks of a page and the tree they hang on. Node 0 is the root; a key is ``tag name words``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.key = [-1], [""]
        self.below: list[dict[str, list[int]]] = [{}]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.silent = ""
        self.pending: list[str] = []
        self.link_at, self.linked = 0, 0
        self.blocks: list[tuple[int, str, int]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.pending).split())
        if text:
            self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
        self.pending, self.linked = [], 0

    def _node(self, parent: int, tag: str, key: str) -> int:
        known = self.below[parent].setdefault(key, [])
        if len(known) >= (1 if tag in _ITEMS or self.key[parent].split(" ")[0] in _ITEMS else RUN):
            return known[-1]
        known.append(len(self.key))
        self.parent.append(parent)
        self.key.append(key)
        self.below.append({})
        return known[-1]

    def _close(self, at: int) -> None:
        self.flush()
        del self.stack[at:]
        if self.link_at > len(self.stack):
            self.link_at = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            return
        if tag in _VOID:
            if tag == "br" or tag == "hr":
                self.pending.append(" ")
            return
        if tag in _SILENT:
            self.silent = tag
            return
        if tag == "a":
            self.link_at = len(self.stack)
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        words = _WORD.findall(_CAMEL.sub(" ", named).lower()) if named else []
        if tag in _INLINE and not _NOISE_WORDS.intersection(words):
            return
        if tag not in _INLINE:
            ends, within = _ENDS.get(tag, (("p",), ()))
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] in ends:
                    self._close(at)
                elif self.stack[at][0] in within or (tag not in _ENDS and self.stack[at][0] not in _INLINE):
                    break
        self.flush()
        node = self.stack[-1][1]
        if len(self.stack) < DEPTH:
            node = self._node(node, tag, " ".join([tag, *sorted(set(words))]))
        self.stack.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.silent = ""
            return
        if tag == "br":
            self.pending.append(" ")
        if tag == "a":
            self.link_at = 0
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                break
            if tag in _INLINE and self.stack[at][0] not in _INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pending.append(data)
            if self.link_at:
                self.linked += len(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return page


@dataclass
class Tree:
    """A page's tree, or several laid over one another. Of each node: how many different pages have text in
    it, least and greatest hash of that text, its characters and those in links."""

    parent: list[int]
    key: list[str]
    pages: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def children(self) -> list[list[int]]:
        """Node numbers below each node, in page order."""
        below: list[list[int]] = [[] for _ in self.key]
        for node in range(1, len(self.key)):
            below[self.parent[node]].append(node)
        return below


def shape_of(parent: list[int], key: list[str]) -> str:
    return "\n".join(f"{p} {k}" for p, k in zip(parent, key, strict=True))


def tree_of(shape: str) -> Tree:
    lines = [line.split(" ", 1) for line in shape.split("\n")]
    return Tree([int(p) for p, _ in lines], [k for _, k in lines])


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: node of ``b`` -> node of ``a``, as many pairs as possible with equal keys, equal
    order of siblings and matched parents; the first such pairs on a tie."""
    below_a, below_b = a.children(), b.children()
    known: dict[tuple[int, int], list[list[int]]] = {}

    def table(i: int, j: int) -> list[list[int]]:
        """Most pairs below ``i`` and ``j``, by how many children of each take part."""
        if (i, j) not in known:
            rows = [[0] * (len(below_b[j]) + 1)]
            for x in below_a[i]:
                last, row = rows[-1], [0]
                for k, y in enumerate(below_b[j]):
                    pair = last[k] + 1 + table(x, y)[-1][-1] if a.key[x] == b.key[y] else 0
                    row.append(max(last[k + 1], row[k], pair))
                rows.append(row)
            known[i, j] = rows
        return known[i, j]

    pairs, todo = {0: 0}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        rows, p, q = table(i, j), len(below_a[i]), len(below_b[j])
        while p and q:
            if rows[p][q] == rows[p - 1][q]:
                p -= 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                pairs[below_b[j][q]] = below_a[i][p]
                todo.append((below_a[i][p], below_b[j][q]))
    return pairs


def overlay(a: Tree, b: Tree) -> Tree:
    """``b`` laid over ``a``: matched nodes add up, the others come in behind their matched neighbours."""
    pairs, below = match(a, b), b.children()
    order: list[list[tuple[str, int]]] = [[("a", x) for x in row] for row in a.children()]
    for j, i in pairs.items():
        at = 0
        for y in below[j]:
            if y in pairs:
                at = order[i].index(("a", pairs[y])) + 1
            else:
                order[i].insert(at, ("b", y))
                at += 1
    back = {i: j for j, i in pairs.items()}
    out = Tree([], [])

    def add(tree: str, node: int, parent: int) -> int:
        own, other = (a, b) if tree == "a" else (b, a)
        twin = back.get(node) if tree == "a" else None
        out.parent.append(parent)
        out.key.append(own.key[node])
        pages, least, most = own.pages[node], own.least[node], own.most[node]
        if twin is not None and other.pages[twin]:
            least = min(least, other.least[twin]) if pages else other.least[twin]
            most = max(most, other.most[twin]) if pages else other.most[twin]
        out.pages.append(pages + (other.pages[twin] if twin is not None else 0))
        out.least.append(least)
        out.most.append(most)
        out.chars.append(own.chars[node] + (other.chars[twin] if twin is not None else 0))
        out.linked.append(own.linked[node] + (other.linked[twin] if twin is not None else 0))
        return len(out.key) - 1

    todo = [("a", 0, -1)]
    while todo:
        tree, node, parent = todo.pop()
        at = add(tree, node, parent)
        for kind, x in reversed(order[node] if tree == "a" else [("b", y) for y in below[node]]):
            todo.append((kind, x, at))
    return out


def places(parent: list[int], key: list[str]) -> tuple[list[bool], list[bool]]:
    """Per node: is it in a place that holds no article text, is it inside an article."""
    noise, inside = [False], [False]
    for node in range(1, len(key)):
        tag, *words = key[node].split(" ")
        landmark = tag in ("article", "main") or (tag not in ("html", "body") and "main" in words)
        if tag in ("html", "body", "main"):
            named = False
        elif tag == "article":
            named = not _READERS.isdisjoint(words)
        else:
            named = not _NOISE_WORDS.isdisjoint(words) or ("header" in words or tag == "header") and not inside[parent[node]]
        noise.append(noise[parent[node]] or named or tag in _NOISE_TAGS)
        inside.append(inside[parent[node]] or (landmark and not noise[node]))
    return noise, inside


def content(wrapper: Tree, page: Tree) -> list[bool]:
    """Which nodes of a page's tree are content, by the wrapper of its host."""
    pairs = match(wrapper, page)
    noise, inside = places(page.parent, page.key)
    template, links, used = [], [], []
    for node in range(len(page.key)):
        w = pairs.get(node)
        seen = wrapper.pages[w] if w is not None else 0
        template.append(seen >= (PAGES_INSIDE if inside[node] else PAGES) and wrapper.least[w] == wrapper.most[w])
        links.append(w is not None and 2 * wrapper.linked[w] > wrapper.chars[w])
        used.append(page.pages[node] > 0 and not noise[node])
    if any(u and i for u, i in zip(used, inside, strict=True)):
        if all(t for t, u, i in zip(template, used, inside, strict=True) if u and i):
            template = [False] * len(template)
        title = [k.split(" ")[0] == "h1" for k in page.key]
        return [not n and not t and (i or h) for n, t, i, h in zip(noise, template, inside, title, strict=True)]
    return [not n and not t and not x for n, t, x in zip(noise, template, links, strict=True)]


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: host, tree, hash of what may be content, and of each node hash, characters, characters in
    links; blocks of places that may hold content, in page order."""
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("host", T.StringType()),
            T.StructField("shape", T.StringType()),
            T.StructField("variant", T.LongType()),
            T.StructField("hashes", _LONGS),
            T.StructField("chars", _INTS),
            T.StructField("linked", _INTS),
            T.StructField("slots", _INTS),
            T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.string())]

    def one(url: str | None, html: str | None) -> tuple:
        page = parse(html)
        noise, _ = places(page.parent, page.key)
        kept = [b for b in page.blocks if not noise[b[0]]]
        own: dict[int, list[str]] = {}
        chars, linked = [0] * len(page.key), [0] * len(page.key)
        for node, text, links in kept:
            own.setdefault(node, []).append(text)
            chars[node] += len(text)
            linked[node] += links
        hashes = [_hash(*own[n]) | 1 if n in own else 0 for n in range(len(page.key))]
        shape = shape_of(page.parent, page.key)
        variant = _hash(shape, *map(str, hashes))
        return host_of(url), shape, variant, hashes, chars, linked, [b[0] for b in kept], [b[1] for b in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(u, h) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, schema)


_STATS = "array<struct<node:int,pages:bigint,least:bigint,most:bigint,chars:bigint,linked:bigint>>"
_TREE = f"host string, shape string, stats {_STATS}"


def _trees(parsed: DataFrame) -> DataFrame:
    """One row per host and tree: what all its different pages have in each node. Pages that differ in no
    place of content count once, so copies are no evidence of a template."""
    variants = parsed.groupBy("host", "shape", "variant").agg(F.min(F.struct("hashes", "chars", "linked")).alias("v"))
    nodes = variants.selectExpr("host", "shape", "posexplode(arrays_zip(v.hashes, v.chars, v.linked)) AS (node, x)")
    stats = nodes.groupBy("host", "shape", "node").agg(
        F.expr("count_if(x.hashes <> 0) AS pages"),
        F.expr("coalesce(min(x.hashes) FILTER (WHERE x.hashes <> 0), 0L) AS least"),
        F.expr("coalesce(max(x.hashes) FILTER (WHERE x.hashes <> 0), 0L) AS most"),
        F.expr("sum(x.chars) AS chars"),
        F.expr("sum(x.linked) AS linked"),
    )
    return stats.groupBy("host", "shape").agg(F.expr(f"cast(array_sort(collect_list(struct(node, pages, least, most, chars, linked))) AS {_STATS}) AS stats"))


def _loaded(shape: str, stats: list) -> Tree:
    tree = tree_of(shape)
    for s in stats:
        tree.pages.append(int(s["pages"]))
        tree.least.append(int(s["least"]))
        tree.most.append(int(s["most"]))
        tree.chars.append(int(s["chars"]))
        tree.linked.append(int(s["linked"]))
    return tree


def _row(host: str, tree: Tree) -> dict:
    stats = zip(tree.pages, tree.least, tree.most, tree.chars, tree.linked, strict=True)
    return {
        "host": host,
        "shape": shape_of(tree.parent, tree.key),
        "stats": [dict(node=k, pages=p, least=a, most=b, chars=c, linked=x) for k, (p, a, b, c, x) in enumerate(stats)],
    }


def _lay(frame: pd.DataFrame) -> pd.DataFrame:
    """The trees of a group laid over one another, those of most pages first."""
    trees = [_loaded(s, x) for s, x in zip(frame["shape"], frame["stats"], strict=True)]
    order = sorted(range(len(trees)), key=lambda k: (-max(trees[k].pages), frame["shape"].iloc[k]))
    total = trees[order[0]]
    for k in order[1:]:
        total = overlay(total, trees[k])
    return pd.DataFrame([_row(frame["host"].iloc[0], total)])


def wrappers(trees: DataFrame, *, fan_in: int = FAN_IN) -> DataFrame:
    """One tree per host. A host with many different trees lays them over one another in rounds, at most
    about ``fan_in`` of them in a task."""
    while True:
        most = trees.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if most <= 1:
            return trees
        groups = trees
        if most > fan_in:
            sizes = trees.groupBy("host").agg(F.expr(f"ceil(2 * count(*) / {fan_in}) AS _parts"))
            groups = trees.join(sizes, "host").withColumn("_part", F.expr("pmod(xxhash64(shape), _parts)")).drop("_parts")
        else:
            groups = trees.withColumn("_part", F.lit(0))
        trees = stored(groups.groupBy("host", "_part").applyInPandas(lambda f: _lay(f), _TREE), "wrappers")


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars, host.

    White space inside a block is one space, blocks are joined by one space in page order. Where a page
    has an ``article`` or ``main`` with text, its slots and a varying ``h1`` are the content; else all slots
    that are not mostly links. A node is template if its text is the same on ``PAGES`` pages of the host that
    differ elsewhere (``PAGES_INSIDE`` inside an article), and on all others that have it.

    Null and empty html, and pages of nothing but template, give an empty text. A null url, or one without
    host, belongs to the host ''. Null and repeated ids are kept, repeated pages are extracted one by one;
    other columns are not read. Elements below ``DEPTH`` levels keep their text.
    """
    parsed = stored(_parsed(pages, id_col, url_col, html_col), "parsed")
    trees = stored(_trees(parsed), "trees")
    found = wrappers(trees, fan_in=fan_in)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [
                content(_loaded(r.wrapper, r.whole), _loaded(r.shape, r.stats)) for r in frame.itertuples(index=False)
            ]
            yield pd.DataFrame({"host": frame["host"], "shape": frame["shape"], "keep": keep})

    both = trees.join(found.select("host", F.col("shape").alias("wrapper"), F.col("stats").alias("whole")), "host")
    verdicts = stored(both.mapInPandas(judge, "host string, shape string, keep array<boolean>"), "verdicts")
    text = "array_join(transform(filter(arrays_zip(slots, texts), b -> keep[b.slots]), b -> b.texts), ' ')"
    rows = parsed.select(id_col, "url", "host", "shape", "slots", "texts").join(verdicts, ["host", "shape"], "left")
    rows = rows.select(id_col, "url", F.expr(f"coalesce({text}, '') AS text"), "host")
    return rows.select(id_col, "url", "text", F.length("text").cast("long").alias("n_chars"), "host")
