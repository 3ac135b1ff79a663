"""Main text of web pages by wrapper induction over the pages of a host.

A few pages of each host (at most SLOTS, those with the smallest hashes) are parsed and aligned by simple tree matching. Nodes of the aligned tree that
have the same text on all pages are template; those that vary are slots. The wrapper of the host is the path
to the region that holds the varying prose, the nodes that their marks would skip but that hold varying prose (they are opened), and the constant
subtrees inside the region. Those are candidates only: all pages of the host are counted, and a subtree that a share of them (CONSTANT_SHARE) has at
its place is template. The wrapper is applied to every page of the host, in whole.

Adverts, comments, related links and the like vary too, so what has such a mark stays out as long as there is prose elsewhere.
Constant prose stays where the aligned pages are near copies of each other (less than half of their region's text varies) or fewer than three.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, cut, fresh, quoted, small_batches
from .dom import BLOCK, RAW, Node, parse

SLOTS = 8
WIDE = 1 << 16  # pairs of children; wider lists are aligned in one pass in their order
CONSTANT_SHARE = 0.9  # of all pages of the host
BROADCAST_BYTES = 32 << 20
SKIPPED_TAGS = RAW | frozenset("head nav footer aside form button select datalist menu dialog canvas audio video picture map".split())
#: Names of parts that vary from page to page and are no article.
OTHER_MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising comment comments complementary contentinfo disqus footer promo promotion reactions related replies sidebar sponsor sponsored".split()
)
#: Names of parts that are the same on all pages, as a rule.
LAYOUT_MARKS = frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies masthead menu modal nav navbar navigation newsletter notice notices pagination popup search share sharing signup social subscribe toolbar topbar widget widgets".split()
)
SKIPPED_MARKS = OTHER_MARKS | LAYOUT_MARKS
OPENED_WORDS, FEW_WORDS = 25, 15  # varying words a page that make a marked part prose; that are no article
#: A name with one of these pieces tells of a part, or that there is none, and is no part itself.
QUALIFIERS = frozenset("has have with without no not is enabled disabled".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption".split())


@lru_cache(maxsize=1 << 14)
def marked(marks: str, among: frozenset = SKIPPED_MARKS) -> bool:
    """Whether a whole name, or its first or last piece, is one of these marks, and no piece is a qualifier."""
    for name in marks.split():
        pieces = [x for x in re.split(r"[^a-z]+", name) if x]
        if pieces and (pieces[0] in among or pieces[-1] in among) and QUALIFIERS.isdisjoint(pieces):
            return True
    return False


def barred(node, inside: bool) -> bool:
    """Whether a node is no part of an article by its tag. A header inside the article holds its title."""
    return node.tag in SKIPPED_TAGS or node.tag == "header" and not inside


def suspect(node) -> bool:
    """Whether the node's marks tell of no article."""
    return bool(node.marks) and node.tag not in ("html", "body", "main", "article") and marked(node.marks)


def skipped(node: Node, inside: bool, by_marks: bool = True, opened: frozenset = frozenset()) -> bool:
    return barred(node, inside) or by_marks and suspect(node) and node.label not in opened


def own_text(node: Node) -> str:
    return " ".join(" ".join(x for x in node.children if isinstance(x, str)).split())


class Aligned:
    """A template node: its label, the hashes of the texts seen at it, on how many pages, and its children."""

    def __init__(self, node: Node, inside: bool = False):
        self.label, self.tag, self.marks, self.pages = node.label, node.tag, node.marks, 0
        self.barred, self.suspect = barred(node, inside), suspect(node)
        self.texts: set[str] = set()
        self.length = self.words = 0
        self.see(node)
        inside = inside or node.tag in ("article", "main")
        self.children = [] if self.barred else [Aligned(c, inside) for c in node.children if isinstance(c, Node)]

    def see(self, node: Node) -> None:
        self.first = text = own_text(node)
        self.texts.add(told(text))
        self.pages += 1
        self.length += len(text)
        self.words += len(text.split())


def in_order(left: list, right: list):
    """Pairs (i, j) of equal labels, each the next ones on both sides: one pass, for lists that are too wide for all pairs."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(right):
        places.setdefault(y.label, []).append(j)
    used = dict.fromkeys(places, 0)
    at = 0
    for i, x in enumerate(left):
        mine = places.get(x.label, ())
        k = used.get(x.label, 0)
        while k < len(mine) and mine[k] < at:
            k += 1
        # a partner far behind would cost all between
        if k < len(mine) and mine[k] - at <= max(8, len(left) - i):
            yield i, mine[k]
            at, k = mine[k] + 1, k + 1
        if mine:
            used[x.label] = k


def match(a, b, memo: dict) -> int:
    """Simple tree matching: the size of the largest common top-down ordered subtree of two trees with equal root labels."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    right = [c for c in b.children if not isinstance(c, str)]
    if len(a.children) * len(right) > WIDE:
        memo[key] = 1 + sum(match(a.children[i], right[j], memo) for i, j in in_order(a.children, right))
        return memo[key]
    row = [0] * (len(right) + 1)
    for x in a.children:
        new = [0]
        for j, y in enumerate(right):
            new.append(max(new[-1], row[j + 1], row[j] + (match(x, y, memo) if x.label == y.label else 0)))
        row = new
    memo[key] = 1 + row[-1]
    return memo[key]


def partners(left: list, right: list, memo: dict) -> list[tuple[int, int]]:
    """The pairs of children in a largest matching, where a pair with the same text counts one more: so constant nodes meet among slots of the same label."""
    n, m = len(left), len(right)
    texts = [told(own_text(y)) for y in right]
    if n * m > WIDE:
        k = 0  # the same nodes at the end
        while k < min(n, m) and left[n - 1 - k].label == right[m - 1 - k].label and texts[m - 1 - k] in left[n - 1 - k].texts:
            k += 1
        return [*in_order(left[: n - k], right[: m - k]), *((n - k + i, m - k + i) for i in range(k))]

    def weight(i: int, j: int) -> int:
        s = match(left[i], right[j], memo)
        return s + (texts[j] in left[i].texts) if s else 0

    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            s = weight(i, j)
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + s if s else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        s = weight(i, j)
        if s and best[i][j] == best[i + 1][j + 1] + s:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def align(t: Aligned, page: Node, memo: dict) -> None:
    """Join a page's tree to the template: matched nodes gain its texts, others become nodes of their own in place."""
    t.see(page)
    if t.barred:
        return
    right = [c for c in page.children if isinstance(c, Node)]
    inside = t.tag in ("article", "main")
    out, i, j = [], 0, 0
    for a, b in [*partners(t.children, right, memo), (len(t.children), len(right))]:
        out += t.children[i:a]
        out += [Aligned(c, inside) for c in right[j:b]]
        if a < len(t.children):
            align(t.children[a], right[b], memo)
            out.append(t.children[a])
        i, j = a + 1, b + 1
    t.children = out


def subtree(node, text: str, inner, opened: frozenset) -> str:
    """A hash of all that stands in a node, skipped parts apart; empty for one without text."""
    parts = [h for c in inner if not (c.tag in SKIPPED_TAGS or suspect(c) and c.label not in opened) and (h := subtree_of(c, opened))]
    return told("\x1f".join([text, *parts])) if text or parts else ""


def subtree_of(node, opened: frozenset) -> str:
    if isinstance(node, Aligned):
        return subtree(node, node.first, node.children, opened)
    return subtree(node, own_text(node), [c for c in node.children if isinstance(c, Node)], opened)


def induce(pages: list[str]) -> dict:
    """The wrapper of these pages: the region's path ([] if none stands out), the labels of nodes that are opened despite their marks, constant subtrees inside
    the region (place, hash), and hashes of the texts beside the path."""
    root, total = None, 0
    for p in dict.fromkeys(pages):
        tree = parse(p)
        if root is None:
            root = Aligned(tree)
        else:
            align(root, tree, {})
        total += 1
    if root is None:
        return {"region": [], "opened": [], "constant": [], "beside": []}

    def varies(t: Aligned) -> bool:
        """Slots are nodes that vary or that not all pages have; with one page, all nodes."""
        return total == 1 or len(t.texts) > 1 or t.pages < total

    def prose(t: Aligned, top: bool = True) -> tuple[int, int]:
        """Words of slots outside links, and of links, without marked parts."""
        if t.barred or t.suspect and not top and t.label not in opened:
            return 0, 0
        words = t.words if varies(t) else 0
        inner = [prose(c, False) for c in t.children]
        links = sum(x[1] for x in inner) + (words if t.tag == "a" else 0)
        return sum(x[0] for x in inner) + (words if t.tag != "a" else 0), links

    def suspects(t: Aligned):
        for c in t.children:
            if not c.barred:
                if c.suspect:
                    yield c
                yield from suspects(c)

    opened: frozenset = frozenset()
    if total > 1:
        found = [(c, marked(c.marks, OTHER_MARKS), *prose(c)) for c in suspects(root)]
        found = [x for x in found if x[2] >= OPENED_WORDS * total and x[2] > x[3]]
        opened = frozenset(c.label for c, other, _, _ in found if not other)
        outside = prose(root)[0]
        if outside < FEW_WORDS * total:
            opened |= {c.label for c, other, words, _ in found if other and words > 10 * outside}

    def skip(t: Aligned) -> bool:
        return t.barred or t.suspect and t.label not in opened

    masses: dict[int, int] = {}

    def mass(t: Aligned) -> int:
        """Text of slots outside links."""
        if id(t) not in masses:
            masses[id(t)] = 0 if skip(t) else (t.length if varies(t) and t.tag != "a" else 0) + sum(map(mass, t.children))
        return masses[id(t)]

    path, t = [], root
    while True:
        whole = mass(t)
        inner = max((c for c in t.children if c.tag in BLOCK and c.tag not in PROSE and not skip(c)), key=mass, default=None)
        # where anything varies beside the child, be it a title, the region is the node that holds both
        if inner is None or not whole or mass(inner) < whole or sum(c.label == inner.label for c in t.children) > 1:
            break
        path.append(inner.label)
        t = inner
        if t.tag in ("article", "main") and not any(c.tag == "article" for c in t.children):
            break

    def length(x: Aligned) -> int:
        return 0 if skip(x) else x.length + sum(map(length, x.children))

    firm = total >= 3 and 2 * mass(t) >= length(t)
    same: dict[int, bool] = {}

    def fixed(x: Aligned) -> bool:
        if id(x) not in same:
            same[id(x)] = x.pages == total and len(x.texts) == 1 and all(skip(c) or fixed(c) for c in x.children)
        return same[id(x)]

    constant = []

    def labels(x: Aligned, at: list[str], prose: bool) -> None:
        for c in x.children:
            if skip(c):
                continue
            inside = prose or c.tag in PROSE
            if fixed(c):
                brief = not inside and len(c.first.split()) <= 8 and not c.children and c.first[-1:] not in tuple(".!?…\"'»”")
                if (firm or brief) and (key := subtree_of(c, opened)):
                    constant.append(["/".join([*at, c.label]), key])
            else:
                labels(c, [*at, c.label], inside)

    if total > 1 and mass(t):
        labels(t, path, False)
    beside: set[str] = set()

    def known(x: Aligned) -> None:
        if not skip(x):
            beside.update(x.texts)
            for c in x.children:
                known(c)

    t = root
    for label in path:
        beside.update(t.texts)
        for c in t.children:
            if c.label != label:
                known(c)
        t = next(c for c in t.children if c.label == label)
    return {"region": path, "opened": sorted(opened), "constant": constant, "beside": sorted(beside)}


def told(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode("utf-8", "replace"))


def _inner(node: Node, at: str) -> list[tuple[Node, str]]:
    """The elements in a node, and their places: the labels from the root on."""
    return [(c, f"{at}/{c.label}" if at else c.label) for c in node.children if isinstance(c, Node)]


def along(tree: Node, path: list[str], beside: set[str], opened: frozenset = frozenset()) -> list[tuple[Node, str]]:
    """The nodes at this path and, in their order, parts beside it with any text that the aligned pages don't have there; nothing if the path is absent."""
    reached = False

    def new(node: Node) -> bool:
        text = own_text(node) if node.tag != "a" else ""
        return bool(text) and told(text) not in beside or any(new(c) for c in node.children if isinstance(c, Node) and not skipped(c, True, True, opened))

    def walk(node: Node, at: str, k: int) -> list[tuple[Node, str]]:
        nonlocal reached
        if k == len(path):
            reached = True
            return [(node, at)]
        out = [x for c, there in _inner(node, at) for x in (walk(c, there, k + 1) if c.label == path[k] else [(c, there)] if not skipped(c, False, True, opened) and new(c) else [])]
        text = own_text(node)
        return [(node, at)] if text and told(text) not in beside else out

    found = walk(tree, "", 0)
    return found if reached else []


def regions(tree: Node, path: list[str], beside: list[str] | None = None, opened: frozenset = frozenset()) -> list[tuple[Node, str]]:
    """The nodes at this path, with their places; without any, the page's articles, else its main part, else such parts inside nodes that their marks would
    skip (unless the part itself has such a mark, as a comment), else all of the page."""
    found = [(tree, "")]
    for label in path:
        found = [x for node, at in found for x in _inner(node, at) if x[0].label == label]
    if found and path and found[0][0].tag not in ("html", "body"):
        return found if beside is None else along(tree, path, set(beside), opened)

    def seek(tag: str, by_marks: bool = True, node: Node = tree, at: str = "") -> list[tuple[Node, str]]:
        out = []
        for c, there in _inner(node, at):
            if c.tag == tag and not skipped(c, True, True, opened) and (by_marks or not marked(c.marks)):
                out.append((c, there))
            elif not skipped(c, False, by_marks, opened):
                out += seek(tag, by_marks, c, there)
        return out

    return seek("article") or seek("main") or seek("article", False) or seek("main", False) or [(tree, "")]


def _rules(wrapper: dict) -> tuple[set, set, frozenset]:
    constant = {tuple(x) for x in wrapper["constant"]}
    return constant, {x[0] for x in constant}, frozenset(wrapper.get("opened") or ())


def main_text(page: str, wrapper: dict) -> str:
    """The blocks of the region, one a line: white space inside is one blank, references are decoded, and nothing is cut off."""
    constant, places, opened = _rules(wrapper)
    blocks: list[str] = []
    held: list[str] = []

    def end():
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    def walk(node: Node, at: str, by_marks: bool = True):
        for c in node.children:
            if isinstance(c, str):
                held.append(c)
            elif c.tag == "br":
                held.append(" ")
            elif not skipped(c, True, by_marks, opened):
                there = f"{at}/{c.label}" if at else c.label
                block = c.tag in BLOCK
                if block:
                    end()
                if there not in places or (there, subtree_of(c, opened)) not in constant:
                    walk(c, there, by_marks)
                if block:
                    end()

    found = regions(parse(page), wrapper["region"], wrapper.get("beside"), opened)
    for by_marks in (True, False):  # a page whose whole text is under such marks keeps it
        for region, at in found:
            walk(region, at, by_marks)
            end()
        if blocks:
            break
    return "\n".join(blocks)


def held_constants(page: str, wrapper: dict) -> set[tuple[str, str]]:
    """The constant subtrees of the wrapper that this page has at their places."""
    constant, places, opened = _rules(wrapper)
    found = set()

    def walk(node: Node, at: str):
        for c, there in _inner(node, at):
            if not skipped(c, True, True, opened):
                if there in places and (key := (there, subtree_of(c, opened))) in constant:
                    found.add(key)
                else:
                    walk(c, there)

    for region, at in regions(parse(page), wrapper["region"], None, opened):
        walk(region, at)
    return found


@lru_cache(maxsize=512)
def _wrapper(told: str) -> dict:
    return json.loads(told)


EMPTY = json.dumps({"region": [], "opened": [], "constant": []})


def _induce(t: pa.Table) -> pa.Table:
    pages = [x for x in t.column("html").to_pylist() if x]
    return pa.table({"host": t.column("host")[:1].cast(pa.string()), "wrapper": [json.dumps(induce(pages))]})


def _count(batches):
    """Pages by host (place and label null), and pages by host that have a label at its place."""
    for b in small_batches(batches, 4.0):
        n: Counter = Counter()
        for host, page, told in zip(b.column(0).to_pylist(), binary(b, 1), b.column(2).to_pylist(), strict=True):
            n[host, None, None] += 1
            n.update((host, *x) for x in held_constants(page.decode("utf-8", "replace"), _wrapper(told)))
        if n:
            columns = [*zip(*n, strict=True), tuple(n.values())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "at", "label", "n"])


def _extract(at: tuple[int, int, int], names: list[str]):
    def run(batches):
        for b in small_batches(batches, 4.0):
            told = b.column(at[2]).to_pylist()
            texts = [main_text(p.decode("utf-8", "replace"), _wrapper(w or EMPTY)) if p else "" for p, w in zip(binary(b, at[1]), told, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names)

    return run


def host_of(url):
    """Host of a URL in lower case, without the port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def meet(rows: DataFrame, made: DataFrame, how: str) -> DataFrame:
    """rows joined with wrappers by host; the wrappers go to all tasks only if their bytes are few."""
    told = made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    return rows.join(F.broadcast(made) if told <= BROADCAST_BYTES else made, "host", how)


def confirm(rows: DataFrame, made: DataFrame, share: float = CONSTANT_SHARE) -> DataFrame:
    """The wrappers with those constant labels only that a share of all the host's pages has; rows are (host, html)."""
    shape = F.from_json("wrapper", "region array<string>, opened array<string>, constant array<array<string>>, beside array<string>")
    unsure = cut(made.filter(F.size(shape["constant"]) > 0))
    n = meet(rows, unsure, "inner").select("host", "html", "wrapper").mapInArrow(_count, "host string, at string, label string, n long").groupBy("host", "at", "label").agg(F.sum("n").alias("n"))
    n = cut(n)
    pages = n.filter("at is null").select("host", F.col("n").alias("pages"))
    sure = n.filter("at is not null").join(pages, "host").filter(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_list(F.array("at", "label"))).alias("sure"))
    wrapper = F.struct(shape["region"].alias("region"), shape["opened"].alias("opened"), F.coalesce("sure", F.array().cast("array<array<string>>")).alias("constant"), shape["beside"].alias("beside"))
    return made.join(sure, "host", "left").select("host", F.to_json(wrapper).alias("wrapper"))


def wrappers(df: DataFrame, url_col: str = "url", html_col: str = "html", slots: int = SLOTS) -> DataFrame:
    """(host, wrapper): one row per host. The sample that is aligned has the smallest distinct hashes, all of them if the host has no more. Each task ranks its
    hashes before they are shuffled, so a host with very many pages is like any other."""
    rows = df.select(host_of(quoted(url_col).cast("string")).alias("host"), quoted(html_col).cast("string").alias("html")).filter("html is not null")
    rows = rows.withColumn("h", F.xxhash64("html"))
    # the hash alone is aggregated; the pages that have it are few, and only they are shuffled as long as the hashes of all hosts are small
    rank = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    chosen = cut(rows.select("host", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= slots).select("host", "h"))
    held = chosen.agg(F.sum(F.octet_length("host") + 8)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        pages = rows.join(F.broadcast(chosen), ["host", "h"], "left_semi").groupBy("host", "h").agg(F.first("html").alias("html"))
    else:  # copies of a page are one before the join, so no page that many share is a task of its own
        pages = rows.groupBy("host", "h").agg(F.first("html").alias("html")).join(chosen, ["host", "h"], "left_semi")
    return confirm(rows.select("host", "html"), cut(pages.groupBy("host").applyInArrow(_induce, "host string, wrapper string")))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", slots: int = SLOTS) -> DataFrame:
    """One row per row of df: the id, the url, text.

    Null or empty html: empty text. A null url, or one without a host, shares one wrapper with all such pages. Null and repeated ids each give a row. An
    empty table gives an empty one. Extra columns are ignored.
    """
    names = [id_col, url_col]
    names.append(fresh(names, "text"))
    made = cut(wrappers(df, url_col, html_col, slots))
    rows = df.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url").cast("string")))
    joined = meet(rows, made, "left").select("id", "url", "html", "wrapper")
    # html stands second for the reader below, the url goes through
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(url_col, df.schema[url_col].dataType), T.StructField(names[2], T.StringType())])
    return joined.mapInArrow(_extract((0, 2, 3), names), schema)
