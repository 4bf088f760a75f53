"""Main text of web pages, with site template removal.

Every page is parsed once. Every block subtree of the page is hashed, in the main part and outside it, and
counted per host over distinct main texts; subtrees that recur on ``LEAST_PAGES`` pages and
``LEAST_SHARE`` of the pages of their host are template and are deleted. Inside an article
the same passage may well stand in several texts, so that blocks there must recur on
``ARTICLE_SHARE`` of the pages of their host, unless they are made mostly of links or are named like
furniture; rows and terms of tables and lists of terms go with their whole table or list only.

Counts can't show everything: scripts, forms and the like are dropped while parsing, and what markup names
as furniture for certain (menus, headers, footers, asides, adverts, notices, reader comments, ...) goes on
pages whose host has too few of them as well; a class or id word never takes the only article along
(``_settle``), and words that also name ordinary parts of a text (``VAGUE_NAMES``) leave the decision
to the counts inside an article, as do names there that hold other words too (``ad-hoc``; words that only tell
place or shape, ``BESIDE_WORDS``, are no others). All outermost article and main elements and the h1 beside them are the
main part; where several articles together hold less than the paragraphs outside them, as teasers do, it is the
element that holds nearly all of these paragraphs.

Defined results: a null, empty or text-free page gives ''; an empty table gives no rows; a null url has
the host ''; repeated rows are extracted each, and count once as evidence for a template; broken markup is
read as far as it goes (unclosed elements end with their parent, an unclosed tag at the next one), in time
and memory that grow with the length of the page, however deep or broken it is; white space is what
Unicode calls so; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text
from ._util import materialize, slices, small_batches, table

LEAST_PAGES = 5
LEAST_SHARE = 0.05
ARTICLE_SHARE = 0.5
SALTS = 16
#: Most templates (8 bytes each) that are broadcast; more are joined.
MOST_BROADCAST = 4_000_000

#: Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tr figure figcaption dl dt dd".split())
#: Parts that mean nothing without what stands beside them.
PARTS = frozenset("caption thead tbody tfoot tr dt dd figcaption".split())
#: Dropped while parsing: no text of the page, or controls of a form.
DROPPED = frozenset("head script style noscript template form button input select option textarea iframe object embed svg canvas audio video map title".split())
FURNITURE = frozenset("nav footer aside dialog menu search".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
GONE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription popup modal overlay sidebar widget widgets related recommended share sharing "
    "social breadcrumb breadcrumbs menu nav navbar navigation footer pagination pager toolbar login signup search comment comments "
    "commentlist respond disqus replies".split()
)
#: Names that ordinary parts of an article may bear as well.
VAGUE_NAMES = frozenset("related recommended search share sharing social widget widgets toolbar login signup header promotion alert menu".split())
#: Names of what often outweighs the text it stands in.
BESIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion comment comments commentlist respond disqus replies".split())
#: Words of a class that tell the place, shape or content of a box and leave its meaning to the others.
BESIDE_WORDS = frozenset(
    "area article articles author bar body bottom box btn button buttons card center column container content desktop fixed float form global grid group "
    "head header heading hidden icon icons image img inline inner item items label large layout left link links list main message mid middle mobile module "
    "outer page panel post posts primary reader readers right row section side site slot small space sticky stories story text thread title "
    "top unit user users view wrap wrapper zone".split()
)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}
#: An opening tag ends an open element of the second set, up to the limits of the third.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Where an element that an opening tag would end is looked for no further.
STOPS = frozenset("article main section body div td blockquote button".split())
#: What the closing tag of an element within a line doesn't reach out of.
BARRIERS = ("article", "main", "td", "th", "table", "li")
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?<![^\s"'])(hidden)(?![^\s/>])""")
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    """``gone`` elements are furniture: their text goes, their subtrees are counted. ``vague`` ones are
    decided by counts."""

    __slots__ = ("children", "depth", "gone", "links", "named", "parent", "tag", "text_size", "vague")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, named: frozenset[str] = frozenset(), vague: bool = False):
        self.tag, self.parent, self.gone, self.named, self.vague = tag, parent, gone, named, vague
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text_size = self.links = 0


def _furniture(tag: str, attributes: str, inside_article: bool) -> tuple[bool, frozenset[str], bool]:
    """Whether an element is furniture for certain, words of its class and id that make it likely, and
    whether such words leave it to the counts."""
    if tag in FURNITURE or tag == "header" and not inside_article:
        return True, frozenset(), False
    named: set[str] = set()
    partly = False
    if not attributes or tag in ("body", "html", "article", "main"):
        return False, frozenset(), False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if bare or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, frozenset(), False
        if name == "role" and value in GONE_ROLES:
            return True, frozenset(), False
        if name in ("class", "id"):
            for token in value.split():
                words = {*_NAME.findall(token)}
                own = words & GONE_NAMES
                if not inside_article and "header" in words:
                    own.add("header")
                if inside_article and own and any(not w[0].isdigit() for w in words - own - BESIDE_WORDS):
                    partly = True
                else:
                    named |= own
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, frozenset(), False
    vague = inside_article and (partly or bool(named)) and named <= VAGUE_NAMES
    return False, frozenset() if vague else frozenset(named), vague


def _settle(root: Node) -> None:
    """Decides on elements with furniture's names: they go, unless the article (or, without one,
    most of the text of the page) stands in them alone, or they hold most of the text of the page
    as a part of the article."""
    order, stack = [], [(root, False)]
    any_named = False
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        any_named |= bool(node.named)
        inside |= node.tag in ("article", "main")
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and not c.gone]
    if not any_named:
        return
    size: dict[int, int] = {}
    article: dict[int, int] = {}
    for node, inside in reversed(order):
        parts = [c for c in node.children if isinstance(c, Node) and not c.gone]
        size[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(size[id(c)] for c in parts)
        own = size[id(node)] if node.tag in ("article", "main") or inside and node.named else 0
        article[id(node)] = max([own, *(article[id(c)] for c in parts)])
    most = size[id(root)]
    while True:
        outer, clean, stack = [], False, [(root, False)]
        while stack:
            node, inside = stack.pop()
            if node.named:
                outer.append((node, inside))
                continue
            inside |= node.tag in ("article", "main")
            clean |= inside and any(isinstance(c, str) and c.strip() for c in node.children)
            stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node) and not c.gone]
        kept: list[Node] = []
        if clean:
            kept = [n for n, inside in outer if inside and 2 * size[id(n)] > most and not n.named & BESIDE_NAMES]
        elif any(article[id(n)] for n, _ in outer):
            best = max((n for n, _ in outer), key=lambda n: article[id(n)])
            kept = [n for n, _ in outer if article[id(n)] and n.named == best.named]
        else:
            kept = [n for n, _ in outer if 2 * size[id(n)] > most]
        if not kept:
            break
        for n in kept:
            n.named = frozenset()
    for n, _ in outer:
        n.gone = True


def parse(text: str) -> Node:
    """A tree of the page: elements, and decoded text without what stands in dropped elements. The open
    elements are known by tag, so that no tag is looked for through the depth of the page."""
    root = node = Node("#root", None)
    opened: defaultdict[str, list[Node]] = defaultdict(list)
    dropped: Node | None = None
    at = 0

    def leave(to: Node) -> None:
        nonlocal node, dropped
        while node is not to:
            opened[node.tag].pop()
            if node is dropped:
                dropped = None
            node = node.parent

    def innermost(tags) -> int:
        return max((opened[t][-1].depth for t in tags if opened[t]), default=-1)

    def end_head() -> None:
        if opened["head"]:
            leave(opened["head"][-1].parent)

    def say(part: str) -> None:
        if node.tag == "head" and part.strip():
            end_head()
        if part and dropped is None:
            node.children.append(html.unescape(part))

    position = 0
    while (m := _TOKEN.search(text, position)) is not None:
        say(text[at : m.start()])
        at = position = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            own = opened[tag][-1] if opened[tag] else None
            if own is not None and (tag in BLOCK or tag in ("td", "th") or innermost(BARRIERS) < own.depth):
                leave(own.parent)
            continue
        if tag == "body" or node.tag == "head" and tag not in IN_HEAD:
            end_head()
        if tag in CLOSES_P or tag in ENDS:
            ended, limits = ENDS.get(tag, (frozenset(), frozenset()))
            floor = innermost((limits | STOPS) - ended)
            found: Node | None = None
            for t in ended | {"p"} if tag in CLOSES_P else ended:
                for own in reversed(opened[t]):
                    if own.depth <= floor:
                        break
                    if found is None or own.depth < found.depth:
                        found = own
            if found is not None:
                leave(found.parent)
        if dropped is not None:
            new = Node(tag, node)
        else:
            new = Node(tag, node, *_furniture(tag, attributes, bool(opened["article"] or opened["main"])))
            if tag not in DROPPED:
                node.children.append(new)
            elif tag in BLOCK:
                node.children.append(Node(tag, node, True))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = position = end.end() if end else len(text)
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            if dropped is None and tag in DROPPED:
                dropped = new
            node = new
            opened[tag].append(new)
    say(text[at:])
    _settle(root)
    return root


def _measure(root: Node) -> list[Node]:
    """All elements that stay, children first, with the size of their text and of that in links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.gone]
    order.reverse()
    for node in order:
        node.text_size = sum(len(c.strip()) if isinstance(c, str) else c.text_size for c in node.children if isinstance(c, str) or not c.gone)
        node.links = node.text_size if node.tag == "a" else sum(c.links for c in node.children if isinstance(c, Node) and not c.gone)
    return order


def _main(root: Node) -> list[Node]:
    """The outermost article and main elements and the headlines (h1) beside them, else everything; the element with the
    paragraphs outside of several articles, if these are more."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main", "h1"):
            if node.text_size:
                found.append(node)
            if node.text_size or node.tag == "h1":
                continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.gone]
    articles = [n for n in found if n.tag == "article"]
    if len(articles) > 1 and all(n.tag != "main" for n in found):
        story = _story(root, sum(n.text_size for n in articles))
        if story is not None:
            return [*_headlines_beside(found, story), story]
    return found if any(n.tag != "h1" for n in found) else [root]


def _story(root: Node, least: int) -> Node | None:
    """The innermost element with nine tenths of the paragraphs outside of articles, if these hold more than ``least``."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag != "p":
            stack += [c for c in node.children if isinstance(c, Node) and not c.gone and c.tag != "article"]
    prose: dict[int, int] = {}
    for node in reversed(order):
        prose[id(node)] = node.text_size - node.links if node.tag == "p" else sum(prose.get(id(c), 0) for c in node.children)
    if prose[id(root)] <= least:
        return None
    node = root
    while inner := [c for c in node.children if isinstance(c, Node) and c.tag != "p" and 10 * prose.get(id(c), 0) >= 9 * prose[id(root)]]:
        node = inner[0]
    return node


def _headlines_beside(found: list[Node], story: Node) -> list[Node]:
    inner, stack = set(), [story]
    while stack:
        node = stack.pop()
        inner.add(id(node))
        stack += [c for c in node.children if isinstance(c, Node)]
    return [n for n in found if n.tag == "h1" and id(n) not in inner]


def _hash(node: Node, digest: dict[int, bytes]) -> bytes:
    made = hashlib.blake2b(node.tag.encode(), digest_size=8)
    for c in node.children:
        made.update(b"\0" + " ".join(c.split()).encode("utf-8", "replace") if isinstance(c, str) else b"\1" + digest.get(id(c), b""))
    return made.digest()


def _furniture_marks(root: Node) -> list[int]:
    """Hashes of the block subtrees of the page's furniture."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside |= node.gone
        if inside:
            order.append(node)
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]
    digest: dict[int, bytes] = {}
    said: set[int] = set()
    out = []
    for node in reversed(order):
        node.parent = None
        made = digest[id(node)] = _hash(node, digest)
        if any(c.strip() if isinstance(c, str) else id(c) in said for c in node.children):
            said.add(id(node))
            if node.tag in BLOCK:
                out.append(int.from_bytes(made, "big", signed=True) & ~1)
    return out


def blocks(text: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The blocks of the main part, and (mark, first, last) of every block subtree of the page: its hash
    and the blocks it covers (last exclusive; none outside the main part). Subtrees with odd marks must
    recur on ``ARTICLE_SHARE`` of the pages."""
    root = parse(text or "")
    order = _measure(root)
    main = _main(order[-1])
    inside: set[int] = set()
    inner_nodes = [n for n in main if n.tag in ("article", "main")]
    outermost = {id(n) for n in inner_nodes}
    while inner_nodes:
        node = inner_nodes.pop()
        inside.add(id(node))
        inner_nodes += [c for c in node.children if isinstance(c, Node) and not c.gone]
    digest: dict[int, bytes] = {}
    mark: dict[int, int] = {}
    for node in order:
        made = digest[id(node)] = _hash(node, digest)
        whole = id(node) not in inside
        if node.vague and 2 * node.links >= node.text_size:
            node.gone = True  # a box of links within an article
        template_like = node.tag in BLOCK and (node.tag not in ("body", "html") if whole else node.tag not in PARTS and id(node) not in outermost)
        if template_like and node.text_size:
            often = not whole and not node.vague and (node.tag in PROSE or 2 * node.links < node.text_size)
            mark[id(node)] = int.from_bytes(made, "big", signed=True) & ~1 | often
    out: list[str] = []
    marks: list[tuple[int, int, int]] = []
    run: list[str] = []

    def close() -> None:
        said = " ".join("".join(run).split())
        run.clear()
        if said:
            out.append(said)

    stack: list[tuple[object, int]] = [(n, -1) for n in reversed(main)]
    while stack:
        item, first = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif first >= 0:  # the end of a block
            close()
            if id(item) in mark:
                marks.append((mark.pop(id(item)), first, len(out)))
        elif item.gone:
            if item.tag in BLOCK:
                close()
        else:
            if item.tag in BLOCK:
                close()
                stack.append((item, len(out)))
            elif item.tag in ("br", "td", "th"):
                run.append(" ")
            if item.tag in ("td", "th"):
                stack.append((" ", -1))
            stack += [(c, -1) for c in reversed(item.children)]
    close()
    # what is left stands beside the main part
    marks += [(m, 0, 0) for m in [*mark.values(), *_furniture_marks(root)]]
    for node in order:
        node.parent = None  # no cycles: the tree is freed at once
    return out, marks


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _parsed(pages: DataFrame) -> DataFrame:
    named = pages.select("page_id", "url", F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))).alias("host"), F.col("html").alias("page_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "page_html"):
                made = [blocks(t) for t in piece.column(3).to_pylist()]
                marks = [[[m[k] for m in ms] for _, ms in made] for k in range(3)]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array([b for b, _ in made], pa.list_(pa.string())), *map(pa.array, marks, kinds)], names=[*piece.schema.names[:3], "blocks", "marks", "first", "last"])

    ids = named.schema["page_id"].dataType.simpleString()
    made = small_batches(named).mapInArrow(run, f"page_id {ids}, url string, host bigint, blocks array<string>, marks array<bigint>, first array<int>, last array<int>")
    return made.withColumn("content", F.xxhash64("blocks"))


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """(host, mark) of the recurring subtrees. Counts are over distinct main texts."""
    texts = parsed.groupBy("host", "content").agg(F.max(F.array_sort(F.array_distinct("marks"))).alias("marks"))
    pages = texts.groupBy("host").agg(F.count("*").alias("pages"))
    count = texts.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return count.join(pages, "host").where(F.col("n") >= F.when(F.col("mark") % 2 == 0, least_share).otherwise(max(least_share, article_share)) * F.col("pages")).select("host", "mark")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _text.mix(_text.mix(a.astype(np.int64).view(np.uint64)) ^ b.astype(np.int64).view(np.uint64))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists without nulls, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def cut(batch: pa.RecordBatch, known: np.ndarray | None) -> tuple[pa.Array, pa.Array]:
    """The text of each page without the blocks of template subtrees, and how many of those the page
    holds. ``known``: sorted pairs of host and mark; without it the column ``gone`` lists the marks."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    marks, row = _lists(get("marks"))
    if known is None:
        gone, gone_row = _lists(get("gone"))
        hit = np.isin(_pair(row, marks), _pair(gone_row, gone))
    else:
        own = _pair(get("host").to_numpy()[row], marks)
        at = np.searchsorted(known, own)
        hit = known[np.minimum(at, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
    said = get("blocks")
    size = said.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(size)])
    first, last = (begin[row[hit]] + _lists(get(c))[0][hit] for c in ("first", "last"))
    covered = np.zeros(begin[-1] + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, last, -1)
    keep = np.cumsum(covered)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(keep)])[begin]
    left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), said.flatten().filter(pa.array(keep)))
    found = np.bincount(np.unique(np.stack([row[hit], marks[hit]]), axis=1)[0].astype(np.int64), minlength=len(batch)) if hit.any() else np.zeros(len(batch), np.int64)
    return pc.binary_join(left, "\n"), pa.array(found, pa.int64())


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates) of every page: ``n_templates`` counts the distinct
    template subtrees that were deleted from it."""
    parsed = materialize(_parsed(pages), "parsed_pages")
    found = materialize(templates(parsed, least_pages, least_share), "page_templates")
    columns = ["page_id", "url", "host", "blocks", "marks", "first", "last"]
    known = None
    if found.count() <= MOST_BROADCAST:
        # beside the pages themselves: their text isn't shuffled
        pairs = found.toPandas()
        known = parsed.sparkSession.sparkContext.broadcast(np.sort(_pair(pairs["host"].to_numpy(), pairs["mark"].to_numpy())))
        told = parsed.select(*columns)
    else:
        # a template of a large host is on all of its pages: its templates are copied for each salt
        copied = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = parsed.select("host", "content", F.explode(F.array_distinct("marks")).alias("mark"), F.pmod("content", F.lit(SALTS)).cast("int").alias("salt"))
        gone = own.join(copied, ["host", "mark", "salt"]).groupBy("host", "content").agg(F.collect_set("mark").alias("gone"))
        told = parsed.join(gone, ["host", "content"], "left").select(*columns, F.coalesce("gone", F.expr("cast(array() as array<bigint>)")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_templates = cut(batch, known.value if known is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], text, n_templates], names=["page_id", "url", "text", "n_templates"])

    made = small_batches(told).mapInArrow(run, f"page_id {parsed.schema['page_id'].dataType.simpleString()}, url string, text string, n_templates bigint")
    return made.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_templates")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
