"""Main text of pages by site style trees.

The pages of a host are merged into one tree: a node is a path of presentation labels (tag, classes, id). A node's presentation importance is the
entropy of its children's sequences over the host's pages, a text's content importance one minus the entropy of its
occurrences: what every page repeats is worth nothing. Branches with low importance are removed from each page, and so are texts that most
pages of the host repeat under one node. Elements that are furniture by their tag or by their name go whatever the tree
says; the tree adds to them. The rest of the main element is the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vitrine.llm.common import free_names, materialize
from vitrine.llm.url_rules import url_host

# A branch below this composite importance is removed, on hosts with so many pages that have the branch.
LOW_IMPORTANCE = 0.2
MIN_PAGES = 8
# A text that more than half of a host's pages repeat under one node is removed, if so many pages have it.
MIN_REPEATS = 3
# How much a node's own presentation counts against what is beneath it, by its number of children.
DAMPING = 0.9
# A text counts for its own node and so many nodes above it, so a page's features grow with the page and not with its depth.
ABOVE = 3
# Features a task adds up before it lets them go.
GATHERED = 400_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that end an open p, and those that end an open element of their own kind.
ENDS_P = BLOCKS - frozenset("body head html td th tr tbody thead tfoot li dd dt legend summary".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SIBLING_LIMIT = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
# Furniture by tag, and by a word of the class, id or role (forms count as named).
FURNITURE = frozenset(
    "script style noscript template iframe object embed canvas svg math audio video map head title nav footer aside button"
    " select textarea input menu dialog datalist noembed noframes xmp".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored sponsors promo promotion sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter"
    " subscribe subscription comment comments disqus replies related recommended share sharing social widget widgets login signup"
    " search pagination pager masthead copyright toolbar alert alerts topbar complementary contentinfo skip hidden".split()
)
# Names that go even where they hold most of a page's text.
COMMENTS = frozenset("comment comments disqus replies".split())
MAIN = frozenset(("article", "main"))
ARTICLE = frozenset(("article",))
# Plain text elements of a main element are never branches to remove.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th b i em strong a span code br".split())
WORDS = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "path", "parent", "children", "furniture", "suspect", "comments", "named")

    def __init__(
        self, tag: str, label: str, parent: Node | None, furniture: bool, suspect: bool = False, comments: bool = False
    ):
        self.tag, self.label, self.parent, self.furniture = tag, label, parent, furniture
        self.suspect, self.comments = suspect, comments  # furniture by its name only; named as comments
        self.named = label != tag
        self.children: list = []
        self.path = xxh64_intdigest(f"{parent.path if parent else 0}/{label}") >> 1
        if parent:
            parent.children.append(self)


ROOT_PATH = Node("#root", "#root", None, False).path


def parse(html: str) -> Node:
    """The page's tree: nodes and strings (undecoded). Lenient as browsers are: open paragraphs and list items end where
    the next begins, stray end tags are ignored, a tag cut off by the page's end is dropped."""
    root = node = Node("#root", "#root", None, False)
    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if not m:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            up = node
            while up.parent and up.tag != name:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        if html[m.end() - 1] != ">":  # cut off
            break
        node = _open(node, name, m[3] if m[2] else m[6])
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            stop = close.start() if close else end
            node.children.append(html[at:stop])
            at = html.find(">", stop) + 1 or end if close else end
            node = node.parent
        elif name in VOID:
            node = node.parent
    _clear_suspects(root)
    return root


def _clear_suspects(root: Node) -> None:
    """No article or main element is furniture by its name, nor is what holds one (at least half as long as the longest: teasers
    do not count), nor, unless it is named as comments, what holds more than half of the plain text (outside links) of its main
    element, or of a page without one. Articles inside an article (comments) do not count."""
    nodes = list(_nodes(root))
    if not any(n.suspect for n in nodes):
        return
    size = _plain_sizes(nodes)
    within: dict[int, Node | None] = {}  # the main element, not inside another article, that a node lies in
    mains = []
    for n in nodes:
        up = within.get(id(n.parent)) if n.parent else None
        if n.tag in MAIN and not (up and _inside(n.parent, ARTICLE)):
            mains.append(n)
            n.suspect = False
            up = n
        within[id(n)] = up
    holders = {id(up) for n in mains for up in _above(n)}
    longest = max((size[id(n)] for n in mains if id(n) not in holders), default=0)
    for n in mains:
        if id(n) not in holders and 2 * size[id(n)] >= longest:
            for up in _above(n):
                up.suspect = False
    for n in nodes:
        whole = within[id(n)] or (None if longest else root)
        if n.suspect and not n.comments and whole and 2 * size[id(n)] > size[id(whole)]:
            n.suspect = False


def _above(node: Node) -> Iterator[Node]:
    while node := node.parent:
        yield node


def _plain_sizes(nodes: list[Node]) -> dict[int, int]:
    """Characters of text beneath each node, links and furniture by tag left out. ``nodes`` has parents first."""
    size = {id(n): 0 if n.tag == "a" else sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in nodes}
    for n in reversed(nodes):
        if n.parent and n.tag != "a":
            size[id(n.parent)] += size[id(n)]
    return size


def _open(node: Node, name: str, attributes: str | None) -> Node:
    if name in ENDS_P:
        node = _leave(node, {"p"}, {"article", "div", "section", "td", "th", "li", "button", "main", "aside"})
    if name in SIBLINGS:
        node = _leave(node, SIBLINGS[name], SIBLING_LIMIT[name])
    label, furniture, suspect, comments = name, name in FURNITURE, name == "form", False
    if attributes and attributes.strip(" /\n\t"):
        found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
        named = DIGITS.sub("", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()).strip()
        if named:
            label = f"{name}.{' '.join(sorted(named.split()))}"
            words = NAMES.intersection(WORDS.findall(named))
            if name not in ("html", "body") and words:
                suspect, comments = True, not COMMENTS.isdisjoint(words)
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style:
            furniture = True
    if name == "header" and not _inside(node, MAIN):
        furniture = True
    return Node(name, label, node, furniture, suspect, comments)


def _leave(node: Node, tags: set[str], limit: set[str]) -> Node:
    """The parent of the outermost open element of ``tags`` this side of ``limit``, or the node itself."""
    up, out = node, node
    while up.parent and up.tag not in limit:
        if up.tag in tags:
            out = up.parent
        up = up.parent
    return out


def _inside(node: Node | None, tags: frozenset) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _texts(root: Node, dropped) -> list[tuple[Node, str]]:
    """Blocks in page order, each with the block element it began in."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    owner = root

    def flush():
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append((owner, text))
        held.clear()

    stack = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in BLOCKS:
            flush()
            owner = node
        descended = False
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif not dropped(child):
                stack.append((node, i))
                stack.append((child, 0))
                descended = True
                break
            elif child.tag in BLOCKS:
                flush()
                owner = node
        if not descended and node.tag in BLOCKS:
            flush()
            owner = node.parent or root
    flush()
    return out


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.furniture)


def page_features(html: str) -> set[tuple[int, int, int, int, int]]:
    """What a page adds to its host's tree: ``(path, 0, number of children, suspect, hash of their sequence)`` for every node, and
    ``(path, 1, 0, own, hash of the text)`` for every text of a node (``own``) or up to ``ABOVE`` nodes beneath it. Furniture by tag is left
    out; what is in a suspect node counts for the nodes up to that one."""
    root = parse(html)
    out = set()
    for node in _nodes(root):
        kinds = [c.label for c in node.children if not isinstance(c, str)]
        merged = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]  # a run of one kind is one child
        out.add((node.path, 0, len(merged), int(node.suspect), xxh64_intdigest(" ".join(merged)) >> 1))
    beneath: dict[tuple[int, int], int] = {}
    for owner, text in _texts(root, lambda n: n.furniture):
        feature, own = xxh64_intdigest(text) >> 1, 1
        for _ in range(ABOVE + 1):
            beneath[owner.path, feature] = own or beneath.get((owner.path, feature), 0)
            own = 0
            if owner.suspect or not owner.parent:
                break
            owner = owner.parent
    out.update((path, 1, 0, own, feature) for (path, feature), own in beneath.items())
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def release() -> pa.RecordBatch:
        rows = [(*key, n) for key, n in counts.items()]
        names = ["host", "path", "kind", "children", "mark", "feature", "n"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            counts.update((host, *f) for f in page_features(html))
            if len(counts) >= GATHERED:
                yield release()
                counts.clear()
    if counts:
        yield release()


def tree_sums(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each host's merged tree as sums: a row of every node, and one of every (node, text) that ``MIN_REPEATS`` pages have.

    Features are counted in their task first and then by (host, path, feature), so a hot host is many keys. Pages without a host or
    html add nothing.
    """
    src = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> '' and html is not null")
    counted = (
        src.mapInArrow(_gather, "host string, path long, kind int, children int, mark int, feature long, n long")
        .groupBy("host", "path", "kind", "feature")
        .agg(F.sum("n").alias("n"), F.max("children").alias("children"), F.max("mark").alias("mark"))
    )
    node, text = F.col("kind") == 0, F.col("kind") == 1
    repeated = text & (F.col("mark") == 1) & (F.col("n") >= MIN_REPEATS)
    return counted.groupBy("host", "path", F.when(repeated, F.col("feature")).alias("text")).agg(
        F.sum(F.when(node, F.col("n"))).alias("pages"),
        F.sum(F.when(node, F.col("n") * F.log("n"))).alias("nlogn"),
        F.max("children").alias("children"),
        F.max(F.when(node, F.col("mark"))).alias("suspect"),
        F.sum(F.when(text, F.log("n"))).alias("logs"),
        F.count_if(text).alias("texts"),
        F.max(F.when(repeated, F.col("n"))).alias("times"),
    )


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, pages, suspect, importance``: the nodes of each host's merged tree with their composite importance. On a
    node that one page has, entropy says nothing; its importance is 1."""
    return _importance(tree_sums(pages, url_col, html_col))


def _importance(sums: DataFrame) -> DataFrame:
    sums = sums.groupBy("host", "path").agg(
        *(F.sum(c).alias(c) for c in ("pages", "nlogn", "logs", "texts")), *(F.max(c).alias(c) for c in ("children", "suspect"))
    )
    m = F.col("pages")
    own = F.when(m > 1, (F.log(m) - F.col("nlogn") / m) / F.log(m)).otherwise(1.0)
    mean_log = F.when(F.col("texts") > 0, F.col("logs") / F.col("texts"))
    content = F.when(m > 1, F.lit(1.0) - mean_log / F.log(m)).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.col("children"))
    importance = F.when(mean_log.isNull(), own).otherwise((1 - weight) * own + weight * content)
    return sums.where("pages is not null").select(
        "host", "path", "pages", (F.col("suspect") == 1).alias("suspect"), importance.alias("importance")
    )


def low_branches(tree: DataFrame, threshold: float = LOW_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _low``: each host's paths with low importance."""
    low = tree.where((F.col("importance") < threshold) & (F.col("pages") >= min_pages))
    return low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("_low"))


def _judged(sums: DataFrame) -> DataFrame:
    """``_host, _low, _common``: each host's paths with low importance, and the texts (path xor hash) that more than
    half of its pages have under one node."""
    none = F.lit(None).cast("long")
    low = _importance(sums).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW_IMPORTANCE))
    paths = low.select("host", F.col("path").alias("low"), none.alias("common"))
    whole = sums.where(F.col("path") == ROOT_PATH).groupBy(F.col("host").alias("h")).agg(F.sum("pages").alias("all"))
    texts = sums.where("text is not null").select("host", F.col("path").bitwiseXOR(F.col("text")).alias("common"), "times")
    common = texts.join(whole, F.col("host") == F.col("h")).where(F.col("times") * 2 > F.col("all"))
    rows = paths.unionAll(common.select("host", none.alias("low"), "common"))
    return rows.groupBy(F.col("host").alias("_host")).agg(*(F.collect_set(c).alias(f"_{c}") for c in ("low", "common")))


def main_text(html: str | None, low: set[int] = frozenset(), common: set[int] = frozenset()) -> str:
    """The main text of a page: its blocks joined by an empty line. ``low`` and ``common`` are what its host's tree says: branches of low
    importance, and texts most pages have."""
    if not html:
        return ""
    root = parse(html)
    mains = [n for n in _nodes(root) if n.tag in MAIN and not _inside(n.parent, MAIN)]

    def dropped(node: Node) -> bool:
        if node.furniture or node.suspect:
            return True
        if node.path not in low or node.tag in MAIN or node.tag in ("html", "body"):
            return False
        inside = _inside(node, MAIN)
        if inside:
            return node.named or node.tag not in FLOW
        return not mains  # outside the main element nothing is taken anyway

    blocks = _texts(root, dropped)
    if mains:
        # Of articles and main elements those are taken whose longest has more text.
        size = dict.fromkeys(map(id, mains), 0)
        holder = _holders(size)
        for node, text in blocks:
            if found := holder(node):
                size[found] += len(text)
        longest = max(mains, key=lambda n: (size[id(n)], n.tag == "article"))
        holder = _holders({id(n) for n in mains if n.tag == longest.tag})
        blocks = [(n, t) for n, t in blocks if holder(n)]
    elif not blocks:
        # Repeated pages make their own text look like furniture: a page does not lose all it has.
        blocks = _texts(root, lambda n: n.furniture or n.suspect) or _texts(root, lambda n: n.furniture)
    # A page of nothing but common texts is a copy, and keeps them.
    rest = [(n, t) for n, t in blocks if n.path ^ (xxh64_intdigest(t) >> 1) not in common] if common else blocks
    return "\n\n".join(t for _, t in rest or blocks)


def _holders(chosen):
    """A function that gives the id of the innermost node of ``chosen`` that holds a node, or 0; it climbs each node once."""
    known: dict[int, int] = {}

    def holder(node: Node) -> int:
        climbed, up = [], node
        while up and id(up) not in known and id(up) not in chosen:
            climbed.append(id(up))
            up = up.parent
        found = 0 if not up else id(up) if id(up) in chosen else known[id(up)]
        known.update(dict.fromkeys(climbed, found))
        return found

    return holder


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with ``text`` and ``n_chars`` (its code points) appended (columns of these names are replaced).

    The text is that of the page's article (or main element, or body) without furniture and without the branches that
    the host's style tree finds of low importance; character references decoded, white space in a block one
    space, blocks trimmed, in page order, joined by an empty line. Plain paragraphs, headings, lists and tables of an article are
    no branches to remove; each of their texts goes if more than half of the host's pages (and ``MIN_REPEATS``) have it under
    the same node, but a page with no other texts is a copy and keeps them. Null or empty html gives an empty
    text; pages without a host are judged alone; repeated rows come as often as they came; an empty table gives no rows.

    Two scans: the first gathers the trees, the second extracts. What the hosts' trees say is a table of a few paths and texts a host;
    Spark broadcasts it if it is small as written and otherwise splits hot hosts in the join.
    """
    pages = pages.drop("text", "n_chars")
    columns = pages.columns
    sums = materialize(tree_sums(pages, url_col, html_col), "tree")
    low = materialize(_judged(sums), "branches")
    h, host, low_col, common_col = free_names(columns, "h", "host", "low", "common")
    low = low.toDF(host, low_col, common_col)
    joined = pages.withColumn(h, url_host(F.col(url_col))).join(low, F.col(h) == F.col(host), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = zip(*(batch.column(c).to_pylist() for c in (html_col, low_col, common_col)))
            texts = [main_text(html, *(set(found or ()) for found in sets)) for html, *sets in judged]
            out = [batch.column(i) for i in range(len(columns))]
            out += [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return joined.select(*(F.col(f"`{c}`") for c in columns), low_col, common_col).mapInArrow(run, f"{schema}, text string, n_chars long")
