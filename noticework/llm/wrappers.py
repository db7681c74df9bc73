"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of block elements in which runs of alike siblings are folded into one repeating node.  Simple
tree matching aligns every page with the most frequent tree of its cluster: a host's pages that align badly with its most
frequent tree form the next cluster.  A text that stands in the same aligned node on nearly all pages that have this node is
template; what varies is content, unless the element's role says otherwise.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from noticework.llm.common import fresh, in_small_batches, with_arrow
from noticework.llm.urlfilter import host_and_path
from noticework.operators.ordering import best_rows
from noticework.session import settled

# A text is template if it stands on this share of the host's distinct pages, of which there have to be this many.
CONSTANT_SHARE, MIN_PAGES = 0.8, 5
# Pages with this share of their nodes in a cluster's seed belong to it.
ALIGNED_SHARE = 0.5
# A round looks for seeds among so many of a host's most frequent trees, four times as many in each round after the first, up to the second number.
FIRST_TREES, MOST_TREES = 4, 64
# Siblings with up to so many pairs of equal labels are chained pair by pair, others row by row.  Both find a heaviest chain.
MAX_PAIRS = 200_000
# Nodes in all alignments that a task remembers, and pairs of unlike subtrees while it aligns.
REMEMBERED_NODES = 1_000_000
# Deeper elements count as part of the element at this depth.
MAX_DEPTH = 100
# Outside articles, nodes whose text is mostly links are navigation.
LINK_SHARE = 0.6
# Words and forms mark nothing on an element around this share of the text outside OTHER_ELEMENTS: around an article, or around plain text.
AROUND_ARTICLE, AROUND_TEXT = 0.5, 0.8

# Elements that start a block of their own (fixed values).
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
# Elements whose content is no text of the page, up to their end tag (fixed values).
HIDDEN = frozenset("script style noscript template iframe object svg math textarea select title button audio video canvas".split())
# Open elements that a start tag closes (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements, and words of classes and ids, that mark what is no part of the article (fixed values).
OTHER_ELEMENTS = frozenset("nav header footer aside form dialog menu search head".split())
OTHER_WORDS = frozenset("""ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disclaimer disqus
    footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply
    respond search share sharing sidebar skip social sponsor sponsored subscribe teaser teasers toolbar widget""".split())
# Words that mark outside articles only, where they are a whole class or id (fixed values).
OUTER_WORDS = frozenset("bottom foot top".split())
# Words of OTHER_WORDS that name subjects as well: they mark only beside words of the frame (fixed values).
SUBJECT_WORDS = frozenset("banner comment consent disclaimer form header menu notice notices promotion related reply respond search share sharing social".split())
# Words that say nothing on what an element holds (fixed values).
FRAME_WORDS = frozenset("""area article articles bar block body bottom box btn button buttons col column container content count entry fb footer global group icons
    inner item items layout left link links list main module outer page pages panel post posts primary right row secondary section site stories story sub tool
    tools top us widget wp wrap wrapper thread""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# A tag in the rest of a page whose last quote is never closed.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_OPENING = re.compile("<[a-zA-Z/!?]")
_WORD = re.compile(r"[a-zA-Z]+")
_ROLE_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile("[ \t\n\x0b\x0c\r\xa0]+")


@dataclass
class Node:
    """A block element, folded with the alike siblings that follow it."""

    label: str
    children: list[Node] = field(default_factory=list)
    cursor: int = -1
    number: int = -1

    def child(self, label: str) -> Node:
        """The child for the next element: one that is at the cursor or after it, or a new one."""
        for at in range(max(self.cursor, 0), len(self.children)):
            if self.children[at].label == label:
                break
        else:
            at = self.cursor + 1
            self.children.insert(at, Node(label))
        self.cursor = at
        found = self.children[at]
        found.cursor = -1
        return found


@dataclass
class Run:
    """A stretch of text inside one block."""

    node: Node
    text: str
    linked: int
    article: bool
    other: bool


@dataclass(eq=False)
class Mark:
    """An element that seems to be no part of the article.  Words and forms are ``soft``: what lies inside may show that they are wrong."""

    soft: bool
    size: int = 0
    around: bool = False
    main: bool = False


def _label(tag: str, attributes: str, article: bool = False) -> tuple[str, bool]:
    """Tag with the words of its class and id, and whether they mark something besides the article, which has headers of its own."""
    if not attributes:
        return tag, False
    names = [name for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()]
    words = sorted({w.lower() for name in names for w in _WORD.findall(name)})
    return ".".join([tag, *words]), any(_marks(name, article) for name in names)


def _marks(name: str, article: bool) -> bool:
    """Whether a class or id marks what is no part of the article.

    Any role word does, unless it may be a subject (``market-share``): beside such a word all others have to be role words or say nothing.
    """
    words = [w.lower() for w in _ROLE_WORD.findall(name)]
    roles = {w for w in (*words, name.lower()) if w in OTHER_WORDS and not (article and w == "header")}
    if not roles:
        return not article and name.lower() in OUTER_WORDS
    return bool(roles - SUBJECT_WORDS) or all(w in OTHER_WORDS or w in FRAME_WORDS for w in words) or name.lower() in OTHER_WORDS


def parse(page: str) -> tuple[Node, list[Run]]:
    """The folded block tree of a page and its stretches of text in page order."""
    root = Node("")
    stack: list[tuple[str, Node, bool, tuple[Mark, ...]]] = [("", root, False, ())]
    marks_of: list[tuple[Mark, ...]] = []
    runs: list[Run] = []
    parts: list[str] = []
    linked = links = 0
    opened: Counter[str] = Counter()
    pattern = _TOKEN

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", references.unescape("".join(parts))).strip(" ")
            if text:
                _, node, article, marks = stack[-1]
                runs.append(Run(node, text, linked, article, bool(marks)))
                marks_of.append(marks)
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    while at < len(page):
        opening = _OPENING.search(page, at)
        if opening is None or page.find(">", opening.start()) < 0 and not page.startswith("<!--", opening.start()):
            add(page[at:])
            break
        found = pattern.match(page, opening.start())
        if found is None:
            # Only a quote that is never closed, or a stray end tag, has no end: the former is looked for once.
            if page[opening.start() + 1] != "/" or page[opening.start() + 2:opening.start() + 3].isalpha():
                pattern = _LOOSE
                found = pattern.match(page, opening.start())
        if found is None:
            add(page[at:opening.end()])
            at = opening.end()
            continue
        if found.start() > at:
            add(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if opened[tag]:
                    flush()
                    while True:
                        closed = stack.pop()[0]
                        opened[closed] -= 1
                        if closed == tag:
                            break
                    links = 0
            continue
        if tag in HIDDEN:
            if not found[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else len(page)
            add(" ")
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            while stack[-1][0] in CLOSES.get(tag, ()):
                opened[stack.pop()[0]] -= 1
            if tag == "hr":
                continue
            _, parent, article, marks = stack[-1]
            if tag in ("article", "main"):
                for mark in marks:
                    mark.around, mark.main = True, mark.main or tag == "main"
            article = article or tag in ("article", "main")
            label, marked = _label(tag, found[3], article)
            apart = tag in OTHER_ELEMENTS and not (tag == "header" and article)
            # What lies in so many marked elements is marked.
            if len(marks) < MAX_DEPTH and (apart or marked and tag not in ("html", "body", "main")):
                marks = (*marks, Mark(tag == "form" or not apart))
            node = parent.child(label) if len(stack) <= MAX_DEPTH else parent
            stack.append((tag, node, article, marks))
            opened[tag] += 1
    flush()
    _lift(runs, marks_of)
    return root, runs


def _lift(runs: list[Run], marks_of: list[tuple[Mark, ...]]) -> None:
    """Unmarks the runs whose marks are all soft ones around the article, if the page has no unmarked article."""
    if not any(marks_of) or any(r.article and not r.other for r in runs):
        return
    total = 0
    for run, marks in zip(runs, marks_of, strict=True):
        if all(m.soft for m in marks):
            total += len(run.text)
            for mark in marks:
                mark.size += len(run.text)
    for run, marks in zip(runs, marks_of, strict=True):
        run.other = any(not m.soft or not (m.main or m.size >= (AROUND_ARTICLE if m.around else AROUND_TEXT) * total) for m in marks)


def shape_of(root: Node) -> str:
    """The tree as text; numbers its nodes in the same order as ``read_shape`` will."""
    parts: list[str] = []
    count = 0

    def visit(node: Node) -> None:
        nonlocal count
        node.number = count
        count += 1
        parts.append(node.label)
        if node.children:
            parts.append("(")
            for child in node.children:
                visit(child)
                parts.append(",")
            parts[-1] = ")"

    visit(root)
    return "".join(parts)


@lru_cache(maxsize=4096)
def read_shape(shape: str) -> Node:
    stack: list[Node] = []
    count = 0
    top = None
    for label, closing in re.findall(r"([^(),]*)([(),]|\Z)", shape):
        if label or top is None:
            node = Node(label, number=count)
            count += 1
            if stack:
                stack[-1].children.append(node)
            top = top or node
            latest = node
        if closing == "(":
            stack.append(latest)
        elif closing == ")":
            stack.pop()
    return top


def _hashes(root: Node) -> list[int]:
    """A number per node that is equal for equal subtrees only (but for collisions of 64 bits)."""
    out: dict[int, int] = {}

    def visit(node: Node) -> int:
        own = xxhash.xxh3_64_intdigest(repr((node.label, [visit(c) for c in node.children])).encode(errors="surrogatepass"))
        out[node.number] = own
        return own

    visit(root)
    return [out[n] for n in range(len(out))]


def align(shape: str, seed: str) -> dict[int, int]:
    """Nodes of a tree matched with nodes of the seed by simple tree matching.

    Equal subtrees at both ends of two lists of siblings are matched at once, which loses nothing.  Between them only siblings with equal
    labels are compared, by the heaviest increasing chain of such pairs; no pair is left out.
    """
    if (shape, seed) not in _aligned:
        pairs = _align(shape, seed)
        if sum(map(len, _aligned.values())) + len(pairs) > REMEMBERED_NODES:
            _aligned.clear()
        if len(pairs) > REMEMBERED_NODES:
            return pairs
        _aligned[shape, seed] = pairs
    return _aligned[shape, seed]


_aligned: dict[tuple[str, str], dict[int, int]] = {}


def _align(shape: str, seed: str) -> dict[int, int]:
    one, other = read_shape(shape), read_shape(seed)
    if shape == seed:
        return {n: n for n in range(_size(one))}
    hashes, others = _hashes(one), _hashes(other)
    sizes: dict[tuple[int, int], int] = {}

    def match(a: Node, b: Node) -> int:
        """Size of the best matching of two trees with equal roots."""
        if not a.children or not b.children:
            return 1
        key = (hashes[a.number], others[b.number])
        size = sizes.get(key)
        if size is None:
            size = 1 + _matched_children(a, b)[0]
            if len(sizes) >= REMEMBERED_NODES:
                sizes.clear()
            sizes[key] = size
        return size

    def _matched_children(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
        left, right = a.children, b.children
        start, short = 0, min(len(left), len(right))
        while start < short and hashes[left[start].number] == others[right[start].number]:
            start += 1
        end = 0
        while end < short - start and hashes[left[-1 - end].number] == others[right[-1 - end].number]:
            end += 1
        same = [*zip(left[:start], right[:start], strict=True), *zip(left[len(left) - end:], right[len(right) - end:], strict=True)]
        total, chain = _heaviest_chain(left[start:len(left) - end], right[start:len(right) - end])
        return total + sum(match(x, y) for x, y in same), same + chain

    def _heaviest_chain(left: list[Node], right: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        if not left or not right:
            return 0, []
        places: dict[str, list[int]] = {}
        for j, node in enumerate(right):
            places.setdefault(node.label, []).append(j)
        if sum(len(places.get(node.label, ())) for node in left) > MAX_PAIRS:
            return _chain_by_rows(left, right)
        candidates = [places.get(node.label, [])[::-1] for node in left]
        # tree[j]: the heaviest chain that ends before a place, as (weight, link), kept as a tree of prefix maxima.
        tree: list[tuple[int, tuple | None]] = [(0, None)] * (len(right) + 1)
        for i, found in enumerate(candidates):
            for j in found:
                best, at = (0, None), j
                while at > 0:
                    best, at = max(best, tree[at], key=lambda x: x[0]), at - (at & -at)
                grown = best[0] + match(left[i], right[j]), (i, j, best[1])
                at = j + 1
                while at <= len(right):
                    if tree[at][0] < grown[0]:
                        tree[at] = grown
                    at += at & -at
        best, at = (0, None), len(right)
        while at > 0:
            best, at = max(best, tree[at], key=lambda x: x[0]), at - (at & -at)
        chain, link = [], best[1]
        while link is not None:
            chain.append((left[link[0]], right[link[1]]))
            link = link[2]
        return best[0], chain

    def _chain_by_rows(left: list[Node], right: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        shared = {n.label for n in left} & {n.label for n in right}
        left, right = [n for n in left if n.label in shared], [n for n in right if n.label in shared]
        kinds, columns = {hashes[n.number]: n for n in left}, {others[n.number]: n for n in right}
        weights = np.array([[match(a, b) if a.label == b.label else 0 for b in columns.values()] for a in kinds.values()], np.int32)
        turn, column = {h: i for i, h in enumerate(kinds)}, {h: j for j, h in enumerate(columns)}
        chain = heaviest_chain(weights, np.array([turn[hashes[n.number]] for n in left]), np.array([column[others[n.number]] for n in right]))
        matched = [(left[i], right[j]) for i, j in chain]
        return sum(match(a, b) for a, b in matched), matched

    pairs: dict[int, int] = {}

    def trace(a: Node, b: Node) -> None:
        pairs[a.number] = b.number
        for x, y in _matched_children(a, b)[1]:
            trace(x, y)

    if one.label == other.label:
        trace(one, other)
    return pairs


def heaviest_chain(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A heaviest increasing chain of pairs (i, j), whose weights are ``weights[left[i], right[j]]``; 0 is no pair.

    The left half of the rows meets the columns before some place, the other half those from there on: the place is where the best chains of
    both halves weigh most together (Hirschberg).  Only one row of sums is held at a time.
    """
    if not len(left) or not len(right):
        return []
    if len(left) == 1:
        found = weights[left[0], right]
        return [(0, int(found.argmax()))] if found.any() else []
    half = len(left) // 2
    place = int((_best_before(weights, left[:half], right) + _best_before(weights, left[half:][::-1], right[::-1])[::-1]).argmax())
    return [*heaviest_chain(weights, left[:half], right[:place]),
            *((half + i, place + j) for i, j in heaviest_chain(weights, left[half:], right[place:]))]


def _best_before(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weight of the heaviest chain of all of ``left`` with the first 0, 1, 2, ... of ``right``."""
    best = np.zeros(len(right) + 1, np.int64)
    for kind in left:
        best[1:] = np.maximum(best[1:], best[:-1] + weights[kind, right])
        np.maximum.accumulate(best, out=best)
    return best


def places_of(shape: str, seed: str) -> dict[int, int]:
    """The place of every node in the seed, which grows by what it lacks: a node without a partner has its label's place below its parent's."""
    out = dict(align(shape, seed))
    below = [read_shape(shape)]
    out.setdefault(below[0].number, -1)
    while below:
        node = below.pop()
        for child in node.children:
            if child.number not in out:
                out[child.number] = -2 - (xxhash.xxh3_64_intdigest(f"{out[node.number]} {child.label}".encode(errors="surrogatepass")) >> 2)
        below += node.children
    return out


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.children))


def main_text(page: str | None, seed: str | None, constants: set[tuple[int, int]]) -> str:
    """Text blocks of the article, joined by line ends, without the host's template texts."""
    return _main_text(page, [] if seed is None else [(seed, constants)])


def _main_text(page: str | None, clusters: list[tuple[str, set[tuple[int, int]]]]) -> str:
    root, runs = parse(page or "")
    if not runs:
        return ""
    template = _template(root, runs, clusters)
    wanted = [r for r, fixed in zip(runs, template, strict=True) if not r.other and not fixed]
    # A page whose article is all template has no text of its own.
    if any(r.article and not r.other for r in runs):
        wanted = [r for r in wanted if r.article]
    else:
        linked: dict[int, list[int]] = {}
        for run in wanted:
            seen = linked.setdefault(id(run.node), [0, 0])
            seen[0] += run.linked
            seen[1] += len(run.text)
        wanted = [r for r in wanted if linked[id(r.node)][0] < LINK_SHARE * linked[id(r.node)][1]]
    return "\n".join(r.text for r in wanted)


def _template(root: Node, runs: list[Run], clusters: list[tuple[str, set[tuple[int, int]]]]) -> list[bool]:
    """Which runs are template: those of the first cluster that the page's tree belongs to."""
    if any(constants for _, constants in clusters):
        shape = shape_of(root)
        for seed, constants in clusters:
            if len(align(shape, seed)) >= ALIGNED_SHARE * _size(root):
                places = places_of(shape, seed)
                return [(places[r.node.number], _digest(r.text)) in constants for r in runs]
    return [False] * len(runs)


def _digest(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass"))).view(np.int64))


# ---------------------------------------------------------------- the operator

_SKELETON = StructType([StructField("host", StringType()), StructField("page", BinaryType()), StructField("shape", StringType()),
                        StructField("nodes", ArrayType(IntegerType())), StructField("texts", ArrayType(LongType())), StructField("inside", ArrayType(BooleanType()))])
_SEED = StructType([StructField("host", StringType()), StructField("seed", StringType()), StructField("turn", IntegerType())])
_MEMBER = StructType([StructField("host", StringType()), StructField("shape", StringType()), StructField("n", LongType()), StructField("seed", StringType()),
                      StructField("turn", IntegerType())])
# One row per page and node that it has (text null), and per text that stands there.
_PLACED = StructType([StructField("host", StringType()), StructField("seed", StringType()), StructField("node", LongType()), StructField("text", LongType()),
                      StructField("inside", BooleanType())])


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, shapes, nodes, texts, inside = [], [], [], [], []
        for page in batch.column(1).to_pylist():
            root, runs = parse(page or "")
            shapes.append(shape_of(root))
            # A page counts once per node and text.
            seen = {(r.node.number, _digest(r.text)): r.article for r in runs}
            nodes.append([n for n, _ in seen])
            texts.append([t for _, t in seen])
            inside.append(list(seen.values()))
            digests.append(xxhash.xxh3_128_digest((page or "").encode(errors="surrogatepass")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(shapes, pa.string()), pa.array(nodes, pa.list_(pa.int32())),
                                          pa.array(texts, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.bool_()))], names=_SKELETON.fieldNames())


def _belongs(shape: str, seed: str) -> bool:
    return len(align(shape, seed)) >= ALIGNED_SHARE * _size(read_shape(shape))


def _seeds(trees: pa.Table) -> pa.Table:
    """The trees of one host that belong to none of the seeds before them, in falling order of (n, shape)."""
    seeds: list[str] = []
    for _, shape in sorted(zip(trees.column("n").to_pylist(), trees.column("shape").to_pylist(), strict=True), reverse=True):
        if not any(_belongs(shape, seed) for seed in seeds):
            seeds.append(shape)
    host = trees.column("host")[0].as_py()
    return pa.table([pa.array([host] * len(seeds), pa.string()), pa.array(seeds, pa.string()), pa.array(range(len(seeds)), pa.int32())], names=_SEED.fieldNames())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [next(((s["seed"], s["turn"]) for s in seeds if _belongs(shape, s["seed"])), (None, None))
                 for shape, seeds in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s for s, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())],
                                         names=_MEMBER.fieldNames())


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for host, shape, seed, own, found, inside in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            places = places_of(shape, seed)
            here = {(places[n], t): i for n, t, i in zip(own, found, inside, strict=True)}
            out += [(host, seed, node, None, False) for node in {n for n, _ in here}]
            out += [(host, seed, node, text, i) for (node, text), i in here.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))],
                                         names=_PLACED.fieldNames())


def cluster_shapes(shapes: DataFrame) -> DataFrame:
    """Rows (host, shape, seed, turn) for the trees (host, shape, n pages) that belong to a cluster.

    A host's most frequent tree is the seed of all trees that align with it; the rest of the host is taken on with a seed of its
    own, and so on while it has pages enough for a template.  A round finds several of these seeds at once: among the most frequent
    trees left, every one that belongs to no seed before it.
    """
    found, rest, trees, before = None, shapes, FIRST_TREES, 0
    while True:
        enough = rest.groupBy("host").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= MIN_PAGES).select("host")
        frequent = best_rows(rest.join(enough, "host", "left_semi"), ["host"], [F.desc("n"), F.desc("shape")], trees)
        seeds = settled(frequent.groupBy("host").applyInArrow(_seeds, _SEED), "seeds")
        if seeds.isEmpty():
            break
        of_host = seeds.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + before).alias("turn"), "seed"))).alias("seeds"))
        judged = settled(in_small_batches(rest.join(of_host, "host").select("host", "shape", "n", "seeds")).mapInArrow(_members, _MEMBER), "clusters")
        members = judged.filter(F.col("seed").isNotNull()).select("host", "shape", "seed", "turn")
        found = members if found is None else found.unionByName(members)
        rest = judged.filter(F.col("seed").isNull()).select("host", "shape", "n")
        before, trees = before + trees, min(4 * trees, MOST_TREES)
    return shapes.select("host", "shape", F.lit(None).cast("string").alias("seed"), F.lit(0).alias("turn")).limit(0) if found is None else found


def induce_templates(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Rows (host, clusters): a host's clusters in the order in which they were found, each with its seed and the (node, text) pairs that are template.

    Evidence is counted over distinct pages, so copies prove nothing.  A text outside articles is held against the pages of the
    cluster that have its node, one inside an article against all pages of the cluster.
    """
    read = pages.select(F.col(host).alias("host"), html).mapInArrow(_skeletons, _SKELETON)
    distinct = settled(read, "skeletons").dropDuplicates(["host", "page"])
    shapes = settled(distinct.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")), "shapes")
    clusters = settled(cluster_shapes(shapes), "clustered")
    sizes = clusters.join(shapes, ["host", "shape"]).groupBy("host", "seed", "turn").agg(F.sum("n").alias("pages"))
    counted = settled(distinct.join(clusters, ["host", "shape"]).select("host", "shape", "seed", "nodes", "texts", "inside")
                      .mapInArrow(_placed, _PLACED).groupBy("host", "seed", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.bool_or("inside").alias("inside")), "placed")
    holders = counted.filter("text IS NULL").select("host", "seed", "node", F.col("n").alias("holders"))
    of = F.when(F.col("inside"), F.col("pages")).otherwise(F.col("holders"))
    constant = counted.filter("text IS NOT NULL").join(holders, ["host", "seed", "node"]).join(sizes, ["host", "seed"]).filter(
        (of >= MIN_PAGES) & (F.col("n") >= CONSTANT_SHARE * of)).groupBy("host", "seed").agg(F.collect_list(F.struct("node", "text")).alias("constants"))
    # Clusters after the last one with a template decide nothing.
    last = F.max(F.when(F.col("constants").isNotNull(), F.col("turn"))).over(Window.partitionBy("host"))
    needed = sizes.join(constant, ["host", "seed"], "left").withColumn("last", last).filter(F.col("turn") <= F.col("last"))
    return needed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("turn", "seed", "constants"))).alias("clusters"))


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", n_chars: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default all) columns of ``pages`` with the article's text and its length in code points.

    Null and empty pages, and pages with no text of their own, give an empty text.  Long pages are read whole, in time that grows with
    their length (alignments: with the number of pairs of siblings that have equal labels).  Pages without a host form a group
    of their own.  Repeated rows are extracted alike.  Columns named like the results are replaced.
    """
    replaced = {text.lower(), n_chars.lower()}
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in replaced]
    own, held = (fresh(pages, x) for x in ("page_host", "page_clusters"))
    hosted = pages.withColumn(own, host_and_path(F.col(url))[0])
    templates = settled(induce_templates(hosted, own, html), "templates").toDF(own, held)
    joined = hosted.join(templates, own, "left")

    def extract(bodies: pa.Array, clusters: pa.Array) -> list[pa.Array]:
        out: list[str] = []
        held, read = None, []
        for body, own_clusters in zip(bodies.to_pylist(), clusters, strict=True):
            if held is None or not held.equals(own_clusters):  # pages of a host often follow each other
                held, read = own_clusters, [(c["seed"], {(x["node"], x["text"]) for x in c["constants"] or ()}) for c in own_clusters.as_py() or ()]
            out.append(_main_text(body, read))
        return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

    return with_arrow(joined, [html, held], StructType([StructField(text, StringType()), StructField(n_chars, LongType())]), extract, kept)
