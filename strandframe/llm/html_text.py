"""Operator 6: main text by tag-path ratios.

Text nodes are pooled by root-to-leaf tag path (names with classes). Each path has a text length and a punctuation
count per node; both are smoothed over neighbouring paths in page order, fused by their product, and thresholded at
a share of the mean. The content container is the deepest path that holds most of the selected text, whatever its tag;
an article or main around it takes its place only where that adds mostly headings or text that passes by itself.
All its blocks outside menus, headers, footers, sidebars, notices, adverts, forms and comments make the text, and none
is capped. Such places are known by tag or by a whole class, id or role name (sidebar-left, not has-sidebar), and a
named one or a form that holds an article, a main or most of the selected text stays; adverts, comments and the like
stay only around a main.
Null or empty html gives an empty text; repeated rows give equal rows; extra columns are ignored.
"""
import functools
import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?![a-zA-Z/!?])|<[^<>]*$|<|[^<]+", re.S)
#: without quotes: for pages in which the ends of many tags are lost
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?([a-zA-Z][^\s/><]*)([^<>]*)>?|<|[^<]+", re.S)
SHARE = 0.5  # of the mean of all paths, that a path of the story reaches
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
DROP = frozenset("head nav header footer aside form script style noscript template select button iframe textarea svg title menu dialog object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = re.compile(r"ads?|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|sidebar|menu|nav[^\W_]*|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|reply|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|widget|toolbar|copyright|complementary|contentinfo|navigation")
#: texts of other people: they may be longer than the story and are dropped all the same
_ALIEN = re.compile(r"ads?|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|comments?|disqus|replies|reply|cookies?|consent|popup|modal|newsletter|subscribe|related|recommended")
#: what may stand beside such a word in a class name that still names boilerplate (has-, with-, no-, post-, entry- may not)
_PLAIN = frozenset("site main global top bottom left right primary secondary fixed sticky mobile desktop block box bar area container wrapper wrap inner outer list item items link links button buttons icon icons slot unit zone text message title posts stories articles thread form".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_PUNCT = re.compile(r"[.,;:!?。、，！？]")


@functools.lru_cache(1 << 14)
def named(marks: str, inside: bool) -> str:
    """a for the name of an alien text, m for that of other boilerplate, by whole class, id and role names; headers inside an article or main are its own."""
    kinds = ""
    for name in marks.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        bad = [x for x in parts if _BAD.fullmatch(x)]
        if bad and all(x in bad or x in _PLAIN or x.isdigit() for x in parts) and not (inside and set(bad) <= {"header", "masthead"}):
            kinds += "a" if any(map(_ALIEN.fullmatch, bad)) else "m"
    return kinds and min(kinds)


class Tree:
    """Tag paths as nodes: elements of one tag, drop kind and marks under one parent are one. A parent's number is below its children's."""

    def __init__(self):
        self.parent, self.tag, self.drop, self.outer, self.x, self.alien, self.head, self.child = [0], [""], [""], [-1], [False], [False], [False], {}

    def get(self, up: int, tag: str, drop: str, marks: str) -> int:
        at = self.child.setdefault((up, tag, drop, marks), len(self.parent))
        if at == len(self.parent):
            self.parent.append(up)
            self.tag.append(tag)
            self.drop.append(drop)
            # the outermost article or main around it, and what holds for all that is inside
            self.outer.append(self.outer[up] if self.outer[up] >= 0 or tag not in ("article", "main") else at)
            self.x.append(self.x[up] or drop == "x")
            self.alien.append(self.alien[up] or drop == "a")
            self.head.append(self.head[up] or tag in HEADS)
        return at

    def up(self, values: list) -> list:
        """Each node's sum over its subtree."""
        for k in range(len(values) - 1, 0, -1):
            values[self.parent[k]] += values[k]
        return values

    def under(self, tops) -> list:
        """Whether each node is one of tops or inside one."""
        out = [k in tops for k in range(len(self.parent))]
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out


def nodes(page: str) -> tuple[Tree, list]:
    """The tree, and (path, text, block number) of each text node; drop is x (by tag), m or a (by name, and forms) or empty. Linear in the page."""
    tree, stack, open_ = Tree(), [0], {}
    block, raw, out = 0, None, []
    at = failed = 0

    def pop():
        k = stack.pop()
        open_[tree.tag[k]] -= 1
        return k

    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at, raw = (end.end() if end else len(page)), None
            pop()
            continue
        m = (_TOKEN if failed < 50 else _LOOSE).match(page, at)
        if m[0] == "<" and page[at + 1 : at + 2].isalpha():  # no end of this tag: after some of these quotes no longer count
            failed += 1
        at, s, tag = m.end(), m[0], m[1]
        if tag is None:
            if s[0] != "<" or s == "<":
                out.append((stack[-1], s, block))
            continue
        tag = tag.lower()
        if tag not in INLINE or tag in ("hr",):
            block += 1
        if s[1] == "/":
            if open_.get(tag):
                while tree.tag[pop()] != tag:
                    pass
            continue
        if tag == "br":
            out.append((stack[-1], " ", block))
        if tag in VOID:
            continue
        if tag in _CLOSES_P and open_.get("p"):
            while tree.tag[pop()] != "p":
                pass
        if tag in _SELF and any(map(open_.get, (tag, "dt", "dd", "td", "th"))):
            for j in range(len(stack) - 1, 0, -1):
                name = tree.tag[stack[j]]
                if name in _SELF[tag]:
                    break
                if name == tag or {name, tag} in ({"dt", "dd"}, {"td", "th"}):
                    while len(stack) > j:
                        pop()
                    break
        marks = " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(m[2])) if "=" in m[2] else ""
        inside = bool(open_.get("article") or open_.get("main"))
        drop = named(marks, inside) if marks and tag not in ("html", "body", "article", "main") else ""
        if tag in DROP and not (tag == "header" and open_.get("article")):
            drop = "x" if tag != "form" else drop or "m"
        stack.append(tree.get(stack[-1], tag, drop, marks))
        open_[tag] = open_.get(tag, 0) + 1
        if tag in RAW and not s.endswith("/>"):
            raw = tag
    return tree, out


def select(found: list) -> tuple:
    """Sizes by path, the paths with text, their sizes and punctuation a node, the threshold and the paths over it."""
    stats: dict = {}
    for p, t, _ in found:
        s = stats.setdefault(p, [0, 0, 0])
        k = len(t.strip())
        if k:
            s[0] += k
            s[1] += len(_PUNCT.findall(t))
            s[2] += 1
    paths = [p for p, s in stats.items() if s[2]]
    size, punct = [stats[p][0] / stats[p][2] for p in paths], [(1 + stats[p][1]) / stats[p][2] for p in paths]

    def smooth(v):  # a path's own value counts four times as much as a neighbour's in page order
        return [(4 * x + sum(near := v[max(0, i - 1) : i] + v[i + 1 : i + 2])) / (4 + len(near)) for i, x in enumerate(v)]

    fused = [a * b for a, b in zip(smooth(size), smooth(punct), strict=True)]
    least = SHARE * sum(fused) / max(1, len(fused))
    return stats, paths, size, punct, least, [p for p, f in zip(paths, fused, strict=True) if f >= least]


def held(tree: Tree, chosen: list, stats: dict) -> list:
    """Selected text under each path."""
    weight = [0] * len(tree.parent)
    for p in chosen:
        weight[p] = stats[p][0]
    return tree.up(weight)


def holders(tree: Tree, found: list) -> set:
    """Marked elements that stay: outermost ones around a main, and, but for alien texts, around an article or most of the selected text."""
    stats, paths, _, _, _, chosen = select(found)
    weight = held(tree, chosen, stats)
    some, main = [0] * len(weight), [0] * len(weight)
    for p in paths:
        o = tree.outer[p]
        if o > 0:
            some[tree.parent[o]] = 1
            main[tree.parent[o]] |= tree.tag[o] == "main"
    some, main = tree.up(some), tree.up(main)
    return {q for q, d in enumerate(tree.drop) if d and (some[q] and tree.outer[q] < 0 and (d == "m" or main[q]) or d == "m" and 2 * weight[q] > weight[0])}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree, found = nodes(page)
    found = [(p, _html.unescape(t), b) for p, t, b in found if not tree.x[p]]
    if any(tree.drop):
        kept = holders(tree, found)
        lost = tree.under({q for q, d in enumerate(tree.drop) if d and q not in kept})
        story = [f for f in found if not lost[f[0]]]
        found = story if any(t.strip() for _, t, _ in story) else [f for f in found if not tree.alien[f[0]]]
    stats, paths, size, punct, least, chosen = select(found)
    if not paths:
        return ""
    weight, depth, box = held(tree, chosen, stats), [0] * len(tree.parent), 0
    for k in range(1, len(depth)):  # the deepest path that holds most of the selected text
        depth[k] = depth[tree.parent[k]] + 1
        if weight[k] >= 0.6 * weight[0] and depth[k] > depth[box] and tree.tag[k] not in INLINE and tree.tag[k] not in ("p", "h1", "h2", "h3", "li"):
            box = k
    top = box
    while top and tree.tag[top] not in ("article", "main"):
        top = tree.parent[top]
    inside = tree.under({box})
    if top:  # the article or main around the box, if what it adds is mostly headings or text that passes unsmoothed
        own = {p for p, a, b in zip(paths, size, punct, strict=True) if a * b >= least}
        around = tree.under({top})
        more = [p for p in paths if around[p] and not inside[p]]
        if 2 * sum(stats[p][0] for p in more if p in own or tree.head[p]) >= sum(stats[p][0] for p in more):
            inside = around
    blocks: dict = {}
    for p, t, b in found:
        if inside[p]:
            blocks.setdefault(b, []).append(t)
    return "\n".join(x for x in (" ".join("".join(v).split()) for v in blocks.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 200):
                p = b.slice(a, 200)
                text = [main_text(x) for x in p.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
