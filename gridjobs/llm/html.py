"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host (operator 3).

A page's token stream is read as nested sequences. Pages of a host are aligned one after the other with the expression that
the earlier ones gave: equal tags match, different texts become slots, and where tags differ, what repeats becomes a repeated
group and what is missing on one side becomes optional. The host's expression then tells which part of its pages varies: the
elements that hold the slots are the main text, and what is constant on the host is no part of it where no element is named for
the article.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
ATTR = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([\w-]+)""")
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset("head nav footer aside form script style noscript iframe template button select textarea input svg math dialog menu object embed canvas audio video title xmp noframes noembed option".split())
#: Words in class, id or role that mark what isn't the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notifications?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|aside|widget\w*|menu\w*|nav\w*|breadcrumbs?|toolbar|footer|foot|masthead|topbar|comments?|respond|replies|discussion|disqus|share|sharing|social|related|recommend\w*|more-?stories|search|pagination|pager|tags|complementary|contentinfo|navigation|skip-?link)(?:$|[\s_-])",
    re.I,
)
#: Marks of articles that aren't the page's own, and names that an element of the article may have beside others.
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies|related|recommend\w*|teasers?)(?:$|[\s_-])", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OWN = frozenset("content main article post entry story main-content entry-content post-content article-body".split())
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])", re.I)
BODY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|article-?body|post-?body|entry-?content|post-?content|main-?content|page-?content|text)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")
#: Elements that an end tag doesn't reach across, but for those of the page's frame.
WALLS = frozenset("td th table article body".split())
FRAME = frozenset("article body html table main section div tr".split())
#: Hosts whose expressions one task holds at a time, and partial expressions of a host that are merged in one task first.
HOSTS, FAN_IN = 2_000, 64
#: Elements of one expression from which it is generalised (repeats are folded, long sequences become bags, labels lose marks).
ELEMENTS, WIDE = 2_000, 16
#: Levels of an expression; deeper elements melt into the one around them, as inline elements do.
LEVELS = 48
#: Cells of an alignment's table; longer sequences are first cut at labels that each side has once.
CELLS = 40_000
#: Longest group that is looked for as a repetition.
PERIOD = 8
#: Share of the slots' text that an element without a name must hold to be the main text.
MOST = 0.8
#: Names that mark noise but may as well belong to what an article says: inside one they count only where they stand alone.
VAGUE = re.compile(r"related|search|side|tags|social|menus?|alert|discussion|notices?|banner|navigation", re.I)
#: Pages of a host from which a text that all of them have is no part of its articles; headings are.
SAME = 3
#: Total size of the rules up to which they are broadcast.
BROADCAST_CHARS = 16_000_000


@dataclass(slots=True)
class Node:
    name: str
    mark: str = ""
    label: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)


class Open:
    """Open elements, and where each kind of them stands, so that no tag searches through all of them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}
        self.walls, self.solid = [0], [0]

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.where.setdefault(node.name, []).append(k)
        if node.name in WALLS:
            self.walls.append(k)
        if node.name not in INLINE and node.name != "p":
            self.solid.append(k)
        self.stack.append(node)

    def close(self, k: int) -> None:
        """End the element at place ``k`` and all inside it."""
        while len(self.stack) > k:
            self.where[self.stack.pop().name].pop()
        while self.walls[-1] >= k:
            self.walls.pop()
        while self.solid[-1] >= k:
            self.solid.pop()


def parse(page: str) -> Node:
    """Nested elements and texts of a page; missing end tags are put in where the tags around demand it."""
    root = Node("#", label="#")
    open_ = Open(root)
    stack = open_.stack
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m["close"]:
            k = open_.last(name)
            if k and (name in FRAME or open_.walls[-1] <= k):
                open_.close(k)
            continue
        if name in CLOSES_P and (k := open_.last("p")) > open_.solid[-1]:
            open_.close(k)
        if name in ENDS_ITEM and (k := open_.last(*ENDS_ITEM[name])) > open_.last(*SCOPES[name]):
            open_.close(k)
        node = Node(name, label=name)
        if m["attrs"] and not m["attrs"].isspace():
            found = {(a or c).lower(): b.strip("\"'") for a, b, c in ATTR.findall(m["attrs"])}
            node.mark = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
            node.label = label(name, found)
            style = found.get("style", "").replace(" ", "").lower()
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
        stack[-1].parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif name not in VOID and not m["attrs"].endswith("/"):
            open_.push(node)
    if at < len(page):
        stack[-1].parts.append(entities.unescape(page[at:]))
    return root


def label(name: str, found: dict[str, str]) -> str:
    """What an element is compared by: its name and classes without their numbers, and of its id and role (which may be its own
    on every page) the words that say what it is for."""
    marks = [re.sub(r"[0-9]+", "0", c) for c in found.get("class", "").split()]
    marks += [w for k in ("id", "role") for w in found.get(k, "").split() if any(v.search(w) for v in (NOISE, HEADER, BODY)) or w in OWN]
    return ".".join([name, *dict.fromkeys(marks)])


# An expression is [label, quantifier, text, parts, mass, n]: the quantifier is "", "?", "+" or "*"; text is None (no text), a
# constant, or True for a slot; parts are expressions in order; mass is the length of its own text outside links on all pages,
# and n how often it was seen. A group of several elements has no label of its own but theirs in brackets; a bag, "(*)", is a
# repeated group of optional elements in any number.

BAG = "(*)"


def joined_text(a, b):
    """Equal constants stay; anything else is a slot."""
    return a if a == b else b if a is None else a if b is None else True


def digest(text: str) -> str:
    return text if len(text) <= 80 else hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()


def lines(text: list) -> str:
    """Texts of an element, those apart that a block stands between (None)."""
    out, line = [], []
    for t in [*text, None]:
        if t is None:
            if said := WHITE.sub(" ", "".join(line)).strip():
                out.append(said)
            line = []
        else:
            line.append(t)
    return "\n".join(map(digest, out))


def express(node: Node, level: int = 0) -> list:
    """Expression of one page's element; inline elements melt into the text around them, what isn't the article keeps no parts."""
    text, parts, mass = [], [], 0
    todo = [(iter(node.parts), False)]
    while todo:
        it, link = todo[-1]
        p = next(it, None)
        if p is None:
            todo.pop()
        elif isinstance(p, str):
            text.append(p)
            mass += 0 if link else len(p.strip())
        elif p.hidden or p.name in ("script", "style", "meta", "link"):
            continue
        elif p.name == "br":
            text.append(" ")
        elif p.name in INLINE:
            if not (p.mark and NOISE.search(p.mark)):
                todo.append((iter(p.parts), link or p.name == "a"))
        elif is_noise(p.name, p.mark, level > 0 and node.name == "article") and not vague(p.name, p.mark):
            text.append(None)
            parts.append([p.label, "", None, [], 0, 1])
        elif level < LEVELS or level == LEVELS and container(p.name, p.mark):
            text.append(None)
            parts.append(express(p, level + 1))
        else:
            text.append(None)
            todo.append((iter(p.parts), link))
    return [node.label, "", lines(text) or None, parts, mass, 1]


def loosest(a: str, b: str) -> str:
    many, none = any(x in "+*" and x for x in (a, b)), any(x in "?*" and x for x in (a, b))
    return "*" if many and none else "+" if many else "?" if none else ""


def merged(a: list, b: list) -> list:
    return [a[0], loosest(a[1], b[1]), joined_text(a[2], b[2]), aligned(a[3], b[3]), a[4] + b[4], a[5] + b[5]]


def optional(p: list) -> list:
    return [p[0], loosest(p[1], "?"), *p[2:]]


def repeated(p: list) -> list:
    return [p[0], "*" if p[1] in ("?", "*") and p[1] else "+", *p[2:]]


def group(unit: list[list]) -> list:
    """Several elements in a row as one; a single one is itself."""
    return unit[0] if len(unit) == 1 else [f"({' '.join(p[0] for p in unit)})", "", None, unit, 0, 1]


def folded(parts: list) -> list:
    """Adjacent elements, and adjacent groups of up to ``PERIOD`` elements, of the same labels become one repeated element or group."""
    for period in range(1, PERIOD + 1):
        names = [p[0] for p in parts]
        out: list = []
        k = 0
        while k < len(parts):
            n = 1
            while names[k : k + period] == names[k + n * period : k + (n + 1) * period] and k + (n + 1) * period <= len(parts):
                n += 1
            if n == 1 or BAG in names[k : k + period]:
                out.append(parts[k])
                k += 1
                continue
            units = [group(parts[k + i * period : k + (i + 1) * period]) for i in range(n)]
            whole = units[0]
            for u in units[1:]:
                whole = merged(whole, u)
            out.append(repeated(whole))
            k += n * period
        parts = out
    return parts


def bag(*sides: list) -> list:
    """All elements of some sequences, those of a label merged, as a repeated group of optional ones."""
    found: dict[str, list] = {}
    todo = [p for side in reversed(sides) for p in reversed(side)]
    while todo:
        p = todo.pop()
        if p[0].startswith("("):
            todo += reversed(p[3])
        else:
            found[p[0]] = optional(merged(found[p[0]], p)) if p[0] in found else optional(p)
    return [BAG, "*", None, [found[k] for k in sorted(found)], 0, 1]


def grouped(parts: list, units: dict[str, int]) -> list:
    """Single occurrences of the other side's groups as groups."""
    out, k = [], 0
    while k < len(parts):
        n = next((n for name, n in units.items() if k + n <= len(parts) and f"({' '.join(p[0] for p in parts[k : k + n])})" == name), 0)
        out.append(group(parts[k : k + n]) if n else parts[k])
        k += n or 1
    return out


def aligned(a: list, b: list) -> list:
    """One sequence for both: parts that match are merged, repetitions folded where the sides differ, what one side lacks optional."""
    if [p[0] for p in a] == [p[0] for p in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    if any(p[0] == BAG for p in a + b):
        return [bag(a, b)]
    # what is the same on both sides, text included, and there only once, stays out of repetitions
    said = Counter((p[0], p[2]) for p in a) | Counter((p[0], p[2]) for p in b)
    same = lambda x, y: x[0] == y[0] and isinstance(x[2], str) and x[2] == y[2] and said[x[0], x[2]] == 1
    n, m = 0, 0
    while n < min(len(a), len(b)) and same(a[n], b[n]):
        n += 1
    while m < min(len(a), len(b)) - n and same(a[-1 - m], b[-1 - m]):
        m += 1
    ends = lambda x: (x[:n], x[len(x) - m :])
    (a0, a1), (b0, b1) = ends(a), ends(b)
    a, b = folded(a[n : len(a) - m]), folded(b[n : len(b) - m])
    for x, y in ((a, b), (b, a)):
        if units := {p[0]: len(p[3]) for p in x if p[0].startswith("(")}:
            y[:] = folded(grouped(y, units))
    middle = matched(a, b)
    return [*map(merged, a0, b0), *middle, *map(merged, a1, b1)]


def matched(a: list, b: list) -> list:
    """Parts in an order that keeps a longest common sequence of labels; where the table for that would be too large, the sides
    are cut at labels that each has once, and what has none becomes a bag."""
    la, lb = [p[0] for p in a], [p[0] for p in b]
    if la == lb:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    if len(a) * len(b) > CELLS:
        return _cut_at_anchors(a, b, la, lb)
    n, m = len(la), len(lb)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if la[i] == lb[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if la[i] == lb[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return out + [optional(p) for p in a[i:]] + [optional(p) for p in b[j:]]


def _cut_at_anchors(a: list, b: list, la: list[str], lb: list[str]) -> list:
    ca, cb = Counter(la), Counter(lb)
    place = {x: j for j, x in enumerate(lb) if cb[x] == 1}
    both = [(i, place[x]) for i, x in enumerate(la) if ca[x] == 1 and x in place]
    tails: list[int] = []  # longest rising run of places
    back: list[tuple[int, int]] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
        back.append((ends[at - 1] if at else -1, k))
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(both[k])
        k = back[k][0]
    if not chain:
        return [bag(a, b)]
    out, i0, j0 = [], 0, 0
    for i, j in reversed(chain):
        out += _between(a[i0:i], b[j0:j]) + [merged(a[i], b[j])]
        i0, j0 = i + 1, j + 1
    out += _between(a[i0:], b[j0:])
    return [bag(out)] if any(p[0] == BAG for p in out) else out


def _between(a: list, b: list) -> list:
    if not a or not b:
        return [optional(p) for p in a or b]
    return [bag(a, b)] if len(a) * len(b) > CELLS else matched(a, b)


def elements(e: list) -> int:
    return 1 + sum(elements(p) for p in e[3])


def bounded(e: list) -> list:
    """An expression of more than ``ELEMENTS`` elements, generalised: all levels and slots stay, only order and marks are given up."""
    for how in (folded, lambda parts: [bag(parts)] if len(parts) > WIDE else parts, lambda parts: [bag(parts)] if parts else parts, _plain):
        if elements(e) <= ELEMENTS:
            break
        e = _changed(e, how)
    return e


def _changed(e: list, how) -> list:
    return [*e[:3], how([_changed(p, how) for p in e[3]]), *e[4:]]


def _plain(parts: list) -> list:
    """Elements of a bag told apart by their names and what these say, no longer by other marks."""
    known = lambda lab: ".".join(w for k, w in enumerate(lab.split(".")) if not k or any(v.search(w) for v in (NOISE, HEADER, BODY)) or w in OWN)
    return [bag([[p[0] if p[0].startswith("(") else known(p[0]), *p[1:]] for p in parts])] if parts else parts


def pattern(e: list) -> str:
    """The expression as text: tags, #slot for varying text, groups with ? + *."""
    inner = ("#slot" if e[2] is True else e[2] or "") + "".join(pattern(p) for p in e[3])
    if e[0].startswith("("):
        return f"({inner}){e[1]}"
    return f"(<{e[0]}>{inner}</>){e[1]}" if e[1] else f"<{e[0]}>{inner}</>"


def name_of(lab: str) -> tuple[str, str]:
    name, _, mark = lab.partition(".")
    return name, mark.replace(".", " ")


def is_noise(name: str, mark: str, inside: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header" and not inside:
        return True
    if not mark or name in ("main", "body", "html") or not OWN.isdisjoint(mark.lower().split()):
        return False
    if name == "article":
        return bool(OTHERS.search(mark))
    return bool(NOISE.search(mark) or (not inside and HEADER.search(mark)))


def vague(name: str, mark: str) -> bool:
    """Whether an element is marked as noise only by words that may be an article's own, beside others (as in ``related work``)."""
    words = mark.split()
    noise = [w for w in words if NOISE.search(w)]
    return name not in DROPPED and 0 < len(noise) < len(words) and all(VAGUE.fullmatch(w) for w in noise)


def container(name: str, mark: str) -> str | None:
    """article, main or marked for an element that may be named for the main text."""
    return "article" if name == "article" else "main" if name == "main" or "main" in mark.split() and name != "body" else "marked" if BODY.search(mark) and name in ("div", "section", "td") else None


def content_rule(e: list, same: Iterable[str] = ()) -> dict:
    """Where a host's main text is.

    {"labels": ..., "same": ..., "own": ...}: elements of these labels, wherever they stand: the host's articles with slots, else its
    main element, else the element marked as content with most of the slots' text; without the texts ``same``, which all pages of
    the host have, and with elements of the labels ``own``, whose vague marks (see ``vague``) their slots outweigh. Otherwise {"path": ..., "constants": ...}: the smallest element
    that holds most of the slots' text, by the labels of the elements around it, without blocks that are constant on the host or
    links only. Text counts as constant if it was seen twice at least and never differed; links don't count.
    """
    found: dict[str, dict[str, int]] = {"article": {}, "main": {}, "marked": {}}
    constants: set[str] = set()
    own: set[str] = set()

    def weigh(x: list) -> tuple[int, list]:
        """Slots' text of an element, and the same for its parts."""
        name, mark = name_of(x[0])
        plain = not x[0].startswith("(")
        if plain and is_noise(name, mark, False):
            if x[3] or x[2] and not (isinstance(x[2], str) and x[5] > 1):
                before = {k: dict(v) for k, v in found.items()}
                if x[4] or any(weigh(p)[0] for p in x[3]):
                    own.add(x[0])
                found.update(before)
            return 0, []
        fixed = isinstance(x[2], str) and x[5] > 1
        if fixed:
            constants.update(x[2].split("\n"))
        parts = [(*weigh(p), p) for p in x[3]]
        inside = (0 if fixed else x[4]) + sum(p[0] for p in parts)
        if plain and inside:
            if kind := container(name, mark):
                found[kind][x[0]] = max(inside, found[kind].get(x[0], 0))
        return inside, parts

    total, parts = weigh(e)
    more = {"same": sorted(same), "own": sorted(own)}
    for k in ("article", "main"):
        if found[k]:
            return {"labels": sorted(found[k]), **more}
    if found["marked"]:
        return {"labels": [min(found["marked"], key=lambda k: (-found["marked"][k], len(k), k))], **more}
    path, at, open_ = [], 0, parts
    while open_:  # groups are no level of their own
        inside, below, p = max(open_, key=lambda x: x[0])
        if inside < MOST * total or not total or not any(q[0] for q in below) and not p[0].startswith("("):
            break
        open_ = below
        if not p[0].startswith("("):
            path.append(p[0])
    return {"path": path, "constants": sorted(constants)}


def blocks(root: Node, rule: dict) -> list[str]:
    """Texts of the blocks under the elements of the rule, in page order."""
    out: list[str] = []
    line: list[str] = []
    wanted, path, constants = frozenset(rule.get("labels", ())), rule.get("path"), frozenset(rule.get("constants", ()))
    same, meant = frozenset(rule.get("same", ())), frozenset(rule.get("own", ()))

    plain: list[str] = []  # what of the line stands outside links

    def end() -> None:
        said, own = WHITE.sub(" ", "".join(line)).strip(), "".join(plain).strip()
        line.clear()
        plain.clear()
        if said and (own and digest(said) not in constants if path is not None else headings or not same or digest(said) not in same):
            out.append(said)

    # parts to come, whether they are the main text, the name of their element if it ends a block, how much of the path led to it,
    # and whether it stands in a link
    todo = [(iter(root.parts), path == [], "", 0, False)]
    headings = 0  # how many are open
    while todo:
        it, inside, block, depth, link = todo[-1]
        p = next(it, None)
        if p is None:
            todo.pop()
            if block:
                end()
                headings -= block in HEADINGS
        elif isinstance(p, str):
            if inside:
                line.append(p)
                if not link:
                    plain.append(p)
        elif p.hidden:
            continue
        elif p.name == "br":
            line.append("\n")
        elif p.name in INLINE:
            if not (p.mark and NOISE.search(p.mark)):
                todo.append((iter(p.parts), inside, "", depth, link or p.name == "a"))
        elif not is_noise(p.name, p.mark, inside) or inside and p.label in meant and vague(p.name, p.mark):
            if inside:
                end()
            led = depth + 1 if path and 0 <= depth < len(path) and p.label == path[depth] else -1
            into = inside or p.label in wanted or bool(path) and led == len(path)
            headings += into and p.name in HEADINGS
            todo.append((iter(p.parts), into, p.name if into else "", led, link))
    end()
    return out


def extract(page: str, rule: dict | None) -> str:
    """Main text of a page under its host's rule; a page on which the rule finds nothing falls back to its own expression."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    found = blocks(root, rule) if rule else []
    if not found:
        found = blocks(root, content_rule(express(root)))
    return "\n".join(found)


def texts_of(e: list) -> set[str]:
    """Texts (or their digests) of all elements of one page's expression."""
    out: set[str] = set()
    todo = [e]
    while todo:
        x = todo.pop()
        if isinstance(x[2], str):
            out.update(x[2].split("\n"))
        todo += x[3]
    return out


#: An expression, how many pages it is of, and the texts that all of them have.
WRAPPER = "host string, expression string, pages long, same array<string>"


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages -> one expression for each host of the partition."""
    held: dict[str, tuple[list, int, set[str]]] = {}
    flush = lambda: pd.DataFrame([(h, json.dumps(e, ensure_ascii=False), n, sorted(same)) for h, (e, n, same) in held.items()], columns=["host", "expression", "pages", "same"])
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            e = express(parse(page))
            same, e = texts_of(e), bounded(e)
            old = held.get(host)
            held[host] = (bounded(merged(old[0], e)), old[1] + 1, old[2] & same) if old else (e, 1, same)
            if len(held) >= HOSTS:
                yield flush()
                held.clear()
    if held:
        yield flush()


def _merge(group_: pd.DataFrame) -> pd.DataFrame:
    group_ = group_.sort_values("expression")
    out = None
    for x in map(json.loads, group_["expression"]):
        out = x if out is None else bounded(merged(out, x))
    same = set.intersection(*map(set, group_["same"]))
    return pd.DataFrame({"host": group_["host"].iloc[:1], "expression": [json.dumps(out, ensure_ascii=False)], "pages": [group_["pages"].sum()], "same": [sorted(same)]})


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, expression, pages, same) of every host: the union-free expression that all its pages match, and the texts that all have.

    Each task aligns its own pages host by host, so what is shuffled is one bounded expression for a host and task. Those of a host of
    any size are merged in levels: ``FAN_IN`` of neighbouring tasks in one, until a host has no more than that. Null and empty pages
    take no part; pages without a host share the host "".
    """
    p = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where("html is not null and trim(html) <> ''")
    parts = p.rdd.getNumPartitions()
    level = p.mapInPandas(_partial, WRAPPER).withColumn("slice", F.spark_partition_id())
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        level = level.withColumn("slice", F.floor(F.col("slice") / FAN_IN).cast("int"))
        level = level.groupBy("host", "slice").applyInPandas(lambda g: _merge(g).assign(slice=g["slice"].iloc[0]), f"{WRAPPER}, slice int")
    return level.groupBy("host").applyInPandas(lambda g: _merge(g), WRAPPER)


def _texts(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rules = [json.loads(r) if r else None for r in batch.column("_rule").to_pylist()]
            text = [extract(p or "", r) for p, r in zip(batch.column("_html").to_pylist(), rules, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(text, pa.string())], names=[*columns, "text"])

    return run


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        told = zip(batch["expression"], batch["same"], batch["pages"], strict=True)
        yield pd.DataFrame({"host": batch["host"], "_rule": [json.dumps(content_rule(json.loads(e), same if n >= SAME else ())) for e, same, n in told]})


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", url: str = "url") -> DataFrame:
    """``keep`` columns and the main text of every page: its blocks joined by line ends, empty where there is none.

    Null and empty pages give an empty text, pages of an unknown host use their own expression. Repeated pages give repeated
    rows; an empty table gives an empty one; other columns are not read. Elements may be nested to any depth. The rules of the hosts are a few words each: they are
    broadcast where their summed size allows, and otherwise joined by host, where a hot host's side can be split.
    """
    rules = cut(wrappers(pages, html, url).mapInPandas(_rules, "host string, _rule string"))
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("_rule")), F.lit(0))).first()[0]
    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes)
    p = pages.select(*keep, F.col(html).alias("_html"), host_of(url).alias("host"))
    told = p.join(F.broadcast(rules) if size <= BROADCAST_CHARS else rules, "host", "left")
    return told.mapInArrow(_texts(list(keep)), f"{kinds}, text string")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
