"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; elements that never belong to an article.
RAW = frozenset("script style textarea title xmp noframes".split())
NOISE = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside menu button select textarea input dialog".split())
#: Elements that are noise unless they hold the article or, of a header inside of one, its title.
WEIGHED = frozenset({"form", "header"})
#: Words of class or id, and roles, that mark what is no article.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars rail widget widgets menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager header masthead footer comment comments disqus reply replies respond discussion share sharing social related recommended recommendations outbrain taboola search login toolbar skip".split())
#: Parts that may follow and go before a noise word in a class or id that is noise as a whole ("ad-box", "site-header").
SUFFIXES = frozenset("area bar block body box btn button buttons col column container content form icons inner item items label left link links list message outer panel right root row section slot text title top unit widget wrap wrapper zone".split())
PREFIXES = frozenset("article bottom desktop entry footer global google js left main mobile page post primary right secondary site sticky top".split())
#: Elements that mark an article; how much denser than the text around a heading a noise-named element must be to be the article; levels of noise names in each other that are weighed.
MARKED, OUTWEIGHS, LEVELS = frozenset({"article", "main"}), 10, 8
#: Beginnings of a name's part that hint at what is no article wherever they stand in it, words that do, and words that do only beside many links or a form.
STEMS = re.compile(r"comment(?!ar|at)|newsletter|advert|sponsor|cookie|disqus|taboola|outbrain|sign-?up|subscrib|paywall|gdpr|breadcrumb|sidebar|recommend")
STRONG = frozenset("ad ads adv consent promo promos promoted promotion related replies trending".split())
#: First parts of names that tell of a page's state.
STATES = frozenset("can has hide is js no not show with without".split())
#: Names of what says who wrote a comment, and when.
BYLINE = re.compile(r"author|avatar|byline|date|meta|posted|time|user")
#: Elements of forms that a reader fills in.
CONTROLS = frozenset("button input select textarea".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: The least logarithm of a density's base: ln(ln(e + e * e)), some ten characters of link text.
FLOOR = math.log(math.log(math.e + math.e**2))
#: Open elements that a start tag closes, up to the elements that hide them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HIDES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"form", "header", "footer", "nav", "aside"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|\"[^\"]*\"|'[^']*'")
RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)|\Z", re.I) for t in RAW}


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("tag", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "suspect", "hint", "name", "near")

    def __init__(self, tag: str, parent: Node | None, suspect: bool = False, hint: int = 0, name: str = ""):
        self.tag, self.parent, self.children, self.suspect, self.hint, self.name = tag, parent, [], suspect, hint, name
        # the nearest block around, itself if it is one
        self.near = self if parent is None or tag in BLOCKS or tag == "option" else parent.near


def noise_name(token: str) -> bool:
    """Whether a class or id is a noise word as a whole: nothing but noise words, or one at its start or end with known parts beside it."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"\d+", "", token)) if p]
    if not parts:
        return False
    first = parts[0] in NOISE_WORDS and all(p in NOISE_WORDS or p in SUFFIXES for p in parts)
    return first or parts[-1] in NOISE_WORDS and all(p in NOISE_WORDS or p in PREFIXES for p in parts)


def hinted(token: str) -> int:
    """How much a part of a class or id hints at what is no article: 2 by a strong word or stem, 1 by any noise word, 0 not at all."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", re.sub(r"\d+", "", token)).lower()) if p]
    if not parts or parts[0] in STATES:
        return 0
    return 2 if any(p in STRONG or STEMS.match(p) for p in parts) else int(any(p in NOISE_WORDS for p in parts))


def noisy(tag: str, attributes: str) -> tuple[bool, bool, int, str]:
    """Whether an element's kind, role or being hidden says that it is no article; whether its class or id does as a whole; how much they hint at it; and both."""
    if tag in NOISE:
        return True, False, 0, ""
    suspect, hint, named = tag in WEIGHED, 0, ""
    if not attributes or tag in ("html", "body"):
        return False, suspect, 0, ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "role" and low in NOISE_ROLES:
            return True, False, 0, ""
        if name in ("class", "id"):
            suspect = suspect or any(map(noise_name, low.split()))
            hint = max([hint, *map(hinted, value.split())])
            if name == "class":
                named = low
    return False, suspect, hint, named


def parse(page: str) -> Node:
    """The page's tree, rid of comments, raw text and elements that are no article by kind or role; those with a noise name are suspect. Unclosed and stray tags are mended as browsers do."""
    root = Node("html", None)
    node, skip, at = root, [], 0  # skip: open elements below one that is left out
    opened, skipped = Counter(), Counter()  # elements that stand open, by tag, so that an end tag without a beginning is told at once

    def pop(to: Node) -> Node:
        """Ends all that stands open below a node."""
        inner = node
        while inner is not to:
            opened[inner.tag] -= 1
            inner = inner.parent
        return to

    while at < len(page):
        found = TOKEN.search(page, at)
        start = found.start() if found else len(page)
        if start > at and not skip:
            node.children.append(page[at:start])
        if not found:
            break
        at = found.end()
        cdata, closing, tag, attributes = found.groups()
        if cdata is not None and not skip:
            node.children.append(cdata)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if skip:
                if skipped[tag] > 0:
                    while (last := skip.pop()) != tag:
                        skipped[last] -= 1
                    skipped[tag] -= 1
                    continue
                if opened[tag] <= 0 or tag not in BLOCKS or tag == "p":
                    continue
                skip, skipped = [], Counter()  # the end of an element around what is left out ends that as well
            if opened[tag] > 0 and tag != "body":
                up = node
                while up.tag != tag:
                    up = up.parent
                node = pop(up.parent)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end()
            continue
        void = tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in NOISE
        if skip:
            # what stands open below an element that is left out ends with it
            if not void and not (tag == "body" and skip[0] == "head"):
                skip.append(tag)
                skipped[tag] += 1
                continue
            if void:
                continue
            skip, skipped = [], Counter()
        if tag in ("html", "body"):
            if tag == "body" and node is root:
                node = Node("body", root)
                root.children.append(node)
                opened["body"] += 1
            continue
        closes, hides = CLOSES.get(tag, ()), HIDES.get(tag, ())
        if tag in ENDS_P:
            closes = {*closes, "p"}
        if closes:
            up = node.near
            while up is not root and up.tag in closes and up.tag not in hides:
                node = pop(up.parent)
                up = node.near
        cut, suspect, hint, name = noisy(tag, attributes)
        if cut:
            if tag not in ("br", "hr") and not void:
                skip, skipped = [tag], Counter([tag])
            node.children.append(Node("cut", node, name=tag))
            continue
        child = Node(tag, node, suspect, hint, name)
        node.children.append(child)
        if not void:
            node = child
            opened[tag] += 1
    return root


def measure(root: Node) -> list[Node]:
    """All nodes from the root on, with characters, tags, the same in links, density and summed density of children.

    Density is the published composite one: characters per tag times the logarithm of characters per link character and tags per link tag, to a base that is the
    logarithm of what grows with the node's link text and with the body's share of link text. Where neither has links that base is 1; its logarithm is therefore held at
    FLOOR at least, and the argument is raised by one, so that a node that is all links has a density above zero.
    """
    order = [root]
    for n in order:
        order += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        n.chars = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        inner = [c for c in n.children if isinstance(c, Node)]
        n.chars += sum(c.chars for c in inner)
        n.tags = sum(c.tags + (c.tag != "cut") for c in inner)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(c.link_chars for c in inner)
        n.link_tags = n.tags if link else sum(c.link_tags + (c.tag == "a") for c in inner)
    base = root.link_chars / max(root.chars, 1)
    for n in reversed(order):
        if not n.chars:
            n.density = 0.0
        else:
            tags, links = max(n.tags, 1), max(n.link_chars, 1)
            log_base = max(math.log(math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + base * n.chars + math.e)), FLOOR)
            n.density = n.chars / tags * math.log(max(n.chars / links * tags / max(n.link_tags, 1), 1.0) + 1) / log_base
        n.total = sum(c.density for c in n.children if isinstance(c, Node))
    return order


def inside(node: Node) -> list[Node]:
    """A node and all nodes below it."""
    found = [node]
    for n in found:
        found += [c for c in n.children if isinstance(c, Node)]
    return found


def repeats(node: Node) -> bool:
    """Whether an element is a list of alike entries: two or more children of some node in it have the same tag and class, or are items, and text of their own."""
    for n in inside(node):
        alike = Counter((c.tag, c.name) for c in n.children if isinstance(c, Node) and c.chars and (c.name or c.tag in ("li", "article", "section")))
        if any(m > 1 for m in alike.values()):
            return True
    return False


def hint_holds(node: Node) -> bool:
    """Whether what an element is bears out what its name hints at.

    Many links or a form do. A strong hint also does if the element is a list of alike entries, or has no more than half of the text of the article or main element around it (of the page, where there is none).
    """
    if node.link_chars * 3 > node.chars or any(c.tag == "cut" and c.name in CONTROLS for c in inside(node)):
        return True
    if node.hint < 2:
        return False
    around = node
    while around.parent is not None and around.tag not in MARKED:
        around = around.parent
    return node.chars * 2 <= around.chars or repeats(node)


def signed(node: Node) -> bool:
    """Whether an element says who wrote it or when: it has a time, or a short part with a name like that."""
    return any(c is not node and c.chars <= 80 and (c.tag == "time" or c.name and BYLINE.search(c.name)) for c in inside(node))


def cut_comments(order: list[Node]) -> bool:
    """Cuts runs of two or more neighbours of one tag and class that each say who wrote them or when and stand after the densest subtree, whatever their names: readers' comments."""
    core = max(order, key=lambda n: n.total)
    around = set()
    up: Node | None = core
    while up is not None:
        around.add(id(up))
        up = up.parent
    found = False
    up = core
    while up.parent is not None:
        above = up.parent
        after = [c for c in above.children[next(i for i, c in enumerate(above.children) if c is up) + 1 :] if isinstance(c, Node)]
        runs: list[list[Node]] = []
        for c in after:
            alike = lambda x: (x.tag, x.name) == (c.tag, c.name)  # noqa: B023, E731
            inner = [x for x in c.children if isinstance(x, Node)]
            if c.chars and c.name and runs and alike(runs[-1][-1]):
                runs[-1].append(c)
            else:
                runs.append([c])
            if len(inner) > 1 and len({(x.tag, x.name) for x in inner if x.chars}) == 1 and inner[0].tag != "p":
                runs.append(inner)
        for run in runs:
            run = [c for c in run if c.chars]
            if len(run) > 1 and all(map(signed, run)):
                for c in run:
                    c.tag, c.children = "cut", []
                found = True
        up = above
    return found


def settled(root: Node) -> list[Node]:
    """As measure(), after suspect elements and those whose names hint at noise and that bear it out (see hint_holds) are cut, except those that hold the article, and then readers' comments that only their form tells.

    An element with a noise name stays if it holds an h1, or article or main element, and none stands outside of such elements; or if it holds the densest subtree and
    nothing outside marks another place: an article or main element does, a mere h1 unless its surroundings are OUTWEIGHS times less dense. It also stays if nothing else has text.
    Elements in one that stays are weighed in turn.
    """
    order = measure(root)
    for _ in range(LEVELS):
        outer, todo = [], [root]
        for n in todo:
            for c in n.children:
                if isinstance(c, Node):
                    (outer if c.suspect or c.hint and hint_holds(c) else todo).append(c)
        if not outer:
            break
        core = max(order, key=lambda n: n.total)
        around = {id(core)}
        while core.parent is not None:
            core = core.parent
            around.add(id(core))
        facts = []
        for n in outer:
            below = inside(n)
            facts.append((n, n.tag, n.children, n.chars, {c.tag for c in below if c.chars}, max(c.total for c in below)))
            n.tag, n.children = "cut", []
        order = measure(root)
        title = any(n.tag == "h1" and n.chars for n in order)
        marked = any(n.tag in MARKED and n.chars for n in order)
        most = max(n.total for n in order)
        alone = not root.chars and not any(n.tag in MARKED for n in order)
        longest = max(f[3] for f in facts)
        stays = False
        for n, tag, children, chars, tags, total in facts:
            densest = id(n) in around
            keep = "h1" in tags and not title or tags & MARKED and not marked and (densest or not title)
            keep = keep or densest and not marked and total > most * (OUTWEIGHS if title else 1)
            if keep or alone and chars and chars == longest:
                n.tag, n.children, n.suspect, n.hint, stays = tag, children, False, 0, True
        if not stays:
            break
        order = measure(root)
    return measure(root) if cut_comments(order) else order


def chosen(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order.

    The node whose children's densities sum highest is the core. If it lies in an article element, the outermost such is the text, with article elements beside it that have the
    threshold's density and few links; else a main element around it is. The least density on the path from the body to the
    core is the threshold. The lowest node around the core with a heading or a node of that density and few links beside the path is the content's container, or
    the one with the title (h1) if that is further up and not the body; without any, the core's parent is, if it isn't the body and the core has no title of its own. Of the container all is kept that is not mostly links, bare text too. Beside
    the path above it, headings and nodes of the threshold's density with few links belong to the text as well.
    """
    order = settled(root)
    core = max(order, key=lambda n: n.total)
    if not core.total:  # text without elements around it
        return [root]
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    named = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    if named:
        top = named[-1]
        alike = lambda c: isinstance(c, Node) and c.tag == "article" and c.chars > 0 and c.link_chars * 3 <= c.chars and c.density >= threshold
        return [c for c in top.parent.children if c is top or alike(c)] if top.tag == "article" else [top]

    def beside(c: Node | str) -> bool:
        return isinstance(c, Node) and c.chars > 0 and c.link_chars * 3 <= c.chars and (c.density >= threshold or re.fullmatch("h[1-6]", c.tag) is not None)

    around = [i for i in range(1, len(path)) if any(c is not path[i - 1] and beside(c) for c in path[i].children)]
    titled = any(n.tag in ("h1", "h2") and n.chars for n in inside(core))
    title = [i for i in around if path[i].tag not in ("body", "html") and any(isinstance(c, Node) and c.tag == "h1" and beside(c) for c in path[i].children)]
    held = max(around[:1] + title[:1]) if around else int(len(path) > 1 and path[1].tag not in ("body", "html") and not titled)
    whole = core
    for i in range(1, held + 1):
        whole = unlinked(path[i], path[i - 1], whole)
    keep = [whole]
    for above, inner in zip(path[held + 1 :], path[held:], strict=False):
        at = above.children.index(inner)
        keep = [c for c in above.children[:at] if beside(c)] + keep + [c for c in above.children[at + 1 :] if beside(c)]
    return keep


def unlinked(node: Node, child: Node, instead: Node) -> Node:
    """A copy of a node without its blocks and runs of text that are mostly links, with another node instead of one child."""
    out, run = Node(node.tag, None), []

    def close() -> None:
        chars = sum(len(c.strip()) if isinstance(c, str) else c.chars for c in run)
        if sum(c.link_chars for c in run if isinstance(c, Node)) * 3 <= chars:
            out.children += run
        run.clear()

    for c in node.children:
        block = isinstance(c, Node) and (c.tag in BLOCKS or c is child)
        if block:
            close()
        run.append(c)
        if c is child:
            run[:] = [instead]
            out.children += run
            run.clear()
        elif block:
            close()
    close()
    return out


def blocks(node: Node) -> list[str]:
    """The texts of a node's blocks in page order, character references decoded, white space folded."""
    out, run = [], []

    def close() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        elif n.tag in BLOCKS or n is node:
            close()
            stack += [None, *reversed(n.children)]
        else:
            stack += reversed(n.children)
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null, for an empty page and for one without text."""
    if not page:
        return ""
    return "\n\n".join(b for n in chosen(parse(page)) for b in blocks(n))


def extract(html: Column) -> Column:
    """The main text of whole pages (string, never null)."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return run(html)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars (long, its code points), replacing columns of these names; other columns, html too, are kept.

    Each page is its own: nulls elsewhere, repeated rows and long pages change nothing. An empty table gives an empty one.
    """
    out = pages.withColumn("text", extract(F.col(f"`{html}`")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
