"""Main text of web pages: the contiguous region of words and tags with the greatest sum of scores.

Words score positive and tags negative, with weights learned from labelled pages; one linear scan finds the best region.
The region is then widened to the element that holds it, so that short blocks at its ends stay, and parts that are no
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments) go.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityjobs.llm.shared import lean, text_batches

#: Bounds of the labelled pages that the weights are learned from: how many, and the longest in characters.
LABELLED, LONGEST = 400, 200_000
ROUNDS = 5

#: Starts of tags, comments and declarations. Possessive, so each character is read a bounded number of times.
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks of running text: a region is widened over them, and a new block ends an open paragraph.
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre ul ol dl table figure hr".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form script style noscript template button select option textarea title head iframe svg canvas object dialog menu datalist".split())
OUTSIDE_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids that mark such elements.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot adunit adbanner sponsor sponsors sponsored promo promos promotion promotions "
    "banner banners cookie cookies cookiebar cookiebanner consent gdpr notice notices alert alerts popup popups modal overlay toast paywall "
    "newsletter subscribe subscription signup login nav navbar navmenu navigation mainnav topnav subnav sidenav topbar menu menus menubar mainmenu "
    "breadcrumb breadcrumbs sidebar sidebars leftbar rightbar rail aside widget widgets footer footers colophon share sharing social "
    "comment comments commentlist commentform commentbox disqus respond replies discussion reactions talkback guestbook "
    "related recommended recommendations trending teaser teasers pagination pager search toolbar skip copyright disclaimer masthead".split()
)
#: A name after one of these says what the element has or lacks, not what it is.
OF_OTHERS = frozenset("has with no without is hide show".split())
CONTENT_NAMES = frozenset("article content post entry story text main body".split())

#: Weights before any page is learned from: of a word, of a word in a link, and of tags.
FIRST_WEIGHTS = {"word": 1.0, "link word": 0.2, "inline": -0.3, "paragraph": -0.5, "block": -2.0, "outside": -8.0}
#: Weights keep their sign: words stay at or above this, tags at or below minus this.
_LEAST = 0.05


@dataclass
class Page:
    """Elements (name, parent, whether outside the article) and tokens of one page, in page order."""

    names: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    marks: list[set[str]] = field(default_factory=lambda: [set()])
    outside: list[str] = field(default_factory=lambda: [""])
    #: (kind, element, text, words): a tag's kind is its name, that of a text is empty.
    tokens: list[tuple[str, int, str, int]] = field(default_factory=list)


def _marks_of(name: str, rest: str) -> tuple[set[str], str]:
    """Parts of an element's class and id, and why it is outside the article (empty if it is not)."""
    found = {}
    for key, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(key.lower(), "".join(values))
    parts = [p.lower() for key in ("class", "id") for p in _NAME_PART.findall(html.unescape(found.get(key, "")))]
    own = {p for before, p in zip(["", *parts], parts) if before not in OF_OTHERS}
    if name in OUTSIDE:
        return own, name
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return own, "hidden"
    if name in HEADINGS or name in ("html", "body", "main"):
        return own, ""
    if name == "header" or found.get("role") == "banner" or ("header" in own and not own & CONTENT_NAMES):
        return own, "header"
    if found.get("role") in OUTSIDE_ROLES or own & OUTSIDE_NAMES:
        return own, "named"
    return own, ""


def parsed(source: str) -> Page:
    """Tags and texts of ``source``; open elements end where an outer one or, for paragraphs and items, the next one does."""
    page, stack, open_names, at = Page(), [0], Counter(), 0

    def text(raw: str) -> None:
        words = len(raw.split())
        if words:
            page.tokens.append(("", stack[-1], raw, words))
        elif raw:
            page.tokens.append(("", stack[-1], " ", 0))

    def close(name: str) -> None:
        if open_names[name]:
            while True:
                last = page.names[stack.pop()]
                open_names[last] -= 1
                if last == name:
                    return

    while at < len(source):
        found = _MARK.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            page.tokens.append((name, stack[-1], "", 0))
            close(name)
            continue
        if name not in INLINE:
            if page.names[stack[-1]] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option"):
                close(name)
            if open_names["p"]:
                close("p")
        marks, outside = _marks_of(name, found[3]) if found[3].strip() or name in OUTSIDE or name == "header" else (set(), "")
        page.names.append(name)
        page.parents.append(stack[-1])
        page.marks.append(marks)
        page.outside.append(outside)
        stack.append(len(page.names) - 1)
        open_names[name] += 1
        page.tokens.append((name, stack[-1], "", 0))
        if name in VOID:
            stack.pop()
            open_names[name] -= 1
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
    return page


def _settled(page: Page) -> list[bool]:
    """Whether each element is outside the article, by itself or by an element around it.

    A header within an article keeps its headings. A form or a named element around an article, or a form or header with over half
    of the page's words, is a wrapper and not outside.
    """
    n = len(page.names)
    words = [0] * n
    for _, element, _, count in page.tokens:
        words[element] += count
    wraps = [page.names[i] in ("article", "main") and not page.outside[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        words[page.parents[i]] += words[i]
        wraps[page.parents[i]] |= wraps[i] and page.names[page.parents[i]] not in ("nav", "footer", "aside")
    out, inner, header = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, why = page.parents[i], page.outside[i]
        inner[i] = inner[up] or page.names[i] in ("article", "main")
        wrapper = (wraps[i] and why in ("form", "named", "header")) or (why in ("form", "header") and 2 * words[i] > words[0])
        own = bool(why) and not wrapper
        header[i] = header[up] or (own and why == "header" and inner[up])
        if page.names[i] in HEADINGS and header[up] and not own:
            out[i] = False
        else:
            out[i] = own or out[up]
    return out


def _class_of(kind: str, outside: bool) -> str:
    if outside:
        return "outside"
    if kind in INLINE:
        return "inline"
    return "paragraph" if kind in TEXT_BLOCKS or kind == "li" else "block"


def _features(page: Page, out: list[bool]) -> list[tuple[str, str, int]]:
    """(class, own class, count) of each token: texts count their words, those outside count nothing, tags count one.

    A tag's weight is its class's plus its name's own correction.
    """
    linked = [False] * len(page.names)
    for i in range(1, len(page.names)):
        linked[i] = page.names[i] == "a" or linked[page.parents[i]]
    found = []
    for kind, element, _, words in page.tokens:
        if kind:
            found.append((_class_of(kind, out[element]), f"<{kind}>", 1))
        else:
            found.append(("link word" if linked[element] else "word", "", 0 if out[element] else words))
    return found


def _scores(features: list[tuple[str, str, int]], weights: dict[str, float]) -> list[float]:
    scores = []
    for kind, own, count in features:
        weight = weights[kind]
        if own:
            weight = min(weight + weights.get(own, 0.0), -_LEAST)
        scores.append(weight * count)
    return scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, after) of the contiguous stretch with the greatest sum, in one scan; ties to the earliest, (0, 0) if none is above 0."""
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, region = total, (first, i + 1)
    return region


def _article_region(page: Page, out: list[bool]) -> tuple[int, int]:
    """Tokens of texts from the first to the last one in the first ``article`` element that is not outside."""
    inside = [False] * len(page.names)
    chosen = next((i for i, n in enumerate(page.names) if n == "article" and not out[i]), 0)
    for i in range(1, len(page.names)):
        inside[i] = bool(chosen) and (i == chosen or inside[page.parents[i]])
    held = [k for k, (kind, element, _, words) in enumerate(page.tokens) if not kind and words and inside[element] and not out[element]]
    return (held[0], held[-1] + 1) if held else (0, 0)


def _text_region(page: Page, main: str) -> tuple[int, int]:
    """Tokens of texts from the first to the last one whose words stand in ``main``."""
    whole = f" {' '.join(main.split())} "
    held = [k for k, (kind, _, raw, words) in enumerate(page.tokens) if not kind and words > 1 and f" {' '.join(html.unescape(raw).split())} " in whole]
    return (held[0], held[-1] + 1) if held else (0, 0)


def learned(pages: list[tuple[str, str | None]]) -> dict[str, float]:
    """Weights from labelled pages (html, main text; None: the page's own ``article`` element), averaged over all steps.

    A step moves the weights by the difference of the labelled and the best region's counts of words and tags. No page
    gives ``FIRST_WEIGHTS``.
    """
    weights, total, steps = dict(FIRST_WEIGHTS), Counter(), 0
    examples = []
    for source, main in pages:
        page = parsed(source)
        out = _settled(page)
        truth = _article_region(page, out) if main is None else _text_region(page, main)
        if truth != (0, 0):
            examples.append((_features(page, out), truth))
    for _ in range(ROUNDS):
        for features, truth in examples:
            region = best_region(_scores(features, weights))
            counts = Counter()
            for sign, (first, after) in ((1, truth), (-1, region)):
                for kind, own, count in features[first:after]:
                    counts[own or kind] += sign * count
            size = max(1, sum(abs(c) for c in counts.values()))
            for key, count in counts.items():
                weights[key] = weights.get(key, 0.0) + count / size
            for key in ("word", "link word"):
                weights[key] = max(weights[key], _LEAST)
            steps += 1
            total.update(weights)
    return {key: value / steps for key, value in total.items()} if steps else weights


def _container(page: Page, out: list[bool], first: int, after: int) -> tuple[int, int]:
    """The element that holds the region's texts, and tokens (first, after) of what is taken from it."""
    held = [k for k in range(first, after) if not page.tokens[k][0] and page.tokens[k][3] and not out[page.tokens[k][1]]]
    if not held:
        return 0, 0

    def path(element: int) -> list[int]:
        up = [element]
        while up[-1] > 0:
            up.append(page.parents[up[-1]])
        return up[::-1]

    left, right = path(page.tokens[held[0]][1]), path(page.tokens[held[-1]][1])
    common = [a for a, b in zip(left, right) if a == b]
    # Texts in one paragraph: what holds the paragraph.
    while len(common) > 1 and page.names[common[-1]] in INLINE | TEXT_BLOCKS | {"li", "td", "th", "tr", "tbody"}:
        common.pop()
    for name in ("article", "main"):
        around = [e for e in common if page.names[e] == name]
        if around:
            return _span(page, around[-1])
    holder = common[-1]
    low, high = _span(page, holder)
    if not page.marks[holder] & CONTENT_NAMES or page.names[holder] in ("#page", "html", "body"):
        low, high = _widened(page, out, holder, held[0], held[-1] + 1, low, high)
    return _with_title(page, out, low), high


def _span(page: Page, element: int) -> tuple[int, int]:
    """First and after-last token within ``element``."""
    inside = {element}
    low = high = None
    for k, (_, e, _, _) in enumerate(page.tokens):
        if e in inside or page.parents[e] in inside:
            inside.add(e)
            low, high = k if low is None else low, k + 1
    return low or 0, high or 0


def _widened(page: Page, out: list[bool], holder: int, first: int, after: int, low: int, high: int) -> tuple[int, int]:
    """The region and the blocks of running text beside it, up to the next other element."""
    child = list(range(len(page.names)))  # the holder's child that each element below it stands in
    for i in range(1, len(child)):
        if page.parents[i] != holder and i != holder:
            child[i] = child[page.parents[i]]
    # A child that the region begins or ends in belongs to it as a whole.
    own = {child[page.tokens[k][1]] for k in (first, after - 1)} - {holder}

    def joins(k: int) -> bool:
        element = page.tokens[k][1]
        top = child[element]
        return top in own or out[element] or element == holder or page.names[top] in TEXT_BLOCKS | INLINE

    while first > low and joins(first - 1):
        first -= 1
    while after < high and joins(after):
        after += 1
    return first, after


def _with_title(page: Page, out: list[bool], first: int) -> int:
    """Where the heading just before the region begins, if only tags stand between them."""
    k = first
    while k > 0 and (page.tokens[k - 1][0] or not page.tokens[k - 1][3] or out[page.tokens[k - 1][1]]):
        k -= 1
    if k and page.names[page.tokens[k - 1][1]] == "h1":
        while k > 0 and page.names[page.tokens[k - 1][1]] == "h1":
            k -= 1
        return k
    return first


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The article's blocks, joined by newlines; white space within a block is one space."""
    page = parsed(source or "")
    out = _settled(page)
    first, after = _container(page, out, *best_region(_scores(_features(page, out), weights)))
    blocks: list[list[str]] = [[]]
    for kind, element, raw, _ in page.tokens[first:after]:
        if kind and kind not in INLINE:
            blocks.append([])
        elif kind == "br":
            blocks[-1].append(" ")
        elif not kind and not out[element]:
            blocks[-1].append(raw)
    texts = (" ".join(html.unescape("".join(block)).split()) for block in blocks)
    return "\n".join(t for t in texts if t)


def fit(pages: DataFrame, html_col: str = "html", main_col: str | None = None, labelled: int = LABELLED, longest: int = LONGEST) -> dict[str, float]:
    """Weights from at most ``labelled`` different pages of at most ``longest`` characters: those of least hash among the labelled ones.

    A page is labelled by ``main_col`` (its main text) or, without such a column, by an ``article`` element of its own. The
    driver sees hashes first (``labelled`` of each task), then the chosen pages once each, however often a page is repeated.
    """
    source = F.col(html_col)
    label = F.col(main_col) if main_col else F.lit(None).cast("string")
    known = label.isNotNull() if main_col else F.lower(source).contains("<article")
    chosen = pages.filter(known & (F.length(source) <= longest)).select(source.alias("html"), label.alias("main"), F.xxhash64(source).alias("hash"))
    hashes = [r["hash"] for r in chosen.select("hash").distinct().orderBy("hash").limit(labelled).collect()]
    drawn = chosen.filter(F.col("hash").isin(hashes)).groupBy("hash").agg(F.min(F.struct("html", "main")).alias("page"))
    return learned([(r["page"]["html"], r["page"]["main"]) for r in sorted(drawn.collect(), key=lambda r: r["hash"])])


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page: its main text, empty if it has none.

    A null html is empty. Null and repeated ids stay rows of their own; other columns are left out; an empty table gives no
    rows. Character references are decoded; broken markup is read as far as it goes.
    """
    text_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(source, weights) for source in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return pages.select(id_col, url_col, html_col).mapInArrow(lean(run), f"page_id {kinds[0]}, url {kinds[1]}, text string")
