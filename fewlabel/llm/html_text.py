"""Main text of web pages by the line-block distribution.

The page is stripped of markup into lines (one per block element); a line's weight is
the length of its text outside links and outside elements that are no main text by
their kind (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments).  Weights are summed over a sliding window of lines.  A surge point
is a line where the window sum rises over the threshold from below, the dive point the
line where it has fallen back; the lines between them form a text block.  The threshold is
``THRESHOLD`` characters, on pages without long lines the ``SHARE``-th part of the heaviest
window.

The blocks of the container of the main text are joined, gaps between them included.  The
edges then move over what is left of the containers that bear a block (a short last line, a
quotation), never into containers without one: a sidebar, a teaser or an imprint without
any telling name forms no block and goes.  Where an ``article`` or ``main`` element holds most
of the blocks, surge and dive snap to that element's edges, and articles beside it in the
same container that weigh at least half as much join it.

Whether an element is left out is decided when the whole page is read: by its tag or by
whole class, id and role tokens (also compounds that end in a listed word, as in
``site-footer``, or join one with words of shape or place, as in ``ad-slot-1``, but not states
of the layout, as in ``has-sidebar``).  An id alone (an anchor) leaves out no heading or
paragraph, and inside an article only reader comments; words that may be an article's subject
(``legal``) don't count inside one.  An element that holds most of the page's text, or an
``article`` or ``main`` element heavier than all text outside such elements, is kept, unless it
is hidden or holds reader comments.

Character references are decoded, white space inside a line becomes one blank, empty
lines go, lines are joined by one newline.  A page is read in time linear in its length,
whatever its markup: where tags end is looked up once per quote.

Defined results: null and empty html, and pages without text, give an empty text and 0
characters; rows are kept one to one (repeated rows too); an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fewlabel.llm.common import map_texts, pick, text_list

#: Lines in a window; weight that a window must exceed to count as text, at most this part of the page's heaviest window.
WINDOW = 3
THRESHOLD = 80
SHARE = 4

# Element kinds of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "canvas", "title", "select")
NOT_MAIN = frozenset("nav footer aside form button menu dialog fieldset label option legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset(
    "address article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol "
    "section table ul button label".split())
#: Words of class, id and role values of elements that are no main text.
NOT_MAIN_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu menubar nav "
    "navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus respond reply replies complementary contentinfo search pagination pager skip "
    "copyright legal disclaimer toolbar masthead".split())

_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z]+")


#: A class token ending in one of the words counts as the word, but not where it names a state of the layout.
_STATE = frozenset("has no with without is not show hide".split())
#: Elements whose text is no main text although it may outgrow it, and kinds that never wrap a page.
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that may be the subject of a part of an article, and words of shape or place in compounds.
_SUBJECTS = frozenset("legal search copyright disclaimer".split())
_SHAPES = frozenset(
    "area bar block bottom box button buttons card cards col column container group icon icons inner item items left link "
    "links list outer page panel post posts right row section site slot tile tiles top unit user wrap wrapper zone".split())
_NEVER_WRAPS = NOT_MAIN - {"form", "fieldset"}
#: Containers that are parts of the text around them.
_PARTS = frozenset("address button center details dl figure label ol section ul".split())

_HARD, _SOFT, _READERS, _UNSEEN, _GATE = range(1, 6)


def _named(token: str) -> str:
    """The word of ``NOT_MAIN_WORDS`` that a whole class token stands for, or nothing."""
    if token in NOT_MAIN_WORDS:
        return token
    words = _WORD.findall(token)
    listed = [w for w in words if w in NOT_MAIN_WORDS]
    if not listed or _STATE.intersection(words):
        return ""
    return listed[-1] if words[-1] in NOT_MAIN_WORDS or all(w in NOT_MAIN_WORDS or w in _SHAPES for w in words) else ""


def _no_main_text(tag: str, attrs: str, inside: int) -> int:
    """Why an element may be no main text (0: it may not); a ``header`` inside an article belongs to it."""
    if attrs and tag not in ("html", "body", "article", "main") and _HIDDEN.search(attrs):
        return _UNSEEN
    if tag in NOT_MAIN or tag == "header" and not inside:
        return _HARD
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    names = set()
    for key, a, b, c in _ATTR.findall(attrs):
        found = {_named(t) for t in (a or b or c).lower().split()} - {""}
        if key.lower() == "id":
            found = set() if tag not in CONTAINER else found & _COMMENTS if inside else found
        names |= found
    if inside:
        names -= _SUBJECTS
    return 0 if not names else _READERS if names <= _COMMENTS else _SOFT


class _Ends:
    """Where tags end; every quote of the page is followed once."""

    def __init__(self, page: str):
        self.page, self.end_of = page, {}
        self.special = self.plain_end = (0, -1)  # (searched from, found at)
        self.last_special = max(page.rfind(c) for c in ">\"'")
        self.last_end, self.last_open = page.rfind(">"), page.rfind("<")

    def quoted(self, at: int) -> int:
        """The ``>`` that ends a tag read up to ``at``, quoted values passed over; -1 if there is none."""
        if at > self.last_end:
            return -1
        if not self.special[0] <= at <= self.special[1]:
            self.special = at, _SPECIAL.search(self.page, at).start()
        y, trail, end = self.special[1], [], -1
        while True:
            if y in self.end_of:
                end = self.end_of[y]
                break
            trail.append(y)
            if self.page[y] == ">":
                end = y
                break
            shut = self.page.find(self.page[y], y + 1)
            if shut < 0 or shut >= self.last_special:
                break
            y = _SPECIAL.search(self.page, shut + 1).start()
        self.end_of.update(dict.fromkeys(trail, end))
        return end

    def plain(self, at: int) -> int:
        """The next ``>``, -1 if there is none."""
        if at > self.last_end:
            return -1
        if not self.plain_end[0] <= at <= self.plain_end[1]:
            self.plain_end = at, self.page.find(">", at)
        return self.plain_end[1]


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(begin, end, raw tag, whether it closes, tag, attributes) of all markup; neither tag for comments and broken tags."""
    ends, at, n = _Ends(page), page.find("<"), len(page)
    while at >= 0:
        stop, raw, close, tag, attrs = 0, "", False, "", ""
        m = _NAME.match(page, at)
        if m:
            name, end = m[2].lower(), ends.quoted(m.end())
            if end >= 0 and not m[1] and name in _RAW_END:
                raw, stop = name, end + 1
                if page[end - 1] != "/":
                    shut = _RAW_END[name].search(page, stop)
                    stop = shut.end() if shut else n
            elif end >= 0:
                close, tag, attrs, stop = bool(m[1]), name, page[m.end():end], end + 1
            else:  # a quote that never ends: up to the next >; an unfinished tag at the page's end
                stop = ends.plain(at) + 1 or (n if at == ends.last_open else 0)
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = n if stop < 3 else stop
        elif page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at + 9) + 3
            stop = n if stop < 3 else stop
        elif page.startswith(("<!", "<?"), at):
            stop = ends.plain(at + 2) + 1 or n
        if stop:
            yield at, stop, raw, close, tag, attrs
        at = page.find("<", stop or at + 1)


class _Page:
    """The lines of a page with their containers; what is skipped is decided when all of it is read."""

    def __init__(self, page: str):
        # per element that may be skipped (0: none): reason, tag, element around it, whether its end tag was met, weight
        self.why, self.tag, self.up, self.ended, self.weight = [0], [""], [0], [False], [0]
        # per box (0: the page): tag, box around it, region; per region: weight, skippable element and box around it
        self.box_tag, self.box_up, self.box_region = [""], [0], [0]
        self.region_weight, self.region_in, self.region_box = [0], [0], [0]
        self.raw: list[tuple[list[tuple[str, bool, int]], int, int]] = []
        self._read(page)
        self._choose()

    def _read(self, page: str) -> None:
        buf: list[tuple[str, bool, int]] = []
        inside = region = inner = box = at = gated = 0
        link = False
        stack: list[tuple[str, int, int, int]] = []  # open containers: tag, its skippable element, inner and box around it
        opened: Counter[str] = Counter()

        def flush() -> None:
            if buf:
                self.raw.append((buf.copy(), region, box))
                buf.clear()

        def take(a: int, b: int) -> None:
            if b > a:
                piece = page[a:b]
                buf.append((piece, link, inner))
                if not link:
                    w = len(piece.strip())
                    self.weight[inner] += w
                    self.region_weight[region] += w

        for begin, end, raw, close, tag, attrs in _tokens(page):
            take(at, begin)
            at = end
            if not tag:
                if raw in BLOCK:
                    flush()
                continue
            if tag == "a":
                link = not close
            elif tag == "br":
                buf.append((" ", True, inner))
            if tag in BLOCK:
                flush()
                link = False
            if close:
                if opened[tag]:
                    while stack:
                        t, node, inner, box = stack.pop()
                        opened[t] -= 1
                        if t in ("article", "main"):
                            inside -= 1
                            if not inside:
                                region = 0
                        if t == tag:
                            self.ended[node] = True
                            break
                    gated = min(gated, len(stack))
            elif tag not in VOID and not attrs.endswith("/"):
                if tag in ("article", "main") and inner and self.why[inner] != _GATE:
                    # a menu or header that is never closed ends here; what was open at the last such place is done
                    late = stack[gated:]
                    gates = {i: self._node(_GATE, "", i) for i in {inner, *(x[2] for x in late)} if i and self.why[i] != _GATE}
                    inner = gates[inner]
                    stack[gated:] = [(t, node, gates.get(i, i), b) for t, node, i, b in late]
                    gated = len(stack)
                why = _no_main_text(tag, attrs, inside)
                if tag in CONTAINER or why and tag in BLOCK | {"span"}:
                    node = self._node(why, tag, inner) if why else 0
                    stack.append((tag, node, inner, box))
                    opened[tag] += 1
                    inner = node or inner
                    if tag in ("article", "main"):
                        inside += 1
                        if inside == 1:
                            self.region_weight.append(0)
                            self.region_in.append(inner)
                            self.region_box.append(box)
                            region = len(self.region_in) - 1
                    if tag in CONTAINER and tag not in _PARTS:
                        self.box_tag.append(tag)
                        self.box_up.append(box)
                        self.box_region.append(region)
                        box = len(self.box_tag) - 1
        take(at, len(page))
        flush()

    def _node(self, why: int, tag: str, up: int) -> int:
        for x, v in ((self.why, why), (self.tag, tag), (self.up, up), (self.ended, False), (self.weight, 0)):
            x.append(v)
        return len(self.why) - 1

    def _dropped(self, kept: set[int]) -> list[bool]:
        """Per element whether its text goes; a menu without end tag goes up to the article in it."""
        n = len(self.why)
        open_, rest = [False] * n, [False] * n  # by elements that were never closed; by all others
        for i in range(1, n):
            j = self.up[i]
            open_[i], rest[i] = open_[j], rest[j]
            if self.why[i] == _GATE:
                open_[i] = False
            elif i not in kept:
                if self.why[i] == _HARD and not self.ended[i]:
                    open_[i] = True
                else:
                    rest[i] = True
        return [a or b for a, b in zip(open_, rest)]

    def _choose(self) -> None:
        n, out = len(self.why), self._dropped(set())
        own, total = self.weight.copy(), self.weight.copy()
        seen = [True] * n  # neither hidden nor among reader comments
        best = [0] * n  # the heaviest article or main element inside
        for r in range(1, len(self.region_in)):
            best[self.region_in[r]] = max(best[self.region_in[r]], self.region_weight[r])
        for i in range(1, n):
            seen[i] = seen[self.up[i]] and self.why[i] not in (_READERS, _UNSEEN)
        for i in range(n - 1, 0, -1):
            total[self.up[i]] += total[i]
            best[self.up[i]] = max(best[self.up[i]], best[i])
        page = sum(w for w, s in zip(own, seen) if s)
        left = sum(w for w, o in zip(own, out) if not o)
        regions = sum(w for w, at in zip(self.region_weight[1:], self.region_in[1:]) if not out[at])
        for i in range(1, n):
            if self.why[i] == _GATE:
                own[self.up[i]] += own[i]
        kept, alive = set(), [True] * n
        for i in range(1, n):  # an element comes before those in it
            w, why = total[i], self.why[i]
            if why == _GATE:
                alive[i] = alive[self.up[i]]
                continue
            if why == _READERS:
                keep = not left and 2 * w > total[0]
            elif why == _SOFT or why == _HARD:
                wraps = not regions and 10 * left <= w if self.tag[i] in _NEVER_WRAPS else 10 * regions < w
                keep = w > 0 and 2 * w > page and wraps or best[i] > left
            else:
                keep = False
            alive[i] = keep and alive[self.up[i]]
            if keep:
                kept.add(i)
            if alive[i]:
                left += own[i]
        self.out = self._dropped(kept)

    def lines(self) -> list[tuple[str, int, int, int]]:
        """(text, weight, region, box) of every line that is left."""
        found = []
        for pieces, region, box in self.raw:
            stay = [(p, link) for p, link, node in pieces if not self.out[node]]
            text = " ".join(_html.unescape("".join(p for p, _ in stay)).split())
            if text:
                found.append((text, max(0, len(text) - sum(len(p.strip()) for p, link in stay if link)), region, box))
        return found


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, region) per line; region: the number of the outermost article or main element, 0 outside."""
    return [x[:3] for x in _Page(page).lines()]


def text_blocks(weights: list[int], window: int = WINDOW, threshold: int = 0) -> list[tuple[int, int]]:
    """(surge, dive) line numbers: runs of lines whose window sum is over the threshold."""
    n, total, found, begin = len(weights), 0, [], -1
    total = sum(weights[:window])
    for i in range(n):
        if total > threshold and weights[i] and begin < 0:
            begin = i
        elif begin >= 0 and total <= threshold:
            found.append((begin, i))
            begin = -1
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    if begin >= 0:
        found.append((begin, n))
    return found


def _box_of(page: _Page, weights: list[int], boxes: list[int], lines: Iterable[int]) -> int:
    """The smallest box that holds most of the weight of some lines."""
    total = [0] * len(page.box_up)
    for i in lines:
        total[boxes[i]] += weights[i]
    for i in range(len(total) - 1, 0, -1):
        total[page.box_up[i]] += total[i]
    return max(i for i, w in enumerate(total) if 2 * w > total[0] or not i)  # such boxes lie in one another


def _threshold(weights: list[int], window: int, most: int) -> int:
    """The page's threshold: ``most``, but no more than a part of its heaviest window."""
    total = heaviest = sum(weights[:window])
    for i in range(len(weights) - window):
        total += weights[i + window] - weights[i]
        heaviest = max(heaviest, total)
    return min(most, heaviest // SHARE)


def _extended(page: _Page, boxes: list[int], weights: list[int], box: int, blocks: list[tuple[int, int]], least: int) -> list[int]:
    """The lines of some blocks inside a box, the gaps between them, and what is left of the containers that bear them."""
    n, up = len(page.box_up), page.box_up
    wide = [t in ("", "html", "body") for t in page.box_tag]
    within = [False] * n
    for i in range(n):
        within[i] = i == box or i > 0 and within[up[i]]
    own = [i for x in blocks for i in range(*x) if within[boxes[i]]]
    held = [0] * n
    for i in own:
        held[boxes[i]] += weights[i]
    bears = [w > least for w in held]
    home = bears.copy()
    for i in range(n - 1, 0, -1):  # a headline straight in a container around them
        if home[i] and i != box and within[i] and not wide[up[i]]:
            home[up[i]] = True
    inner = bears.copy()
    for i in range(1, n):
        inner[i] = inner[i] or inner[up[i]] and not wide[up[i]]
    a, b = own[0], own[-1]
    return [i for i in range(len(boxes)) if a <= i <= b or home[boxes[i]] or inner[boxes[i]]]


def main_text(page: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The lines of the text blocks in the container of the main text, snapped to the article or main element that holds
    most of them.

    The container is the smallest one with most of the weight of the page's blocks; if that is the whole page, the smallest
    one with most of the heaviest block.  On a page without long lines an article's links count as text.
    """
    read = _Page(page)
    lines = read.lines()
    weights, boxes = [x[1] for x in lines], [x[3] for x in lines]
    least = _threshold(weights, window, threshold)
    blocks = text_blocks(weights, window, least)
    inside = [t for t, _, r, _ in lines if r]
    outside = sum(w for _, w, r, _ in lines if not r)
    if not blocks or least < threshold and not any(w for _, w, r, _ in lines if r) and sum(map(len, inside)) > outside:
        return "\n".join(inside)  # links only: what an article element holds, if there is one
    a, b = max(blocks, key=lambda x: (sum(weights[x[0]:x[1]]), -x[0]))
    box = _box_of(read, weights, boxes, [i for x in blocks for i in range(*x)])
    if read.box_tag[box] in ("", "html", "body"):
        box = _box_of(read, weights, boxes, range(a, b))
    within = [False] * len(read.box_up)
    for i, up in enumerate(read.box_up):
        within[i] = i == box or i > 0 and within[up]
    joined = [x for x in blocks if any(weights[i] and within[boxes[i]] for i in range(*x))] or [(a, b)]
    a, b = joined[0][0], joined[-1][1]
    region = read.box_region[box]
    if not region:
        by_region: dict[int, int] = {}
        for _, w, r, _ in lines[a:b]:
            by_region[r] = by_region.get(r, 0) + w
        region = max(by_region, key=lambda r: (by_region[r], -r))
        region = region if 2 * by_region[region] > sum(weights[a:b]) else 0
    if not region:
        heavy: dict[int, int] = {}
        for _, w, r, _ in lines:
            heavy[r] = heavy.get(r, 0) + w
        first = max(heavy, key=lambda r: (heavy[r] if r else -1, -r))
        if first and 2 * sum(w for r, w in heavy.items() if r) > sum(weights):
            region = first  # several articles hold most of the page together
    if region:
        total: dict[int, int] = {}
        for _, w, r, _ in lines:
            total[r] = total.get(r, 0) + w
        chosen = {r for r, w in total.items() if r and read.region_box[r] == read.region_box[region] and 2 * w >= total[region] > 0} | {region}
        return "\n".join(t for t, _, r, _ in lines if r in chosen)
    return "\n".join(lines[i][0] for i in _extended(read, boxes, weights, box, joined, least))


def extract_text(pages: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars of every row's whole html; a narrow map."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, window, threshold) for p in text_list(b.column("html"))]
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return map_texts(pick(pages, page_id="bigint", url="string", html="string"), run,
                     "page_id bigint, url string, text string, n_chars bigint")
