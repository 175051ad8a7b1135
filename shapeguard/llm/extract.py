"""Main text of web pages by union-free wrapper inference.

A page becomes a token stream: opening and closing tags of block elements, named
by tag, class and id, and text slots (inline tags dissolve in their slot, open tags
are closed as browsers do, whatever the depth). A host's wrapper is a union-free
regular expression over such tokens. It starts as the first page's stream; each further
page is aligned with it, token by token, and a mismatch is resolved

* between two texts: the slot becomes variable;
* if the page's token comes later among the wrapper's siblings: what lies between is optional;
* if it came before among them: what has stood from there on is a repeated group, and
  the page goes on against it (which also folds a page's own repetitions);
* else the page's element is new and optional.

Every page of a host takes part: tasks fold their own pages into one wrapper a
host, and partial wrappers are aligned with each other, ``FAN_IN`` at a time, until
one is left. So a hot host costs a few wrappers, not pages, in one task. Wrappers hold
no page text, only hashes and lengths.

The wrapper tells what a page's tokens are once the page is aligned with it. The main
region is found from the root down: into the element that holds most of the
characters of its level's variable slots. In the region, slots that stand fixed on
``ENOUGH`` different pages go (but for headings), and, where no tag names the region,
repeated groups of short links. Tags, roles and class words are hints: an article or main
element counts ``HINT`` times in the search, and menus, headers, footers, sidebars,
notices, adverts, forms and reader comments so named are left out of it and of the text,
unless they hold most of the host's variable text. Class words count for containers
only, as whole names, never for headings, paragraphs or list items.

Defined cases: a null or empty html gives an empty text; broken markup is closed
where it ends; pages whose url has no host share the host ""; repeated rows are
extracted alike, and copies of a page count as one; of several regions on a page the
longest is taken, the first of equals; pages of any length, width and depth are taken
whole; if all of a region is fixed, it stays; a page that its wrapper does not lead into
is read by its own wrapper; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import cut, small, strings

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "xmp"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: An opening tag closes these open elements first, up to a container that bounds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOUNDS = {"ul", "ol", "dl", "table", "select"}
SKIPPED = {"nav", "footer", "aside", "form", "button", "select", "label", "fieldset", "dialog", "head", "menu", "audio", "video"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
FURNITURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social comment comments disqus respond "
    "replies reply footer masthead subscribe newsletter signup login popup modal overlay pagination pager banner topbar toolbar skip byline".split()
)
#: Words that say nothing beside furniture words in a name, as in "site-footer" or "share-buttons".
NEUTRAL = set(
    "site page global main primary secondary top bottom left right inner outer box block list links link buttons button bar area wrap wrapper container "
    "section item items group panel form message text js fixed sticky header".split()
)
#: Words and tags of elements that are furniture even where they hold most of a host's text.
ALWAYS = set("ad ads advert adverts advertisement advertising cookie cookies consent gdpr comment comments disqus respond replies reply".split())
CLOSED = SKIPPED - {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold a text themselves: no class word counts for them, and no region is looked for in them.
TEXTUAL = HEADINGS | {"p", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "address", "summary"}
HEADERS = {"header", "heading"}
#: Different pages on which a text must stand alike to be a host's fixed text.
ENOUGH = 3
NEVER = {"html", "body", "main"}
#: How much more an article's or main element's text counts in the search for the region.
HINT = 8
#: A repeated group is a menu if so much of its text is linked and its texts are shorter than this on average.
LINKED, SHORT_TEXT = 0.9, 40


def furnished(names: str) -> set[str]:
    """Furniture words of those class names and ids that consist of such and neutral words only."""
    found: set[str] = set()
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if parts and all(p in FURNITURE or p in NEUTRAL for p in parts):
            found.update(FURNITURE.intersection(parts))
    return found


class Element:
    __slots__ = ("tag", "key", "hidden", "skip", "always", "header", "hint", "mark")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".lower() if found else ""
        parts = {p for p in re.split(r"[^a-z]+", names) if p} if names.strip() else set()
        self.key = " ".join([tag, *sorted(parts)]) if tag not in TEXTUAL else tag
        self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        words = furnished(names) if parts and tag not in NEVER | TEXTUAL else set()
        role = found.get("role", "").lower() in ROLES and tag not in NEVER
        self.skip = tag in SKIPPED or self.hidden or role or bool(words)
        self.always = tag in CLOSED or self.hidden or bool(words & ALWAYS)
        self.header = tag == "header" or (tag not in NEVER | TEXTUAL | {"article"} and bool(HEADERS & set(names.split())))
        self.hint = tag in ("article", "main") and not words & ALWAYS
        self.mark = self.skip * SKIPS | self.always * ALWAYS_SKIPS | self.hint * IS_HINT


# Tokens of a page: ("<", Element), (">",) and ("#", text, linked characters).
# Items of a wrapper: ["<", key, mark, hints], [">"] and ["#", mark, hash or 0, pages, characters, linked characters, texts].
# (pages: the least hashes of up to ENOUGH different pages that have the slot, kept while its text is the same on all)
OPTIONAL, REPEATED = 1, 2
SKIPS, ALWAYS_SKIPS, IS_HINT = 1, 2, 4


#: Attributes that say something of an element.
TELLING = re.compile(r"(?i)class|id\s*=|role|hidden|style")
KNOWN: dict[tuple[str, str], Element] = {}


def element(tag: str, attributes: str) -> Element:
    """The element of a tag; those seen before are kept, up to a number of them."""
    key = tag, attributes if attributes and TELLING.search(attributes) else ""
    found = KNOWN.get(key)
    if found is None:
        if len(KNOWN) > 50_000:
            KNOWN.clear()
        found = KNOWN[key] = Element(*key)
    return found


def parse(page: str) -> list[tuple]:
    """The page's tokens; every opening tag is closed."""
    tokens: list[tuple] = []
    stack, text, at = [""], [], 0
    opened_tags: Counter = Counter()  # so that no stack is searched for what isn't open
    linked = inside_link = 0

    def flush() -> None:
        nonlocal linked
        whole = "".join(text)
        text.clear()
        if whole and not whole.isspace():
            tokens.append(("#", whole, linked))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece)
        text.append(piece)
        if inside_link:
            linked += len(piece.strip())

    def close(upto: int) -> None:
        flush()
        for tag in reversed(stack[upto:]):
            opened_tags[tag] -= 1
            tokens.append((">",))
        del stack[upto:]

    def last(tags: set[str], bounds: set[str] = frozenset()) -> int:
        """The innermost open element of the tags, 0 if a bound or nothing comes first."""
        if not any(opened_tags[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i] in tags:
                return i
            if stack[i] in bounds:
                return 0
        return 0

    while at < len(page):
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                inside_link = 0
            if tag == "br":
                text.append(" ")
            elif tag not in VOID and (i := last({tag})):
                close(i)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end and not m[3].endswith("/") else at if m[3].endswith("/") else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        own = element(tag, m[3])
        if tag in INLINE and not own.skip:
            inside_link = 1 if tag == "a" else inside_link
            continue
        if tag not in INLINE and tag not in ("button", "label", "select") and (i := last({"p"}, BOUNDS | {"td", "th", "button"})):
            close(i)
        if tag in CLOSES and (i := last(CLOSES[tag], BOUNDS if tag != "body" else frozenset())):
            close(i)
            while tag == "tr" and (i := last(CLOSES[tag], BOUNDS)):
                close(i)
        flush()
        tokens.append(("<", own))
        stack.append(tag)
        opened_tags[tag] += 1
    close(1)
    return tokens


def tidy(text: str) -> str:
    return " ".join(text.split())


def checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1


def stream(tokens: list[tuple], learning: bool = True) -> list[list]:
    """A page's tokens as items of a wrapper; what slots hold only if it is to be learnt. The
    page is known by all of its texts: copies are one page."""
    out, slots, page = [], [], 0
    for t in tokens:
        if t[0] == "<":
            e = t[1]
            out.append(["<", e.key, 0, e.mark])
        elif t[0] == ">":
            out.append([">"])
        elif learning:
            text = tidy(t[1])
            code = checksum(text)
            page = zlib.crc32(code.to_bytes(4, "little"), page)
            slots.append(["#", 0, code, None, len(text), min(t[2], len(text)), 1])
            out.append(slots[-1])
        else:
            out.append(["#", 0, 0, [], 0, 0, 0])
    for slot in slots:
        slot[3] = [page]
    return out


def ends(items: list[list]) -> list[int]:
    """Where each item ends: an opening tag at its closing one, others at themselves."""
    out, open_at = list(range(len(items))), []
    for i, item in enumerate(items):
        if item[0] == "<":
            open_at.append(i)
        elif item[0] == ">":
            out[open_at.pop()] = i
    return out


def kind(item: list) -> str:
    return item[1] if item[0] == "<" else "#text"


def marked(item: list, mark: int) -> None:
    item[2 if item[0] == "<" else 1] |= mark


def places(items: list[list], closed: list[int], at: int, stop: int) -> dict[str, list[int]]:
    """Where the siblings of each kind stand."""
    found: dict[str, list[int]] = defaultdict(list)
    while at < stop:
        found[kind(items[at])].append(at)
        at = closed[at] + 1
    return found


def join(a: list, b: list) -> None:
    """One item takes up what another of its kind says."""
    if a[0] == "<":
        a[2] |= b[2]
        a[3] &= b[3]
        return
    a[1] |= b[1]
    a[2] = a[2] if a[2] == b[2] else 0
    a[3] = sorted({*a[3], *b[3]})[:ENOUGH] if a[2] else []
    for i in (4, 5, 6):
        a[i] += b[i]


class Level:
    """Siblings: where the wrapper's stand, and which are written already."""

    __slots__ = ("ahead", "written", "kinds", "fresh")

    def __init__(self, ahead: dict[str, list[int]], fresh: bool):
        self.ahead, self.fresh = ahead, fresh
        self.written: list[tuple[int, str]] = []
        self.kinds: dict[str, list[int]] = defaultdict(list)

    def wrote(self, at: int, kind_: str) -> None:
        self.written.append((at, kind_))
        self.kinds[kind_].append(at)

    def back_to(self, at: int) -> None:
        while self.written and self.written[-1][0] >= at:
            self.kinds[self.written.pop()[1]].pop()


def align(wrapper: list[list], page: list[list], met: dict[int, list] | None = None) -> list[list]:
    """The wrapper of what the wrapper and the page (or another wrapper) describe. With ``met``
    nothing is learnt; it is told which item of the wrapper each of the page's items met."""
    learning, out = met is None, []
    w, w_ends, p_ends, i, j = wrapper, ends(wrapper), ends(page), 0, 0
    levels = [Level(places(w, w_ends, 0, len(w)), not wrapper)]
    frames: list[tuple] = []  # wrappers to go back to: the one before a repeated group or a new element

    def leave() -> bool:
        """Back from a group or new element that is through."""
        nonlocal w, w_ends, i
        if i == len(w) and frames and frames[-1][0] == len(levels):
            _, w, w_ends, i, levels[-1].ahead = frames.pop()
            return True
        return False

    def enter(items: list[list]) -> None:
        nonlocal w, w_ends, i
        frames.append((len(levels), w, w_ends, i, levels[-1].ahead))
        w, w_ends, i = items, ends(items), 0
        levels[-1].ahead = places(w, w_ends, 0, len(w))

    def pass_over(stop: int) -> None:
        """The wrapper's next items, which the page lacks."""
        nonlocal i
        while i < stop:
            if learning:
                marked(w[i], OPTIONAL)
            levels[-1].wrote(len(out), kind(w[i]))
            out.extend(w[i : w_ends[i] + 1])
            i = w_ends[i] + 1

    def after_group(own: str) -> bool:
        """Whether the kind comes later among the siblings, behind a group that is not through."""
        for depth, _, _, at, ahead in reversed(frames):
            if depth != len(levels):
                return False
            later = ahead.get(own, ())
            if bisect_left(later, at) < len(later):
                return True
        return False

    def rest() -> None:
        """The wrapper's items up to the end of the level, groups included."""
        while True:
            while i < len(w) and w[i][0] != ">":
                pass_over(w_ends[i] + 1)
            if not leave():
                return

    while j < len(page):
        while leave():
            pass
        level, p = levels[-1], page[j]
        if p[0] == ">":
            rest()
            out.append(w[i])
            levels.pop()
            i, j = i + 1, j + 1
            continue
        own = kind(p)
        if i < len(w) and w[i][0] != ">":
            if kind(w[i]) != own:
                later = level.ahead.get(own, ())
                at = bisect_left(later, i)
                if at < len(later):
                    pass_over(later[at])
            if kind(w[i]) == own:
                item = w[i]
                level.wrote(len(out), own)
                out.append(item)
                if learning:
                    if item is not p:
                        join(item, p)
                else:
                    met[j] = item
                if p[0] == "<":
                    inner = places(w, w_ends, i + 1, w_ends[i])
                    levels.append(Level(inner, len(w) == 2 and bool(frames) and frames[-1][0] == len(levels)))
                i, j = i + 1, j + 1
                continue
        if after_group(own):
            pass_over(len(w))
        elif level.kinds.get(own):  # it came before: a group repeats
            start = level.kinds[own][-1]
            group = out[start:]
            del out[start:]
            level.back_to(start)
            if learning:
                closed = ends(group)
                at = 0
                while at < len(group):
                    marked(group[at], REPEATED)
                    at = closed[at] + 1
            enter(group)
        else:  # new
            item = list(p) if learning else p
            if learning and not level.fresh:
                marked(item, OPTIONAL)
            if p[0] == "#":
                level.wrote(len(out), own)
                out.append(item)
                j += 1
            elif not learning:  # nothing to learn from it
                level.wrote(len(out), own)
                out.extend(page[j : p_ends[j] + 1])
                j = p_ends[j] + 1
            else:
                enter([item, [">"]])
    while True:
        rest()
        if not frames:
            return out


def wrapper(tokens: list[tuple]) -> list[list]:
    """The wrapper of one page."""
    return align([], stream(tokens))


def constant(item: list) -> bool:
    """Whether a text slot is the same on enough different pages."""
    return bool(item[2]) and len(item[3]) >= ENOUGH


class Reading:
    """What a host's wrapper says about its pages: the region's item, the kinds of furniture
    that are none as they hold most of the text, and the slots that are template or menu."""

    def __init__(self, items: list[list]):
        self.items, closed = items, ends(items)
        n = len(items)
        variable, hinted = [0] * n, [False] * n
        total = [0]
        for i, item in enumerate(items):  # sums from prefix sums, as elements are ranges
            total.append(total[-1] + (0 if item[0] != "#" or constant(item) else item[4]))
        hints = [0]
        for item in items:
            hints.append(hints[-1] + (item[0] == "<" and item[3] & IS_HINT and not item[3] & SKIPS > 0))
        for i in range(n):
            variable[i] = total[closed[i] + 1] - total[i]
            hinted[i] = hints[closed[i] + 1] > hints[i]
        self.kept = self.opened(closed, variable)
        weight = lambda i: 0 if self.furniture(items[i]) else variable[i] * (HINT if hinted[i] else 1)
        self.region, at, stop, named = None, 0, n, False
        while True:
            children = []
            while at < stop:
                children.append(at)
                at = closed[at] + 1
            inner = [c for c in children if items[c][0] == "<" and items[c][1].split(" ")[0] not in TEXTUAL]
            largest = max(inner, key=weight, default=None)
            if largest is None or not weight(largest) or weight(largest) < 0.6 * sum(map(weight, children)):
                break
            self.region, named = items[largest], named or bool(items[largest][3] & IS_HINT)
            at, stop = largest + 1, closed[largest]
        self.dropped = {id(item) for item in items if item[0] == "#" and constant(item)}
        if not named:
            self.dropped |= self.menus(closed)

    def furniture(self, item: list) -> bool:
        return item[0] == "<" and bool(item[3] & SKIPS) and item[1] not in self.kept

    def opened(self, closed: list[int], variable: list[int]) -> set[str]:
        """Kinds of furniture that hold most of the host's variable text, and so are none."""
        items, found, at, stop = self.items, set(), 0, len(self.items)
        whole = sum(item[4] for item in items if item[0] == "#" and not constant(item))
        while True:
            large = None
            while at < stop:
                if items[at][0] == "<" and 2 * variable[at] > whole:
                    large = at
                at = closed[at] + 1
            if large is None or items[large][3] & ALWAYS_SKIPS:
                return found
            if items[large][3] & SKIPS:
                found.add(items[large][1])
            at, stop = large + 1, closed[large]

    def menus(self, closed: list[int]) -> set[int]:
        """Slots of repeated groups that are short links."""
        found: set[int] = set()
        for i, item in enumerate(self.items):
            if item[0] == "<" and item[2] & REPEATED:
                slots = [x for x in self.items[i : closed[i] + 1] if x[0] == "#"]
                chars, linked, n = (sum(x[k] for x in slots) for k in (4, 5, 6))
                if chars and linked >= LINKED * chars and chars < SHORT_TEXT * n:
                    found.update(map(id, slots))
        return found


def blocks(tokens: list[tuple], at: int, stop: int, kept: set[str], gone: set[int]) -> list[str]:
    """The texts of the tokens from ``at`` to ``stop``; of headers only the headings."""
    out: list[str] = []
    stack: list[tuple[bool, bool, bool]] = []  # skipped, in a header, a heading
    skip = header = heading = False
    for j in range(at, stop):
        t = tokens[j]
        if t[0] == "<":
            e = t[1]
            stack.append((skip, header, heading))
            skip = skip or e.hidden or (e.skip and e.key not in kept)
            header, heading = header or e.header, e.tag in HEADINGS
        elif t[0] == ">":
            skip, header, heading = stack.pop()
        elif not skip and (heading or not header) and (heading or j not in gone):
            text = tidy(t[1])
            if text:
                out.append(text)
    return out


def main_text(tokens: list[tuple], host: list[list], reading: Reading | None = None) -> str:
    """The blocks of a page's main region, by its host's wrapper."""
    reading, own = reading or Reading(host), stream(tokens, False)
    closed, met = ends(own), {}
    align(host, own, met)

    def regions() -> list[int]:
        if reading.region is None:
            return []
        return [j for j, item in met.items() if item is reading.region]

    found = regions()
    if not found and reading.region is not None:  # this page goes another way
        met, alone = {}, wrapper(tokens)
        reading = Reading(alone)
        align(alone, own, met)
        found = regions()
    gone = {j for j, item in met.items() if id(item) in reading.dropped}
    spans = [(j + 1, closed[j]) for j in found] or [(0, len(tokens))]
    texts = [blocks(tokens, a, b, reading.kept, gone) or blocks(tokens, a, b, reading.kept, set()) for a, b in spans]
    return "\n\n".join(max(texts, key=lambda t: sum(map(len, t))))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages as one wrapper a host."""
    hosts: dict[str, list] = {}
    part = TaskContext.get().partitionId()
    out = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())])

    def rows() -> pa.RecordBatch:
        found = [{"host": h, "part": part, "wrapper": json.dumps(w)} for h, w in hosts.items()]
        hosts.clear()
        return pa.RecordBatch.from_pylist(found, out)

    for batch in small(batches):
        for host, page in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
            hosts[host] = align(hosts.get(host, []), stream(parse(page)))
        if len(hosts) > 20_000:
            yield rows()
    yield rows()


def _merged(table: pa.Table) -> pa.Table:
    whole: list[list] = []
    for text in sorted(table["wrapper"].to_pylist()):
        whole = align(whole, json.loads(text))
    return pa.table({"host": table["host"][:1], "part": table["part"][:1], "wrapper": [json.dumps(whole)]})


WRAPPERS = "host string, part long, wrapper string"
#: Wrappers of one host that a task aligns at once.
FAN_IN = 64
BROADCAST_BYTES = 4 << 20


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row a host, from all its pages."""
    own = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html"))
    found = cut(own.mapInArrow(_partial, WRAPPERS), "partial")
    parts = 1 + (found.agg(F.max("part")).first()[0] or 0)
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("host", "part").applyInArrow(_merged, WRAPPERS)
        parts = -(-parts // FAN_IN)
        if parts == 1:
            return found.select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Reading] = {}
    for batch in small(batches):
        out = []
        for page, text in zip(strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            tokens = parse(page)
            if text is None:
                out.append(main_text(tokens, wrapper(tokens)))
                continue
            if text not in known:
                if len(known) > 500:
                    known.clear()
                known[text] = Reading(json.loads(text))
            out.append(main_text(tokens, known[text].items, known[text]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    found = cut(wrappers(pages), "wrappers")
    total = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    table = F.broadcast(found) if total <= BROADCAST_BYTES else found
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of().alias("host"))
    joined_pages = own.join(table, "host", "left").select("page_id", "url", "html", "wrapper")
    schema = T.StructType([own.schema["page_id"], own.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined_pages.mapInArrow(_extract, schema)
