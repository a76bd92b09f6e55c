"""Main text of web pages by union-free wrapper inference.

A page becomes a tree of block elements and text slots, the token stream with its tags
matched. Neighbouring groups of one kind fold into repeated groups; the folded pages of a
host are aligned one after the other, and where they differ the alignment makes optional or
repeated groups. The result, a regular expression without unions, is the host's wrapper.

Then each page is matched against its host's wrapper, which gives every text its slot: a
place in the expression. Slots in an article or main element are main; a page with text in these gives
that text. In others a slot's texts over all pages of the host tell what is the template's: texts that recur in
their slot, slots of links. Slots in elements that are set aside by name or mark (menus, adverts, comments) give none.

Alignment is a merge of two wrappers, so each task merges what it reads and a host's
partial wrappers are merged in two rounds after the shuffle: no page leaves its task
and no host's pages meet in one.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .urls import host_of

#: Tags without quotes, or with quoted values that hold no angle brackets; others are scanned.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*+")
_PLAIN = re.compile(r"[^<>\"']*+")
_ATTR = re.compile(r"([^\s=<>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_SPACE = re.compile(r"\s+")
#: Elements whose content isn't text of the page; of the first, an unclosed one reaches to the end.
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())
RAW = RAW_TEXT | frozenset("template svg math select option object".split())
_ENDS = {t: re.compile(rf"</{t}(?![a-z0-9:-])[^<>]*>?", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't break a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that aren't main text.
ASIDE = frozenset("nav header footer aside form button menu dialog head".split())
#: Words that mark an element, if its class, id or role has a token of these and common words only (comment-list, sidebar).
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus feedback footer "
                  "header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion reactions related remark remarks replies reply respond "
                  "responses share sharing sidebar social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
COMMON = frozenset("area bar block body bottom box buttons container content fixed form inner item items left links list main outer page post posts right section site sticky text "
                   "thread top user visitor reader wrap wrapper".split())
#: Of these also an inline element is left out.
ADVERT = frozenset("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored sponsors".split())
MAIN = frozenset("article main".split())
#: Elements that hold a whole page: a mark on them says what the page has, not what it is. An article in an article keeps its mark.
WHOLE = frozenset("html body article main".split())
#: Elements that an opening tag of the same kind ends.
SELF_ENDING = frozenset("p li dt dd tr td th".split())
#: A p is also ended by these.
ENDS_P = frozenset("p div article section ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 footer header nav aside form main hr figure".split())
#: Elements of which neighbours are repetitions whatever they hold; others only if they look alike.
REPEATED = frozenset("# p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure".split())
#: Deeper elements count as part of the one at this depth. Longer lists become a repeated group of optional members.
DEPTH, WIDE = 48, 64
#: A text is the template's if at least so many pages of its host have it in the same slot, and at least half of those that have the slot.
FIXED_PAGES = 3
#: A copyright line outside an article.
_NOTICE = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


def _marks(attrs: str) -> tuple[str, str]:
    """First class or id token without digits, and the first mark of class, id and role."""
    name = mark = ""
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            if m[2] and m[1].lower() in ("class", "id", "role"):
                for token in m[2].strip("\"'").lower().split():
                    name = name or re.sub(r"[^a-z]+", "-", token)
                    words = [w for w in re.split(r"[^a-z]+", token) if w]
                    if not mark and words and all(w in MARKS or w in COMMON for w in words):
                        mark = next((w for w in words if w in MARKS), "")
    return name, mark


def _tag(page: str, at: int, lost: dict[str, int]) -> tuple[bool, str, str, int] | None:
    """Whether it ends an element, name, attributes and end of the tag that begins there; None if none does.

    A quote is one only if its pair is followed by what may follow a value, so that an
    unbalanced quote doesn't swallow the page. lost: quotes of which no more are to come, so that time is linear.
    """
    m = _TAG.match(page, at)
    if m:
        return bool(m[1]), m[2].lower(), m[3], m.end()
    m = _NAME.match(page, at)
    if not m:
        return None
    k, n = m.end(), len(page)
    while k < n:
        k = _PLAIN.match(page, k).end()
        if k >= n or page[k] in "<>":
            break
        q = page[k]
        end = -1 if k >= lost.get(q, n) else page.find(q, k + 1)
        if end < 0:
            lost[q] = min(lost.get(q, n), k)
        k = end + 1 if end >= 0 and (end + 1 == n or page[end + 1] in " \t\r\n\f/>") else k + 1
    return page[at + 1] == "/", m[0].lstrip("</").lower(), page[m.end():k], k + (k < n and page[k] == ">")


class Page:
    """A page's text blocks, and the tree of their elements: ["#", [block]] is a slot, [name, children] an element."""

    def __init__(self, page: str | None):
        self.texts: list[str] = []
        self.links: list[int] = []  # characters in links
        self.place: list[str] = []  # main: in an article or main element; aside: in an element set aside; other
        self.tree: list = []
        if page:
            self._read(page)

    def _read(self, page: str) -> None:
        # Open elements: tag, children, place of its texts. Counts by tag, so that an end tag of none costs nothing.
        stack: list[tuple[str, list, str]] = [("", self.tree, "other")]
        open_: dict[str, int] = {}
        text: list[str] = []
        links = in_link = 0
        skip, deep = "", 0  # an inline advert, and how many elements of its kind are open in it
        lost: dict[str, int] = {}
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal links
            if text:
                t = _SPACE.sub(" ", "".join(text)).strip()
                if t:
                    stack[-1][1].append(["#", [len(self.texts)]])
                    self.texts.append(t)
                    self.links.append(min(links, len(t)))
                    self.place.append(stack[-1][2])
                text.clear()
            links = 0

        def close(upto: int) -> None:
            flush()
            for tag, *_ in stack[upto:]:
                open_[tag] -= 1
            del stack[upto:]

        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt != at:
                t = page[at:lt] if lt >= 0 else page[at:]
                at = lt if lt >= 0 else n
                if not skip:
                    t = entities.unescape(t) if "&" in t else t
                    text.append(t)
                    links += in_link * len(t)
                continue
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else n
                continue
            if page[at + 1:at + 2] in ("!", "?"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
                continue
            got = _tag(page, at, lost)
            if got is None:
                if not skip:
                    text.append("<")
                at += 1
                continue
            end, tag, attrs, at = got
            if tag in RAW:
                if not end and not attrs.rstrip().endswith("/") and tag not in unclosed:
                    stop = _ENDS[tag].search(page, at)
                    if stop:
                        at = stop.end()
                    elif tag in RAW_TEXT:
                        at = n
                    else:
                        unclosed.add(tag)
                continue
            if tag in INLINE:
                if skip:
                    if tag == skip:
                        deep += -1 if end else 1
                        skip = skip if deep else ""
                elif not end and "=" in attrs and tag not in VOID and _marks(attrs)[1] in ADVERT:
                    skip, deep = tag, 1
                elif tag == "a":
                    in_link = 0 if end else 1
                continue
            skip = ""  # an inline element ends with its block
            if tag in VOID:
                text.append(" ")
                if tag in ("br", "hr"):
                    flush()
            elif end:
                if open_.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    close(k)
                else:
                    flush()
            else:
                last = stack[-1][0]
                if last == "p" and tag in ENDS_P or last == tag and tag in SELF_ENDING:
                    close(len(stack) - 1)
                flush()
                in_link = 0
                name, mark = _marks(attrs) if "=" in attrs else ("", "")
                if tag in WHOLE and not (tag == "article" and open_.get("article")):
                    mark = ""
                place = stack[-1][2]
                if place != "aside":
                    place = "aside" if tag in ASIDE or mark else "main" if tag in MAIN else place
                children = stack[-1][1]
                if len(stack) <= DEPTH:
                    node = [(f"{tag}.{name}" if name else tag) + "!" * (mark != ""), []]
                    children.append(node)
                    children = node[1]
                stack.append((tag, children, place))
                open_[tag] = open_.get(tag, 0) + 1
        flush()

    @cached_property
    def folded(self) -> list:
        return fold(self.tree)


# A wrapper is a list of nodes: ["#", blocks] a slot, [name, nodes] an element (tag, first class, ! if it has a mark), ["+", nodes] a
# repeated group, ["?", [node]] an optional node, ["*", nodes] a repeated group of optional nodes of different names.


def signature(nodes: list) -> str:
    return " ".join("#" if x[0] == "#" else f"{x[0]}({signature(x[1])})" for x in nodes)


def _join(a: list, b: list) -> list:
    """One node for two of a name; a slot of the first takes the blocks of the second's."""
    if a[0] == "#":
        a[1].extend(b[1])
        return a
    return [a[0], align(a[1], b[1])]


def _tag_of(name: str) -> str:
    return name.partition(".")[0].rstrip("!")


def _alike(a: list, b: list) -> bool:
    return a[0] == b[0] and (_tag_of(a[0]) in REPEATED or signature([a]) == signature([b]))


def fold(nodes: list, longest: int = 8) -> list:
    """The list with neighbouring nodes, then groups, of one kind as one repeated group; without elements that hold no text."""
    out: list = []
    for x in nodes:
        if x[0] != "#":
            inner = fold(x[1], longest)
            if not inner:
                continue
            x = [x[0], inner]
        if out:
            last = out[-1]
            one = last[1][0] if last[0] == "+" and len(last[1]) == 1 else last
            if one[0] not in "+?*" and _alike(one, x):
                out[-1] = ["+", [_join(one, x)]]
                continue
        out.append(x)
    if len(out) > 8 * WIDE:
        return _wide(out)
    keys = [signature([x]) for x in out]
    for size in range(2, min(longest, len(out) // 2) + 1):
        i = 0
        while i + 2 * size <= len(out):
            k = i + size
            while keys[i:i + size] == keys[k:k + size]:
                k += size
            if k > i + size:
                group = out[i:i + size]
                for j in range(i + size, k, size):
                    group = [_join(x, y) for x, y in zip(group, out[j:j + size])]
                out[i:k] = [["+", group]]
                keys[i:k] = [signature([out[i]])]
            i += 1
    return _wide(out) if len(out) > WIDE else out


def _bare(x: list) -> list:
    """The node in an optional or repeated group of one."""
    while x[0] in "+?" and len(x[1]) == 1:
        x = x[1][0]
    return x


def _wide(nodes: list) -> list:
    """The list as a repeated group of optional nodes, one a name."""
    by: dict[str, list] = {}

    def add(x: list) -> None:
        if x[0] in ("*", "+", "?"):
            for y in x[1]:
                add(y)
        else:
            by[x[0]] = _join(by[x[0]], x) if x[0] in by else x
    for x in nodes:
        add(x)
    return [["*", [by[k] for k in sorted(by)]]]


def _fits(x: list, y: list) -> bool:
    """Whether one node can stand for both."""
    if x[0] == y[0] == "+" and len(x[1]) == len(y[1]) > 1:
        return all(p[0] == q[0] for p, q in zip(x[1], y[1]))
    a, b = _bare(x), _bare(y)
    return a[0] == b[0] and a[0] not in "+?"


def _both(x: list, y: list) -> list:
    """The node that stands for two that fit: repeated or optional if one of them is."""
    if x[0] == y[0] == "+" and len(x[1]) > 1:
        return ["+", [_join(p, q) for p, q in zip(x[1], y[1])]]
    got = _join(_bare(x), _bare(y))
    if _repeated(x) or _repeated(y):
        got = ["+", [got]]
    return ["?", [got]] if "?" in (x[0], y[0]) else got


def _repeated(x: list) -> bool:
    while x[0] == "?":
        x = x[1][0]
    return x[0] == "+"


def _path(a: list, b: list) -> Iterator[tuple[int | None, int | None]]:
    """The alignment of two lists that lets most nodes stand for both."""
    n, m, lo = len(a), len(b), 0
    while lo < min(n, m) and _fits(a[lo], b[lo]):  # no alignment matches more by leaving out heads that fit
        yield lo, lo
        lo += 1
    fit = [[_fits(x, y) for y in b[lo:]] for x in a[lo:]]
    n, m = n - lo, m - lo
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if fit[i][j] else max(below[j], row[j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and fit[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            yield lo + i, lo + j
            i, j = i + 1, j + 1
        elif i < n and (j >= m or best[i + 1][j] >= best[i][j + 1]):
            yield lo + i, None
            i += 1
        else:
            yield None, lo + j
            j += 1


def _grouped(nodes: list) -> list:
    """The list with neighbouring nodes of one name, which alignment made optional, as a repeated group."""
    out: list = []
    for x in nodes:
        one = _bare(x)
        if out and _tag_of(one[0]) in REPEATED and _bare(out[-1])[0] == one[0]:
            last = _both(out[-1], x)
            out[-1] = last if _repeated(last) else ["?", [["+", last[1]]]] if last[0] == "?" else ["+", [last]]
        else:
            out.append(x)
    return out


def align(a: list, b: list) -> list:
    """One wrapper for two: what both have stays, repeated if it is in one of them; what only one has becomes optional."""
    if len(a) == len(b) == 1 and a[0][0] == b[0][0] == "#":
        return [_join(a[0], b[0])]
    if any(w and w[0][0] == "*" for w in (a, b)) or max(len(a), len(b)) > WIDE:
        return _wide(a + b)
    out = []
    for i, j in _path(a, b):
        if i is None or j is None:
            x = a[i] if j is None else b[j]
            out.append(x if x[0] == "?" else ["?", [x]])
        else:
            out.append(_both(a[i], b[j]))
    return _grouped(out)


def slots(nodes: list) -> list[list]:
    """The slots of a list of nodes, in order."""
    out: list = []
    for x in nodes:
        out += [x[1]] if x[0] == "#" else slots(x[1])
    return out


def match(wrapper: list, page: list) -> list[int | None]:
    """For each slot of a folded page, in order, the number of the wrapper's slot that it falls in; None if in none."""
    found: dict[int, int] = {}
    number = {id(s): k for k, s in enumerate(slots(wrapper))}

    def lists(a: list, b: list) -> None:
        if a and a[0][0] == "*":
            by = {x[0]: x for x in a[0][1]}
            for y in b:
                wide(by, y)
        elif len(b) <= 4 * WIDE:
            for i, j in _path(a, b):
                if i is not None and j is not None:
                    x, y = a[i], b[j]
                    if x[0] == y[0] == "+" and len(x[1]) > 1:
                        for p, q in zip(x[1], y[1]):
                            node(p, q)
                    else:
                        node(_bare(x), _bare(y))

    def wide(by: dict, y: list) -> None:
        if y[0] in ("*", "+", "?"):
            for z in y[1]:
                wide(by, z)
        elif y[0] in by:
            node(by[y[0]], y)

    def node(x: list, y: list) -> None:
        if y[0] == "#":
            found[id(y[1])] = number[id(x[1])]
        else:
            lists(x[1], y[1])

    lists(wrapper, page)
    return [found.get(id(s)) for s in slots(page)]


def _bared(nodes: list) -> list:
    return [["#", []] if x[0] == "#" else [x[0], _bared(x[1])] for x in nodes]


def _places(nodes: list, place: str = "other") -> list[str]:
    """For each slot main (in an article or main element), aside (in an element set aside) or other."""
    out: list = []
    for x in nodes:
        if x[0] == "#":
            out.append(place)
        else:
            tag = _tag_of(x[0])
            out += _places(x[1], "aside" if place == "aside" or tag in ASIDE or x[0][-1] == "!" else "main" if tag in MAIN else place)
    return out


class Wrapper:
    """A host's regular expression, and whether a page of it has texts but none in an article or main element."""

    def __init__(self, regex: list | None = None, open_: bool = False):
        self.regex, self.open, self._seen = regex, open_, set()
        self._slots: dict[str, list] = {}

    def add(self, page: Page) -> None:
        self.open |= "other" in page.place and "main" not in page.place
        key = signature(page.folded)
        if key not in self._seen:
            if len(self._seen) < 4096:  # of a known form: aligning it again would change nothing
                self._seen.add(key)
            self.merge(Wrapper(_bared(page.folded)))

    def merge(self, other: Wrapper) -> None:
        self.open |= other.open
        if other.regex is not None:
            self.regex = other.regex if self.regex is None else align(self.regex, other.regex)

    def slots_of(self, page: Page) -> list[tuple[int | None, str]]:
        """For each block of a page the slot that it falls in, and that slot's place (the block's own if it falls in none)."""
        key = signature(page.folded)
        if key not in self._slots:
            if len(self._slots) >= 4096:
                self._slots.clear()
            places = _places(self.regex or [])
            self._slots[key] = [(k, "" if k is None else places[k]) for k in match(self.regex or [], page.folded)]
        out: list = [(None, p) for p in page.place]
        for blocks, (k, place) in zip(slots(page.folded), self._slots[key]):
            if k is not None:
                for b in blocks:
                    out[b] = (k, place)
        return out

    def dump(self) -> str:
        return json.dumps([self.regex, self.open], separators=(",", ":"), ensure_ascii=False)

    @staticmethod
    def load(s: str | None) -> Wrapper:
        return Wrapper(*json.loads(s)) if s else Wrapper()


@lru_cache(1 << 16)
def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _of_links(page: Page, k: int) -> bool:
    return 2 * page.links[k] > len(page.texts[k])


def _running(page: Page, slot_of: list) -> list[int]:
    """Blocks that may be main text in a page without an article: not set aside, not of links, no copyright line."""
    return [k for k, (_, place) in enumerate(slot_of) if place == "other" and 2 * page.links[k] <= len(page.texts[k]) and not _NOTICE.match(page.texts[k])]


def main_blocks(page: Page, wrapper: Wrapper, fixed: frozenset = frozenset()) -> list[str]:
    """Texts of a page's blocks in main slots; in a page without such text its running text less
    the template's (fixed: slot and digest of each), or, if nothing else is there (a copy of other pages), with it."""
    slot_of = wrapper.slots_of(page)
    inner = [t for t, (_, place) in zip(page.texts, slot_of) if place == "main"]
    if inner:
        return inner
    running = _running(page, slot_of)
    return [page.texts[k] for k in running if (slot_of[k][0], _digest(page.texts[k])) not in fixed] or [page.texts[k] for k in running]


#: Largest table of wrappers that is broadcast; beyond it pages are joined by host.
BROADCAST_BYTES = 32 << 20
#: Groups that a host's partial wrappers are merged in first.
SALTS = 16


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and open (whether it decides anything on one of its pages) from all pages (host, html)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Wrapper] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([w.dump() for w in own.values()], pa.string())], ["host", "wrapper"])
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own.setdefault(host, Wrapper()).add(Page(page))
            if len(own) > 20_000:  # bounded memory: what is left is merged after the shuffle
                yield rows()
                own.clear()
        if own:
            yield rows()

    def merged(parts: pd.DataFrame) -> Wrapper:
        w = Wrapper()
        for s in sorted(parts["wrapper"]):
            w.merge(Wrapper.load(s))
        return w

    def some(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [merged(df).dump()]})

    def whole(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        w = merged(df)
        return pd.DataFrame({"host": [key[0]], "wrapper": [w.dump()], "open": [w.open]})

    parts = pages.select("host", "html").mapInArrow(partial, "host string, wrapper string").distinct()
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(some, "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(whole, "host string, wrapper string, open boolean")


def fixed_texts(pages: DataFrame) -> DataFrame:
    """host, fixed (slot and digest of each text of the template) from the pages (host, html, wrapper) of hosts where it matters."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for b in batches:
            counts: dict[tuple, int] = {}
            for host, page, w in zip(*(b.column(k).to_pylist() for k in range(3))):
                p = Page(page)
                own = _known(known, host, w).slots_of(p)
                texts = {(own[k][0], _digest(p.texts[k])) for k in _running(p, own)}
                for key in {(s, None) for s, _ in texts} | texts:
                    counts[host, *key] = counts.get((host, *key), 0) + 1
            host, slot, text = zip(*counts) if counts else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(slot, pa.int64()), pa.array(text, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "slot", "text", "n"])

    on = pages.filter("host <> ''").select("host", "html", "wrapper").mapInArrow(count, "host string, slot long, text long, n long").filter("slot is not null")
    on = stored(on.groupBy("host", "slot", "text").agg(F.sum("n").alias("n")), "slot_texts")
    slot = on.filter("text is null")
    text = on.filter(f"text is not null and n >= {FIXED_PAGES}")
    fixed = text.alias("t").join(slot.alias("s"), F.expr("t.host = s.host and t.slot = s.slot")).filter("2 * t.n >= s.n")
    return fixed.groupBy("t.host").agg(F.collect_set(F.struct("t.slot", "t.text")).alias("fixed"))


def _known(known: dict, host: str, wrapper: str | None) -> Wrapper:
    if host not in known:
        if len(known) >= 5000:
            known.clear()
        known[host] = Wrapper.load(wrapper)
    return known[host]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    White space inside a block is one space, blocks are joined by one space. A null or
    empty page, or one without main text, gives an empty text; a null url counts as
    the empty host, which has no template. Repeated rows come again (and count again for what recurs), an
    empty table gives none, other columns are ignored. A page is read whole, in time linear in its length.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = stored(infer(d), "wrappers")

    def with_side(rows: DataFrame, side: DataFrame, size, how: str) -> DataFrame:
        n = side.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
        side = side.withColumnRenamed("host", "_host")
        return rows.join(F.broadcast(side) if n <= BROADCAST_BYTES else side, F.col("host") == F.col("_host"), how).drop("_host")

    d = with_side(d, wrappers.select("host", "wrapper", "open"), F.length("wrapper") * 3, "inner")
    # What recurs matters only on hosts of which a page has texts, but none in an article or main element.
    if wrappers.filter("open").limit(1).count():
        fixed = stored(fixed_texts(d.filter("open")), "fixed")
        d = with_side(d, fixed, F.size("fixed") * 32, "left")
    else:
        d = d.withColumn("fixed", F.lit(None).cast("array<struct<slot:bigint,text:bigint>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        fixed: dict[str, frozenset] = {}
        for b in batches:
            text = []
            for host, page, w, own in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                if len(fixed) >= 5000:
                    fixed.clear()
                if host not in fixed:
                    fixed[host] = frozenset((x["slot"], x["text"]) for x in own or ())
                text.append(" ".join(main_blocks(Page(page), _known(known, host, w), fixed[host])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return d.select("page_id", "url", "host", "html", "wrapper", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
