"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside navigation, headers, footers, sidebars, notices, adverts,
forms and reader comments, by tag, role, class or id, are structure and take no part. Forms and common words of classes
are evidence of structure only: a page without a content mark outside of them is read with the marked content inside, and one
that would lose most of its running text to them is read without them. A long paragraph of running text is never structure by its own class.
Buttons and labels are no text. Pass one labels every other block
by its length, its density of stop words and its density of links: kept, left out or undecided. Pass two gives an
undecided block the label of its nearest decided neighbours. Where a page marks its content (article or main), blocks
outside of it are left out, and short blocks inside need only that no decided neighbour speaks against them.

Null and empty pages have the empty text. Pages of any length are read whole, in time linear in their length; broken
markup never fails. An element whose content is left out and that is never closed leaves nothing out, but for scripts and
styles, whose rest is code. A block as far from a kept as from a left-out neighbour follows the kept one inside marked
content and the left-out one elsewhere. Repeated pages give repeated results, an empty table an empty result, and extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import map_arrow

#: Fixed lists: frequent words of four languages, tags that end a block, tags whose content is never text, tags of page
#: structure, and words of classes, ids and roles that mark it.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais comme être sa cette ont ses été aussi leur fait nous vous elle tout "
    "el que y los las del se por un para con no una su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style title template noscript textarea iframe object svg math canvas audio video noembed xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STRUCTURE_TAGS = frozenset("nav footer aside form menu dialog select head search fieldset".split())
STRUCTURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
STRUCTURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners promo promos promotion sponsor sponsored sponsors "
    "sidebar sidebars rail nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup paywall login "
    "share sharing social related recommended recommendations recirculation trending popular comment comments commentlist disqus reply replies respond "
    "widget widgets popup modal overlay pagination pager skip hidden".split()
)
#: Words that also stand in classes of content; with forms, they are evidence only.
EVIDENCE_WORDS = frozenset("rail foot share sharing social related recommended recommendations recirculation trending popular widget widgets overlay modal popup hidden skip banner banners promo promos promotion notice notices login reply respond signup subscription pager".split())
EVIDENCE_TAGS = frozenset("form fieldset search".split())
#: Elements within a line whose text is no text of the page, and tags of running text.
MUTE_TAGS, TEXT_TAGS = frozenset("button label".split()), frozenset("p blockquote pre li dd".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Characters of a block from which it is long, and of one that is short; least stop-word densities; most link density.
LONG, SHORT, DENSE, SPARSE, LINKS = 200, 70, 0.30, 0.10, 0.5

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Starts and ends of an element whose content is left out; those of raw text have no elements of their kind inside.
_WITHIN = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in RAW_TAGS}
_FLAT_TAGS = frozenset("script style title textarea iframe noembed xmp".split())
#: Open elements that the start of another ends.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


def is_structure(tag: str, raw: str, in_content: bool) -> int:
    """Whether an element is page structure rather than content: 0 for no, 1 for evidence of it, 2 for yes."""
    if tag in EVIDENCE_TAGS:
        return 1
    if tag in STRUCTURE_TAGS or (tag == "header" and not in_content):
        return 2
    if "=" not in raw and "hidden" not in raw:
        return 0
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("role", "").lower() in STRUCTURE_ROLES:
        return 2
    names = {w.lower() for w in _NAME_PARTS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    if tag in ("html", "body", "main", "article"):
        return 2 * (tag == "article" and bool(names & COMMENT_WORDS))
    if not in_content and "header" in names:
        return 2
    found = names & STRUCTURE_WORDS
    return 2 if found - EVIDENCE_WORDS else int(bool(found))


class Block:
    __slots__ = ("content", "doubt", "inner", "label", "linked", "links", "own", "text")

    def __init__(self, text: str, linked: int, links: int, content: bool, doubt: bool, inner: bool, own: bool):
        self.text, self.linked, self.links, self.content, self.label = text, linked, links, content, None
        #: Inside of what may be structure; of that, inside a content mark within it; and whether only its own class says so.
        self.doubt, self.inner, self.own = doubt, inner, own


class Scanner:
    """Tags of a page in order, in time linear in the page, however broken its markup is."""

    def __init__(self, html: str):
        self.html = html
        #: Opening quotes from which no end of a tag is reached; the next mark and the next > from some place on.
        self.dead: set[int] = set()
        self.mark, self.close = (-1, -1), (-1, -1)
        #: Kinds of elements of which no end follows.
        self.unclosed: set[str] = set()

    def next_close(self, at: int) -> int:
        """The first > from a place on, -1 if none; places may only grow."""
        seen, found = self.close
        if not (0 <= seen <= at and (found < 0 or found >= at)):
            self.close = at, self.html.find(">", at)
        return self.close[1]

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at a place: at the first > outside quotes, else at the first of all; -1 if none."""
        seen, found = self.mark
        if not (0 <= seen <= at and (found < 0 or found >= at)):
            m = _STOP.search(self.html, at)
            self.mark = at, m.start() if m else -1
        stop, html, met = self.mark[1], self.html, []
        while stop >= 0 and html[stop] != ">":
            if stop in self.dead:
                stop = -1
                break
            met.append(stop)
            quote = html.find(html[stop], stop + 1)
            m = _STOP.search(html, quote + 1) if quote >= 0 else None
            stop = m.start() if m else -1
        if stop < 0:
            self.dead.update(met)
            return self.next_close(at)
        return stop

    def past(self, tag: str, at: int) -> int:
        """Where an element ends whose content is left out. One that is never closed leaves out nothing but code."""
        if tag not in self.unclosed:
            depth, last = 1, -1
            for m in _WITHIN[tag].finditer(self.html, at):
                if m[1]:
                    depth, last = depth - 1, m.end()
                    if not depth or tag in _FLAT_TAGS:
                        break
                elif tag not in _FLAT_TAGS:
                    depth += 1
            if last >= 0:
                end = self.next_close(last)
                return end + 1 if end >= 0 else len(self.html)
            self.unclosed.add(tag)
        return len(self.html) if tag in ("script", "style") else at

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, "/" for an end tag, name in lower case, attributes); the name is empty for comments and at the page's end."""
        html, at, begin, n = self.html, 0, 0, len(self.html)
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                yield html[begin:at], "", "", ""
                at = begin = end + 3 if end >= 0 else n
                continue
            m = _NAME.match(html, at)
            if m is None and html[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            end = self.tag_end(m.end()) if m else self.next_close(at)
            if end < 0:
                break  # no tag ends from here on
            text, at, begin = html[begin:at], end + 1, end + 1
            if m is None:
                yield text, "", "", ""
                continue
            tag, raw = m[2].lower(), html[m.end() : end]
            yield text, m[1], tag, raw
            if tag in RAW_TAGS and not m[1] and not raw.endswith("/"):
                at = begin = self.past(tag, at)
        yield html[begin:], "", "", ""


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, those of page structure left out, those of what may be structure marked."""
    out: list[Block] = []
    # Of each open element its tag, whether it is in structure (2) or what may be (1), in content, in content within what may be, and whether it alone says so.
    stack: list[tuple[str, int, bool, bool, bool]] = []
    open_: Counter = Counter()  # of each tag in the stack
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "anchor": 0, "mute": 0}

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not (stack and stack[-1][1] == 2):
                _, doubt, content, inner, own = stack[-1] if stack else ("", 0, False, False, False)
                out.append(Block(text, state["linked"], state["links"], content, doubt == 1, inner, own))
        state["linked"] = state["links"] = state["mute"] = 0

    def add(raw: str) -> None:
        if raw and not state["mute"] and not (stack and stack[-1][1] == 2):
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["anchor"]:
                state["linked"] += len(text.strip())

    for text, close, tag, raw in Scanner(html):
        add(text)
        if not tag or tag in RAW_TAGS:
            continue
        if tag == "a":
            state["anchor"] = 0 if close else 1
            state["links"] += not close
        elif tag == "br":
            parts.append(" ")
        elif tag in MUTE_TAGS:
            state["mute"] = int(not close)
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if tag in VOID_TAGS:
                continue
            if close:
                if open_[tag]:
                    while pop() != tag:
                        pass
                continue
            while stack and (stack[-1][0] == "p" or stack[-1][0] in _IMPLIED.get(tag, ())):
                pop()
            if tag == "body":
                stack.clear()
                open_.clear()
            _, skipped, content, inner, _ = stack[-1] if stack else ("", 0, False, False, False)
            here = is_structure(tag, raw, content or inner) if skipped < 2 else 2
            mark = tag in ("article", "main")
            own = here == 1 and not skipped and tag in TEXT_TAGS
            within = max(skipped, here)
            stack.append((tag, within, content or (mark and not within), within < 2 and ((inner and not here) or (mark and within == 1)), own))
            open_[tag] += 1
    flush()
    return out


def first_pass(block: Block, marked: bool) -> bool | None:
    """Kept, left out, or None for undecided, by length, stop words and links."""
    size = len(block.text)
    density = block.linked / size
    if marked and not block.content:
        return False
    if density > LINKS and (block.links > 2 or not block.content):
        return False
    stops = _stops(block.text)
    if block.content:
        return True if (size >= SHORT and (stops >= SPARSE or size >= LONG)) and density <= LINKS else None
    if size < SHORT:
        return False if block.linked else None
    if stops >= DENSE:
        return True if size > LONG or density < 0.2 else None
    return None if stops >= SPARSE else False


def _stops(text: str) -> float:
    """The share of stop words among a text's words."""
    words = [w.strip(".,;:!?()[]\"'«»*#%&$") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _running(block: Block) -> bool:
    """Whether a block is long running text without links."""
    return len(block.text) >= LONG and not block.links and _stops(block.text) >= SPARSE


def candidates_of(blocks: list[Block]) -> list[Block]:
    """The blocks that the two passes see, by what the rest of the page says of those that may be structure."""
    for b in blocks:
        if b.doubt and b.own and _running(b):
            b.doubt = False  # a long paragraph whose class alone tells against it
    sure = [b for b in blocks if not b.doubt]
    if any(b.content for b in sure):
        return sure
    if any(b.inner for b in blocks):
        for b in blocks:
            b.content = b.content or b.inner
        return [b for b in blocks if b.inner or not b.doubt]
    told = lambda some: sum(len(b.text) for b in some if _running(b))
    return blocks if told(blocks) > 2 * told(sure) else sure


def main_text(html: str | None) -> str:
    """The main text of a page."""
    blocks = candidates_of(blocks_of(html or ""))
    marked = any(b.content for b in blocks)
    for b in blocks:
        b.label = first_pass(b, marked)
    decided = [b.label for b in blocks]
    before, seen = [], None
    for i, label in enumerate(decided):
        seen = (i, label) if label is not None else seen
        before.append(seen)
    seen = None
    for i in range(len(blocks) - 1, -1, -1):
        if decided[i] is not None:
            seen = (i, decided[i])
            continue
        near = sorted((abs(i - j), not label if blocks[i].content else label) for j, label in (x for x in (before[i], seen) if x) if blocks[j].content == blocks[i].content)
        if blocks[i].content:
            # Inside marked content the kept label wins a tie, and stands where nothing is decided.
            blocks[i].label = not near[0][1] if near else True
        else:
            blocks[i].label = near[0][1] if near else False
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
