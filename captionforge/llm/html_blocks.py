"""From raw HTML to the sequence of leaf blocks, each with its text and what is known of its place."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

#: Buckets of tag-path tokens and of words, and the plain numbers of a block.
PATHS, WORDS, PLAIN = 256, 512, 10
FEATURES = PATHS + WORDS + PLAIN
#: Words whose bucket a worker keeps at most.
STORE = 200_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
OTHER = re.compile(r"\D+")
NAMES = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text of the page; of the first, it isn't even markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("head noscript template svg math select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag ends an open element of these, if none of the fences is in between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
NOT_HEAD = frozenset("head meta title link script style base noscript template".split())

_BUCKETS: dict[str, int] = {}


def bucket(word: str) -> int:
    if (b := _BUCKETS.get(word)) is None:
        if len(_BUCKETS) > STORE:
            _BUCKETS.clear()
        b = _BUCKETS[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
    return b


class Element:
    """An open element; known: the path buckets of it and of all around it."""

    __slots__ = ("known", "linked", "name", "silent")

    def __init__(self, name: str, tokens: tuple[str, ...], above: Element | None):
        own = {zlib.crc32(t.encode("utf-8", "replace")) % PATHS for t in tokens}
        self.name = name
        self.known = own if above is None else above.known if own <= above.known else above.known | own
        self.silent = name in SILENT or (above is not None and above.silent)
        self.linked = name in ("a", "button", "label") or (above is not None and above.linked)


class Block:
    __slots__ = ("known", "linked", "parts", "tag")

    def __init__(self, element: Element):
        self.known, self.tag, self.parts, self.linked = element.known, element.name, [], 0


def tokens(name: str, rest: str) -> tuple[str, ...]:
    """What a start tag adds to the path: its name, and the words of the attributes that tell of its use."""
    out = [name]
    if "=" in rest or "hidden" in rest:
        for a, *values in ATTRIBUTE.findall(rest):
            value = next((v for v in values if v), "").lower()
            a = a.lower()
            if a == "style":
                if "none" in value:
                    out.append("hidden")
            elif a in ("hidden", "aria-hidden"):
                if value != "false":
                    out.append("hidden")
            else:
                out += ["." + w for w in NAMES.findall(value)]
    return tuple(out)


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of every leaf sequence of the page that has text, in page order.

    A leaf sequence is text that no block-level tag interrupts. Character references are decoded and white space is made one
    space each. Comments, scripts, styles and the head have no text. Tags that don't end, ends without a start and missing
    ends are taken as browsers mostly do.
    """
    out: list[tuple[str, Block]] = []
    stack: list[Element] = []
    root = Element("#", (), None)
    now: Block | None = None
    #: where the head is on the stack, while it is open
    head: int | None = None
    at, end = 0, len(page)

    def close() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(html.unescape("".join(now.parts)).split())
            now.parts = []
            if text:
                out.append((text, now))
            now = None

    def add(text: str) -> None:
        nonlocal now
        top = stack[-1] if stack else root
        if top.silent or not text:
            return
        if now is None:
            if not text.strip():
                return
            # inline elements are not the block's own place, but what they are called may tell of it
            now = Block(next((e for e in reversed(stack) if e.name not in INLINE), root))
            now.known = top.known
        now.parts.append(text)
        if top.linked:
            now.linked += len(text)

    def pop_to(k: int) -> None:
        nonlocal head
        del stack[k:]
        if head is not None and head >= k:
            head = None

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        block = name not in INLINE and name != "br"
        if block:
            close()
        elif name == "br":
            add(" ")
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    pop_to(k)
                    break
                if not block and stack[k].name not in INLINE:
                    break
            continue
        rest = m["rest"]
        if head is not None and name not in NOT_HEAD:
            pop_to(head)
        if block:
            if name in ENDS:
                which, fences = ENDS[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in fences:
                        break
                    if stack[k].name in which:
                        pop_to(k)
                        break
            else:
                # any other block ends an open paragraph, and with it what is open inside
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == "p":
                        pop_to(k)
                        break
                    if stack[k].name not in INLINE:
                        break
        if name in VOID or rest.endswith("/>"):
            continue
        stack.append(Element(name, tokens(name, rest), stack[-1] if stack else root))
        if name == "head" and head is None:
            head = len(stack) - 1
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else end
    close()
    return out


def features(found: list[tuple[str, Block]], first: int = 0, of: int | None = None) -> np.ndarray:
    """A row for each block: path buckets that it has, its word buckets as a vector of length one, plain numbers.

    Of a slice of a page, first is the number of its first block, and of that of all the page's blocks.
    """
    out = np.zeros((len(found), FEATURES), np.float32)
    n = len(found) if of is None else of
    for i, (text, block) in enumerate(found):
        row = out[i]
        row[list(block.known)] = 1
        w = text.lower().split()
        counts = np.bincount([bucket(x.strip(".,;:!?()\"'")) for x in w], minlength=WORDS)
        row[PATHS : PATHS + WORDS] = counts / max(float(counts @ counts), 1.0) ** 0.5
        stops = sum(map(text.count, ".!?。"))
        row[PATHS + WORDS :] = (
            min(len(w), 60) / 60,
            min(len(w), 8) / 8,
            min(1.0, block.linked / max(len(text), 1)),
            min(1.0, 8 * stops / max(len(w), 1)),
            text[-1:] in ".!?…。:",
            len(OTHER.sub("", text)) / max(len(text), 1),
            block.tag[:1] == "h" and block.tag[1:].isdigit(),
            block.tag == "li",
            block.tag == "p",
            (first + i + 0.5) / n,
        )
    return out
