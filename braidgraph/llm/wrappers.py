"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page becomes a stream of tokens: opening tags with their classes, closing tags, and text slots.
Runs that repeat inside a page fold into repeated groups. The streams of a host are then aligned one
after the other with the expression inferred so far: where both agree the token stays, a run that is
a group's body on the other side joins the group, and any other mismatch becomes an optional group.
There is no alternation. Every page is then matched against its host's finished wrapper, which gives each
of its texts a slot. What a slot holds alike on all pages that have it is template text and left out, on
the evidence of pages that differ otherwise; what varies stays. The wrapper's repeated groups tell items
from running text: repeated links beside the text are a menu, and repeated containers without headings that
stand after the container of the text, in a named one of their own, are reader comments and the like. What
menus, notices, adverts and forms hold by element or name goes too. Text outside of article and main
elements goes from a page where these, standing by themselves in the wrapper, hold half of the rest.

Equal streams are counted once in every task, so a host with a third of all pages sends a few
rows a task. Distinct streams of a host are merged as a tree: groups of about FAN_IN, then groups of what
those gave, until one is left, so no task holds more of a host than that.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import bounded
from .host_reputation import host_of
from .storage import map_arrow, scratch, written

#: Wrappers are broadcast up to this number of hosts and of characters, else joined by a salted shuffle.
BROADCAST_HOSTS = 50_000
BROADCAST_CHARS = 16_000_000
#: Wrappers that a task holds ready at once.
HELD_MATCHERS = 2_000
SALTS = 32
#: Streams of a host that one group of the merging tree is to hold.
FAN_IN = 64
#: Runs up to this length are folded by patterns, longer ones by comparing the stream with itself moved on.
SHORT_GROUP = 32
#: A slot's text is template text if so many pages, and this share of the host's, have it and differ in at least
#: half of their longest texts.
LEAST_PAGES, LEAST_SHARE = 3, 0.1
#: Pages that are kept as evidence for a slot, and texts that tell one page from another.
EVIDENCE, LONGEST_TEXTS = 8, 4

_RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")

CONTAINERS = frozenset("article aside blockquote body dd details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td th thead tfoot tr ul".split())
BLOCKS = CONTAINERS | frozenset("address center dt figcaption h1 h2 h3 h4 h5 h6 hr html head legend p pre summary caption option".split())
#: Elements that never hold main text; words that, as a whole name in class, id or role, say the same of other containers;
#: and words that such a name may have besides (ad-box, but not ad-free or has-sidebar).
OUTSIDE = frozenset("nav aside footer form menu dialog head button label input".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead notice notices cookie cookies consent gdpr comment comments reply replies disqus discussion related recommended share sharing social subscribe subscription newsletter signup login popup modal overlay form search searchbox pagination pager widget toolbar skip alert complementary contentinfo"
    " anzeige anzeigen werbung navigationsleiste seitenleiste fusszeile kopfzeile kommentar kommentare leserkommentare publicidad anuncio navegacion comentario comentarios opiniones publicite commentaire commentaires pubblicita navigazione commento commenti reactie reacties komentarze kommentarer yorumlar комментарии отзывы реклама 评论 コメント".split()
)
BESIDE_WORDS = frozenset("bar block bottom box container inner item items list site slot top unit wrap wrapper".split())
MAIN = ("article", "main")
#: Share of a page's text that its article and main elements must hold for the rest to go, and share of a host's text
#: that a container must hold for no word to drop it.
ENOUGH, NEARLY_ALL = 0.5, 0.8
#: A host's text outside of repeated containers tells where the text stands only from so many characters a page.
LEAST_TEXT = 80
#: Containers that can be items of a list that follows the text; rows of tables are not.
ITEMS = frozenset("li div section article dd blockquote".split())
#: Headings stay, alike or not: they belong to the text below them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is 'open', 'close' or 'text'; rest is the attributes, or the text."""
    at, last, m = 0, page.rfind(">") + 1, None
    for m in TOKEN.finditer(page, 0, last):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        slash, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if name:
            yield ("close" if slash else "open"), name.lower(), rest
    # An unfinished comment or raw element reaches to the end of the page.
    if m and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)):
        return
    tail = re.match(rf"(.*?)(?:<!--|<(?:{_RAW})(?=[\s/>]))", page[at:], re.S | re.I) if at < len(page) else None
    text = tail[1] if tail else page[at:]
    if text:
        yield "text", "", text


def label(name: str, attributes: str) -> str:
    """The name of an opening tag, with its classes, id and role: div.ad#top."""
    if "=" not in attributes:
        return name
    out = name
    for key, a, b, c in NAMED.findall(attributes):
        value = (a or b or c).lower()
        mark = {"class": ".", "id": "#", "role": "@"}[key.lower()]
        out += "".join(mark + re.sub(r"[0-9]+", "0", x) for x in value.split())
    return out


def is_outside(tag: str, kept: frozenset[str] = frozenset()) -> bool:
    """Whether what an element holds is never main text. Words say so of no body, article, main, or container in kept."""
    name, *names = re.split(r"[.#@]", tag)
    if name in OUTSIDE:
        return True
    if not names or name == "body" or _is_main(name, tag) or tag in kept:
        return False
    for words in map(WORD.findall, names):
        if any(w in OUTSIDE_WORDS for w in words) and all(w in OUTSIDE_WORDS or w in BESIDE_WORDS for w in words):
            return True
    return False


def _is_main(name: str, tag: str) -> bool:
    return name in MAIN or "@" in tag and "@main" in re.findall("[.#@][^.#@]*", tag)


class _Walk:
    """The open containers while walking a page."""

    def __init__(self, kept: frozenset[str] = frozenset()):
        self.kept = kept
        self.stack: list[tuple[str, str, bool, bool, int, int]] = []  # name, tag, outside by itself, marked as main, place, number
        self.outside = self.marked = self.opened = 0

    def open(self, name: str, tag: str, place: int = -1, alone: bool = True) -> None:
        """place: of the tag in the wrapper; alone: it is in no repeated group."""
        if name in CONTAINERS or name in OUTSIDE and name not in ("input",):
            out = is_outside(tag, self.kept)
            marked = _is_main(name, tag) and alone
            self.opened += 1
            self.stack.append((name, tag, out, marked, place, self.opened))
            self.outside += out
            self.marked += marked

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.outside -= sum(x[2] for x in self.stack[i:])
                self.marked -= sum(x[3] for x in self.stack[i:])
                del self.stack[i:]
                return


class Alphabet:
    """One letter for each token or group, so that streams are strings."""

    def __init__(self):
        self.letters: dict = {}
        self.names: list = []

    def letter(self, name) -> str:
        if name not in self.letters:
            # Past the surrogates and away from the characters that mean something in a pattern.
            n = 0x100 + len(self.names)
            self.letters[name] = chr(n if n < 0xD800 else n + 0x800)
            self.names.append(name)
        return self.letters[name]

    def name(self, letter: str):
        n = ord(letter)
        return self.names[(n if n < 0xD800 else n - 0x800) - 0x100]

    def group(self, mark: str, body: str) -> str:
        return self.letter((mark, body))

    def expanded(self, stream: str) -> list:
        """Nested lists: a token is a string, a group is [mark, tokens]."""
        return [x if isinstance(x := self.name(c), str) else [x[0], self.expanded(x[1])] for c in stream]

    def joined(self, items: list) -> str:
        return "".join(self.letter(x) if isinstance(x, str) else self.group(x[0], self.joined(x[1])) for x in items)


TWICE = [re.compile(rf"(.{{{n}}})\1+", re.S) for n in range(1, SHORT_GROUP + 1)]


def fold(stream: str, al: Alphabet) -> str:
    """Neighbouring equal runs become a repeated group, short runs first, until there are none."""
    n = 0
    while n < len(TWICE) and 2 * (n + 1) <= len(stream):
        folded = TWICE[n].sub(lambda m: _repeated(m[1], al), stream)
        n, stream = (0 if folded != stream else n + 1), folded
    found = _long_run(stream)
    if found:
        at, size, times = found
        return fold(stream[:at] + _repeated(stream[at : at + size], al) + stream[at + size * times :], al)
    return stream


def _long_run(stream: str) -> tuple[int, int, int] | None:
    """Where the first of the shortest runs longer than SHORT_GROUP that repeat begins, its length, how often it stands there."""
    n = SHORT_GROUP + 1
    if 2 * n > len(stream):
        return None
    seen: dict[str, int] = {}
    apart = set()  # how far apart equal windows lie; a run that repeats moves every window in it by its length
    for i in range(len(stream) - n + 1):
        before = seen.get(stream[i : i + n])
        if before is not None:
            apart.add(i - before)
        seen[stream[i : i + n]] = i
    if not apart:
        return None
    letters = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    # Equal windows next to each other may lie closer than the run is long, so every sum of distances is possible.
    for size in range(max(n, min(apart)), len(stream) // 2 + 1):
        differ = np.flatnonzero(letters[:-size] != letters[size:])
        edges = np.concatenate(([-1], differ, [len(letters) - size]))
        long = np.flatnonzero(np.diff(edges) - 1 >= size)
        if len(long):
            at = int(edges[long[0]]) + 1
            return at, size, 1 + int(edges[long[0] + 1] - at) // size
    return None


def _repeated(body: str, al: Alphabet) -> str:
    """The group of a body; a repeated group repeats as itself, an optional one becomes optional and repeated."""
    if len(body) == 1 and not isinstance(inner := al.name(body), str):
        return body if inner[0] == "+" else al.group("?", _repeated(inner[1], al))
    return al.group("+", body)


def _optional(body: str, al: Alphabet) -> str:
    """What may be missing: runs of tokens become optional groups, optional groups stay."""
    out, run = [], ""
    for c in body:
        if isinstance(x := al.name(c), str) or x[0] == "+":
            run += c
        else:
            out += [run, c]
            run = ""
    out.append(run)
    return "".join(x if len(x) == 1 and not isinstance(al.name(x), str) and al.name(x)[0] == "?" else al.group("?", x) for x in out if x)


def _matcher(letter: str, al: Alphabet) -> str:
    """A regular expression for a token, or for a group or anything it stands for."""
    name, own = al.name(letter), re.escape(letter)
    if isinstance(name, str):
        return own
    inner = "".join(_matcher(c, al) for c in name[1])
    return f"(?:{own}|{inner}){'++' if name[0] == '+' else '?+'}"


def _into_groups(stream: str, other: str, al: Alphabet) -> str:
    """Runs of a stream that a group of the other stands for join such a group, large groups first."""
    groups = sorted({c for c in other if not isinstance(al.name(c), str)} - set(stream), key=lambda c: (-len(_matcher(c, al)), c))
    for c in groups:
        body = al.name(c)[1]
        if len(body) > 1 or isinstance(al.name(body), str) is False:
            inner = "".join(_matcher(x, al) for x in body)
            mark = "++" if al.name(c)[0] == "+" else ""
            stream = re.sub(f"(?:{inner}){mark}", lambda m, c=c: c if m[0] else "", stream)
    return stream


def merge(wrapper: str, stream: str, al: Alphabet) -> str:
    """The expression that matches what either matches."""
    if wrapper == stream:
        return wrapper
    a, b = fold(_into_groups(wrapper, stream, al), al), fold(_into_groups(stream, wrapper, al), al)
    if a == b:
        return a
    out = []
    for what, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        out.append(a[i:j] if what == "equal" else _optional(a[i:j], al) + _optional(b[k:m], al))
    return fold("".join(out), al)


def pattern(items: list) -> str:
    """A wrapper as text: tokens, ( )+ and ( )? groups, #text slots."""
    return " ".join(x if isinstance(x, str) else f"({pattern(x[1])}){x[0]}" for x in items)


def _has_heading(items: list) -> bool:
    return any(x[1:3] in HEADINGS and x[3:4] in ">.#@" if isinstance(x, str) else _has_heading(x[1]) for x in items)


class Matcher:
    """A wrapper as an automaton that gives every token of a page its place in the wrapper.

    States are numbered in the order of the wrapper; a state after a token stands for the token. Sets of
    states are worked out when a page first needs them.
    """

    def __init__(self, items: list):
        self.after: list[tuple[str, int] | None] = [None]  # the token that leaves a state, and the state after it
        self.free: list[list[int]] = [[]]  # states reached without a token
        self.many: set[int] = set()  # states after tokens of repeated groups
        self.items: set[int] = set()  # states after the tags that open the outermost containers of repeated groups without headings
        self.last = self._built(items, 0)
        self.reached: dict[int, tuple[int, ...]] = {}
        self.sets: dict[tuple[int, ...], int] = {(0,): 0}
        self.members: list[tuple[int, ...]] = [(0,)]
        self.steps: dict[tuple[int, str], int] = {}
        self.backs: dict[tuple[int, int], int] = {}

    def _state(self) -> int:
        self.after.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _built(self, items: list, at: int, many: bool = False, item: bool = False, depth: list[int] | None = None) -> int:
        depth = [0] if depth is None else depth
        for x in items:
            start, at = at, self._state()
            if isinstance(x, str):
                self.free[start].append(at)
                end = self._state()
                self.after[at] = (x, end)
                at = end
                if many:
                    self.many.add(at)
                if item and x[0] == "<":
                    name = re.split(r"[.#@>]", x.removeprefix("</").removeprefix("<"), maxsplit=1)[0]
                    if name in CONTAINERS:
                        if x[1] != "/" and not depth[0]:
                            self.items.add(at)
                        depth[0] = depth[0] + 1 if x[1] != "/" else max(0, depth[0] - 1)
                continue
            self.free[start].append(at)
            repeated = x[0] == "+"
            plain = repeated and not _has_heading(x[1])
            body, at = at, self._built(x[1], at, many or repeated, plain or item and not repeated, None if repeated else depth)
            end = self._state()
            self.free[at].append(end)
            if x[0] == "?":
                self.free[body].append(end)
            else:
                self.free[at].append(body)
            at = end
        return at

    def _open(self, state: int) -> tuple[int, ...]:
        """The states with a token, or the last one, that a state reaches without a token."""
        if state not in self.reached:
            seen, todo = {state}, [state]
            while todo:
                for t in self.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.reached[state] = tuple(sorted(t for t in seen if self.after[t] or t == self.last))
        return self.reached[state]

    def _step(self, here: int, token: str) -> int:
        found = {self.after[t][1] for s in self.members[here] for t in self._open(s) if self.after[t] and self.after[t][0] == token}
        states = tuple(sorted(found))
        if states not in self.sets:
            self.sets[states] = len(self.members)
            self.members.append(states)
        self.steps[here, token] = n = self.sets[states]
        return n

    def _back(self, before: int, state: int) -> int:
        found = next(s for s in self.members[before] if any(self.after[t] and self.after[t][1] == state for t in self._open(s)))
        self.backs[before, state] = found
        return found

    def places(self, stream: list[str]) -> list[int] | None:
        """The place of every token; None if the wrapper doesn't match the page."""
        here, path, steps, backs = 0, [0], self.steps, self.backs
        for token in stream:
            n = steps.get((here, token))
            here = self._step(here, token) if n is None else n
            if not self.members[here]:
                return None
            path.append(here)
        state = next((s for s in self.members[here] if self.last in self._open(s)), None)
        if state is None:
            return None
        out = []
        for before in reversed(path[:-1]):
            out.append(state)
            s = backs.get((before, state))
            state = self._back(before, state) if s is None else s
        out.reverse()
        return out


def stream_of(page: str, al: Alphabet) -> tuple[str, Counter]:
    """The folded stream of a page, and what share of its text, in parts of 10 000, the largest container of each tag
    holds; at '' the whole. Text in menus and the like counts only where a word, not the element, says so; if article or
    main elements have text, only containers around or inside of them count."""
    out, closed, stack, hard, main, total = [], [], [], 0, 0, 0
    for kind, name, rest in tokens(page):
        if kind == "text":
            if not rest.strip():
                continue
            out.append("#text")
            if not hard:
                total += len(rest)
                for x in stack:
                    x[2] += len(rest)
                    x[3] |= main > 0
        elif kind == "open":
            tag = label(name, rest)
            out.append(f"<{tag}>")
            if name in CONTAINERS or name in OUTSIDE and name != "input":
                stack.append([name, tag, 0, False])
                hard += name in OUTSIDE
                main += _is_main(name, tag)
        else:
            out.append(f"</{name}>")
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is not None:
                hard -= sum(x[0] in OUTSIDE for x in stack[i:])
                main -= sum(_is_main(x[0], x[1]) for x in stack[i:])
                closed += stack[i:]
                del stack[i:]
    closed = [x for x in closed + stack if x[2]]
    marked, mass = any(x[3] for x in closed), Counter()
    for _, tag, size, near in closed:
        if near or not marked:
            mass[tag] = max(mass[tag], 10_000 * size // total)
    if total:
        mass[""] = 10_000
    return fold("".join(map(al.letter, out)), al), mass


def region(mass: dict[str, int]) -> str:
    """The containers, by tag and with spaces between, that hold nearly all of the text of a host's pages; every page
    counts alike. No word in their names says that they are outside."""
    return " ".join(sorted(t for t, m in mass.items() if t and m > NEARLY_ALL * mass[""] and re.split(r"[.#@]", t)[0] not in OUTSIDE))


def extract(page: str, main: str, matcher: Matcher | None = None, template: dict[int, set[str]] | None = None) -> str:
    """The text of a page without template text, menus, and items after the text; of its article and main elements
    alone if they hold half of it.

    main: the tags of containers that are never outside by a word, with spaces between.
    """
    blocks = _blocks(page, main, matcher)
    found = [b for b in blocks if not template or b.heading or not b.is_template(template)]
    marked = [b for b in found if b.marked]
    if marked and sum(len(b.text) for b in marked) >= ENOUGH * sum(len(b.text) for b in found if not b.linked):
        found = marked
    else:
        found = _without_headers(_without_items(found), template)
    return "\n".join(b.text for b in found)


def _without_items(found: list[_Block]) -> list[_Block]:
    """Without repeated links beside the text, and without items in a container of their own after the text's."""
    text = [i for i, b in enumerate(found) if not (b.heading or b.linked or b.item or b.header)]
    size = sum(len(found[i].text) for i in text)
    if size < LEAST_TEXT:
        return found
    holds = Counter()
    for i in text:
        for n in found[i].chain:
            holds[n] += len(found[i].text)
    # Containers are numbered as they open: of those that hold most of the text, the last is the innermost.
    own = max((n for n, m in holds.items() if 2 * m > size), default=0)
    out = []
    for i, b in enumerate(found):
        beside = i < text[0] or i > text[-1] or not b.chain or not holds[b.chain[-1]]
        after = i > text[-1] and own > 1 and own not in b.chain and b.item and b.item[1] and not holds[b.item[0]]
        if not (b.linked and beside or after):
            out.append(b)
    return out


def _without_headers(found: list[_Block], template: dict[int, set[str]] | None) -> list[_Block]:
    """Without what header elements outside of article and main hold; a heading there stays if the page has no other
    and it is no template text."""
    titled = any(b.heading and not b.header for b in found)
    rest = [b for b in found if not b.header or b.heading and not titled and not (template and b.is_template(template))]
    return rest if any(not b.header for b in rest) else found


class _Block:
    """A block's text and where it stands: whether it is a heading, inside an article or main, inside a page header;
    whether it is nothing but repeated links; the numbers of the containers around it; the container around the item it
    belongs to (its number, and whether it has a name), None outside of items; its texts with their slots (-1: none)."""

    def __init__(self, text: str, heading: bool, walk: _Walk, slots: list[tuple[int, str]], linked: bool, items: set[int]):
        self.text, self.heading, self.marked, self.linked, self.slots = text, heading, walk.marked > 0, linked, slots
        self.chain = [x[5] for x in walk.stack]
        self.header = not self.marked and any(x[0] == "header" for x in walk.stack)
        at = next((i for i in range(len(walk.stack) - 1, 0, -1) if walk.stack[i][4] in items and walk.stack[i][0] in ITEMS), 0)
        around = walk.stack[at - 1] if at else None
        self.item = (around[5], any(c in around[1] for c in ".#@")) if around else None

    def is_template(self, template: dict[int, set[str]]) -> bool:
        """Constant words inside a block that varies stay with it."""
        return all(slot in template and digest(text) in template[slot] for slot, text in self.slots)


def digest(text: str) -> str:
    return hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _flat(page: str) -> list[tuple[str, str, str, str]]:
    """The tokens of a page, each with how the stream names it; '' for blank text, which is not in the stream."""
    out = []
    for kind, name, rest in tokens(page):
        if kind == "text":
            out.append((kind, name, rest, "#text" if rest.strip() else ""))
        else:
            out.append((kind, name, rest, f"<{label(name, rest)}>" if kind == "open" else f"</{name}>"))
    return out


def _blocks(page: str, main: str, matcher: Matcher | None = None) -> list[_Block]:
    walk, out, part, slots = _Walk(frozenset(main.split())), [], [], []
    heading, link, unlinked = False, False, False
    flat = _flat(page)
    places = matcher and matcher.places([x[3] for x in flat if x[3]])
    place = iter(places) if places else None
    many, items = (matcher.many, matcher.items) if places else (set(), set())

    def flush() -> None:
        nonlocal unlinked
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            if text:
                out.append(_Block(text, heading, walk, slots.copy(), not unlinked and any(s in many for s, _ in slots), items))
            part.clear()
            slots.clear()
        unlinked = False

    for kind, name, rest, token in flat:
        slot = next(place) if place and token else -1
        if kind == "text":
            if not walk.outside:
                part.append(rest)
                if token:
                    slots.append((slot, rest))
                    unlinked |= not link
            continue
        if name in BLOCKS:
            flush()
            heading = kind == "open" and name in HEADINGS
        elif name == "br":
            part.append(" ")
        elif name == "a":
            link = kind == "open"
        if kind == "open":
            walk.open(name, token[1:-1], slot, slot not in many)
        else:
            walk.close(name)
    flush()
    return out


class Slots:
    """What the slots of a wrapper hold alike on all pages seen, and pages as evidence; mergeable in any order."""

    def __init__(self):
        self.same: dict[int, set[str]] = {}  # texts on every page that has the slot; empty for a slot that varies
        self.pages: dict[int, set[str]] = {}  # the least of the pages' keys, for slots that don't vary
        self.counts: Counter = Counter()  # the pages that have a slot that doesn't vary; at -1 all pages

    def see(self, blocks: list[_Block]) -> None:
        texts = [(slot, text) for b in blocks if not b.heading for slot, text in b.slots]
        longest = sorted({" ".join(text.split()) for _, text in texts}, key=lambda t: (-len(t), t))[:LONGEST_TEXTS]
        key = json.dumps([[digest(t), len(t)] for t in longest])
        held: dict[int, list[str]] = {}
        for slot, text in texts:
            if slot >= 0 and self.same.get(slot, True):
                held.setdefault(slot, []).append(text)
        for slot, found in held.items():
            self._add(slot, set(map(digest, found)), {key}, 1)
        self.counts[-1] += 1

    def _add(self, slot: int, texts: set[str], pages: set[str], n: int) -> None:
        both = self.same[slot] & texts if slot in self.same else texts
        self.same[slot] = both
        if both:
            self.pages[slot] = set(sorted(self.pages.get(slot, set()) | pages, key=_dealt)[:EVIDENCE])
            self.counts[slot] += n
        else:
            self.pages.pop(slot, None)

    def merge(self, text: str) -> None:
        total, slots = json.loads(text)
        self.counts[-1] += total
        for slot, texts, pages, n in slots:
            self._add(slot, set(texts), set(pages), n)

    def dumps(self) -> str:
        return json.dumps([self.counts[-1], [[slot, sorted(texts), sorted(self.pages.get(slot, ())), self.counts[slot]] for slot, texts in sorted(self.same.items())]])

    def template(self) -> dict[int, set[str]]:
        """The texts to leave out, by slot. Copies of one page, or nearly, are no evidence."""
        able = {slot: texts for slot, texts in self.same.items() if texts and len(self.pages[slot]) >= LEAST_PAGES and self.counts[slot] >= LEAST_SHARE * self.counts[-1]}
        constant = set().union(*able.values())
        out = {}
        for slot, texts in able.items():
            others = set()
            for page in self.pages[slot]:
                longest = json.loads(page)
                own = [(d, n) for d, n in longest if d not in constant]
                if own and 2 * sum(n for _, n in own) >= sum(n for _, n in longest):
                    others.add(tuple(own))
            if len(others) >= LEAST_PAGES:
                out[slot] = texts
        return out


def _dealt(key: str) -> str:
    return hashlib.blake2b(key.encode(), digest_size=8).hexdigest()


class _Matchers:
    """The matchers of the hosts that a task last met."""

    def __init__(self):
        self.held: dict = {}

    def get(self, host: str, expression: str | None, template: str | None = None) -> tuple[Matcher | None, dict]:
        if host not in self.held:
            if len(self.held) >= HELD_MATCHERS:
                self.held.clear()
            known = {int(k): set(v) for k, v in json.loads(template).items()} if template else {}
            self.held[host] = (Matcher(json.loads(expression)) if expression else None, known)
        return self.held[host]


WRAPPER = T.StructType([T.StructField("host", T.StringType()), T.StructField("part", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("mass", T.StringType()), T.StructField("n_pages", T.LongType())])


def _merged(group: pa.Table) -> pa.Table:
    """One row of the rows of a host and part; streams that more pages have come first, equal ones are one."""
    al, wrapper, mass, n, held = Alphabet(), None, Counter(), 0, Counter()
    for count, stream, sizes in zip(group["n_pages"].to_pylist(), group["stream"].to_pylist(), group["mass"].to_pylist(), strict=True):
        held[stream] += count
        mass.update(json.loads(sizes))
        n += count
    for stream, _ in sorted(held.items(), key=lambda x: (-x[1], x[0])):
        letters = al.joined(json.loads(stream))
        wrapper = letters if wrapper is None else merge(wrapper, letters, al)
    row = [group["host"][0].as_py(), group["part"][0].as_py(), json.dumps(al.expanded(wrapper)), json.dumps(mass), n]
    return pa.table([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=WRAPPER.names)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """host, wrapper (the expression as text), expression (as JSON), main (the containers that hold most text) and n_pages, one row a host, from all its pages."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, found = Alphabet(), {}

        def sent() -> pa.RecordBatch:
            rows = [(host, json.dumps(al.expanded(s)), json.dumps(mass), n) for (host, s), (mass, n) in found.items()]
            hosts, texts, masses, counts = zip(*rows, strict=True)
            parts = [hash_part(t) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(parts, pa.int64()), pa.array(texts), pa.array(masses), pa.array(counts, pa.int64())], WRAPPER.names)

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stream, mass = stream_of(page.as_py() or "", al)
                held, n = found.setdefault((host, stream), (Counter(), 0))
                held.update(mass)
                found[host, stream] = held, n + 1
            if len(found) > 20_000 or len(al.names) > 200_000:
                yield sent()
                al, found = Alphabet(), {}
        if found:
            yield sent()

    rows = written(map_arrow(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)), streams, WRAPPER), "wrapper-streams")
    # part is a hash of the stream: equal streams meet, and a level's groups hold about fan_in distinct ones each.
    while True:
        groups = F.ceil(F.count_distinct("part") / F.lit(fan_in)).alias("groups")
        sizes = written(rows.groupBy("host").agg(groups), "wrapper-sizes")
        dealt = rows.join(bounded(sizes, BROADCAST_HOSTS), "host").select("host", F.pmod("part", "groups").alias("part"), *WRAPPER.names[2:])
        rows = written(dealt.groupBy("host", "part").applyInArrow(_merged, WRAPPER), "wrapper-parts")
        if sizes.where("groups > 1").isEmpty():
            break

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                wrappers = [pattern(json.loads(x)) for x in b.column(2).to_pylist()]
                mains = [region(json.loads(x)) for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wrappers), b.column(2), pa.array(mains), b.column(4)], ["host", "wrapper", "expression", "main", "n_pages"])

    return map_arrow(rows, named, "host string, wrapper string, expression string, main string, n_pages long")


def hash_part(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=7).digest(), "big")


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Id, URL and page with w_own (the host) and the columns of its wrapper, which are named w_..., one being w_host."""
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(F.col(url_col)).alias("w_own"))
    others = [F.length(c) for c in wrappers.columns if c != "w_host"]
    hosts, chars = wrappers.agg(F.count("*"), F.coalesce(F.sum(sum(others, F.lit(0))), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and chars <= BROADCAST_CHARS:
        return rows.join(F.broadcast(wrappers), F.col("w_own") == F.col("w_host"), "left")
    salted = wrappers.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).cast("int")
    return rows.withColumn("w_own_salt", own).join(salted, (F.col("w_own") == F.col("w_host")) & (F.col("w_own_salt") == F.col("w_salt")), "left")


def templates(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """w_host and w_template, the texts to leave out by slot as JSON, one row a host: from all its pages, matched against its wrapper."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, found = _Matchers(), {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array([x.dumps() for x in found.values()])], ["w_host", "w_template"])

        for b in batches:
            for host, page, expression, main in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                matcher, _ = matchers.get(host, expression)
                found.setdefault(host, Slots()).see(_blocks(page.as_py() or "", main or "", matcher))
            if len(found) > 5_000:
                yield sent()
                found = {}
        if found:
            yield sent()

    def merged(group: pa.Table) -> pa.Table:
        slots = Slots()
        for text in group["w_template"].to_pylist():
            slots.merge(text)
        chosen = json.dumps({slot: sorted(texts) for slot, texts in sorted(slots.template().items())})
        return pa.table([pa.array([group["w_host"][0].as_py()], pa.string()), pa.array([chosen], pa.string())], names=["w_host", "w_template"])

    rows = _with_wrappers(pages, wrappers.select("w_host", "w_main", "w_expression"), id_col, url_col, html_col)
    schema = "w_host string, w_template string"
    return map_arrow(rows.select("w_own", html_col, "w_expression", "w_main"), seen, schema).groupBy("w_host").applyInArrow(merged, schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, its url, text (blocks joined by line feeds, empty if none), n_chars.

    A null or empty page has an empty text. Pages without a host (null URL, no ://) form a host of their own.
    Rows with equal ids are extracted one by one; other columns are not read; an empty table gives no rows.
    """
    with scratch(pages.sparkSession) as keep:
        wrappers = written(infer(pages, url_col, html_col), "wrappers").select(F.col("host").alias("w_host"), F.col("main").alias("w_main"), F.col("expression").alias("w_expression"))
        known = templates(pages, wrappers, id_col, url_col, html_col)
        rules = keep(written(wrappers.join(known, "w_host", "left"), "wrapper-rules"))
    rows = _with_wrappers(pages, rules, id_col, url_col, html_col)
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _Matchers()
        for b in batches:
            hosts, mains, expressions, known = (b.column(i).to_pylist() for i in range(3, 7))
            texts = [extract(page.as_py() or "", main or "", *matchers.get(host, e, t)) for page, host, main, e, t in zip(b.column(2), hosts, mains, expressions, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return map_arrow(rows.select(id_col, url_col, html_col, "w_own", "w_main", "w_expression", "w_template"), run, schema)
