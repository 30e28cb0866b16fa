"""Main text of web pages by two-pass block rules.

A page is read once, from one tag to the next, into blocks, the runs of text between block-level tags. The
first pass looks at each block alone: its place in the page, its link density, its length and its share of
stop-words make it good, bad or undecided; a page in a language without a list of stop-words is judged by
length, link density and the ends of sentences. The second pass gives every undecided block, which mostly
are short, the label of the nearest decided block of the same part of the page; where a part has none,
blocks inside an article are good and others are bad.

Words of class and id are hints: they, headers and forms do not condemn what holds the article, nor the
element that holds most of the running text where all of it would go. Reading takes time in proportion to
the page's length, however broken its markup: what no longer occurs is looked for once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A block of this many characters decides for itself.
LONG = 70
#: Of a long block's words, at least this share are stop-words in running text.
STOP_SHARE = 0.12
#: Of a block's characters, at most this share are inside links.
LINK_SHARE = 0.33

# Frequent function words of ten languages.
STOP_WORDS = {
    "en": "the of and to a in is it you that he was for on are with as his they be at one have this from or had by not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look more go see no way could my than been who its now did get may",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihr ich wir",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont aux avec son cette ou mais comme elle on nous leur être ont ses fait si tout même aussi sans deux ces autre entre sous où était cela peut y vous je",
    "it": "di e il la che in un per con non una del si da sono al lo come ma le dei della anche più nel alla gli i questo ha è dal se delle o ai su",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je",
    "pl": "i w nie na się z do to że jest o jak po co za tak od jego jej ale dla przez był są tym już tylko czy może które który przy oraz być ich",
    "ru": "и в не на я что он с а это как по но из у за к все от так же для вы бы мы до о его она было только или если уже их при был",
    "sv": "och i att det som en på är av för med den till inte har de ett om var jag men sig från vi så kan när han eller hade vid nu efter",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto",
}
#: The languages in which a word is a stop-word, as places in STOP_WORDS.
STOPS: dict[str, tuple[int, ...]] = {}
for _k, _words in enumerate(STOP_WORDS.values()):
    for _w in dict.fromkeys(_words.split()):
        STOPS[_w] = (*STOPS.get(_w, ()), _k)

# Elements by what they do to blocks.
DROPPED = frozenset("script style noscript template svg math iframe object canvas video audio head title select option button textarea map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
BOILER = frozenset("nav footer aside menu dialog".split())
#: Elements that are left out like a bad name: not if they hold the article.
MILD = frozenset("form fieldset header".split())
#: An article or main element that stands in one of these closes it: it was not closed before.
LEFT_OPEN = frozenset("nav menu header dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id attributes.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices banner alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus pagination pager copyright legal disclaimer toolbar masthead topbar".split()
)
HEADER_NAMES = frozenset("header head top".split())
TALK_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
GOOD_NAMES = frozenset("article post entry story content main".split())
#: Elements whose class and id tell of the page's layout, not of what stands inside.
UNNAMED = frozenset("html body main article".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
END_TAGS = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

ENDS_OR_QUOTE = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[^\s\"'>/=]+")
WANTED = frozenset("class id role style hidden aria-hidden href".split())
NEXT_A = re.compile(r"<(/?)a(?=[\s/>])", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that say as much as three letters; ends of sentences.
WIDE = re.compile("[\u2e80-\uffdc]")
SENTENCE = re.compile("[.!?…。！？।؟۔]")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    boiler: bool
    article: bool
    part: int  # the part of the page it belongs to
    named: int = 0  # the innermost open element that only a hint makes bad, 0 if there is none
    inside: int = 0  # the innermost open element that may be the page's article
    label: bool | None = None
    share: float = -1.0  # of stop-words, when it is known

    @property
    def stops(self) -> float:
        if self.share < 0:
            self.share = stop_share(self.text)
        return self.share


class Source:
    """A page read from front to back: every search starts no earlier than the one before."""

    def __init__(self, page: str):
        self.page, self.gone, self.broken = page, set(), 0

    def find(self, what: str, at: int) -> int:
        """Like str.find, but what was not found once is not looked for again."""
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def end_of_tag(self, at: int) -> int:
        """Where the tag that is open at a place ends: at the next > outside quotes. Where quotes leave
        none, at the next >; after two such tags quotes are not heeded any more. -1 if there is none."""
        plain = self.find(">", at)
        if plain < 0 or self.broken > 1:
            return plain
        k = at
        while True:
            m = ENDS_OR_QUOTE.search(self.page, k)
            if not m:
                self.broken += 1
                return plain
            k = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while before > at and self.page[before].isspace():
                before -= 1
            if self.page[before] == "=":
                close = self.find(m[0], k)
                k = close + 1 if close >= 0 else k

    def end_of_element(self, name: str, at: int) -> int:
        """Behind the end tag of an element without markup inside, -1 if there is none."""
        what = "</" + name
        while True:
            if what in self.gone:
                return -1
            m = END_TAGS[name].search(self.page, at)
            if not m:
                self.gone.add(what)
                return -1
            return m.end()


def attributes(text: str) -> dict[str, str]:
    """The wanted attributes of a tag; of one that is repeated the first."""
    out: dict[str, str] = {}
    source, at = Source(text), 0
    while True:
        m = ATTRIBUTE.search(text, at)
        if not m:
            return out
        at, name, value = m.end(), m[0].lower(), ""
        k = at
        while k < len(text) and text[k].isspace():
            k += 1
        if text[k : k + 1] == "=":
            k += 1
            while k < len(text) and text[k].isspace():
                k += 1
            quote = text[k : k + 1]
            close = source.find(quote, k + 1) if quote in ("'", '"') else -1
            if close >= 0:
                value, at = text[k + 1 : close], close + 1
            else:
                stop = k
                while stop < len(text) and not text[stop].isspace():
                    stop += 1
                value, at = text[k:stop].strip("\"'"), max(stop, at)
        else:
            at = k
        if name in WANTED:
            out.setdefault(name, value.lower())


def _place(name: str, found: dict[str, str], in_article: bool) -> str:
    """'bad', 'named' (bad unless it holds the article), 'talk' (named for readers' comments), 'good' or ''."""
    if name in BOILER or "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
        return "bad"
    if found.get("role") in ROLES:
        return "bad"
    place = "good" if name in ("article", "main") else ""
    if name in MILD and not (name == "header" and in_article):
        return "named"
    if name not in UNNAMED and ("class" in found or "id" in found):
        words = {w for key in ("class", "id") for w in re.split(r"[^a-z]+", found.get(key, ""))}
        if words & TALK_NAMES:
            return "talk"
        if words & BAD_NAMES or not in_article and words & HEADER_NAMES and not words & GOOD_NAMES:
            return "named"
        if words & GOOD_NAMES and name in ("div", "section", "td"):
            return "good"
    return place


@dataclass
class Hints:
    """Elements by their numbers, in the order in which they open."""

    named: dict[int, int] = field(default_factory=dict)  # bad by a hint: the next such element around
    talks: set[int] = field(default_factory=set)  # of these, for readers' comments
    holders: dict[int, tuple[str, int, int]] = field(default_factory=dict)  # may be the article: name, named, holder around


def _pardon(found: list[Block], hints: Hints) -> None:
    """Hints do not condemn what contains the article: the longest main and the longest article element, or,
    in a page with neither, the longest element of a good name if it has more text than stands outside bad
    names. Where they would condemn all running text, they do not condemn the elements, from the outermost
    inwards, that have more than half of it, readers' comments excepted."""
    size = dict.fromkeys(hints.holders, 0)
    for b in found:
        if b.inside:
            size[b.inside] += len(b.text) - b.linked
    for k in reversed(hints.holders):
        if hints.holders[k][2]:
            size[hints.holders[k][2]] += size[k]
    free = {0}

    def pardon(k: int) -> None:
        while k:
            free.add(k)
            k = hints.named[k]

    kinds = {}
    for k, (name, _, _) in hints.holders.items():
        kind = name if name in ("main", "article") else ""
        if size[k] and size[k] > size.get(kinds.get(kind), 0):
            kinds[kind] = k
    for kind in ("main", "article"):
        if kind in kinds:
            pardon(hints.holders[kinds[kind]][1])
    if set(kinds) == {""} and size[kinds[""]] > sum(len(b.text) - b.linked for b in found if not b.boiler and not b.named):
        pardon(hints.holders[kinds[""]][1])

    def condemned() -> dict[int, bool]:
        out = {0: False}
        for k, around in hints.named.items():
            out[k] = k not in free or out[around]
        return out

    out = condemned()
    running = [b for b in found if not b.boiler and b.linked <= LINK_SHARE * len(b.text) and weight(b.text) >= LONG and SENTENCE.search(b.text)]
    if running and all(out[b.named] for b in running):
        own = dict.fromkeys(hints.named, 0)
        for b in running:
            own[b.named] += weight(b.text)
        whole, inner = dict(own), {}
        for k in reversed(hints.named):
            around = hints.named[k]
            if around:
                whole[around] += whole[k]
            inner.setdefault(around, []).append(k)
        total, k = sum(own.values()), 0
        while not own.get(k):
            k = next((c for c in inner.get(k, []) if 2 * whole[c] > total and c not in hints.talks), 0)
            if not k:
                break
            free.add(k)
        out = condemned()
    for b in found:
        b.boiler = b.boiler or out[b.named]


@dataclass
class Open:
    """An open element."""

    name: str
    place: str
    holder: bool
    link: bool


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    source = Source(page)
    stack: list[Open] = []
    where: dict[str, list[int]] = {}  # of each name, where in the stack it is open
    barriers: list[int] = []  # where elements that are not inline are open
    bad = good = links = part = opened = 0
    named, inside = [0], [0]
    hints = Hints()
    text: list[str] = []
    linked: list[str] = []

    def end_block() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                n_linked = len(" ".join(html.unescape("".join(linked)).split()))
                out.append(Block(whole, n_linked, bad > 0, good > 0, part, named[-1], inside[-1]))
            text.clear()
            linked.clear()

    def close(to: int) -> None:
        nonlocal bad, good, links, part
        while len(stack) > to:
            e = stack.pop()
            where[e.name].pop()
            if barriers and barriers[-1] == len(stack):
                barriers.pop()
            bad -= e.place == "bad"
            good -= e.place == "good"
            if e.place in ("named", "talk"):
                named.pop()
            if e.holder:
                inside.pop()
            links -= e.link
            part += e.place != ""

    at, n = 0, len(page)
    while at < n:
        k = source.find("<", at)
        piece = page[at : k if k >= 0 else n]
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)
        if k < 0:
            break
        if page.startswith("<!--", k):
            stop = source.find("-->", k + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        closing = page.startswith("</", k)
        m = NAME.match(page, k + 1 + closing)
        if not m:
            if page[k + 1 : k + 2] in ("!", "?", "/"):
                stop = source.find(">", k)
                at = stop + 1 if stop >= 0 else n
            else:  # no tag
                text.append("<")
                if links:
                    linked.append("<")
                at = k + 1
            continue
        name = m[0].lower()
        stop = source.end_of_tag(m.end())
        if stop < 0:  # the page ends inside a tag
            break
        inner, at = page[m.end() : stop], stop + 1
        if name in DROPPED:
            if not closing and not inner.endswith("/"):
                end = source.end_of_element(name, at)
                if end >= 0:
                    at = end
                elif name in ("script", "style", "textarea"):  # what follows is no markup
                    at = n
            text.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            end_block()
        elif name == "br":
            text.append(" ")
        if closing:
            own = where.get(name)
            if own and not (inline and barriers and barriers[-1] > own[-1]):
                close(own[-1])
        elif name not in VOID:
            if barriers:
                last = stack[barriers[-1]].name
                again = name in ("li", "tr", "td", "th", "dt", "dd")
                if last == "p" and (again or name in CLOSES_P) or again and last == name:
                    close(barriers[-1])
            if name in ("article", "main"):
                left = min((where[x][0] for x in LEFT_OPEN if where.get(x)), default=-1)
                if left >= 0 and not (where.get("article") and where["article"][-1] > left):
                    close(left)
            found = attributes(inner) if inner else {}
            place = "" if inline else _place(name, found, good > 0)
            bad += place == "bad"
            good += place == "good"
            opened += 1
            holder = place == "good" and not bad
            if holder:
                hints.holders[opened] = (name, named[-1], inside[-1])
                inside.append(opened)
            if place in ("named", "talk"):
                hints.named[opened] = named[-1]
                named.append(opened)
            if place == "talk":
                hints.talks.add(opened)
            link = name == "a"
            if link and "href" not in found:  # an anchor, unless it is closed
                end = NEXT_A.search(page, at) if "<a" not in source.gone else None
                if end is None:
                    source.gone.add("<a")
                link = end is not None and end[1] == "/"
            links += link
            part += place != ""
            where.setdefault(name, []).append(len(stack))
            if not inline:
                barriers.append(len(stack))
            stack.append(Open(name, place, holder, link))
    end_block()
    _pardon(out, hints)
    return out


def weight(text: str) -> int:
    """Characters, where a character of Chinese, Japanese and Korean counts as three."""
    return len(text) + 2 * len(WIDE.findall(text)) if not text.isascii() else len(text)


def stop_share(text: str) -> float:
    """The share of stop-words of the language that has most of them."""
    words = LETTERS.findall(text.lower())
    many = [0] * len(STOP_WORDS)
    for found in map(STOPS.get, words):
        if found:
            for k in found:
                many[k] += 1
    return max(many) / len(words) if words else 0.0


def first_pass(b: Block, listed: bool) -> bool | None:
    """listed: the page's language has a list of stop-words."""
    if b.boiler or b.linked > LINK_SHARE * len(b.text):
        return False
    if weight(b.text) < LONG:
        return None
    if b.stops >= STOP_SHARE or not listed and SENTENCE.search(b.text):
        return True
    return None


def has_list(found: list[Block]) -> bool:
    """Whether most of the page's long blocks are in a language of STOP_WORDS."""
    long = [b for b in found if b.linked <= LINK_SHARE * len(b.text) and weight(b.text) >= LONG]
    known = sum(weight(b.text) for b in long if b.stops >= STOP_SHARE)
    return 2 * known >= sum(weight(b.text) for b in long)


def second_pass(found: list[Block]) -> None:
    """Labels of undecided blocks, from decided ones of the first pass only."""
    labels = []
    # the nearest decided block before and behind, of the same part
    before: list[tuple[int, bool] | None] = []
    last: dict[int, tuple[int, bool]] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.part))
        if b.label is not None:
            last[b.part] = (i, b.label)
    behind: list[tuple[int, bool] | None] = [None] * len(found)
    last = {}
    for i in range(len(found) - 1, -1, -1):
        behind[i] = last.get(found[i].part)
        if found[i].label is not None:
            last[found[i].part] = (i, found[i].label)
    for i, b in enumerate(found):
        if b.label is not None:
            labels.append(b.label)
        elif before[i] and behind[i]:
            p, q = before[i], behind[i]
            labels.append(p[1] if i - p[0] < q[0] - i else q[1] if q[0] - i < i - p[0] else p[1] or q[1])
        elif before[i] or behind[i]:
            labels.append((before[i] or behind[i])[1])
        else:
            labels.append(b.article)
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str) -> str:
    found = blocks(page)
    listed = has_list(found)
    for b in found:
        b.label = first_pass(b, listed)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page.

    The whole html is read. Null or empty html, and pages without main text, give the empty text. Null or
    repeated ids and urls stay; other columns are ignored.
    """
    spark = pages.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=SCHEMA
            )

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return out.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(pages: DataFrame) -> DataFrame:
    return extract(pages)
