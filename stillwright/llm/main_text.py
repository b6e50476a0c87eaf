"""Main text of web pages by tree scoring.

Every block of text is a paragraph whose points (length and commas) go to its ancestors, less the
farther they are; a container's points are discounted by its share of link text. What element, role,
class or id name as header, footer, sidebar, notice, advert, form or comments gives fewer points, but
whatever holds the best container stays, whatever its name. The best container is kept with those
siblings that score or are made like it and the headline before it, without what is named otherwise in it.
"""

from __future__ import annotations

import html as entities
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import column, steps

#: Element names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title nav button select textarea option iframe object svg canvas audio video dialog menu math noscript template".split())
NAMED = frozenset("header footer aside form".split())
HEADINGS = frozenset("h1 h2 h3".split())
CLOSES_ITSELF = {x: frozenset(ys.split()) for x, ys in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}.items()}
SCOPES = frozenset("ul ol dl table article section main div body td th".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class and id that name what is not the article; the second set counts outside an article only.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended paywall sidebar".split())
OUTER = frozenset("header footer nav navbar navigation menu breadcrumb breadcrumbs masthead toolbar login search pagination pager copyright widget tags".split())
#: Words that are topics as well ('social-impact'), and words that only say how an element is laid out.
TOPICS = frozenset("alert notice notices share sharing social related reply replies respond sponsor signup subscription".split())
LAYOUT = frozenset("box block bar area wrap wrapper container inner outer list item items row col column section panel module content body left right top bottom main links icons buttons button form text small large".split())
COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
#: After the first and before the second a word is no name but a state of the element.
STATES_BEFORE, STATES_AFTER = frozenset("has have no not with without hide show open".split()), frozenset("open closed enabled disabled on off".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: Points for a paragraph's ancestors from its parent on; share of them that what is named gives, and comments.
SHARES, OF_NAMED, OF_COMMENTS = (1, 1 / 2, 1 / 6, 1 / 9), 0.2, 0.02
#: Points of an element that says it is the article; characters that may stand between a headline and it.
SAYS_SO, BEFORE = 25.0, 300

#: Where markup begins: a comment, an element of raw text, a declaration, or a tag's name; `rest` is what nothing ends.
HEAD = regex.compile(
    r"<!--(?:.*?-->|(?P<rest>.*))|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*+>(?:.*?</(?P=raw)\s*+>|(?P<rest>.*))|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)",
    regex.S | regex.I,
)
ATTRS = regex.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", regex.S)
NAMES = regex.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
HIDDEN = regex.compile(r"\shidden(?:\s|=|$)", regex.I)
STYLE, UNSEEN = regex.compile(r"\bstyle\s*+=", regex.I), regex.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", regex.I)
PARTS = regex.compile(r"[^a-z]+")


def _names(words: list[str]) -> set[str]:
    """The words of a class or id that name its element: 'has-sidebar', 'comments-open' tell a state of it."""
    return {w for k, w in enumerate(words) if not (k and words[k - 1] in STATES_BEFORE or k + 1 < len(words) and words[k + 1] in STATES_AFTER)}


def _named(words: list[str], in_article: bool) -> set[str]:
    """The names in one word of a class or id; in an article a topic with an unknown word beside it names nothing."""
    found = _names(words)
    names = found & (BOILERPLATE | OUTER)
    return set() if in_article and names <= TOPICS and found - names - LAYOUT - {""} else found


def _hidden(attrs: str) -> bool:
    """Whether attributes hide their element."""
    if HIDDEN.search(" " + attrs):
        return True
    styles = ((part, STYLE.search(part)) for part in attrs.split(">"))
    return any(m and UNSEEN.search(part, m.end()) for part, m in styles)


class Closings:
    """Where tags end, for a page with one that doesn't: found once for all quotes, from the right."""

    def __init__(self, source: str, begin: int) -> None:
        self.marks = [m.start() for m in regex.finditer("[>\"']", source, pos=begin)]
        self.ends = [-1] * len(self.marks)
        last: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = source[self.marks[i]]
            if c == ">":
                self.ends[i] = self.marks[i]
            else:  # what follows the quote of the same kind
                k = last.get(c, len(self.marks)) + 1
                self.ends[i] = self.ends[k] if k < len(self.marks) else -1
                last[c] = i

    def of(self, at: int) -> int:
        """The end of the tag whose attributes begin at `at`; -1 for none."""
        i = bisect_left(self.marks, at)
        return self.ends[i] if i < len(self.marks) else -1


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """begin, end, tag, whether it is an end tag, attributes of all markup; tag is empty for what is no element. Text lies between."""
    last = source.rfind(">") + 1  # markup ends with it; behind it an unended comment is all there can be
    at, closings = 0, None
    while at < last:
        m = HEAD.search(source, at, last)
        if not m:
            break
        at = m.end()
        if m["rest"] is not None:
            yield m.start(), len(source), "", False, ""
            return
        if not m["tag"]:
            yield m.start(), at, "", False, ""
            continue
        if closings is None and (found := ATTRS.match(source, at)):
            end = found.end() - 1
        else:  # a quote that nothing ends: from here on ends are looked up
            closings = closings or Closings(source, at)
            end = closings.of(at)
        if end < 0:
            at = m.start() + 1  # no tag: text
            continue
        yield m.start(), end + 1, m["tag"].lower(), bool(m["end"]), source[at:end]
        at = end + 1
    if (at := source.find("<!--", at)) >= 0:
        yield at, len(source), "", False, ""


def _weight(tag: str, attrs: str, in_article: bool) -> tuple[float, str]:
    """What a text counts for in an element: 0 where it never does, 1 where it is nothing but text; and the class."""
    if tag in DROPPED or attrs and tag not in ("html", "body") and _hidden(attrs):
        return 0.0, ""
    weight = OF_NAMED if tag in NAMED and not (tag == "header" and in_article) else 1.0
    if tag in ("html", "body", "main") or not attrs:
        return weight, ""
    kind = ""
    for name, *values in NAMES.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            if tag != "article" and ROLES.intersection(PARTS.split(value)):
                weight = min(weight, OF_NAMED)
            continue
        if name == "class":
            kind = value
        words = set().union(*(_named(PARTS.split(x), in_article) for x in value.split()))
        if COMMENT.intersection(words):
            weight = OF_COMMENTS
        elif tag != "article" and (BOILERPLATE.intersection(words) or not in_article and OUTER.intersection(words)):
            weight = min(weight, OF_NAMED)
    return weight, kind


class Tree:
    """Elements in page order, each with its subtree's end, and the runs of text below them."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.ends, self.article, self.links = ["html"], [-1], [0], [-1], [False]
        #: Weight of an element by itself, and with its ancestors; its class.
        self.own, self.weights, self.kinds = [1.0], [1.0], [""]
        self.runs: list[tuple[int, str]] = []  # element, text
        self._stack, self._blocks = [0], [0]
        self._open: dict[str, list[int]] = {}  # places in the stack, by tag; of all but inline ones
        at = 0
        for begin, end, tag, ends, attrs in tokens(source):
            if at < begin:
                self.runs.append((self._stack[-1], source[at:begin]))
            at = end
            if tag:
                (self._end if ends else self._begin)(tag, attrs)
        if at < len(source):
            self.runs.append((self._stack[-1], source[at:]))
        self._close(1)
        self.ends[0] = len(self.tags)

    def _close(self, upto: int) -> None:
        """Close all from place `upto` of the stack on; the root stays."""
        while len(self._stack) > max(upto, 1):
            n = self._stack.pop()
            self.ends[n] = len(self.tags)
            self._open[self.tags[n]].pop()
            if self.tags[n] not in INLINE:
                self._blocks.pop()

    def _last(self, tags: frozenset) -> int:
        """The highest place in the stack of any of the tags; 0 without."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _end(self, tag: str, attrs: str) -> None:
        place = self._open[tag][-1] if self._open.get(tag) else 0
        if place and not (tag in INLINE and self._blocks[-1] > place):
            self._close(place)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P or tag in CLOSES_ITSELF:
            place = self._last(CLOSES_ITSELF.get(tag, frozenset(("p",))))
            if place and place >= self._last(SCOPES):
                self._close(place)
        up, n = self._stack[-1], len(self.tags)
        weight, kind = _weight(tag, attrs, self.article[up] >= 0)
        self.tags.append(tag)
        self.parents.append(up)
        self.ends.append(n + 1)
        self.article.append(n if tag == "article" else self.article[up])
        self.links.append(self.links[up] or tag == "a")
        self.own.append(weight)
        self.weights.append(self.weights[up] * weight)
        self.kinds.append(kind)
        if tag == "br":
            self.runs.append((up, " "))
        if tag not in VOID and not attrs.endswith("/"):
            self._open.setdefault(tag, []).append(len(self._stack))
            if tag not in INLINE:
                self._blocks.append(len(self._stack))
            self._stack.append(n)

    def blocks(self) -> list[int]:
        """The nearest element of each that isn't inline."""
        out: list[int] = []
        for n, tag in enumerate(self.tags):
            out.append(out[self.parents[n]] if tag in INLINE or tag == "br" else n)
        return out

    def above(self, n: int) -> list[int]:
        """An element and its ancestors."""
        out = []
        while n >= 0:
            out.append(n)
            n = self.parents[n]
        return out

    def gone(self, best: int, headers: list[float] | None = None) -> list[bool]:
        """Elements that are never text, or named otherwise, with all in them; those that hold `best` are not, nor
        headers whose number in `headers` (characters of links), if it is given, is 0."""
        spared, out = set(self.above(best)), []
        for n, weight in enumerate(self.own):
            own = weight < 1 and n not in spared and not (headers is not None and weight > 0 and self.tags[n] == "header" and not headers[n])
            out.append(n > 0 and (out[self.parents[n]] or own))
        return out


def _scores(tree: Tree, block: list[int], kept: list[tuple[int, int, str]]) -> tuple[list[float], list[float], list[float]]:
    """Score, weighted characters, and those of them in links, of each element with all in it; -1: no container."""
    size, linked, commas = ([0.0] * len(tree.tags) for _ in range(3))
    for n, b, text in kept:
        chars = len("".join(text.split())) * tree.weights[n]
        size[b] += chars
        linked[b] += chars * tree.links[n]
        commas[b] += text.count(",")
    points = [SAYS_SO * (tag in ("article", "main")) * weight for tag, weight in zip(tree.tags, tree.weights, strict=True)]
    for n, chars in enumerate(size):
        if chars:
            whole = chars / tree.weights[n] if tree.weights[n] else 0.0
            gain = (1 + commas[n] + min(whole / 100, 3)) * (1 - linked[n] / chars) * tree.weights[n]
            up = tree.parents[n] if n else 0
            for share in SHARES:
                points[up] += gain * share
                if up == 0:
                    break
                up = tree.parents[up]
    for n in range(len(tree.tags) - 1, 0, -1):
        size[tree.parents[n]] += size[n]
        linked[tree.parents[n]] += linked[n]
    return [p * (1 - linked[n] / size[n]) if size[n] and block[n] == n else -1.0 for n, p in enumerate(points)], size, linked


def _headline(tree: Tree, best: int, gone: list[bool], kept: list[tuple[int, int, str]], linked: list[float]) -> list[tuple[int, int]]:
    """The h1 shortly before a container that does not begin with a heading itself and has no h1. In a header
    it counts where the header has no link: the headline's own, not the site's."""
    inside = [b for n, b, text in kept if best <= n < tree.ends[best] and not gone[n] and not text.isspace()]
    if not inside or tree.tags[inside[0]] in HEADINGS or "h1" in tree.tags[best : tree.ends[best]]:
        return []
    lost = tree.gone(best, headers=linked)
    heads = [n for n in range(best) if tree.tags[n] == "h1" and not lost[n] and tree.ends[n] <= best]
    between = sum(len(text) for n, b, text in kept if heads and tree.ends[heads[-1]] <= n < best and not gone[n])
    if not heads or between > BEFORE:
        return []
    gone[heads[-1] : tree.ends[heads[-1]]] = lost[heads[-1] : tree.ends[heads[-1]]]
    return [(heads[-1], tree.ends[heads[-1]])]


def main_text(source: str) -> str:
    """The article of a page: character references decoded, white space one space, blocks joined by one."""
    tree = Tree(source)
    block = tree.blocks()
    kept = [(n, block[n], entities.unescape(text)) for n, text in tree.runs if tree.weights[n]]
    score, size, linked = _scores(tree, block, kept)
    if not size[0]:
        return ""
    best = max(range(len(score)), key=score.__getitem__)
    if tree.article[best] >= 0:
        best = tree.article[best]
    gone = tree.gone(best)
    spans = [(best, tree.ends[best]), *_headline(tree, best, gone, kept, linked)]
    # a wrapper of nothing but the best container stands for it among its siblings
    while best and tree.parents[best] and tree.tags[tree.parents[best]] != "body" and size[tree.parents[best]] == size[best] and tree.weights[tree.parents[best]] == tree.weights[best]:
        best, score[tree.parents[best]] = tree.parents[best], max(score[best], score[tree.parents[best]])
    if best:
        enough = max(10.0, 0.2 * score[best])
        up = tree.parents[best]
        n = up + 1
        while n < tree.ends[up]:  # children of the parent
            if n != best and size[n] and not gone[n]:
                density = linked[n] / size[n]
                alike = tree.tags[n] == tree.tags[best] and tree.kinds[n] == tree.kinds[best] and (tree.tags[n] == "section" or tree.kinds[n] != "" or size[n] >= 0.3 * size[best])
                if score[n] >= enough or alike and density < 0.25 or tree.tags[n] == "p" and (size[n] >= 80 and density < 0.25 or size[n] < 80 and density == 0):
                    spans.append((n, tree.ends[n]))
            n = tree.ends[n]
    edge = [0] * (len(tree.tags) + 1)
    for begin, end in spans:
        edge[begin] += 1
        edge[end] -= 1
    held, inside = 0, []
    for step in edge[:-1]:
        held += step
        inside.append(held > 0)
    out: list[str] = []
    last = -1
    for n, b, text in kept:
        if inside[n] and not gone[n]:
            if b != last:
                out.append(" ")
            out.append(text)
            last = b
    return " ".join("".join(out).split())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    One map over the rows, without a shuffle; memory is bounded by a page, time by its length however
    deep or wide its tree is. Null or empty html gives an empty text, markup without text too; null ids
    and urls stay null; repeated rows stay; an empty table gives an empty result; other columns, those
    named text or n_chars too, are not read. Of containers that score alike the first one is taken.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "html"):
            found = [main_text(x) for x in column(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
