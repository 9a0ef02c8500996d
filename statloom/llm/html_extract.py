"""Main text of web pages by a maximum-scoring subsequence (operator 10).

A page is a sequence of words and tags. Each word scores by the least weight of the keys around it, each tag by its own
negative weight, and one linear scan finds the contiguous region with the largest sum. Weights are log-odds of words
(tags) inside against outside the content, counted on labelled pages: pages whose markup names its article. The sample
is bounded, a documented parameter: of the labelled pages about `sample`, drawn by a hash of id and text.

Keys stand in their context. Regions are elements with a landmark's name or a class, id or role; they are keys of
their own. Other blocks are keys together with the region around them (`li@nav`), so a list in an article is not a menu;
such a key without counts says nothing, and its words score as their region. Inline elements score as their block.
Tags are likewise counted with their region; without counts they have a small cost, less for inline ones but for links, of which menus consist.

Inside is what stands in an article or main element, except elements in it that bear a name of boilerplate: those are
outside unless they hold most of its words, so that a name never overrules what a page calls its article. Content within
a boilerplate-named wrapper is inside only if the page has no other. What wraps an article says nothing by the words
around it. Names of boilerplate (menus, forms, comments, ...) are a prior of `PRIOR` words outside, which labelled words
outweigh; a header in an article has none. Words with a negative weight inside an element of content (an advert in the
article) score nothing, so they cannot cut the region, and are left out of it. Scripts, styles and comments are no words.

Defined results: null or empty html, or html without a content word, gives an empty text; cut pages are read as far
as they go, and time and memory are linear in their length however deep elements nest; of regions with the same sum
the one that ends first is taken, and of these the shortest; repeated rows are extracted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import small_batches


TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?/]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*>", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "option": {"option"}}
PLAIN = {"html", "body", "div", "section", "span"}
CONTENT = {"article", "main"}
#: Elements that are regions without a mark.
LANDMARKS = CONTENT | {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "label", "dialog"}
#: Prior: names of boilerplate, as elements and in class, id and role.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "label", "dialog"}
OUTSIDE_MARK = re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|comment-list|cookies?|consent|footer|header|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo|promoted|related|reply|replies|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|search|login)(?:$|[-_ 0-9])", re.I)
PRIOR = 20.0


class Page:
    """The elements that are open while a page is read; each is told to `opened` and `closed` as (name, keys, outer)."""

    def __init__(self, opened=None, closed=None):
        self.opened, self.closed, self.stack, self.names = opened, closed, [], Counter()

    def _push(self, name: str, own: list[str]):
        self.stack.append((name, self.opened(name, own, self.stack[-1][1] if self.stack else None)))
        self.names[name] += 1

    def _pop(self) -> str:
        name, state = self.stack.pop()
        self.names[name] -= 1
        if self.closed:
            self.closed(state, self.stack[-1][1] if self.stack else None)
        return name

    def read(self, page: str):
        """(state of the innermost open element, tag name or None, text or None) in page order; a tag's state is its own."""
        state = lambda: self.stack[-1][1] if self.stack else None
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                yield state(), None, page[at : m.start()]
            at, raw = m.end(), m.group()
            if m.group(1) or raw.startswith(("<!", "<?")) or not (named := NAME.match(raw)):
                continue
            name = named.group(1).lower()
            if raw[1] == "/":
                if self.names[name]:
                    while self._pop() != name:
                        pass
                yield state(), name, None
                continue
            while self.stack and self.stack[-1][0] in CLOSES.get(name, ()):
                self._pop()
            own = [name] if name in LANDMARKS else []
            for a in MARK.finditer(raw):
                own += [f"{'div' if name in PLAIN else name}.{w.lower()}" for w in (a[1] or a[2] or a[3] or "").split()]
            if name not in VOID and not raw.endswith("/>"):
                self._push(name, own)
            yield state(), name, None
        if at < len(page):
            yield state(), None, page[at:]
        while self.stack:
            self._pop()


def is_outside(key: str) -> bool:
    element, _, mark = key.partition(".")
    return element in OUTSIDE or bool(mark and OUTSIDE_MARK.search(mark))


def is_labelled(html_col: Column) -> Column:
    """Whether a page names its content."""
    return F.coalesce(html_col.rlike(r"(?i)<(article|main)[\s>]"), F.lit(False))


def is_named(own: list[str], in_content: bool) -> bool:
    """Whether an element bears a name of boilerplate; an article's own header does not."""
    return any(is_outside(k) for k in own if not (in_content and k == "header"))


def _region(name: str, own: list[str], outer: str, in_content: bool) -> tuple[str, list[str]]:
    """The region that an element is in or opens, and its keys; an article's own header is a block like any other."""
    if in_content and own[:1] == ["header"]:
        own = own[1:]
    if own:
        return own[0], own
    return outer, [] if name in INLINE or name in PLAIN else [f"{name}@{outer}"]


def _decided(page: str) -> set[int]:
    """Numbers, in order of opening, of the elements that a labelled page shows to be outside though within content."""
    found: list[list] = []  # of named elements in content, and of content in named wrappers: number, words, those of the content

    class Element:
        __slots__ = ("content", "named", "number", "words", "wrapped")

    number, clean = 0, 0

    def opened(name, own, outer):
        nonlocal number
        e = Element()
        e.number, e.words, e.content = number, 0, outer.content if outer else None
        number += 1
        within = e.content is not None
        named = is_named(own, within)
        e.wrapped = (outer.wrapped if outer else False) or (named and not within)
        if not within and name in CONTENT:
            e.content = e
        e.named = named and within and not (outer.named if outer else False)
        return e

    def closed(e, outer):
        nonlocal clean
        if outer:
            outer.words += e.words
        if e.named:
            found.append([e.number, e.words, e.content])
        elif e.content is e:
            if e.wrapped:
                found.append([e.number, e.words, None])
            else:
                clean += e.words

    for e, _, text in Page(opened, closed).read(page):
        if text is not None and e:
            e.words += len(text.split())
    return {n for n, words, content in found if (2 * words <= content.words if content is not None else clean)}


def counts(page: str) -> Counter:
    """(kind, key, inside) counts of a labelled page."""
    out: Counter = Counter()
    open_keys: Counter = Counter()
    decided, number = _decided(page), 0

    class Element:
        __slots__ = ("inside", "keys", "outside", "region", "words", "wraps")

    def opened(name, own, outer):
        nonlocal number
        e = Element()
        e.region, keys = _region(name, own, outer.region if outer else "", bool(outer and outer.inside))
        e.keys = [k for k in dict.fromkeys(keys) if not open_keys[k]]  # a key counts a word once
        open_keys.update(e.keys)
        e.wraps, e.words = False, [0, 0]
        e.inside = name in CONTENT or (outer.inside if outer else False)
        e.outside = e.inside and (number in decided or (outer.outside if outer else False))
        number += 1
        return e

    def closed(e, outer):
        open_keys.subtract(e.keys)
        for k in e.keys:
            out["word", k, True] += e.words[1]
            if not e.wraps:
                out["word", k, False] += e.words[0]
        if outer:
            outer.words[0] += e.words[0]
            outer.words[1] += e.words[1]
            outer.wraps |= e.wraps or (e.inside and not e.outside and not outer.inside)

    for e, name, text in Page(opened, closed).read(page):
        inside = bool(e and e.inside and not e.outside)
        if text is None:
            out["tag", f"{name}@{e.region if e else ''}", inside] += 1
        elif e:
            e.words[inside] += len(text.split())
        else:
            out["word", "", False] += len(text.split())
    return +out


class Weights:
    def __init__(self, rows: list[tuple[str, str, float, float]]):
        """`rows`: (kind, key, count inside, count outside)."""
        self.word: dict[str, float | None] = {}
        self.tag: dict[str, float] = {}
        for kind, key, a, b in rows:
            if kind == "word":
                self.word[key] = self._odds(key, a, b)
            else:
                self.tag[key] = -0.1 - b / (a + b + 1)

    @staticmethod
    def _odds(key: str, a: float, b: float) -> float:
        prior = (PRIOR, 1.0) if key in CONTENT else (1.0, 1.0) if "@" in key else (1.0, PRIOR) if is_outside(key) else (2.0, 1.0)
        return max(-3.0, min(3.0, math.log((a + prior[0]) / (b + prior[1]))))

    def of(self, key: str) -> float | None:
        """None for a block that no labelled page has in this region."""
        if key not in self.word:
            self.word[key] = None if "@" in key else self._odds(key, 0, 0)
        return self.word[key]

    def of_tag(self, name: str, region: str) -> float:
        return self.tag.get(f"{name}@{region}", UNSEEN_LINK if name == "a" else UNSEEN_INLINE if name in INLINE else UNSEEN_BLOCK)


#: Costs of tags that no labelled page has in their region: a link of two words in a list item is worth nothing.
UNSEEN_LINK, UNSEEN_INLINE, UNSEEN_BLOCK = -0.15, -0.02, -0.1
#: Weight of words within elements without a key.
BARE = 0.25


def items(page: str, weights: Weights) -> list[tuple[float, float | None, str]]:
    """(score, weight or None of a tag, text) of the page's tags and texts in order."""

    def opened(name, own, outer):
        """(least weight of the keys around or None, whether in an element of content, region)"""
        least, content, region = outer or (None, False, "")
        region, keys = _region(name, own, region, content)
        for k in keys:
            w = weights.of(k)
            least = least if w is None else w if least is None or w < least else least
        return least, content or name in CONTENT, region

    out = []
    for state, name, text in Page(opened).read(page):
        least, content, region = state or (None, False, "")
        if text is None:
            out.append((weights.of_tag(name, region), None, " " if name not in INLINE else ""))
        else:
            w = BARE if least is None else min(least, 3.0)
            text = html.unescape(text)
            out.append((0.0 if w < 0 and content else w * len(text.split()), w, text))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the largest positive sum, in one scan."""
    best, total, begin, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def extract(page: str | None, weights: Weights) -> str:
    """The text of the page's best region."""
    own = items(page or "", weights)
    i, j = best_region([score for score, _, _ in own])
    return " ".join("".join(s for _, w, s in own[i:j] if w is None or w > 0).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 2000) -> list[tuple[str, str, float, float]]:
    """Weights' counts from about `sample` labelled pages; only these pages' keys reach the driver."""
    labelled = pages.filter(is_labelled(F.col(html_col)))
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64(id_col, html_col), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else labelled

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(counts(page))
        kind, key, inside = zip(*total) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(inside, pa.bool_()), pa.array(total.values(), pa.int64())], ["kind", "key", "inside", "n"])

    rows = chosen.select(html_col).mapInArrow(run, "kind string, key string, inside boolean, n bigint")
    summed = rows.groupBy("kind", "key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    return sorted((r.kind, r.key, float(r.a), float(r.b)) for r in summed.collect())


def main_text(pages: DataFrame, rows: list[tuple[str, str, float, float]], html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns with text and n_chars of every page; map only."""
    data = pages.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        weights = Weights(data.value)
        for batch in small_batches(batches):
            texts = [extract(p, weights) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html_col).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
