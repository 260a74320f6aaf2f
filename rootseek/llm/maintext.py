"""Main text of web pages: the best-scoring contiguous region of words and tags.

Method: a page is a sequence of words and tags. Words score positive and tags
negative; one linear scan finds the contiguous region with the highest sum
(maximum-scoring subsequence). Elements that are boilerplate drop out before:
they neither score nor appear, so one in the middle of an article does not cut it.
The weights come from labelled pages, those that mark their article with
``<article>`` or ``<main>``. For every element key (tag name, and each class,
id or role beside it) learning counts the occurrences inside and outside such
an article; a tag's penalty and whether an element is boilerplate follow from these
counts. An element that encloses an article counts as inside and is no boilerplate.
A short fixed list names elements that are boilerplate by their
meaning. Keys that are not among the most frequent ones stay in a table, and pages
are joined to it, so no key is left out. On a page with a marked article, words outside it score negative.

An article counts as marked if its tag is one of the page (not of a comment or a script),
it stands outside boilerplate, is not hidden and holds words. Failing those, one counts that
stands in boilerplate by class names only, or on a page that has no words elsewhere in any, and
holds most of the words that are left when the elements around it are kept. Class
names and learned keys are evidence, not proof: an element that holds most of
the page's words (of those in the marked article, if it stands in one) is kept in spite of them.
How much "most" is follows from the evidence, see ``Extractor.level``.

A block is the text between two block-level tags; white space inside it
becomes one space, blocks are joined by one line feed, and character references
are decoded as browsers do.

Defined cases: null or empty html, or a page without any word of content, gives
the empty text; an empty table gives an empty result; very long pages are read whole, in linear time; markup that is cut off or not closed is read as far as it goes;
a closing tag ends its element at any depth, a stray one does nothing, and p, li, dd, dt,
option and the parts of a table end where HTML ends them without a closing tag;
equal ids stay separate rows; other columns are ignored. Without any labelled
page the fixed list alone decides.
"""

from __future__ import annotations

import html as entities
import re
from collections import ChainMap, defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import arrow_rows, durable, per_partition
from rootseek.llm.jaccard import add_key, bit_filter, ddl, passing, text_key

# Element names and the words of class, id and role attributes, by their meaning in HTML.
RAW = frozenset("script style noscript template textarea svg math iframe object select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr script style template noscript".split()
)
BOILERPLATE = frozenset("nav header footer aside menu dialog button".split()) | RAW
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navigation navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside related share social "
    "notice cookie cookies consent popup modal newsletter subscribe "
    "form search login complementary contentinfo alert".split()
)
READERS = frozenset("comment comments disqus replies".split())
#: Parts that make a class name tell a state or a layout ("has-sidebar", "comments-open") instead of what an element is.
STATES = frozenset("has no with without open opened closed enabled disabled on off".split())
ARTICLE = frozenset(("article", "main"))

# Elements that HTML closes without a closing tag: by opening tag, the names it closes and the scope in which it looks for them.
_TABLE = ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")
ENDS = {
    **{n: ((_TABLE[:2], "#table"),) for n in ("td", "th")},
    "tr": ((("td", "th", "tr", "caption", "colgroup"), "#table"),),
    **{n: ((_TABLE, "#table"),) for n in ("tbody", "thead", "tfoot", "caption", "colgroup")},
    "option": ((("option",), "#select"),),
    "optgroup": ((("option", "optgroup"), "#select"),),
    "li": ((("li",), "#list"), (("p",), "#p")),
    **{n: ((("dd", "dt"), "#list"), (("p",), "#p")) for n in ("dd", "dt")},
    **{
        n: ((("p",), "#p"),)
        for n in (
            "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr listing main menu nav ol p plaintext pre search section summary table ul xmp"
        ).split()
    },
}
#: Elements that bound such a scope.
_BOUNDS = {
    "#table": "table template",
    "#select": "select datalist template",
    "#list": "ul ol menu dir dl table caption td th article aside section main nav header footer blockquote figure figcaption form fieldset details summary center pre button object template select dialog search body",
    "#p": "applet caption table td th marquee object select template button svg math html",
}
SCOPES: dict[str, list[str]] = defaultdict(list)
for _scope, _names in _BOUNDS.items():
    for _name in _names.split():
        SCOPES[_name].append(_scope)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
MARKED = re.compile(r"<(article|main)\b", re.I)
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[\s_-]+")

#: Element keys broadcast, the most frequent ones, and characters of them in all; pages are joined to the other keys.
KEYS, KEY_CHARS = 50_000, 4_000_000
#: Element keys counted in a task before it hands its counts on.
COUNTED = 100_000
#: Occurrences outside articles from which a key that never lies inside one is boilerplate.
ENOUGH = 5
#: What every tag costs, in words, besides its learned penalty.
TAG_COST = 0.05


#: Levels of evidence that an element is boilerplate, and the share of the words, in percent, from which it is kept in spite of it.
NONE, PART, WHOLE, SURE = 0, 1, 2, 3
KEEPS = {PART: 50, WHOLE: 90}


def named(attributes: str) -> list[tuple[str, str]]:
    """(name in lower case, value) of an opening tag's attributes."""
    return [(name.lower(), value.strip("\"'")) for name, value in ATTRIBUTE.findall(attributes)]


def keys_of(name: str, attributes: str) -> list[str]:
    """An element's keys: its name, and its name with each class, id and role."""
    found = [name]
    if attributes:
        for kind, value in named(attributes):
            if kind in ("class", "id", "role"):
                found += [f"{name}.{w.lower()}" for w in value.split()]
    return found


def hinted(name: str, attributes: str) -> int:
    """The level at which an element is boilerplate by its meaning.

    ``SURE``: by its tag, hidden, or named as readers' comments. ``WHOLE``: a form, or
    named by a listed word alone. ``PART``: a listed word is part of a longer name.
    """
    if name in BOILERPLATE:
        return SURE
    level = WHOLE if name == "form" else NONE
    if not attributes or name in ("html", "body"):
        return level
    for kind, value in named(attributes):
        if (kind == "hidden" and value.lower() != "false") or (kind == "style" and NOT_SHOWN.search(value)):
            return SURE
        if kind == "aria-hidden" and value.lower() == "true":
            level = max(level, WHOLE)
        if kind not in ("class", "id", "role") or name in ARTICLE:
            continue
        for token in value.lower().split():
            parts = {w for w in WORDS.split(token) if w}
            if len(parts) > 1 and parts & STATES:
                continue
            if parts & READERS:
                return SURE
            if parts & HINTS:
                level = max(level, PART if len(parts) > 1 else WHOLE)
    return level


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        attributes = m[3] if m[2] else m[6]
        yield "open", name, attributes
        if attributes.endswith("/") and name in ("svg", "math"):
            yield "close", name, ""
        elif name in RAW and name not in ("head", "object", "select", "svg", "math"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""


class Walk:
    """Open elements while a page is scanned.

    ``level`` judges an element by name and attributes. Those whose opening tags are numbered
    in ``kept`` are no boilerplate, those in ``marks`` are the articles that count.
    """

    def __init__(self, level, kept: frozenset[int] | set[int] = frozenset(), marks: frozenset[int] | set[int] = frozenset(), left=None):
        self.level, self.kept, self.marks, self.left = level, kept, marks, left
        self.open, self.bad, self.sure, self.articles, self.tags = [], 0, 0, 0, 0
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in ``open``, by name and by scope

    def step(self, kind: str, name: str, attributes: str) -> None:
        if kind == "open":
            number, self.tags = self.tags, self.tags + 1
            for closed, scope in ENDS.get(name, ()):
                self._end(closed, scope)
            if name in VOID:
                return
            level = NONE if number in self.kept else self.level(name, attributes)
            for place in (name, *SCOPES.get(name, ())):
                self.at[place].append(len(self.open))
            self.open.append((name, level, number))
            self.bad += level > NONE
            self.sure += level == SURE
            self.articles += number in self.marks
            if name == "body":  # what an unclosed head left open
                self._leave("head")
        elif kind == "close":
            self._leave(name)

    def _leave(self, name: str) -> None:
        """Close the innermost element of this name and all within it; a stray closing tag does nothing."""
        if self.at.get(name):
            self._cut(self.at[name][-1])

    def _end(self, names: tuple[str, ...], scope: str) -> None:
        """Close the elements of these names that are open inside the innermost one that bounds the scope."""
        bound = self.at[scope][-1] if self.at.get(scope) else -1
        found = [self.at[n][-1] for n in names if self.at.get(n) and self.at[n][-1] > bound]
        if found:
            self._cut(min(found))

    def _cut(self, size: int) -> None:
        while len(self.open) > size:
            name, level, number = self.open.pop()
            self.bad -= level > NONE
            self.sure -= level == SURE
            self.articles -= number in self.marks
            if self.left:
                self.left(number)
            for place in (name, *SCOPES.get(name, ())):
                self.at[place].pop()


class _Element:
    """An article, or an element that may be boilerplate: where it stands and how many words lie in it."""

    __slots__ = ("article", "level", "bad", "sure", "start", "words")

    def __init__(self, article: bool, level: int, bad: int, sure: int, start: tuple[int, int, int]):
        self.article, self.level, self.bad, self.sure, self.start, self.words = article, level, bad, sure, start, (0, 0, 0)


def _measured(events: list[tuple[str, str, str]], level, kept: set[int]) -> tuple[dict[int, _Element], dict[int, int | None], list[int]]:
    """Elements of interest by the number of their opening tag, the element above each element, and the page's words: all, outside what is surely boilerplate, outside all boilerplate."""
    found: dict[int, _Element] = {}
    parent: dict[int, int | None] = {}
    seen = [0, 0, 0]

    def left(number: int) -> None:
        if number in found:
            found[number].words = tuple(n - b for n, b in zip(seen, found[number].start))

    walk = Walk(level, kept, left=left)
    for kind, name, attributes in events:
        if kind == "text":
            n = len(name.split())
            seen[0] += n
            seen[1] += n if not walk.sure else 0
            seen[2] += n if not walk.bad else 0
            continue
        walk.step(kind, name, attributes)
        if kind == "open" and walk.open and walk.open[-1][2] == walk.tags - 1:
            _, mine, number = walk.open[-1]
            parent[number] = walk.open[-2][2] if len(walk.open) > 1 else None
            if name in ARTICLE or mine in KEEPS:
                found[number] = _Element(name in ARTICLE, mine, walk.bad, walk.sure, tuple(seen))
    walk._cut(0)
    return found, parent, seen


def _above(numbers: set[int], parent: dict[int, int | None]) -> set[int]:
    out: set[int] = set()
    for i in numbers:
        above = parent[i]
        while above is not None and above not in out:
            out.add(above)
            above = parent[above]
    return out


def outline(events: list[tuple[str, str, str]], level) -> tuple[set[int], set[int], set[int]]:
    """(around, kept, marks): numbers of the opening tags of elements that enclose a marked article, of all that are kept in spite of evidence, and of marked articles."""
    found, parent, seen = _measured(events, level, set())
    articles = {i for i, e in found.items() if e.article and e.level != SURE}
    marks = {i for i in articles if not found[i].bad and found[i].words[2]}
    if not marks and articles:
        inner = {i for i in articles if not found[i].sure or not seen[1]}
        again, _, clean = _measured(events, level, _above(inner, parent))
        marks = {i for i in inner if again[i].words[2] and 100 * again[i].words[2] > KEEPS[PART] * clean[2]}
    around = _above(marks, parent)
    within: dict[int | None, int | None] = {None: None}  # the outermost marked article that an element stands in
    for i in parent:  # in page order, so the element above comes first
        within[i] = i if within[parent[i]] is None and i in marks else within[parent[i]]
    kept = around | marks
    for i, e in found.items():
        if e.level in KEEPS and not e.sure and i not in kept and (not marks or within[i] is not None):
            whole = found[within[i]].words[1] if marks else seen[1]
            if e.words[1] and 100 * e.words[1] > KEEPS[e.level] * whole:
                kept.add(i)
    return around, kept, marks


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside, names = defaultdict(int), defaultdict(int), set()

    def settle() -> pa.RecordBatch:
        found = sorted(inside.keys() | outside.keys())
        out = arrow_rows({
            "key": (found, pa.string()), "tag": ([k in names for k in found], pa.bool_()),
            "inside": ([inside.get(k, 0) for k in found], pa.int64()), "outside": ([outside.get(k, 0) for k in found], pa.int64()),
        })
        for held in (inside, outside, names):
            held.clear()
        return out

    for batch in batches:
        for page in batch.column(0).to_pylist():
            if page is None or not MARKED.search(page):
                continue
            events = list(scan(page))
            around, kept, marks = outline(events, hinted)
            if not marks:
                continue
            walk = Walk(hinted, kept, marks)
            for kind, name, attributes in events:
                if kind == "text":
                    continue
                walk.step(kind, name, attributes)
                if kind == "open":
                    for key in keys_of(name, attributes)[walk.bad > 0 :]:
                        (inside if walk.articles or walk.tags - 1 in around else outside)[key] += 1
                    if not walk.bad:
                        names.add(name)
            if len(inside) + len(outside) > COUNTED:
                yield settle()
    yield settle()


def _weight(inside: int, outside: int, bad: bool) -> tuple[float, bool]:
    return TAG_COST + max(0.0, log((outside + 1) / (inside + 1))), bad


class Weights(dict):
    """Element key to (penalty of its tag, boilerplate or not): the most frequent keys; ``rest`` is a table of the others, if any."""

    rest: DataFrame | None = None


def learn(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages: those of every tag, and of every class, id and role that is boilerplate."""
    counts = per_partition(pages.select(F.col(html_col).cast("string").alias("html")), _learn, "key string, tag boolean, inside long, outside long")
    total = counts.groupBy("key").agg(F.max("tag").alias("tag"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    ruled = total.withColumn("bad", F.expr(f"inside = 0 AND outside >= {ENOUGH}")).where("tag OR bad")
    ruled = durable(ruled.select("key", "inside", "outside", "bad", F.expr("inside + outside").alias("seen")), "element-keys")
    short = F.length("key") <= KEY_CHARS // KEYS
    top = ruled.where(short).orderBy(F.desc("seen"), "key").limit(KEYS).collect()
    weights = Weights({r.key: _weight(r.inside, r.outside, r.bad) for r in top})
    others = ~short
    if len(top) == KEYS:
        seen, key = F.lit(top[-1].seen), F.lit(top[-1].key)
        others = others | (F.col("seen") < seen) | ((F.col("seen") == seen) & (F.col("key") > key))
    rest = ruled.where(others & F.expr("bad OR outside > inside")).select("key", "inside", "outside", "bad")  # any other weighs what an unknown one does
    if not rest.isEmpty():
        weights.rest = rest
    return weights


class Extractor:
    """Main text of single pages, given the learned weights; ``extract`` adds those of ``Weights.rest``."""

    def __init__(self, weights: dict[str, tuple[float, bool]]):
        self.weights = weights

    def level(self, name: str, attributes: str) -> int:
        """As ``hinted``; an element with a key that was learned as boilerplate is at least ``WHOLE``."""
        level = hinted(name, attributes)
        if level >= WHOLE or not attributes or name in ARTICLE or name in ("html", "body"):
            return level
        return WHOLE if any(self.weights.get(key, (0.0, False))[1] for key in keys_of(name, attributes)[1:]) else level

    def penalty(self, name: str) -> float:
        return self.weights.get(name, (TAG_COST, False))[0]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        events = list(scan(page))
        _, kept, marked = outline(events, self.level)
        walk = Walk(self.level, kept, marked)
        pieces: list[tuple[int, str, bool]] = []  # block, text, below boilerplate
        score, best, begin, span, block = 0.0, 0.0, 0, (0, 0), 0
        for kind, name, attributes in events:
            if kind != "text":
                if name not in INLINE:
                    block += 1
                elif name == "br":
                    pieces.append((block, " ", walk.bad > 0))
                walk.step(kind, name, attributes)
                gain = 0.0 if walk.bad else -self.penalty(name)
            else:
                text = entities.unescape(name)
                pieces.append((block, text, walk.bad > 0))
                gain = 0 if walk.bad else len(text.split()) * (-1 if marked and not walk.articles else 1)
            if score <= 0 and gain > 0:
                score, begin = 0.0, len(pieces) - 1
            score += gain
            if score > best:
                best, span = score, (begin, len(pieces))
        blocks: dict[int, list[str]] = {}
        for block, text, bad in pieces[span[0] : span[1]]:
            if not bad:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def _page_keys(sent):
    """(tid, kid, text): the keys of each page's elements that are not broadcast."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, str]] = []

        def settle() -> pa.RecordBatch:
            tids, found = zip(*out) if out else ((), ())
            out.clear()
            return arrow_rows({"tid": (tids, pa.int64()), "kid": ([text_key(k) for k in found], pa.int64()), "text": (found, pa.string())})

        for batch in batches:
            for page in batch.column(0).to_pylist():
                tid = text_key(page)
                out += [(tid, k) for k in {k for kind, name, attributes in scan(page or "") if kind == "open" for k in keys_of(name, attributes)} if k not in sent.value]
                if len(out) > COUNTED:
                    yield settle()
        yield settle()

    return work


def _texts(sent):
    """(id, url, text, n_chars) of pages; a column ``more`` has weights besides those broadcast."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Extractor(sent.value)
        for batch in batches:
            ids, urls, pages = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "url", "text"))
            at = batch.schema.get_field_index("more")
            more = batch.column(at).to_pylist() if at >= 0 else [None] * len(batch)
            texts = []
            for page, found in zip(pages.to_pylist(), more):
                extra = {r["key"]: _weight(r["inside"], r["outside"], r["bad"]) for r in found or []}
                texts.append((Extractor(ChainMap(extra, sent.value)) if extra else own).text(page))
            yield arrow_rows({"id": (ids, None), "url": (urls, None), "text": (texts, pa.string()), "n_chars": ([len(t) for t in texts], pa.int64())})

    return work


def _by_all(narrow: DataFrame, sent, rest: DataFrame, schema: str) -> DataFrame:
    """Texts by the broadcast weights and those of ``rest``; pages without a key of ``rest`` are not shuffled."""
    named = per_partition(rest.withColumnRenamed("key", "text"), add_key, "tid long, text string, inside long, outside long, bad boolean").withColumnRenamed("tid", "kid")
    named = durable(named, "other-keys")
    keys = passing(narrow.select("text"), "kid", bit_filter(named, "kid"), before=(_page_keys(sent),), schema="tid long, kid long, text string").distinct()
    weight = F.struct(F.col("text").alias("key"), "inside", "outside", "bad")
    found = durable(keys.join(named, ["kid", "text"]).groupBy("tid").agg(F.collect_list(weight).alias("more")), "page-weights")
    bits = bit_filter(found, "tid")
    hit = passing(narrow, "tid", bits, before=(add_key,), schema="tid long, " + ddl(narrow)).join(found, "tid", "left")
    clean = passing(narrow, "tid", ~bits, before=(add_key,), after=(_texts(sent),), schema=schema)
    return per_partition(hit.select("id", "url", "text", "more"), _texts(sent), schema).union(clean)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page; weights are learned from the pages unless given."""
    weights = learn(pages, html_col) if weights is None else weights
    sent, rest = pages.sparkSession.sparkContext.broadcast(dict(weights)), getattr(weights, "rest", None)
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"))
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("id", "url")]
    schema = f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    done = per_partition(narrow, _texts(sent), schema) if rest is None else _by_all(narrow, sent, rest, schema)
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
