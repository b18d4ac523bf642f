"""Main text of web pages: the maximum-scoring run of tokens.

A page is read as words and tags.  Tags score negative, words positive, but for words in a
context (a menu, a notice, text beside the article and the like) that labelled pages have
outside their article.  A linear scan finds the contiguous run with the largest sum; it is
widened to the blocks that it touches, and its words are the text.  Where a page marks one article
the scan alone says what lies outside; elsewhere the run may reach over furniture.  Furniture
inside an article, or between the blocks of such a run, is left out.

The weights are log-odds from labelled pages: of a bounded number of pages that mark their
article by an element, what lies in it and what doesn't.  Contexts and tags that these pages
don't have start from prior counts.  On pages that mark no article, words score by the shape of
their block too (its length, and whether most of its words are links), so that a menu which no name
marks scores below zero.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    # quotes count only behind "="
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*)(?:>|\Z)",
    re.S,
)
#: Attributes in turn, each with its whole name and value, so that none is found inside another.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas noframes xmp".split())
#: Of these, elements that end with the page where their end tag is missing, and those that "/>" closes.
TO_THE_END, FOREIGN = frozenset("script style textarea title".split()), frozenset(["svg"])
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are furniture, and words in the names of a class, an id or a role (fixed values).
FURNITURE = frozenset("nav header footer aside form menu dialog button select head search".split())
#: These mark an element when one of its names is such a word, or begins or ends with it ("post-comments").
MARKS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "menu modal nav navbar navigation newsletter popup replies responses sidebar sponsor sponsored widget".split()
)
#: These are names of parts of articles too: they mark a container beside an article so, and one within it only if it has no other name.
WEAK_MARKS = frozenset("alert banner complementary footer header masthead notice promo related search share sharing social subscribe toolbar".split())
#: Elements of text.  Words in them are seldom furniture, so only a whole name of ``MARKS`` counts.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre span a em strong b i".split())
#: An article that has less than this part of a page's plain words isn't what the page is about.
LEAST_SHARE = 1 / 3
PARTS = re.compile(r"[^-_]+")
#: Prior counts of words: (inside, outside) for plain words, words beside an article, and furniture.
PRIOR = {"plain": (50.0, 5.0), "beside": (1.0, 10.0), None: (1.0, 20.0)}
#: Bounds of the weights of words and of tags.
MOST, LEAST_TAG, MOST_TAG = 2.0, -1.0, -0.05
#: Bounds of what the shape of a block adds to the weight of its words: of links, and of other text, which no shape turns negative.
LINK_SHAPE, TEXT_SHAPE = (-3.0, 0.0), (-1.0, 1.0)
SHORT, MIDDLE = 3, 15
#: The most labelled pages and characters of a page that weights are learned from.
SAMPLE_PAGES, SAMPLE_CHARS = 500, 200_000

WORD, TAG, SHAPE = "word", "tag", "shape"
PLAIN, BESIDE = "plain", "beside"


def furniture(name: str, found: dict[str, str], in_article: bool) -> str | None:
    """The kind of furniture that an element is, or None."""
    if name in FURNITURE and not (name == "header" and in_article):
        return name
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return "hidden"
    if name in ("body", "html", "main"):
        return None
    for key in ("class", "id", "role"):
        names = found.get(key, "").lower().split()
        ends = [m[-1] for m in map(PARTS.findall, names) if m] + [m[0] for m in map(PARTS.findall, names) if m]
        strong = [w for w in (names if name in TEXT else ends) if w in MARKS]
        if strong:
            return strong[0]
        weak = [w for w in (names if in_article else ends) if w in WEAK_MARKS]
        if weak and name not in TEXT and name != "article" and (not in_article or len(weak) == len(names)):
            return weak[0]
    return None


class Page:
    """Tokens of a page: (kind, name of the tag or context of the words, text, article number, block number)."""

    __slots__ = ("articles", "links", "tokens", "words")

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str, int, int]] = []
        self.articles = 0
        self.words, self.links = Counter(), Counter()  # by block: its words, and those in links
        stack: list[tuple[str, str | None, int]] = []  # name, furniture, article
        pos, block, n = 0, 0, len(source)
        context, article = None, 0
        endless: set[str] = set()  # names without an end tag in what is left
        add = self.tokens.append
        while pos < n:
            m = TOKEN.search(source, pos)
            upto = m.start() if m else n
            if upto > pos:
                text = htmllib.unescape(source[pos:upto])
                add((WORD, context or PLAIN, text, article, block))
                self.words[block] += len(text.split())
                if any(s[0] == "a" for s in stack):
                    self.links[block] += len(text.split())
            if not m:
                break
            pos = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["close"]:
                if name in BLOCK:
                    block += 1
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        context, article = stack[-1][1:] if stack else (None, 0)
                        break
                    if stack[i][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                        break  # a stray end tag closes nothing outside its article
                add((TAG, name, "", article, block))
                continue
            if name in RAW:
                add((TAG, name, "", article, block))
                if name in FOREIGN and m["rest"].rstrip().endswith("/"):
                    continue
                end = None if name in endless else re.compile(f"</{name}\\b[^>]*>", re.I).search(source, pos)
                if end:
                    pos = end.end()
                elif name in TO_THE_END:
                    pos = n
                else:  # only the tag is skipped
                    endless.add(name)
                continue
            if name in BLOCK:
                block += 1
            if name == "br":
                add((WORD, context or PLAIN, " ", article, block))
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # their end tags may be left out
                context, article = stack[-1][1:] if stack else (None, 0)
            found: dict[str, str] = {}
            if m["rest"]:
                for a in ATTRIBUTE.findall(m["rest"]):
                    found.setdefault(a[0].lower(), a[1] or a[2] or a[3])  # of equal names the first holds
            if name == "div" and found.get("role") == "main":
                name = "main"
            own, inner = context or furniture(name, found, article > 0), article
            if name in ("article", "main") and not own and not article:
                self.articles += 1
                inner = self.articles
            if name not in VOID and not m["rest"].rstrip().endswith("/"):
                stack.append((m["name"].lower(), own, inner))
                context, article = own, inner
            add((TAG, name, "", inner, block))
        plain = [(len(t.split()), a) for k, c, t, a, _ in self.tokens if k == WORD and c == PLAIN]
        if sum(n for n, a in plain if a) < LEAST_SHARE * sum(n for n, _ in plain):
            self.articles = 0
            self.tokens = [(k, c, t, 0, b) for k, c, t, _, b in self.tokens]
        if self.articles:  # plain words beside the articles are a context of their own
            self.tokens = [(k, BESIDE, t, a, b) if k == WORD and c == PLAIN and not a else (k, c, t, a, b) for k, c, t, a, b in self.tokens]

    def shape(self, block: int) -> str:
        """Whether most words of a block are links, and how many words it has."""
        n = self.words[block]
        return f"{'links' if 2 * self.links[block] > n else 'text'} {'short' if n <= SHORT else 'middle' if n <= MIDDLE else 'long'}"


def _count(source: str) -> tuple[Counter, Counter] | None:
    """(tokens inside the marked article, tokens outside) of a labelled page."""
    page = Page(source)
    if page.articles != 1:
        return None
    inside, outside = Counter(), Counter()
    for kind, name, text, article, block in page.tokens:
        side, n = inside if article else outside, 1 if kind == TAG else len(text.split())
        side[kind, name] += n
        if kind == WORD:
            side[SHAPE, page.shape(block)] += n
    return inside, outside


def learn(sources: Iterator[str]) -> dict[tuple[str, str], float]:
    """Weights of words by context, of shapes of blocks and of tags: log-odds of lying in the article, within bounds."""
    inside, outside = Counter(), Counter()
    for s in sources:
        if s and (c := _count(s)):
            inside += c[0]
            outside += c[1]
    weights = {}
    for kind, name in {*inside, *outside, *((WORD, w) for w in (PLAIN, BESIDE, "hidden", *FURNITURE, *MARKS, *WEAK_MARKS))}:
        a, b = PRIOR.get(name, PRIOR[None]) if kind == WORD else (5.0, 5.0)
        odds = math.log(inside[kind, name] + a) - math.log(outside[kind, name] + b)
        least, most = {WORD: (-MOST, MOST), TAG: (LEAST_TAG, MOST_TAG), SHAPE: LINK_SHAPE if name.startswith("links") else TEXT_SHAPE}[kind]
        weights[kind, name] = min(most, max(least, odds))
    return weights


def scores(page: Page, weights: dict[tuple[str, str], float], shapes: bool = True) -> list[float]:
    """The score of each token; that of a text is the sum of its words', with ``shapes`` by the shape of its block where no article is marked.

    Inside an article tags, and words of furniture, have the least penalty, so that a list or
    a notice there doesn't end the run.
    """
    out = []
    for kind, name, text, article, block in page.tokens:
        if kind == TAG:
            out.append(MOST_TAG if article else weights.get((TAG, name), -0.3))
        else:
            w = weights.get((WORD, name), -1.0)
            if shapes and not page.articles:
                w += weights.get((SHAPE, page.shape(block)), 0.0)
            out.append(len(text.split()) * (MOST_TAG if article and w < 0 else w))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, in one pass; (0, 0) if none is above 0."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += v
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(source: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The main text of a page; blocks are joined by an empty line."""
    if not source:
        return ""
    page = Page(source)
    for shapes in (True, False):  # a page of nothing but links has these as its text
        lo, hi = best_run(scores(page, weights, shapes))
        blocks = [t[4] for t in page.tokens[lo:hi] if t[0] == WORD and t[2].strip()]
        if blocks:
            break
    else:
        return ""
    first, last = min(blocks), max(blocks)
    out: list[list[str]] = []
    at = None
    for kind, context, text, article, block in page.tokens:
        outside = page.articles == 1 and not article  # left to the scan
        if kind == WORD and first <= block <= last and (outside or weights.get((WORD, context), -1.0) > 0):
            if block != at:
                out.append([])
                at = block
            out[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in out)
    return "\n\n".join(b for b in joined if b)


def train(pages: DataFrame, most_pages: int = SAMPLE_PAGES, most_chars: int = SAMPLE_CHARS) -> dict[tuple[str, str], float]:
    """Weights from at most ``most_pages`` pages, the first by a hash of their id, that mark an
    article and have at most ``most_chars`` characters."""
    some = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= most_chars))
    ids = some.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most_pages)
    texts = some.join(F.broadcast(ids), "page_id", "left_semi").select("html").limit(2 * most_pages)  # bounded by ids
    return learn(r["html"] for r in texts.toLocalIterator())


def _extract(weights: dict[tuple[str, str], float]) -> Callable:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [extract(x.as_py(), weights) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null and empty pages, and pages without a word outside furniture, have an empty text.
    Null ids and urls stay; equal pages have equal texts; other columns are not read.  Pages
    of any length are read whole.
    """
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    t = dict(src.dtypes)
    return map_batches(src, _extract(weights), f"page_id {t['page_id']}, url {t['url']}, text string, n_chars long")
