"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores 2 p - 1, where p is the chance that it is content by its
features: the innermost block element, whether in a link, the elements around it and their class and id names and
the parts of these names. Features weigh by the log-odds of the words that have them inside and outside of the content of labelled
pages; tags score below 0 by the share of their kind outside. Pages that mark their content themselves (article or main
elements) are the labelled ones; all of them are counted. A linear scan finds the best contiguous region, and all words of the
region are the text.

Left out before the scan is what HTML defines as no content (FURNITURE, hidden elements, landmark roles), and elements
with a class or id that labelled pages have outside of their content alone. Names that no labelled page has weigh by a
prior (OUTSIDE_NAMES, INSIDE_NAMES), a count like any other that more evidence outweighs.

Null html is an empty page. Character references are decoded; white space inside a block is one
space; blocks are joined by one space. Broken markup (unclosed tags, comments or quotes) is read as
far as it goes. Repeated rows give repeated results. Other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import rows_of, slices, table

#: Features that a model holds: the most frequent ones, some megabytes.
MOST_FEATURES = 50_000
#: Features that one task counts before it hands them on.
FEATURES_AT_ONCE = 100_000
#: Words outside that a name needs, with a hundredth of them at most inside, to be left out before the scan.
LEAST_OUTSIDE = 50

def _pattern(attrs: str) -> re.Pattern:
    return re.compile(
        r"<!--(?:.*?-->|.*\Z)"
        r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select|option|button|object)\b(?>[^>]*)>"
        rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{attrs})>"
        r"|<[!?/][^>]*>?"
        r"|<[a-zA-Z/][^<>]*>?"
        r"|[^<]+|<",
        re.DOTALL | re.IGNORECASE,
    )


_PIECE = _pattern(r"(?>\"[^\"]*\"|'[^']*'|[^'\">])*+")
#: Where a quote is open to the end of the page, quotes mean nothing.
_LOOSE = _pattern(r"[^>]*+")
#: Behind the last ">" of a page no tag ends.
_REST = re.compile(r"(?P<raw>(?!))?(?P<name>(?!))?(?:<[!?/a-zA-Z][^<]*|[^<]+|<)")
#: Elements whose text runs to the end of the page where no end tag follows.
RUN_ON = frozenset("script style textarea iframe".split())
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
FURNITURE = frozenset("nav footer aside form menu dialog head fieldset label".split())
BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Landmark and widget roles of no content by the ARIA standard.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of names that a prior counts outside of content ...
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus replies reply respond newsletter subscribe signup login breadcrumb breadcrumbs pagination pager navbar "
    "nav navigation menu menus toolbar footer header masthead banner sidebar aside widget widgets promo promotion notice notices alert popup modal overlay search share sharing social related recommended recommendations copyright legal disclaimer".split()
)
#: ... and inside.
INSIDE_NAMES = frozenset("content article main post body story entry text".split())
#: Words that the prior counts.
PRIOR = 100
#: Most that a tag, and that all names of an element, add to the log-odds; what a word without any evidence has.
MOST_TAG, MOST_NAME, BIAS = 2.0, 4.0, 0.5


def attributes(attrs: str) -> dict[str, str]:
    """By lower-cased name; the first of equal names counts."""
    out: dict[str, str] = {}
    for key, *values in _ATTR.findall(attrs):
        out.setdefault(key.lower(), next((v for v in values if v), ""))
    return out


def is_furniture(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """By HTML's own marks alone."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return hidden or attrs.get("role", "").strip().lower() in ROLES


def names_of(attrs: dict[str, str]) -> tuple[str, ...]:
    """Features of an element's class and id names: each whole, its last part, and with half their weight the parts before."""
    out: set[str] = set()
    for name in (n for key in ("class", "id") for n in attrs.get(key, "").split()):
        parts = [p.lower() for p in _PART.findall(name)]
        out.update([f"is:{name.lower()}", *(f"half:{p}" for p in parts[:-1]), *(f"part:{p}" for p in parts[-1:])])
    return tuple(sorted(out))


#: A context: features of tags, and one tuple of name features for each element around that has names.
Context = tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]


def pieces(source: str) -> Iterator[re.Match]:
    """Texts, comments, tags and elements without text of their own, from left to right.

    An element of the last kind ends with its next end tag; where none follows it is its tag alone (of RUN_ON: all the rest). The next
    end tag of each kind is sought once and kept until it is passed, so a page takes time in proportion to its length.
    """
    pattern, last, at = _PIECE, source.rfind(">"), 0
    ends: dict[str, re.Match | None] = {}
    while at < len(source):
        piece = (pattern if at <= last else _REST).match(source, at)
        if pattern is _PIECE and at <= last and piece["name"] is None and piece["raw"] is None and re.match("</?[a-zA-Z]", piece[0]):
            pattern = _LOOSE  # this tag's quotes have no end
            continue
        yield piece
        at = piece.end()
        if raw := (piece["raw"] or "").lower():
            if raw not in ends or ends[raw] and ends[raw].start() < at:
                ends[raw] = re.compile(rf"</{raw}\s*>", re.IGNORECASE).search(source, at)
            if ends[raw]:
                at = ends[raw].end()
            elif raw in RUN_ON:
                return


class Page:
    """Parallel lists, one entry a piece of text or a tag: context (None: a tag, whose name is in text), words, furniture, marked (in article or main), text, block."""

    def __init__(self, source: str):
        self.context: list[Context | None] = []
        self.words: list[int] = []
        self.furniture: list[bool] = []
        self.marked: list[bool] = []
        self.text: list[str] = []
        self.block: list[int] = []
        self.has_mark = False
        self._read(source)

    def _add(self, context: Context | None, words: int, furniture: bool, marked: bool, text: str, block: int) -> None:
        self.context.append(context)
        self.words.append(words)
        self.furniture.append(furniture)
        self.marked.append(marked)
        self.text.append(text)
        self.block.append(block)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, tuple[str, ...]]] = []  # name, furniture, name features
        blocks: list[tuple[str, tuple[str, ...]]] = []  # of the stack, those that are not inline
        named: list[tuple[str, ...]] = []  # of the stack, those with names but html and body
        open_: Counter[str] = Counter()
        furniture = marks = block = 0
        here: Context | None = None  # of the open elements, made where it is needed

        def context() -> Context:
            inner = blocks[-1] if blocks else ("body", ())
            tags = {f"in:{n}" for n, k in open_.items() if k and n not in INLINE and n not in ("html", "body", "div", "p")}
            if not inner[1] or inner[0] not in ("div", "section"):  # a container with names is known by them
                tags.add(f"at:{inner[0]}")
            if open_["a"]:
                tags.add("link")
            return tuple(sorted(tags)), tuple(named)

        def pop() -> None:
            nonlocal furniture, marks, here
            name, odd, names = stack.pop()
            if name not in INLINE:
                blocks.pop()
            if names and name not in ("html", "body"):
                named.pop()
            open_[name] -= 1
            furniture -= odd
            marks -= name in ("article", "main")
            here = None

        for piece in pieces(source):
            name = piece["name"]
            if name is None:
                text = piece[0]
                if piece["raw"]:
                    block += piece["raw"].lower() not in INLINE
                    continue
                if text[0] == "<" and len(text) > 1:
                    continue
                if text := html.unescape(text):
                    here = here or context()
                    self._add(here, len(text.split()), furniture > 0, marks > 0, text, block)
                continue
            name = name.lower()
            self._add(None, 0, furniture > 0, marks > 0, f"{piece['close']}{name}", block)
            if name not in INLINE:
                block += 1
            if piece["close"]:
                if open_[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in VOID:
                continue
            if name in BLOCK_ENDS_P and open_["p"]:
                while open_["p"]:
                    pop()
            elif name in SIBLINGS and stack and stack[-1][0] in SIBLINGS[name]:
                pop()
            attrs = attributes(piece["attrs"]) if piece["attrs"] else {}
            odd = is_furniture(name, attrs, marks > 0)
            names = names_of(attrs) if attrs else ()
            stack.append((name, odd, names))
            if name not in INLINE:
                blocks.append((name, names))
            if names and name not in ("html", "body"):
                named.append(names)
            open_[name] += 1
            furniture += odd
            here = None
            if name in ("article", "main"):
                marks += 1
                self.has_mark |= not odd


def counts_of(page: Page) -> Iterator[tuple[str, int, bool]]:
    """(feature, words or tags, inside) of a labelled page; what HTML defines as furniture teaches nothing."""
    for context, words, odd, marked, text in zip(page.context, page.words, page.furniture, page.marked, page.text):
        if context is None:
            yield f"<{text}>", 1, marked and not odd
        elif words and not odd:
            tags, names = context
            for feature in {*tags, *(f.replace("half:", "part:") for n in names for f in n)}:
                yield feature, words, marked


class Weights:
    """What labelled pages say of each feature: (inside, outside) counts."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.known: dict[Context, tuple[float, bool]] = {}

    def _odds(self, feature: str, most: float) -> float:
        kind, _, name = feature.partition(":")
        inside, outside = self.counts.get(f"part:{name}" if kind == "half" else feature, (0, 0))
        if kind in ("part", "half"):
            inside, outside = inside + PRIOR * (name in INSIDE_NAMES), outside + PRIOR * (name in OUTSIDE_NAMES)
        return max(-most, min(most, log((inside + 2) / (outside + 2)))) * (0.5 if kind == "half" else 1)

    def _names(self, names: tuple[str, ...]) -> float:
        """What an element's names add: where some speak against content, these alone."""
        odds = [self._odds(f, MOST_NAME) for f in names]
        return max(-MOST_NAME, min(MOST_NAME, sum(x for x in odds if x < 0) or sum(odds)))

    def _never_content(self, feature: str) -> bool:
        inside, outside = self.counts.get(feature, (0, 0))
        return feature.startswith("is:") and outside >= LEAST_OUTSIDE and 100 * inside <= outside

    def of(self, context: Context) -> tuple[float, bool]:
        """The score of a word there, and whether it is left out."""
        if (found := self.known.get(context)) is None:
            tags, names = context
            odds = BIAS + sum(self._odds(f, MOST_TAG) for f in tags)
            odds += sum(map(self._names, names))
            found = 2 / (1 + exp(-odds)) - 1, any(self._never_content(f) for n in names for f in n)
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[context] = found
        return found

    def tag(self, name: str) -> float:
        inside, outside = self.counts.get(f"<{name}>", (0, 0))
        return min(0.15 * ((inside + 1.6) / (inside + outside + 2) - 1), -0.02)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the maximum-scoring subsequence; the first and shortest of equal ones; empty if none is above 0."""
    best = total = 0.0
    begin = end = start = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def main_text(source: str, weights: Weights) -> str:
    page = Page(source)
    scores, left_out = [], []
    for context, words, odd, text in zip(page.context, page.words, page.furniture, page.text):
        score, never = weights.of(context) if context else (0.0, False)
        odd = odd or never
        left_out.append(odd)
        if odd:  # not in the text in any case: a small price for reaching across it
            scores.append(-0.05 * min(words, 10) if words else -0.02)
        else:
            scores.append(score * words if context else weights.tag(text))
    begin, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for i in range(begin, end):
        if page.context[i] and not left_out[i]:
            blocks.setdefault(page.block[i], []).append(page.text[i])
    return " ".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


def learn_weights(pages: DataFrame, most: int = MOST_FEATURES) -> Weights:
    """Counts of all labelled pages; of the features the ``most`` frequent ones are kept, ties by name."""
    schema = pa.schema([("feature", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for _, sources in slices(batches, text="html"):
            for page in map(Page, sources):
                for feature, n, inside in counts_of(page) if page.has_mark else ():
                    seen.setdefault(feature, [0, 0])[not inside] += n
            if len(seen) > FEATURES_AT_ONCE:
                yield rows_of(schema, feature=list(seen), inside=[v[0] for v in seen.values()], outside=[v[1] for v in seen.values()])
                seen = {}
        yield rows_of(schema, feature=list(seen), inside=[v[0] for v in seen.values()], outside=[v[1] for v in seen.values()])

    counts = pages.select("html").mapInArrow(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    total = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(most).collect()
    return Weights({r.feature: (r.inside, r.outside) for r in total})


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text of every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sources in slices(batches, text="html"):
            yield rows_of(schema, page_id=piece.column("page_id"), url=piece.column("url"), text=[main_text(s, weights) for s in sources])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages)).withColumn("n_chars", F.length("text").cast("long"))
