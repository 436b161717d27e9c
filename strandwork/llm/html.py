"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, by weights that are learned from
labelled pages: a tag's weight comes from its name, a word's from where it stands (inside a link, in an element of a
boilerplate kind, in a short block). One linear scan finds the contiguous region of highest total score. Inside the
region, blocks whose words score below zero (adverts, menus, forms, comments) are left out, and the words of each block
are joined.

The weights are fitted twice. The first fit tells which kinds of element speak against main text; in the second, standing
in any of these is a feature of its own, so that an advert inside an article is an advert. A page is taken to have main
text: where no word outside such elements scores above zero, all these words are raised until the best one does.

Null, empty and text-free pages give an empty text. Rows are judged each on its own, repeated ones too. A tag whose
quote is never closed ends at its next >. Other columns are kept whatever their names, but for one named like the output.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandwork.llm.learning import logistic
from strandwork.llm.shared import as_bytes, steps

#: Elements whose text is never shown, elements that interrupt a line, elements without an end.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea button audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and name parts (of class, id and role) that speak for or against main text; their weights are learned.
KINDS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "article", "main", "h1", "h2")
HINTS = (
    "nav", "menu", "header", "footer", "sidebar", "side", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "consent", "notice",
    "comment", "comments", "reply", "respond", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "popup", "modal", "widget",
    "login", "signup", "search", "tags", "pagination", "pager", "copyright", "legal", "toolbar", "content", "article", "post", "entry", "story", "main", "body", "text", "alert",
    "skip", "tracking", "promoted", "outbrain", "disclaimer", "discussion", "replies", "navbar", "topbar", "masthead", "complementary", "contentinfo", "navigation",
)
FEATURES = ["length", "link", "against", *[f"k:{k}" for k in KINDS], *[f"h:{h}" for h in HINTS]]
INDEX = {name: k for k, name in enumerate(FEATURES)}

#: One attribute; a tag with its attributes, or else up to the next >; and every token of a page.
ATTRIBUTE = r"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?"
TAG = rf"</?[a-zA-Z][^\s/>]*+(?:(?:[\s/]++|{ATTRIBUTE}|=)*+>|[^>]*+(?:>|$))"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?|{TAG}|[^<]++|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")
#: How much tags weigh beside words.
TAG_SCALE = 0.12
SEEN_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@lru_cache(1 << 14)
def marks(tag: str) -> frozenset[int]:
    """Features of an element that its start tag gives to all words in it."""
    name = NAME.match(tag).group(1).lower()
    out = {INDEX[f"k:{name}"]} if name in KINDS else set()
    for found in MARK.findall(tag[len(name) + 1 :]):
        for part in PART.findall(" ".join(found).lower()):
            if f"h:{part}" in INDEX:
                out.add(INDEX[f"h:{part}"])
    return frozenset(out)


LINK = frozenset({INDEX["link"]})
#: A kind of element whose weight is below this speaks against main text, but for kinds that occur inside it too.
AGAINST = -0.6
UNDECIDED = frozenset({INDEX["link"], INDEX["length"], INDEX["against"], INDEX["k:header"], INDEX["h:header"]})
#: What the best word of a page scores at least.
LEAST = 0.05


#: Elements that an end tag of another kind does not close, and those that the start of a block closes.
HOLDS = frozenset({"html", "body", "article", "main", "table"})
INLINE = frozenset({"p", "b", "i", "em", "strong", "u", "small"})
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}


class Piece:
    """A stretch of text inside one line, or a tag (text is None)."""

    __slots__ = ("text", "block", "features", "opens")

    def __init__(self, text, block, features, opens):
        self.text, self.block, self.features, self.opens = text, block, features, opens


def pieces(page: str) -> list[Piece]:
    """The page's texts and tags in order, each text with its block and the features of the elements around it."""
    out: list[Piece] = []
    # open elements: name, the features of all elements up to it, whether one of them is hidden
    stack: list[tuple[str, tuple[frozenset[int], ...], bool]] = []
    block, around, hidden = 0, (), False
    # how many elements of a name are open: of HOLDS, and of others above each of these, so that a stray end tag costs one look-up
    held, above = Counter(), [Counter()]
    at, n = 0, len(page)

    def drop() -> None:
        last = stack.pop()[0]
        if last in HOLDS:
            above.pop()
            held[last] -= 1
        else:
            above[-1][last] -= 1

    match, name_of = TOKEN.match, NAME.match
    while at < n:
        m = match(page, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            if not hidden:
                out.append(Piece(token, block, around, None))
            continue
        named = name_of(token)
        if not named:
            if token.startswith("<![CDATA[") and not hidden:
                out.append(Piece(token[9:].removesuffix("]]>"), block, around, None))
            continue
        name = named.group(1).lower()
        closing = token[1] == "/"
        if name in BLOCKS:
            block += 1
        if not hidden:
            out.append(Piece(None, block, (), name))
        if closing:
            if held[name] if name in HOLDS else above[-1][name]:  # a stray end tag does not close what is around it
                while stack[-1][0] != name:
                    drop()
                drop()
        elif name not in VOID and not token.endswith("/>"):
            if name in RAW:
                end = RAW[name].search(page, at)
                at = end.end() if end else (n if name in ("script", "style") else at)
                continue
            if name in BLOCKS:
                while stack and stack[-1][0] in INLINE:
                    drop()
                if stack and stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    drop()
            around, hidden = stack[-1][1:] if stack else ((), False)
            own = marks(token) | LINK if name == "a" else marks(token)
            if own and own not in around:
                around = (*around, own)
            stack.append((name, around, hidden or name in HIDDEN or bool(SEEN_HIDDEN.search(token))))
            if name in HOLDS:
                above.append(Counter())
                held[name] += 1
            else:
                above[-1][name] += 1
        else:
            continue
        around, hidden = stack[-1][1:] if stack else ((), False)
    return out


def block_words(found: list[Piece]) -> dict[int, int]:
    """How many words each block has."""
    out: dict[int, int] = {}
    for p in found:
        if p.text is not None:
            out[p.block] = out.get(p.block, 0) + len(p.text.split())
    return out


def length_feature(words: int) -> float:
    return min(1.0, np.log1p(words) / 4)


class Model:
    """Weights of words by their features, and of tags by name."""

    def __init__(self, examples: list[str]):
        """examples: pages whose main text stands between <!--main--> and <!--/main-->, in one or more stretches."""
        rows, target, weight, tag_seen = [], [], [], {}
        for page in examples:
            for inside, p, words in marked(page):
                if p.text is None:
                    tag_seen.setdefault(p.opens, [0, 0])[inside] += 1
                    continue
                x = np.zeros(len(FEATURES))
                x[list(set().union(*p.features))] = 1
                x[INDEX["length"]] = length_feature(words)
                rows.append(x)
                target.append(inside)
                weight.append(np.sqrt(len(p.text.split())))
        x, target, weight = np.array(rows), np.array(target), np.array(weight)
        first = logistic(x, target, weight, ridge=3e-3)
        self.against = frozenset(k for k, w in enumerate(first[:-1].tolist()) if w < AGAINST and k not in UNDECIDED)
        x[:, INDEX["against"]] = x[:, sorted(self.against)].max(axis=1)
        fitted = logistic(x, target, weight, ridge=3e-3)
        self.word, self.base = fitted[:-1], fitted[-1]
        self.known: dict[tuple, tuple[float, bool]] = {}
        # a tag's weight: log odds that it stands in main text, made negative throughout
        odds = {t: np.log((s[1] + 1) / (s[0] + 1)) for t, s in tag_seen.items()}
        top = max(odds.values())
        self.tag = {t: -TAG_SCALE * float(np.clip(top - v, 0.5, 3)) for t, v in odds.items()}
        self.other = -TAG_SCALE * 1.5

    def value(self, features: tuple[frozenset[int], ...], words: int) -> tuple[float, bool]:
        """Weight of a word with these features, in a block of so many words, and whether an element speaks against it."""
        known = self.known.get(features)
        if known is None:
            if len(self.known) > 100_000:
                self.known.clear()
            every = set().union(*features)
            against = bool(every & self.against)
            own = float(self.base + self.word[sorted(every)].sum() + against * self.word[INDEX["against"]])
            known = self.known[features] = (own, against)
        return max(-1.0, min(3.0, known[0] + float(self.word[INDEX["length"]]) * length_feature(words))), known[1]

    def extract(self, page: str) -> str:
        """The text of the page's best region."""
        found = pieces(page)
        size = block_words(found)
        score, best = [], None
        for p in found:
            if p.text is None:
                score.append((self.tag.get(p.opens, self.other), 1, True))
                continue
            n = len(p.text.split())
            own, against = self.value(p.features, size[p.block])
            score.append((own, n, against))
            if n and not against:
                best = own if best is None else max(best, own)
        lift = max(0.0, LEAST - best) if best is not None else 0.0
        total: dict[int, float] = {}
        score = [(own if against else own + lift) * n for own, n, against in score]
        for p, own in zip(found, score):
            if p.text is not None:
                total[p.block] = total.get(p.block, 0.0) + own
        first, last = best_region(score)
        blocks: dict[int, list[str]] = {p.block: [] for p in found[first:last] if p.text is not None and total[p.block] > 0}
        for p in found:
            if p.text is not None and p.block in blocks:  # a block that the region cuts is whole
                blocks[p.block].append(p.text)
        lines = [" ".join(unescape("".join(v)).split()) for v in blocks.values()]
        return "\n".join(line for line in lines if line)


def best_region(score: list[float]) -> tuple[int, int]:
    """Maximum-scoring contiguous run [first, last) by one scan; the first and longest of equals; empty if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(score):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or (total == best and best > 0 and start == at[0]):
            best, at = total, (start, k + 1)
    return at


def marked(page: str) -> Iterator[tuple[int, Piece, int]]:
    """(1 between the marks or else 0, piece, words of its block) of a labelled page."""
    inside, found = 0, pieces(page.replace("<!--main-->", "\x01").replace("<!--/main-->", "\x02"))
    size = block_words(found)
    for p in found:
        for part in re.split("([\x01\x02])", p.text) if p.text is not None else ():
            if part in ("\x01", "\x02"):
                inside = int(part == "\x01")
            elif part.strip():
                yield inside, Piece(part, p.block, p.features, None), size[p.block]
        if p.text is None:
            yield inside, p, 0


@cache
def default_model() -> Model:
    from strandwork.llm.labelled_pages import PAGES

    return Model(PAGES)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages' other columns and out_col, the page's main text, which takes the place of a column of that name."""
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0))
    plain = pages.select(row.alias("row"), as_bytes(html_col).alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(default_model())  # bounded: a weight for each feature and tag name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            texts = [model.value.extract(p.decode("utf-8", "replace")) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    schema = StructType([plain.schema["row"], StructField("text", StringType())])
    return plain.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("text").alias(out_col))
