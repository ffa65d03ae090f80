"""HTML extraction: the best contiguous region under scores of words and tags, then its readable blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.base import ship, slices

#: Elements whose content is never text.
SILENT = "script|style|noscript|template|iframe|object|svg|math|canvas|video|audio|select|textarea|button|title"
#: What a head may hold; any other opening tag ends it, as its closing tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Elements that hold something beside the article.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
#: A class, id or role made of these words says the same of any element, and may have the plain words behind as company.
_BESIDE_WORD = (r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|cookies?|consent|disqus|footer|masthead|menu|nav|navbar|navigation|"
                r"newsletter|notices?|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|teasers?|"
                r"toolbar|widget|(?:site|page|top|global)[_-]?header)")
_PLAIN = r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|box|block|area|list|bar|container|wrap|wrapper|inner|section|links?|items?|posts?|form|\d+)"
_BESIDE = re.compile(rf"(?:(?:{_PLAIN}[_-]+)*{_BESIDE_WORD}(?:[_-]+(?:{_BESIDE_WORD}|{_PLAIN}))*|header|form)", re.I)
#: Elements that run on inside a line; every other tag parts two blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|<(?!(?:script|style|title|textarea)\b)(?:{SILENT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<({SILENT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(frozen=True)
class Weights:
    """What a word adds, and what each tag takes; ``tags`` are learned, others cost ``other``."""

    word: float = 1.0
    other: float = -1.5
    tags: dict[str, float] = field(default_factory=dict)


def _says_beside(attributes: str) -> tuple[bool, bool]:
    """``(beside, hidden)``: what an element's class, id or role, and its hidden, aria-hidden or style say."""
    beside = hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            beside = beside or any(map(_BESIDE.fullmatch, value.split()))
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none", value, re.I))
    return beside, hidden


def _holders(matches: list[re.Match]) -> set[int]:
    """Places of opening tags whose element holds a ``<main>`` or all ``<article>`` of the page, or without such marks
    most of its words: none of these stands beside the article."""
    stack: list[tuple[str, int, int, int, int]] = []
    ended, mains, articles, words = [], 0, 0, 0
    open_names: Counter = Counter()
    for i, match in enumerate(matches):
        slash, name, attributes = match[2], match[3], match[4]
        if not name:
            words += len(match[0].split()) if match[0][0] != "<" else 0
            continue
        name = name.lower()
        if slash:
            while open_names[name]:
                last = stack.pop()
                open_names[last[0]] -= 1
                ended.append((last[1], mains - last[2], articles - last[3], words - last[4]))
                if last[0] == name:
                    break
            continue
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, i, mains, articles, words))
            open_names[name] += 1
        mains += name == "main"
        articles += name == "article"
    ended += [(i, mains - m, articles - a, words - w) for _, i, m, a, w in stack]
    if mains or articles:
        return {i for i, m, a, _ in ended if m or articles and a == articles}
    return {i for i, _, _, w in ended if 2 * w > words}


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """``(kind, value, beside)``: kind is ``text``, ``open``, ``close`` or ``other``; ``beside`` says whether the place
    lies in an element beside the article (by name, class, id or role), in the head, or is hidden. What holds the article
    is not beside it by class, id or role, nor if it is a form. Unclosed elements end with the nearest enclosing one
    that is closed."""
    stack: list[tuple[str, bool]] = []
    matches = list(_TOKEN.finditer(page))
    holders = _holders(matches)
    for i, match in enumerate(matches):
        silent, slash, name, attributes = match[1], match[2], match[3], match[4]
        if name and not slash and name.lower() not in IN_HEAD and stack and stack[-1][0] == "head":
            stack.pop()
        beside = bool(stack) and stack[-1][1]
        if name:
            name = name.lower()
            if slash:
                if any(name == n for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
                yield "close", name, beside
                continue
            if attributes:
                says, hidden = _says_beside(attributes)
                beside = beside or hidden or says and name not in ("html", "body") and i not in holders
            beside = beside or name == "head" or name in ASIDE and not _in_article(stack, name) and not (name == "form" and i in holders)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                stack.append((name, beside))
            yield "open", name, beside
        elif match[0][0] == "<" and len(match[0]) > 1:
            yield "other", (silent or "").lower(), beside
        else:
            yield "text", match[0], beside


def _in_article(stack: list[tuple[str, bool]], name: str) -> bool:
    """An article's own header is part of it; a header elsewhere is the site's."""
    return name == "header" and any(n in ("article", "main") for n, _ in stack)


def learn(pages: list[str]) -> Weights:
    """Tag weights from labelled pages: those that mark their content with ``<article>`` or ``<main>``.

    A tag costs the more, the more of its occurrences lie outside the content: from nothing (always inside)
    to eight words (always outside). Elements beside the article are known as such and don't count. Pages without
    the mark teach nothing.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        depth, own_in, own_out, marked = 0, Counter(), Counter(), False
        for kind, value, beside in tokens(page):
            if value in ("article", "main") and kind in ("open", "close"):
                marked = True
                depth += 1 if kind == "open" else -1
            elif kind == "open" and not beside:
                (own_in if depth > 0 else own_out)[value] += 1
        if marked:
            inside += own_in
            outside += own_out
    tags = {t: -8.0 * (outside[t] + 0.5) / (inside[t] + outside[t] + 1.0) for t in inside.keys() | outside.keys()}
    return Weights(tags=tags)


def main_text(page: str, weights: Weights) -> str:
    """The text of the region with the greatest score.

    Words add and opening tags take, inline ones a quarter. Elements beside the article neither add nor take: a region
    may stretch over them, and their text is left out. Inside a marked ``<article>`` or ``<main>`` tags cost nothing.
    One scan keeps the best run so far, the earlier of equal ones.
    """
    seen = list(tokens(page))
    marked = any(value in ("article", "main") and kind == "open" and not beside for kind, value, beside in seen)
    best, best_from, best_to, run, start, depth = 0.0, 0, 0, 0.0, 0, 0
    for i, (kind, value, beside) in enumerate(seen):
        gain = 0.0
        if beside:
            pass
        elif kind == "text":
            # Beside a marked article words speak against a region as loud as inside for it.
            gain = weights.word * len(value.split()) * (-1.0 if marked and not depth else 1.0)
        elif value in ("article", "main"):
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif kind == "open" and not depth:
            gain = weights.tags.get(value, weights.other) * (0.25 if value in INLINE or value in ("p", "br") else 1.0)
        if run <= 0:
            run, start = 0.0, i
        run += gain
        if run > best:
            best, best_from, best_to = run, start, i + 1
    blocks, parts = [], []
    for kind, value, beside in seen[best_from:best_to]:
        if kind == "text":
            if not beside:
                parts.append(value)
        elif value not in INLINE or kind == "other" and value:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    readable = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in readable if b)


def learned_weights(pages: DataFrame, max_pages: int = 400, max_bytes: int = 1 << 17) -> Weights:
    """Weights from at most ``max_pages`` labelled pages of at most ``max_bytes``, drawn by the hash of the address."""
    drawn = (
        pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.octet_length("html") <= max_bytes))
        .select("html", F.xxhash64("url", "html").alias("h")).orderBy("h").limit(max_pages))
    return learn([r.html for r in drawn.select("html").toLocalIterator()])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; null pages count as empty and give the empty text. No shuffle.

    Columns of these names are replaced.
    """
    ship(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    schema = pages.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, weights) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*part.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
