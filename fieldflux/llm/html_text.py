"""Main text of web pages by their line-block distribution.

A page is read from the left.  Markup is stripped and the text falls into lines, one for each
block element.  Lines in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments have the length 0 and no text; mostly linked lines outside an article
have the length 0, and so have lines that only link to a place on the page itself.  Over the
lengths slides a window of a few lines.  Where its sum rises above DENSE of the page's usual line
(or PROSE, if that is less), or an article begins, is a surge point, where it falls back, or the article ends, a dive point, and
the text between them is a stretch, its shortest lines included.  So short lines before or after
the text stay only as far as a window reaches, and short lines between two stretches stay where
nothing of length 0 stands between.  In an article nothing but 0 is too short.

An element that is left out for its name or tag, but holds most of the text of a page without an
article, is the frame of the page and is not left out: if it is named by class or id, or has long
lines and is a form or not ended.

The stretches of one article, and those outside of articles, belong together.  The main stretch is
the longest one, a character in an article counting ARTICLE times.  The other stretches stay if they
are in its article, or if their lines are long enough compared with its lines: DENSE of them where
both are outside of articles, ALIKE where they are not.  A mostly linked line beside a stretch that
stays is kept if it is as long as a line alike.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped

#: Lines in a window, what a character in an article counts, the share of the usual line that a window needs, or of the main
#: stretch's mean line that another's needs, and that share where one is in an article and the other is not.
LINES, ARTICLE, DENSE, ALIKE = 3, 4, 0.25, 0.6
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|<[a-zA-Z/!?][^<>]*>|[^<]+|<", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
#: Elements whose content is not markup, or not shown: skipped up to their end.
RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas title xmp".split())
ZONES = frozenset("nav footer aside form dialog menu button select head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice onetrust sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social "
    "related newsletter subscribe popup modal overlay login signup search toolbar".split()
)
#: Words beside those in a name of the same kind: comment-list is one, but not has-sidebar or related-work.
BESIDE = frozenset(
    "area article articles bar block body bottom box btn button buttons card center col column container content form global group head "
    "header icons inner item items left link links list main outer page panel post posts primary right row sdk secondary section site slot "
    "stories sub text title top unit widget widgets wrap wrapper".split()
)
KEEP = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments".split())
#: What readers write, where a name has both words: user-reviews, but not book-reviews.
SAID = frozenset("response responses review reviews reply replies discussion opinions".split())
READERS = frozenset("reader readers user users visitor visitors customer customers".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HERE = re.compile(r"\bhref\s*=\s*[\"']?\s*#", re.I)
#: Code points of a window that is text on any page, and of the mean line in a form that frames the page.
PROSE = 25


def _words(name: str) -> set[str]:
    """The words of a class or id; commentlist and adslot are two words each, single letters none."""
    out = set()
    for word in PARTS.findall(name):
        word = word.lower()
        cut = next((i for i in range(2, len(word) - 2) if word[:i] in WORDS and word[i:] in BESIDE), 0)
        if cut and word not in WORDS | BESIDE:
            out |= {word[:cut], word[cut:]}
        elif len(word) > 1:
            out.add(word)
    return out


def _zone(tag: str, name: str, in_article: bool) -> bool:
    """Is this element, opened by `tag`, one whose text is never main text?"""
    if name in ZONES or (name == "header" and not in_article):
        return True
    if "=" not in tag and "hidden" not in tag:
        return False
    for a in ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return name not in KEEP
        if key == "role" and value.lower() in ROLES:
            return name not in KEEP
        if key in ("class", "id"):
            # Each name as a whole: all its words are of the kind, or stand beside one.
            for value_ in value.split():
                words = _words(value_)
                if words & SAID and words & READERS and name not in KEEP:
                    return True
                if name in KEEP:
                    if name == "article" and words & COMMENTS and words <= WORDS | BESIDE:
                        return True
                elif words <= WORDS | BESIDE and (words & WORDS or ("header" in words and not in_article)):
                    return True
    return False


def lines(page: str, shown: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, int]], dict[int, tuple[int, int, bool]]]:
    """((text, length without links, number of the article or 0) of each line, (text length, texts, whether
    ended) of left out elements by place); a left out element is the line ('', 0, ..).  Those in `shown`
    are not left out."""
    out: list[tuple[str, int, int]] = []
    left: dict[int, tuple[int, int, bool]] = {}
    parts: list[str] = []
    heading = here = False
    linked = inside = at = article = depth = link = number = begin = 0
    skip = ""

    def flush() -> None:
        nonlocal linked, inside
        text = " ".join("".join(parts).split())
        if text and inside >= len(text) and not heading:
            out.append(("", 0, number if article else 0))
        elif text:
            out.append((text, 0 if 2 * linked > len(text) and not article else len(text), number if article else 0))
        parts.clear()
        linked = inside = 0

    size = len(page)
    while at < size:
        m = TOKEN.match(page, at)
        place, at, token = at, m.end(), m[0]
        n = NAME.match(token) if token[0] == "<" else None
        if n is None:
            if token.startswith(("<!", "<?", "</")):
                continue
            if skip:
                chars, texts, ended = left[begin]
                left[begin] = chars + len(token.strip()), texts + (not token.isspace()), ended
            else:
                text = entities.unescape(token)
                parts.append(text)
                linked += len(text) if link else 0
                inside += len(text) if link and here else 0
            continue
        close, name = n[1], n[2].lower()
        if not close and name in RAW and not token.endswith("/>"):
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if skip:
            # Only elements of the same name count, so a missing end tag inside does not matter.
            if name == skip and not token.endswith("/>"):
                depth += -1 if close else 1
                if not depth:
                    skip = ""
                    left[begin] = *left[begin][:2], True
                    out.append(("", 0, number if article else 0))
            continue
        if not close and not token.endswith("/>") and place not in shown and _zone(token, name, article > 0):
            flush()
            skip, depth, begin = name, 1, place
            left[place] = 0, 0, False
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = 0 if close else 1
            here = not close and HERE.search(token) is not None
        elif name in BLOCKS:
            flush()
            link = 0
            heading = not close and name in HEADINGS
            if name == "article":
                number += not close and not article
                article = max(0, article + (-1 if close else 1))
    flush()
    return out, left


def stretches(lengths: list[int], window: int = LINES, least: float = 0.0) -> list[tuple[int, int]]:
    """(surge, dive): from a line where the sum of a window that begins there rises above `least` to before
    the line where that of a window that ends there is `least` or less.  Lines of length 0 at either end go;
    stretches with none between them are one."""
    out: list[tuple[int, int]] = []
    start, n = None, len(lengths)
    for i in range(n + 1):
        if start is None and sum(lengths[i : i + window]) > least:
            if lengths[i]:
                start = i
        elif start is not None and i - start >= window and sum(lengths[i - window + 1 : i + 1]) <= least:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, n))
    joined: list[tuple[int, int]] = []
    for a, b in out:
        while b > a and not lengths[b - 1]:
            b -= 1
        if joined and all(lengths[joined[-1][1] : a]):
            a = joined.pop()[0]
        joined.append((a, b))
    return joined


def _lines_of(page: str) -> list[tuple[str, int, int]]:
    """The page's lines.  Without text in an article, an element that frames the page is not left out."""
    shown: frozenset[int] = frozenset()
    while True:
        found, left = lines(page, shown)
        if any(number for text, _, number in found if text):
            return found
        most = 0.5 * (sum(len(text) for text, _, _ in found) + sum(n for n, _, _ in left.values()))
        large = {at for at, (n, texts, ended) in left.items() if n > most and _frame(page, at, n >= PROSE * texts, ended)}
        if not large:
            return found
        shown |= large


def _frame(page: str, at: int, prose: bool, ended: bool) -> bool:
    """May the element left out at this place hold the page?  Not if it is hidden, has a role of its own or
    holds readers' comments."""
    tag = TOKEN.match(page, at)[0]
    name = NAME.match(tag)[2].lower()
    named = " ".join(a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(tag, len(name) + 1) if a[1].lower() in ("class", "id"))
    words = _words(named)
    other = ATTRIBUTE.sub(lambda a: "" if a[1].lower() in ("class", "id") else a[0], tag)
    if _zone("<div" + other[len(name) + 1 :], "div", False) or words & COMMENTS or words & SAID and words & READERS:
        return False
    if _zone("", name, False):
        return prose and (not ended or name == "form")
    return True


def main_text(page: str, window: int = LINES) -> str:
    found = _lines_of(page)
    total = sum(n for _, n, _ in found)
    # The usual line is that of a code point taken at random, so many short lines don't make it short.
    least = min(PROSE, DENSE * sum(n * n for _, n, _ in found) / total) if total else 0.0
    spans = []
    start = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i][2] != found[start][2]:
            spans += [(start + a, start + b) for a, b in stretches([n for _, n, _ in found[start:i]], window, 0.0 if found[start][2] else least)]
            start = i
    if not spans:
        return ""
    size = [sum(n for _, n, _ in found[a:b]) for a, b in spans]
    mean = [n / sum(1 for x in found[a:b] if x[1]) for n, (a, b) in zip(size, spans, strict=True)]
    number = [found[a][2] for a, _ in spans]
    main = max(range(len(spans)), key=lambda i: size[i] * (ARTICLE if number[i] else 1))
    keep = [False] * len(found)
    for i, (a, b) in enumerate(spans):
        if number[i] == number[main]:
            stays = number[i] > 0 or mean[i] >= DENSE * mean[main]
        else:
            stays = mean[i] >= ALIKE * mean[main]
        if stays:
            keep[a:b] = [True] * (b - a)
            while a and not found[a - 1][1] and len(found[a - 1][0]) >= ALIKE * mean[main]:
                keep[a := a - 1] = True
            while b < len(found) and not found[b][1] and len(found[b][0]) >= ALIKE * mean[main]:
                keep[b], b = True, b + 1
    return "\n".join(text for (text, _, _), k in zip(found, keep, strict=True) if k and text)


def _extract(window: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for t in chunks(batches, "html"):
            text = [main_text(x or "", window) for x in t["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [t["page_id"].combine_chunks(), t["url"].combine_chunks(), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return work


def extract(pages: DataFrame, window: int = LINES) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Null and empty html, and pages without main text, have the empty text.  Pages are worked on
    one by one where they are, so repeated or null ids change nothing.  An empty table gives no
    rows; other columns are not read.  A line break inside a block is white space of it."""
    base = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    return mapped(base, _extract(window), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
