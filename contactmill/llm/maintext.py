"""Main text of a web page by tag-path ratios.

The page is read once: every block of text gets its root-to-leaf tag path (with class and id names). Elements that HTML
itself sets apart (navigation, footers, asides, scripts and the like) are left out, and forms, unless one holds most of the
page. Each tag path sums up the length and the punctuation of its blocks, per block and less the share of link text; both
ratios are laid over the page in order, smoothed by a Gaussian, and fused (geometric mean). Names decide nothing by
themselves: a path under an element with the name of a sidebar, notice, advert or comments counts ``NAMED`` of its ratio, one
inside an ``article`` or ``main`` element ``PRIOR`` times. Only whole names count, or those made of such names and words of
place (``comment-list``), never ``no-sidebar``; ids of headings are anchors and do not.

The region with the largest sum of fused ratios is the article, be it an ``article`` or ``main`` element or what lies
outside of them (if that is ``OUTSIDE`` characters or more); another such element joins it from ``ALSO`` of that sum on. In it, paths whose fused ratio reaches
``LAMBDA`` times the standard deviation over the page are content (the best path, where none does). So are, in the same
container (the article or main element, outside the element around the block), paths of paragraphs, headings, lists, tables
and quotes, and others from ``WEAK`` of that limit on. Paths made of links, or with such a name, are not.

Null or empty html gives an empty text; repeated rows each get theirs; an empty table gives an empty result; broken markup
is read as browsers do in the common cases (unclosed paragraphs, stray end tags). Very long pages are read whole, in time
that grows with their length; nothing is cut off. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA = 1.5
SIGMA = 1.0
LINKS = 0.6
PRIOR = 2.0
NAMED = 0.02
ALSO = 0.5
OUTSIDE = 200
WEAK = 0.25
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAMES = re.compile(r"[a-z0-9]+")
# Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                  "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table select article section div body html".split())
# Elements that HTML sets apart from the main text.
OUT_TAGS = frozenset("nav header footer aside head menu button select svg dialog object math audio video canvas fieldset search".split())
# Names of what is no main text, and words of place and kind that such a name may be made up with.
OUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside footer header masthead "
                      "cookie cookies consent gdpr notice notices alert disclaimer comment comments reply replies discussion respond disqus related recommended share sharing social "
                      "newsletter subscribe subscription popup modal overlay breadcrumb breadcrumbs pagination pager widget login signup toolbar search skip".split())
PLACES = frozenset("list box wrap wrapper container site main page section area bar left right top bottom item items block inner outer body content links link text form panel slot unit "
                   "primary secondary global mobile desktop thread post posts user reader readers buttons icons module group row col column".split())
# Containers that are part of the text around them.
PARTS = frozenset("ul ol dl dd li table tbody thead tfoot tr blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = HEADINGS | frozenset("p li dt dd td th pre blockquote caption figcaption summary".split())


def listed(name: str) -> bool:
    """Whether a class, id or role is one of ``OUT_NAMES``, or is made of them and of words of place."""
    parts = set(NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
    return bool(parts & OUT_NAMES) and parts <= OUT_NAMES | PLACES


def dropped(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """Whether the element holds no main text, whether it is named so, and its class and id names."""
    if tag in OUT_TAGS:
        return True, False, ""
    names, out, named = "", False, False
    if attrs:
        for m in ATTR.finditer(attrs):
            key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out = True
            elif key in ("class", "id", "role"):
                named = named or tag not in HEADINGS and tag not in ("html", "body") and any(map(listed, value.split()))
                names += "." + value.lower()
    return out, named, names


class Block:
    __slots__ = ("path", "tag", "holder", "region", "named", "form", "parts", "links", "text")

    def __init__(self, path, tag, holder, region, named, form):
        self.path, self.tag, self.holder, self.region, self.named, self.form = path, tag, holder, region, named, form
        self.parts, self.links = [], 0


def blocks(page: str) -> list[Block]:
    """Blocks of the page outside dropped elements, in order, with their tag path, the element around them, the innermost
    article (else main) element they are in (0: none), whether they are under a listed name, and their form."""
    out: list[Block] = []
    stack: list[tuple] = []  # (tag, path, element number, dropped, region, in a link, named, form)
    none = ("", "", 0, False, 0, False, False, 0)
    top = none
    current, count, at, n = None, 0, 0, len(page)
    while at <= n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not top[3]:
            text = page[at:end]
            if not text.isspace() or current is not None:
                if current is None:
                    at_block = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
                    holder = stack[at_block] if at_block >= 0 else top
                    up = next((e for e in reversed(stack[:max(0, at_block)]) if e[0] in BLOCK and e[0] not in PARTS), none)
                    current = Block(holder[1], holder[0], up[2], top[4], top[6], top[7])
                    out.append(current)
                text = html.unescape(text) if "&" in text else text
                current.parts.append(text)
                if top[5]:
                    current.links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            current = None
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not (m.group(3).endswith("/") and tag not in BLOCK and tag != "a"):
            shut = CLOSES.get(tag, ("p",) if tag in BLOCK else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in STOPS:
                    break
            top = stack[-1] if stack else none
            gone, named, names = (True, False, "") if top[3] else dropped(tag, m.group(3))
            count += 1
            region = count if tag == "article" or tag == "main" and not top[4] else top[4]
            stack.append((tag, f"{top[1]}/{tag}{names}", count, gone, region, top[5] or tag == "a", top[6] or named, top[7] or (count if tag == "form" else 0)))
        top = stack[-1] if stack else none
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    # A form that holds most of the page's text is a frame around it and no form to fill in.
    size: dict = {}
    for b in out:
        size[b.form] = size.get(b.form, 0) + len(b.text)
    frame = [f for f, n in size.items() if 2 * n > sum(size.values())]
    return [b for b in out if not b.form or b.form in frame]


def punctuation(text: str) -> int:
    return sum(map(text.count, ".,;:!?"))


def content(found: list[Block]) -> list[Block]:
    """The blocks whose tag paths are content."""
    if not found:
        return []
    total: dict = {}
    for b in found:
        s = total.setdefault((b.region, b.path), [0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), punctuation(b.text), min(b.links, len(b.text)))):
            s[i] += v
    free = {p: 1 - s[3] / s[1] for p, s in total.items()}
    keys = [(b.region, b.path) for b in found]
    length = [total[k][1] * free[k] / total[k][0] for k in keys]
    marks = [(total[k][2] + 1) * free[k] / total[k][0] for k in keys]
    # The ratios of the path itself and, smoothed, of what stands around it, fused.
    fused = [math.sqrt(math.sqrt(a * x * c * y)) * (PRIOR if b.region else 1) * (NAMED if b.named else 1)
             for a, x, c, y, b in zip(length, smoothed(length), marks, smoothed(marks), found)]
    mean = sum(fused) / len(fused)
    limit = LAMBDA * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    by_path: dict = {}
    mass: dict = {}
    for k, x in zip(keys, fused):
        by_path.setdefault(k, []).append(x)
        mass[k[0]] = mass.get(k[0], 0) + x
    means = {k: sum(v) / len(v) for k, v in by_path.items()}
    if sum(len(b.text) for b in found if not b.region and not b.named) < OUTSIDE and len(mass) > 1:
        mass.pop(0, None)
    first = max(mass, key=mass.get)
    regions = {r for r, m in mass.items() if r == first or r and m >= ALSO * mass[first]}
    wanted = [k for k in means if k[0] in regions]
    text = {k: free[k] > 1 - LINKS for k in means}
    good = {k for k in wanted if means[k] >= limit and text[k]} or {max(wanted, key=means.get)}
    homes = {b.region or b.holder for b, k in zip(found, keys) if k in good}

    def near(b: Block, k) -> bool:
        return k[0] in regions and (k[0] or b.holder) in homes and text[k] and not b.named and (b.tag in STRUCTURE or means[k] >= WEAK * limit)

    return [b for b, k in zip(found, keys) if k in good or near(b, k)]


def smoothed(values: list[float], reach: int = 2) -> list[float]:
    """Gaussian mean over the neighbours in page order."""
    kernel = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, z = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[a - i + reach:z - i + reach]
        out.append(sum(x * y for x, y in zip(values[a:z], w)) / sum(w))
    return out


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(page))) if page else ""


def op8_main_text(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
