"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events over the whole page. Each block (paragraph, heading, list item, cell, ...) is a line with its
text and the number of tags met in it. Lines that stand in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments (by element, role, or a word of class or id) are never content, but take part in the smoothing. The ratios of characters
to tags are smoothed by a Gaussian over the line order; two clusters (text-like and link-like lines) are split by the threshold that
minimises the variance within them. Lines with the same container form a region, and all of an article or main element is one region; the
regions that hold a line of the text cluster are chosen, save regions of links whose own ratios are in the lower cluster. Where a page has an article element, only its lines are clustered.

Chosen regions are then looked at once more. Consecutive lines of one container that are mostly links or inline markup form a run; within an
article (outside, a region stands or falls as one) a run is left out if its ratios, smoothed within the container, are in the lower cluster:
the article speaks for plain lines, however short, and not for link lists. Outside of articles a region that was not chosen is taken in if it is
no run of links and stands between chosen lines, or inside a chosen container.

Defined cases: null or empty html gives the empty text; broken markup never fails (unclosed elements end with the page or with an
enclosing end tag); repeated rows are treated one by one; empty input gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column, mapped, read

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title noscript template iframe object svg canvas math select button textarea option nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
                  "gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related "
                  "replies search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets".split())
ENDS_P = BLOCKS - {"body", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FORMAT = frozenset("b strong i em u s sub sup small br wbr code kbd samp var cite q mark del ins abbr dfn time data".split())
SIGMA, LINK_SHARE, TAG_CHARS = 1.5, 0.5, 5
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _unwanted(tag: str, attrs, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not in_article
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and any(w.lower() in WORDS for w in _SPLIT.split(value)):
            return True
        if name in ("class", "id") and tag == "article" and any(w.lower() in ("comment", "comments", "ad", "advert", "promo", "related", "teaser") for w in _SPLIT.split(value)):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, region, unwanted, in article, container, mostly links or markup) for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.tags, self.regions = [], [], 0, 0
        self.open = [("", False, 0, 0, False)]  # tag, unwanted, article (its region), container, header of an article
        self.parent = {0: 0}
        self.inline, self.linked, self.link = 0, 0, 0  # inline tags and characters in links of this line, depth of the open link

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            tag, unwanted, article, region, heading_only = self.open[-1]
            full = len(text) - text.count(" ")
            heavy = self.linked >= LINK_SHARE * full or full < TAG_CHARS * self.inline
            self.lines.append((text, self.tags, article or region, unwanted or heading_only and tag not in HEADINGS, article > 0, region, heavy))
            self.tags = 0
        self.parts, self.inline, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P and self.open[-1][0] == "p":
                self.open.pop()
        elif tag not in FORMAT:
            self.inline += 1
        if tag == "a" and any(k == "href" for k, _ in attrs):
            self.link = len(self.open)
        if tag in VOID:
            return
        _, unwanted, article, region, heading_only = self.open[-1]
        unwanted = unwanted or _unwanted(tag, attrs, article > 0)
        if tag in BLOCKS or unwanted and not self.open[-1][1]:
            if tag not in BLOCKS:
                self.inline -= 1
                self.flush()
            if tag not in ("p", "li", "tr", "td", "th", "dd", "dt") and tag not in HEADINGS:
                self.regions += 1
                self.parent[self.regions] = region
                region = self.regions
            heading_only = heading_only or tag == "header" and article > 0
            self.open.append((tag, unwanted, article or (region if tag in ("article", "main") and not unwanted else 0), region, heading_only))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag not in FORMAT:
            self.inline += 1
        if tag == "a":
            self.link = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.flush()
                del self.open[i:]
                return
            if self.open[i][0] in ("article", "main", "body") and tag in ("p", "li", "b", "i", "em", "a", "span"):
                return  # a stray end tag does not close what encloses it

    def handle_data(self, data):
        self.parts.append(data)
        if self.link > len(self.open):
            self.link = 0  # what enclosed the link has ended
        if self.link:
            self.linked += sum(map(len, data.split()))


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]
    return np.convolve(values, kernel)[reach:reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """The value that splits ``values`` in two with the least variance within both parts; the smallest value if all are alike."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return float(v[0])
    n, total, squares = np.arange(1, len(v)), np.cumsum(v), np.cumsum(v * v)
    left = squares[:-1] - total[:-1] ** 2 / n
    right = (squares[-1] - squares[:-1]) - (total[-1] - total[:-1]) ** 2 / (len(v) - n)
    cost = np.where(v[1:] > v[:-1], left + right, np.inf)
    return float(v[int(np.argmin(cost)) + 1])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    wanted = [i for i, x in enumerate(lines) if not x[3]]
    if not wanted:
        return ""
    if any(lines[i][4] for i in wanted):
        wanted = [i for i in wanted if lines[i][4]]
    raw = np.array([len(x[0]) / (1 + x[1]) for x in lines])
    ratios = smoothed(raw)
    least = threshold(ratios[wanted])
    chosen = {lines[i][2] for i in wanted if ratios[i] >= least}
    if lines[wanted[0]][4]:
        own = [i for i in wanted if lines[i][2] in chosen]
        kept = _without_links(lines, raw, own) or own
    else:
        regions: dict[int, list[int]] = {}
        for i in wanted:
            regions.setdefault(lines[i][2], []).append(i)
        for region in sorted(chosen):
            own = regions[region]
            # links beside a paragraph are not lifted by it
            if sum(lines[i][6] for i in own) * 2 >= len(own) and raw[own].mean() < least and len(chosen) > 1:
                chosen.discard(region)
        kept = _joined(lines, parser.parent, wanted, chosen)
    return "\n".join(lines[i][0] for i in kept)


def _runs(lines, at: list[int], parts: tuple[int, ...]) -> list[list[int]]:
    """``at`` in stretches of lines that agree in ``parts``."""
    out: list[list[int]] = []
    for i in at:
        if out and all(lines[i][p] == lines[out[-1][-1]][p] for p in parts):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _without_links(lines, raw: np.ndarray, own: list[int]) -> list[int]:
    """An article's lines without its runs of links in the lower cluster."""
    local = np.zeros(len(lines))
    for run in _runs(lines, own, (5,)):
        local[run] = smoothed(raw[run])
    least = threshold(local[own])
    return [i for run in _runs(lines, own, (5, 6)) if not lines[run[0]][6] or local[run].mean() >= least for i in run]


def _joined(lines, parent: dict[int, int], wanted: list[int], chosen: set[int]) -> list[int]:
    """Lines of chosen regions, and of others without links that stand between them in a common container, or within one of them."""
    def common(a, b):
        while a != b:
            a, b = (parent[a], b) if a > b else (a, parent[b])
        return a
    runs = _runs(lines, wanted, (2,))
    picked = [lines[r[0]][2] in chosen for r in runs]
    if all(picked):
        return wanted
    within: dict[int, bool] = {0: False}  # parents are numbered before what they hold
    held = {lines[i][2] for i in wanted if lines[i][5] and parent[lines[i][5]]} & chosen
    for region in sorted(parent)[1:]:
        within[region] = within[parent[region]] or region in held
    before = np.maximum.accumulate([k if p else -1 for k, p in enumerate(picked)])
    after = np.minimum.accumulate([k if p else len(runs) for k, p in enumerate(picked)][::-1])[::-1]
    kept, gaps = [], {}
    for k, run in enumerate(runs):
        take = picked[k]
        if not take and sum(lines[i][6] for i in run) * 2 < len(run):
            region = lines[run[0]][2]
            take = within[region]
            if not take and before[k] >= 0 and after[k] < len(runs):
                gap = (int(before[k]), int(after[k]))
                if gap not in gaps:
                    gaps[gap] = common(lines[runs[gap[0]][0]][2], lines[runs[gap[1]][0]][2])
                take = common(gaps[gap], region) == gaps[gap]
        if take:
            kept += run
    return kept


def extracted(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (columns ``keep`` of the pages) and ``text``."""
    keep = pages.columns if keep is None else keep
    packed = pages.select(F.struct(*[column(pages, c) for c in pages.columns if c in keep]).alias("doc"), F.col("html"))
    kind = packed.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())], ["doc", "text"])
    return mapped(packed, run, f"doc {kind}, text string")


def op6_html(spark, sf_dir: str) -> DataFrame:
    rows = extracted(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return rows.select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"))
