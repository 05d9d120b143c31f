"""Main text of web pages from parser events: text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is the text between two block borders. Each line has a ratio of characters outside links to tags; the ratios are smoothed along the
page and split into two clusters by a threshold. Lines of the upper cluster choose the region: the article that holds most of
them, or else the innermost container that does. Inside it every line stays that neither links nor a tag or class mark as
something else, so titles, lists, tables and short last sections do; where only the body holds the chosen lines, it is those
beside them and lines of prose.
Tags and classes are a filter besides: boilerplate containers are never content.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
RADIUS = 2
HOLDS = 0.5  # share of the chosen characters that articles must hold to count as the region; else all of the page does
INNER = 0.8  # share of the chosen characters that a container must hold to be the region of a page without articles
LINKED = 0.5  # a line with more than this share of its characters in links is one of links
PROSE = 8    # words of a line that reads as text wherever it stands

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("""article aside blockquote body center details dialog div dl fieldset figure footer form head header
html main menu nav ol section table ul""".split())
DROPPED = frozenset("""aside button canvas datalist dialog fieldset footer form head iframe menu nav noscript object script
select style svg template textarea title""".split())
ARTICLES = frozenset("article main section".split())  # a header inside is theirs, not the page's
JOINED = frozenset("blockquote dl figure ol section table ul".split())
# Words in class, id or role that name what isn't the article.
NOT_ARTICLE = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent contentinfo cookie cookies disqus footer gdpr hidden login masthead menu menubar modal nav navbar navigation
newsletter notice notices pagination popup promo promotion promoted recommended related reply replies respond search share
sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
WORDS = re.compile(r"[a-z0-9]+")


class Lines(HTMLParser):
    """Collects lines: (text, tags, dropped, container, characters in links, links). Containers form a tree in ``parents``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, int]] = []
        self.parents, self.names = [-1], [""]
        self.stack: list[tuple[str, bool, int]] = [("", False, 0)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = 0
        self.articles = 0
        self.in_link, self.linked, self.links = False, 0, 0

    def cut(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            _, dropped, container = self.stack[-1]
            self.lines.append((text, self.tags, dropped, container, self.linked, self.links))
            self.tags = 0
        self.linked = self.links = 0
        self.parts.clear()

    def marked(self, tag, attrs) -> bool:
        if tag in DROPPED or tag == "header" and not self.articles:
            return True
        for name, value in attrs:
            if name in ("class", "id", "role"):
                if value and not NOT_ARTICLE.isdisjoint(WORDS.findall(value.lower())) and tag not in ("body", "html", "article", "main") \
                        or tag == "article" and value and not {"comment", "comments", "reply", "ad", "advert"}.isdisjoint(WORDS.findall(value.lower())):
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
            if self.stack[-1][0] == "p":  # a block ends an open paragraph
                self.open["p"] -= 1
                self.stack.pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a" or tag in CONTAINERS:  # a link left open ends with the container
            self.in_link = tag == "a"
            self.links += self.in_link
        name, dropped, container = self.stack[-1]
        drop = dropped or self.marked(tag, attrs)
        if tag in CONTAINERS:
            self.parents.append(container)
            self.names.append(tag)
            container = len(self.parents) - 1
            self.articles += tag in ARTICLES
        elif drop == dropped:
            return  # neither a container nor the start of a dropped part
        if drop != dropped:
            self.cut()
        self.stack.append((tag, drop, container))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a" or tag in CONTAINERS:
            self.in_link = False
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut()
                for name, _, _ in self.stack[i:]:
                    self.articles -= name in ARTICLES
                    self.open[name] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in ("article", "main", "body") and tag not in CONTAINERS:
                return  # a stray end tag doesn't close the article

    def handle_data(self, data):
        self.parts.append(data)
        if self.in_link:
            self.linked += len("".join(data.split()))


def smoothed(ratios: np.ndarray, sigma=SIGMA, radius=RADIUS) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Border between two clusters: halves of the means above and below it, repeated until it stays."""
    border = float(values.mean())
    for _ in range(50):
        upper = values >= border
        if upper.all():
            return border
        moved = (values[upper].mean() + values[~upper].mean()) / 2
        if abs(moved - border) < 1e-9:
            break
        border = float(moved)
    return border


def link_lines(parser: Lines) -> list[bool]:
    """Whether each line is one of links: several of them, or one that has no text beside it in its container. A paragraph
    that is one link between others of text is text."""
    heavy = [linked > LINKED * len("".join(text.split())) for text, _, _, _, linked, _ in parser.lines]
    texts: dict[int, int] = {}
    for line, links in zip(parser.lines, heavy):
        texts[line[3]] = texts.get(line[3], 0) + (-1 if links else 1)
    return [links and (line[5] > 1 or texts[line[3]] < 1) for line, links in zip(parser.lines, heavy)]


def content_lines(parser: Lines) -> list[int]:
    """Numbers of the lines that are content, by their smoothed ratios."""
    lines, parents, names = parser.lines, parser.parents, parser.names
    usable = [i for i, line in enumerate(lines) if not line[2]]
    if not usable:
        return []
    ratios = np.array([0.0 if dropped else max(0, len(text) - linked) / max(1, tags) for text, tags, dropped, _, linked, _ in lines])
    smooth = smoothed(ratios)
    border = threshold(smooth)
    links = link_lines(parser)
    # Smoothing must not lift a line of links, or a container of its own, into the content beside it.
    strong = {lines[i][3] for i in usable if smooth[i] >= border and ratios[i] >= border}
    chosen = [i for i in usable if smooth[i] >= border and (ratios[i] >= border or not links[i] and lines[i][3] in strong)]
    chosen = chosen or [i for i in usable if smooth[i] >= border] or usable
    weight = [0] * len(parents)  # of each container and all in it; parents come before their children
    for i in chosen:
        weight[lines[i][3]] += len(lines[i][0])
    for c in range(len(parents) - 1, 0, -1):
        weight[parents[c]] += weight[c]
    region = _region(parents, names, weight)
    inside = [False] * len(parents)
    for c in range(len(parents)):
        inside[c] = c in region or c > 0 and inside[parents[c]]
    held = [i for i in usable if inside[lines[i][3]]]
    if names[min(region)] not in ("", "html", "body"):
        return [i for i in held if not links[i]] or held
    beside = {lines[i][3] for i in chosen}
    kept = set(chosen)
    for i in held:
        at, between = lines[i][3], chosen[0] < i < chosen[-1]
        if i not in kept and not links[i] and (at in beside and (between or names[at] not in ("", "html", "body"))
                                              or between and names[at] in JOINED or len(lines[i][0].split()) >= PROSE):
            kept.add(i)
    return sorted(kept)


def _region(parents: list[int], names: list[str], weight: list[int]) -> set[int]:
    """Containers that hold the content: articles with most of it, else the innermost container that has most of it."""
    named = [c for c in range(len(parents)) if names[c] in ("article", "main") and weight[c]]
    if named:
        # Nested articles count with the outer one; a teaser list beside the article holds little text.
        best = max(weight[c] for c in named)
        region = {c for c in named if weight[c] >= 0.5 * best}
        inner = [False] * len(parents)
        for c in range(1, len(parents)):
            inner[c] = inner[parents[c]] or parents[c] in region
        if sum(weight[c] for c in region if not inner[c]) >= HOLDS * weight[0]:
            return region
    at = 0
    for c in range(1, len(parents)):  # at most one child of a container holds that much
        if parents[c] == at and weight[c] >= INNER * weight[0]:
            at = c
    return {at}


def main_text(html: str) -> str:
    """Content lines, joined by an empty line; empty if the page has none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return "\n\n".join(parser.lines[i][0] for i in content_lines(parser))


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Null or empty html gives the empty text, as does a page without content. Unclosed, stray and misnested tags are taken
    as they come. Repeated pages give repeated rows; ids and urls, null included, are carried along; columns besides the
    three named are not read.
    """
    types = dict(pages.dtypes)
    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) if html else "" for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(extract, schema)
