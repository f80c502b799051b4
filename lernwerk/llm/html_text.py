"""Main text of web pages by consensus host paths (operator 4).

A first pass scores the containers of each page: text outside links counts for its nearest container and by half for
the one above.  Each page votes for the path of its best container, tags with generalised classes from the body down;
Spark counts the votes per host.  Paths with at least ``MIN_SHARE`` of a host's votes win, so a host has at most
1 / ``MIN_SHARE`` of them.  The second pass takes each page's text from the winning path that the page has and that
got most votes; a page without any uses its own best container.  Menus, headers, footers, sidebars, notices, adverts,
forms, comments and code are left out by tag, role, class and id, wherever they stand.  A class or id that is such a
word as a whole decides at once; one that only holds it (``no-sidebar``) and a form decide only at the end of the page:
what stands in them stays if an article or main element does that is not itself named so; or, unless it is a form, if
the page has no such element but around it, it is more than half of the page's text, and all that is not in doubt is
less than a quarter of it.

Defined results: a null or empty page has an empty text; a page without a host votes with those of the host "";
repeated rows are all returned; extra columns are ignored; tags that are not closed end with what contains them.
The work on a page grows with its length, also where tags nest deeply, stay open or have no end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, small

MIN_SHARE = 0.1

# A quote that is not closed ends the first form at once; the second then ends the tag at the next ">".
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select option button canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body center details dialog div fieldset figure footer form header main menu nav section table tbody td tr".split())
LEFT_OUT = frozenset("nav footer aside menu dialog fieldset".split())
#: A start tag of the first kind ends an open one of the second, unless a container stands between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}} | {b: {"p"} for b in BLOCKS - {"p", "li", "dd", "dt", "tr", "td", "th", "html", "body"}}
#: Words of class, id, role or label that name what is no article text.
OTHER = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline-ad comment comments commentlist consent cookie cookies disqus footer "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination popup promo promotion recommended related "
    "reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets gdpr complementary contentinfo"
    .split()
)
GOOD = frozenset("article content entry post story text main body".split())


class Page:
    """Containers in the order of their start (path number, tag, parent, last one inside) and pieces of text."""

    def __init__(self, html: str):
        self.path, self.tag, self.parent, self.last, self.good = [0], ["body"], [-1], [0], [False]
        self.step = ["body"]  # the last step of each container's path
        self.number: dict[tuple[int, str], int] = {}  # of a path: that of the path above and the last step
        self.pieces: list[tuple[int, int, bool, str]] = []  # container, block, in a link, text
        inside: list[int] = []  # of each piece: the innermost doubtful element, 0 for none
        above, holds, form, within = [0], [True], [False], [0]  # of each doubtful element
        cores = around_now = 0  # article and main elements not named otherwise: all so far, and those open
        stack: list[tuple[str, int, bool, int, bool]] = []  # tag, container or -1, left out, doubtful element around, core
        opened: Counter = Counter()
        here, out, doubt, block, at = 0, 0, 0, 0, 0
        # after the last ">" no tag ends; a comment that opens there has no end
        size = html.rfind(">") + 1
        tail = html[size:].partition("<!--")[0]

        def pop(depth: int) -> None:
            nonlocal here, out, doubt, around_now
            while len(stack) > depth:
                name, box, gone, doubt, clean = stack.pop()
                if box >= 0:
                    self.last[box] = len(self.path) - 1
                    here = self.parent[box]
                out -= gone
                opened[name] -= 1
                around_now -= clean

        def add(link: bool, text: str) -> None:
            if text and not out:
                self.pieces.append((here, block, link, text))
                inside.append(doubt)

        while at < size:
            found = _TAG.search(html, at, size)
            add(opened["a"] > 0, html[at:found.start() if found else size])
            if not found:
                break
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if name in BLOCKS:
                block += 1
            if found[1] or found[4]:
                if opened[name]:
                    pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if name == "br":
                add(False, " ")
                continue
            rest = found[3] if found[2] else found[6]
            if name in VOID or name in ("html", "body", "head"):
                continue
            if name in RAW:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            if any(opened[c] for c in CLOSES.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[name]:
                        pop(i)
                        break
                    if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "dl"):
                        break
            words, whole, classes, hidden = set(), set(), [], False
            if rest and not rest.isspace():
                for m in _ATTR.finditer(rest):
                    value = (m[2] or m[3] or m[4] or "").lower()
                    key = m[1].lower()
                    if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                        hidden = True
                    elif key != "style":
                        words.update(_WORD.findall(value))
                        whole.update(value.split())
                        if key == "class":
                            classes = sorted({re.sub("[0-9]+", "#", c).replace(">", "_") for c in value.split()})
            box = -1
            core = name in ("article", "main")
            head = name == "header" and not opened["article"] and not opened["main"]
            gone = hidden or name in LEFT_OUT or head or (not core and bool(whole & OTHER))
            around, clean = doubt, core and not gone and not out and not words & OTHER
            if not gone and (name == "form" or not core and words & OTHER):
                above.append(doubt)
                holds.append(False)
                form.append(name == "form")
                within.append(around_now)
                doubt = len(above) - 1
            elif clean:
                cores += 1
                while not holds[around]:
                    holds[around] = True
                    around = above[around]
                around = doubt
            if name in CONTAINERS:
                box = len(self.path)
                step = name + "".join(f".{c}" for c in classes)
                self.path.append(self.number.setdefault((self.path[here], step), len(self.number) + 1))
                self.step.append(step)
                self.tag.append(name)
                self.parent.append(here)
                self.last.append(box)
                self.good.append(core or bool(words & GOOD))
                here = box
            stack.append((name, box, gone, around, clean))
            around_now += clean
            opened[name] += 1
            out += gone
        if at <= size:
            add(opened["a"] > 0, tail)
        pop(0)
        self.last[0] = len(self.path) - 1
        # doubtful elements: those inside come after those around them
        weight = [0] * len(above)
        for piece, element in zip(self.pieces, inside, strict=True):
            weight[element] += 0 if piece[2] else len(piece[3].strip())
        plain = weight[0]
        for i in range(len(above) - 1, 0, -1):
            weight[above[i]] += weight[i]
        for i in range(1, len(above)):
            holds[i] = holds[above[i]] and (holds[i] or not form[i] and cores == within[i] and weight[i] > 4 * plain and 2 * weight[i] > weight[0])
        self.pieces = [piece for piece, element in zip(self.pieces, inside, strict=True) if holds[element]]

    def path_of(self, box: int) -> str:
        """The steps from the body down to a container."""
        steps = []
        while box >= 0:
            steps.append(self.step[box])
            box = self.parent[box]
        return ">".join(reversed(steps))

    def boxes(self, path: str) -> list[int]:
        """The containers with a path."""
        number = 0
        for step in path.split(">")[1:]:
            number = self.number.get((number, step), -1)
        return [i for i, n in enumerate(self.path) if n == number]

    def best(self) -> int:
        """The container with most text of its own; the article around it, if there is one."""
        score = [0.0] * len(self.path)
        for box, _, link, text in self.pieces:
            if not link:
                n = len(text) - text.count(" ") if len(text) < 400 else 0.85 * len(text)
                score[box] += n
                if self.parent[box] >= 0:
                    score[self.parent[box]] += n / 2
        best = max(range(len(score)), key=lambda i: (score[i] * (1.5 if self.good[i] else 1.0), -i))
        at = best
        while at > 0:
            if self.tag[at] == "article":
                best = at
            at = self.parent[at]
        return best if score[best] > 0 else 0

    def text(self, paths: list[str]) -> str:
        """The text below the first path that has any, else below the page's best container."""
        for path in paths:
            found = self._below(self.boxes(path))
            if found:
                return found
        return self._below([self.best()])

    def _below(self, boxes: list[int]) -> str:
        spans, done = [], -1
        for box in boxes:
            if box > done:
                spans.append((box, self.last[box]))
                done = self.last[box]
        blocks: dict[int, list[str]] = {}
        starts = [a for a, _ in spans]
        for box, block, _, text in self.pieces:
            i = bisect_right(starts, box) - 1
            if i >= 0 and box <= spans[i][1]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
        return "\n".join([x for x in lines if x])


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes), counted per batch already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
                page = Page(html.as_py() or "")
                if any(not text.isspace() for *_, text in page.pieces):
                    count[host.as_py(), page.path_of(page.best())] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in count], pa.string()), pa.array([p for _, p in count], pa.string()), pa.array(list(count.values()), pa.int64())
            ], names=["host", "path", "votes"])

    return pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths): the winning paths of each host, the one with most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    won = counted.join(total, "host").where(F.col("votes") >= MIN_SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    shared = Shared(pages.sparkSession)
    paths = shared.put(winners(shared.put(votes(pages))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html.as_py() or "").text(own.as_py() or []) for html, own in zip(batch.column("html"), batch.column("paths"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", _host().alias("host")).join(small(paths, 100_000), "host", "left")
    return rows.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))


QUERIES = {"op4_html": op4_html}
SQL: dict[str, str] = {}
