"""Main-text extraction by a maximum-scoring subsequence.

A page becomes a sequence of tags and text runs. Words score positive, tags
negative; words under a boilerplate container score negative too. The weights
are log-odds of tags, class or id words and features of a container's own text, learnt from
labelled pages (``train``), and one linear scan finds the contiguous region with the best sum.
Within it, runs under a container of negative weight are left out. A container named
as boilerplate that holds most of the page and its article (a form or a div.sidebar
around everything) is judged as if it had no name.

A name of several words is judged by its head, the last word that is no part of a layout
(post-comments and comment-list are comments, a login-guide is a guide). A
telling word before the head counts little, and nothing against prose. Without names, a
container tells by its links, its buttons or a copyright line; inside an element that is
telling of content these say nothing, as an article may hold a list of links.

Output rules: character references are decoded, white space within a block
becomes one space, blocks are trimmed and joined by one line feed; empty blocks
vanish. Defined results: a null or empty page, or one without text, gives an
empty string; of equal regions the first counts; unclosed tags close with their
container or, for cells, rows, items and options, with the next of their kind; a tag
that never ends is text; repeated rows are handled row by row; an empty table gives no
rows; extra columns are left out; a long page is handled whole, in linear time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is never text.
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "head", "canvas", "audio", "video")
#: Elements that run within a block.
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
).split()
#: Elements that hold other blocks and keep their mark on what is inside.
CONTAINERS = (
    "article main section div nav header footer aside form ul ol dl menu table tbody thead tr td th figure figcaption blockquote details dialog fieldset button body"
).split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: First words of names that tell what an element has, and last ones that tell its place or make.
RELATIONS = frozenset("has have with without no is not tag category".split())
LAYOUT = frozenset(
    "area list inner outer wrap wrapper container box section block item left right top bottom bar slot row col column content body link main panel group holder region unit zone header title text".split()
)
#: Silent elements whose content a browser reads as raw text up to their end tag.
_RAW = {"script", "style", "iframe", "textarea", "title"}
_INLINE, _HELD, _SILENT = set(INLINE), set(CONTAINERS), set(SILENT)


def marks_of(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an opening tag: its name and the names of its class, id and role, words of one joined by a hyphen.

    The body holds every page, so only its name counts.
    """
    named = [x for m in _NAMES.finditer(attributes) for x in next(x for x in m.groups("") if x or not any(m.groups(""))).lower().split()] if attributes and tag != "body" else []
    names = ["-".join(w.rstrip("s") if len(w) > 3 else w for w in re.split(r"[^a-z]+", x) if w) for x in named]
    return (f"<{tag}>", *dict.fromkeys(n for n in names if n))


#: The open elements that the start of another ends, and those that hold them apart.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "thead": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}


def runs(page: str) -> tuple[list[tuple], list[tuple[int, tuple[str, ...]]]]:
    """(tokens, containers) of a page.

    Tokens, in page order, are ("tag", marks, opens, container) and ("text", text,
    block number, container, whether in a link); containers, in order of their start, (parent, marks),
    the first standing for the page.
    """
    out: list[tuple] = []
    nodes: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    held: list[tuple[str, int]] = []  # open containers and their numbers
    open_at: dict[str, list[int]] = {t: [] for t in _HELD}  # their places in held, by tag
    endings: dict[str, int] = {}
    block = at = here = links = 0
    end = len(page)

    def ending(tag: str) -> int:
        """Where the next end tag starts, -1 where there is none; each stretch is searched once a tag."""
        if tag not in endings or 0 <= endings[tag] < at:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            endings[tag] = found.start() if found else -1
        return endings[tag]

    def close(place: int) -> None:
        while len(held) > place:
            open_at[held.pop()[0]].pop()

    last = lambda tags: max((open_at[t][-1] for t in tags if open_at[t]), default=-1)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            out.append(("text", page[at:stop], block, here, links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in _SILENT and not closing:
            if m[3].rstrip().endswith("/"):
                continue
            if ending(tag) >= 0:
                at = page.index(">", ending(tag)) + 1
            elif tag in _RAW:
                at = end
            elif tag != "head" and held and ending(held[-1][0]) >= 0:
                at = ending(held[-1][0])
            block += 1
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag not in _INLINE:
            block += 1
        if tag in _HELD:
            outer = here
            if closing:
                if open_at[tag]:
                    close(open_at[tag][-1])
                out.append(("tag", (f"<{tag}>",), False, outer))
            else:
                if tag in _ENDS:
                    ended, apart = _ENDS[tag]
                    first = last(ended[:1])
                    place = first if first > last(apart) else last(ended)
                    if place > last([t for t in apart if t != tag]):
                        close(place)
                        outer = held[-1][1] if held else 0
                marks = marks_of(tag, m[3])
                open_at[tag].append(len(held))
                held.append((tag, len(nodes)))
                nodes.append((outer, marks))
                out.append(("tag", marks, True, outer))
            here = held[-1][1] if held else 0
        else:
            out.append(("tag", (f"<{tag}>",), not closing, here))
    return out, nodes


def _walk(nodes: list[tuple[int, tuple[str, ...]]]) -> Iterator[tuple[list[str], list[str], dict[str, int]]]:
    """Per container (features that come up, that go, how often each is on its way to the page), by steps along the tree."""
    path, count = [0], {}
    for k, (parent, marks) in enumerate(nodes):
        gone = []
        while k and path[-1] != parent:
            for f in nodes[path.pop()][1]:
                count[f] -= 1
                if not count[f]:
                    gone.append(f)
        new = []
        for f in marks:
            count[f] = count.get(f, 0) + 1
            if count[f] == 1:
                new.append(f)
        if k:
            path.append(k)
        yield new, gone, count


#: Words of a block that reads as prose, of a container that holds prose, and of a short one.
LONG_BLOCK, PROSE, SHORT = 8, 12, 40
_COPYRIGHT = re.compile(r"©|&copy;|&#169;|\(c\)\s*\d{4}|all rights reserved", re.I)
_ACTS = {"<button>", "<input>"}


def structure(tokens: list[tuple], nodes: list[tuple[int, tuple[str, ...]]]) -> tuple[list[bool], list[tuple[str, ...]]]:
    """Per container, whether it holds prose, and the features of what it holds."""
    n = len(nodes)
    words, linked, links, prose, acts, rights = ([0] * n for _ in range(6))
    block, whose, size, free = -1, 0, 0, True

    def close() -> None:
        if size >= LONG_BLOCK and free:
            prose[whose] += size

    for t in tokens:
        if t[0] == "text":
            k = len(t[1].split())
            if (t[2], t[3]) != (block, whose):
                close()
                block, whose, size, free = t[2], t[3], 0, True
            size += k
            free = free and not t[4] or size > 3 * k
            words[t[3]] += k
            linked[t[3]] += k * t[4]
            links[t[3]] += bool(k and t[4])
            rights[t[3]] += bool(_COPYRIGHT.search(t[1]))
        elif t[2] and t[1][0] in _ACTS:
            acts[t[3]] += 1
    close()
    for k in range(n - 1, 0, -1):
        for x in (words, linked, links, prose, acts, rights):
            x[nodes[k][0]] += x[k]
    has = [prose[k] >= PROSE for k in range(n)]
    found = []
    for k in range(n):
        short = words[k] <= SHORT and not has[k]
        told = (("#links", links[k] >= 3 and 5 * linked[k] > 3 * words[k]), ("#acts", acts[k] > 0 and words[k] <= SHORT), ("#rights", rights[k] > 0 and short))
        found.append(tuple(name for name, holds in told if holds and k))
    return has, found


class Weights(dict):
    """Log-odds of content by feature; a feature never seen has none."""

    #: What a telling word says that is not the head of its name.
    WEAK = -4.0

    def resolved(self, tokens: list[tuple], nodes: list[tuple[int, tuple[str, ...]]]) -> list[tuple[int, tuple[str, ...]]]:
        """The containers with names by their heads, and with the features of their own text outside content elements."""
        prose, told = structure(tokens, nodes)
        out: list[tuple[int, tuple[str, ...]]] = []
        inside = [False] * len(nodes)
        for k, (parent, marks) in enumerate(nodes):
            kept = tuple(dict.fromkeys(f for m in marks for f in self.named(m, prose[k])))
            inside[k] = k > 0 and inside[parent] or any(self.get(f, 0.0) >= 1 for f in kept)
            out.append((parent, kept))
        holds = list(inside)  # an element around a content element is none of the short ones
        for k in range(len(nodes) - 1, 0, -1):
            holds[nodes[k][0]] |= holds[k]
        return [(p, marks if holds[k] else (*marks, *told[k])) for k, (p, marks) in enumerate(out)]

    def named(self, mark: str, prose: bool) -> tuple[str, ...]:
        """The features that a name stands for."""
        if mark.startswith("<") or "-" not in mark:
            return (mark,)
        parts = mark.split("-")
        if parts[0] in RELATIONS:
            return ()
        core = parts[: max((i + 1 for i, w in enumerate(parts) if w not in LAYOUT), default=len(parts))]
        if self.get(core[-1], 0.0) or len(core) == 1:
            return (core[-1],)
        rest = [self.get(w, 0.0) for w in core[:-1]]
        if min(rest) < 0:
            return () if prose else ("~before",)
        return tuple(w for w, x in zip(core, rest, strict=False) if x > 0)

    def judged(self, nodes: list[tuple[int, tuple[str, ...]]]) -> list[tuple[float, bool]]:
        """Per container: the sum over the distinct features on its way to the page, and whether one is telling of content."""
        odds, telling, out = 0.0, 0, []
        for new, gone, _ in _walk(nodes):
            for sign, features in ((-1, gone), (1, new)):
                for f in features:
                    odds += sign * self.get(f, 0.0)
                    telling += sign * (self.get(f, 0.0) >= 1)
            out.append((round(odds, 6), telling > 0))
        return out

    def unmarked(self, tokens: list[tuple], nodes: list[tuple[int, tuple[str, ...]]]) -> list[tuple[int, tuple[str, ...]]]:
        """The containers, those without their marks that are named as boilerplate but hold the page.

        Such a one has more than half of the page's words, and an element inside that is
        telling of content and not of boilerplate has half of its.
        """
        own = [[self.get(f, 0.0) for f in marks] for _, marks in nodes]
        if not any(sum(x) < 0 for x in own):
            return nodes
        words = [0] * len(nodes)
        for t in tokens:
            if t[0] == "text":
                words[t[3]] += len(t[1].split())
        content = [0] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            parent = nodes[k][0]
            words[parent] += words[k]
            good = words[k] if sum(own[k]) >= 0 and max(own[k], default=0.0) >= 1 else content[k]
            content[parent] = max(content[parent], good)
        return [(p, () if sum(own[k]) < 0 and 2 * words[k] > words[0] and 2 * content[k] >= words[k] else marks) for k, (p, marks) in enumerate(nodes)]


def best_region(tokens: list[tuple], judged: list[tuple[float, bool]], weights: Weights, tag_cost: float = 0.02, link_cost: float = 0.5) -> tuple[int, int]:
    """[first, last) of the tokens with the largest sum, by one linear scan; of equal ones the first.

    A tag costs little by itself, so that a block of one word still pays for its
    tags; links cost more, and boilerplate elements what they have learnt. Inside
    a content element, boilerplate costs nothing: it is left out of the text, and
    what follows it there still belongs to the region.
    """
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores(tokens, judged, weights, tag_cost, link_cost)):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, region = total, (first, i + 1)
    return region


def scores(tokens: list[tuple], judged: list[tuple[float, bool]], weights: Weights, tag_cost: float = 0.02, link_cost: float = 0.5) -> Iterator[float]:
    """What each token adds to a region."""
    for t in tokens:
        odds, inside = judged[t[3]]
        if t[0] == "text":
            n = len(t[1].split())
            yield n if odds >= 0 else 0 if inside else -n
        else:
            learnt = 0.0 if inside or not t[2] else min(0.0, sum(weights.get(f, 0.0) for f in t[1]))
            yield learnt - (link_cost if t[1][0] == "<a>" else tag_cost)


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    tokens, nodes = runs(page or "")
    judged = weights.judged(weights.unmarked(tokens, weights.resolved(tokens, nodes)))
    first, last = best_region(tokens, judged, weights)
    blocks: dict[int, list[str]] = {}
    for t in tokens[first:last]:
        if t[0] == "text" and judged[t[3]][0] >= 0:
            blocks.setdefault(t[2], []).append(t[1])
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


# Labelled pages -------------------------------------------------------------

#: Words of class and id names around content and around boilerplate, for the labelled pages.
CONTENT_NAMES = "article content entry post story text body main page single copy chapter prose".split()
BOILERPLATE_NAMES = (
    "ad advert advertisement sponsor sponsored promo promotion banner nav navigation menu navbar breadcrumb sidebar widget rail related recommended "
    "trending popular share sharing social follow cookie consent notice gdpr alert newsletter subscribe signup popup modal overlay footer copyright "
    "legal masthead topbar toolbar login search form comment respond reply discussion disqus feedback rating pagination pager tag hidden skip"
).split()
BOILERPLATE_TAGS = "nav footer aside form header menu dialog button fieldset".split()
CONTENT_TAGS = "article main section blockquote figure".split()


def labelled_pages(spark: SparkSession, copies: int = 2) -> DataFrame:
    """(html, content): pages made by rule, each name and element in its usual role; ``content`` is the true text."""
    text = "It was a long day and the people of the town had much to say about it number {}"
    pages = []
    for k in range(copies):
        for i, (bad, element) in enumerate([*((b, False) for b in BOILERPLATE_NAMES), *((b, True) for b in BOILERPLATE_TAGS)]):
            good = CONTENT_NAMES[(i + k) % len(CONTENT_NAMES)]
            tag = CONTENT_TAGS[(i + k) % len(CONTENT_TAGS)]
            line = [text.format(f"{k} {i} {j}") for j in range(4)]
            other = f"<ul><li>Some other words {k} {i}</li></ul>"
            boiler = f"<{bad}>{other}</{bad}>" if element else f'<div {("class", "id")[k % 2]}="{bad}">{other}</div>'
            body = f"<p>{line[0]}</p><p>{line[1]}</p>" + boiler * (k % 2) + f"<ul><li>{line[2]}</li></ul>"
            where = f'<div class="{good}">{body}</div>' if i % 2 else f"<{tag}>{body}</{tag}>"
            pages.append((f"<html><body>{boiler}<div>{where}</div>{boiler}</body></html>", "\n".join(line[:3])))
        # Without names: a list of links, a short note with a button, a line of rights.
        menu = "<div><ul>" + "".join(f'<li><a href="/{k}{j}">Other {j}</a></li>' for j in range(5)) + "</ul></div>"
        note = f"<div><p>Some other words {k}</p><button>Go</button></div>"
        rights = f"<div><p>&copy; 20{k:02} Some other words</p></div>"
        text_only = [text.format(f"{k} none {j}") for j in range(4)]
        for before, after in ((menu, rights), (note, menu), (menu + note, rights + menu)):
            body = "".join(f"<p>{x}</p>" for x in text_only[:2]) + "".join(f"<ul><li>{x}</li></ul>" for x in text_only[2:])
            pages.append((f"<html><body>{before}<div><div>{body}</div></div>{after}</body></html>", "\n".join(text_only)))
    return spark.createDataFrame(pages, "html string, content string")


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for page, content in zip(b["html"].to_pylist(), b["content"].to_pylist(), strict=True):
            true = set((content or "").split("\n"))
            tokens, nodes = runs(page or "")
            nodes = [(p, (*marks, *own)) for (p, marks), own in zip(nodes, structure(tokens, nodes)[1], strict=True)]
            features = [[f for f, n in count.items() if n] for _, _, count in _walk(nodes)]
            for t in tokens:
                if t[0] == "text" and t[1].strip():
                    inside = " ".join(entities.unescape(t[1]).split()) in true
                    found += [(f, inside) for f in features[t[3]]]
        f, inside = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(inside, pa.bool_())], names=["feature", "inside"])


def train(labelled: DataFrame, smoothing: float = 0.5, most: float = 40.0, features: int = 10_000) -> Weights:
    """Weights from labelled pages (html, content).

    Counts are summed by Spark; the ``features`` most frequent reach the driver.
    A feature seen only outside content is scaled to outweigh content around it.
    """
    counts = (
        labelled.select("html", "content").mapInArrow(_observe, "feature string, inside boolean")
        .groupBy("feature").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(features).collect()
    )
    weights = Weights()
    for r in counts:
        odds = log((r["inside"] + smoothing) / (r["outside"] + smoothing))
        weights[r["feature"]] = max(-most, odds * 8) if odds < -1 else min(max(odds, 0.0), 2.0)
    weights["~before"] = Weights.WEAK
    return weights


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(p.as_py(), weights) for p in b["html"]]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``pages`` table, with weights from the labelled pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_pages(spark)))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
