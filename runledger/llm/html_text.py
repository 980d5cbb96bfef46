"""HTML extraction by consensus host paths.

Every page scores its containers and votes for the generalised tag-class path of its best one; votes are summed
per host in Spark; pages are then extracted again from the container on their host's winning path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch, aliased, col, names, restored, schema_of
from runledger.llm.url_filters import host_of

#: A tag. Quotes count only after an equals sign, so a stray one cannot swallow the page.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
#: As TAG, up to the next ">", whatever is quoted, or to the page's end.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Elements whose content is read up to their own end tag and thrown away.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace".split())
CONTAINERS = frozenset("article body center content div main section story table tbody td".split())
#: Never part of a main text.
BOILER_TAGS = frozenset("aside button datalist dialog fieldset footer head menu nav object select svg template canvas audio video map".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words that make any class or id that has them boilerplate.
BOILER_NAMES = frozenset(
    "adbox adsense advert adverts advertisement advertising breadcrumb breadcrumbs commentlist consent cookie cookies disclaimer disqus footer gdpr"
    " masthead navbar navigation newsletter paywall popup sidebar topbar".split()
)
#: Words that do so alone or beside words of LAYOUT: ad-slot and site-search, but not ad-hoc or search-results.
BOILER_ALONE = frozenset(
    "ad ads alert announcement banner comment comments discussion feedback header hidden login menu modal nav notice notices notification overlay pager pagination popular promo promoted"
    " promotion recommended related replies reply respond search share sharing signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget widgets".split()
)
GOOD_NAMES = frozenset("article body content entry main page post story text".split())
#: Words that say where or how large an element is, not what it holds.
LAYOUT = GOOD_NAMES | frozenset(
    "area bar block bottom box button buttons card center col column container desktop div element fixed floating form global group holder horizontal icon icons id inline inner item items js large left level"
    " link links list logo media message mobile module outer pane panel posts primary reader right row secondary section site slot small space sticky stories thread title top unit user vertical wrap wrapper zone".split()
)
#: Words after which a class tells what an element holds or lacks, not what it is: with-sidebar, has-comments.
MODIFIERS = frozenset("has no with without".split())
SAFE_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Ends of an element that another start tag closes.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
OUTER = frozenset("body html div article main section".split())
SCOPES = frozenset("table td th ul ol dl body html".split())
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[^a-z]+")
#: Attributes that can mark an inline element as boilerplate.
MARKS = re.compile(r"class|id|role|hidden|style", re.I)
PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open block element. ``path`` numbers its path, ``form`` its form (0: none), ``container`` is itself or the nearest one around it."""

    __slots__ = ("tag", "path", "boiler", "parent", "in_link", "inside", "form", "container", "inline", "counts")

    def __init__(self, tag: str, path: int, boiler: bool, parent, in_link: bool, inside: bool, form: int):
        self.tag, self.path, self.boiler, self.parent, self.in_link, self.inside, self.form = tag, path, boiler, parent, in_link, inside, form
        self.container = self if tag in CONTAINERS else parent.container if parent else None
        #: Open inline elements as (tag, boilerplate, in a link), and how many there are of each tag.
        self.inline: list[tuple] = []
        self.counts: dict[str, int] = {}


class Page:
    """The blocks of a page in order as (text, block element), boilerplate left out, and its paths by number.

    A path is its parent's number and a step, so that memory follows the number of elements at any depth.
    """

    def __init__(self):
        self.found: list[tuple[str, Element]] = []
        self.up, self.steps, self.ids = [0], [""], {}
        #: Of each form: whether it stands right in the body or holds an article, and its characters of text.
        self.forms: list[list] = [[False, 0]]

    def number(self, up: int, step: str) -> int:
        if (n := self.ids.get((up, step))) is None:
            n = self.ids[up, step] = len(self.up)
            self.up.append(up)
            self.steps.append(step)
        return n

    def path(self, n: int) -> str:
        steps = []
        while n:
            steps.append(self.steps[n])
            n = self.up[n]
        return "".join(f">{s}" for s in reversed(steps))

    def at(self, path: str) -> int | None:
        n = 0
        for step in path.split(">")[1:]:
            if (n := self.ids.get((n, step))) is None:
                return None
        return n

    def within(self, n: int) -> list[bool]:
        """For each path, whether it is ``n`` or below; parents have smaller numbers."""
        hit = [False] * len(self.up)
        hit[n] = True
        for k in range(n + 1, len(hit)):
            hit[k] = hit[self.up[k]]
        return hit


_described: dict[tuple, tuple[str, bool]] = {}


def _describe(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """The generalised step of a path, and whether the element is boilerplate; the last few thousand answers are kept."""
    if (found := _described.get((tag, attrs, inside))) is None:
        if len(_described) > 1 << 14:
            _described.clear()
        found = _described_anew(tag, attrs, inside)
        if len(attrs) < 1000:
            _described[tag, attrs, inside] = found
    return found


def boilerplate(named: str, inside: bool) -> bool:
    """Whether a class or an id names something other than content; words after a modifier tell nothing of the element itself."""
    words = []
    for word in SPLIT.split(PARTS.sub("-", named).lower()):
        if word in MODIFIERS:
            break
        if word:
            words.append(word)
    if any(w in BOILER_NAMES for w in words):
        return True
    if not any(w in BOILER_ALONE for w in words) or not all(w in BOILER_ALONE or w in LAYOUT for w in words):
        return False
    # The header of an article itself ("entry-header") heads the text.
    return not (inside and "header" in words and any(w in GOOD_NAMES for w in words))


def _described_anew(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    own = tag in BOILER_TAGS or (tag == "header" and not inside)
    if not attrs or attrs.isspace():
        return tag, own
    found = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    classes = found.get("class", "").split()
    step = tag + "".join(f".{c}" for c in sorted(DIGITS.sub("#", c).replace(">", "") for c in classes))
    if own or found.get("role", "").lower() in BOILER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return step, tag not in ("html", "body")
    return step, tag not in SAFE_TAGS and any(boilerplate(c, inside) for c in [*classes, *found.get("id", "").split()])


def read(page: str) -> Page:
    """The page's blocks; white space is single, text that follows an unclosed inline element counts for the block around it.

    Time and memory follow the page's length, however deep or broken it is. A form is boilerplate unless it frames the page:
    it holds more than half of all text, and stands right in the body or holds an article or main.
    """
    out = Page()
    root = Element("#", 0, False, None, False, False, 0)
    stack, text, at, begin, owner = [root], [], 0, 0, root
    # Open elements of each tag, in the page and in each open table, cell and list: an end tag without a start costs nothing.
    everywhere: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]
    loose, length, find, strict, unescape = False, len(page), page.find, TAG.match, html.unescape

    def flush():
        if own := " ".join("".join(text).split()):
            out.found.append((own, owner))
            out.forms[owner.form][1] += len(own)
        text.clear()

    def close(k: int):
        for e in reversed(stack[k:]):
            everywhere[e.tag] -= 1
            if e.tag in SCOPES:
                scopes.pop()
            else:
                scopes[-1][e.tag] -= 1
        del stack[k:]

    while True:
        i = find("<", at)
        top = stack[-1]
        boiler = top.inline[-1][1] if top.inline else top.boiler
        if i < 0 or i + 1 >= length:
            if not boiler:
                text.append(unescape(page[begin:]))
            break
        m, cdata, second = None, None, page[i + 1]
        if second in "!?" or (second == "/" and not page[i + 2 : i + 3].isalpha()):
            close_by, skip = ("-->", 4) if page.startswith("!--", i + 1) else ("]]>", 9) if page.startswith("![CDATA[", i + 1) else (">", 1)
            stop = find(close_by, i + skip)
            if skip == 9:
                cdata = page[i + 9 : stop if stop >= 0 else length]
            stop = stop + len(close_by) if stop >= 0 else length
        elif second == "/" or (second.isascii() and second.isalpha()):
            if not loose and (m := strict(page, i)) is None:
                loose = True  # a value's quote is never closed: from here on quotes do not count
            if m is None:
                m = LOOSE.match(page, i)
            if m is None:
                at = i + 1
                continue
            stop = m.end()
        else:
            at = i + 1
            continue
        if not boiler and i > begin:
            chunk = page[begin:i]
            text.append(unescape(chunk) if "&" in chunk else chunk)
        begin = at = stop
        if m is None:
            if cdata and not boiler:
                text.append(cdata)
            continue
        end, tag, attrs = m.groups()
        tag = tag.lower()
        if tag in INLINE:
            if end:
                if top.counts.get(tag):
                    while True:
                        gone = top.inline.pop()[0]
                        top.counts[gone] -= 1
                        if gone == tag:
                            break
            elif tag not in VOID:
                marked = boiler or (bool(attrs) and MARKS.search(attrs) is not None and _describe(tag, attrs, top.inside)[1])
                in_link = tag == "a" or (top.inline[-1][2] if top.inline else top.in_link)
                top.inline.append((tag, marked, in_link))
                top.counts[tag] = top.counts.get(tag, 0) + 1
            continue
        if tag == "br":
            if not boiler:
                text.append(" ")
            continue
        if end:
            if not everywhere.get(tag) or (tag not in SCOPES and tag not in OUTER and not scopes[-1].get(tag)):
                continue
            if text:
                flush()
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            close(k)
            owner = stack[-1]
            continue
        if tag in RAW:
            ends = RAW[tag].search(page, at)
            stop = find(">", ends.end()) if ends else -1
            begin = at = stop + 1 if stop >= 0 else length
            continue
        if tag in VOID and tag != "hr" or (tag == "form" and top.form):
            continue
        if text:
            flush()
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k].tag
            if open_tag in CLOSES and tag in CLOSES[open_tag]:
                close(k)
                break
            if open_tag not in CLOSES or open_tag in SCOPES:
                break
        owner = up = stack[-1]
        if tag == "hr":
            continue
        boiler, in_link = up.inline[-1][1:] if up.inline else (up.boiler, up.in_link)
        step, own_boiler = _describe(tag, attrs, up.inside)
        form = up.form
        if tag == "form":
            form = len(out.forms)
            out.forms.append([up.tag in ("#", "html", "body"), 0])
        elif form and tag in ("article", "main"):
            out.forms[form][0] = True
        # html and body may be left out, and a body's classes describe the page: neither is a step.
        path = up.path if tag in ("html", "body") else out.number(up.path, step)
        owner = Element(tag, path, boiler or own_boiler, up, in_link, up.inside or tag == "article" or tag == "main", form)
        stack.append(owner)
        everywhere[tag] = everywhere.get(tag, 0) + 1
        if tag in SCOPES:
            scopes.append({tag: 1})
        else:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
    flush()
    total = sum(f[1] for f in out.forms)
    frames = [not k or (f[0] and 2 * f[1] > total) for k, f in enumerate(out.forms)]
    if not all(frames):
        out.found = [(own, e) for own, e in out.found if frames[e.form]]
    return out


def scores(page: Page) -> list[tuple[float, Element]]:
    """Containers by score: a block's characters count for its container, and half for the container above. Of equal ones the first comes first."""
    points: dict[int, list] = {}
    for own, e in page.found:
        size = (0.4 if e.in_link or e.tag in ("li", "dt", "dd") else 1.0) * len(own)
        if c := e.container:
            points.setdefault(id(c), [c, 0.0])[1] += size
            if c := c.parent.container:
                points.setdefault(id(c), [c, 0.0])[1] += 0.5 * size
    bonus = lambda e: 1.3 if e.tag in ("article", "main") or GOOD_NAMES & set(SPLIT.split(page.steps[e.path].lower())) - {e.tag} else 1.0
    return sorted(((p * bonus(e), e) for e, p in points.values()), key=lambda x: (-x[0], x[1].path))


def best(page: Page) -> tuple[int | None, float]:
    """The path of the best container, and its share of all points.

    An article that holds it stands in for it, so that title, lead and sibling containers stay. So does a main without an
    article in between, unless most of the rest of it is links and list items.
    """
    ranked = scores(page)
    total = sum(s for s, _ in ranked)
    if not total:
        return None, 0.0
    score, top = ranked[0]
    e = top
    while e is not None and e.tag not in ("article", "main"):
        e = e.parent
    if e is None or e is top:
        return top.path, score / total
    if e.tag == "main":
        around, below = page.within(e.path), page.within(top.path)
        rest = [(len(own), x) for own, x in page.found if around[x.path] and not below[x.path]]
        if 2 * sum(n for n, x in rest if x.in_link or x.tag in ("li", "dt", "dd")) > sum(n for n, _ in rest):
            return top.path, score / total
    return e.path, score / total


def main_text(page: str, path: str | None) -> str:
    """The blocks of the outermost elements on ``path``; of the page's own best container if none is there."""
    p = read(page)

    def text(n: int | None) -> list[str]:
        if n is None:
            return []
        hit = p.within(n)
        return [own for own, e in p.found if hit[e.path]]

    return " ".join(text(p.at(path) if path else None) or text(best(p)[0]) or [own for own, _ in p.found])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path, score = [], [], []
        for h, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            page = read(text.as_py())
            top, share = best(page)
            if top:
                host.append(h.as_py())
                path.append(page.path(top))
                score.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [main_text(p.as_py(), w.as_py()) if p.is_valid else "" for p, w in zip(batch.column("page"), batch.column("path"), strict=True)]
        keep = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(own, pa.string())], names=[*keep, "text"])


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, votes): each host's winning path. Ties go by the summed score share, then by path."""
    votes = pages.select(host_of(col(url)).alias("host"), col(page).alias("html")).mapInArrow(_vote, "host string, path string, score double")
    summed = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 6).alias("score"))
    return summed.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), -F.col("score"), "path")).alias("w")).select("host", "w.path", "w.votes")


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (the main text) and ``n_chars`` (its code points).

    A null or empty page has an empty text. Pages without a host vote together as one host. Repeated rows each
    vote and are extracted alike. A column named text or n_chars is replaced; all others stay, whatever their names.
    """
    scratch = Scratch(pages.sparkSession, "paths")
    own = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    paths = scratch.write(host_paths(pages, url, page).select("host", "path"), "paths")
    rows = pages.select(col(page).alias("page"), host_of(col(url)).alias("at"), *aliased(own))
    joined = rows.join(paths, rows["at"] == paths["host"], "left").select("page", "path", *names(own))
    out = joined.mapInArrow(_extract, schema_of(pages, own, "text string"))
    return out.select(*restored(own), "text", F.length("text").cast("long").alias("n_chars"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
