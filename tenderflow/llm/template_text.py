"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A page is a row of tokens: structure (the path of an opened container) and text (a block with its path), those of the article too. Tokens
of a host whose occurrence vectors over its pages are equal form a class: the exclusive-or of a hash of (page, count) stands for the
vector, so a host of a third of all pages is added up in parts. Pages of equal html count once. A class is valid where it has `LEAST_SIZE`
tokens on `LEAST_PAGES` pages, whatever part of the host that is, so each layout of a host has a template of its own. On every page its
tokens have to come in one order, over and over where they repeat; tokens out of it leave the class. Texts nest in containers: a text
is fixed where one of the containers around it is of its own class, for it then stands wherever that container does.

What the template does not fix are the slots of a page. `article` and `main` say which slots are the article; a page without them
gives all slots outside menus, forms and the like. A valid class of texts alone, without a container of its own, can be the menu of a layout as
well as a passage of copies of an article. It is taken for template outside the article only where it fills its container and that is not
the one with most of the page's text.

A line that articles share is the article's, so inside it a fixed text is dropped only with a container that the template gives it: one
below the article with a class, of the text's own class of tokens, filled with such texts and not the one with most of the text. Where words of a
container's class or id tell it aside, a valid class is enough; without the template these words do nothing inside an article. A form is set aside unless it holds the article, or at least half of the text; its fields always are.

A block ends where a block element starts or ends; a line break is white space. An element without text of its own (select, svg) that is
never closed is skipped as a tag alone. Null or empty html, and a page without text, give an empty text. A null url is a host of its own, as is
every host with fewer pages than a class needs: they have no template. Each row gives a row. Only id, url and html are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import stored, table
from tenderflow.llm.tokens import in_batches

#: A class is valid with so many tokens, on so many pages.
LEAST_SIZE, LEAST_PAGES = 3, 3
#: Template tokens that are sent to every executor, at most; beyond it, pages are joined with their host's by a shuffle.
BROADCAST_TOKENS = 500_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|</?[a-zA-Z][^<>]*>|<(?=[a-zA-Z/])[^<]*\Z", re.S)
MARKS = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "title", "textarea", "select", "xmp"}
CONTAINERS = {
    "html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "dl", "table",
    "thead", "tbody", "tfoot", "tr", "blockquote", "figure", "details", "dialog", "menu", "fieldset", "center", "button", "label",
}
BLOCKS = CONTAINERS - {"label", "button"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "dt", "dd", "address", "figcaption", "caption", "summary", "legend", "option"}
SPACED = {"br", "td", "th", "img", "input", "wbr"}
ASIDE_TAGS = {"head", "nav", "footer", "aside", "dialog", "menu", "button", "fieldset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "status"}
ASIDE_WORDS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay",
    "sidebar", "side", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "copyright", "legal", "toolbar", "login", "signup", "search",
    "comment", "comments", "reply", "replies", "respond", "disqus", "discussion",
}


def marks_of(attributes: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in MARKS.finditer(attributes)}


def set_aside(tag: str, marks: dict[str, str], in_article: bool, in_form: bool) -> tuple[bool, bool]:
    """Whether tag or state set a container aside, and whether the words of its class and id would."""
    by_tag = tag in ASIDE_TAGS or tag == "header" and not in_article or tag == "label" and in_form
    hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
    if by_tag or hidden or tag != "form" and marks.get("role") in ASIDE_ROLES:
        return True, False
    if tag in ("html", "body", "main", "form"):
        return False, False
    words = set(re.split(r"[^a-z]+", f"{marks.get('class', '')} {marks.get('id', '')}"))
    if tag in ("article", "header"):
        words &= {"comment", "comments", "reply", "replies", "ad", "advert", "sponsored"}
    return False, bool(words & ASIDE_WORDS)


class Open(NamedTuple):
    """An open container. `named`: words of a class or id inside the article tell it aside. `form`: the outermost form around."""

    tag: str
    path: str
    at: int
    article: bool
    aside: bool
    named: bool
    form: int


class Block(NamedTuple):
    text: str
    at: int
    around: Open


def ends(html: str, tag: str) -> dict[int, int]:
    """Where each element of a tag ends, by the end of its opening tag; an element that is never closed is not there."""
    out, started = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*(?:>|\Z)", html, re.I):
        if not m[1]:
            if not m[0].rstrip(">").endswith("/"):
                started.append(m.end())
        elif started:
            out[started.pop()] = m.end()
    return out


def read(html: str) -> tuple[list[Open], list[Block]]:
    """Containers and blocks with text, both in page order; `at` counts them together."""
    opened: list[Open] = []
    found: list[Block] = []
    stack = [Open("", "", 0, False, False, False, 0)]
    text: list[str] = []
    closed: dict[str, dict[int, int]] = {}
    place = 0

    def close() -> None:
        nonlocal place
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                place += 1
                found.append(Block(block, place, stack[-1]))
            text.clear()

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if m[3].rstrip().endswith("/"):
                continue
            if tag in ("script", "style"):
                closing = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = closing.end() if closing else end
            else:
                if tag not in closed:
                    closed[tag] = ends(html, tag)
                at = closed[tag].get(at, at)
            continue
        if tag in BLOCKS:
            close()
        elif tag in SPACED:
            text.append(" ")
        if tag not in CONTAINERS:
            continue
        if m[1]:
            if any(x.tag == tag for x in stack):
                if tag not in BLOCKS:
                    close()
                while stack.pop().tag != tag:
                    pass
        else:
            if tag not in BLOCKS:
                close()
            if tag == "li" and stack[-1].tag == "li":
                stack.pop()
            up = stack[-1]
            marks = marks_of(m[3]) if m[3] else {}
            name = tag + ("." + marks["class"].replace(" ", ".") if marks.get("class") else "")
            aside, words = set_aside(tag, marks, up.article or tag in ("article", "main"), bool(up.form))
            place += 1
            form = up.form or (place if tag == "form" else 0)
            # Words count at once outside the article; inside, only together with the template.
            aside, named = up.aside or aside or words and not up.article, up.named or words and up.article
            stack.append(Open(tag, f"{up.path}/{name}", place, up.article or tag in ("article", "main"), aside, named, form))
            opened.append(stack[-1])
    close()
    return opened, found


def candidates(found: list[Block]) -> tuple[list[Block], bool]:
    """Blocks that tags and state leave for the text, and whether they are those of an article."""
    free = [x for x in found if not x.around.aside]
    article = [x for x in free if x.around.article]
    own = article or free
    total = sum(len(x.text) for x in own)
    chars: dict[int, int] = defaultdict(int)
    for x in own:
        chars[x.around.form] += len(x.text)
    kept = [x for x in own if not x.around.form or 2 * chars[x.around.form] >= total]
    return kept, bool(article)


def token(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest("\x00".join(parts).encode("utf-8", "replace")), "big", signed=True)


def page_tokens(html: str) -> dict[tuple[int, int], list[int]]:
    """Places of each (token, kind). Kinds: 0 structure, 1 text set aside, 2 text of the article, 3 text that a class without a container can fix."""
    own: dict[tuple[int, int], list[int]] = defaultdict(list)
    opened, found = read(html)
    for x in opened:
        own[(token(x.path), 0)].append(x.at)
    kept, article = candidates(found)
    asked = {x.at for x in kept}
    for x in found:
        own[(token(x.around.path, x.text), (2 if article and not x.around.named else 3) if x.at in asked else 1)].append(x.at)
    return own


def occurrences(pages: DataFrame, html: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0)
            for part in in_batches(batch.column(1)):
                rows = []
                for i, page in enumerate(part.texts, part.first):
                    if page:
                        host, own = hosts[i].as_py(), token(page)
                        rows += [(host, own, *key, places) for key, places in page_tokens(page).items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["host", "page", "token", "kind", "places"])

    return pages.select("_host", html).where("_host IS NOT NULL").mapInArrow(run, "host long, page long, token long, kind int, places array<int>")


def templates(pages: DataFrame, html: str, least_pages: int = LEAST_PAGES, least_size: int = LEAST_SIZE) -> DataFrame:
    """(host, tokens, classes): the tokens of each host's valid classes; a class is named by its vector."""
    # A text can be of one kind on one page and of another on the next; its vector is that of the text.
    seen = stored(occurrences(pages, html), "seen")
    # Equal pages, and repeated rows, once.
    once = seen.groupBy("host", "token", "page").agg(F.max("kind").alias("kind"), F.max(F.size("places")).alias("n"))
    vectors = once.groupBy("host", "token").agg(
        F.max("kind").alias("kind"), F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
    )
    vectors = stored(vectors.where(F.col("pages") >= least_pages), "vectors")
    sizes = vectors.groupBy("host", "vector").agg(F.count("*").alias("size"))
    sizes = sizes.where(F.col("size") >= least_size).select(F.col("host").alias("_h"), F.col("vector").alias("_v"), "size")
    held = stored(vectors.join(sizes, (F.col("host") == F.col("_h")) & (F.col("vector") == F.col("_v"))).select("host", "token", "kind", "vector", "size"), "held")
    small = held.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    of = held.select(F.col("host").alias("_h"), F.col("token").alias("_t"), "vector", "size")
    of = F.broadcast(of) if small else of
    # The tokens of a class in page order. Their order repeats with its size; a rank is the place in it.
    rows = seen.join(of, (F.col("host") == F.col("_h")) & (F.col("token") == F.col("_t"))).select("host", "vector", "size", "page", "token", F.explode("places").alias("place"))
    in_page = rows.distinct().groupBy("host", "vector", "size", "page").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("row"))
    ranks = in_page.select("host", "vector", "size", F.posexplode("row").alias("i", "x"))
    ranks = ranks.select("host", "vector", F.col("x.token").alias("token"), F.pmod("i", F.col("size").cast("int")).alias("rank"))
    ordered = ranks.groupBy("host", "vector", "token").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low = high")
    ordered = stored(ordered.select("host", "vector", "token"), "ordered")
    still = ordered.groupBy("host", "vector").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    still = still.select(F.col("host").alias("_h"), F.col("vector").alias("_v"))
    valid = ordered.join(still, (F.col("host") == F.col("_h")) & (F.col("vector") == F.col("_v"))).drop("_h", "_v")
    kinds = held.select(F.col("host").alias("_h"), F.col("token").alias("_t"), "kind")
    told = stored(valid.join(kinds, (F.col("host") == F.col("_h")) & (F.col("token") == F.col("_t"))).select("host", "token", "vector", "kind"), "valid")
    # Copies of articles make classes of texts of the article alone, which are not asked for.
    bound = told.where("kind = 0").select(F.col("host").alias("_h"), F.col("vector").alias("_v")).distinct()
    inside = told.where("kind = 2").join(bound, (F.col("host") == F.col("_h")) & (F.col("vector") == F.col("_v"))).select(*told.columns)
    told = told.where("kind IN (0, 3)").unionByName(inside)
    return stored(told.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("classes")), "templates")


def slots(html: str, classes: dict[int, int]) -> list[str]:
    """Texts of the slots of the article, or of all that is not set aside where the page has no article."""
    opened, found = read(html)
    kept, article = candidates(found)
    if not classes:
        return [x.text for x in kept]
    around: dict[str, set[int]] = {"": set()}

    def classes_around(path: str) -> set[int]:
        """Classes of the containers around a text; of an article's text, of those below the article that have a class attribute."""
        if path not in around:
            up, _, name = path.rpartition("/")
            own = classes.get(token(path))
            if article and name.partition(".")[0] in ("article", "main"):
                around[path] = set()
            else:
                around[path] = classes_around(up) | ({own} if own is not None and (not article or "." in name) else set())
        return around[path]

    own = [classes.get(token(x.around.path, x.text)) for x in kept]
    # Containers that hold more than texts of classes, and the one with most of the text.
    mixed = {x.around.at for x, c in zip(kept, own, strict=True) if c is None}
    chars: dict[int, int] = defaultdict(int)
    for x in kept:
        chars[x.around.at] += len(x.text)
    main = max(chars, key=lambda at: (chars[at], -at), default=0)

    def fixed(x: Block, c: int | None) -> bool:
        if c is None:
            return False
        inside, filled = c in classes_around(x.around.path), x.around.at not in mixed and x.around.at != main
        if article:
            return x.around.named and x.around.at != main or inside and filled
        return inside or filled

    return [x.text for x, c in zip(kept, own, strict=True) if not fixed(x, c)]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **limits) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    df = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.when(host != "", host).alias("_host"))
    df = df.withColumn("_host", F.when(F.col("_host").isNotNull(), F.xxhash64("_host")))
    fixed = templates(df, "html", **limits).select(F.col("host").alias("_of"), "tokens", "classes")
    n = fixed.agg(F.sum(F.size("tokens"))).first()[0] or 0
    joined = df.join(F.broadcast(fixed) if n <= BROADCAST_TOKENS else fixed, F.col("_host") == F.col("_of"), "left").select("page_id", "url", "tokens", "classes", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, named = batch.column(2), batch.column(3)
            for part in in_batches(batch.column(4)):
                texts = []
                for i, page in enumerate(part.texts, part.first):
                    classes = dict(zip(known[i].as_py() or (), named[i].as_py() or (), strict=True)) if page else {}
                    texts.append("\n".join(slots(page, classes)) if page else "")
                own = batch.slice(part.first, len(part.texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
