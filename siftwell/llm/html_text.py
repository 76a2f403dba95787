"""Operator 7: main text of web pages by site template removal.

Every element's subtree (tags and text) is hashed. Spark counts on how many different pages of a host each hash occurs;
block-level subtrees that recur across a good part of the host's pages are its template and go. Pages that are copies
of each other count once. Within an article (or main) element subtrees are counted among the host's pages that have one,
apart from those outside; the element itself and what holds it are never template. Of what is left, elements whose tag,
class, id or role marks them as menu, header, footer, sidebar, notice, advert, form or comments go as well; within an
article only what no article's own parts are called. The main text is what the articles keep, if that is a third of all
that the page keeps, or else all of it: a teaser in an article element doesn't stand for the story beside it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, lean, read, scratch, settled

#: A subtree is template from so many different pages of a host on, and from such a part of them.
LEAST_PAGES, LEAST_PART = 5, 0.3

#: Quotes count after an equals sign only; nothing is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
#: An attribute's name, and its value in any of its three forms; what stands in one value is no attribute.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Only these can be template: not inline elements, headings, or pieces of lists and tables, whose container may go.
UNITS = (BLOCK | frozenset(("script", "style", "noscript", "iframe", "template"))) - frozenset("h1 h2 h3 h4 h5 h6 li dt dd caption figcaption summary tbody thead tfoot tr html body".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr"}
DROP = frozenset("head nav footer form script style noscript template iframe svg canvas button select textarea object embed dialog menu".split())
ARTICLE = frozenset(("article", "main"))
HINTS = frozenset("nav navbar navigation menu sidebar footer header masthead cookie cookies consent gdpr banner notice notices ad ads adv advert adverts advertisement sponsored promo comment comments commentlist disqus share sharing social related newsletter subscribe popup modal breadcrumb breadcrumbs widget toolbar pagination skip".split())
#: Of these, those that mark a part of an article, too; it may have a header of its own.
INNER_HINTS = HINTS - frozenset(("header", "masthead"))
#: Of these, those that mark a paragraph of an article; one that is called a notice or comment may be its own.
PARAGRAPH_HINTS = INNER_HINTS - frozenset("footer banner notice notices comment promo related widget toolbar modal popup skip".split())
#: What is a container can be judged by class and id; headings have ids made from their words, and are text in any case.
CONTAINERS = BLOCK - frozenset("h1 h2 h3 h4 h5 h6 p hgroup pre caption figcaption dt dd html body".split()) - ARTICLE
#: What the articles keep counts as the main text from such a part of what the page keeps.
ARTICLE_PART = 1 / 3
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "number")

    def __init__(self, tag: str, attrs: str, number: int):
        self.tag, self.attrs, self.parts, self.number = tag, attrs, [], number


def parse(page: str) -> Node:
    """A tree of elements; parts are nodes and text. Missing end tags are supplied, stray ones ignored."""
    root = Node("#root", "", 0)
    stack, at, count = [root], 0, 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(text)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",), BLOCK - {"p"})
        if tag == "li":
            _close(stack, ("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            _close(stack, ("dt", "dd"), frozenset(("dl",)))
        elif tag == "tr":
            _close(stack, ("tr",), frozenset(("table",)))
        elif tag in ("td", "th"):
            _close(stack, ("td", "th"), frozenset(("tr", "table")))
        elif tag == "option":
            _close(stack, ("option",), frozenset(("select",)))
        count += 1
        node = Node(tag, m[3], count)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)


def _close(stack: list[Node], tags: tuple[str, ...], barrier: frozenset[str]) -> None:
    """End the innermost open element of one of the tags, unless one of barrier was opened within it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in barrier:
            return


def subtrees(root: Node) -> list[tuple[int, bytes]]:
    """Number and hash of each element that could be template; and, first, 0 and the whole page's hash.

    The last bit of an element's hash tells whether it is in an article.
    """
    nodes, stack = [], [(root, False)]
    while stack:  # parents before their parts
        node, inside = stack.pop()
        nodes.append((node, inside))
        inside = inside or node.tag in ARTICLE
        stack += [(p, inside) for p in node.parts if not isinstance(p, str)]
    done: dict[int, tuple[bytes, bool]] = {}  # hash, and whether the subtree has an article
    out: list[tuple[int, bytes]] = []
    for node, inside in reversed(nodes):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        has = node.tag in ARTICLE
        for p in node.parts:
            if isinstance(p, str):
                words = " ".join(p.split())
                if words:
                    h.update(b"\x01" + words.encode())
            else:
                own, article = done.pop(p.number)
                h.update(b"\x02" + own)
                has = has or article
        digest = h.digest()
        done[node.number] = digest, has
        if node.tag in UNITS and not has:
            out.append((node.number, digest[:-1] + bytes([digest[-1] & 0xFE | inside])))
    return [(0, done[0][0]), *out]


def attributes(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name, of two with one name the first; those without a value are empty."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), a or b or c)
    return out


def marked(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id tell that it isn't main text. An article's own header and asides are part of it.

    Class and id count on containers, word by word; on a paragraph a class counts that is such a word as a whole. On
    headings and inline elements they count for nothing.
    """
    if node.tag in DROP or node.tag in ("header", "aside") and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body") or node.tag in ARTICLE:
        return False
    hints, known = INNER_HINTS if inside else HINTS, attributes(node.attrs)
    if not ROLES.isdisjoint(known.get("role", "").lower().split()):
        return True
    names = known.get("class", "").lower()
    if node.tag == "p":
        return not (PARAGRAPH_HINTS if inside else hints).isdisjoint(names.split())
    return node.tag in CONTAINERS and not hints.isdisjoint(re.split(r"[\s_\-:]+", f"{names} {known.get('id', '').lower()}"))


def main_text(root: Node, template: frozenset[int]) -> str:
    """Blocks joined by a line break, without template and marked elements."""
    blocks: list[tuple[bool, str]] = []
    run: list[str] = []

    def close(inside: bool) -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((inside, text))

    stack = [(root, iter(root.parts), False)]
    while stack:
        node, parts, inside = stack[-1]
        for p in parts:
            if isinstance(p, str):
                run.append(p)
                continue
            if p.number in template or marked(p, inside):
                continue
            if p.tag in BLOCK:
                close(inside)
            elif p.tag in ("br", "td", "th"):
                run.append(" ")
            stack.append((p, iter(p.parts), inside or p.tag in ARTICLE))
            break
        else:
            if node.tag in BLOCK:
                close(inside)
            stack.pop()
    close(False)
    own = sum(len(text) for inside, text in blocks if inside)
    only = own and own >= ARTICLE_PART * sum(len(text) for _, text in blocks)
    return "\n".join(text for inside, text in blocks if inside or not only)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_part: float = LEAST_PART) -> DataFrame:
    """page_id, url and text of every row. Null html is empty; pages without a host, or with a null url, share one.

    Rows that repeat a page_id each get a row. Only hashes are shuffled for counting, summed per task first, so that
    a host with many pages doesn't meet in one task; the pages themselves are shuffled once, by row. An empty table gives
    no row, very long pages take memory in proportion; other columns may have any names, and elements may be nested to any depth.
    """
    pages = settled(pages)
    arrow_limits(pages.sparkSession)
    keyed = pages.select(F.monotonically_increasing_id().alias("row_key"), "page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, host, page in zip(*(batch.column(c).to_pylist() for c in ("row_key", "host", "html")), strict=True):
                (_, whole), *rest = subtrees(parse(page))
                keys = [int.from_bytes(h, "big", signed=True) ^ host & ~1 for _, h in rest]
                rows.append((key, host, int.from_bytes(whole, "big", signed=True) ^ host, any(k & 1 for k in keys), [n for n, _ in rest], keys))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row_key", "host", "page", "article", "nodes", "keys"])

    # page and keys are hashes of the host and the whole page or subtree; article: whether any key is of one in an article
    found = scratch(keyed.select("row_key", F.xxhash64(host_of(F.col("url"))).alias("host"), "html").mapInArrow(lean(hashes), "row_key long, host long, page long, article boolean, nodes array<int>, keys array<long>"), "subtrees")
    different = found.groupBy("page").agg(F.first("host").alias("host"), F.first(F.array_distinct("keys")).alias("keys"))
    hosts = found.select("host", "page", "article").distinct().groupBy("host").agg(F.count("*").alias("pages"), F.count_if("article").alias("articles"))
    counts = different.select("host", F.explode("keys").alias("key")).groupBy("key").agg(F.first("host").alias("host"), F.count("*").alias("n")).where(F.col("n") >= least_pages)
    template = counts.join(hosts, "host").where(F.col("n") >= F.when(F.col("key").bitwiseAND(1) == 1, F.col("articles")).otherwise(F.col("pages")) * least_part).select("key")
    each = found.select("row_key", F.explode(F.arrays_zip("nodes", "keys")).alias("x")).select("row_key", F.col("x.nodes").alias("node"), F.col("x.keys").alias("key"))
    nodes = each.join(template, "key", "left_semi").groupBy("row_key").agg(F.collect_set("node").alias("nodes"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(parse(page), frozenset(nodes or ())) for page, nodes in zip(batch.column("html").to_pylist(), batch.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return keyed.join(nodes, "row_key", "left").select("page_id", "url", "html", "nodes").mapInArrow(lean(clean), f"page_id {kind}, url string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
