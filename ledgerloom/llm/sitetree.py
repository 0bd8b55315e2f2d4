"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a block element at a place, told by what its
way from the root looks like (tag, class, id and role without digits); its presentations are the
sequences of blocks that it has had below it, its contents the texts that stood in it. Both give an
entropy over the host's pages: presentations that vary say content, texts that come again on page
after page say furniture of the site. With m pages that have a node, l presentations, of which c_i pages have
the i-th, and texts that k_j pages have each:

    presentation = - sum(c_i / m * log_m(c_i / m))
    content      = 1 - sum(k_j * log_m(k_j)) / sum(k_j)      (of a branch: the mean over what is in it)
    importance   = (1 - 0.9 ** l) * presentation + 0.9 ** l * content

A branch of low importance is taken off every page of its host. Equal pages of a host count once.

What markup says of itself needs no statistics and holds on a host's only page too: branches that
are named as a menu, header, footer, sidebar, notice, advert, form or comments have no importance, and
where a page has an article (or else a main part), what is outside of it has none either. Within an
article a heading or paragraph without a name is never a branch to be taken off, and where the article as
a whole is of low importance (all pages of the host have the same one) nothing in it is. A page that
would lose all its text keeps it.

Scale: the pass over the pages gives digests only, a few hundred bytes a page; presentations and texts
are counted by (host, node, digest), so a host with most of the pages is counted in many tasks. The
second pass joins each page with its host's low nodes, of which there are as many as a site has templates.
No page is shuffled for the statistics.

Defined cases: null or empty html has an empty text. A null url, or one without a host, has no tree of
its own: only markup decides. Repeated rows give repeated results and count as one page. Null page ids
are kept. An empty table gives an empty result. A very long page is read whole. Other columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import map_texts, staged
from ledgerloom.llm.dom import BLOCKS, Element, parse

LOW = 0.3
LEAST_PAGES = 3
DAMPING = 0.9

# Markup that says what it is.
#: Elements without text of the page.
SILENT = frozenset("script style noscript template head title iframe svg canvas object audio video map datalist noframes noembed math xmp".split())
#: Elements that are furniture of the page by their name alone.
FURNITURE = frozenset("nav aside footer form button select option optgroup textarea dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words in a class or id that say furniture.
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager footer foot sidebar aside rail masthead topbar toolbar "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner popup modal overlay "
    "cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription signup signin login register "
    "search share sharing social related recommended recommendations comment comments commentlist reply replies disqus respond discussion widget widgets".split())
HEADER_WORDS = frozenset("header head".split())
#: A class that begins like this tells how the page is laid out, not what the element is.
LAYOUT = frozenset("no not with without has is show hide".split())
_ARTICLE = re.compile(r"(article|post|entry|story)([-_]?(body|content|text|main))?$")
_MAIN = re.compile(r"(main|content|main[-_]?content)$")
#: Blocks that a text runs through, one like the next; others of one kind are told apart by their number.
FLOW = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd tr blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EDGES = BLOCKS | {"body", "html", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}


@lru_cache(maxsize=20_000)
def _kind(tag: str, names: str, role: str) -> str:
    """What an element's markup says: furniture, header, article, main or nothing."""
    if tag in FURNITURE or role in ROLES:
        return "furniture"
    classes = names.split()
    if tag in ("html", "body"):
        return ""
    header = tag == "header"
    for name in classes:
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not words or words[0] in LAYOUT:
            continue
        if not FURNITURE_WORDS.isdisjoint(words):
            return "furniture" if tag not in ("article", "main") or "comment" in words or "ad" in words else ""
        header = header or not HEADER_WORDS.isdisjoint(words)
    if tag == "article" or role == "article" or any(_ARTICLE.match(c.lower()) for c in classes):
        return "article"
    if tag == "main" or role == "main" or any(_MAIN.match(c.lower()) for c in classes):
        return "main"
    return "header" if header else ""


@lru_cache(maxsize=200_000)
def _digest(*parts) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=20_000)
def _look(tag: str, names: str) -> str:
    return f"{tag}.{re.sub('[0-9]+', '', names).lower()}"


class Block:
    """A run of text without a block's edge in it. way: the nodes of its elements from the root on; sparing: those of them that
    the tree may take off; part: the node of the article or main part around it; named: in a branch that is named as furniture; linked: all of it is links."""
    __slots__ = ("text", "way", "named", "article", "main", "linked", "sparing", "part")

    def __init__(self, text, way, named, article, main, linked, sparing, part):
        self.text, self.way, self.named, self.article, self.main, self.linked, self.sparing, self.part = text, way, named, article, main, linked, sparing, part


def _hidden(a: dict[str, str]) -> bool:
    return bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())


def read(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """A page's blocks in order, and (node, presentation) of its block elements."""
    blocks: list[Block] = []
    looks: list[tuple[int, int]] = []
    text: list[str] = []
    # State of an open block element: node, named as furniture, in an article, in main, all way nodes, nodes the tree may take off, part.
    state = (_digest("root"), False, False, False, (), (), None)
    linked = [0, 0]  # characters in links, all characters of the block

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append(Block(joined, state[4], state[1], state[2], state[3], linked[0] >= linked[1], state[5], state[6]))
        linked[0] = linked[1] = 0

    top = parse(html)
    stack: list = [(iter(top.kids), None, 0, {}, [])]
    links = 0
    while stack:
        kids, before, link, seen, order = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                text.append(kid)
                size = len(kid) - kid.count(" ")
                linked[0] += size if links else 0
                linked[1] += size
                if not order or order[-1] != "text":
                    if not kid.isspace():
                        order.append("text")
                continue
            tag = kid.tag
            if tag in SILENT or _hidden(kid.attributes):
                continue
            if tag == "br" or tag in ("td", "th", "img"):
                text.append(" ")
            if tag == "hr":
                flush()
                continue
            if tag not in EDGES:
                stack.append((iter(kid.kids), None, int(tag == "a"), seen, order))
                links += tag == "a"
                if tag in FURNITURE:  # a button or a choice in a line of text
                    stack.pop()
                break
            flush()
            names, role = kid.names(), kid.attributes.get("role", "")
            kind, look = _kind(tag, names, role), _look(tag, names)
            if kid.attributes.get("itemprop") == "articleBody":
                kind = "article"
            if not order or order[-1] != look:
                order.append(look)
            number = 0
            if tag not in FLOW and not names:
                number = seen[look] = seen.get(look, -1) + 1
            node = _digest(state[0], look, number)
            article, main = state[2] or kind == "article" and not state[1], state[3] or kind == "main" and not state[1]
            named = state[1] or kind == "furniture" or kind == "header" and not article
            plain = article and (kind == "article" or tag in FLOW and not names)
            outer = state
            part = kind in ("article", "main")
            state = (node, named, article, main, (*state[4], node), () if part else state[5] if plain else (*state[5], node), node if part else state[6])
            stack.append((iter(kid.kids), outer, 0, {}, []))
            break
        else:
            stack.pop()
            if before is not None:
                flush()
                looks.append((state[0], _digest("/".join(order))))
                state = before
            else:
                links -= link
            continue
    flush()
    return blocks, looks


def main_text(blocks: list[Block], low: frozenset[int]) -> str:
    """The texts of blocks that are neither named as furniture nor in a branch of low importance."""
    given = [b for b in blocks if not b.named]
    inner = [b for b in given if b.article] or [b for b in given if b.main]
    # Without an article, blocks of nothing but links are menus.
    given = inner or [b for b in given if not b.linked]
    left = [b for b in given if b.part in low or low.isdisjoint(b.sparing)] if low else given
    return "\n\n".join(b.text for b in left or given)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("host", pa.string()), ("page", pa.int64()), ("texts", pa.list_(pa.struct([("node", pa.int64()), ("text", pa.int64()), ("way", pa.list_(pa.int64()))]))),
                       ("looks", pa.list_(pa.struct([("node", pa.int64()), ("look", pa.int64())])))])
    for batch in batches:
        out = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks, looks = read(html)
            texts = dict.fromkeys((b.way, _text_digest(b.text)) for b in blocks if b.way)
            # A node that a page has several times counts once, with all its presentations together.
            own: dict[int, list[int]] = {}
            for node, look in looks:
                own.setdefault(node, []).append(look)
            whole = _text_digest("\x00".join(b.text for b in blocks))
            out.append((host, whole, [{"node": way[-1], "text": t, "way": list(way)} for way, t in texts],
                        [{"node": n, "look": x[0] if len(x) == 1 else _digest(*sorted(set(x)))} for n, x in own.items()]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds.field(i).type) for i in range(4)], schema=kinds)


def _text_digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def importances(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, node, pages, presentation, content, importance: the nodes of the hosts' trees that have texts below them."""
    given = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).filter("host != '' AND html IS NOT NULL")
    schema = "host string, page long, texts array<struct<node: long, text: long, way: array<long>>>, looks array<struct<node: long, look: long>>"
    seen = map_texts(given, _digests, schema)
    once = staged(seen.groupBy("host", "page").agg(F.first("texts").alias("texts"), F.first("looks").alias("looks")), "page-digests")

    def share(n: str) -> Column:
        return F.sum(F.col(n) * F.log(F.col(n).cast("double")))

    looks = once.select("host", F.inline("looks")).groupBy("host", "node", "look").agg(F.count(F.lit(1)).alias("c"))
    nodes = looks.groupBy("host", "node").agg(F.sum("c").alias("pages"), F.count(F.lit(1)).alias("kinds"), share("c").alias("s"))
    alone, log_m = F.col("pages") < 2, F.log(F.col("pages").cast("double"))
    nodes = staged(nodes.select("host", "node", "pages", "kinds", F.when(alone, 1.0).otherwise(1 - F.col("s") / (F.col("pages") * log_m)).alias("presentation")), "site-nodes")

    texts = once.select("host", F.inline("texts")).groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("k"), F.first("way").alias("way"))
    leaves = texts.groupBy("host", "node").agg(F.sum("k").alias("n"), share("k").alias("s"), F.first("way").alias("way"))
    leaves = leaves.join(nodes.select("host", "node", "pages"), ["host", "node"])
    own = F.when(alone, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("n") * log_m)))
    within = leaves.select("host", "n", own.alias("content"), F.explode("way").alias("node"))
    branches = within.groupBy("host", "node").agg((F.sum(F.col("n") * F.col("content")) / F.sum("n")).alias("content"))
    kept = F.pow(F.lit(DAMPING), F.col("kinds"))
    return nodes.join(branches, ["host", "node"]).select(
        "host", "node", "pages", "presentation", "content", ((1 - kept) * F.col("presentation") + kept * F.col("content")).alias("importance"))


def low_nodes(trees: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, low: the nodes that go, for each host that has any. Fewer than least_pages pages tell nothing of a node."""
    gone = trees.filter((F.col("importance") < low) & (F.col("pages") >= least_pages))
    return staged(gone.groupBy("host").agg(F.collect_list("node").alias("low")), "low-nodes")


def extracted(pages: DataFrame, low: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page, without its host's low branches and what its markup names as furniture."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))

    def run(batches):
        for batch in batches:
            texts = [main_text(read(h)[0], frozenset(low or ())) if h else "" for h, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = given.schema["page_id"].dataType.simpleString()
    return map_texts(given.join(low, "host", "left"), run, f"page_id {kind}, url string, text string, n_chars long")


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page, by the trees of all hosts among them."""
    return extracted(pages, low_nodes(importances(pages, url, html), low, least_pages), id_col, url, html)
