"""Main text of web pages with a site style tree.

Pages of one host share templates, so their document trees are merged: a style node is a path of block elements with their
classes, below a host. For each node two entropies are taken over the host's distinct pages, each over the logarithm of
its count: of the presentation (the sequence of an element's children) and of the content (the text of a block). Noise
looks alike on every page, so both are low for it. What a block shows is PRESENTATION_SHARE of its parent's presentation
entropy and the rest of its content entropy; its importance is the mean of that, once for each page, and of PRIOR_PAGES times
what is thought of it beforehand: 1, or 0 for a suspect. Blocks of LOW_OUTSIDE or less go (LOW_INSIDE within an article or
main element, LOW_SUSPECT for a suspect). So a host of few pages leans on the prior and one of many on its statistics.

Elements that are noise by what they are (menus, headers, footers, sidebars, forms, scripts) or by an unmistakable name always go:
a class token, an id or a role whose pieces are all in WORDS or GENERIC, one in WORDS at least (`comments`, `share-buttons`). An
element outside an article whose class or id only has such a piece (`search-results-analysis`) is a suspect; inside one it is
judged as any other. Where a page has an article or main element, only what stands in one is main text.

Pages are read twice: the first pass sends out node and content hashes only, the second removes the low nodes that join
back by host. Texts are never shuffled while the hosts' table is small enough to broadcast.

A null html is empty; of a page whose url is null or without host, suspects go, as there are no statistics. Repeated pages each
give a row and count once in the tree. Unclosed or misnested tags end where a block parser would end them; buttons, options, drawings and the like without
an end tag end at the next block. White space is what
Unicode calls so, no-break spaces too. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch
from cinegrid.llm.url_filter import url_parts

PRESENTATION_SHARE = 0.1
LOW_OUTSIDE, LOW_INSIDE, LOW_SUSPECT = 0.3, 0.08, 0.6
PRIOR_PAGES = 3
OUTSIDE, INSIDE, SUSPECT = 0, 1, 2
#: Low nodes (8 bytes each) are broadcast up to so many; beyond, pages are shuffled by host.
BROADCAST_NODES = 4_000_000

# Fixed names: elements of HTML and the usual words of class, id and role values.
RAW = "script style noscript textarea title iframe".split()
MUTED = "template svg select option button canvas audio video datalist".split()
NOISE = "nav header footer aside form menu dialog head fieldset label search".split()
MAIN = "article main".split()
CONTAINERS = "html body div section article main nav header footer aside form menu dialog head ul ol dl table thead tbody tfoot tr fieldset details figure blockquote center hgroup address search".split()
LEAVES = "p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre figcaption summary legend hr label".split()
ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
WORDS = "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar disclaimer comment comments commentlist respond reply replies disqus skip".split()
SITE_WORDS = "header topbar".split()
GENERIC = "list area box block container wrapper wrap section buttons button bar links link posts articles slot unit form inner outer item items title heading main site page top bottom left right".split()

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?:!|\?)[^>]*>?"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?>[^>\"']*(?:\"[^\"]*(?:\"|\Z)[^>\"']*|'[^']*(?:'|\Z)[^>\"']*)*)>?(?:(?<=/>)|.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"
    # a muted element whose end tag comes before another of its kind begins
    r"|<(?P<box>" + "|".join(MUTED) + r")(?=[\s/>])(?>[^>\"']*(?:\"[^\"]*(?:\"|\Z)[^>\"']*|'[^']*(?:'|\Z)[^>\"']*)*)>?(?:(?<=/>)|(?>(?:[^<]+|<(?!/?(?P=box)[\s/>]))*)</(?P=box)(?=[\s/>])[^>]*>)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']*(?:\"[^\"]*(?:\"|\Z)[^>\"']*|'[^']*(?:'|\Z)[^>\"']*)*))>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")


def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _facts(rest: str, inside: bool) -> tuple[str, bool, bool]:
    """(class of the style node, whether the element is noise by its own attributes, whether it is a suspect)."""
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(rest):
        found.setdefault(k.lower(), v.strip("\"'").lower())
    label = found.get("class", "")
    noise, suspect = found.get("role", "") in ROLES or "hidden" in found, False
    for token in [*label.split(), found.get("id", "")]:
        pieces = re.findall("[a-z]+", token)
        if any(w in _WORDS or not inside and w in SITE_WORDS for w in pieces):
            noise = noise or all(w in _WORDS or w in SITE_WORDS or w in GENERIC for w in pieces)
            suspect = suspect or not inside
    return label, noise, suspect


_WORDS = frozenset(WORDS)
_KINDS = {**dict.fromkeys(CONTAINERS, 1), **dict.fromkeys(LEAVES, 2)}


def parse(page: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int]]]:
    """Blocks of a page that are not noise by name, (node, OUTSIDE, INSIDE or SUSPECT, text, parent's node), and its elements'
    (node, children's hash)."""
    blocks: list[tuple[int, int, str, int]] = []
    elements: list[tuple[int, int]] = []
    # open containers: name, path hash, noise, where, children
    stack: list[list] = [["", 0, False, OUTSIDE, []]]
    leaf, leaf_noise, leaf_suspect, text, at = "", False, False, [], 0
    muted = False  # within a muted element without an end tag, up to the next block

    def close_block() -> None:
        nonlocal leaf, leaf_noise, leaf_suspect
        if text:
            top = stack[-1]
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined and not top[2] and not leaf_noise:
                where = SUSPECT if leaf_suspect and top[3] == OUTSIDE else top[3]
                blocks.append((hash64(f"{top[1]}/{leaf}/{where}"), where, joined, top[1]))
        leaf, leaf_noise, leaf_suspect = "", False, False

    def pop() -> None:
        name, path, noise, _, children = stack.pop()
        if not noise:
            elements.append((path, hash64(",".join(children))))

    for m in TOKEN.finditer(page):
        if m.start() > at and not muted:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] or m["box"]:
                text.append(" ")
            continue
        name = name.lower()
        kind = _KINDS.get(name)
        if kind is None:
            if name == "br":
                text.append(" ")
            elif name in MUTED:
                text.append(" ")
                muted = not m["end"] and not m["rest"].endswith("/")
            continue
        muted = False
        close_block()
        top = stack[-1]
        if m["end"]:
            if kind == 1 and any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in MAIN:
            while stack[-1][2] and stack[-1][0] not in NOISE:  # an unclosed noise box does not swallow the article
                pop()
            top = stack[-1]
        label, noise, suspect = _facts(m["rest"], top[3] == INSIDE) if len(m["rest"]) > 1 else ("", False, False)
        top[4].append(name)
        if kind == 1 and not m["rest"].endswith("/"):
            whole = name in ("html", "body")
            noise = noise and not whole or name in NOISE and not (name == "header" and top[3] == INSIDE)
            where = INSIDE if name in MAIN and not noise else SUSPECT if suspect and not whole and top[3] == OUTSIDE else top[3]
            stack.append([name, hash64(f"{top[1]}>{name}.{label}"), top[2] or noise, where, []])
        elif kind == 2:
            leaf, leaf_noise, leaf_suspect = name, noise or name in NOISE, suspect
    if at < len(page) and not muted:
        text.append(page[at:])
    close_block()
    while len(stack) > 1:
        pop()
    return blocks, elements


def main_text(blocks: list[tuple[int, int, str, int]], low: frozenset[int] | set[int], known: bool) -> str:
    """known: whether the page's host has statistics."""
    inside = any(b[1] == INSIDE for b in blocks)
    return "\n".join(b[2] for b in blocks if b[0] not in low and (b[1] == INSIDE or not inside) and (known or b[1] != SUSPECT))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page with a host: host, digest of the page, and its (kind, node, inside, content hash, parent node)."""
    for batch in batches:
        hosts, digests, nodes = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host:
                blocks, elements = parse(page or "")
                parents = [{"kind": 1, "node": n, "inside": 0, "content": c, "parent": n} for n, c in elements]
                hosts.append(host)
                digests.append(hash64(page or ""))
                nodes.append(parents + [{"kind": 0, "node": n, "inside": i, "content": hash64(t), "parent": p} for n, i, t, p in blocks])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("node", pa.int64()), ("inside", pa.int32()), ("content", pa.int64()), ("parent", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(nodes, kind)], names=["host", "page", "nodes"])


def importances(pages: DataFrame) -> DataFrame:
    """The style tree: host, node, inside and importance of every block node. pages: host, html."""
    nodes = pages.mapInArrow(_nodes, "host string, page long, nodes array<struct<kind:int,node:bigint,inside:int,content:bigint,parent:bigint>>")
    distinct = Scratch(pages.sparkSession, "style-tree").save(nodes.groupBy("host", "page").agg(F.first("nodes").alias("nodes")))
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    seen = distinct.select("host", F.explode("nodes").alias("n")).groupBy("host", "n.kind", "n.node", "n.inside", "n.parent", "n.content").agg(F.count("*").alias("c"))
    total = F.sum("c")
    entropy = (F.log(total) - F.sum(F.col("c") * F.log("c")) / total) / F.log(total)
    stats = seen.groupBy("host", "kind", "node", "inside", "parent").agg(total.alias("n"), F.when(total > 1, entropy).otherwise(1.0).alias("entropy"))
    shown = stats.where("kind = 1").select("host", F.col("node").alias("parent"), F.col("entropy").alias("shown"))
    blocks = stats.where("kind = 0").join(shown, ["host", "parent"], "left").join(sizes, "host")
    times = F.least("n", "pages")
    shows = PRESENTATION_SHARE * F.coalesce("shown", F.lit(1.0)) + (1 - PRESENTATION_SHARE) * F.col("entropy")
    prior = F.when(F.col("inside") == SUSPECT, 0.0).otherwise(1.0)
    return blocks.select("host", "node", "inside", ((times * shows + PRIOR_PAGES * prior) / (times + PRIOR_PAGES)).alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """The style tree's unimportant nodes: host, low (array); every host has a row. pages: host, html."""
    limit = F.when(F.col("inside") == INSIDE, LOW_INSIDE).when(F.col("inside") == SUSPECT, LOW_SUSPECT).otherwise(LOW_OUTSIDE)
    low = F.when(F.col("importance") <= limit, F.col("node"))
    return importances(pages).groupBy("host").agg(F.sort_array(F.collect_set(low)).alias("low"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(parse(page or "")[0], set(low or ()), low is not None) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For each row of pages: id, url, main text and its number of code points."""
    plain = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    plain = plain.withColumn("host", url_parts(F.col("url"))[0])
    low = Scratch(pages.sparkSession, "style-low").save(low_nodes(plain.select("host", "html")))
    few = (low.agg(F.sum(F.size("low") + 8)).collect()[0][0] or 0) <= BROADCAST_NODES
    joined = plain.join(F.broadcast(low) if few else low, "host", "left").select("id", "url", "html", "low")
    out = joined.mapInArrow(_texts, "id long, url string, text string")
    return out.select(F.col("id").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
