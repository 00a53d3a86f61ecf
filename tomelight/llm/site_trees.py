"""Main text of web pages by site style trees (operator 1).

The pages of a host are merged into one tree over their whole DOM: nodes are elements with equal paths (tags, classes and
ids from the root, digits folded). For every node the tree holds the distribution of its presentation styles (the sequence
of its children's looks, a page at a time) and of its contents (a text block's hash). Over the m pages that have a node,

    presentation importance = entropy of its styles, to the base m
    content importance      = mean over its distinct texts of 1 - entropy of the pages that have it, to the base m

A branch (a node and all below it) has a composite importance: the mean presentation importance of its nodes, weighted by
pages, and the mean content importance of its text-bearing nodes, weighted by texts, mixed by ``GAMMA``. With few pages
neither says much, so ``PRIOR`` imaginary pages on which a branch is important are added: importance = (m * composite +
PRIOR) / (m + PRIOR). What looks and reads alike on every page approaches 0 as pages grow, and branches below ``LEAST`` are
removed from each page. A branch is not removed where nothing would be left of a page.

Some parts need not repeat to be foreign to the main text (each page has other reader comments, adverts and forms). On what
the tree has left, elements that say what they are go too:

* by tag or role: scripts, styles, navigation, asides, footers, forms, dialogs and so on; page headers;
* by a class or id all of whose words are such names (``comment-list``, ``site-footer``, but not ``has-sidebar``), unless
  the branch holds the page's main part: its main element, its first h1, or, where there is neither, its first article
  outside of such branches; and unless that would leave nothing;
* what is outside of the page's articles (or its main element), if these hold at least half of what is left.

Pages of a host with the same remaining text count as one page, so copies of an article don't make it a template.

Scale: a task sends one row a page with the hashes of its tree (deduplicated by host and text), then merges what it holds
and sends counts by (host, node, value), which spreads a host with a third of all pages over its values. Only the keys of
unimportant branches come back to the pages: one row a host, by broadcast if all of them together are small (checked; the
plan differs then, the rows do not), else by a join on the host that adaptive execution may split. Their number is bounded
by the paths of a site's templates. A page is read once and each element knows in constant time what lies above it, so neither long nor deep
pages cost more than their length; sums up the tree go ``CHAIN`` levels at once and double from there.

Defined results: a null or empty page gives an empty text; a null or unreadable url belongs to the host ''; repeated rows
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, small_batches
from ._dom import BLOCK, Element, read

GAMMA, LEAST, PRIOR = 0.9, 0.3, 2.0
#: Nodes (keys of 8 bytes) that may be broadcast.
BROADCAST_NODES = 2_000_000
#: Levels above a node that its row names.
CHAIN = 64

#: Elements without text that is shown, elements and roles that never hold main text.
UNSEEN = frozenset("head script style noscript template title textarea iframe xmp noembed noframes".split())
FOREIGN = frozenset("nav aside footer form menu dialog button select option input svg canvas object audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of classes and ids for what is not main text, and words that may stand beside them.
WORDS = frozenset(
    "nav navbar navigation navi menu menubar topbar sidebar sidenav aside rail footer foot masthead breadcrumb breadcrumbs pagination pager "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promotions banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox newsletter subscribe subscription signup login signin register paywall "
    "share sharing social follow comment comments commentlist reply replies respond response responses disqus discussion feedback related recommended recommendations "
    "toolbar search searchbox form widget widgets skip hidden blogroll roll tag tags tagcloud".split()
)
BESIDE = frozenset(
    "site page main global top bottom left right inner outer primary secondary list lists item items box wrapper wrap container area section block blocks bar bars link links button buttons btn "
    "icon icons post posts article articles content body header head title text group row col column panel form field media user reader readers thread tree slot unit blog cloud by in on to of the and us your privacy policy a".split()
)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(100_000)
def _named_foreign(name: str) -> bool:
    words = [w.lower() for w in _SPLIT.split(name) if w]
    return any(w in WORDS for w in words) and all(w in WORDS or w in BESIDE for w in words)


@lru_cache(100_000)
def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


class Page:
    """A page's text blocks (text, number of the element that owns it), and which parts of it are not main text."""

    def __init__(self, html: str):
        self.elements, pieces = read(html)
        n = len(self.elements)
        # what holds for an element itself or from above, found in page order
        unseen, self.block, self.cut = [False] * n, list(range(n)), [False] * n
        self.sections, self.mains = [False] * n, [False] * n  # inside an article, main element or section; an article or main element
        for e in self.elements[1:]:
            above, tag = e.parent.number, e.tag
            unseen[e.number] = tag in UNSEEN or unseen[above]
            self.mains[e.number] = tag in ("article", "main") or self.mains[above]
            self.sections[e.number] = tag == "section" or self.mains[e.number] or self.sections[above]
            if tag not in BLOCK:  # an inline element is in the block above it
                self.block[e.number] = self.block[above]
                self.cut[e.number] = self.cut[above] or tag in FOREIGN or bool(e.attributes) and self._says(e)
        self.blocks: list[tuple[str, int]] = []
        text, owner = [], None
        for number, piece in [*pieces, (0, None)]:
            if piece is None:
                if owner is not None and (joined := " ".join("".join(text).split())):
                    self.blocks.append((joined, self.block[owner]))
                text, owner = [], None
            elif not unseen[number] and not self.cut[number]:  # a button or hidden span is cut out of its block
                text.append(piece)
                if owner is None and not piece.isspace():
                    owner = number

    @staticmethod
    def _says(element: Element) -> bool:
        """By role, attribute or style."""
        given = element.attributes
        return (
            given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        )

    def _core(self) -> set[int]:
        """The elements around the page's main part: a class or id does not remove these."""
        found = next((e for e in self.elements if e.tag == "main" or e.attributes.get("role") == "main"), None) or next((e for e in self.elements if e.tag == "h1"), None)
        if not found:
            named = [False] * len(self.elements)
            for e in self.elements[1:]:
                named[e.number] = named[e.parent.number] or bool(e.attributes) and e.tag not in ("html", "body") and self._by_name(e)
            found = next((e for e in self.elements if e.tag == "article" and not named[e.number]), None)
        out = set()
        while found is not None:
            out.add(found.number)
            found = found.parent
        return out

    def _by_name(self, element: Element) -> bool:
        given = element.attributes
        names = f"{given.get('class', '')} {given.get('id', '')}".split()
        return any(map(_named_foreign, names)) or element.tag != "header" and any("header" in x.lower() for x in names) and not (element.parent is not None and self.mains[element.parent.number])

    def foreign(self, by_name: bool = True) -> list[bool]:
        """For each element, whether it says that it isn't main text, itself or from above."""
        core, out = self._core(), [False] * len(self.elements)
        for e in self.elements[1:]:
            if out[e.parent.number]:
                out[e.number] = True
                continue
            tag, given = e.tag, e.attributes
            if tag in ("html", "body", "main"):
                continue
            says = tag in FOREIGN and not (tag == "form" and e.number in core)
            says = says or tag == "header" and not self.sections[e.parent.number]
            if given and not says:
                says = self._says(e) or by_name and e.number not in core and self._by_name(e)
            out[e.number] = says
        return out

    def main(self, blocks: list[tuple[str, int]]) -> str:
        """The main text among these blocks, without the tree."""
        foreign, scope = self.foreign(), [0] * len(self.elements)
        for e in self.elements[1:]:
            kind = 2 if e.tag == "article" else 1 if e.tag == "main" or e.attributes.get("role") == "main" else 0
            scope[e.number] = max(scope[e.parent.number], kind)
        kept = [b for b in blocks if not foreign[b[1]]]
        if not kept and blocks:  # then classes and ids are no guide here
            foreign = self.foreign(False)
            kept = [b for b in blocks if not foreign[b[1]]]
        total = sum(len(t) for t, _ in kept)
        for least in (2, 1):
            inside = [b for b in kept if scope[b[1]] >= least]
            if inside and 2 * sum(len(t) for t, _ in inside) >= total:
                kept = inside
                break
        return "\n".join(t for t, _ in kept)

    def left(self, low: set[int]) -> list[tuple[str, int]]:
        """The blocks outside of branches with these keys; all blocks if none would be left."""
        if not low:
            return self.blocks
        out = [False] * len(self.elements)
        for e in self.elements[1:]:
            out[e.number] = out[e.parent.number] or e.path in low
        return [b for b in self.blocks if not out[b[1]]] or self.blocks

    def tree(self) -> bytes:
        """The page's part of the style tree: nodes (key, place of the parent, style) and their distinct texts (place, hash)."""
        places: dict[int, int] = {0: 0}
        nodes, styles = [(0, 0)], [[]]
        for e in self.elements[1:]:
            if e.tag in UNSEEN:
                continue
            place, above = places.get(e.path), places[e.parent.path] if e.parent.path in places else 0
            if place is None:
                place = places[e.path] = len(nodes)
                nodes.append((e.path, above))
                styles.append([])
            if not styles[above] or styles[above][-1] != e.tag:
                styles[above].append(e.tag)
        texts = sorted({(places.get(self.elements[number].path, 0), _key(text)) for text, number in self.blocks})
        rows = [(k, p, _key(",".join(s))) for (k, p), s in zip(nodes, styles, strict=True)]
        return np.array([len(rows)], "<i8").tobytes() + np.array(rows, "<i8").tobytes() + np.array(texts, "<i8").reshape(-1, 2).tobytes()


def unpacked(tree: bytes):
    """(nodes: key, parent's place, style; texts: node's place, hash) of what ``Page.tree`` gives."""
    values = np.frombuffer(tree, "<i8")
    n = int(values[0])
    return values[1 : 1 + 3 * n].reshape(-1, 3), values[1 + 3 * n :].reshape(-1, 2)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def branches(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every branch of the hosts' style trees that holds text."""

    def look(batches):
        for batch in batches:
            hosts, keys, trees = [], [], []
            seen = set()
            for host, html in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if html:
                    page = Page(html)
                    key = _key(page.main(page.blocks))
                    if (host, key) not in seen:
                        seen.add((host, key))
                        hosts.append(host)
                        keys.append(key)
                        trees.append(page.tree())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(trees, pa.binary())], ["host", "page", "tree"])

    read_once = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(look, "host string, page long, tree binary")
    # pages with the same text are one page
    distinct = read_once.groupBy("host", "page").agg(F.min("tree").alias("tree"))

    def merge(batches):
        counts, chains = Counter(), {}

        def rows():
            found = [(h, n, k, v, c, *chains[n]) for (h, n, k, v), c in counts.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["host", "node", "kind", "value", "c", "chain", "far"])

        for batch in batches:
            for host, tree in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                nodes, texts = unpacked(tree)
                keys, own = nodes[:, 0].tolist(), []
                for place, (key, above, style) in enumerate(nodes.tolist()):
                    own.append([key] if not place else [key, *own[above][: CHAIN - 1]])
                    far = own[above][CHAIN - 1] if place and len(own[above]) == CHAIN else None
                    chains.setdefault(key, (own[-1], far))
                    counts[host, key, 0, style] += 1
                for place, text in texts.tolist():
                    counts[host, keys[place], 1, text] += 1
                if len(counts) > 200_000:
                    yield rows()
                    counts, chains = Counter(), {}
        if counts:
            yield rows()

    merged = distinct.select("host", "tree").mapInArrow(merge, "host string, node long, kind int, value long, c long, chain array<long>, far long")
    values = merged.groupBy("host", "node", "kind", "value").agg(F.sum("c").alias("c"), F.first("chain").alias("chain"), F.first("far").alias("far"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    nodes = values.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("clogc"),
        F.coalesce(F.sum(F.when(text, F.log("c"))), F.lit(0.0)).alias("logs"),
        F.count(F.when(text, 1)).alias("texts"),
        F.first("chain").alias("chain"),
        F.first("far").alias("far"),
    )
    base = F.log("m")
    presentation = F.when(F.col("m") > 1, (base - F.col("clogc") / F.col("m")) / base).otherwise(0.0)
    content = F.when(F.col("m") > 1, F.col("texts") - F.col("logs") / base).otherwise(F.col("texts").cast("double"))
    scored = nodes.select("host", "node", "m", (F.col("m") * presentation).alias("p"), content.alias("q"), "texts", "chain", "far")
    # sums over what is less than CHAIN levels below a node, then over twice as much, and so on: pages are seldom that deep
    above = scored.select("host", F.col("node").alias("low"), "m", "p", "q", "texts", "far", F.explode("chain").alias("node"))
    itself = F.col("low") == F.col("node")
    own = [F.max(F.when(itself, F.col("m"))).alias("pages"), F.max(F.when(itself, F.col("far"))).alias("far")]
    sums = materialize(above.groupBy("host", "node").agg(*own, *(F.sum(c).alias(c) for c in ("p", "m", "q", "texts"))))
    while not sums.where("far is not null").isEmpty():
        deeper = sums.where("far is not null").groupBy("host", F.col("far").alias("node")).agg(*(F.sum(c).alias(f"{c}_") for c in ("p", "m", "q", "texts")))
        further = sums.where("far is not null").select("host", F.col("node").alias("far"), F.col("far").alias("far_"))
        both = sums.join(deeper, ["host", "node"], "left").join(further, ["host", "far"], "left")
        sums = materialize(both.select("host", "node", "pages", F.col("far_").alias("far"), *((F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("p", "m", "q", "texts"))))
    sums = sums.where("texts > 0")
    composite = (1 - GAMMA) * F.col("p") / F.col("m") + GAMMA * F.col("q") / F.col("texts")
    return sums.select("host", "node", "pages", ((F.col("pages") * composite + PRIOR) / (F.col("pages") + PRIOR)).alias("importance"))


def main_text(pages: DataFrame, marks: bool = True) -> DataFrame:
    """One row a row of pages: page_id, url, text, n_chars. Without ``marks`` the tree alone decides, over all text that is shown."""
    small_batches(pages.sparkSession)
    low = materialize(branches(pages).where(F.col("importance") < LEAST).groupBy("host").agg(F.collect_list("node").alias("nodes")))
    size = low.agg(F.sum(F.size("nodes"))).first()[0] or 0
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(low) if size <= BROADCAST_NODES else low, "host", "left")

    def run(batches):
        for batch in batches:
            texts = []
            for html, nodes in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True):
                if html:
                    page = Page(html)
                    blocks = page.left(set(nodes or ()))
                    text = page.main(blocks) if marks else "\n".join(t for t, _ in blocks)
                    # where the marks leave nothing of what the tree has kept, the tree was wrong about this page
                    texts.append(text or (page.main(page.blocks) if marks else ""))
                else:
                    texts.append("")
            sizes = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "nodes").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_site_style_tree(spark, sf_dir: str) -> DataFrame:
    """All pages: page_id, url, text, n_chars."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
