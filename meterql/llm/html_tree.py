r"""HTML extraction with a site style tree.

Pages of one host are merged by the paths of their elements (tags with classes,
digits levelled). For each path the tree counts, over the host's distinct
pages, how often each presentation (the shape of the branch: its elements in
order, runs of equal ones by the power of two of their number) and each content
(the text of the branch) is shown. A branch's two importances are the entropies
of those counts to the base of the number of pages: 0 if all pages show the
same, 1 if each differs. Both are of whole branches, so what lies below an
element counts towards it, up to the page.

* Within an article (`article`, `main`), and on pages without one, a branch
  counts by the larger of the two: headings have one shape and ever new text,
  so only what repeats in shape and text is furniture.
* Outside the article of a page that has one, a branch counts by the smaller:
  menus, adverts and footers may say something else on each page, but their
  shape stays.

Evidence grows with the pages, so an importance is mixed with a prior worth
`prior_pages` pages: 1 within an article and on pages without one, 0 outside an
article and for classes, ids and roles that name adverts, notices, comments and
so on. A host of one page is thus read by the prior alone and no size switches
the tree on. Branches below `importance` are removed from each page.

Markup that says outright what it is needs no evidence: navigation, page headers
and footers, side matter, forms, frames, scripts and hidden elements go; article
and main themselves and the headings in them stay. `lists=False` leaves all this
and the prior's names out, which shows what the entropies alone find.

Pages count once per article text, however their furniture differs, so a host of
copies does not make its articles look like furniture.

Blocks are separated by block elements. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined in page
order by a line feed.

Only counts are aggregated by host, added up before they are sent, so a host
may hold any share of the pages. A path's evidence goes to the executors as a
broadcast while there are at most `broadcast_paths` paths that at least two
pages of a host share, else by a join.

Defined edge cases: null or empty html gives an empty text; broken or cut-off
markup is read as far as it goes, and an element closed in its own tag holds
nothing; a null or odd url belongs to an unnamed host; repeated rows each get a
row; a null page_id gets a row; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Mapping

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterql.llm.common import cut

IMPORTANCE, PRIOR_PAGES, BROADCAST_PATHS = 0.4, 4, 200_000

_TOKEN = re.compile(r"""(?is)<!--.*?(?:-->|$)|<(script|style|textarea|title|xmp)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""")
_ATTRIBUTE = re.compile(r"""(?is)([a-z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_ALL = 0xFFFFFFFFFFFFFFFF

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr caption ul video audio""".split())
SPACED = frozenset("br td th img".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are not main text; header only outside an article.
NOISE_TAGS = frozenset("nav footer aside form head menu dialog button select option optgroup datalist input object embed audio video canvas map dir frameset iframe svg noscript template".split())
#: Words of class, id and role that name what is not main text.
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu
breadcrumb breadcrumbs sidebar widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup
login comment comments reply replies disqus respond share sharing social related recommended trending pagination pager toolbar search skip copyright
complementary contentinfo""".split())

#: What the tree says of a path: (distinct pages, entropy of its shapes, entropy of its contents).
Evidence = tuple[int, float, float]


class Node:
    __slots__ = ("tag", "path", "up", "main", "noise", "named", "evidence", "shape", "run", "last", "content")

    def __init__(self, tag: str, path: int, up: Node | None) -> None:
        self.tag, self.path, self.up = tag, path, up
        self.main = self.noise = self.named = False
        self.evidence: Evidence | None = None
        self.shape = self.run = self.last = self.content = 0


def _said(tag: str, attributes: dict[str, str], inside_main: bool) -> tuple[bool, bool]:
    """(noise outright, noise by its names)."""
    if tag in NOISE_TAGS or (tag == "header" and not inside_main):
        return True, True
    if not attributes:
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, True
    if tag in ("html", "body", "main"):
        return False, False
    words = {w.lower() for a in ("class", "id", "role") if a in attributes for w in _PART.findall(attributes[a])}
    return False, not words.isdisjoint(NOISE_WORDS) or ("header" in words and not inside_main)


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _leave(node: Node) -> None:
    """Adds a finished element to its parent's shape: equal neighbours are one run, counted by powers of two."""
    _end_run(node)
    up = node.up
    if up is None:
        return
    own = _mark(node.tag) ^ node.shape * 31 & _ALL
    if own != up.last:
        _end_run(up)
        up.last = own
    up.run += 1


def _end_run(node: Node) -> None:
    if node.run:
        node.shape = (node.shape * 1000003 + node.last + node.run.bit_length()) & _ALL
        node.run = node.last = 0


def parse(page: str | None, tree: Mapping[int, Evidence] | None = None, features: bool = False, lists: bool = True) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(blocks with their nodes, all nodes). tree: evidence by path; features: fill the nodes' shapes and contents."""
    root = Node("", 0, None)
    stack, nodes, blocks, text = [root], [], [], []
    holder, known = root, tree or {}

    def flush() -> None:
        nonlocal holder
        if text:
            body = " ".join("".join(text).split())
            if body:
                blocks.append((holder, body))
            text.clear()
        holder = stack[-1]

    def add(raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = _html.unescape(raw)
            text.append(raw)
            if features and (bare := raw.strip()):
                mark = _mark(bare)
                for node in stack:
                    node.content = node.content * 1000003 + mark & _ALL

    def leave(k: int) -> None:
        if features:
            for node in reversed(stack[k:]):
                _leave(node)
        del stack[k:]

    def close(tag: str, barriers: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                leave(k)
                return
            if stack[k].tag in barriers:
                return

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SPACED:
            text.append(" ")
        block = tag in BLOCKS
        if m[2]:
            if block:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    break
                if tag not in BLOCKS and stack[k].tag in ("article", "main", "body", "td", "div", "section"):
                    break  # an inline end tag does not close a block
            holder = stack[-1] if block else holder
            continue
        if block:
            flush()
            if tag in CLOSES_P:
                close("p", ("button", "table", "div", "section", "article", "main", "body"))
            if tag == "li":
                close("li", ("ul", "ol", "menu"))
            elif tag == "tr":
                close("tr", ("table",))
        up = stack[-1]
        attributes = {a.lower(): v.strip("\"'") for a, v in _ATTRIBUTE.findall(m[4])} if m[4] and not m[4].isspace() else {}
        name = f"{tag}.{_DIGITS.sub('0', attributes['class'])}" if "class" in attributes else tag
        if tag in VOID or m[4].endswith("/"):
            if features:
                _leave(Node(tag, 0, up))
            holder = stack[-1] if block else holder
            continue
        node = Node(tag, xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), up.path), up)
        if lists:
            node.main = up.main or (tag in ("article", "main") or attributes.get("role") == "main")
            node.noise, node.named = _said(tag, attributes, up.main)
        node.noise = node.noise or up.noise or tag == "head"
        if not node.noise and node.path in known and not (node.main and (not up.main or tag in HEADINGS)):
            node.evidence = known[node.path]
        nodes.append(node)
        stack.append(node)
        if block:
            holder = node
        elif not text:
            holder = node if node.noise or node.named else holder
        if (node.noise or node.named) and not up.noise and not block:
            flush()
            holder = node
    add(page[at:] if not page[at:].startswith("<") else "")
    flush()
    leave(0)
    return blocks, nodes


def importance(evidence: Evidence | None, varied: bool, prior: float, prior_pages: float = PRIOR_PAGES) -> float:
    """A branch's importance; varied: it must vary in shape and in content, not in either."""
    if evidence is None:
        return prior
    pages, shape, content = evidence
    own = min(shape, content) if varied else max(shape, content)
    return (prior_pages * prior + (pages - 1) * own) / (prior_pages + pages - 1)


def judged(page: str | None, tree: Mapping[int, Evidence] | None = None, least: float = IMPORTANCE, prior_pages: float = PRIOR_PAGES, lists: bool = True) -> tuple[str, int, int]:
    """(main text, branches that the tree removes from it, branches that the tree keeps against the prior)."""
    blocks, nodes = parse(page, tree, lists=lists)
    article = any(n.main and not n.noise for n in nodes) or not lists
    verdict: dict[int, bool] = {}
    gone = back = 0
    for n in nodes:  # parents come first
        up = verdict.get(id(n.up), True)
        if n.noise or not up:
            verdict[id(n)] = False
            continue
        if n.tag in ("", "html", "body") or (n.main and not n.up.main):
            verdict[id(n)] = True
            continue
        # Without lists the first branch below the body that varies in both stands for the article.
        outside = not n.main and (article if lists else n.up.tag in ("", "html", "body"))
        prior = 0.0 if n.named or (outside and lists) else 1.0
        keep = importance(n.evidence, outside, prior, prior_pages) >= least
        gone += not keep and prior >= least
        back += keep and prior < least
        verdict[id(n)] = keep
    # Bare text beside an article belongs to no branch; on a page without one it is the text.
    bare = not (article and lists)
    return "\n".join(body for node, body in blocks if (bare if node.tag in ("", "html", "body") else verdict.get(id(node), False))), gone, back


def main_text(page: str | None, tree: Mapping[int, Evidence] | None = None, least: float = IMPORTANCE, prior_pages: float = PRIOR_PAGES, lists: bool = True) -> str:
    return judged(page, tree, least, prior_pages, lists)[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_features(page: str | None, lists: bool = True) -> tuple[int, dict[int, tuple[int, int]]]:
    """(what the page counts as, (shape, content) of each path); equal paths of a page are one node of the tree."""
    nodes = parse(page, features=True, lists=lists)[1]
    article = [n.content for n in nodes if n.main and not n.up.main]
    merged: dict[int, tuple[int, int]] = {}
    for n in nodes:
        if not n.noise:
            shape, content = merged.get(n.path, (0, 0))
            merged[n.path] = shape * 31 + n.shape & _ALL, content * 31 + n.content & _ALL
    return (hash(tuple(article)) & _ALL if article else _mark(page or "")), merged


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", lists: bool = True) -> DataFrame:
    """(host, path, pages, shape, content) of each site's merged tree: the entropies of its shapes and contents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for host, page in zip(part["host"], part["html"]):
                whole, merged = page_features(page, lists)
                rows += [(host, _signed(p), _signed(whole), _signed(s), _signed(c)) for p, (s, c) in merged.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "page", "shape", "content"])

    slim = pages.select(_host(url).alias("host"), F.col(html).cast("string").alias("html"))
    seen = slim.mapInPandas(run, "host string, path long, page long, shape long, content long")
    # A page may come with other furniture each time; one of them stands for it.
    seen = seen.groupBy("host", "path", "page").agg(F.min(F.struct("shape", "content")).alias("f")).select("host", "path", "f.*")
    kinds = seen.select("host", "path", F.posexplode(F.array("shape", "content")).alias("kind", "feature")).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    sums = kinds.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("m") * F.log("m")))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, entropy))
    return sums.where("m > 1").groupBy("host", "path").agg(F.max("m").alias("pages"), pick(0).alias("shape"), pick(1).alias("content"))


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: float = IMPORTANCE, prior_pages: float = PRIOR_PAGES,
            broadcast_paths: int = BROADCAST_PATHS, lists: bool = True) -> DataFrame:
    """(key, url, text, n_chars, n_removed, n_kept) per row; n_removed: branches the tree removed, n_kept: those it kept against the prior."""
    tree = cut(style_tree(pages, url, html, lists))
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), _host(url).alias("host"), F.col(html).cast("string").alias("html"))
    kind = "text string, n_removed long, n_kept long"

    def text_of(page: str | None, own: Mapping[int, Evidence]) -> tuple[str, int, int]:
        return judged(page, own, least, prior_pages, lists)

    if tree.count() <= broadcast_paths:
        table: dict[str, dict[int, Evidence]] = {}
        for host, path, n, shape, content in tree.collect():
            table.setdefault(host, {})[path & _ALL] = (n, shape, content)
        handle = slim.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf(kind)
        def extracted(hosts: pd.Series, bodies: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([text_of(b, handle.value.get(h, {})) for h, b in zip(hosts, bodies)], columns=["text", "n_removed", "n_kept"])

        found = slim.withColumn("found", extracted("host", "html"))
    else:
        # A host's list has one entry for each path that its pages share, whatever the number of the pages.
        lists_of = tree.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "shape", "content")).alias("tree"))

        @F.pandas_udf(kind)
        def extracted(trees: pd.Series, bodies: pd.Series) -> pd.DataFrame:
            own = [{} if t is None else {int(x["path"]) & _ALL: (int(x["pages"]), x["shape"], x["content"]) for x in t} for t in trees]
            return pd.DataFrame([text_of(b, t) for t, b in zip(own, bodies)], columns=["text", "n_removed", "n_kept"])

        found = slim.join(lists_of, "host", "left").withColumn("found", extracted("tree", "html"))
    return found.select(F.col("key").alias(key), "url", "found.text", F.char_length("found.text").cast("long").alias("n_chars"), "found.n_removed", "found.n_kept")
