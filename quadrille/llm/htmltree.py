"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree: a node is the chain of tags and classes from the root. Entropies over
the host's m pages say how important a node is:

* presentation: the entropy of the node's styles (the sequence of its children on a page). A node with few styles is a
  template, whose branches are parts of a page; one with many is content that differs from page to page.
* content: 1 - the mean of log_m n over the texts in the node's branch, weighted by their words, where n pages carry the
  text. Texts of one page only count 1, a text of all pages counts 0.
* share: the branch's words times its content importance, on the pages that have it, as part of a whole page's.

A branch is dropped if it holds less than SHARE of a page's information and its content importance is below REPEATED
(under a template) or CONSTANT (elsewhere, for elements that hold more than one paragraph or heading). What stands on one
page only can't repeat, so a node on one page is never dropped by itself; all its words count in its ancestors.

Entropies know nothing about a host of one page, and menus, forms and comments that differ on every page carry
information. So parts whose tag, class or role names what has to go (ROLES) are dropped too, and article and main elements
are kept. ``names=False`` leaves this out: then entropies alone decide.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, slices, text_of

SHARE, REPEATED, CONSTANT = 0.1, 0.95, 0.1
#: A node is a template if the entropy of its styles, in nats, is at most that of so many equally frequent styles.
STYLES = 4
#: Counts that are held before a task sends them on.
HELD = 100_000

# Elements by kind.
RAW = "script style textarea iframe title".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("base link meta noscript script style template title".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary"}
#: Open element that a new one closes, if it is the innermost block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that aren't shown as text, and elements that name parts which have to go.
UNSEEN = set("annotation annotation-xml datalist noscript template".split())
NOISE_TAGS = set("nav aside footer form button dialog menu search input label fieldset select".split())
MAIN = {"article", "main"}
TEXTUAL = set("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th figcaption a b i em strong span code q sub sup small mark u s".split())
_BEFORE = r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|cookies?)[-_]+)*"
_AFTER = r"\d*(?:[-_]+(?:\d+(?:x\d+)?|area|bar|box|block|bottom|button|buttons|container|form|icons|inner|item|items|left|links?|list|main|panel|primary|right|secondary|section|slot|top|unit|wrap|wrapper|nav|menu|posts|articles|policy))*"
_PART = r"(?:nav|navbar|navigation|menu|footer|sidebar|side|aside|banner|cookies?|consent|gdpr|notices?|alert|ad|ads|advert|adverts|advertisement|adsense|promo|promoted|sponsor|sponsored|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|breadcrumbs?|pagination|pager|popup|modal|toolbar|widget|contentinfo|complementary)"
#: Whole names in class, id and role: words for parts, with narrow forms around them. A name of another thing (has-sidebar, entry-header) is none.
ROLES = re.compile(rf"{_BEFORE}(?:(?:post|entry|article)[-_]+)?{_PART}(?:[-_]+{_PART})*{_AFTER}", re.I)
#: Names of a page's head; in an article they are its own head, as the bare element is.
HEADS = re.compile(rf"{_BEFORE}(?:header|masthead){_AFTER}", re.I)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r""">|=\s*+["']""")
_ATTR = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_DIGITS = re.compile(r"\d{3,}")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("open", tag, attributes) and ("close", tag, "") in order.

    Every character is read a bounded number of times, whatever is broken: a quote that never closes ends the search for
    quotes in this page, and from there on a tag ends at its first ``>``.
    """
    at, end, last, quotes = 0, len(text), text.rfind(">"), True
    start = 0  # of the text not yet given
    while True:
        i = text.find("<", at)
        if i < 0 or i > last:  # no tag can close any more, and a comment takes the rest
            i = text.find("<!--", i) if i >= 0 else end
            end = i if i >= 0 else end
            break
        m = _NAME.match(text, i)
        if m is None:
            if not text.startswith(("<!", "<?", "</"), i):
                at = i + 1
                continue
            if i > start:
                yield "text", text[start:i], ""
            if text.startswith("<!--", i):
                if text.startswith((">", "->"), i + 4):
                    at = text.find(">", i) + 1
                else:
                    j = text.find("-->", i + 4)
                    at = end if j < 0 else j + 3
            else:
                at = text.find(">", i) + 1
            start = at
            continue
        stop, p = -1, m.end()
        while quotes:
            s = _STOP.search(text, p)
            if s is None:
                quotes = False
            elif s[0] == ">":
                stop = s.start()
                break
            else:
                p = text.find(s[0][-1], s.end()) + 1
                quotes = p > 0
        if stop < 0:
            stop = text.find(">", m.end())
        if i > start:
            yield "text", text[start:i], ""
        tag = m[2].lower()
        at = start = stop + 1
        if m[1]:
            yield "close", tag, ""
        elif tag in _END_OF:
            e = _END_OF[tag].search(text, at)
            at = start = text.find(">", e.end()) + 1 or end if e else end
            if tag == "textarea":  # part of a form
                yield "open", "hr", ""
        else:
            yield "open", tag, text[m.end() : stop]
    if start < end:
        yield "text", text[start:], ""


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Dom:
    """A page: its elements in order (0 is the root) and, in ``events``, (element, text) or (element, None) where a block begins or ends.

    An element's ``node`` is the hash of its chain of styles, so that deep pages take no more room than flat ones.
    """

    def __init__(self, text: str, names: bool = True):
        self.tag, self.parent, self.style, self.node = [""], [-1], [""], [0]
        self.role, self.head, self.unseen = [False], [False], [False]
        self.events: list[tuple[int, str | None]] = []
        self._read(text, names)
        self._mark(names)

    def _read(self, text: str, names: bool) -> None:
        # open elements: number; place in the stack of the innermost block but p, and of the innermost p in it (or -1)
        stack, block, para = [0], [0], [-1]
        places: dict[str, list[int]] = defaultdict(list)
        in_head = False

        def pop_to(at: int) -> None:
            while len(stack) > at:
                places[self.tag[stack.pop()]].pop()
                block.pop(), para.pop()

        for kind, what, attrs in tokens(text):
            if in_head:  # ends where something of a body begins
                if kind == "close":
                    in_head = what != "head"
                    continue
                if kind == "text" and what.isspace() or kind == "open" and what in IN_HEAD or what == "head":
                    continue
                in_head = False
            if kind == "text":
                self.events.append((stack[-1], what))
                continue
            if kind == "close":
                if what in BLOCKS:
                    self.events.append((stack[-1], None))
                elif what == "br":
                    self.events.append((stack[-1], " "))
                if what in ("html", "body") or not places[what]:
                    continue
                at = places[what][-1]
                if what in BLOCKS and what != "p" or block[-1] <= at:  # inline elements and paragraphs don't close blocks
                    pop_to(at)
                continue
            if what == "head":
                in_head = True
                continue
            if what in BLOCKS:
                self.events.append((stack[-1], None))
            if what in CLOSES_P and para[-1] >= 0:
                pop_to(para[-1])
            while self.tag[stack[block[-1]]] in ENDS.get(what, ()):
                pop_to(block[-1])
            if what == "option" and places["option"] and block[-1] < places["option"][-1]:
                pop_to(places["option"][-1])
            if what in VOID:
                if what == "br":
                    self.events.append((stack[-1], " "))
                continue
            if what in ("html", "body") and places[what]:
                continue
            self._add(stack[-1], what, attrs, names)
            if not (attrs.endswith("/") and (places["svg"] or places["math"])):  # there elements may close themselves
                places[what].append(len(stack))
                stack.append(len(self.tag) - 1)
                block.append(len(stack) - 1 if what in BLOCKS and what != "p" else block[-1])
                para.append(len(stack) - 1 if what == "p" else -1 if what in BLOCKS else para[-1])

    def _add(self, parent: int, tag: str, attrs: str, names: bool) -> None:
        style, unseen, role, head = tag, tag in UNSEEN, names and tag in NOISE_TAGS, names and tag == "header"
        if attrs and not attrs.isspace():
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            if a.get("class"):  # long numbers in names (post-1234) tell pages apart, short ones (col-3) styles
                style = f"{tag}.{'.'.join(sorted(_DIGITS.sub('#', a['class']).split()))}"
            unseen = unseen or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            if names and tag not in ("html", "body", *MAIN):
                called = [x for k in ("class", "id", "role") for x in a.get(k, "").split() if len(x) < 100]
                role = role or any(ROLES.fullmatch(x) for x in called)
                head = head or any(HEADS.fullmatch(x) for x in called)
        self.tag.append(tag), self.parent.append(parent), self.style.append(style), self.role.append(role), self.head.append(head), self.unseen.append(unseen)
        self.node.append(_hash(f"{self.node[parent]} {style}"))

    def _mark(self, names: bool) -> None:
        """``noise`` by name (or unseen), ``inside`` a main element, ``holds`` one."""
        n = len(self.tag)
        tags = MAIN if names else ()
        held: dict[str, set[int]] = {t: set() for t in MAIN}
        for i in range(n):
            if self.tag[i] in tags:
                seen, j = held[self.tag[i]], self.parent[i]
                while j > 0 and j not in seen:
                    seen.add(j)
                    j = self.parent[j]
        self.holds = held["main"] | held["article"]
        spare: set[int] = held["main"]
        for _ in range(2):  # a name doesn't hide what holds a main element, or all of a page's articles
            self.noise, self.inside = [False] * n, [False] * n
            free = False
            for i in range(1, n):
                p = self.parent[i]
                inside = self.inside[p]
                named = self.role[i] or self.head[i] and not inside
                self.noise[i] = self.noise[p] or self.unseen[i] or (named and i not in spare)
                self.inside[i] = inside or (self.tag[i] in tags and not self.noise[i])
                free = free or (self.tag[i] == "article" and not self.noise[i])
            if free or not held["article"]:
                break
            spare = self.holds
        self.has_main = any(self.inside)


def main_text(text: str, low: Iterable[int] = (), names: bool = True) -> str:
    """The blocks of a page's main text, one in a line; ``low``: nodes of its host's unimportant branches."""
    dom = Dom(text, names)
    gone, low = list(dom.noise), frozenset(low)
    if low:
        for i in range(1, len(gone)):
            kept = i in dom.holds or (dom.inside[i] and dom.tag[i] in TEXTUAL | MAIN)
            gone[i] = gone[i] or gone[dom.parent[i]] or (dom.node[i] in low and not kept)
    kinds: dict[bool, list[str]] = {False: [], True: []}
    parts: list[str] = []
    inside = False
    for e, raw in [*dom.events, (0, None)]:
        if raw is not None and gone[e]:
            continue
        if raw is None or dom.inside[e] != inside:
            block = " ".join("".join(parts).split())
            if block:
                kinds[inside].append(block)
            parts.clear()
        if raw is not None:
            inside = dom.inside[e]
            parts.append(html.unescape(raw))
    return "\n".join(kinds[dom.has_main])


def page_nodes(text: str) -> tuple[dict[int, tuple[int, int, int, bool]], dict[tuple[int, int], int]]:
    """(node -> (parent, hash of its children's styles, words in its branch, textual), (node, hash of a text) -> words); the root is node 0. Unseen elements aren't there."""
    dom = Dom(text, names=False)
    n = len(dom.tag)
    words, children = [0] * n, defaultdict(list)
    texts: dict[tuple[int, int], int] = {}
    for e, raw in dom.events:
        if raw is not None and not dom.noise[e]:
            said = html.unescape(raw).split()
            if said:
                words[e] += len(said)
                texts[dom.node[e], _hash(" ".join(said))] = len(said)
    for i in range(n - 1, 0, -1):
        words[dom.parent[i]] += words[i]
    out: dict[int, list] = {}
    for i in range(n):
        if i and not dom.noise[i]:
            children[dom.node[dom.parent[i]]].append(dom.style[i])
        if not dom.noise[i]:
            out.setdefault(dom.node[i], [dom.node[dom.parent[i]] if i else 0, 0, dom.tag[i] in TEXTUAL])[1] += words[i]
    return {k: (p, _hash(">".join(children[k])), w, t) for k, (p, w, t) in out.items()}, texts


def unimportant_nodes(table: dict[int, tuple[int, float, float, float, float, bool]], pages: int, words: float) -> list[int]:
    """The topmost unimportant nodes of a host with so many pages and words. table: node -> (parent, pages, entropy of styles in nats, words in the branch, sum of words n ln n over its own texts, textual).

    Nodes of one page and texts of one page may be left out: they repeat nothing.
    """
    if pages < 2:
        return []
    repeated = {k: v[4] for k, v in table.items()}
    children = defaultdict(list)
    for k, v in table.items():
        if k:
            children[v[0]].append(k)
    order, stack = [], [0]
    while stack:
        k = stack.pop()
        order.append(k)
        stack.extend(children[k])
    for k in reversed(order[1:]):
        repeated[table[k][0]] += repeated[k]
    log = math.log(pages)
    whole = (words - repeated[0] / log) / pages  # a page's information
    if whole <= 1e-9 * words / pages:
        return []
    low, stack = [], [0]
    while stack:
        k = stack.pop()
        template = table[k][2] <= math.log(STYLES)
        for c in children[k]:
            _, n, _, w, _, textual = table[c]
            content = 1 - repeated[c] / log / w if w else 1.0
            limit = REPEATED if template else CONSTANT if not textual else 0.0
            if w and content < limit and content * w / n < SHARE * whole:
                low.append(c)
            else:
                stack.append(c)
    return sorted(low)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_FACTS = "host string, node long, parent long, style long, textual boolean, text long, n long, words long"


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for (host, node, style) and (host, node, text), added up within a batch; a text has no style."""
    for batch in batches:
        counts: Counter = Counter()
        sums: Counter = Counter()

        def made() -> pa.RecordBatch:
            columns = [*zip(*counts, strict=True), list(counts.values()), [sums[k] for k in counts]]
            counts.clear(), sums.clear()
            kinds = {"host": pa.string(), "node": pa.int64(), "parent": pa.int64(), "style": pa.int64(), "textual": pa.bool_(), "text": pa.int64(), "n": pa.int64(), "words": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

        for host, text in zip(batch.column(0), batch.column(1), strict=True):  # one page's text at a time is a Python object
            host = host.as_py()
            nodes, texts = page_nodes(text.as_py())
            for node, (parent, style, words, textual) in nodes.items():
                key = (host, node, parent, style, textual, None)
                counts[key] += 1
                sums[key] += words
            for (node, said), words in texts.items():
                key = (host, node, None, None, None, said)
                counts[key] += 1
                sums[key] = words
            if len(counts) > HELD:
                yield made()
        if counts:
            yield made()


def unimportant(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, low: the nodes of each host's unimportant branches.

    Counts are added up by (host, node, style or text), so a hot host is spread over all tasks. A host's tree, in one
    task, has only nodes of two pages or more, with five numbers each.
    """
    rows = pages.select(host_of(pages[url_col]).alias("host"), text_of(pages, html_col).alias("html")).where("html <> ''")
    counts = rows.mapInArrow(_node_rows, _FACTS).groupBy("host", "node", "style", "text").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("words").alias("most"), F.max("parent").alias("parent"), F.bool_or("textual").alias("textual"))
    n = F.col("n").cast("double")
    styled = F.col("style").isNotNull()
    facts = counts.where(styled | (n > 1)).groupBy("host", "node").agg(
        F.max("parent").alias("parent"),
        F.bool_or("textual").alias("textual"),
        F.coalesce(F.sum(F.when(styled, n)), F.lit(0.0)).alias("pages"),
        F.sum(F.when(styled, n * F.log(n))).alias("nlogn"),
        F.sum(F.when(styled, F.col("words"))).cast("double").alias("words"),
        F.coalesce(F.sum(F.when(~styled, F.col("most") * n * F.log(n))), F.lit(0.0)).alias("repeated"),
    )
    facts = facts.where("pages > 1").select("host", "node", "parent", "textual", "pages", F.expr("ln(pages) - nlogn / pages").alias("entropy"), "words", "repeated")

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        table = {k: (p, n, h, w, r, t) for k, p, n, h, w, r, t in zip(*(group[c].tolist() for c in ("node", "parent", "pages", "entropy", "words", "repeated", "textual")), strict=True)}
        root = table.get(0)
        low = unimportant_nodes(table, int(root[1]), root[3]) if root else []
        return pd.DataFrame({"host": [group["host"].iloc[0]], "low": [low]})

    return cut(facts.groupBy("host").applyInPandas(tree, "host string, low array<long>").where(F.size("low") > 0))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per page: id, url, text, n_chars. A null or empty page has an empty text; a null url is a host of its own.

    The table of hosts is joined to the pages by Spark's own choice: sent to all tasks only if it is small. Broken and
    deep pages take time and room in proportion to their length. Null ids stay; repeated rows give equal texts and count
    as pages of their own; extra columns are ignored; an empty table gives no rows. Nodes and texts are told apart by
    64-bit hashes; a collision, at a chance of k^2 / 2^65 for k nodes of a host, could only merge two nodes' counts.
    """
    low = unimportant(pages, url_col=url_col, html_col=html_col)
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), text_of(pages, html_col).alias("html")).join(low, "host", "left").select("id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [main_text(t.as_py(), low.as_py() or (), names) for t, low in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "url")}
    return rows.mapInArrow(run, f"id {kind['id']}, url {kind['url']}, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
