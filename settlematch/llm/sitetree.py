"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of element paths. One that lays out its children
the same way everywhere, and whose content repeats from page to page, is part of the site and
not of the page: its composite importance (entropy of layouts, and one minus the entropy of
contents over pages, combined bottom-up) is low, and its branch is removed from each page. What
elements say of themselves counts too. Navigation, headers, footers, asides, forms, scripts and
elements named after adverts, notices or comments go at once: their text differs from page to
page too often for statistics. An article or main element is a prior of so many pages: for what
is inside it, and against what is outside on a page that has one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlematch.llm.common import byte_blocks, record_batch
from settlematch.operators.runs import solve_runs
from settlematch.storage import written

# Elements by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_NOT_P = BLOCK - {"p"}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "figcaption"}
NOT_TEXT = frozenset("head script style noscript template textarea title nav header footer aside form button select option menu dialog iframe object embed svg math audio video canvas map fieldset label input search".split())
MAIN = frozenset(("article", "main"))
#: As many pages of importance 1 (in an article or main element) or 0 (outside of it) are added to those seen.
PRIOR = 8
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|popup\w*|modal|cookie\w*|consent\w*|gdpr|notice\w*|newsletter\w*|subscribe\w*|subscription\w*|signup|login|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side-bar|header|masthead|footer|copyright|comments?|comment-\w+|disqus|replies|reply|respond|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|widget\w*|skip)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|[!?])")
_INSIDE_TAG = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset(("ul", "ol", "dl", "table", "menu", "select"))


class Node:
    """An open element: its place in the tree, whether it is site furniture or main content, and its children's names.

    place: a hash of the names from the root down, so that equal paths of a host's pages are one
    node of the tree, however deep they lie.
    """

    __slots__ = ("children", "depth", "drop", "gone", "main", "name", "parent", "place", "said", "tag")

    def __init__(self, tag: str, name: str, above: Node | None, drop: bool, main: bool):
        self.tag, self.name, self.drop, self.main, self.children, self.said = tag, name, drop, main, [], []
        self.parent, self.depth = (above.place, above.depth + 1) if above else (0, 0)
        self.place = xxhash.xxh64_intdigest(f"{self.parent}/{name}") >> 1 if above else 0
        self.gone = bool(above and above.gone)


def _next_tag(page: str, at: int, quotes: bool) -> tuple[tuple[int, int, str, str | None, str] | None, bool]:
    """(start, end, "/" or "", name or None, what is between name and end) of the first tag or comment from ``at`` on.

    With ``quotes``, a ">" in quotes does not end a tag. Where that leaves one without an end, the
    rest of the page goes without, so that no stretch is searched twice. What begins like a tag
    and has no ">" behind it is text.
    """
    m = _OPEN.search(page, at)
    if not m:
        return None, quotes
    if m[0] == "<!--":
        end = page.find("-->", m.end())
        return (m.start(), len(page) if end < 0 else end + 3, "", None, ""), quotes
    inside = _INSIDE_TAG.match(page, m.end()) if quotes and m[2] else None
    quotes = quotes and (inside is not None or not m[2])
    end = inside.end() if inside else page.find(">", m.end()) + 1
    return ((m.start(), end, m[1] or "", m[2] and m[2].lower(), page[m.end() : end - 1]) if end else None), quotes


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def parse(page: str, removed: frozenset[int] | set[int] = frozenset()):
    """Yield ("text", node, text), ("break", node, None) and ("end", node, None) in page order.

    Forgives what browsers forgive: unclosed paragraphs and items, stray end tags, and a last
    tag that never ends, which counts as text.
    """
    stack, at, end, quotes = [Node("", "", None, False, False)], 0, len(page), True
    lower, open_tags = None, Counter()
    while at < end:
        found, quotes = _next_tag(page, at, quotes)
        stop = found[0] if found else end
        if stop > at:
            yield "text", stack[-1], page[at:stop]
        if not found:
            break
        _, at, closing, tag, rest = found
        if not tag:
            continue
        if closing:
            if tag == "br":
                yield "text", stack[-1], " "
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    while len(stack) > k:
                        yield "end", _popped(stack, open_tags), None
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        if tag in ENDS_P:
            yield from _close(stack, open_tags, {"p"}, _NOT_P)
        if tag in _CLOSES:
            yield from _close(stack, open_tags, _CLOSES[tag], _LISTS)
        if tag == "br":
            yield "text", stack[-1], " "
            continue
        attrs, top = _attributes(rest), stack[-1]
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        name = tag + ("." + ".".join(sorted(label.split())) if label else "")
        drop = top.drop or tag in NOT_TEXT or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(label and tag not in ("html", "body") and tag not in MAIN | {"p"} and _NAMED.search(label)) or bool(label and tag == "article" and re.search(r"comment|reply", label, re.I))
        top.children.append(name)
        mine = name + "[main]" if tag not in MAIN and attrs.get("role", "").lower() == "main" else name
        node = Node(tag, mine, top, drop, (top.main or tag in MAIN or attrs.get("role", "").lower() == "main") and not drop)
        node.gone = node.gone or node.place in removed
        if tag in VOID:
            if tag == "hr":
                yield "break", node, None
            continue
        if tag in BLOCK:
            yield "break", node, None
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != end:  # lower-casing can change lengths; search the slow way then
                close = re.compile(f"</{tag}", re.I).search(page, at)
                at = close.start() if close else end
            else:
                close = lower.find(f"</{tag}", at)
                at = close if close >= 0 else end
        if not (rest.endswith("/") and tag not in BLOCK and tag not in RAW):
            stack.append(node)
            open_tags[tag] += 1
    while len(stack) > 1:
        yield "end", _popped(stack, open_tags), None


def _popped(stack: list[Node], open_tags: Counter) -> Node:
    node = stack.pop()
    open_tags[node.tag] -= 1
    return node


def _close(stack: list[Node], open_tags: Counter, tags: set[str], walls: frozenset[str]):
    if not any(open_tags[t] for t in tags):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            while len(stack) > k:
                yield "end", _popped(stack, open_tags), None
            return
        if stack[k].tag in walls:
            return


def host_column(url: str = "url"):
    """Host of a URL in lower case; empty for null and broken ones."""
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


def observations(page: str) -> tuple[int, dict[int, tuple[int, int, str, bool]], set[tuple[int, int, int]]]:
    """What one page adds to its host's tree: a hash of its text outside furniture, its places, and facts about them.

    Places: (parent, depth, name, inside main content) by place. Facts: (place, kind, value); kind
    0: the place occurs; 1: a hash of its children's layout; 2: a hash of text directly in it.
    """
    places, seen, said = {}, set(), []
    for event, node, part in parse(page):
        if node.drop or not node.depth:
            continue
        if event == "text":
            node.said.append(part)
            said.append(part)
        elif event == "end":
            places[node.place] = (node.parent, node.depth, node.name, node.main)
            seen.add((node.place, 0, 0))
            names = [n for i, n in enumerate(node.children) if not i or n != node.children[i - 1]]
            seen.add((node.place, 1, xxhash.xxh64_intdigest("|".join(names)) >> 1))
            whole = " ".join("".join(node.said).split())
            if whole:
                seen.add((node.place, 2, xxhash.xxh64_intdigest(whole) >> 1))
    return xxhash.xxh64_intdigest(" ".join("".join(said).split())) >> 1, places, seen


_SEEN = pa.schema([("host", pa.string()), ("page", pa.int64()), ("place", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("name", pa.string()), ("inside", pa.bool_()), ("kind", pa.int32()), ("value", pa.int64())])


def compose(depth: list[int], place: list[int], parent: list[int], pages: list[int], layouts: list[int], once: list[int], layout: list[float], content: list[float | None], inside: list[bool], damping: float) -> dict[int, tuple[float, float]]:
    """Composite importance of every place of one host, worked out from the deepest up, and the highest at or below it.

    The highest is taken with the prior of main content, where a place lies in it.
    """
    value: dict[int, tuple[float, float]] = {}
    highest: dict[int, float] = {}
    below: dict[int, tuple[float, float]] = {}  # weight, weighted sum of what lies directly below
    for i in sorted(range(len(place)), key=lambda i: (-depth[i], place[i])):
        weight, total = below.get(place[i], (0.0, 0.0))
        if content[i] is not None:
            weight, total = weight + pages[i], total + pages[i] * content[i]
        weight, total = weight + once[i], total + once[i]
        share = damping ** layouts[i] if weight else 1.0
        inner = total / weight if weight else 0.0
        own = min(max((1 - share) * inner + share * max(layout[i], inner if weight else 0.0), 0.0), 1.0)
        known = (pages[i] * own + PRIOR) / (pages[i] + PRIOR) if inside[i] else own
        value[place[i]] = own, max(known, highest.get(place[i], 0.0), 1.0 if once[i] else 0.0)
        w, t = below.get(parent[i], (0.0, 0.0))
        below[parent[i]] = (w + pages[i], t + pages[i] * own)
        highest[parent[i]] = max(highest.get(parent[i], 0.0), value[place[i]][1])
    return value


def importance(pages: DataFrame, damping: float = 0.9) -> DataFrame:
    """The trees: host, place, parent, depth, name, inside, pages, composite importance (0 to 1) and the highest at or below it, of every place on two or more pages of a host.

    Pages of a host that say the same count once: copies are no template. A place seen on one
    page has importance 1; it is only summed into its parent. Layouts: entropy over the pages'
    layouts, to the base of the number of pages. Contents: one minus the mean entropy of the texts'
    spread over pages. Parents mix their own layout entropy with their children's importance,
    weighted by damping to the power of the number of layouts.
    """

    def run(batches):
        for batch in byte_blocks(batches, rows=128, column="html"):
            out = {name: [] for name in _SEEN.names}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                digest, places, seen = observations(page or "")
                for place, kind, value in seen:
                    for name, x in zip(_SEEN.names, (host, digest, place, *places[place], kind, value), strict=True):
                        out[name].append(x)
            yield record_batch(_SEEN, out)

    seen = pages.select(host_column().alias("host"), "html").mapInArrow(run, "host string, page long, place long, parent long, depth int, name string, inside boolean, kind int, value long")
    where = ["host", "place", "parent", "depth", "name", "inside"]
    counts = seen.distinct().groupBy(*where, "kind", "value").agg(F.count("*").alias("n"))
    # one row per place: pages, entropy of layouts, mean spread of texts
    log = F.log(F.col("n").cast("double"))
    facts = written(counts.groupBy(*where).agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("laid"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * log)).alias("n_log_n"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("layouts"),
        F.avg(F.when(F.col("kind") == 2, log)).alias("spread"),
    ))
    once = facts.where("pages < 2").groupBy("host", F.col("parent").alias("place")).agg(F.count("*").alias("once"))
    many = F.log(F.col("pages").cast("double"))
    facts = facts.where("pages > 1").join(once, ["host", "place"], "left").select(
        *where, "pages", "layouts", F.coalesce("once", F.lit(0)).cast("long").alias("once"),
        ((F.log(F.col("laid").cast("double")) - F.col("n_log_n") / F.col("laid")) / many).alias("layout"),
        (1 - F.col("spread") / many).alias("content"),
    )

    def solve(host: dict[str, list]) -> list[tuple]:
        value = compose(*(host[c] for c in ("depth", "place", "parent", "pages", "layouts", "once", "layout", "content", "inside")), damping)
        return [(*row, *value[row[1]]) for row in zip(*(host[c] for c in (*where, "pages")), strict=True)]

    # one row per place that pages of a host share; places of a single page (ids in names) are summed above
    return solve_runs(facts, "host", [], solve, "host string, place long, parent long, depth int, name string, inside boolean, pages long, importance double, highest double")


def judged(tree: DataFrame, least: float) -> DataFrame:
    """Of every host, the places of :func:`importance` that are removed, and the ones that stay beside an article or main element.

    A branch goes where neither its root nor anything below is important.
    """
    seen, prior = F.col("pages") * F.col("importance"), F.col("pages") + PRIOR
    removed = F.col("highest") < least
    beside = ~F.col("inside") & (seen / prior >= least)
    return tree.groupBy("host").agg(F.collect_set(F.when(removed, F.col("place"))).alias("removed"), F.collect_set(F.when(beside, F.col("place"))).alias("beside")).where((F.size("removed") > 0) | (F.size("beside") > 0))


def main_text(page: str, removed: frozenset[int] | set[int] = frozenset(), beside: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the page's main content, one line each.

    removed: places of its host that go, with all below them; beside: those that stay outside an
    article or main element where the page has one. Where both leave nothing, such an element stays whole.
    """
    lines: list[tuple[int, str]] = []
    current: list[str] = []
    state = [_OUTSIDE]  # standing of the block being gathered

    def flush():
        line = " ".join(html.unescape("".join(current)).split())
        if line:
            lines.append((state[0], line))
        current.clear()

    for event, node, part in parse(page, removed):
        if event == "text":
            if node.drop:
                continue
            now = (_REMOVED if node.main else None) if node.gone else _INSIDE if node.main else _BESIDE if node.place in beside else _OUTSIDE
            if now is None:
                continue
            if current and (now == _REMOVED) != (state[0] == _REMOVED):
                flush()
            if not current:
                state[0] = now
            current.append(part)
        elif event == "break" or node.tag in BLOCK:
            flush()
    flush()
    found = {x for x, _ in lines}
    if _INSIDE in found:
        kept = {_INSIDE, _BESIDE}
    elif _REMOVED in found:
        kept = {_BESIDE} if _BESIDE in found else {_REMOVED}
    else:
        kept = {_OUTSIDE, _BESIDE}
    return "\n".join(line for x, line in lines if x in kept)


_REMOVED, _OUTSIDE, _BESIDE, _INSIDE = range(4)
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, *, least: float = 0.5, broadcast_bytes: int = 64 << 20, salts: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of every page; empty where nothing is left (null html too).

    Hosts' lists of places travel by broadcast while they take at most ``broadcast_bytes``, and
    by a join salted over ``salts`` beyond, so that a host with most of the pages is not one
    task. Pages with a null or broken url share one nameless host. Repeated rows repeat.
    """
    low = written(judged(importance(pages), least))
    rows = pages.select("page_id", "url", "html", host_column().alias("host"))
    size = low.agg(F.sum(F.length("host") + 64 + 8 * (F.size("removed") + F.size("beside")))).head()[0] or 0
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        rows = rows.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")

    def run(batches):
        for batch in byte_blocks(batches, rows=128, column="html"):
            texts = [main_text(page or "", set(removed or ()), set(beside or ())) for page, removed, beside in zip(*(batch.column(c).to_pylist() for c in ("html", "removed", "beside")), strict=True)]
            yield record_batch(_TEXT, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))})

    return rows.select("page_id", "url", "html", "removed", "beside").mapInArrow(run, "page_id long, url string, text string, n_chars long")
