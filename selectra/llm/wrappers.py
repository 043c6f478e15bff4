"""Main-text extraction with wrappers inferred per host.

Pages of a host come from templates. A wrapper is a union-free regular expression
over a host's token streams: tags, text slots, optional groups and repeated groups.
It is inferred by aligning pages one after another. As long as the pages' children of
an element are the same tags, they are aligned by place. Where they differ, the
mismatch is resolved: children of one tag become one, those that some pages lack are
optional, and those that come again or in another order form a repeated group
(``expression`` reads the groups off the orders seen). Differing texts at one place
are a slot, equal texts a constant of the template. Aligning is commutative and
associative, so a wrapper doesn't depend on how pages are dealt to tasks: partial
wrappers are folded inside each task and merged per host in two steps, and a host
with a third of all pages needs no task that sees all of them.

The wrapper then says where the record, the main text, lies: in the subtree whose
varying slots hold most of the running text over the host. From the root on, the child
is followed that holds three fifths of what its pages have there; optional groups that
exclude each other are ranked, so every template of a host keeps its own record. Slots
of links and slots that are constant over different pages weigh nothing, nor do parts
beside the text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments; known by tags and names). Tags and names of main text weigh more and end the
search. Every page is matched with its host's wrapper and read by its slots, in page
order from the whole html; nothing on the single page decides but which of the ranked
groups it has. Inside the record all text stays but slots of links, parts known by
their tags, and adverts, comments, sidebars and the like by a short list of names.

Defined cases: null and empty pages have an empty text; a null or odd url makes a
host of its own (""); a host with one page, or copies of one, has only slots that may vary; text outside any tag is a
block of the page's root; depth and number of elements have no bound; ids may be null
or repeat; other columns pass through unless they are named like an output.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from selectra.llm.common import joined_by_size, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that a new one of these ends (the end tag may be left out).
ENDED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}
#: Blocks that end an open paragraph.
AFTER_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MAIN = re.compile(r"^(article|main)\b|[.#](main|article|content|post|entry|story)([-_ .#]|$)|@main")
BESIDE_TAG = frozenset("head nav footer aside form button select textarea option dialog menu title fieldset".split())
#: Names of parts beside the text. Whole words: "with-sidebar" or "comments-open" say how a page looks, not what a part is.
BESIDE_NAME = re.compile(
    r"((site|page|main|top|bottom|left|right|primary|secondary|global|mobile|user|reader|post|entry|article|cookie|blog|google|text)[-_]?)?"
    r"(ads?|adverts?|advertis\w+|adsense|adslot|banners?|sponsor(s|ed)?|promos?|promotions?|cookies?|consent|notices?|alerts?|comments?|respond|responses?|disqus|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?"
    r"|footer|masthead|share|sharing|social|related|recommend(ed|ations?)|subscribe|newsletter|signup|login|popup|modal|widgets?|pagination|pager|copyright|legal|toc|search)"
    r"([-_]?(bar|box|block|area|list|items?|wrap|wrapper|container|inner|section|slot|unit|banner|links?|buttons?|icons?|form|menu|body|content|text|title|notice|thread|posts|articles|widget))*"
    r"|((site|page|main|top|global|mobile|blog)[-_]?)?header([-_]?(bar|inner|wrap|wrapper|container|menu|nav))?|side|skip([-_]\w+)*"
)
#: Names of parts that are no text inside a region either: adverts, reader comments, sidebars, menus, offers to share or subscribe.
INSIDE_NAME = re.compile(
    r"((site|page|main|user|reader|post|entry|article|cookie|google|text)[-_]?)?"
    r"(ads?|adverts?|advertis\w+|adsense|adslot|sponsor(s|ed)?|promos?|promotions?|cookies?|comments?|respond|responses?|disqus|sidebars?|menus?|navbar|navigation|breadcrumbs?|share|sharing|subscribe|newsletter|pagination|pager)"
    r"([-_]?(bar|box|block|area|list|items?|wrap|wrapper|container|inner|section|slot|unit|banner|links?|buttons?|icons?|form|menu|body|notice|thread))*"
)
#: Blocks of running text: no region lies inside one.
LEAF = frozenset("p li td th dt dd tr blockquote pre h1 h2 h3 h4 h5 h6".split())
MAX_HOSTS = 400
#: Bytes of text of the wrappers that a task keeps unpacked.
UNPACKED = 4 << 20
#: Bytes of wrappers that are sent to every task; more are met by a shuffle of the pages.
MOST_BYTES = 64 << 20
#: Pages of one host that are then read with one copy of its wrapper, as expected.
PAGES = 500
#: A slot is constant if so many different pages have the same text in it; copies of a page count once.
DISTINCT = 2


def key_of(name: str, attributes: str) -> str:
    """Tag with its class, id and role, digits left out."""
    out = name
    if "=" in attributes:
        for kind, *values in ATTRIBUTE.findall(attributes):
            value = re.sub(r"\d+", "", next((v for v in values if v), "")).strip().lower()
            if value:
                out += {"c": ".", "i": "#", "r": "@"}[kind[0].lower()] + " ".join(value.split())
    return out


# A wrapper node is [key, parents that have it, times, slot, children, orders]. Children are aligned by place while orders
# is None; then they are one a key, and orders are the pairs of keys seen next to each other. Text nodes have the key "#"
# and the slot [characters, characters in links, least text hash, greatest text hash, the least DISTINCT hashes of whole
# pages that have it]; in a page's own tree the slot is the number of the text or element.
KEY, PRESENT, TIMES, SLOT, CHILDREN, ORDERS = range(6)


def parsed(html: str) -> tuple[list, list[tuple[tuple[str, ...], tuple[int, ...], str, int]]]:
    """The tree of a page, and its texts in page order: (keys and numbers of the elements it is in, text, characters in links)."""
    root: list = ["", 1, 1, None, [], None]
    nodes, keys, numbers, names, texts = [root], [], [], [], []
    text: list[str] = []
    linked = links = opened = 0

    def flush() -> None:
        nonlocal linked
        found = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if found:
            nodes[-1][CHILDREN].append(["#", 1, 1, len(texts), [], None])
            texts.append((tuple(keys), tuple(numbers), found, min(linked, len(found))))
        linked = 0

    def close() -> None:
        for stack in (nodes, keys, numbers, names):
            stack.pop()

    for match in TOKEN.finditer(html):
        raw = match[5]
        if raw is not None:
            text.append(raw)
            linked += len(raw) * (links > 0)
            continue
        if not match[3]:
            continue
        name, closing = match[3].lower(), bool(match[2])
        if name in INLINE:
            links = max(0, links + (-1 if closing else 1)) if name == "a" else links
            continue
        if name in VOID:
            text.append(" ")
            continue
        flush()
        links = 0
        if closing:
            if name in names:
                while names[-1] != name:
                    close()
                close()
            continue
        ends = ENDED_BY.get(name, "").split()
        while names and (names[-1] in ends or names[-1] == "p" and name in AFTER_P):
            close()
        opened += 1
        node = [key_of(name, match[4]), 1, 1, opened, [], None]
        nodes[-1][CHILDREN].append(node)
        for stack, value in ((nodes, node), (keys, node[KEY]), (numbers, opened), (names, name)):
            stack.append(value)
    flush()
    return root, texts


def each_node(root: list) -> Iterator[list]:
    """All nodes, parents first, children in order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node[CHILDREN]))


def tree(html: str) -> list:
    """The wrapper of one page."""
    root, texts = parsed(html)
    page = zlib.crc32(html.encode("utf-8", "replace"))
    for node in each_node(root):
        if node[KEY] == "#":
            _, _, text, linked = texts[node[SLOT]]
            h = zlib.crc32(text.encode())
            node[SLOT] = [len(text), linked, h, h, [page]]
        else:
            node[SLOT] = None
    return root


def both(a: list, b: list) -> list:
    """The slot that covers two."""
    return [a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:DISTINCT]]


def keys_of(node: list) -> list[str]:
    return [c[KEY] for c in node[CHILDREN]]


def by_key(node: list) -> list[tuple[list, list]]:
    """Make the children one a key; the neighbours that must still be aligned to that end."""
    if node[ORDERS] is not None:
        return []
    found, first = [], {}
    keys = keys_of(node)
    for child in node[CHILDREN]:
        if first.setdefault(child[KEY], child) is not child:
            found.append((first[child[KEY]], child))
    node[CHILDREN], node[ORDERS] = list(first.values()), set(zip(keys, keys[1:]))
    return found


def aligned(a: list, b: list) -> list:
    """The least wrapper that covers both, made in place of ``a``."""
    todo = [(a, b, False)]  # two nodes, and whether they have one parent
    while todo:
        one, two, siblings = todo.pop()
        one[PRESENT] = max(one[PRESENT], two[PRESENT]) if siblings else one[PRESENT] + two[PRESENT]
        one[TIMES] += two[TIMES]
        if two[SLOT]:
            one[SLOT] = both(one[SLOT], two[SLOT])
        if one[ORDERS] is None and two[ORDERS] is None and keys_of(one) == keys_of(two):
            todo.extend((x, y, False) for x, y in zip(one[CHILDREN], two[CHILDREN], strict=True))
            continue
        folds = by_key(one) + by_key(two)
        own = {c[KEY]: c for c in one[CHILDREN]}
        for child in two[CHILDREN]:
            if child[KEY] in own:
                todo.append((own[child[KEY]], child, False))
            else:
                one[CHILDREN].append(child)
        one[ORDERS] |= two[ORDERS]
        todo.extend((x, y, True) for x, y in folds)  # taken from the end, so before what stands below
    return a


def packed(root: list) -> str:
    """A wrapper as text: its nodes, parents first. Children aligned by key are sorted, so equal wrappers have equal texts."""
    rows = []
    for node in each_node(root):
        if node[ORDERS] is not None:
            node[CHILDREN].sort(key=lambda c: c[KEY])
        rows.append([*node[:CHILDREN], len(node[CHILDREN]), None if node[ORDERS] is None else sorted(node[ORDERS])])
    return json.dumps(rows, separators=(",", ":"))


def unpacked(text: str) -> list:
    at: list[tuple[list, int]] = []
    root: list = []
    for *head, n, orders in json.loads(text):
        node = [*head, [], None if orders is None else {(x, y) for x, y in orders}]
        while at and len(at[-1][0][CHILDREN]) == at[-1][1]:
            at.pop()
        if at:
            at[-1][0][CHILDREN].append(node)
        else:
            root = node
        at.append((node, n))
    return root


def groups(keys: list[str], orders: set[tuple[str, str]]) -> list[list[str]]:
    """Keys in an order that agrees with the pairs; keys that follow each other both ways are one group."""
    after, before = {k: [] for k in sorted(keys)}, {k: [] for k in keys}
    for x, y in sorted(orders):
        after[x].append(y)
        before[y].append(x)

    def visited(start: str, ways: dict[str, list[str]], seen: set[str]) -> list[str]:
        """Keys first reached from ``start``, in the order in which they are left."""
        left, path = [], [(start, iter(ways[start]))]
        seen.add(start)
        while path:
            for k in path[-1][1]:
                if k not in seen:
                    seen.add(k)
                    path.append((k, iter(ways[k])))
                    break
            else:
                left.append(path.pop()[0])
        return left

    seen: set[str] = set()
    finished = [k for start in after if start not in seen for k in visited(start, after, seen)]
    seen = set()
    return [sorted(visited(k, before, seen), key=finished[::-1].index) for k in reversed(finished) if k not in seen]


def expression(root: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    inner: dict[int, str] = {}

    def often(text: str, optional: bool, repeated: bool) -> str:
        return f"( {text} ){'*' if optional and repeated else '?' if optional else '+'}" if optional or repeated else text

    for node in reversed(list(each_node(root))):
        text = {id(c): inner.pop(id(c)) for c in node[CHILDREN]}
        alone = {id(c): often(text[id(c)], c[PRESENT] < node[TIMES], c[TIMES] > c[PRESENT]) for c in node[CHILDREN]}
        if node[ORDERS] is None:
            parts = [alone[id(c)] for c in node[CHILDREN]]
        else:
            at, parts = {c[KEY]: c for c in node[CHILDREN]}, []
            for group in groups(keys_of(node), node[ORDERS]):
                if len(group) == 1:
                    parts.append(alone[id(at[group[0]])])
                    continue
                some = " ".join(often(text[id(at[k])], True, (k, k) in node[ORDERS]) for k in group)
                parts.append(f"( {some} ){'*' if all(at[k][PRESENT] < node[TIMES] for k in group) else '+'}")
        if node[KEY] == "#":
            parts = ["#const" if node[SLOT][2] == node[SLOT][3] else "#text"]
        elif node[KEY]:
            parts = [f"<{node[KEY]}>", *parts, f"</{tag(node[KEY])}>"]
        inner[id(node)] = " ".join(parts)
    return inner[id(root)]


def tag(key: str) -> str:
    return re.split(r"[.#@]", key, maxsplit=1)[0]


#: Marks of a slot: constant over different pages, mostly links, below a tag beside the text, below a name beside the text
#: outside a marked region, inside a marked region, and below a name beside the text in there.
CONSTANT, LINKS, DROPPED, AROUND, IN_MAIN, INSIDE = 1, 2, 4, 8, 16, 32
BARRED = LINKS | DROPPED | AROUND | INSIDE
#: Text below a tag or name of main text weighs so much more where the record's subtree is chosen.
MARKED = 5


@lru_cache(maxsize=100_000)
def key_traits(key: str) -> tuple[str, bool, bool, bool]:
    """The tag of a key, whether a main region begins there, and whether it is named like a part beside the text, or like one that isn't text even inside a region. Names of html and body say nothing."""
    name = tag(key)
    if name in ("html", "body"):
        return name, False, False, False
    names = re.split(r"[.#@ ]", key)[1:]
    return name, bool(MAIN.search(key)), any(map(BESIDE_NAME.fullmatch, names)), any(map(INSIDE_NAME.fullmatch, names))


def _marked(wrapper: list) -> list[tuple[list, int, int]]:
    """(node, marks, depth of the deepest element around it with a name that isn't text inside a region) of all nodes, parents first."""
    out, todo = [], [(wrapper, 0, 0, 0)]
    while todo:
        node, depth, marks, within = todo.pop()
        slot = node[SLOT]
        if slot:
            marks |= CONSTANT * (slot[2] == slot[3] and len(slot[4]) == DISTINCT) | LINKS * (2 * slot[1] > slot[0])
        elif node[KEY]:
            name, begins, beside, inside = key_traits(node[KEY])
            if name in BESIDE_TAG or name == "header" and not (begins or marks & IN_MAIN):
                marks |= DROPPED
            if marks & IN_MAIN:
                marks |= INSIDE * inside
            else:
                marks |= AROUND * beside | IN_MAIN * begins
            within = depth if inside else within
        out.append((node, marks, within))
        todo.extend((c, depth + 1, marks, within) for c in reversed(node[CHILDREN]))
    chars = {True: 0, False: 0}  # in a marked region below a name beside the text; clear of such names
    plain = True
    for node, marks, _ in out:
        if node[SLOT] and not marks & (BARRED & ~AROUND) and (not marks & AROUND or marks & IN_MAIN):
            chars[bool(marks & AROUND)] += node[SLOT][0] - node[SLOT][1]
            plain &= not marks & IN_MAIN or bool(marks & AROUND)
    if plain and chars[True] > chars[False]:
        out = [(n, m & ~AROUND if m & IN_MAIN else m, w) for n, m, w in out]
    return out


def _entered(node: list, weight: dict[int, int]) -> list[list]:
    """The children that hold the record where a page has them, best first.

    Text a page with the child is weighed against what such a page has beside it at least: optional groups that exclude
    each other are templates of their own, each of which may hold the record of its pages.
    """
    held = [(c, weight[id(c)] / c[PRESENT]) for c in node[CHILDREN] if weight[id(c)]]
    rates: dict[int, float] = {}
    for c, rate in held:
        rates[c[PRESENT]] = rates.get(c[PRESENT], 0.0) + rate

    def beside(c: list, rate: float) -> float:
        n = c[PRESENT]
        return sum(r * max(0, p + n - node[TIMES]) / n for p, r in rates.items()) - rate * max(0, 2 * n - node[TIMES]) / n

    found = [(c, rate) for c, rate in held if c[KEY] != "#" and tag(c[KEY]) not in LEAF and 2 * rate >= 3 * beside(c, rate)]
    return [c for c, _ in sorted(found, key=lambda x: -x[1])]


def rules(wrapper: list) -> str:
    """What pages are read with, as text: [key, rank, 1, marks, children, whether they are aligned by place] of each node.

    An element's rank (from 1) says that the record is looked for below it, in a page that has none of its siblings of a
    lower rank; 0: never. A text's rank is the depth of the last name around it that isn't text inside a region. Only
    slots that vary (or came once), are not mostly links and not below parts beside the text have a weight, by their
    characters over all pages; constant ones have where nothing else does.
    """
    nodes = _marked(wrapper)
    rank: dict[int, int] = {}
    for barred in (BARRED | CONSTANT, BARRED):
        weight: dict[int, int] = {}
        for node, marks, _ in reversed(nodes):
            if node[SLOT]:
                weight[id(node)] = 0 if marks & barred else (node[SLOT][0] - node[SLOT][1]) * (MARKED if marks & IN_MAIN else 1)
            else:
                weight[id(node)] = sum(weight[id(c)] for c in node[CHILDREN])
        if weight[id(wrapper)]:
            break
    for node, marks, _ in nodes:
        if not marks & IN_MAIN:
            rank.update((id(c), k) for k, c in enumerate(_entered(node, weight), 1))
    rows = [[n[KEY], w if n[SLOT] else rank.get(id(n), 0), 1, m if n[SLOT] else 0, len(n[CHILDREN]), None if n[ORDERS] is None else []] for n, m, w in nodes]
    return json.dumps(rows, separators=(",", ":"))


def matched(page: list, slots: list) -> list[tuple[list, list]]:
    """The children of a page's element with what the wrapper has for them."""
    if slots[ORDERS] is None and keys_of(page) == keys_of(slots):
        return list(zip(page[CHILDREN], slots[CHILDREN], strict=True))
    own = {c[KEY]: c for c in slots[CHILDREN]}
    return [(c, own[c[KEY]]) for c in page[CHILDREN] if c[KEY] in own]


def slots_of(page: list, wrapper: list, n: int) -> list[list | None]:
    """The slots of a page's texts, found by matching its tree with the wrapper (from ``rules``); None where it has none."""
    found, todo = [None] * n, [(page, wrapper)]
    while todo:
        one, slots = todo.pop()
        if one[KEY] == "#":
            found[one[SLOT]] = slots
        else:
            todo.extend(matched(one, slots))
    return found


def page_text(html: str | None, wrapper: list) -> str:
    """Main text of a page, read by its host's wrapper (from ``rules``); text that the wrapper has no slot for is none.

    From the root on, the elements of the lowest rank that hold text are followed. Where that ends lies the record. All its
    slots are text but those of links, those below tags beside the text and those below the few names that say so inside.
    Constant slots stay, but for a record that is the whole page. A page with nothing but constant slots is read with them,
    one with nothing else than barred slots of a marked region with those.
    """
    root, texts = parsed(html or "")
    slots = slots_of(root, wrapper, len(texts))
    for barred, needed in ((BARRED | CONSTANT, 0), (BARRED, 0), (DROPPED, IN_MAIN)):
        usable = {k for k, s in enumerate(slots) if s and not s[SLOT] & barred and s[SLOT] & needed == needed}
        if usable:
            break
    else:
        return ""
    holds = {e for k in usable for e in texts[k][1]}
    here, depth = [(root, wrapper)], 0
    while True:
        inner = [(c, s) for pair in here for c, s in matched(*pair) if c[KEY] != "#" and s[PRESENT] and c[SLOT] in holds]
        if not inner:
            break
        best = min(s[PRESENT] for _, s in inner)
        here, depth = [pair for pair in inner if pair[1][PRESENT] == best], depth + 1
    record = {one[SLOT] for one, _ in here}
    top = not depth or tag(here[0][0][KEY]) in ("html", "body")
    out = []
    for k, (_, elements, text, _) in enumerate(texts):
        if not depth or len(elements) >= depth and elements[depth - 1] in record:
            s = slots[k]
            if k in usable or not top and s and not s[SLOT] & (DROPPED | LINKS) and s[PRESENT] <= depth:
                out.append(text)
    return "\n".join(out)


def rules_at_hand(known: dict[str, str]):
    """Wrappers unpacked as they are asked for; the last ones stay, of up to ``UNPACKED`` bytes of text in all."""
    kept: dict[str, list] = {}
    size = 0

    def get(name: str) -> list:
        nonlocal size
        found = kept.pop(name, None)
        if found is None:
            found = unpacked(known[name])
            size += len(known[name])
        kept[name] = found
        while size > UNPACKED and len(kept) > 1:
            oldest = next(iter(kept))
            del kept[oldest]
            size -= len(known[oldest])
        return found

    return get


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the pages of a task into one wrapper a host."""
    found: dict[str, list] = {}
    part = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        rows = [(h, part, n, packed(w)) for h, (w, n) in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], ["host", "part", "pages", "wrapper"])

    for batch in batches:
        for name, html in zip(batch.column(0), batch.column(1), strict=True):
            page, old = tree(html.as_py() or ""), found.get(name.as_py())
            found[name.as_py()] = [page, 1] if old is None else [aligned(old[0], page), old[1] + 1]
            if len(found) > MAX_HOSTS:
                yield out()
    yield out()


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper a key; a task holds one at a time."""
    names, schema = [*keys, "pages", "wrapper"], rows.select(*keys, "pages", "wrapper").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pages, wrapper = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], batch.column(k).type) for k, v in enumerate(at)), pa.array([pages]), pa.array([packed(wrapper)])], names)

        for batch in batches:
            for *key, n, text in zip(*batch.columns, strict=True):
                key, page = [k.as_py() for k in key], unpacked(text.as_py())
                if key != at:
                    if at is not None:
                        yield out()
                    at, pages, wrapper = key, n.as_py(), page
                else:
                    pages, wrapper = pages + n.as_py(), aligned(wrapper, page)
        if at is not None:
            yield out()

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper): the wrapper of each host over all its pages, as ``packed`` text."""
    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = rows.mapInArrow(_partial, "host string, part int, pages long, wrapper string")
    # Two steps: the wrappers of 64 tasks, then one of each host.
    return _merged(_merged(parts.withColumn("salt", F.floor(F.col("part") / 64)), ["host", "salt"]), ["host"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", columns: Sequence[str] | None = None) -> DataFrame:
    """The input's columns (or those named) plus text: the main text of every page.

    Wrappers of up to ``MOST_BYTES`` in all are sent to every task, and pages are read where they lie. Beyond, pages meet
    their host's wrapper in (host, salt) groups of about ``PAGES`` pages, each sorted behind one copy of the wrapper, so a
    task holds one wrapper at a time whatever their number, and a hot host is split.
    """
    names = [c for c in columns or pages.columns if c.lower() != "text"]
    schema = StructType([*(pages.schema[c] for c in names), StructField("text", StringType())])

    def to_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, wrapper in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([n.as_py()]), pa.array([rules(unpacked(wrapper.as_py()))])], ["_host", "_pages", "_body"])

    known = written(infer(pages, url_col, html_col).mapInArrow(to_rules, "_host string, _pages long, _body string"), "rules")
    n_hosts, n_bytes = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_body") + F.octet_length("_host")), F.lit(0))).first()
    row, body = F.struct(*names).alias("_row"), F.col(html_col).cast("string").alias("_body")
    if n_bytes <= MOST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["_host"]: r["_body"] for r in known.select("_host", "_body").collect()})

        def read_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrapper_of = rules_at_hand(sent.value)
            for batch in batches:
                found = [page_text(html.as_py(), wrapper_of(name)) for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.column(2).flatten(), pa.array(found, pa.string())], [*names, "text"])

        return pages.select(host(F.col(url_col)).alias("_host"), body, row).mapInArrow(read_here, schema)

    known = known.withColumn("_salts", F.ceil(F.col("_pages") / PAGES).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt")
    hashed = [c for c in pages.columns if not any(k in pages.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    rows = pages.select(row, host(F.col(url_col)).alias("_host"), body, F.xxhash64(*hashed).alias("_spread"))
    rows = joined_by_size(rows, known.select("_host", "_salts"), ["_host"], n_hosts)
    rows = rows.select("_host", F.pmod("_spread", "_salts").cast("int").alias("_salt"), F.lit(True).alias("_page"), "_body", "_row")
    heads = known.select("_host", salts, F.lit(False).alias("_page"), "_body", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    dealt = heads.unionByName(rows).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_page")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper: list = []
        for batch in batches:
            found = []
            for is_page, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if is_page:
                    found.append(page_text(text.as_py(), wrapper))
                else:
                    wrapper = unpacked(text.as_py())
            out = batch.filter(batch.column(0)).column(2)
            yield pa.RecordBatch.from_arrays([*out.flatten(), pa.array(found, pa.string())], [*names, "text"])

    return dealt.select("_page", "_body", "_row").mapInArrow(read, schema)
