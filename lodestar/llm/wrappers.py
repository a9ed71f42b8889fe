"""Main text of web pages by wrappers, one for each template of a host, inferred without unions.

A page is read as the stream of its block-level tags and texts, and its wrapper is a regular expression over such streams
without unions, kept as a tree: an element's content is a sequence of groups, (..)+ where a page repeats it, (..)? where a page
lacks it, with '..' for a text that all pages share and # for a slot of differing texts. Runs of up to three siblings of like
form fold into a repeated group. The pages of a host are aligned one after another: groups of equal form meet; a mismatch
meets the most similar group of the same tag in the gap, whose content is then aligned in turn; what is left is optional; texts
that differ become a slot. A single run of what another page repeats is one round of the repeated group.

The wrapper tells the article from its surroundings. A node's mass is its text outside links, where fixed text (equal on all
pages, of three or more) counts a fifth and boilerplate elements nothing. An article or main element is taken if it has a third
of the mass; else the node is sought that holds the mass: from the root on the way leads into the one child that has more
than half of it, and ends where the mass is spread or repeated. Headings beside the way belong to it. Where the way ends
at a single text, siblings that are fixed or links stay behind. Elements whose kind or role says that they are menus, forms,
asides and the like, or whose class does (reader comments look like any other text), are left out inside the article, too.

All pages take part. Each task aligns its own pages, and partial wrappers are aligned in two rounds, so a host with a third
of all pages is spread like the others. Wrappers are broadcast if they measure at most `broadcast_mb`, and joined by host
otherwise, where the adaptive planner splits a hot host. Texts stand in a wrapper as hashes, so its size follows the host's
kinds of blocks, not its pages.

Defined results: a null or blank page has an empty text; a null or bad url belongs to the host ''; repeated rows come out each;
very long pages are read whole, in time linear in their length; unclosed comments, scripts and styles end with the page, other
unclosed elements with their parent; of nodes of equal mass the first counts; an id that is no number is null; an empty
table gives no rows; other columns are not read."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Elements that hold no text to read, that begin a block, that have no end tag, and that are boilerplate.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas", "math")
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section select summary table tbody td
tfoot th thead tr ul option optgroup button label""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog head select option optgroup button label legend fieldset search".split())
BOILERPLATE_WORDS = frozenset("""ad ads advert advertisement advertisements adverts advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay
pager pagination popup popups promo promotion promotions promoted recommended related replies reply respond search share sharing sidebar
signin signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets warning alert register
rail teaser teasers trending popular side foot topnav subnav crumb crumbs adbox adslot advertorial disclaimer discussion feedback""".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An open element of the first kind is ended by the start of one of the second.
ENDS = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}, "head": {"body"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LAYOUT = re.compile(r"\b(?:with|has|no|without)[-_][a-z]+", re.I)  # says what a container has beside it, not what it is


#: Ids of these are anchors, which say what the text is about.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 hgroup p li dt dd blockquote pre figure figcaption caption td th tr".split())


@lru_cache(maxsize=20000)
def _mark(tag: str, attrs: tuple, inside: bool = False) -> tuple[str, bool]:
    """An element's token, and whether it is hidden: the tag, with ! if it is boilerplate by kind, class, id or role, or with
    . if it is an article or main element. Other names are dropped, for they differ from page to page. The id of a heading
    or a paragraph makes no boilerplate, nor that of a section inside an article."""
    bad, hidden = tag in BOILERPLATE_TAGS, False
    good = tag in ("article", "main")
    for name, value in attrs:
        if name in ("class", "id", "itemprop"):
            words = {w.lower() for w in _WORD.findall(_LAYOUT.sub("", value))}
            if tag in ("div", "section") and "header" in words:
                tag = "header"
            if name != "id" or not (tag in ANCHORED or (tag == "section" and inside)):
                bad |= bool(words & BOILERPLATE_WORDS)
        elif name == "role":
            bad |= value.lower() in BOILERPLATE_ROLES
            if value.lower() in ("main", "article"):
                tag, good = value.lower(), True
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (
                name == "aria-hidden" and value == "true"):
            hidden = True
    return tag + ("!" if bad and tag not in ("body", "html") else "." if good else ""), hidden


_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[\s/]*([^\s=/>]+)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
#: A page's elements may nest as deep as this; what is deeper stands beside.
DEEP = 40


class Node:
    """An element of a page (tag, children), or a text: tag '#'."""

    __slots__ = ("tag", "kids", "text", "links")

    def __init__(self, tag: str, text: str = "", links: int = 0):
        self.tag, self.text, self.links, self.kids = tag, text, links, []


def _tag_end(s: str, i: int, lost: set[str]) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag ends whose attributes begin at i, and the attributes. lost: quotes that don't occur any more."""
    attrs = []
    while True:
        m = _PART.match(s, i)
        if m is None:
            k = s.find(">", i)
            return (len(s) if k < 0 else k + 1), attrs
        i = m.end()
        value = ""
        if m[2]:
            quote = s[i:i + 1]
            k = s.find(quote, i + 1) if quote in ("'", '"') and quote not in lost else -1
            if k >= 0:
                value, i = s[i + 1:k], k + 1
            else:
                if quote in ("'", '"'):
                    lost.add(quote)
                value = _BARE.match(s, i)[0]
                i += len(value)
        attrs.append((m[1].lower(), value))


def _tokens(s: str) -> Iterator[tuple[str, str, list]]:
    """("#", text, []), ("<", tag, attributes), (">", tag of an end, []), in one pass."""
    i, n, lost, unclosed = 0, len(s), set(), set()
    while i < n:
        k = s.find("<", i)
        if k < 0:
            k = n
        if k > i:
            yield "#", s[i:k], []
        if k == n:
            return
        m = _NAME.match(s, k + 1)
        if m:
            tag = m[0].lower()
            i, attrs = _tag_end(s, m.end(), lost)
            if tag[0] == "/":
                yield ">", tag[1:], []
                continue
            yield "<", tag, attrs
            if tag in RAW and tag not in unclosed:
                end = _ends(tag).search(s, i)
                if end:
                    i = end.end()
                elif tag in ("script", "style"):
                    return
                else:
                    unclosed.add(tag)
        elif s.startswith("<!--", k):
            i = s.find("-->", k + 4)
            if i < 0:
                return
            i += 3
        elif s[k + 1:k + 2] in ("!", "?"):
            i = s.find(">", k)
            if i < 0:
                return
            i += 1
        else:
            yield "#", "<", []
            i = k + 1


@lru_cache(maxsize=None)
def _ends(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}[^>]*>", re.I)


def parse(page: str | None) -> Node:
    """The page's tree of block-level elements and texts; hidden elements are left out."""
    root = Node("")
    stack: list[tuple[str, Node, bool]] = [("", root, False)]
    text: list[str] = []
    links, anchor, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            clean = " ".join("".join(text).split())
            if clean and not hidden:
                stack[-1][1].kids.append(Node("#", clean, min(links, len(clean))))
            text.clear()
        links = 0

    def drop(at: int) -> None:
        nonlocal hidden
        hidden -= sum(x[2] for x in stack[at:])
        del stack[at:]

    for kind, what, attrs in _tokens(page or ""):
        if kind == "#":
            t = _html.unescape(what) if "&" in what else what
            text.append(t)
            if anchor:
                links += len(t)
        elif kind == ">":
            if what == "a":
                anchor = 0
            elif what in BLOCKS:
                flush()
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == what), None)
                if at is not None:
                    drop(at)
        elif what == "a":
            anchor = 1
        elif what in ("br", "img", "input"):
            text.append(" ")
        elif what in RAW:
            if what not in ("script", "style"):
                text.append(" ")
        elif what in BLOCKS:
            flush()
            anchor = 0
            for k in range(len(stack) - 1, 0, -1):
                above = stack[k][0]
                if above in SCOPES.get(what, ()) or (above in ("article", "section", "div", "td", "body", "main", "blockquote") and what != "body"):
                    break
                if what in ENDS.get(above, ()):
                    drop(k)
                    break
            mark, gone = _mark(what, tuple(attrs), what == "section" and any(x[1].tag in ("article.", "main.") for x in stack))
            if len(stack) > DEEP:
                drop(len(stack) - 1)
            node = Node(mark)
            if not (hidden or gone):
                stack[-1][1].kids.append(node)
            stack.append((what, node, gone))
            hidden += gone
    flush()
    return root


def texts_of(node: Node) -> list[str]:
    """The texts below a node, without boilerplate elements; of the header of an article, its headings."""
    out, stack = [], [(node, False, True)]
    while stack:
        n, inside, read = stack.pop()
        if n.tag == "#":
            if read:
                out.append(n.text)
        elif n is node or not n.tag.endswith("!"):
            inside = inside or n.tag in ("article.", "main.")
            if n.tag == "header":
                if not inside:
                    continue
                read = False
            elif re.match("h[1-6]$|hgroup$", n.tag):
                read = True
            stack += [(k, inside, read) for k in reversed(n.kids)]
    return out


# ---- wrappers: a node is [tag, pages, times, characters, of them in links, hash of its text or None, groups], a group is
# [repeated, nodes]

TAG, PAGES, TIMES, CHARS, LINKS, SAME, GROUPS = range(7)


def _key(node: list) -> tuple:
    return node[TAG], tuple(sorted({x[TAG] for _, nodes in node[GROUPS] for x in nodes}))


def folded(keys: list, most: int = 3) -> list[tuple[int, int, int]]:
    """(first, number, period): runs of up to `most` keys that repeat are one group."""
    out, i, n = [], 0, len(keys)
    while i < n:
        for k in range(1, most + 1):
            j = i + k
            while j + k <= n and keys[j:j + k] == keys[i:i + k]:
                j += k
            if j > i + k:
                out.append((i, j - i, k))
                i = j
                break
        else:
            out.append((i, 1, 1))
            i += 1
    return out


def page_wrapper(node: Node, seen: dict[int, list] | None = None) -> list:
    """The wrapper of one page; seen gets those of all its nodes, by their identity."""
    if node.tag == "#":
        return ["#", 1, 1, len(node.text), node.links, xxhash.xxh64_hexdigest(node.text.encode("utf-8", "surrogatepass")), []]
    made = [page_wrapper(k, seen) for k in node.kids]
    if seen is not None:
        seen.update((id(k), x) for k, x in zip(node.kids, made))
    groups = []
    for at, n, k in folded([_key(x) for x in made]):
        nodes = made[at:at + k]
        for j in range(at + k, at + n):
            nodes[(j - at) % k] = aligned(nodes[(j - at) % k], made[j], 0)
        groups.append([n > k, nodes])
    if len(groups) > 200:  # no pattern: each form once, repeated
        forms: dict = {}
        for rep, nodes in groups:
            key = tuple(map(_key, nodes))
            forms[key] = [True, [aligned(a, b, 0) for a, b in zip(forms[key][1], nodes)]] if key in forms else [rep, nodes]
        groups = list(forms.values())
    same = xxhash.xxh64_hexdigest("|".join(str(x[SAME]) for x in made).encode())
    return [node.tag, 1, 1, sum(x[CHARS] for x in made), sum(x[LINKS] for x in made), same, groups]


def _rounds(groups: list, other: list) -> list:
    """Single nodes that are one round of a group that the other side repeats become such a group."""
    wanted = {tuple(map(_key, nodes)) for rep, nodes in other if rep and len(nodes) > 1}
    if not wanted:
        return groups
    out, i = [], 0
    while i < len(groups):
        for k in (3, 2):
            run = groups[i:i + k]
            if len(run) == k and all(len(x[1]) == 1 for x in run) and tuple(_key(x[1][0]) for x in run) in wanted:
                out.append([False, [x[1][0] for x in run]])
                i += k
                break
        else:
            out.append(groups[i])
            i += 1
    return out


def matched(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of groups that meet, in order: those of equal form, then in each gap the most similar of the same tags."""
    a, b = ([tuple(map(_key, nodes)) for _, nodes in side] for side in (left, right))
    if a == b:
        return list(zip(range(len(a)), range(len(b))))
    pairs = []
    for what, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if what == "equal":
            pairs += zip(range(i, j), range(k, m))
            continue
        while i < j and k < m:  # the best pair of the gap, then what is left before it is optional
            best, at = 0.0, None
            for x in range(i, min(j, i + 30)):
                for y in range(k, min(m, k + 30)):
                    if [t for t, _ in a[x]] == [t for t, _ in b[y]]:
                        p, q = ({c for _, cs in side for c in cs} for side in (a[x], b[y]))
                        alike = (len(p & q) + 0.01) / (len(p | q) + 0.01)
                        if (p & q or not (p or q)) and alike > best:
                            best, at = alike, (x, y)
            if at is None:
                break
            pairs.append(at)
            i, k = at[0] + 1, at[1] + 1
    return pairs


def aligned(a: list, b: list, more: int = 1) -> list:
    """The wrapper of both sides; more: 0 if they are of one page."""
    if a[SAME] == b[SAME] and a[TAG] == "#" or not (a[GROUPS] or b[GROUPS]):
        groups = a[GROUPS]
    else:
        left, right = _rounds(a[GROUPS], b[GROUPS]), _rounds(b[GROUPS], a[GROUPS])
        groups, i, j = [], 0, 0
        for x, y in [*matched(left, right), (len(left), len(right))]:
            groups += left[i:x] + right[j:y]  # options
            if x < len(left):
                groups.append([left[x][0] or right[y][0], [aligned(p, q, more) for p, q in zip(left[x][1], right[y][1])]])
            i, j = x + 1, y + 1
    if more:
        same = a[SAME] if a[SAME] == b[SAME] else None
    else:  # of one page, the text of all rounds
        same = xxhash.xxh64_hexdigest(f"{a[SAME]}+{b[SAME]}".encode())
    return [a[TAG], max(a[PAGES], b[PAGES]) if not more else a[PAGES] + b[PAGES], a[TIMES] + b[TIMES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], same, groups]


def regex(node: list, pages: int | None = None) -> str:
    """The wrapper as an expression: (..)+ repeated, (..)? optional, '..' a fixed text (its hash), # a text slot."""
    pages = pages or node[PAGES]
    if node[TAG] == "#":
        return "'" + node[SAME][:4] + "'" if node[SAME] and node[PAGES] > 1 else "#"
    out = []
    for rep, nodes in node[GROUPS]:
        inner = " ".join(regex(x, x[PAGES]) for x in nodes)
        option = nodes[0][PAGES] < node[PAGES]
        out.append(f"({inner})" + "+" * rep + "?" * option if rep or option else inner)
    return f"<{node[TAG]}>" + " ".join(out) + f"</{node[TAG]}>" if node[TAG] else " ".join(out)


# ---- the article

def _fixed(node: list) -> bool:
    return node[SAME] is not None and node[PAGES] >= 3


class Extractor:
    """Applies the wrapper of a host's template."""

    def __init__(self, wrapper: list):
        self.root, self.mass, self.kept, self.way = wrapper, {}, set(), set()
        total = self._weigh(wrapper, False)
        for name in ("article.", "main."):
            found = [path for path in self._find(wrapper, [], name)]
            if found and sum(self.mass[id(p[-1])] for p in found) >= total / 3:
                for path in found:
                    self._keep(path)
                return
        self._seek()

    def _weigh(self, node: list, out: bool) -> float:
        out = out or node[TAG].endswith("!") or node[TAG] == "header"
        if node[TAG] == "#":
            m = 0.0 if out else (node[CHARS] - node[LINKS]) * (0.2 if _fixed(node) else 1)
        else:
            m = sum(self._weigh(x, out) for _, nodes in node[GROUPS] for x in nodes)
        self.mass[id(node)] = m
        return m

    def _find(self, node: list, path: list, name: str) -> Iterator[list]:
        path = [*path, node]
        if node[TAG] == name:
            yield path
        elif not node[TAG].endswith("!"):
            for _, nodes in node[GROUPS]:
                for x in nodes:
                    yield from self._find(x, path, name)

    def _keep(self, path: list) -> None:
        self.kept.add(id(path[-1]))
        self.way.update(map(id, path[:-1]))

    def _seek(self) -> None:
        path = [self.root]
        while True:
            kids = [(rep, x) for rep, nodes in path[-1][GROUPS] for x in nodes]
            rep, best = max(kids, key=lambda x: self.mass[id(x[1])], default=(False, None))
            if best is None or rep or best[TAG] == "#" or self.mass[id(best)] <= self.mass[id(path[-1])] / 2:
                break
            if not any(x[TAG] != "#" for _, nodes in best[GROUPS] for x in nodes):
                # a single text holds the mass: its siblings stay unless they are fixed, or links
                for _, x in kids:
                    if not _fixed(x) and x[LINKS] <= x[CHARS] / 2:
                        self._keep([*path, x])
                break
            path.append(best)
        if not self.kept:
            self._keep(path)
        for depth in range(1, len(path)):  # headings beside the way
            for _, nodes in path[depth - 1][GROUPS]:
                for x in nodes:
                    if x is path[depth]:
                        break
                    if re.match("h[1-6]$|hgroup", x[TAG]) and not _fixed(x):
                        self._keep([*path[:depth], x])

    def text(self, page: Node) -> str:
        out: list[str] = []
        seen: dict[int, list] = {}
        if id(self.root) in self.way:
            page_wrapper(page, seen)
        self._walk(page, self.root, seen, out)
        return "\n\n".join(out)

    def _walk(self, node: Node, own: list, seen: dict[int, list], out: list[str]) -> None:
        if id(own) in self.kept:
            out += texts_of(node)
        elif id(own) in self.way:
            shapes = [seen[id(k)] for k in node.kids]
            runs = folded([_key(x) for x in shapes])
            for x, y in matched(own[GROUPS], [[n > k, shapes[at:at + k]] for at, n, k in runs]):  # what is not matched is not read
                at, n, k = runs[y]
                for j in range(n):
                    self._walk(node.kids[at + j], own[GROUPS][x][1][j % k], seen, out)


def template(page: Node) -> str:
    """What holds text of this page: an article or main element, or none. Such pages have wrappers of their own."""
    found, stack = set(), [page]
    while stack:
        n = stack.pop()
        if not n.tag.endswith("!"):
            if n.tag in ("article.", "main.") and texts_of(n):
                found.add(n.tag)
            stack += n.kids
    return "article" if "article." in found else "main" if "main." in found else ""


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _add(held: dict[str, dict], host: str, wrappers: dict[str, dict]) -> None:
    own = held.setdefault(host, {})
    for t, w in wrappers.items():
        own[t] = aligned(own[t], w) if t in own else w


def _merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The wrappers of each host and task, from partial ones dealt by `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for b in batches:
            for host, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist()):
                _add(held, host, json.loads(w))
        yield _wrapper_rows(held)

    return rows.repartition(*keys).select("host", "wrapper").mapInArrow(run, "host string, wrapper string")


def _wrapper_rows(held: dict[str, dict]) -> pa.RecordBatch:
    hosts = sorted(held)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([json.dumps(held[h]) for h in hosts], pa.string())], ["host", "wrapper"])


def infer(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, wrapper: json of a wrapper by template), one row per host, from all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tree = parse(page)
                _add(held, host, {template(tree): page_wrapper(tree)})
        yield _wrapper_rows(held)

    parts = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16)))
    return _merge(_merge(salted, ["host", "salt"]), ["host"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_mb: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars), a row per input row."""
    wrappers = written(infer(pages, html_col, url_col), "wrappers")
    measured = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 100)).first()[0] or 0
    small = measured <= broadcast_mb * 1_000_000
    known = pages.sparkSession.sparkContext.broadcast({r["host"]: json.loads(r["wrapper"]) for r in wrappers.collect()} if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, dict[str, Extractor]] = {}
        for b in batches:
            texts = []
            given = b.column("wrapper").to_pylist() if known.value is None else [None] * b.num_rows
            for host, page, w in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), given):
                if host not in made:
                    if len(made) > 2000:
                        made.clear()
                    made[host] = {t: Extractor(x) for t, x in (known.value[host] if known.value is not None else json.loads(w)).items()}
                tree = parse(page)
                texts.append(made[host][template(tree)].text(tree) or Extractor(page_wrapper(tree)).text(tree))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    if not small:
        read = read.join(wrappers, "host")
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
