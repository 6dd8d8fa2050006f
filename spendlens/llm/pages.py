"""Main text of web pages by template deduction over same-host pages (operator 8).

Pass 1 turns each page into tokens (every element as its path of tags and classes, every line of text
outside furniture as its path and text) and counts, per host and token, on how many pages it occurs, how
often, and a fingerprint of its occurrence vector (an exclusive-or over pages of a hash of page and
count).  This is one grouped aggregation, written once; no host's pages ever meet in a task, so a host
with a third of all pages is as cheap as any.

Tokens of one host with equal pages, counts and fingerprints share an occurrence vector: they form an
equivalence class.  Classes on most pages of a host are its template (``classes``).  An element is nested
validly if all elements around it are in the template too.  A line of text is template text if it shares
its vector with such an element: it comes with the frame, not with an article.  The template's elements
are the slots; what fills a slot is the text below it that is no template text (``template_of``).

The slot that holds the articles is the deepest element that occurs at most once a page and keeps
``CORE`` of the host's filling; if it lies inside an article (or else main) that occurs so too, the whole
of this one.  Blocks with the headline beside it, and headings and prose right beside a slot that is no
article, belong to it.  If more than half of the slot, or of the article element that would be the slot
with template text counted as filling, is template text, whole articles repeat and all of it stays.

Pass 2 extracts those slots from each page, without template text and furniture.  Inside an article or
main, class names mark furniture only if they consist of such words.  Hosts with fewer than
``MIN_PAGES`` pages, and pages that lack their host's slot, use the article, main or body element.

Cases: null html is empty, empty html gives an empty text; a null url is a host of its own; cut-off
markup at the end is dropped; rows that repeat a page_id are extracted one by one; a page whose slot
holds template text only keeps it; the templates (one short row per host) are broadcast if they are
within ``BROADCAST_BYTES``, else joined.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import mix64, on_workers, stage
from spendlens.llm.urls import host_and_path

MIN_PAGES = 3
MIN_TEXT_PAGES = 5  # a line on fewer pages is never template text
SUPPORT = 0.6
CORE = 0.8
WHOLE = 0.5
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head nav aside footer form script style noscript template iframe object canvas svg button select textarea input dialog menu title audio video map".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of class, id and role that mark page furniture.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header "
    "masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments reply replies discussion disqus breadcrumb breadcrumbs pagination pager widget "
    "toolbar search complementary contentinfo hidden skip".split()
)
# Words that beside a marked word still name furniture.
GENERIC = frozenset(
    "area bar block body bottom box button buttons container count fixed global form group inner inline item items left link links list "
    "outer panel post posts article articles story stories reader readers right section site slot sticky text title top unit user users wrap wrapper zone".split()
)
UNMARKED = frozenset(("has", "no", "with", "without", "entry", "post", "article", "content"))
_PARTS = re.compile(r"[a-z]+")
KEPT_WHOLE = frozenset(("html", "body", "article", "main"))
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*["']?\s*([a-zA-Z_-]+)""", re.I)


def step_of(tag: str, attrs: str) -> str:
    """An element's name within a path: its tag and, but for the frame of the page, the head of its first class."""
    m = None if tag in KEPT_WHOLE or not attrs else _CLASS.search(attrs)
    return f"{tag}.{m[1].lower()}" if m else tag


def tags_of(path: str) -> list[str]:
    return [step.partition(".")[0] for step in path.split("/")]


def is_furniture(tag: str, attrs: str, strict: bool = False) -> bool:
    """Whether tag, class, id or role say so; ``strict``: a name counts only if all its words do."""
    if tag in FURNITURE or tag == "header":
        return True
    if not attrs or tag in KEPT_WHOLE:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = _PARTS.findall(word)
                if parts and parts[0] not in UNMARKED and MARKED.intersection(parts):
                    if not strict or all(x in MARKED or x in GENERIC for x in parts):
                        return True
    return False


class Page:
    """A page's text nodes with their element paths.

    ``nodes``: (path, furniture, block, text); nodes of one block belong to one line.  ``paths``: how
    often each element path occurs.  The path names open elements from the root down; inline elements
    do not take part.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[str, bool, int, str]] = []
        self.paths: Counter = Counter()
        self.block = 0
        stack: list[tuple[str, str, bool]] = []  # (tag, path, furniture)
        at = 0
        while at < len(html):
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(stack, html[at:])
                break
            if m.start() > at:
                self._text(stack, html[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self._text(stack, m["cdata"], decode=False)
                continue
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["close"] or m["close2"]:
                self._close(stack, tag)
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            self._open(stack, tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                self._close(stack, tag)

    def _text(self, stack, raw: str, decode: bool = True) -> None:
        text = references.unescape(raw) if decode and "&" in raw else raw
        path, furniture = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        self.nodes.append((path, furniture, self.block, text))

    def _open(self, stack, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._implied(stack, ("p",), barrier=("td", "th", "table", "button", "article", "div", "section", "li"))
        elif tag in ITEM:
            self._implied(stack, ITEM[tag], barrier=("ul", "ol", "table", "dl", "select"))
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return
        parent, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        if tag in ("article", "main"):
            # an unclosed element before it does not take the article with it
            inside = any(f and t in ("template", "noscript", "dialog") for t, _, f in stack)
        own = is_furniture(tag, attrs, strict=any(t in ("article", "main") for t, _, _ in stack))
        if tag == "header" and any(t == "article" for t, _, _ in stack):
            own = False  # an article's own header holds its headings
        if tag in INLINE:
            stack.append((tag, parent, inside or own))
            return
        path = f"{parent}/{step_of(tag, attrs)}"
        self.paths[path] += 1
        stack.append((tag, path, inside or own))

    def _implied(self, stack, tags, barrier) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                self.block += 1
                return
            if stack[k][0] in barrier:
                return

    def _close(self, stack, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    def lines(self) -> list[tuple[str, str]]:
        """(path, text) of every line outside furniture; the path is that of its first text node."""
        found: dict[int, list[str]] = {}
        for path, furniture, block, text in self.nodes:
            if furniture or ("/header" in path and not HEADINGS.intersection(tags_of(path))):
                continue
            found.setdefault(block, [path]).append(text)
        joined = ((x[0], _SPACE.sub(" ", "".join(x[1:])).strip()) for x in found.values())
        return [(path, text) for path, text in joined if text]

    def blocks(self, path: str | None = None) -> list[str]:
        """Lines outside furniture below ``path`` (None: the whole page)."""
        return [text for p, text in self.lines() if path is None or below(p, path)]

    def usual(self) -> str | None:
        """The path of the page's article, main or body element, the first of these that has text."""
        for tag in ("article", "main", "body"):
            found = [p for p in self.paths if tags_of(p).count(tag) == 1 and tags_of(p)[-1] == tag]
            if found and any(self.blocks(p) for p in found):
                return min(found, key=len)
        return None

    def main_text(self, slots: list[str] | None, fixed: frozenset[int] | set[int] = frozenset()) -> str:
        """The text below ``slots`` but for the template text ``fixed`` (line tokens)."""
        inside = [(p, text) for p, text in self.lines() if any(below(p, s) for s in slots or ())]
        left = [text for p, text in inside if not fixed or line_token(p, text) not in fixed]
        return "\n".join(left or [text for _, text in inside] or self.blocks(self.usual()))


def below(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def line_token(path: str, text: str) -> int:
    """The token of a line of text, as a signed 64-bit number."""
    return int(np.uint64(_hash(f"{path}\t{text}")).view(np.int64))


TOKENS = "host string, token long, path string, place string, pages long, occurrences long, vector long, chars long"


def tokens(pages: DataFrame) -> DataFrame:
    """Occurrence statistics per host and token; batches add up before the shuffle.

    ``path``: an element's path; ``place``: the path a line of text stands at; ``chars``: free text,
    an element's own and all below it, or the line's.  The token 0 stands for the page.
    """

    def run(batches):
        for batch in batches:
            held: dict = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                html = html or ""
                page, page_hash = Page(html), _hash(f"{host}\n{html}")
                chars: Counter = Counter()
                texts: Counter = Counter(page.lines())
                for (path, text), n in texts.items():
                    while path:
                        chars[path] += len(text) * n
                        path = path.rpartition("/")[0]
                found = [(0, None, None, 1, 0)]
                found += [(int(np.uint64(_hash(p)).view(np.int64)), p, None, n, chars[p]) for p, n in page.paths.items()]
                found += [(line_token(p, t), None, p, n, len(t) * n) for (p, t), n in texts.items()]
                seeds = mix64(np.array([page_hash], np.uint64) + np.array([f[3] for f in found], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for (token, path, place, n, free), vector in zip(found, seeds.view(np.int64).tolist(), strict=True):
                    h = held.setdefault((host, token, path, place), [0, 0, 0, 0])
                    h[0] += 1
                    h[1] += n
                    h[2] ^= vector
                    h[3] += free
            keys, stats = list(held), list(held.values())
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                [pa.array([k[c] for k in keys], kind) for c, kind in enumerate(kinds)] + [pa.array([s[c] for s in stats], pa.int64()) for c in range(4)],
                names=["host", "token", "path", "place", "pages", "occurrences", "vector", "chars"],
            )

    partial = on_workers(pages).select("host", "html").mapInArrow(run, TOKENS)
    return partial.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("place").alias("place"), F.sum("pages").alias("pages"),
        F.sum("occurrences").alias("occurrences"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"),
    )


def classes(counted: DataFrame) -> DataFrame:
    """Template tokens with their class: tokens of a host on ``SUPPORT`` of its pages, classed by vector."""
    sizes = counted.where("token = 0").select(F.col("host").alias("__host"), F.col("pages").alias("host_pages"))
    often = counted.where("token != 0 and pages > 1").join(sizes.where(F.col("host_pages") >= MIN_PAGES), F.col("host").eqNullSafe(F.col("__host")))
    often = often.where(F.col("pages") >= SUPPORT * F.col("host_pages")).drop("__host")
    return often.withColumn("class", F.xxhash64("pages", "occurrences", "vector"))


def template_of(found: list[dict]) -> tuple[list[str], list[int]]:
    """(slots that hold the articles, template text within them) of one host's classed tokens."""
    elements = {t["path"]: t for t in found if t["path"] is not None}
    nested: dict[str, dict] = {}
    for path in sorted(elements):
        parent = path.rpartition("/")[0]
        if not parent or parent in nested:
            nested[path] = elements[path]
    frame = {t["class"] for t in nested.values()}
    fixed = [t for t in found if t["path"] is None and t["pages"] >= MIN_TEXT_PAGES and t["class"] in frame and t["place"] in nested]
    whole, _ = _slots(nested, [])
    slots, free = _slots(nested, fixed)

    def repeats(path: str) -> bool:
        return free[path] < WHOLE * nested[path]["chars"]

    if not slots or repeats(slots[0]) or (tags_of(whole[0])[-1] in ("article", "main") and repeats(whole[0])):
        slots, fixed = whole, []
    return slots, [t["token"] for t in fixed if any(below(t["place"], s) for s in slots)]


def _slots(nested: dict[str, dict], fixed: list[dict]) -> tuple[list[str], dict[str, int]]:
    """The article slot, then the blocks beside it; and each element's filling in characters."""
    free = {path: t["chars"] for path, t in nested.items()}
    for t in fixed:
        path = t["place"]
        while path:
            free[path] -= t["chars"]
            path = path.rpartition("/")[0]
    once = {path for path, t in nested.items() if t["occurrences"] == t["pages"] and free[path] > 0}
    most = max(free.values(), default=0)
    core = {path for path in once if free[path] >= CORE * most}
    if not core:
        return [], free
    slot = max(core, key=lambda path: (path.count("/"), path))
    around = [path for path in core if below(slot, path)]
    for tag in ("article", "main"):
        named = [path for path in around if tags_of(path)[-1] == tag]
        if named:
            slot = min(named, key=len)
            break
    home, whole = slot.rpartition("/")[0], tags_of(slot)[-1] in ("article", "main")
    headlines = [path for path in nested if tags_of(path)[-1] == "h1" and free[path] > 0]
    beside = []
    for path in sorted(once):
        parent = path.rpartition("/")[0]
        if below(path, slot) or not parent or below(slot, path) or not below(slot, parent):
            continue
        if any(below(h, path) for h in headlines) or (parent == home and not whole and tags_of(path)[-1] in PROSE):
            beside.append(path)
    return [slot, *beside], free


TEMPLATES = "host string, slots array<string>, fixed array<long>"


def templates(counted: DataFrame) -> DataFrame:
    """(host, slots, fixed): each host's article slots and the template text inside.

    A host's group is its template, as large as a page or two whatever its number of pages.
    """

    def build(rows):
        import pandas as pd

        host = rows["host"].iloc[0]
        columns = ["token", "path", "place", "pages", "occurrences", "class", "chars"]
        found = [dict(zip(columns, r, strict=True)) for r in zip(*(rows[c].tolist() for c in columns), strict=True)]
        for t in found:
            t["path"] = t["path"] if isinstance(t["path"], str) else None
        slots, fixed = template_of(found)
        return pd.DataFrame({"host": [host if isinstance(host, str) else None], "slots": [slots], "fixed": [fixed]})

    return on_workers(classes(counted)).groupBy("host").applyInPandas(build, TEMPLATES).where(F.size("slots") > 0)


def extract(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, slot, text and n_chars (and ``keep``) for every row of ``pages`` (page_id, url, html)."""
    host, _ = host_and_path(F.col("url"))
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), *keep)
    counted = stage(tokens(known).where("token = 0 or pages > 1"), "page-tokens")
    found = stage(templates(counted), "templates").withColumnRenamed("host", "__host")
    bytes_of = F.octet_length("__host") + F.octet_length(F.array_join("slots", " ")) + 8 * F.size("fixed") + 96
    size = found.agg(F.sum(F.coalesce(bytes_of, F.lit(96)))).first()[0] or 0
    hint = F.broadcast(found) if size <= BROADCAST_BYTES else found
    dealt = known.join(hint, F.col("host").eqNullSafe(F.col("__host")), "left").select(
        "page_id", "url", F.get("slots", F.lit(0)).alias("slot"), "html", F.col("slots").alias("__slots"), F.col("fixed").alias("__fixed"), *keep
    )
    kinds = dict(dealt.dtypes)
    names = ["page_id", "url", "slot", *keep]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "__slots", "__fixed")), strict=True)
            texts = [Page(html).main_text(slots, frozenset(fixed or ())) for html, slots, fixed in rows]
            yield pa.record_batch(
                [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, "text", "n_chars"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, n_chars long"
    return on_workers(dealt).mapInArrow(run, schema)
