"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens: elements, each named by its path of tags with ids and classes, and
words, each told apart by its path and the word before it in its block.  A token's *occurrence
vector* says how often each page of the host has it; tokens of equal vectors form an equivalence
class.  Vectors are compared by mergeable sums, so a host of any size aggregates before the shuffle.

* Elements: the classes that stand at most once in a page, and in half of the host's pages at least,
  are the template's frame.  By their paths they are ordered and nested: a path's element stands
  inside that of the path above it.  Each frame element, with the elements of other classes below it, is a *slot*.
* Words: a class whose words stand equally often in all the pages that have them, three quarters of the host's at
  least, is fixed text.  A block belongs to the class that most of its words are of.  It is the template's, and goes,
  if three quarters of its words are of that class (so one word may vary) and those words times the other pages
  that have them come to ``EVIDENCE``: a long sentence shows in few pages, two words in many; no size of host
  switches the rule.  The fixed text of N pages may be all but one Nth of a page's main text, as else the pages are
  but copies of each other, and keep it.  Candidates come from the shortest five sixteenths of a
  host's pages: at most a quarter can lack such a word, so it stands in the number of these beyond a quarter at least; all pages are counted for these only.
* The text that varies (all but links and fixed words) is summed by slot.  The slot with most of it, and those beside
  it that have much, hold the main text; the slots nested in them are read too.

Tags break ties: the article or main element around the best slot is taken whole, and slots that
HTML itself calls navigation, footer, aside or form, or whose whole class name is one of ``_NAMES``,
come after the others; such a name counts for nothing on an element around nearly all varying text, and a header's
name for nothing inside an article, whose title it holds.
Pages are then cut at their host's slots, and a page without them at those of its own template.

Blocks are the texts between block-level tags; character references are decoded, white space
inside a block becomes one blank, blocks are joined by line feeds.

Defined edge cases: null or empty html, or html without main text, gives an empty text, and such
pages count for no vector; a null url is of the host of urls without
one; repeated rows are pages like others; a host with one page has a template too; malformed and unclosed markup is
read as browsers do in the common cases; pages of any length are read whole; an empty table gives no rows; columns not kept are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import hinted, pinned, trimmed
from tidewheel.llm.textscan import BLANK, mix, word_hashes, words

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*|[^>]*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center",
}
#: Elements that show no text of the page, and those that HTML sets apart from its main text.
_UNSHOWN = {"script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "svg", "head", "title", "object", "canvas", "audio", "video", "map", "datalist"}
_APART = {"nav", "footer", "aside", "menu", "dialog"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Whole class names and ids that set an element apart.
_NAMES = re.compile(
    r"(?:site|page|main|top|bottom|cookie|reader|user)?[-_]?(?:ads?|adverts?|advertisement|banner|promo|sponsored|cookies?|notice|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|comments?|newsletter|popup|pagination)(?:[-_](?:list|section|area|box|bar|banner|notice|wrapper|form))?"
)
#: Those of them that name the head of what they stand in.
_HEADS = re.compile(r"(?:site|page|main|top)?[-_]?(?:header|masthead)(?:[-_](?:area|box|bar|wrapper))?")
#: The share of the varying text that makes an element a wrapper, whatever its name.
WRAPPER = 0.9
#: The share of the best slot's varying text that a slot beside it must have.
BESIDE = 0.25
#: The share of a host's pages, the shortest, whose words are counted in all others: more than can lack a word of SUPPORT of the pages.
PART = 5 / 16
#: How many pages of a host, by length, may give fixed words: None for all.  The tests' count by hand reads it.
SHORTEST = None
#: The share of pages that a class of fixed words is in, of a block's words that are of it, and what these times pages must come to.
SUPPORT, SHARE, EVIDENCE = 0.75, 0.75, 30
#: Pages whose tokens are counted at once.
CHUNK = 256
_HOST = r"^[a-z][a-z0-9+.\-]*://([^/?#]*)"


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: str, text: str, linked: int):
        self.path, self.text, self.linked = path, text, min(linked, len(text))


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in paths (digits as 0), and whether it is not shown."""
    if not attributes:
        return tag, tag in _UNSHOWN
    own = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    unshown = own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes))
    marks = [f"#{own['id'].strip()}"] if own.get("id", "").strip() else []
    marks += [f".{c}" for c in sorted(own.get("class", "").split())]
    marks += [f"@{own['role']}"] if own.get("role") in _ROLES else []
    return tag + re.sub(r"[0-9]+", "0", "".join(marks)).replace("/", "_").replace(" ", "_"), bool(unshown) or tag in _UNSHOWN


@functools.lru_cache(1 << 16)
def _apart(name: str) -> int:
    """2 for elements that HTML sets apart, 1 for those that a name does, 3 if it is a header's, else 0."""
    tag, *marks = re.split(r"[#.]|(?=@)", name)
    if tag in _APART or any(m.startswith("@") for m in marks):
        return 2
    named = [m for m in marks if _NAMES.fullmatch(m)] if tag not in ("html", "body", "main") else []
    return 1 if tag == "form" else 0 if not named else 3 if all(_HEADS.fullmatch(m) for m in named) else 1


def _tag(path: str) -> str:
    return re.match(r"[^#.@]*", path.rpartition("/")[2])[0]


def set_apart(path: str, wrappers: frozenset[str], by_name: bool = True) -> bool:
    """Whether an element on the path, other than the wrappers, sets its text apart."""
    at, article = "", False
    for name in path.split("/")[1:]:
        at = f"{at}/{name}"
        tag, kind = _tag(at), _apart(name)
        heads = tag == "header" or kind == 3
        if kind == 2 or (tag == "header" and not article) or (kind and by_name and at not in wrappers and not (heads and article)):
            return True
        article = article or tag in ("article", "main")
    return False


def read_page(page: str) -> tuple[list[Block], Counter]:
    """Blocks in page order, and how often each element path occurs."""
    blocks: list[Block] = []
    paths: Counter = Counter()
    stack: list[tuple[str, str, bool]] = [("", "", True)]  # tag, path, shown
    parts: list[str] = []
    linked = in_link = 0
    inline_hidden: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text and stack[-1][2]:
                blocks.append(Block(stack[-1][1], text, linked))
        linked = 0

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not inline_hidden:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue  # a comment or declaration
        tag = tag.lower()
        if not closing and tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else n
            if tag in ("title", "script", "style"):
                paths[f"{stack[-1][1]}/{tag}"] += 1
            continue
        if closing and tag in _RAW:
            continue
        if tag == "br" or tag in _VOID:
            if tag == "hr":
                flush()
            elif not inline_hidden:
                parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            if closing:
                if inline_hidden and inline_hidden[-1] == tag:
                    inline_hidden.pop()
            elif inline_hidden or (attributes and _name(tag, attributes)[1]):
                if not attributes.rstrip().endswith("/"):
                    inline_hidden.append(tag)
            continue
        inline_hidden.clear()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        in_link = 0
        if tag in ("html", "body") and any(s[0] == tag for s in stack):
            continue
        if tag == "body" and stack[-1][0] == "head":
            close(len(stack) - 1)
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("svg", "button", "object", "canvas", "audio", "video", "map"):
            close(len(stack) - 1)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in _KEEPS.get(tag, ()):
                break
            if stack[k][0] in _CLOSES.get(tag, ()):
                close(k)
                break
        _, above, shown = stack[-1]
        name, unshown = _name(tag, attributes)
        path = f"{above}/{name}"
        paths[path] += 1
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, path, shown and not unshown))
    flush()
    return blocks, paths


# ---------------------------------------------------------------- tokens


@functools.lru_cache(1 << 16)
def _path_hash(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_tokens(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word tokens of all blocks, their lengths, and each block's first token."""
    texts = [b.text.encode("utf-8", "replace") for b in blocks]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first = words(raw, offsets, BLANK)
    hashes = word_hashes(raw, starts, ends)
    before = np.concatenate([[np.uint64(0)], hashes[:-1]])[: len(hashes)]
    before[first[:-1][first[:-1] < len(hashes)]] = 0
    path = np.repeat(np.array([_path_hash(b.path) for b in blocks], np.uint64), np.diff(first))
    return mix(hashes ^ mix(before * np.uint64(31) + path)), ends - starts + 1, first


def subtree_sizes(blocks: list[Block]) -> dict[str, list[int]]:
    """For each path, the text and the linked text below it."""
    out: dict[str, list[int]] = {}
    for b in blocks:
        at = b.path
        while True:
            own = out.setdefault(at, [0, 0])
            own[0] += len(b.text)
            own[1] += b.linked
            if not at:
                break
            at = at.rpartition("/")[0]
    return out


# ---------------------------------------------------------------- templates


def choose_slots(frame: list[dict]) -> dict:
    """roots and left (paths of the slots that hold the main text, and of those in them that do not), wrappers, by_name.

    The frame's paths have size, linked (text in all and inside links below the path) and fixed (of
    it, in fixed words).
    """
    varying = {f["path"]: max(0, f["size"] - f["linked"] - f["fixed"]) for f in frame}
    varying.setdefault("", max(varying.values(), default=0))
    own, above = dict(varying), {}
    for p in varying:
        up = p
        while up:
            up = up.rpartition("/")[0]
            if up in varying:
                above[p] = up
                own[up] -= varying[p]
                break
    wrappers = frozenset(p for p, v in varying.items() if p and _apart(p.rpartition("/")[2]) in (1, 3) and varying[""] and v >= WRAPPER * varying[""])
    for by_name in (True, False):
        slots = {p: n for p, n in own.items() if n > 0 and not set_apart(p, wrappers, by_name)}
        if slots:
            break
    else:  # nothing varies: whatever is not set apart
        slots = {p: 0 for p in own if not set_apart(p, wrappers)}
        by_name = True
    best = min(slots, key=lambda p: (-slots[p], p))
    around = [p for p in (best, *_ancestors(best)) if p in varying and _tag(p) in ("article", "main")]
    root = around[-1] if around else best
    within = "" if root == "" else root + "/"
    keeps = lambda p: re.fullmatch("h[1-6]", _tag(p)) or own[p] >= BESIDE * slots[best]
    beside = [p for p in slots if p != root and above.get(p) == above.get(root) and root and keeps(p) and not around]
    # The page's whole body is no slot to take everything in.
    left = [p for p in varying if _tag(root) in ("", "html", "body") and p != root and above.get(p) == root and p.startswith(within) and _tag(p) != "body" and p in own and not any(keeps(q) for q in own if q == p or q.startswith(p + "/"))]
    return {"roots": sorted({root, *beside}), "left": sorted(left), "wrappers": sorted(wrappers), "by_name": by_name}


def _ancestors(path: str) -> Iterator[str]:
    while path:
        path = path.rpartition("/")[0]
        yield path


def _inside(path: str, slots) -> bool:
    return any(path == s or path.startswith(s + "/") for s in slots)


def cut(blocks: list[Block], template: dict) -> list[int]:
    """The numbers of the blocks that stand in the template's slots."""
    wrappers, known, out = frozenset(template["wrappers"]), {}, []
    for k, b in enumerate(blocks):
        if b.path not in known:
            known[b.path] = _inside(b.path, template["roots"]) and not _inside(b.path, template["left"]) and not set_apart(b.path, wrappers, template["by_name"])
        if known[b.path]:
            out.append(k)
    return out


def own_template(blocks: list[Block], paths: Counter) -> dict:
    """The template of a page by itself."""
    sizes = subtree_sizes(blocks)
    once = ["", *(p for p, n in paths.items() if n == 1 and p)]
    return choose_slots([{"path": p, "size": sizes.get(p, (0, 0))[0], "linked": sizes.get(p, (0, 0))[1], "fixed": 0} for p in once])


def main_text(page: str) -> str:
    """The main text of a page by itself."""
    blocks, paths = read_page(page)
    return "\n".join(blocks[k].text for k in cut(blocks, own_template(blocks, paths)))


def hosted(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """__host, __key (a hash of the page), __html and the kept columns, packed in __own."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), _HOST, 1), F.lit("")).alias("__host")
    return pages.select(host, F.xxhash64("page_id", "url", "html").alias("__key"), F.coalesce("html", F.lit("")).alias("__html"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__own")] if keep else []))


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their parsed pages, the html being column ``at``."""
    for k in range(0, len(batch), CHUNK):
        part = batch.slice(k, CHUNK)
        yield part, [read_page(page) for page in part.column(at).to_pylist()]


def candidate_words(first: DataFrame) -> DataFrame:
    """__host, token, path, length and ``n``, in how many of the pages, of the words of the pages ``first``."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, read in _chunks(batch, 1):
                for host, (blocks, _) in zip(part.column(0).to_pylist(), read):
                    token, size, at = word_tokens(blocks)
                    path = np.repeat(np.array([b.path for b in blocks], object), np.diff(at))
                    token, one = np.unique(token, return_index=True)
                    path, size = path[one], size[one]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(token), pa.string()), pa.array(token.view(np.int64)), pa.array(path.tolist(), pa.string()), pa.array(size, pa.int64())], ["__host", "token", "path", "length"])

    found = first.select("__host", "__html").mapInArrow(run, "__host string, token bigint, path string, length bigint")
    return found.groupBy("__host", "token").agg(F.min("path").alias("path"), F.min("length").alias("length"), F.count(F.lit(1)).alias("n"))


def occurrence_vectors(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """__host, path or token, and of its vector: pages, occurrences, squares and two sums of hashes of page and count;
    size and linked: the text below the path.  ``own`` has a row for each page, ``candidates`` the words to count.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, read in _chunks(batch, 2):
                elements: dict[tuple[str, str], np.ndarray] = {}
                counted: dict[str, list] = {}
                hosts, keys = part.column(0).to_pylist(), part.column(1).to_numpy()
                for k, (host, key, (blocks, paths)) in enumerate(zip(hosts, keys.view(np.uint64), read)):
                    sizes = subtree_sizes(blocks)
                    signs = mix(key + mix(np.arange(1, max([1, *paths.values()]) + 1, dtype=np.uint64)))
                    for path, n in [("", 1), *((p, n) for p, n in paths.items() if p)]:
                        sign, size = int(signs[n - 1]), sizes.get(path, (0, 0))
                        held = elements.setdefault((host, path), [0] * 7)
                        for i, x in enumerate((1, n, n * n, sign & 0xFFFFFFFF, sign >> 32, *size)):
                            held[i] += x
                    wanted = part.column(3)[k].values
                    if wanted is not None and len(wanted):
                        wanted = np.sort(wanted.to_numpy().view(np.uint64))
                        token, n = np.unique(word_tokens(blocks)[0], return_counts=True)
                        mine = np.isin(token, wanted, assume_unique=True)
                        token, n = token[mine], n[mine].astype(np.uint64)
                        sign = mix(keys.view(np.uint64)[k] + mix(n))
                        counted.setdefault(host, []).append(np.stack([token, np.ones(len(n), np.uint64), n, n * n, sign & np.uint64(0xFFFFFFFF), sign >> np.uint64(32)]))
                rows = np.array(list(elements.values()), np.int64).reshape(-1, 7)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in elements], pa.string()), pa.array([p for _, p in elements], pa.string()), pa.nulls(len(elements), pa.int64()), *[pa.array(c) for c in rows.T]], names)
                for host, found in counted.items():
                    found = np.concatenate(found, axis=1)
                    token, where = np.unique(found[0], return_inverse=True)
                    sums = np.zeros((7, len(token)), np.uint64)
                    for i in range(5):
                        np.add.at(sums[i], where, found[i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(token), pa.string()), pa.nulls(len(token), pa.string()), pa.array(token.view(np.int64)), *[pa.array(c.view(np.int64)) for c in sums]], names)

    sums = ["pages", "occurrences", "squares", "low", "high", "size", "linked"]
    names = ["__host", "path", "token", *sums]
    found = own.join(candidates, "__host", "left").select("__host", "__key", "__html", "tokens").mapInArrow(run, "__host string, path string, token bigint, " + ", ".join(f"{c} bigint" for c in sums))
    return found.groupBy("__host", "path", "token").agg(*[F.sum(c).alias(c) for c in sums])


def _sized(df: DataFrame, bytes_: str) -> DataFrame:
    """``df``, broadcast if its rows, counted and measured, are small."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(bytes_)).alias("b")).first()
    return hinted(df, total["n"], 96 + (total["b"] or 0) // max(1, total["n"]))


def templates(own: DataFrame) -> DataFrame:
    """__host, total (its pages), ``template`` (what ``choose_slots`` returns) and ``fixed``, ``classes``, ``support`` (word tokens, the classes they are of
    and in how many pages these are) of each host with a page that is not empty."""
    own = own.filter("trim(__html) <> ''")
    # A word of SUPPORT of a host's pages is missing in a quarter of them at most, so any pages beyond a quarter have it, in number.
    place = F.octet_length("__html").cast("bigint") * 1024 + F.pmod("__key", F.lit(1024))
    hosts = pinned(own.groupBy("__host").agg(F.count(F.lit(1)).alias("total"), F.percentile_approx(place, PART, 10_000).alias("upto")))
    count = hosts.count()
    first = own.withColumn("place", place).join(hinted(hosts, count, 96), "__host").filter("place <= upto")
    needed = first.groupBy("__host", "total").agg(F.count(F.lit(1)).alias("chosen")).select("__host", F.greatest(F.lit(1), F.col("chosen") - F.floor((1 - SUPPORT) * F.col("total"))).alias("needed"))
    candidates = candidate_words(first).join(hinted(needed, count, 96), "__host").filter("n >= needed")
    candidates = pinned(candidates.select("__host", "token", "path", "length"))
    hosts = hosts.drop("upto")
    gathered = candidates.groupBy("__host").agg(F.collect_list("token").alias("tokens"))
    vectors = pinned(occurrence_vectors(own, _sized(pinned(gathered), "8 * size(tokens)")))
    vectors = vectors.join(hinted(hosts, count, 96), "__host")
    # Words of equal vectors are a class, known by a hash of the vector.
    constant = vectors.filter((F.col("pages") >= F.greatest(F.lit(2), SUPPORT * F.col("total"))) & F.col("token").isNotNull() & (F.col("occurrences") * F.col("occurrences") == F.col("pages") * F.col("squares")))
    fixed = constant.select("__host", "token", "occurrences", "pages", F.xxhash64("pages", "low", "high").alias("class"))
    fixed = pinned(fixed.join(candidates, ["__host", "token"]))
    frame = vectors.filter("path is not null and occurrences = pages and 2 * pages >= total")
    frame = frame.groupBy("__host", "total").agg(F.collect_list(F.struct("path", "size", "linked")).alias("frame"))
    parts = {"fixed": "token", "classes": "class", "support": "pages"}
    words_ = fixed.groupBy("__host").agg(F.collect_list(F.struct("token", "class", "pages", "path", (F.col("length") * F.col("occurrences")).alias("size"))).alias("w"))
    words_ = words_.select("__host", *[F.col(f"w.{c}").alias(n) for n, c in parts.items()], F.transform("w", lambda x: F.struct(x["path"].alias("path"), x["size"].alias("size"))).alias("texts"))

    @F.udf("roots array<string>, left array<string>, wrappers array<string>, by_name boolean")
    def choose(frame, texts):
        below: Counter = Counter()
        for t in texts or ():
            for p in (t["path"], *_ancestors(t["path"])):
                below[p] += t["size"]
        return choose_slots([{"path": f["path"], "size": f["size"], "linked": f["linked"], "fixed": below[f["path"]]} for f in frame])

    none = F.array().cast("array<bigint>")
    return frame.join(words_, "__host", "left").select("__host", "total", choose("frame", "texts").alias("template"), *[F.coalesce(c, none).alias(c) for c in parts])


def varying(blocks: list[Block], fixed: np.ndarray, classes: np.ndarray, support: np.ndarray, total: int) -> list[int]:
    """The numbers of the blocks that are not the template's, given the fixed words of a host of ``total`` pages, sorted, their classes
    and in how many pages these are."""
    if not blocks or not len(fixed):
        return list(range(len(blocks)))
    token, _, at = word_tokens(blocks)
    place = np.minimum(np.searchsorted(fixed, token), len(fixed) - 1)
    known, out = fixed[place] == token, []
    for k in range(len(blocks)):
        own = place[at[k] : at[k + 1]][known[at[k] : at[k + 1]]]
        _, index, n = np.unique(classes[own], return_index=True, return_counts=True)
        most = int(np.argmax(n)) if len(n) else 0
        if not len(n) or n[most] < SHARE * (at[k + 1] - at[k]) or n[most] * (int(support[own[index[most]]]) - 1) < EVIDENCE:
            out.append(k)
    size = lambda numbers: sum(len(blocks[k].text) for k in numbers)
    return out if total * size(out) >= size(range(len(blocks))) else list(range(len(blocks)))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, then text and n_chars."""
    own = hosted(pages, keep)
    known = pinned(templates(own))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, read in _chunks(batch, 0):
                out = []
                for k, ((blocks, paths), template) in enumerate(zip(read, part.column(1).to_pylist())):
                    chosen = cut(blocks, template) if template else []
                    if blocks and not chosen:
                        chosen = cut(blocks, own_template(blocks, paths))
                    held = [part.column(c)[k].values for c in (2, 3, 4)]
                    if chosen and held[0] is not None and len(held[0]):
                        fixed, classes, support = (x.to_numpy() for x in held)
                        order = np.argsort(fixed.view(np.uint64))
                        stays = varying([blocks[c] for c in chosen], fixed.view(np.uint64)[order], classes[order], support[order], part.column(5)[k].as_py())
                        chosen = [chosen[c] for c in stays]
                    out.append("\n".join(blocks[c].text for c in chosen))
                yield pa.RecordBatch.from_arrays([*part.columns[6:], pa.array(out, pa.string())], [*keep, "text"])

    joined = own.join(_sized(known, "24 * size(fixed) + length(to_json(template))"), "__host", "left")
    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    out = joined.select("__html", "template", "fixed", "classes", "support", "total", *[F.col(f"__own.`{c}`").alias(f"__kept{k}") for k, c in enumerate(keep)]).mapInArrow(run, kinds + "text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
