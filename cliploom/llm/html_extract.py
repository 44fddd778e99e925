"""HTML extraction with a site style tree per host.

Pages are read by a tolerant tokenizer into blocks, each with the path of elements it stands in (tag, classes and ids
without digits).  The DOMs of a host are merged by path.  For each path the tree holds how many different pages have it, the
presentation styles (sequence of children) and the contents found there; with m pages,

    entropy = -sum p_i log_m p_i,    importance = (1 - g) * entropy(styles) + g * entropy(contents)

is 1 where every page differs and 0 where all are alike.  A single text at a path that c of the m pages hold has the importance
1 - log_m c.  On hosts with `min_pages` different pages the tree decides, inside and beside the article:

- branches under `least` go, and so do texts under `least_text` (headings within an article stay);
- the main branch is looked for from the root: a container that holds `main_share` of the characters of important nodes is
  entered until one has text of its own (over `loose` of all, a first heading aside) or is the article.  Pages that have text in
  it keep that, and first headings on the way to it.

Pages of other hosts, and pages without text in the host's main branch, take the text of their articles or main
element where they have one.  Elements that by tag, role, class or id are menus, headers, footers, sidebars, notices,
adverts, forms or comments are nodes of no importance on any host.  Pages of equal text count once, and within an article
pages of equal article text, so copies do not make an article look like a template.

The tree is counted by (host, path, value) with partial aggregation, so a host with a third of all pages is no single
task's work.  What it found per host is measured: up to `broadcast_chars` characters it is broadcast to the pages, which
then are not shuffled; beyond, it is joined back in `salts` shares per host.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by a line
feed; a line break element is white space.

Edge cases: null, empty and text-free pages give an empty text; unclosed elements, stray end tags and cut-off pages are
read as browsers do, roughly; a null or odd url belongs to the host ''; very long pages are read whole; repeated rows each
get their result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import checkpointed, dropped, written

LEAST, LEAST_TEXT, CONTENT_SHARE, MIN_PAGES, SALTS = 0.25, 0.1, 0.9, 5, 64
MAIN_SHARE, LOOSE = 0.8, 0.02
#: Characters of what the trees found, over all hosts, up to which it is broadcast.
BROADCAST_CHARS = 4_000_000

#: Fixed lists of HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|video|audio"
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: What an implied end does not reach beyond.
FENCE = frozenset("table ul ol dl select article section div body main".split())

NOISE_TAGS = frozenset("nav footer aside form head title button select label dialog menu input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay"
    " newsletter subscribe subscription sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar share sharing social"
    " related recommended recommendations comment comments commentlist disqus reply replies respond widget login signin signup register search form copyright legal tags tagcloud"
    " skip hidden".split()
)
HEADER_WORDS = frozenset(("header", "head"))
#: Last parts of a compound name that leave its meaning to the part before, and first parts that make it a state.
NEUTRAL_WORDS = frozenset("container wrapper wrap inner outer box block area list item items section content row col column bar panel group link links button buttons icon icons text title posts articles stories top bottom left right main primary secondary".split())
STATE_WORDS = frozenset("has is with no without not show hide".split())
#: Elements that hold blocks, in which the main branch is looked for.
CONTAINERS = ("html", "body", "div", "section", "center", "article", "main")
ARTICLES = ("article", "main")
HEADING = re.compile("h[1-6]")

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:svg|math)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>|<(?P<raw>" + RAW + r")\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Element:
    __slots__ = ("tag", "path", "noise", "article", "header")

    def __init__(self, tag: str, path: str, noise: bool, article: bool, header: bool) -> None:
        self.tag, self.path, self.noise, self.article, self.header = tag, path, noise, article, header


def meaning(name: str) -> str:
    """What a class or id name says an element is: the last part that is not neutral, or a first part that is itself a mark.

    `site-footer` is a footer and `related-posts` is related; `has-sidebar`, `header-fixed` and `form-factor` are no marks.
    """
    parts = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    if not parts or parts[0] in STATE_WORDS:
        return ""
    while len(parts) > 1 and parts[-1] in NEUTRAL_WORDS:
        parts.pop()
    # side-bar, off-canvas and the like are written in one word or two.
    return "sidebar" if parts[0] == "side" else parts[-1]


_known: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _described(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """(name in a path, is noise, is a header, is an article or main element) of a start tag."""
    if (found := _known.get((tag, rest))) is not None:
        return found
    names, role, gone = [], "", False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            gone = True
    words = {meaning(n) for n in names}
    header = tag == "header" or bool(words & HEADER_WORDS) and tag in ("div", "section")
    noise = gone or tag in NOISE_TAGS or role in NOISE_ROLES or (bool(words & NOISE_WORDS) and tag not in ("html", "body", "article", "main")) or (tag == "article" and bool(words & {"comment", "comments", "reply", "ad", "ads", "related"}))
    name = ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", n.lower()) for n in names})])
    if len(_known) >= 50_000:
        _known.clear()
    found = _known[(tag, rest)] = (name, noise, header, tag in ("article", "main") or role in ("main", "article"))
    return found


def blocks(page: str | None) -> list[tuple[str, str, bool, bool, str]]:
    """(path, text, is noise, is in an article, tag) of each block with text, in page order."""
    out: list[tuple[str, str, bool, bool, str]] = []
    stack = [_Element("", "", False, False, False)]
    held: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((owner.path, text, owner.noise or (owner.header and not (owner.article and owner.tag[:1] == "h" and owner.tag[1:].isdigit())), owner.article, owner.tag))

    def close(tags: set[str], fence: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in fence:
                return

    for m in _TOKEN.finditer(page or ""):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not held:
                    owner = stack[-1]
                    for e in reversed(stack):
                        if e.tag in BLOCK:
                            owner = e if e.noise == stack[-1].noise else stack[-1]
                            break
                elif stack[-1].noise != owner.noise:
                    flush()
                    owner = stack[-1]
                held.append(piece)
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr" and not m["end"]:
            held.append(" ") if held and tag == "br" else None
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            if any(e.tag == tag for e in stack):
                close({tag}, frozenset())
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            close({"p"}, frozenset(("table", "article", "section", "div", "li", "td", "body")))
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], FENCE)
        name, noise, header, article = _described(tag, m["rest"])
        above = stack[-1]
        if tag not in BLOCK and not noise:
            stack.append(_Element(tag, above.path, above.noise, above.article, above.header))
        else:
            stack.append(_Element(tag, f"{above.path}>{name}", noise or above.noise, article and not (noise or above.noise) or above.article, header or above.header))
    flush()
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


STYLE, CONTENT, TEXT = 0, 1, 2


def _tag(path: str) -> str:
    return path.rpartition(">")[2].partition(".")[0]


def _in_article(path: str) -> bool:
    return any(n.partition(".")[0] in ARTICLES for n in path.split(">")[:-1])


def page_nodes(page: str | None) -> list[tuple[str, int, int, int, int]]:
    """(path, copy, what, value, characters) of a page's element paths: their style, content and single texts.

    copy names the text within which equal pages count once; the characters are those of the blocks right in the element.
    """
    found = blocks(page)
    if not found:
        return []
    whole = _hash(*(t for _, t, *_ in found))
    main = _hash(*(t for _, t, noise, article, _ in found if article and not noise))
    children: dict[str, dict[str, None]] = {}
    contents: dict[str, list[str]] = {}
    own: dict[str, dict[str, None]] = {}
    for path, text, noise, _, _ in found:
        if noise:
            continue
        names = path.split(">")
        for i in range(1, len(names)):
            node = ">".join(names[: i + 1])
            contents.setdefault(node, []).append(text)
            children.setdefault(node, {}).setdefault(names[i + 1] if i + 1 < len(names) else "#", None)
        own.setdefault(path, {})[text] = None
    rows = []
    for node, texts in contents.items():
        copy = main if _in_article(node) else whole
        rows.append((node, copy, STYLE, _hash(*children[node]), 0))
        rows.append((node, copy, CONTENT, _hash(*texts), sum(map(len, own.get(node, ())))))
    rows += [(path, main if _in_article(path) else whole, TEXT, _hash(path, text), 0) for path, texts in own.items() for text in texts]
    return rows


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64())
    for batch in batches:
        hosts, rows = [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = page_nodes(page)
            rows += own
            hosts += [host] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["host", "path", "copy", "what", "value", "chars"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def node_counts(pages: DataFrame) -> DataFrame:
    """host, path, what, value, c (different pages that have it there) and chars."""
    nodes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_nodes, "host string, path string, copy long, what byte, value long, chars long")
    each = nodes.groupBy("host", "path", "what", "value", "copy").agg(F.max("chars").alias("chars"))
    return each.groupBy("host", "path", "what", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("chars").alias("chars"))


def style_tree(counts: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """host, path, pages (different ones), chars (of blocks right there), importance."""
    clogc = F.col("c") * F.log(F.col("c"))
    part = lambda what, x: F.sum(F.when(F.col("what") == what, x).otherwise(0))
    sums = counts.where(F.col("what") != TEXT).groupBy("host", "path").agg(part(CONTENT, F.col("c")).alias("pages"), part(STYLE, F.col("c")).alias("styled"), part(CONTENT, clogc).alias("content"), part(STYLE, clogc).alias("style"), F.sum("chars").alias("chars"))

    def entropy(s: str, n: str) -> Column:
        m = F.log(F.col(n))
        return F.when(F.col(n) > 1, (m - F.col(s) / F.col(n)) / m).otherwise(F.lit(1.0))

    return sums.select("host", "path", "pages", "chars", (F.lit(1 - share) * entropy("style", "styled") + F.lit(share) * entropy("content", "pages")).alias("importance"))


def main_branches(tree: DataFrame, least: float, main_share: float, loose: float) -> DataFrame:
    """host, main: the path of its main branch, for hosts that have one.

    Two branches beside each other can't both hold `main_share` (over a half) of the characters, so those that do are one
    chain from the root.
    """
    kept = tree.where((F.col("importance") >= least) & (F.col("chars") > 0)).select("host", "chars", F.split("path", ">").alias("names"))
    tag = lambda name: F.substring_index(name, ".", 1)
    holds = lambda name: tag(name).isin(*CONTAINERS)
    ends = F.filter(F.sequence(F.lit(2), F.size("names")), lambda i: holds(F.get("names", i - 1)))
    up = kept.select("host", "chars", "names", F.array_max(ends).alias("home"), F.explode(ends).alias("i"))
    own = (F.col("home") == F.col("i")) & (tag(F.element_at("names", -1)) != "h1")
    sums = up.groupBy("host", F.array_join(F.slice("names", 1, F.col("i")), ">").alias("path"), F.col("i").alias("depth")).agg(F.sum("chars").alias("chars"), F.sum(F.when(own, F.col("chars")).otherwise(0)).alias("own"))
    total = kept.groupBy(F.col("host").alias("_h")).agg(F.sum("chars").alias("total"))
    chain = sums.join(total, F.col("host") == F.col("_h")).where(F.col("chars") >= main_share * F.col("total"))
    stop = (F.col("own") >= loose * F.col("total")) | tag(F.substring_index("path", ">", -1)).isin(*ARTICLES)
    return chain.groupBy("host").agg(F.coalesce(F.min_by("path", F.when(stop, F.col("depth"))), F.max_by("path", "depth")).alias("main"))


def judged(pages: DataFrame, least: float, least_text: float, share: float, min_pages: int, main_share: float, loose: float) -> DataFrame:
    """_h, main, removed (paths), texts (hashes of path and text): what the trees of hosts with enough pages say."""
    counts = written(node_counts(pages).where((F.col("what") != TEXT) | (F.col("c") > 1)))
    tree = checkpointed(style_tree(counts, share))
    large = tree.where(F.length("path") > 0).groupBy("host").agg(F.max("pages").alias("most")).where(F.col("most") >= min_pages).select("host")
    heading = F.col("path").rlike(r">(?:article|main)\b.*>h[1-6](?:\.[^>]*)?$")
    low = tree.where((F.col("pages") >= min_pages) & (F.col("importance") < least) & ~heading).groupBy("host").agg(F.collect_set("path").alias("removed"))
    often = counts.where(F.col("what") == TEXT).join(tree.where((F.col("pages") >= min_pages) & ~heading).select("host", "path", "pages"), ["host", "path"])
    often = often.where(1 - F.log("c") / F.log("pages") < least_text).groupBy("host").agg(F.collect_set("value").alias("texts"))
    main = main_branches(tree.join(large, "host", "left_semi"), least, main_share, loose)
    out = checkpointed(large.join(main, "host", "left").join(low, "host", "left").join(often, "host", "left").withColumnRenamed("host", "_h"))
    dropped(counts)
    return out


class Site:
    """What a host's tree says."""

    def __init__(self, main: str | None = None, removed: frozenset[str] = frozenset(), texts: frozenset[int] = frozenset()) -> None:
        self.main, self.removed, self.texts = main, removed, texts

    def gone(self, path: str, text: str) -> bool:
        if self.removed:
            names = path.split(">")
            if any(">".join(names[: i + 1]) in self.removed for i in range(1, len(names))):
                return True
        return bool(self.texts) and _hash(path, text) in self.texts

    def in_main(self, path: str, tag: str) -> bool:
        if path == self.main or path.startswith(f"{self.main}>"):
            return True
        return tag == "h1" and f"{self.main}>".startswith(path.rpartition(">")[0] + ">")


def main_text(page: str | None, site: Site | None = None) -> tuple[str, bool]:
    """The text, and whether the main branch of the host's tree gave it."""
    found = [b for b in blocks(page) if not b[2]]
    by_tree = False
    if site is not None and site.main is not None:
        inside = [b for b in found if site.in_main(b[0], b[4])]
        if by_tree := any(b[4] != "h1" or b[0].startswith(f"{site.main}>") for b in inside):
            found = inside
    if not (by_tree and _tag(site.main) in ARTICLES) and any(b[3] for b in found):
        found = [b for b in found if b[3]]
    return "\n".join(text for path, text, *_ in found if site is None or not site.gone(path, text)), by_tree


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Site] = {}
    for batch in batches:
        hosts, mains, removed, texts = (batch.column(i) for i in range(3, 7))
        out = []
        for i, page in enumerate(batch.column(2).to_pylist()):
            host, site = hosts[i].as_py(), None
            if host is not None and (site := known.get(host)) is None:
                if len(known) >= 1000:
                    known.clear()
                site = known[host] = Site(mains[i].as_py(), frozenset(removed[i].as_py() or ()), frozenset(texts[i].as_py() or ()))
            out.append(main_text(page, site))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([b for _, b in out], pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_tree"])


def extract(
    pages: DataFrame, least: float = LEAST, least_text: float = LEAST_TEXT, share: float = CONTENT_SHARE, min_pages: int = MIN_PAGES, main_share: float = MAIN_SHARE, loose: float = LOOSE, salts: int = SALTS, broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """page_id, url, text, n_chars and by_tree (the tree's main branch gave the text) of every page."""
    sites = judged(pages, least, least_text, share, min_pages, main_share, loose)
    chars = F.length("_h") + F.coalesce(F.length("main"), F.lit(0)) + F.coalesce(F.length(F.array_join("removed", " ")), F.lit(0)) + 8 * F.greatest(F.size("texts"), F.lit(0))
    size = sites.agg(F.coalesce(F.sum(chars), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("_salt"))
    if size <= broadcast_chars:
        rows = rows.join(F.broadcast(sites), F.col("_host") == F.col("_h"), "left")
    else:
        dealt = sites.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(dealt, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left")
    rows = rows.select("page_id", "url", "html", "_h", "main", "removed", "texts")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long, by_tree boolean")


def digest(pages: DataFrame, **options: object) -> DataFrame:
    return extract(pages, **options)
