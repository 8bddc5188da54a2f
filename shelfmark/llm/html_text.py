"""HTML extraction: the main text of pages, without what a site repeats on its pages.

Every page is parsed once. Element subtrees are hashed (tag, attribute names, class, text
and children), the hashes are counted per host in Spark, and subtrees that recur on many
pages of their host are deleted, inside a marked article too. What says of itself that it is
no text (navigation, footers, adverts and so on, by tag, role, class or id) is deleted on any
page, so that hosts with few pages are served as well. Where a page marks its article (article,
main), only that is taken; paragraphs, headings, list items and cells without a class are text
inside it even if they recur, since sites repeat passages.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import pieces, written

# A subtree is a template if at least this many different pages (inside an article: articles) of the host hold it.
TEMPLATE_PAGES = 4
# A passage without a class outside an article must also be on this share of the host's pages, or on so many pages.
TEMPLATE_SHARE = 0.005
PASSAGE_PAGES = 100

# HTML element names by kind ---------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math maction mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
FOREIGN = frozenset("svg math".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
NO_TEXT = frozenset(
    "nav footer aside form button select option dialog head menu datalist audio video map svg noscript template object canvas "
    "annotation annotation-xml".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification sidebar menu navbar navigation nav breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus newsletter subscribe subscription share sharing social related popup modal widget toolbar pagination pager skip login "
    "signup search".split()
) | frozenset(
    "cookie-notice cookie-banner cookie-bar cookie-consent site-header site-footer page-footer site-nav main-nav main-menu nav-bar side-bar "
    "related-posts related-articles share-buttons social-share social-links ad-banner ad-container ad-slot advert-box newsletter-signup "
    "subscribe-box skip-link comment-form comment-list comments-area".split()
)
# Inside an article an id is most often the anchor of a section; only these are names of a part of the page.
NO_TEXT_IDS_IN_ARTICLE = frozenset("comments disqus-thread respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PASSAGES = HEADINGS | frozenset("p li dt dd tr td th".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
# ---------------------------------------------------------------------------------

_TOKEN = re.compile(
    # A name ends at white space, a slash or the end of its tag: <title-bar> is no title.
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# How an element is no text: by its name, which an article below it overrules, or for good.
BY_NAME, FOR_GOOD = 1, 2


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _tokens(source: str) -> set[str]:
    return set(source.lower().replace("_", "-").split())


def _no_text(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    if tag == "form":
        return BY_NAME  # some sites have one around all of a page
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return FOR_GOOD
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return FOR_GOOD
    if attrs.get("role", "").lower() in NO_TEXT_ROLES:
        return FOR_GOOD
    if in_article and tag in HEADINGS:
        return 0
    ids = NO_TEXT_IDS_IN_ARTICLE if in_article else NO_TEXT_NAMES
    named = not NO_TEXT_NAMES.isdisjoint(_tokens(attrs.get("class", ""))) or not ids.isdisjoint(_tokens(attrs.get("id", "")))
    return BY_NAME if named else 0


class _Element:
    __slots__ = ("tag", "dropped", "main", "rescued", "passage", "hasher", "row", "inner")

    def __init__(self, tag: str, attrs: dict[str, str], dropped: int, main: bool, rescued: bool):
        self.tag, self.dropped, self.main, self.rescued = tag, dropped, main, rescued
        self.passage = tag in PASSAGES and "class" not in attrs
        self.hasher = xxhash.xxh3_64(f"{tag} {sorted(attrs)} {attrs.get('class', '')}")
        self.row: list[int] = []  # blocks that lie inside
        self.inner: list[int] = []  # candidates of which this is the innermost article


def _digest(texts: list[str]) -> int:
    return xxhash.xxh3_64("\n".join(texts)).intdigest() - (1 << 63)


def parse(page: str) -> tuple[list[str], list[list[int]]]:
    """The text blocks of a page that may be main text, and for each the hashes of the
    subtrees around it that count as candidates for a template."""
    return parse_held(page)[:2]


def parse_held(page: str) -> tuple[list[str], list[list[int]], list[tuple[int, int]]]:
    """Blocks and candidates as of ``parse``, and each candidate with a hash of the text that holds it.

    Inside an article that is the article's text, so that one article on several pages (its own,
    archives, copies) counts once; elsewhere it is the page's text. The last bit of a candidate
    tells a passage without a class.
    """
    blocks: list[str] = []
    around: list[list[int]] = []
    in_main: list[bool] = []
    rescued: list[bool] = []  # in an article that lies in an element dropped by name
    plain = False  # whether an article elsewhere has text
    stack: list[_Element] = []
    held: set[tuple[int, int]] = set()
    outer: list[int] = []
    pending: list[str] = []

    def flush() -> None:
        nonlocal plain
        if not pending:
            return
        text = " ".join("".join(pending).split())
        pending.clear()
        if not text:
            return
        if stack and stack[-1].tag == "head":
            close()  # text belongs to the body
        if stack:
            stack[-1].hasher.update(text)
            if stack[-1].dropped:
                return
        for element in stack:
            element.row.append(len(blocks))
        blocks.append(text)
        around.append([])
        in_main.append(bool(stack) and stack[-1].main)
        rescued.append(bool(stack) and stack[-1].rescued)
        plain = plain or (not rescued[-1] and any(e.tag == "article" for e in stack))

    def close() -> None:
        element = stack.pop()
        digest = element.hasher.intdigest()
        if stack:
            stack[-1].hasher.update(digest.to_bytes(8, "little"))
        if not element.row or element.tag in ("html", "body"):
            return
        if element.tag in ("article", "main"):
            if element.inner:
                holder = _digest([blocks[b] for b in element.row])
                held.update((inner, holder) for inner in element.inner)
            return
        if element.main and element.passage:
            return
        candidate = (digest >> 1 << 1 | element.passage) - (1 << 63)
        own = [b for b in element.row if element.main or not in_main[b]]
        for block in own:
            around[block].append(candidate)
        if element.main:
            next(e for e in reversed(stack) if e.tag in ("article", "main")).inner.append(candidate)
        elif own:
            outer.append(candidate)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            pending.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            attrs = _attributes(token["attrs"]) if not token["end"] and tag not in VOID else {}
            if not attrs or not _no_text(tag, attrs, bool(stack) and stack[-1].main):
                continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in INLINE and token["end"] and not any(e.tag == tag for e in stack):
            continue
        flush()
        if token["end"]:
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            continue
        if tag not in IN_HEAD and stack and stack[-1].tag == "head":
            close()  # its end tag may be left out
        if token["attrs"].endswith("/") and (tag in FOREIGN or any(e.tag in FOREIGN for e in stack)):
            continue  # only there does a slash make an element empty
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == "p":
                    while len(stack) > depth:
                        close()
                    break
                if stack[depth].tag not in INLINE:
                    break
        if tag in SAME_LEVEL:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag in SCOPE[tag]:
                    break
                if stack[depth].tag in SAME_LEVEL[tag]:
                    while len(stack) > depth:
                        close()
                    break
        attrs = _attributes(token["attrs"])
        main = bool(stack) and stack[-1].main
        save = bool(stack) and stack[-1].rescued
        dropped = max(stack[-1].dropped if stack else 0, _no_text(tag, attrs, main))
        if tag in ("article", "main") and dropped == BY_NAME and not any(e.tag == "article" for e in stack):
            dropped, save = 0, True
        main = main or (not dropped and tag in ("article", "main"))
        stack.append(_Element(tag, attrs, dropped, main, save))
    if at < len(page):
        pending.append(html.unescape(page[at:]))
    flush()
    while stack:
        close()
    # Articles in elements dropped by name may be those of a list beside the text: they count where no other article has
    # text, and then push out nothing else.
    main_only = any(m and not r for m, r in zip(in_main, rescued))
    stays = [(m or not main_only) and not (r and plain) for m, r in zip(in_main, rescued)]
    blocks, around = [b for b, s in zip(blocks, stays) if s], [a for a, s in zip(around, stays) if s]
    if outer:
        holder = _digest(blocks)
        held.update((candidate, holder) for candidate in outer)
    kept = {candidate for row in around for candidate in row}
    return blocks, around, sorted(pair for pair in held if pair[0] in kept)


_PARSED = (
    "page_id bigint, url string, host string, blocks array<string>, around array<array<bigint>>, "
    "held array<struct<subtree: bigint, holder: bigint>>"
)
_HELD = pa.list_(pa.struct([("subtree", pa.int64()), ("holder", pa.int64())]))


def _host(url: str | None) -> str:
    found = re.match(r"\s*[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def extract_main_text(pages: DataFrame, least_pages: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """One row per page: page_id, url, text (empty if none) and n_chars (code points).

    ``pages`` has page_id, url and html; other columns are not read. Null or empty html
    gives an empty text. A null url, or one without a host, belongs to the nameless host.
    Repeated rows stay rows of their own; pages, or articles, of the same text count once for
    what they hold. An empty table gives no rows.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            urls = piece.column("url").to_pylist()
            parsed = [parse_held(page or "") for page in piece.column("html").to_pylist()]
            columns = [
                piece.column("page_id").cast(pa.int64()), pa.array(urls, pa.string()), pa.array(map(_host, urls), pa.string()),
                pa.array([b for b, _, _ in parsed], pa.list_(pa.string())),
                pa.array([a for _, a, _ in parsed], pa.list_(pa.list_(pa.int64()))),
                pa.array([[dict(zip(("subtree", "holder"), pair)) for pair in h] for _, _, h in parsed], _HELD),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "blocks", "around", "held"])

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    parsed = rows.mapInArrow(build, _PARSED).withColumn("row_key", F.monotonically_increasing_id())
    parsed = written(parsed, "pages")
    is_open = F.exists("around", lambda a: F.size(a) > 0)

    subtrees = parsed.filter(is_open).select("row_key", "host", F.explode("held").alias("h")).select("row_key", "host", "h.*")
    counts = subtrees.groupBy("host", "subtree").agg(F.count_distinct("holder").alias("holding")).filter(F.col("holding") >= least_pages)
    hosts = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    is_box = F.col("subtree").bitwiseAND(1) == 0
    often = F.col("holding") >= F.least(share * F.col("pages"), F.lit(float(PASSAGE_PAGES)))
    templates = counts.join(hosts, "host").filter(is_box | often).select("host", "subtree")
    hits = subtrees.join(templates, ["host", "subtree"]).groupBy("row_key").agg(F.collect_set("subtree").alias("hits"))

    # Pages without a candidate are done; only the others wait for the counts.
    left = parsed.filter(is_open).join(hits, "row_key", "left")
    none = F.array().cast("array<bigint>")
    pairs = F.filter(F.arrays_zip("blocks", "around"), lambda b: ~F.arrays_overlap(b["around"], F.coalesce("hits", none)))
    settled = parsed.filter(~is_open).select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    cleaned = left.select("page_id", "url", F.array_join(F.transform(pairs, lambda b: b["blocks"]), " ").alias("text"))
    return settled.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("bigint"))
