"""HTML extraction: a template per host from valid classes of tokens with equal occurrence vectors; the rest is text."""

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import values
from almanac.llm.url_filter import url_host
from almanac.session import written

SUPPORT = 0.5  # of a host's pages, for a class to be part of its template
CONSTANT_PAGES = 5  # so many different pages must agree before a block counts as the template's
#: What HTML calls by these names isn't the article.
_ASIDE_TAGS = frozenset("head nav footer aside form button select textarea option noscript template iframe svg object dialog menu".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disclaimer footer gdpr header login masthead menu nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription teaser toolbar widget disqus".split()
)
_RAW = frozenset(("script", "style", "title", "xmp", "noembed", "noframes"))
_CONTAINERS = _ASIDE_TAGS | frozenset("html body div section article main header ul ol dl table tbody thead tfoot tr td th figure details fieldset center".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr address caption figcaption summary legend title".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def pieces(page: str) -> Iterator[tuple[str, str | None, bool]]:
    """(path, text, new): the text between marks with the path of containers that it stands in, and whether a block
    begins; a text of None is a container that opens. Tags left open end with the container around them."""
    stack: list[tuple[str, str]] = []
    path, at, new, n = "", 0, True, len(page)
    while at <= n:
        m = _MARK.search(page, at)
        if m is None or m.start() > at:
            yield path, page[at : m.start() if m else n], new
            new = False
        if m is None:
            return
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            yield path, " ", new
        elif tag in _BLOCKS:
            new = True
        if tag in _RAW and not m["end"]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in _CONTAINERS or tag in _EMPTY:
            continue
        elif m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            path = "/".join(name for _, name in stack)
        elif not m["rest"].endswith("/"):
            names = " ".join(x for g in _NAMES.findall(m["rest"]) for x in g if x).lower().split()
            stack.append((tag, ".".join([tag, *sorted(set(names))]).replace("/", "_")))
            path = "/".join(name for _, name in stack)
            yield path, None, new


def inside_article(path: str) -> bool:
    return any(x.split(".")[0] in ("article", "main") for x in path.split("/"))


def aside(path: str, around: frozenset[str] | set[str] = frozenset()) -> bool:
    """True if a container on the path isn't part of an article by its tag, class, id or role.

    Of ``article``, ``main`` and the containers in ``around``, which hold one, only whole names count, not parts of
    names like ``has-sidebar``; ``html`` and ``body`` are the page, whatever their names.
    """
    inside, at = False, ""
    for name in path.split("/"):
        at = f"{at}/{name}" if at else name
        tag, *names = name.split(".")
        inside = inside or tag in ("article", "main")
        if tag in ("html", "body"):
            continue
        if tag in _ASIDE_TAGS or tag == "header" and not inside:
            return True
        whole = tag in ("article", "main") or at in around
        for x in names:
            if x in _ASIDE_WORDS or not whole and len(parts := re.split(r"[-_]+", x)) > 1 and not _ASIDE_WORDS.isdisjoint(parts):
                return True
    return False


def units(page: str | None) -> list[tuple[str, str | None]]:
    """(path, text) in page order: a container that opens, with None, or a block with its words."""
    found: list[tuple[str, str | None]] = []
    path, block = "", []

    def close() -> None:
        if line := " ".join(entities.unescape("".join(block)).split()):
            found.append((path, line))
        block.clear()

    for at, text, new in pieces(page or ""):
        if text is None or new or at != path:
            close()
        path = at
        if text is None:
            found.append((at, None))
        else:
            block.append(text)
    close()
    return found


def token(path: str, text: str | None) -> int:
    """A container that opens, or all words of a block in their place."""
    return xxhash.xxh3_64_intdigest((path if text is None else f"{path}\0{text}").encode("utf-8", "replace")) >> 1


def crossed(sequence: list[int], classes: list[dict]) -> set[int]:
    """Vectors of the classes that aren't valid on a page of these tokens.

    A valid class is ordered: its tokens come round and round in one order. Valid classes are nested: all occurrences of one
    lie in the same slot of another, between two neighbouring tokens, or outside. Of two that cross, the one on more pages,
    or with more tokens, stays.
    """
    of = {t: c["vector"] for c in classes for t in c["tokens"]}
    rank = {c["vector"]: (c["pages"], len(c["tokens"]), c["vector"]) for c in classes}
    walk = [(of[t], t) for t in sequence if t in of]
    places: dict[int, dict[int, int]] = {}
    for v, t in walk:
        own = places.setdefault(v, {})
        own.setdefault(t, len(own))
    bad: set[int] = set()
    slots: dict[int, tuple | None] = {}
    stack: list[tuple[int, int]] = []  # classes whose occurrence is open, and how many of its tokens were met
    for v, t in walk:
        if v in bad:
            continue
        i, at = places[v][t], next((k for k, x in enumerate(stack) if x[0] == v), None)
        if i == 0 and at is None:
            slot = stack[-1] if stack else None
            if slots.setdefault(v, slot) != slot:
                bad.add(v)
                continue
            stack.append((v, 1))
        elif i == 0 or at is None or stack[at][1] != i or any(rank[x] > rank[v] for x, _ in stack[at + 1 :]):
            bad.add(v)
            stack = [x for x in stack if x[0] != v]
            continue
        else:
            bad.update(x for x, _ in stack[at + 1 :])
            stack[at:] = [(v, i + 1)]
        if stack[-1][1] == len(places[v]):
            stack.pop()
    return bad | {x for x, _ in stack}


def extract(page: str | None, template: set[int] | None) -> str:
    """Blocks that remain: those that aren't aside and not of the ``template``. Without a template, those in the article if
    the page has one. A template that is more than half of an article isn't one of it: such an article stays whole."""
    found = units(page)
    around = {p[:i] for p, _ in found if inside_article(p) for i in (m.start() for m in re.finditer("/", p)) if not inside_article(p[:i])}
    known: dict[str, tuple[bool, bool]] = {}
    blocks = []
    for path, text in found:
        if path not in known:
            known[path] = aside(path, around), inside_article(path)
        if text is not None and not known[path][0]:
            blocks.append((known[path][1], text, template is not None and token(path, text) in template))
    article = [(len(text.split()), fixed) for inside, text, fixed in blocks if inside]
    whole = 2 * sum(n for n, fixed in article if fixed) > sum(n for n, _ in article)
    only = bool(article) and template is None
    return "\n".join(text for inside, text, fixed in blocks if (not fixed or inside and whole) and (inside or not only))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, known) from pages (host, html): the tokens of the blocks in valid classes, and whether the host has
    enough pages to have any.

    Tokens are containers that open and blocks with all their words; words of a block that have one occurrence vector
    and one order have the block's. A token's occurrence vector is how often each page has it. Tokens of a host with equal
    vectors are a class; sums of hashes stand for the vectors, so no vector is ever gathered. Classes on at least
    ``SUPPORT`` of the pages and on ``CONSTANT_PAGES`` that are valid on all pages (see ``crossed``) are the template. Pages
    with the same tokens in the same order count as one page, so copies make no template.
    """

    @F.arrow_udf("struct<content:bigint,sequence:array<bigint>>")
    def listed(column: pa.Array) -> pa.Array:
        rows = []
        for p in values(column):
            own = [token(*u) for u in units(p)]
            content = xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "big") for t in own)) >> 1
            rows.append({"content": content, "sequence": own})
        return pa.array(rows, pa.struct([("content", pa.int64()), ("sequence", pa.list_(pa.int64()))]))

    contents = pages.select("host", listed("html").alias("l")).select("host", "l.content", "l.sequence")
    contents = written(contents.dropDuplicates(["host", "content"]), "contents")
    rows = contents.select("host", "content", F.explode("sequence").alias("t")).groupBy("host", "content", "t").count()
    once = F.pmod(F.xxhash64("content", "count"), F.lit(1 << 31))
    vectors = rows.groupBy("host", "t").agg(F.count("*").alias("pages"), F.sum(once).alias("vector"))
    sizes = contents.groupBy("host").agg(F.count("*").alias("all"))
    large = vectors.where(F.col("pages") >= CONSTANT_PAGES).join(sizes, "host").where(F.col("pages") >= F.ceil(F.col("all") * SUPPORT))
    classes = large.groupBy("host", "vector").agg(F.first("pages").alias("pages"), F.array_sort(F.collect_list("t")).alias("tokens"))
    classes = written(classes, "classes")

    @F.arrow_udf("array<bigint>")
    def invalid(sequences: pa.Array, lists: pa.Array, firsts: pa.Array) -> pa.Array:
        out = []
        for sequence, own, first in zip(values(sequences), values(lists), values(firsts), strict=True):
            bad = crossed(sequence, own)
            # the order is that of the page that each class is compared with
            have, kept = {t: k for k, t in enumerate(dict.fromkeys(sequence))}, {t: k for k, t in enumerate(dict.fromkeys(first))}
            for c in own:
                both = [t for t in c["tokens"] if t in have and t in kept]
                if sorted(both, key=have.get) != sorted(both, key=kept.get):
                    bad.add(c["vector"])
            out.append(sorted(bad))
        return pa.array(out, pa.list_(pa.int64()))

    of_host = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("vector", "pages", "tokens"))).alias("own"))
    first = contents.groupBy("host").agg(F.min_by("sequence", "content").alias("first"))
    tested = contents.join(of_host.join(first, "host"), "host")
    bad = tested.select("host", F.explode(invalid("sequence", "own", "first")).alias("vector")).distinct()
    good = classes.join(bad, ["host", "vector"], "left_anti").select("host", F.explode("tokens").alias("t"))
    good = good.groupBy("host").agg(F.collect_list("t").alias("template"))
    return sizes.join(good, "host", "left").select("host", "template", (F.col("all") >= CONSTANT_PAGES).alias("known"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add ``text``: the main text of every page, its blocks in page order, joined by line breaks.

    Pages of a host give its template (see ``templates``): its blocks go, inside an article too unless they are more than
    half of it. Of the others those go that are menus, headers, footers, sidebars, notices, adverts, forms or comments by
    their tags and names. On hosts of fewer than ``CONSTANT_PAGES`` different pages nothing is known of a template: names
    decide and, where there is an ``article`` or ``main``, what is outside it goes. Scripts, styles and comments in the
    source are no text. Character references are decoded, and white space inside a block becomes one space.

    Null and empty pages have an empty text; null URLs share one host, the empty one. Repeated rows get equal texts. A
    column ``text`` is replaced; other columns stay.
    """
    own = pages.drop("text").withColumn("_host", url_host(F.col(url_col)))
    known = templates(own.select(F.col("_host").alias("host"), F.col(html_col).alias("html")))
    template = F.when(F.col("known"), F.coalesce("template", F.array().cast("array<bigint>")))
    known = known.select(F.col("host").alias("_of"), template.alias("_fixed"))

    @F.arrow_udf("string")
    def text(htmls: pa.Array, fixed: pa.Array) -> pa.Array:
        return pa.array([extract(h, None if f is None else set(f)) for h, f in zip(values(htmls), values(fixed), strict=True)], pa.string())

    joined = own.join(known, F.col("_host") == F.col("_of"), "left")
    return joined.withColumn("text", text(F.col(html_col), F.col("_fixed"))).drop("_host", "_of", "_fixed")
