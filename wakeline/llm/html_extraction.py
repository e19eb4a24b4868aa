"""HTML extraction by nearest-URL page differencing.

Method. Pages of one host are ordered by URL path; a page's partner is the neighbour in that order whose path shares
the most leading segments. The text lines (blocks) of both are aligned by their longest common subsequence: lines
shared with the partner are the host's frame and are deleted. A partner that shares almost all of a page's free text
is a copy of it, not another page of the frame, and deletes nothing.

Differencing alone can't give the whole article: pages quote each other's sentences, and a frame line may be unique (an
advert, a footer's last line). So markup decides where it speaks: what stands in an ``article`` or ``main`` element is
never deleted as shared, what stands in menus, headers, footers, sidebars, notices, adverts, forms or comments (by
element, role or class) is never kept, and free text beside an article is not part of it.

Scale. Only paths and 64-bit line hashes are used to find and fetch partners; html is moved once. Neighbours across
the ends of range partitions meet in a table of one row per partition, so a host with a third of all pages is not one
task. Alignment takes time and memory of the two pages' line counts only (bit vectors, halved where they grow large).

Defined cases: null html is empty and gives an empty text; a page without url, or alone on its host, has no partner;
several pages of one path share the partner of that path; repeated rows give repeated results; broken or cut-off
markup ends where the text ends; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import shuffle_partitions
from wakeline.session import cut_lineage

#: Fixed element and name lists.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
DROPPED = frozenset("aside button canvas dialog footer form head header menu nav object select svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FRAME_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments consent cookie"
    " cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices outbrain pager"
    " pagination paywall popup promo promotion related reply respond search share sharing sidebar signup social sponsor"
    " sponsored subscribe taboola toolbar widget widgets".split()
)
FRAME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Share of a page's free text beyond which a partner counts as its copy.
COPY_SHARE = 0.8
#: Bits of alignment rows held at once; larger alignments are halved.
HELD_BITS = 1 << 27

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.I)
DROP, FREE, MAIN = range(3)


def is_frame(attributes: str) -> bool:
    """Do the class, id, role or visibility of an element make it part of the frame?"""
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if not FRAME_NAMES.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
        elif name == "role":
            if value.strip() in FRAME_ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's text blocks in order; texts are decoded and their white space is single blanks."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    # open elements that matter: name, are its blocks dropped, is it a main element, is it a header inside one, and is
    # it a dropped element within a block, whose text is left out without ending the block
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    dropped, main, heading, hidden = 0, 0, 0, 0

    def now() -> int:
        # an article's own header keeps its headings
        if dropped and not (heading and dropped == sum(s[3] for s in stack)):
            return DROP
        return MAIN if main else FREE

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((now(), text))
        parts.clear()

    def pop() -> None:
        nonlocal dropped, main, hidden
        _, gone, own, _, inline = stack.pop()
        dropped -= gone
        main -= own
        hidden -= inline

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not hidden:
            parts.append(page[at : m.start() if m else end])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        if name == "br":
            parts.append(" ")
        elif m[1]:
            if name in HEADINGS:
                heading = max(0, heading - 1)
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name in RAW:
            close = re.compile(rf"</{name}", re.I).search(page, at)
            at = close.start() if close else end
        elif name not in VOID:
            if block and stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in CLOSED_BY_NEXT.get(name, ()):
                pop()
            if name in HEADINGS:
                heading += 1
            gone = name in DROPPED or is_frame(m[3])
            own = name in ("article", "main") and not gone
            if (block or gone) and not m[3].endswith("/"):
                in_main = bool(main) and not dropped and name == "header"
                stack.append((name, gone and block, own, in_main, gone and not block))
                dropped += gone and block
                hidden += gone and not block
                main += own
    flush()
    return out


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def prefix_lengths(a: list[int], b: list[int]) -> list[int]:
    """LCS length of ``a`` with every prefix of ``b``."""
    place: dict[int, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        m = row & place.get(x, 0)
        row = ((row + m) | (row - m)) & full
    out, n = [0], 0
    for j in range(len(b)):
        n += not row >> j & 1
        out.append(n)
    return out


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Indexes of ``a`` on a longest common subsequence with ``b``."""
    found: set[int] = set()
    common = set(a) & set(b)
    keep = [i for i, x in enumerate(a) if x in common]
    _align([a[i] for i in keep], keep, [x for x in b if x in common], found)
    return found


def _align(a: list[int], at: list[int], b: list[int], found: set[int]) -> None:
    while a and b and a[0] == b[0]:
        found.add(at[0])
        a, at, b = a[1:], at[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        found.add(at[-1])
        a, at, b = a[:-1], at[:-1], b[:-1]
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > HELD_BITS:
        half = len(a) // 2
        head, tail = prefix_lengths(a[:half], b), prefix_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[j])
        _align(a[:half], at[:half], b[:cut], found)
        _align(a[half:], at[half:], b[cut:], found)
        return
    place: dict[int, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        row = rows[-1]
        m = row & place.get(x, 0)
        rows.append(((row + m) | (row - m)) & full)
    # a zero bit is a place where the length steps up; walk back along them
    i, j = len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.add(at[i - 1])
            i, j = i - 1, j - 1


def main_text(blocks: list[tuple[int, str]], partner: list[int] | None) -> str:
    """The page's own text: frame blocks and blocks shared with the partner are left out."""
    deleted: set[int] = set()
    if partner:
        deleted = shared_lines([line_hash(t) for _, t in blocks], partner)
        free = [i for i, (k, _) in enumerate(blocks) if k == FREE]
        size = sum(len(blocks[i][1]) for i in free)
        if sum(len(blocks[i][1]) for i in free if i in deleted) > COPY_SHARE * size:
            deleted -= set(free)
    own = any(k == MAIN for k, _ in blocks)
    kept = [t for i, (k, t) in enumerate(blocks) if k == MAIN or (k == FREE and not own and i not in deleted)]
    return "\n\n".join(kept)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(\.html?|/)+$", "")


def common_segments(a: Column, b: Column) -> Column:
    x, y = F.split(a, "/"), F.split(b, "/")
    return F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(x), F.size(y)) - 1), F.lit(0),
        lambda n, i: F.when((n == i) & (F.get(x, i) == F.get(y, i)), n + 1).otherwise(n),
    )


def partners(paths: DataFrame) -> DataFrame:
    """(host, path, partner): of the two neighbours in path order the one with more leading segments in common."""
    order = ["host", "path"]
    placed = paths.select(*order).distinct().repartitionByRange(shuffle_partitions(paths.sparkSession), *order)
    placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()))
    here = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(*order)
    rows = placed.select("*", F.lag(here).over(inside).alias("before"), F.lead(here).over(inside).alias("behind"))
    ends = placed.groupBy("part").agg(F.min(here).alias("head"), F.max(here).alias("tail"))
    along = Window.orderBy("part")
    ends = ends.select("part", F.lag("tail").over(along).alias("outer_before"), F.lead("head").over(along).alias("outer_behind"))
    rows = rows.join(F.broadcast(ends), "part").select(
        *order, F.coalesce("before", "outer_before").alias("before"), F.coalesce("behind", "outer_behind").alias("behind")
    )

    def score(side: str) -> Column:
        return F.when(F.col(f"{side}.host") == F.col("host"), common_segments(F.col("path"), F.col(f"{side}.path"))).otherwise(-1)

    chosen = F.when(score("behind") > score("before"), F.col("behind.path")).when(score("before") >= 0, F.col("before.path"))
    return rows.select(*order, chosen.alias("partner")).where("partner is not null")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    addressed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[line_hash(t) for _, t in blocks_of(page or "")] for page in batch["html"]]
            yield batch[["page_id", "host", "path"]].assign(lines=lines)

    known = addressed.where("host is not null")
    lined = known.select("page_id", "host", "path", "html").mapInPandas(hashes, "page_id long, host string, path string, lines array<long>")
    per_path = cut_lineage(lined.groupBy("host", "path").agg(F.min_by("lines", F.struct("page_id", "lines")).alias("lines")))
    frames = partners(per_path).join(
        per_path.select("host", F.col("path").alias("partner"), "lines"), ["host", "partner"]
    ).select(F.col("host").alias("h"), F.col("path").alias("p"), "lines")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                main_text(blocks_of(page or ""), None if lines is None else list(lines))
                for page, lines in zip(batch["html"], batch["lines"])
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = addressed.join(frames, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    kind = "page_id long, url string, text string, n_chars long"
    return joined.select(F.col("page_id").cast("long"), "url", "html", "lines").mapInPandas(read, kind)
