"""Main text of web pages: block structure, and nearest-URL page differencing for what the markup leaves open.

1. Each page becomes text lines, one for a block, each with a zone: main (inside article or main), chrome (menus,
   headers, footers, sidebars, notices, adverts, forms, comments, by tag, class, id or role) or open (neither).
2. Pages are sorted by host and URL path over all tasks, so the nearest URL of a page on its host is a neighbour; each
   task also sees the pages just outside its range. The lines outside the main zone are aligned with the nearest
   page's by longest common subsequence, and shared ones are deleted: what two neighbouring pages share is their
   host's frame.
3. A page with text in a main zone is that zone's lines; any other is its open lines less the deleted ones.

Lines of the main zone are not deleted for being shared: articles on one host do repeat passages, and even whole
articles, and those belong to the text.

Defined cases: null html is empty, and empty html has empty text; null urls share a host of their own; broken or
unclosed markup is read on to the end, an unfinished tag at the end is dropped; a page without a neighbour on its host
loses nothing; repeated rows are pages each (a page equal to its neighbour shares every line outside its main zone); an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as html_lib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import _io

OPEN, MAIN, CHROME, HIDDEN = range(4)
#: HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe object canvas audio video math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
FRAME = set("nav footer aside form button select dialog menu search fieldset".split())
CLOSED_BY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Words of a class, id or role that name a page's frame; the second line only outside an article.
FRAME_WORDS = re.compile(
    r"(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|respond|disqus|discussion|share|sharing|social|related|recommended|pagination|pager|login|signup|widget|toolbar|complementary|contentinfo)",
    re.I,
)
PAGE_WORDS = re.compile(r"(?:header|masthead|topbar|search|alert)", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^<]*\Z""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def named_frame(attributes: str, in_main: bool) -> bool:
    for found in NAMED.finditer(attributes):
        for word in re.split(r"[\s_-]+", found[1] or found[2] or found[3] or ""):
            if FRAME_WORDS.fullmatch(word) or not in_main and PAGE_WORDS.fullmatch(word):
                return True
    return False


def zone_of(tag: str, attributes: str, parent: int) -> int:
    if parent in (CHROME, HIDDEN):
        return parent
    if attributes and UNSEEN.search(attributes):
        return HIDDEN
    if tag in FRAME or tag == "header" and parent != MAIN:
        return CHROME
    if attributes and tag not in ("html", "body") and named_frame(attributes, parent == MAIN or tag in ("article", "main")):
        return CHROME
    return MAIN if tag in ("article", "main") else parent


def lines_of(page: str | None) -> tuple[list[str], list[int], bool]:
    """The text lines of a page, their zones, and whether it has a main zone with text."""
    page = page or ""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, int]] = []
    text: dict[int, list[str]] = {}
    zone, at = OPEN, 0

    def flush() -> None:
        for z, runs in text.items():
            if line := " ".join("".join(runs).split()):
                lines.append(line)
                zones.append(z)
        text.clear()

    def run(raw: str) -> None:
        if raw and zone != HIDDEN:
            text.setdefault(zone, []).append(html_lib.unescape(raw) if "&" in raw else raw)

    while found := TAG.search(page, at):
        run(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag closes its element and what is open in it
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag in RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run(" ")
        else:
            if tag in BLOCKS:
                flush()
                stop = CLOSED_BY.get(tag)
                for i in range(len(stack) - 1, -1, -1):
                    name = stack[i][0]
                    if name == "p" or stop and (name == tag or {name, tag} == {"dt", "dd"} or {name, tag} == {"td", "th"}):
                        del stack[i:]
                        break
                    if name in BLOCKS and (not stop or name in stop):
                        break
            zone = zone_of(tag, found[3], stack[-1][1] if stack else OPEN)
            stack.append((tag, zone))
        zone = stack[-1][1] if stack else OPEN
    run(page[at:])
    flush()
    return lines, zones, MAIN in zones


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of a's lines in a longest common subsequence with b. Bit-parallel over b; halves a where rows would be many."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _aligned(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*range(head), *(i + head for i in inner), *range(len(a) - tail, len(a))]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of a: an integer with a zero bit at j wherever b[j] lengthens the common subsequence with b[:j]."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    v = full
    for line in a:
        u = v & where.get(line, 0)
        v = (v + u | v - u) & full
        yield v


def _aligned(a: list[str], b: list[str]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 1 << 28:  # Hirschberg: split b where the halves of a are best matched
        mid = len(a) // 2
        *_, up = _rows(a[:mid], b)
        *_, down = _rows(a[:mid - 1:-1] if mid else a[::-1], b[::-1])
        zeros = lambda v: [0, *_running(v, len(b))]
        left, right = zeros(up), zeros(down)
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _aligned(a[:mid], b[:cut]) + [i + mid for i in _aligned(a[mid:], b[cut:])]
    rows, out, j = list(_rows(a, b)), [], len(b)
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):  # back from the end: a[i] is used where row i has one more zero than row i - 1
        below = (1 << j) - 1
        before = rows[i - 1] if i else full
        if (~rows[i] & below).bit_count() > (~before & below).bit_count():
            out.append(i)
            while (~rows[i] & below).bit_count() > (~before & below).bit_count() and b[j - 1] != a[i]:
                j -= 1
                below >>= 1
            j -= 1
    return out[::-1]


def _running(v: int, n: int) -> Iterator[int]:
    total = 0
    for j in range(n):
        total += not v >> j & 1
        yield total


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


ORDER = ["host", "path", "page_id", "html"]
RESULT = "page_id long, url string, text string, n_chars long, n_shared long"


def addressed(pages: DataFrame) -> DataFrame:
    """page_id, url, host (lower case), path (all that follows it), html."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return own.select("page_id", "url", F.lower(host).alias("host"), F.substring(rest, F.length(host) + 1, F.length(rest)).alias("path"), "html")


def cut_in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds part: the range, by host, path and page_id, that a row falls into. The first row of each range comes to the driver, without its html."""
    light = rows.select("host", "path", "page_id").repartitionByRange(ranges, "host", "path", "page_id")
    first = light.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("host", "path", "page_id")).alias("x")).select("x.*").collect()
    key = lambda host, path, page: (host, path, not pd.isna(page), 0 if pd.isna(page) else int(page))
    begins = sorted(key(*r) for r in first)[1:]

    @F.pandas_udf("int")
    def part(host: pd.Series, path: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(begins, key(*r)) for r in zip(host, path, page_id)], dtype="int32")

    return rows.withColumn("part", part("host", "path", "page_id"))


def with_neighbours(rows: DataFrame) -> DataFrame:
    """rows with part; the last row of the range before and the first of the range after are added to each range, as rows with shown = false. A range without rows does not count as one."""
    whole = F.struct(*ORDER)
    ends = rows.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    order = Window.orderBy("part")  # a row for each range
    near = ends.select("part", F.lag("last").over(order).alias("a"), F.lead("first").over(order).alias("b"))
    near = near.select("part", F.explode(F.array("a", "b")).alias("x")).where("x IS NOT NULL").select("x.page_id", F.lit(None).cast("string").alias("url"), "x.host", "x.path", "x.html", "part", F.lit(False).alias("shown"))
    return rows.withColumn("shown", F.lit(True)).select("page_id", "url", "host", "path", "html", "part", "shown").unionAll(near)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines deleted because the nearest page has them) for every page.

    Pages are dealt out in ranges of their order by host, path and page_id, and each range also gets the page before it and
    the page after it, so every page meets its nearest one, however the ranges are cut.
    """

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pages_of():
            for f in frames:
                for r in f.itertuples():
                    lines, zones, has_main = lines_of(r.html)
                    yield r, lines, zones, has_main, [i for i, z in enumerate(zones) if z != MAIN]

        def result(now, ends):
            r, lines, zones, has_main, outer = now
            ends = [p for p in ends if p is not None and p[0].part == r.part and p[0].host == r.host]
            other = max(ends, key=lambda p: shared_prefix(p[0].path, r.path), default=None)
            shared = set()
            if other is not None and outer:
                shared = {outer[i] for i in common_lines([lines[i] for i in outer], [other[1][i] for i in other[4]])}
            kept = [x for i, (x, z) in enumerate(zip(lines, zones)) if (z == MAIN if has_main else z == OPEN and i not in shared)]
            text = "\n".join(kept)
            return None if pd.isna(r.page_id) else int(r.page_id), r.url, text, len(text), len(shared)

        def frame(out):
            names = [x.split()[0] for x in RESULT.split(", ")]
            return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "n_chars": "Int64", "n_shared": "Int64"})

        before = now = None
        out = []
        for after in itertools.chain(pages_of(), [None]):
            if now is not None and now[0].shown:
                out.append(result(now, (before, after)))
            before, now = now, after
            if len(out) >= 500:
                yield frame(out)
                out = []
        yield frame(out)

    n = _io.parts(pages.sparkSession)
    rows = with_neighbours(cut_in_ranges(addressed(pages), 4 * n))  # several ranges a task, so that tasks are of about one size
    return rows.repartition(n, "part").sortWithinPartitions("part", *ORDER, "shown").mapInPandas(texts, RESULT)


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_io.table(spark, sf_dir, "pages"))
