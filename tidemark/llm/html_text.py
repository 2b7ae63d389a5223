"""Main text of web pages by differencing neighbouring pages.

Pages of a host are put in order of their URL path.  Each page's text lines are
aligned with those of the pages next to it by longest common subsequence, and shared
lines, which come from the site's template, are deleted.  Differencing alone cannot
meet the definition of main text: rotating adverts and dated footers are in no
common subsequence, and paragraphs that two articles quote are.  So page structure helps it:

* elements that HTML has for menus, asides, footers, forms and the like are left out;
* so are containers whose class or id is a name of such a part; a name that only holds such a word
  ("ad-free", "social-science") counts only for a minor part of the page, and neither kind can
  empty a page;
* of a page with an article element that is what counts, else the main element or a container
  named as the content, else the body;
* of body and main text differencing deletes every line shared with a neighbour; inside an article
  only lines outside paragraphs, headings, lists, quotes and tables, if both neighbours have them
  (the one, for the first and the last page of a host).

Neighbours that share more than ``COPY_PERCENT`` of the text of both are copies of each other and tell
nothing, and pages with equal lines count as one.

Pages are ordered by range partitioning on (host, path, page_id), so a host with a
third of all pages is spread; the first and last pages of each partition are compared in
a second, smaller round.  A page is parsed once.

Results for odd input: null or empty html gives an empty text; a null url belongs to
the host "" and path ""; broken and cut-off markup is read as far as it goes; rows that repeat are
reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import partitions, saved, small, table

# Elements and names that page authors use for parts of a page.
SKIPPED = frozenset("script style noscript template iframe object svg canvas audio video math title head select option button textarea datalist".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond discussion toolbar copyright disclaimer form search".split()
)
#: Words that may stand beside such a name without changing what it says.
BESIDE = frozenset("area article articles bar blog block bottom box btn button buttons col column container content entry group icons inner item items left links list main module outer page post posts right section site slot stories text title top unit wrap wrapper".split())
PARTIAL = frozenset("has with without no is not".split())
CONTENT = frozenset("article-body article-content articlebody post-content post-body entry-content story-body main-content page-content content story article post entry".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li blockquote pre table dl figure".split())

_WORDS = re.compile(r"[a-z0-9]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_IMPLIED = {tag for tags in _CLOSED_BY.values() for tag in tags}

#: Parts of a page; NAMED is left out for its name alone.
BODY, MAIN, ARTICLE, LEFT_OUT, NAMED = range(5)
#: What differencing may do with a line: nothing (it is not wanted, or it is kept), delete it if one neighbour has it, or if both have.
UNWANTED, EITHER, BOTH, KEPT = range(4)


def _named(value: str) -> str:
    """Whether class names or an id say that the element is not content: "yes", "maybe" or nothing."""
    found = ""
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if not words or words[0] in PARTIAL or not NAMES & set(words):
            continue
        if NAMES.union(BESIDE).issuperset(words):
            return "yes"
        found = "maybe"
    return found


class Page(HTMLParser):
    """Lines of a page, each with the part of the page that it is in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.parts: list[int] = []
        self.weak: list[int] = []  # of each line: the doubtful container that it is in, or -1
        self.loose: list[bool] = []
        self.stack: list[tuple[str, int, int]] = []
        self.open: Counter[str] = Counter()
        self.blocks: list[int] = []  # places of block elements and of those that others close
        self.part, self.group, self.groups = BODY, -1, 0
        self.skip = 0
        self.text: list[str] = []
        self.feed(html)
        if _CUT_TAG.match(self.rawdata):
            self.rawdata = ""  # the page ends inside a tag
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text.clear()
            if line:
                self.lines.append(line)
                self.parts.append(self.part)
                self.weak.append(self.group)
                self.loose.append(not any(self.open[t] for t in PARAGRAPHS))

    def _enter(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """The part inside an element; a doubtful name opens a group."""
        part = self.part
        if part == LEFT_OUT or tag in ("html", "body"):
            return part
        if tag in ASIDE:
            return LEFT_OUT
        if tag == "header":
            return LEFT_OUT if part != ARTICLE else part
        verdict, content = "", False
        for key, value in attrs:
            value = value or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                return LEFT_OUT
            if key == "role" and value.lower() in ROLES:
                return LEFT_OUT
            if key in ("class", "id"):
                content = content or bool(CONTENT & set(value.lower().split()))
                if tag not in ("main", *HEADINGS) and not (part == ARTICLE and "header" in value.lower()):
                    verdict = max(verdict, _named(value))  # "yes" is the greatest
            content = content or key == "itemprop" and value == "articleBody"
        if verdict == "yes":
            return NAMED
        if part == NAMED:
            return part
        if tag == "article" or any(k == "itemprop" and v == "articleBody" for k, v in attrs):
            part = ARTICLE
        elif part == BODY and (tag == "main" or content or any(k == "role" and v == "main" for k, v in attrs)):
            part = MAIN
        if part != self.part:
            self.group = -1
        elif verdict and not content and self.group < 0:
            self.group = self.groups
            self.groups += 1
        return part

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            return
        if tag in _IMPLIED and self.blocks:
            k = self.blocks[-1]
            if tag in _CLOSED_BY.get(self.stack[k][0], ()):
                self._close(k)
        self.stack.append((tag, self.part, self.group))
        self.open[tag] += 1
        if tag in BLOCKS or tag in _CLOSED_BY:
            self.blocks.append(len(self.stack) - 1)
        if tag in SKIPPED:
            self.skip += 1
        had = self.part, self.group
        part = self._enter(tag, attrs)
        if (part, self.group) != had:
            now, self.group = self.group, had[1]
            self._flush()
            self.part, self.group = part, now

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self._flush()

    def _close(self, k: int) -> None:
        _, part, group = self.stack[k]
        if (part, group) != (self.part, self.group):
            self._flush()
        for tag, *_ in self.stack[k:]:
            self.skip -= tag in SKIPPED
            self.open[tag] -= 1
        del self.stack[k:]
        self.part, self.group = part, group
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        if self.open[tag]:  # all above it are closed with it, so every element is passed once
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self._close(k)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def roles(self) -> list[int]:
        """What differencing may do with each line."""
        size = Counter()
        for line, part, group in zip(self.lines, self.parts, self.weak, strict=True):
            size[part] += len(line)
            size[part, group] += len(line)
        # a doubtful container is left out where it is the minor part
        parts = [p if g < 0 or 2 * size[p, g] > size[p] else LEFT_OUT for p, g in zip(self.parts, self.weak, strict=True)]
        want = next((p for p in (ARTICLE, MAIN, BODY, NAMED) if p in parts), BODY)
        return [UNWANTED if p != want else EITHER if p != ARTICLE else BOTH if loose else KEPT for p, loose in zip(parts, self.loose, strict=True)]

    def main_text(self) -> str:
        """The text without differencing."""
        return " ".join(x for x, role in zip(self.lines, self.roles(), strict=True) if role != UNWANTED)


#: Neighbours that share more of their text are copies of one page.
COPY_PERCENT = 80
#: Bits of rows that an alignment may keep for its way back.
ROW_BITS = 1 << 23


def _rows(a: list[int], b: list[int]):
    """Bit-parallel rows of the longest common subsequence: after each line of a, the bits of b that are 0 are its steps."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence.

    Long sequences are halved where the two sides' lengths add up best, so memory grows with their sum.
    """
    if not a or not b:
        return [], []
    if len(a) > 1 and len(a) * len(b) > ROW_BITS:
        mid = len(a) // 2
        total = _lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]
        cut = int(total.argmax())
        (left, right), (more, further) = common(a[:mid], b[:cut]), common(a[mid:], b[cut:])
        return left + [mid + i for i in more], right + [cut + j for j in further]
    rows = list(_rows(a, b))
    left, right = [], []
    i, j = len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif i and not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            left.append(i)
            right.append(j - 1)
            i, j = i - 1, j - 1
    return left[::-1], right[::-1]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


_LIGHT = "content long, host string, path string, page_id long, lines array<long>, roles array<int>, sizes array<int>"
_MET = f"edge boolean, pid int, deleted array<int>, {_LIGHT}"
_PARSED = f"{_LIGHT}, url string, texts array<struct<line:int,role:int,text:string>>"


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each page its wanted lines, and what differencing needs: hashes of all lines and what may be done with them."""
    names = [x.split()[0] for x in _PARSED.split(", ")]
    out = {k: [] for k in names}
    for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html")), strict=True):
        page = Page(html or "")
        roles = page.roles()
        host, path = _place(url)
        lines = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in page.lines]
        content = xxhash.xxh3_64_intdigest(repr((host, lines, roles)).encode("utf-8", "surrogatepass")) - (1 << 63)
        texts = [{"line": k, "role": r, "text": x} for k, (r, x) in enumerate(zip(roles, page.lines, strict=True)) if r != UNWANTED]
        row = (content, host, path, page_id, lines, roles, [len(x) for x in page.lines], url, texts)
        for k, value in zip(names, row, strict=True):
            out[k].append(value)
    text = pa.list_(pa.struct([("line", pa.int32()), ("role", pa.int32()), ("text", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(v, text if k == "texts" else _KINDS[k]) for k, v in out.items()], names)


_KINDS = {
    "edge": pa.bool_(), "pid": pa.int32(), "deleted": pa.list_(pa.int32()), "content": pa.int64(), "host": pa.string(), "path": pa.string(), "page_id": pa.int64(), "lines": pa.list_(pa.int64()),
    "roles": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "url": pa.string(),
}


#: Stand among the numbers of shared lines for a host's last and first page.
LAST, FIRST = -1, -2


def _edge(page: dict, which: int) -> list[int]:
    return [which] if BOTH in page["roles"] else []


def _shared(a: dict, b: dict) -> tuple[list[int], list[int]]:
    """For two neighbours: twice the numbers of the lines of the first that the second has, and of those of the second plus 1.

    Only lines that differencing may delete are named, and none between copies.
    """
    if a["host"] != b["host"]:
        return _edge(a, LAST), _edge(b, FIRST)
    if a["content"] == b["content"]:
        return [], []
    found = dict(zip("ab", common(a["lines"], b["lines"]), strict=True))
    most = []
    for page, at in zip((a, b), found.values(), strict=True):
        wanted = sum(n for n, r in zip(page["sizes"], page["roles"], strict=True) if r)
        most.append(100 * sum(page["sizes"][k] for k in at if page["roles"][k]) > COPY_PERCENT * wanted)
    if all(most):
        return [], []
    left, right = ([k for k in at if page["roles"][k] in (EITHER, BOTH)] for page, at in zip((a, b), found.values(), strict=True))
    return [2 * k for k in left], [2 * k + 1 for k in right]


def _neighbours(light: DataFrame, n: int) -> DataFrame:
    """(content, deleted): line numbers that a page shares with a page next to it in URL order.

    They hold for all pages of that content, so of a run of copies the last one meets the
    next different page, and the first one the page before.  Numbers are doubled; odd ones are
    lines that the page before has.
    """

    def meet(batches):
        def row(page, edge, deleted):
            return {**page, "edge": edge, "deleted": deleted}

        first = last = None
        names = [x.split()[0] for x in _MET.split(", ")]
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if page.get("pid") is None:
                    page["pid"] = own
                if last is None:
                    first = page
                elif page["pid"] != last["pid"] or not page["edge"]:
                    for p, gone in zip((last, page), _shared(last, page), strict=True):
                        if gone:
                            out.append(row(p, False, gone))
                last = page
            if out:
                yield _table(out, names)
        if first is not None and n == 1:
            yield _table([row(first, False, _edge(first, FIRST)), row(last, False, _edge(last, LAST))], names)
        if first is not None:
            yield _table([row(first, True, []), *([row(last, True, [])] if last is not first else [])], names)

    rows = light if "edge" in light.columns else light.select(F.lit(False).alias("edge"), F.lit(None).cast("int").alias("pid"), F.array().cast("array<int>").alias("deleted"), "*")
    met = saved(rows.repartitionByRange(n, "host", "path", "page_id", "content").sortWithinPartitions("host", "path", "page_id", "content").mapInArrow(meet, _MET))
    found = met.where("not edge").select("content", "deleted")
    return found if n == 1 else found.unionAll(_neighbours(met.where("edge"), max(1, n // 500)))


def _table(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[k]) for k in names], names)


def _lines(pages: DataFrame) -> DataFrame:
    """The parsed pages, written."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def parse(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                yield _parsed(batch.slice(k, 200))

    return saved(pages.mapInArrow(parse, _PARSED))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_deleted (lines that differencing deleted from what structure would keep)."""
    parsed = _lines(pages)
    light = parsed.select(*[x.split()[0] for x in _LIGHT.split(", ")])
    found = _neighbours(light, partitions(light, 4.0))
    found = saved(found.select("content", F.explode("deleted").alias("line")).groupBy("content").agg(F.collect_set("line").alias("deleted")))
    rows = parsed.select("page_id", "url", "content", "texts").join(small(found), "content", "left") if found.limit(1).count() else parsed.withColumn("deleted", F.lit(None).cast("array<int>"))
    rows = rows.withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>")))

    def stays(x: Column) -> Column:
        after, before = F.array_contains("deleted", x["line"] * 2), F.array_contains("deleted", x["line"] * 2 + 1)
        both = (after | F.array_contains("deleted", LAST)) & (before | F.array_contains("deleted", FIRST))
        return ~((after | before) & ((x["role"] != BOTH) | both))

    kept = rows.withColumn("kept", F.when(F.size("deleted") > 0, F.filter("texts", stays)).otherwise(F.col("texts")))
    out = kept.withColumn("text", F.concat_ws(" ", F.transform("kept", lambda x: x["text"])))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), (F.size("texts") - F.size("kept")).cast("long").alias("n_deleted"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
