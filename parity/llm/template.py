"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from templates filled with data. A page is read as tokens: its elements, named by their path of
structural tags, and its blocks of text, named by a hash. Tokens of a host that share their occurrence vector (how
often they occur on each of its pages) form an equivalence class; vectors are compared by a sum of mixed (page, count)
values, which combines before the shuffle, so a host with a third of all pages is no more work for one task than any
other. Classes of tokens that occur once on each of their pages and on enough of the host's pages, not all, are kept:
one deviating page or a second page type makes another class and does not undo the first. The kept elements on a page
nest by their paths and are the template of its page group; what lies directly in one of them is a slot. A text is the
template's if it has the vector of a kept element, or is on nearly all pages of the host or of its own element. All
other text is data, and every slot that holds data is read.

Elements that are boilerplate by their meaning (menus, forms, adverts, comments and so on) are left out wherever they
are, unless the page says otherwise: where no article or main element lies outside such elements, one that holds an
article or main element is read, and so is a form or an element with a telling class that holds most of the running
text of the page or of the host. Hidden elements are never read. A host of one page has only such meanings to go by;
the same way is taken by a page without any kept element.

Defined results: a null or empty page, and a page without text, give the empty text. A null url is a host of its own.
Repeated rows count as pages each, but texts that come on copies of one page only are data. On hosts of less than
``least_pages`` pages single texts are never left out, only slots of a lesser part of the text, all of it on every page.
Columns other than id, url and html play no part. The text of a page is never cut.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that path names are made of; the others do not shape a page.
STRUCTURE = frozenset("html body main article section div header footer nav aside table tbody tr td".split())
#: Elements that never hold the article's own words.
MEANT = frozenset(
    "nav aside footer form button select option menu search dialog head datalist fieldset object audio video canvas".split()
)
HINT = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|hidden|login|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|"
    r"subscribe|toolbar|widget",
    re.IGNORECASE,
)
#: Words that a hint may stand with in one class; beside any other (has-, no-, with-, -content) it says nothing.
BESIDE = frozenset(
    "area bar bottom box buttons column form global header icons inner items left links list main mobile posts primary "
    "right secondary site slot text top unit".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
#: A start tag of the first kind closes an open element of the second kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
BLANKS = re.compile(r"\s+")


def attributes(rest: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}


def is_hint(label: str) -> bool:
    """Whether a whole class or id is of hint words."""
    parts = [x for x in re.split("[-_]+", label.lower()) if x and not x.isdigit()]
    hints = [HINT.fullmatch(x) is not None for x in parts]
    return any(hints) and all(h or x in BESIDE for h, x in zip(hints, parts, strict=True))


#: Why an element is left out: by a hint or as a form, by what its tag means, or because it is not shown.
HINTED, MEANS, UNSEEN = 1, 2, 3


def boilerplate(tag: str, given: dict[str, str]) -> int:
    if "hidden" in given or given.get("aria-hidden") == "true":
        return UNSEEN
    role = given.get("role", "").lower()
    if tag == "form" or role == "form":
        return HINTED
    if tag in MEANT or role in ROLES:
        return MEANS
    if tag in ("html", "body", "main", "article"):
        return 0
    return HINTED if any(is_hint(x) for k in ("class", "id") if k in given for x in given[k].split()) else 0


def name_of(tag: str, given: dict[str, str]) -> str:
    label = given.get("id") or given.get("class") or ""
    return f"{tag}.{BLANKS.sub('.', label.strip().lower())}" if label else tag


class Page:
    """The elements and blocks of a page, read once from left to right.

    ``trusted`` are paths of hinted elements that hold most of the host's running text.
    """

    def __init__(self, source: str, trusted: frozenset[str] | set[str] = frozenset()):
        #: The path of every structural element, in order; and blocks (text, element numbers).
        self.elements: list[str] = []
        self.blocks: list[tuple[str, tuple[int, ...]]] = []
        #: Blocks of hinted elements that are not read on this page; another page of the host may say otherwise.
        self.doubted: list[tuple[str, tuple[int, ...]]] = []
        #: Paths of hinted elements with their characters, and the characters of the page; empty beside an article.
        self.hinted: dict[str, int] = {}
        self.running = 0
        self._open: list[tuple[str, bool, int]] = []  # tag, boilerplate, element number or -1
        self._words: list[tuple[str, tuple[int, ...]]] = []  # with the open boilerplate elements
        self._raw: list[tuple[list[tuple[str, tuple[int, ...]]], tuple[int, ...]]] = []
        self._within: tuple[int, ...] = ()
        self._off: tuple[int, ...] = ()
        self._reasons: list[int] = []
        self._paths: list[str] = []
        self._holds: list[bool] = []  # an article or main element
        self._plain = False  # an article or main element outside boilerplate
        for m in TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                self._words.append((text, self._off))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["close"]:
                    self._end(tag)
                else:
                    self._start(tag, m["rest"])
        self._flush()
        self._decide(trusted)

    def _decide(self, trusted: frozenset[str] | set[str]) -> None:
        """Which boilerplate elements are read after all, and the blocks."""
        chars = [0] * len(self._reasons)
        firm = [r != HINTED for r in self._reasons]
        read = [False] * len(self._reasons)
        if not self._plain and self._reasons:
            read = [h and r != UNSEEN for h, r in zip(self._holds, self._reasons, strict=True)]
        if not self._plain:
            for words, _ in self._raw:
                for text, off in words:
                    if not any(firm[k] and not read[k] for k in off):
                        n = len(text.strip())
                        self.running += n
                        for k in off:
                            chars[k] += n
            for k, n in enumerate(chars):
                if not firm[k]:
                    self.hinted[self._paths[k]] = self.hinted.get(self._paths[k], 0) + n
                    read[k] = read[k] or 2 * n > self.running or self._paths[k] in trusted
        for words, within in self._raw:
            sure = [t for t, off in words if all(read[k] for k in off)]
            if text := _clean(sure):
                self.blocks.append((text, within))
            elif not self._plain and (text := _clean([t for t, off in words if all(read[k] or not firm[k] for k in off)])):
                self.doubted.append((text, within))

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self._flush()
            if tag not in ("html", "body"):
                self._pop_to({"p"}, BLOCK - {"p"})
        elif tag == "br":
            self._words.append((" ", self._off))
        if tag in CLOSES:
            self._pop_to(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            return
        given = attributes(rest)
        reason = boilerplate(tag, given)
        if tag in ("article", "main") and not reason:
            self._plain = self._plain or not self._off
            if all(self._reasons[k] != UNSEEN for k in self._off):
                for k in self._off:
                    self._holds[k] = True
        number = -1
        above = self.elements[self._within[-1]] if self._within else ""
        if tag in STRUCTURE:
            number = len(self.elements)
            self.elements.append(f"{above}/{name_of(tag, given)}")
            self._within = (*self._within, number)
        self._open.append((tag, reason > 0, number))
        if reason:
            self._off = (*self._off, len(self._reasons))
            self._reasons.append(reason)
            self._paths.append(f"{above}/{name_of(tag, given)}")
            self._holds.append(False)

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if any(o[0] == tag for o in self._open):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, off, number = self._open.pop()
        if off:
            self._off = self._off[:-1]
        if number >= 0:
            self._within = self._within[:-1]
        return tag

    def _pop_to(self, wanted: set[str], stop) -> None:
        """Close the nearest open element of ``wanted``, unless one of ``stop`` is nearer."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in wanted:
                while len(self._open) > k:
                    self._pop()
                return
            if self._open[k][0] in stop:
                return

    def _flush(self) -> None:
        if self._words:
            self._raw.append((self._words, self._within))
            self._words = []


def _clean(texts: list[str]) -> str:
    return BLANKS.sub(" ", entities.unescape("".join(texts))).strip() if texts else ""


def digest(text: str) -> str:
    """The name of a block of text; texts themselves are not shuffled."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def number_of(name: str) -> int:
    found = hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(found, "big", signed=True)


def features(source: str | None) -> Iterator[tuple[str, str, int, int, int, int]]:
    """(kind, token, occurrences, characters, number of its element, number of the page's texts) of a page."""
    if not source:
        return
    page = Page(source)
    names = {path: number_of(path) for path in {"", *page.elements}}
    texts: dict[str, list[int]] = {}
    said = []
    for blocks in (page.blocks, page.doubted):
        for text, within in blocks:
            name = digest(text)
            if blocks is page.blocks:
                said.append(name)
            seen = texts.setdefault(name, [0, names[page.elements[within[-1]] if within else ""]])
            seen[0] += 1
    sign = number_of("".join(said))
    for path, n in Counter(page.elements).items():
        yield "element", path, n, 0, names[path], sign
    for token, (n, place) in texts.items():
        yield "text", token, n, 0, place, sign
    for path, n in page.hinted.items():
        yield "hinted", path, 1, n, 0, sign
    if page.running:
        yield "running", "", 1, page.running, 0, sign


Names = frozenset[str] | set[str]


def main_text(
    source: str | None,
    frame: Names = frozenset(),
    texts: Names = frozenset(),
    trusted: Names = frozenset(),
    few: bool = False,
) -> str:
    """The data of all slots of the page's template, a block a line: ``frame`` are the paths of the host's template
    elements, ``texts`` the template's texts (of a host of ``few`` pages, texts on all of them). A page without such
    elements gives its articles, its main part or all of it."""
    if not source:
        return ""
    page = Page(source, trusted)
    seen = Counter(page.elements)
    framed = {k for k, path in enumerate(page.elements) if path in frame and seen[path] == 1}
    if not framed:
        chosen = None
        for wanted in ("article", "main"):
            found = {k for k, p in enumerate(page.elements) if p.rpartition("/")[2].split(".")[0] == wanted}
            if found:
                chosen = found
                break
        blocks = [b for b in page.blocks if chosen is None or not chosen.isdisjoint(b[1])]
        return "\n".join(t for t, _ in blocks if few or digest(t) not in texts)
    data = [(t, within, digest(t) not in texts) for t, within in page.blocks]
    if not few:
        return "\n".join(t for t, _, own in data if own)
    slots = [next((k for k in reversed(within) if k in framed), -1) for _, within, _ in data]
    filled = {k for k, (_, _, own) in zip(slots, data, strict=True) if own}
    kept = [t for k, (t, _, _) in zip(slots, data, strict=True) if k in filled]
    whole = [t for t, _, _ in data]
    return "\n".join(kept if 2 * sum(map(len, kept)) > sum(map(len, whole)) else whole)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def templates(pages: DataFrame, least_pages: int = 5, least_share: float = 0.25, nearly: float = 0.9) -> DataFrame:
    """host, pages, frame (paths of the templates' elements), texts (digests of the templates' texts) and trusted (paths
    of hinted elements with most of the host's text). From columns host, page (a hash of the row) and html."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["host", "page", "kind", "token", "n", "chars", "place", "sign"]
        for batch in batches:
            rows: list[tuple] = []
            for host, page, source in zip(batch["host"], batch["page"], batch["html"], strict=True):
                rows += [(host, page, *f) for f in features(source)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    seen = pages.mapInPandas(
        tokens, "host string, page bigint, kind string, token string, n bigint, chars bigint, place bigint, sign bigint"
    )
    # the vector of a token: a sum of mixed values that wraps around, halved so that sums of pages stay in range
    entry = F.shiftright(F.xxhash64("page", "n"), 24)
    vectors = seen.groupBy("host", "kind", "token").agg(
        F.sum(entry).alias("vector"), F.count(F.lit(1)).alias("on"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        F.min("place").alias("place"), (F.min("place") == F.max("place")).alias("one_place"),
        (F.min("sign") != F.max("sign")).alias("on_others"),
    )
    hosts = pages.where("html IS NOT NULL AND html != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    weighed = F.col("kind").isin("hinted", "running")
    found = (
        vectors.where(weighed | ((F.col("on") > 1) & (F.col("n") == F.col("on"))))
        .join(hosts, "host")
        .where(weighed | (F.col("on") >= least_share * F.col("pages")))
        .checkpoint()  # read for elements, texts and hints
    )
    elements = found.where("kind = 'element'")
    classes = elements.select("host", "vector").distinct().withColumn("framed", F.lit(True))
    places = elements.groupBy("host", "place").agg(F.max("on").alias("place_on"))
    texts = (
        found.where("kind = 'text' AND on_others")
        .where((F.col("on") >= least_pages) | ((F.col("pages") < least_pages) & (F.col("on") == F.col("pages"))))
        .join(classes, ["host", "vector"], "left")
        .join(places, ["host", "place"], "left")
        .where(
            F.coalesce("framed", F.lit(False))
            | (F.col("on") >= nearly * F.col("pages"))
            | F.coalesce(F.col("one_place") & (F.col("on") >= nearly * F.col("place_on")), F.lit(False))
        )
        .groupBy("host")
        .agg(F.collect_list("token").alias("texts"))
    )
    frame = elements.groupBy("host").agg(F.collect_list("token").alias("frame"))
    running = found.where("kind = 'running'").select("host", F.col("chars").alias("running"))
    trusted = (
        found.where("kind = 'hinted'")
        .join(running, "host")
        .where(2 * F.col("chars") > F.col("running"))
        .groupBy("host")
        .agg(F.collect_list("token").alias("trusted"))
    )
    known = hosts.withColumn("few", F.col("pages") < least_pages)
    return known.join(frame, "host", "left").join(texts, "host", "left").join(trusted, "host", "left")


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    broadcast_hosts: int = 100_000,
    **options,
) -> DataFrame:
    """page id, url, text of every page."""
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
        F.coalesce(F.regexp_extract(F.lower(F.col(url)), HOST, 1), F.lit("")).alias("host"),
    )
    found = templates(rows.withColumn("page", F.xxhash64("id", "url", "html")), **options).checkpoint()
    few = found.count() <= broadcast_hosts
    known = found.select("host", "frame", "texts", "trusted", "few")
    joined = rows.join(F.broadcast(known) if few else known, "host", "left")

    @F.pandas_udf("string")
    def read(
        source: pd.Series, frame: pd.Series, texts: pd.Series, trusted: pd.Series, few: pd.Series
    ) -> pd.Series:
        out = []
        for row, small in zip(zip(source, frame, texts, trusted, strict=True), few, strict=True):
            names = [frozenset(x) if x is not None else frozenset() for x in row[1:]]
            out.append(main_text(row[0], *names, few=bool(small)))
        return pd.Series(out, dtype=object)

    text = read("html", "frame", "texts", "trusted", F.coalesce("few", F.lit(True))).alias("text")
    return joined.select(F.col("id").alias(page_id), F.col("url").alias(url), text)
