"""Main text of web pages: structure first, then a host suffix array over what structure leaves open."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise
from .suffix import suffix_array

# Elements of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg math object canvas audio video button select textarea dialog menu title noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
# words of class, id and role that mark what isn't the article
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "header masthead topbar footer bottombar sidebar aside rail widget widgets notice notices cookie cookies consent gdpr banner "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager search toolbar skip contentinfo complementary disclaimer".split()
)
# words that say nothing of their own beside those
GENERIC = frozenset(
    "also area articles bar block body bottom box button buttons center col column container content div element feed form forms frame google group "
    "holder icon icons id inner item items left like link links list main may more outer panel post posts reader readers right row section site slot "
    "stories stream text thread threads title top unit user users visitor visitors wrap wrapper you".split()
)
KEPT_ROLES = frozenset({"article", "main"})
#: Places of blocks: elsewhere, in a main element, in an article, in an article below a doubtful mark.
ELSEWHERE, MAIN, ARTICLE, DOUBTFUL = range(4)

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?P<end2>>|\Z)",
    re.S,
)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


_FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
_MAIN = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)


def _wraps_article(source: str, at: int) -> bool:
    """Whether the form whose start tag ends at `at` holds an article or main element: then it is the page, not a form in it."""
    end = _FORM_END.search(source, at)
    return _MAIN.search(source, at, end.start() if end else len(source)) is not None


def _marks(rest: str) -> tuple[int, bool]:
    """(2 for a name that marks what isn't the article, 1 for one that has such a word among others; whether it marks the article).

    `related` and `ad-box` are such names, `related-work` may be anything.
    """
    bad, good = 0, False
    for m in _MARK.finditer(rest):
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if m[1].lower() == "role":
            good |= value.strip().lower() in KEPT_ROLES
        for token in value.split():
            words = {w.lower() for w in _WORD.findall(token)} or {token.lower()}
            if words & MARKED:
                bad = max(bad, 2 if all(w in MARKED or w in GENERIC or w.isdigit() for w in words) else 1)
    return bad, good


def page_blocks(source: str) -> list[tuple[str, int]]:
    """(text, place) of each block in page order, without what structure tells to be no article.

    place is ARTICLE, MAIN, ELSEWHERE, or DOUBTFUL: in an article, but below an element
    whose name has a word for what isn't the article among others. Blocks end
    where block elements begin or end; character references are decoded, white
    space is one space. Unclosed elements, stray ends and a page that breaks off
    are taken as browsers take them, nearly.
    """
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, dropped, place
    text: list[str] = []
    dropped, place = False, 0

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, place))
            text.clear()

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            if not dropped:
                text.append(source[at:])
            break
        if not dropped and m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        if m["name2"] and not m["end2"]:
            break  # the page ends within a tag
        name = name.lower()
        rest = m["rest"] if m["name"] else m["rest2"]
        if m["close"] or m["close2"]:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(x[0] in BLOCKS for x in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end doesn't close blocks
        else:
            if name in BLOCKS:
                flush()
            if name in VOID:
                if name == "br" and not dropped:
                    text.append(" ")
                continue
            if name in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name or (name in ("dt", "dd") and stack[i][0] in ("dt", "dd")):
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
            was_dropped = stack[-1][1] if stack else False
            here = stack[-1][2] if stack else 0
            bad, good = _marks(rest) if "=" in rest else (0, False)
            is_root = name in ("html", "body")
            marked = not is_root and (bad == 2 or bad == 1 and here < ARTICLE and name != "article")
            drop = was_dropped or name in DROPPED and not (name == "form" and here == ELSEWHERE and _wraps_article(source, at)) or marked or (name == "header" and here == ELSEWHERE)
            if name == "article" and not drop:
                here = max(here, ARTICLE)
            elif (name == "main" or good) and not drop:
                here = max(here, MAIN)
            elif bad == 1 and here >= ARTICLE:
                here = DOUBTFUL
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
                if not end:
                    break
            stack.append((name, drop, here))
        top = stack[-1] if stack else ("", False, 0)
        if (top[1], top[2]) != (dropped, place):
            flush()
            dropped, place = top[1], top[2]
    flush()
    return blocks


def proposed(blocks: list[tuple[str, int]]) -> tuple[list[str], list[bool]]:
    """What structure proposes as main text, and which blocks of it the host's other pages must settle.

    An article's blocks, else a main element's; a page with neither proposes all its
    blocks, and all are open. In an article only blocks of doubtful names are.
    """
    for place in (ARTICLE, MAIN):
        if any(place <= p for _, p in blocks):
            return [t for t, p in blocks if p >= place], [p == DOUBTFUL for _, p in blocks if p >= place]
    return [t for t, _ in blocks], [True] * len(blocks)


def unique_runs(pages: list[list[str]], least: int) -> list[list[str]]:
    """Each page's blocks, empty where nothing is left, less the words covered by runs of `least` words or more that occur on distinct pages.

    The pages' word streams are concatenated with separators and suffix-sorted. A
    run that repeats across pages shows as neighbours of different pages with a
    common prefix of `least` words; runs within one block only are compared, as
    blocks end with separators of their own. Blocks that are shorter than `least`
    are compared whole, by their text.
    """
    words: dict[str, int] = {}
    stream, page_of = [], []
    short: dict[str, list[int]] = {}  # first and last page of each short block
    for p, blocks in enumerate(pages):
        for text in blocks:
            if text.count(" ") + 1 < least:
                short.setdefault(text, [p, p])[1] = p
            for w in text.split(" "):
                stream.append(words.setdefault(w, len(words)))
                page_of.append(p)
            stream.append(-1)
            page_of.append(p)
    if not stream:
        return pages
    s = np.array(stream, np.int64)
    page = np.array(page_of)
    ends = np.flatnonzero(s < 0)
    s[s >= 0] += len(ends)
    s[ends] = np.arange(len(ends))
    order = suffix_array(s)
    nearest_end = ends[np.searchsorted(ends, np.arange(len(s)))]
    # how far each suffix agrees with the one before it in the order, up to `least` words
    a, b = order[:-1], order[1:]
    room = np.minimum(nearest_end[a] - a, nearest_end[b] - b)
    common = np.zeros(len(a), np.int64)
    alive = np.ones(len(a), bool)
    for k in range(least):
        ok = alive & (room > k)
        alive = ok.copy()
        i = np.flatnonzero(ok)
        same = s[a[i] + k] == s[b[i] + k]
        common[i[same]] += 1
        alive[i[~same]] = False
    joined = common >= least
    covered = np.zeros(len(s) + 1, np.int64)
    group = np.concatenate([[0], np.cumsum(~joined)])
    low, high = np.full(group[-1] + 1, len(pages)), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, page[order])
    np.maximum.at(high, group, page[order])
    shared = (low < high)[group]
    at = order[shared]
    length = np.minimum(nearest_end[at] - at, least)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + length, -1)
    hit = np.cumsum(covered)[:-1] > 0
    out, pos = [], 0
    for blocks in pages:
        kept = []
        for text in blocks:
            w = text.split(" ")
            left = [x for x, h in zip(w, hit[pos : pos + len(w)]) if not h]
            pos += len(w) + 1
            kept.append("" if len(w) < least and short[text][0] < short[text][1] else " ".join(left))
        out.append(kept)
    return out


def shared_places(pages: DataFrame, least: int) -> DataFrame:
    """(row, places array<struct<block int, at int>>): where runs begin that occur on distinct pages of the host.

    The same runs as `unique_runs` finds, for hosts of any size: each window of
    `least` words within a block, and each shorter block, is one row with the hash
    of host and words, and what isn't confined to one page meets its places again.
    """
    blocks = pages.select("host", "row", F.posexplode("blocks").alias("block", "text")).withColumn("words", F.split("text", " "))
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - least)),
        lambda i: F.unhex(F.md5(F.concat_ws("\n", "host", F.array_join(F.slice("words", i + 1, least), " ")).cast("binary"))),
    )
    windows = blocks.select("row", "block", F.posexplode(windows).alias("at", "w"))
    spread = windows.groupBy("w").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("w")
    return windows.join(spread, "w").groupBy("row").agg(F.collect_list(F.struct("block", "at")).alias("places"))


def without_places(blocks: list[str], places: list[tuple[int, int]], least: int) -> list[str]:
    """Blocks, empty where nothing is left, less the `least` words from each place on."""
    words = [text.split(" ") for text in blocks]
    gone = [bytearray(len(w)) for w in words]
    for block, at in places:
        n = min(least, len(words[block]) - at)
        gone[block][at : at + n] = b"\1" * n
    return [" ".join(x for x, g in zip(w, gone_) if not g) for w, gone_ in zip(words, gone)]


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_words: int = 8, group_pages: int = 256
) -> DataFrame:
    """page_id, url, text, n_chars of every row: the main text of the page.

    Elements and class, id or role names that mark menus, headers, footers,
    sidebars, notices, adverts, forms and comments are left out, with scripts,
    styles and markup. Structure proposes the blocks of the page's article (else main)
    element, else all blocks; repetition on the host settles what structure leaves open:
    all blocks of pages with neither element, and in an article those below a name like
    `related-work`, which may or may not be a mark. The open blocks of a host's pages go
    through the host suffix array: their word streams are suffix-sorted together, and
    runs of at least `least_words` words, or whole blocks, that occur on distinct pages
    are removed; unique runs stay. The pages of a host with more than `group_pages`
    of them don't meet in one task: their runs are compared by hash, over all pages
    of the host, with the same result. What structure settles stays even if it repeats,
    as copies of an article are articles.

    Null html gives an empty text. A null url is a host of its own. Ids may be null
    or repeat, and rows may repeat as a whole; each is a page of its own. A page of any
    length is parsed whole. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    plain = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kind = dict(plain.dtypes)["page_id"]

    def extract(open_pages: bool):
        def go(batches):
            for batch in batches:
                rows, texts, flags = [], [], []
                size = 0
                for i, source in enumerate(batch.column(2)):
                    blocks, doubtful = proposed(page_blocks(source.as_py() or ""))
                    if any(doubtful) != open_pages:
                        continue
                    rows.append(i)
                    texts.append(blocks)
                    flags.append(doubtful)
                    size += sum(map(len, blocks))
                    if size > 8 << 20:
                        yield made(batch, rows, texts, flags)
                        rows, texts, flags, size = [], [], [], 0
                if rows:
                    yield made(batch, rows, texts, flags)

        def made(batch, rows, texts, flags):
            at = pa.array(rows, pa.int64())
            ids = [batch.column(0).take(at), batch.column(1).take(at)]
            if open_pages:
                return pa.RecordBatch.from_arrays([*ids, pa.array(texts, pa.list_(pa.string())), pa.array(flags, pa.list_(pa.bool_()))], ["page_id", "url", "blocks", "open"])
            return pa.RecordBatch.from_arrays(*texts_of(*ids, texts))

        return go

    def texts_of(ids, urls, kept):
        texts = ["\n".join(x) for x in kept]
        return [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]

    def merged(blocks, flags, kept):
        """All blocks in page order, the open ones as far as they are kept."""
        rest = iter(kept)
        found = [next(rest) if f else t for t, f in zip(blocks, flags)]
        return [t for t in found if t]

    schema = f"page_id {kind}, url string, text string, n_chars long"
    closed = plain.mapInArrow(extract(False), schema)
    unsure = plain.mapInArrow(extract(True), f"page_id {kind}, url string, blocks array<string>, open array<boolean>").withColumn("row", F.monotonically_increasing_id())
    unsure = materialise(unsure, "open-pages")
    if unsure.isEmpty():
        return closed
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    doubtful = F.transform(F.filter(F.arrays_zip("blocks", "open"), lambda x: x["open"]), lambda x: x["blocks"])
    unsure = unsure.withColumns({"host": host, "doubtful": doubtful})
    large = unsure.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_pages).select("host")

    def solve(key, table):
        kept = unique_runs(table["doubtful"].to_pylist(), least_words)
        every = [merged(b, f, k) for b, f, k in zip(table["blocks"].to_pylist(), table["open"].to_pylist(), kept)]
        return pa.table(*texts_of(table["page_id"], table["url"], every))

    def cut(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            every = [merged(b, f, without_places(d, [(x["block"], x["at"]) for x in p or []], least_words)) for b, f, d, p in zip(*columns)]
            yield pa.RecordBatch.from_arrays(*texts_of(batch.column(0), batch.column(1), every))

    small = unsure.join(large, "host", "left_anti").groupBy("host").applyInArrow(solve, schema)
    many = unsure.join(large, "host", "left_semi")
    places = shared_places(many.select("host", "row", F.col("doubtful").alias("blocks")), least_words)
    many = many.join(places, "row", "left").select("page_id", "url", "blocks", "open", "doubtful", "places").mapInArrow(cut, schema)
    return closed.unionByName(small).unionByName(many)
