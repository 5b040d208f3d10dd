"""HTML extraction with a host suffix array (operator 8).

Raw text, hidden and boilerplate elements go by their markup.  The tokens of what
it leaves of every page (all blocks where it leaves none) are concatenated by
host; a suffix array over them finds long substrings that repeat on distinct
pages, what they cover goes, and the unique runs stay.  An exact check follows: on
a page with an article or main element, that element's text stays whole, and
nothing beside it.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.repeats import covered
from fathomline.llm.text import window_hashes

#: Tokens of the shortest repeated substring.
RUN = 6
#: Pages of one host that share a suffix array; a larger host is dealt into parts by hash, which tell each other of their runs.
PART_PAGES = 2000

RAW = frozenset("script style noscript template iframe svg textarea title head object canvas select option audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | BOILERPLATE
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class names, ids and roles that mark an element as boilerplate.
MARKS = frozenset("ad-banner cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav related-posts share-buttons site-footer site-header site-nav social-links ad ads advert adverts advertisement banner sidebar cookie cookies consent notice newsletter popup promo sponsored sponsor menu nav navbar navigation breadcrumb breadcrumbs comment comments footer header related share sharing social subscribe toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


#: Headings, and marks that say only how a heading looks.
HEADINGS, LOOKS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("header", "banner"))


def _marked(name: str, attributes: str) -> bool:
    marks = MARKS - LOOKS if name in HEADINGS else MARKS
    return any(w in marks for value in _MARK.findall(attributes) for w in value.strip("\"'").lower().split())


#: Elements that a start tag ends where its author left out the end tag, and the elements that shield them.
_ENDED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_SHIELDS_P = ("button", "table", "td", "th")


class _Open:
    """The elements that are open, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.main = dict.fromkeys(MAIN, 0)  # how many of them are article and main elements
        self.dropped: int | None = None  # the place of the element that is dropped with all inside it

    def cut(self, at: int) -> None:
        for name in self.names[at:]:
            if name in MAIN:
                self.main[name] -= 1
        del self.names[at:]
        if self.dropped is not None and at <= self.dropped:
            self.dropped = None

    def end_implied(self, name: str) -> None:
        for ended, shields in ([(("p",), _SHIELDS_P)] if name in BLOCKS else []) + ([_ENDED_BY[name]] if name in _ENDED_BY else []):
            for at in range(len(self.names) - 1, -1, -1):
                if self.names[at] in ended:
                    self.cut(at)
                    break
                if self.names[at] in shields:
                    break

    def start(self, name: str) -> None:
        self.names.append(name)
        if name in MAIN:
            self.main[name] += 1

    def end(self, name: str) -> None:
        """Ends the innermost element of this name, and all inside it; other elements than blocks end no block."""
        for at in range(len(self.names) - 1, -1, -1):
            if self.names[at] == name:
                return self.cut(at)
            if name not in BLOCKS and self.names[at] in BLOCKS:
                return None
        return None


def blocks(page: str, drop: bool = True) -> tuple[list[str], bool]:
    """The page's blocks in order, and whether an article or main element named them."""
    found, main = left(page, drop)
    return [text for text, in_main in found if in_main or not main], main


def left(page: str, drop: bool = True) -> tuple[list[tuple[str, bool]], bool]:
    """The blocks that markup leaves of a page in order, whether each is in an article or main element, and whether there is such an element.

    An outermost article or main element stays, and so does what contains it.
    Without `drop`, all blocks but those of raw elements are given.  End tags may
    be left out where HTML allows it; an end tag that nothing opened does nothing.
    """
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    opened, main, held_in_main = _Open(), False, False
    inside = 0  # where the content of the dropped element begins
    at, n = 0, len(page)

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, held_in_main))

    while at < n:
        found = _TOKEN.search(page, at)
        if opened.dropped is None:
            piece = page[at : found.start() if found else n]
            if piece:
                held.append(html.unescape(piece) if "&" in piece else piece)
                held_in_main = any(opened.main.values())
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(found[1])
        if not closing and name in RAW:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else n
            if name == "head" and not end:  # an unclosed head ends where the body begins
                body = page.lower().find("<body", found.end())
                at = body if body >= 0 else n
            continue
        if name == "br" and opened.dropped is None:
            held.append(" ")
        if name in BLOCKS and opened.dropped is None:
            close()
        if closing:
            opened.end(name)
        elif name not in VOID:
            opened.end_implied(name)
            if name in MAIN and not opened.main[name]:
                main = True
                if opened.dropped is not None:  # the dropped element holds the main text, so it stays
                    at = inside
                    opened.cut(opened.dropped + 1)
                    opened.dropped = None
                    continue
            elif drop and opened.dropped is None and (name in BOILERPLATE or (found[3] and name not in ("body", "html") and _marked(name, found[3]))):
                opened.dropped, inside = len(opened.names), at
            opened.start(name)
        if name in BLOCKS and opened.dropped is None:
            close()  # what stood before a dropped element that this tag ends
    close()
    return out, main and drop


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` tokens, and the rank of each: equal where those are; by prefix doubling."""
    n = len(tokens)
    _, first = np.unique(tokens, return_inverse=True)
    order, rank, k = np.argsort(first, kind="stable"), first.astype(np.int64), 1
    while k < depth:
        step = min(k, depth - k)  # so the ranks end at `depth` tokens, not beyond
        pair = rank * (n + 1)
        pair[: n - step] += rank[step:] + 1
        order = np.argsort(pair)
        pair = pair[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1])))
        k += step
    return order, rank


def _starts(page: np.ndarray, run: int) -> np.ndarray:
    """Where a substring of `run` tokens stays on its page; page: each token's page, ascending."""
    return np.flatnonzero(page[: max(len(page) - run + 1, 0)] == page[run - 1 :]) if len(page) >= run else np.zeros(0, dtype=np.int64)


def _shared(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Starts of the substrings of `run` tokens that stay on a page and stand on two distinct pages."""
    starts = _starts(page, run)
    if not len(starts):
        return starts
    order, rank = suffix_array(tokens, run)
    order = order[np.isin(order, starts, assume_unique=True)] if len(starts) < len(order) else order
    of, at = rank[order], page[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    two = np.minimum.reduceat(at, first) < np.maximum.reduceat(at, first)
    return order[np.repeat(two, np.diff(np.append(first, len(order))))]


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Tokens covered by a substring of `run` tokens that starts on two distinct pages (and stays on each)."""
    return covered(len(tokens), _shared(tokens, page, run), run)


class Part:
    """Distinct pages of one host, each its blocks, and the runs on them."""

    def __init__(self, pages: list[tuple[str, ...]], run: int):
        self.run, self.pages = run, pages
        words = [" ".join(page).split(" ") if page else [] for page in pages]
        ids: dict[str, int] = {}
        self.tokens = np.array([ids.setdefault(w, len(ids)) for page in words for w in page], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(pages)), [len(page) for page in words])
        self.starts, self.ids = _starts(self.owner, run), ids

    def keys(self) -> np.ndarray:
        """A key (high and low half) of the run at each of `starts`, which means the same in every part."""
        digests = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in self.ids)
        values = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        return np.stack([window_hashes(np.ascontiguousarray(values[:, k])[self.tokens], self.starts, self.run, k) for k in (0, 1)])

    def texts(self, rows: list[tuple[tuple[str, ...], tuple[bool, ...] | None]], elsewhere: np.ndarray) -> list[tuple[str, int]]:
        """Of rows (a page, and which of its blocks markup keeps, None: it has no say): the blocks without what shared runs cover, or those that markup keeps, whole; and how many words are covered.

        A block with none left goes.  elsewhere: starts of runs that other parts hold.
        """
        gone = covered(len(self.tokens), np.concatenate((_shared(self.tokens, self.owner, self.run), elsewhere)), self.run)
        at, of = 0, {}
        for page in self.pages:
            begin, unique = at, []
            for b in page:
                end = at + b.count(" ") + 1
                if not gone[at:end].any():
                    unique.append(b)
                elif not gone[at:end].all():
                    unique.append(" ".join(w for w, g in zip(b.split(" "), gone[at:end], strict=True) if not g))
                at = end
            of[page] = "\n".join(unique), int(gone[begin:at].sum())
        return [of[page] if kept is None else ("\n".join(b for b, k in zip(page, kept, strict=True) if k), of[page][1]) for page, kept in rows]


def _cuts(high: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range of sorted keys of so many bits begins."""
    edges = [((b << bits) + buckets - 1) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(high, np.array(edges, dtype=high.dtype)), [len(high)])).astype(np.int64)


def _packed(prefixes: np.ndarray) -> bytes:
    """Sorted distinct 32-bit numbers as the steps between them, a larger one than 16 bits hold behind a 0."""
    steps = np.diff(prefixes, prepend=np.uint32(0))
    wide = (steps == 0) | (steps > 0xFFFF)
    out = np.zeros(len(steps) + 2 * int(wide.sum()), dtype=np.uint16)
    at = np.arange(len(steps)) + 2 * (np.cumsum(wide) - wide)
    out[at[~wide]] = steps[~wide]
    out[at[wide] + 1], out[at[wide] + 2] = steps[wide] >> 16, steps[wide] & 0xFFFF
    return out.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    halves = np.frombuffer(packed, np.uint16).astype(np.uint32)
    # a 0 is a mark unless one of the two places before it was
    zeros, marks, free = np.flatnonzero(halves == 0), [], 0
    for z in zeros:
        if z >= free:
            marks.append(z)
            free = z + 3
    marks = np.array(marks, dtype=np.int64)
    stay = np.ones(len(halves), dtype=bool)
    stay[marks + 1] = stay[marks + 2] = False
    halves[marks] = (halves[marks + 1] << np.uint32(16)) | halves[marks + 2]
    return np.cumsum(halves[stay], dtype=np.uint32)


def _meet_prefixes(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a host's prefixes in one range: for each part, which of its own another part holds too."""
    held = [_unpacked(x) for x in rows["keys"]]
    values = np.concatenate(held)
    order = np.argsort(values, kind="stable")
    equal = np.zeros(len(order) + 1, dtype=bool)  # to the one before; a part sends a prefix once
    equal[1:-1] = values[order[1:]] == values[order[:-1]]
    flags = np.empty(len(order), dtype=bool)
    flags[order] = equal[:-1] | equal[1:]
    ends = np.cumsum([len(x) for x in held])
    return pd.DataFrame({"host": rows["host"], "part": rows["part"], "bucket": rows["bucket"], "bits": [np.packbits(flags[e - len(x) : e]).tobytes() for e, x in zip(ends, held, strict=True)]})


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a host's keys in one range: for each part, those of its own that another part holds too."""
    held = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in rows["keys"]]
    high, low = np.concatenate(held, axis=1)
    order = np.lexsort((low, high))
    equal = np.zeros(len(order) + 1, dtype=bool)  # to the one before; a part sends a key once
    equal[1:-1] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    flags = np.empty(len(order), dtype=bool)
    flags[order] = equal[:-1] | equal[1:]
    ends = np.cumsum([x.shape[1] for x in held])
    return pd.DataFrame({"host": rows["host"], "part": rows["part"], "keys": [x[:, flags[e - x.shape[1] : e]].tobytes() for e, x in zip(ends, held, strict=True)]})


def extract(pages: DataFrame, run: int = RUN, part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, url, text: one row per row of `pages`, by `judged`."""
    return judged(pages, run, part_pages).select("page_id", "url", "text")


def judged(pages: DataFrame, run: int = RUN, part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, url, text, n_repeated: one row per row of `pages`; n_repeated counts the words that markup leaves and that stand in a run of another page too.

    Null or empty html gives an empty text; a null url is the host "", and a null
    page_id stays null; repeated rows are pages of their own; other columns are ignored.  Copies of one html
    on a host do not count as distinct pages.  A run repeats if it stands on two
    distinct pages of the host, with an article or without, in whatever parts they are.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [left(h or "") for h in part["html"]]
            keeps = [any(kept for _, kept in b) for b, _ in found]
            # where nothing is left, the suffix array decides on all blocks
            found = [(b, m) if k or (b and not m) else (left(h or "", drop=False)[0], False) for h, (b, m), k in zip(part["html"], found, keeps, strict=True)]
            texts = ["\n".join(t for t, _ in b).encode("utf-8", "surrogatepass") for b, _ in found]
            yield part.drop(columns="html").assign(blocks=[zlib.compress(t, 1) for t in texts], kept=[bytes(k for _, k in b) if m else None for b, m in found])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    asked = pages.selectExpr("int(page_id is not null) known", "coalesce(cast(page_id as long), 0) page_id", "url", "html").withColumn("host", host)
    # a row for part_pages pages at most, so this stays small
    large = F.broadcast(asked.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / part_pages).alias("parts")).where("parts > 1"))
    asked = asked.join(large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parsed = asked.mapInPandas(parse, "host string, known int, page_id long, url string, parts long, blocks binary, kept binary")
    # copies of a page share a part, so a run in two parts is on two distinct pages
    dealt = parsed.withColumn("part", F.pmod(F.xxhash64("blocks"), F.col("parts"))).groupBy("host", "part")

    def opened(group: pd.DataFrame) -> tuple[list, Part]:
        held = [tuple(x) for x in zip(group["blocks"], group["kept"], strict=True)]
        # equal blocks are one page for the array, whatever their markup says
        texts = {x: tuple(t.split("\n")) if (t := zlib.decompress(x).decode("utf-8", "surrogatepass")) else () for x in dict.fromkeys(b for b, _ in held)}
        return [(texts[b], k) for b, k in held], Part(list(texts.values()), run)

    def send(group: pd.DataFrame) -> pd.DataFrame:
        rows, parts = [], group["parts"].iloc[0]
        if parts > 1:  # there are others to tell
            prefixes = np.unique((opened(group)[1].keys()[0] >> np.uint64(32)).astype(np.uint32))
            cuts = _cuts(prefixes, math.ceil(parts / 4), 32)
            rows = [(group["host"].iloc[0], group["part"].iloc[0], k, _packed(prefixes[lo:hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        return pd.DataFrame(rows, columns=["host", "part", "bucket", "keys"])

    def ask(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The whole keys of the runs whose prefixes other parts hold."""
        rows = []
        if len(told):
            buckets = math.ceil(group["parts"].iloc[0] / 4)
            keys = opened(group)[1].keys()
            keys = keys[:, np.lexsort((keys[1], keys[0]))]
            keys = keys[:, np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))]
            prefixes, of = np.unique((keys[0] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
            met, cuts = np.zeros(len(prefixes), dtype=bool), _cuts(prefixes, buckets, 32)
            for bucket, bits in zip(told["bucket"], told["bits"], strict=True):
                lo, hi = cuts[bucket], cuts[bucket + 1]
                met[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
            keys = keys[:, met[of]]
            cuts = _cuts(keys[0], buckets, 64)
            rows = [(group["host"].iloc[0], group["part"].iloc[0], k, keys[:, lo:hi].tobytes()) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        return pd.DataFrame(rows, columns=["host", "part", "bucket", "keys"])

    def cut(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        held, part = opened(group)
        elsewhere = part.starts[:0]
        if len(told):
            pair = np.dtype([("high", np.uint64), ("low", np.uint64)])
            theirs = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in told["keys"]], axis=1)
            keys = part.keys()
            near = np.flatnonzero(np.isin(keys[0], theirs[0]))
            own, theirs = (np.ascontiguousarray(x.T).view(pair).ravel() for x in (keys[:, near], theirs))
            elsewhere = part.starts[near[np.isin(own, theirs)]]
        texts = part.texts(held, elsewhere)
        return pd.DataFrame({"known": group["known"], "page_id": group["page_id"], "url": group["url"], "text": [t for t, _ in texts], "n_repeated": [n for _, n in texts]})

    sent = "host string, part long, bucket int, keys binary"
    near = dealt.applyInPandas(send, sent).groupBy("host", "bucket").applyInPandas(_meet_prefixes, "host string, part long, bucket int, bits binary")
    met = dealt.cogroup(near.groupBy("host", "part")).applyInPandas(ask, sent).groupBy("host", "bucket").applyInPandas(_meet, "host string, part long, keys binary")
    told = dealt.cogroup(met.groupBy("host", "part")).applyInPandas(cut, "known int, page_id long, url string, text string, n_repeated long")
    return told.select(F.when(F.col("known") == 1, F.col("page_id")).alias("page_id"), "url", "text", "n_repeated")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


ORACLE_SQL: dict[str, str] = {}
