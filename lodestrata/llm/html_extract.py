"""Main text of web pages: block segmentation, then boilerplate removal by a host suffix array.

Pages are cut into blocks by their markup.  The token streams of the pages of one host are
concatenated, a suffix array finds long runs of tokens that stand on several distinct pages, and the
runs' cover is removed from the blocks; what is unique stays.  Elements that are never text
(menus, forms, scripts, comments of readers, ...) go in any case, and are evidence: where a page marks
its article, the article's blocks are the text, and as passages that several articles share are
content, a repeated block of theirs goes only if it also stands outside articles on RUN_PAGES pages.

Hosts with many or long pages are dealt to shards of about SHARD_PAGES pages and SHARD_BYTES bytes,
each with its own array, so no task holds a whole host.  Distinct pages are still counted over the
whole host: the runs and blocks of all its pages are hashed and counted by host, and those that stand on
RUN_PAGES pages are joined back to the shards, so the texts are those of one array over the host.

Defined results: null and empty pages give an empty text; a null url is a host of its own; equal
pages (by all their blocks) count once when repeats are looked for; unclosed and stray tags are tolerated (a
form that never ends leaves nothing out, a head ends before the first element of a body); nothing is cut.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import WordCache, map_text, saved, shared_dir

#: Pages that share one suffix array, and their bytes, about.
SHARD_PAGES, SHARD_BYTES = 400, 16 << 20
#: Hosts of more than a shard that are broadcast at most; beyond it they are joined.
BROADCAST_HOSTS = 100_000
#: Hashes of repeated runs that are broadcast at most, of 16 bytes each; beyond it they are joined.
BROADCAST_RUNS = 1_000_000
#: Tokens of a repeated run, and distinct pages on which it stands, at least.
RUN_TOKENS, RUN_PAGES = 8, 3
#: Blocks outside articles with fewer words than this and mostly of links are menus.
LINK_WORDS, LINK_SHARE = 20, 0.6

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title canvas audio video noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NEVER = frozenset("nav footer aside form button select option dialog menu head".split())
HEAD = frozenset("head base link meta noscript script style template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS_ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion comment comments disqus reply replies related share sharing social "
    "newsletter subscribe subscription cookie cookies consent gdpr notice popup modal overlay sidebar breadcrumb breadcrumbs pagination".split()
)
MARKS_OUTSIDE = MARKS_ALWAYS | frozenset("nav navbar navigation menu header footer masthead banner topbar toolbar search login signup widget widgets links copyright".split())
#: Words that a class name may hold beside marks; a name with any other word is no mark.
NEUTRAL = frozenset(
    "area bar bottom box btn button buttons center container content div el element fixed form foot head icon icons inner inline item items label left "
    "line link links list main menu message module outer page panel post right row section site slot small text thread title top unit wrap wrapper zone".split()
)
CELLS = frozenset("td th caption".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = BLOCK - frozenset(["body", "html"])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FORM_END = re.compile(r"</form\s*>", re.I)
_PART = re.compile(r"[a-z0-9]+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

ARTICLE, MAIN, OTHER, LEFT = 2, 1, 0, -1
Block = tuple[int, str, bool]


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER or name == "header" and not in_article:  # an article's header holds its title
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m.group(1).lower()
        value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key in ("class", "id"):
            marks = MARKS_ALWAYS if in_article or name in ("article", "main", "body", "html") else MARKS_OUTSIDE
            if name not in ("body", "html") and any(_marked(x, marks) for x in value.split()):
                return True
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _unmarked(attributes: str) -> str:
    """The attributes without class and id."""
    return _ATTRIBUTE.sub(lambda m: "" if m.group(1).lower() in ("class", "id") else m.group(), attributes)


def _marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a class name is a mark, or made of marks, neutral words and numbers."""
    parts = _PART.findall(name)
    return any(x in marks for x in parts) and all(x in MARKS_OUTSIDE or x in NEUTRAL or x.isdigit() for x in parts)


def _is_main(name: str, attributes: str) -> bool:
    return name == "main" or bool(attributes) and re.search(r"(?i)\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articlebody\b", attributes) is not None


def blocks(page: str) -> list[Block]:
    """(zone, text, mostly links) of the visible blocks that are no menu, form, advert, ..."""
    return [b for b in all_blocks(page) if b[0] != LEFT]


def all_blocks(page: str) -> list[Block]:
    """The blocks, and in zone LEFT the longer ones of elements that are left out.

    Where nothing is left but an article lies in a marked element, form or article, that is a wrapper: the
    article stays.  Beside other text an article in such an element is a comment or teaser."""
    out, wrapped = _blocks(page, False)
    if wrapped and all(b[0] == LEFT for b in out):
        out, _ = _blocks(page, True)
    return out


def _blocks(page: str, unwrap: bool) -> tuple[list[Block], bool]:
    """The blocks, and whether an article or main was left out for no element but wrappers around it."""
    out: list[Block] = []
    # open elements, and what each turned on: 1 left out, 2 article, 4 main, 8 link, 16 left out but may be a wrapper
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    on = {1: 0, 2: 0, 4: 0, 8: 0, 16: 0}
    wrapped = False
    pieces: list[str] = []
    left: list[str] = []
    linked = 0
    at, n, last_form = 0, len(page), None

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((ARTICLE if on[2] else MAIN if on[4] else OTHER, text, linked > LINK_SHARE * len(text) and text.count(" ") < LINK_WORDS))
            pieces.clear()
        if left:
            text = " ".join("".join(left).split())
            if _long(text):
                out.append((LEFT, text, False))
            left.clear()
        linked = 0

    def close(name: str):
        while stack:
            top, bits = stack.pop()
            opened[top] -= 1
            for bit in on:
                on[bit] -= bool(bits & bit)
            if top == name:
                return

    def say(text: str):
        nonlocal linked
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if on[1] or on[16] and not (unwrap and (on[2] or on[4])):
            left.append(text)
        else:
            pieces.append(text)
            if on[8]:
                linked += len(text.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            if name in BLOCK:
                flush()
            if opened[name] > 0:
                if name in BLOCK or name in CELLS or _closes(stack, name):
                    close(name)
                elif name in FORMATTING:  # it ends, and the blocks in it do not
                    at_last = max(i for i, (top, _) in enumerate(stack) if top == name)
                    _, bits = stack.pop(at_last)
                    opened[name] -= 1
                    for bit in on:
                        on[bit] -= bool(bits & bit)
            continue
        if name in RAW:
            if name in ("svg", "canvas", "audio", "video", "iframe", "noframes") and attributes.endswith("/"):
                continue
            end = _END_OF[name].search(page, at)
            at = end.end() if end else n
            continue
        if opened["head"] > 0:
            if name == "head":
                continue
            if name not in HEAD:
                close("head")
        if name == "form":
            if last_form is None:
                last_form = max((m.start() for m in _FORM_END.finditer(page)), default=-1)
            if last_form < at:  # it never ends, so it holds nothing
                continue
        if name == "br" or name in ("td", "th"):
            say(" ")
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened["p"] > 0 and _closes(stack, "p"):
                close("p")
            if name in ("li", "dt", "dd", "tr") and _closes(stack, name):
                close(name)
        if name in VOID:
            continue
        bits = 1 * _left_out(name, attributes, on[2] > 0)
        if name == "article" and on[2] > 0 and not bits and not unwrap:  # a comment on the article around it
            wrapped, bits = wrapped or not on[1] and not on[16], 1
            stack.append((name, bits))
            opened[name] += 1
            on[1] += 1
            continue
        if bits and not on[2] and not on[4] and name not in ("article", "main") and not _left_out("div" if name == "form" else name, _unmarked(attributes), False):
            bits = 16
        elif not bits:
            wrapped = wrapped or (name == "article" or name == "main") and on[16] > 0 and not on[1]
            bits = 2 * (name == "article") + 4 * _is_main(name, attributes) + 8 * (name == "a")
        stack.append((name, bits))
        opened[name] += 1
        for bit in on:
            on[bit] += bool(bits & bit)
    say(page[at:])
    flush()
    return out, wrapped


def _closes(stack: list[tuple[str, int]], name: str) -> bool:
    """Whether an open `name` lies above the next element that holds blocks of its own: other end tags mean nothing."""
    for top, _ in reversed(stack):
        if top == name:
            return True
        if top in BLOCK or top in ("td", "th"):
            return False
    return False


# ------------------------------------------------------------------ host suffix array


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, and each position's rank on its first `depth` tokens (a power of two)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, step, n = np.argsort(rank, kind="stable"), 1, len(tokens)
    while step < depth:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        step *= 2
    return order, rank


class RunHashes:
    """64-bit hashes of the runs of a token stream, one for each place where a run starts."""

    def __init__(self):
        self.cache = WordCache(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little"))

    def __call__(self, tokens: list[str], run: int = RUN_TOKENS) -> np.ndarray:
        n = len(tokens) - run + 1
        if n <= 0:
            return np.empty(0, np.int64)
        each = np.fromiter((self.cache[t] for t in tokens), np.uint64, len(tokens))
        out = np.zeros(n, np.uint64)
        for j in range(run):
            out = (out ^ out >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
        return out.view(np.int64)


class Known(NamedTuple):
    runs: np.ndarray
    hashes: RunHashes


def repeated_cover(streams: list[list[str]], run: int = RUN_TOKENS, pages: int = RUN_PAGES, whole: list | None = None, known: Known | None = None) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of at least `run` tokens that stands in at least
    `pages` distinct pages.  Pages of equal `whole` are equal and count once; without it, those of
    equal streams do.  `known` are runs that stand in so many pages anyhow.  `run` is a power of two."""
    first: dict = {}
    owner = [first.setdefault(w, i) for i, w in enumerate(map(tuple, streams) if whole is None else whole)]
    names: dict[str, int] = {}
    tokens, page, at = [], [], 0
    for i, s in enumerate(streams):
        if owner[i] == i:
            tokens += [names.setdefault(t, len(names)) for t in s]
            page += [i] * len(s)
        tokens.append(-1 - i)  # a separator that equals nothing
        page.append(i)
    if not names:
        return [np.zeros(len(s), bool) for s in streams]
    text, page = np.array(tokens, np.int64), np.array(page, np.int64)
    order, rank = suffix_ranks(text, run)
    # neighbours in the suffix array with equal rank share their first `run` tokens
    grouped = rank[order]
    pairs = np.unique(np.stack([grouped, page[order]], axis=1), axis=0)
    spread = np.bincount(pairs[:, 0], minlength=len(text))
    starts = spread[rank] >= pages
    if known is not None:
        begin = 0
        for i, s in enumerate(streams):
            size = len(s) if owner[i] == i else 0
            hashes = known.hashes(s[:size], run)
            starts[begin : begin + len(hashes)] |= np.isin(hashes, known.runs)
            begin += size + 1
    edge = np.zeros(len(text) + run + 1, np.int64)
    edge[:-run][: len(text)] += starts
    edge[run : run + len(text)] -= starts
    covered = np.cumsum(edge)[: len(text)] > 0
    out, bounds, cover = [], {}, {}
    for i, s in enumerate(streams):
        size = len(s) if owner[i] == i else 0
        cover[i] = covered[at : at + size] if owner[i] == i else cover[owner[i]]
        at += size + 1
        out.append(cover[i])
    return out


def _long(text: str) -> bool:
    return text.count(" ") >= RUN_TOKENS - 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def page_hash(found: list[Block]) -> int:
    """Of the whole page, its article included: equal for equal pages."""
    return _hash("\n".join(f"{z} {text}" for z, text, _ in found if z != LEFT))


def judged(z: int) -> bool:
    """Whether a block's tokens are in the array: no article's, and none that go in any case."""
    return z in (MAIN, OTHER)


def outside(found: list[Block]) -> list[str]:
    return [t for z, text, _ in found if judged(z) for t in text.split(" ")]


def long_blocks(found: list[Block], article: bool) -> set[int]:
    """Hashes of the blocks of at least a run inside articles, or outside."""
    return {_hash(text) for z, text, _ in found if (z == ARTICLE) == article and _long(text)}


def shared_blocks(pages: list[list[Block]], hashes: list[int]) -> set[int]:
    """Hashes of the blocks that stand inside articles and outside on RUN_PAGES distinct pages each."""
    inside, beyond = Counter(), Counter()
    for found in dict(zip(hashes, pages)).values():
        inside.update(long_blocks(found, True))
        beyond.update(long_blocks(found, False))
    return {x for x, n in inside.items() if n >= RUN_PAGES and beyond[x] >= RUN_PAGES}


def main_text(found: list[Block], covers: list[np.ndarray] | None, notices: set[int] | frozenset[int] = frozenset()) -> str:
    """The article's blocks but notices; without an article, what is uncovered of the best zone's blocks.
    An article that is nothing but notices stays."""
    zone = max((z for z, _, _ in found), default=OTHER)
    kept = []
    for i, (z, text, links) in enumerate(found):
        if z < zone or z == LEFT:
            continue
        if z == ARTICLE:
            if notices and _long(text) and _hash(text) in notices:
                continue
        else:
            if links and z == OTHER:
                continue
            if covers is not None and covers[i].any():
                text = " ".join(t for t, c in zip(text.split(" "), covers[i].tolist()) if not c)
        if text:
            kept.append(text)
    if notices and zone == ARTICLE and not kept:
        return main_text(found, covers)
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    source = source.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")))
    parsed = map_text(
        source, ["id", "url", "host"], "html",
        lambda: lambda page: ([{"zone": z, "text": t, "links": k} for z, t, k in (all_blocks(page) if page else [])],),
        "blocks array<struct<zone:int,text:string,links:boolean>>",
    )
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    shards = F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(size) / SHARD_BYTES))
    big = source.groupBy("host").agg(shards.alias("shards")).where("shards > 1")
    few = big.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    large = F.broadcast(big) if few else big
    shard = F.pmod(F.xxhash64("id", "url"), F.coalesce("shards", F.lit(1))).alias("shard")
    repeated = _repeated_runs(source.join(large.select("host"), "host", "left_semi") if few else source, large, shard)
    dealt = parsed.join(large, "host", "left").select("id", "url", "host", shard, "blocks")
    schema = T.StructType([parsed.schema["id"], parsed.schema["url"], *T.StructType.fromDDL("text string, n_chars bigint").fields])

    def strip(group: pa.Table, known: pa.Table) -> pa.Table:
        found = [[(b["zone"], b["text"], b["links"]) for b in page.as_py() or []] for page in group.column("blocks")]
        runs = Known(known.column("run").to_numpy(), RunHashes()) if known.num_rows else None
        hashes, texts = [page_hash(page) for page in found], []
        notices = shared_blocks(found, hashes) | set(known.column("run").to_pylist())
        for page, cover in zip(found, repeated_cover([outside(page) for page in found], whole=hashes, known=runs)):
            at, covers = 0, []
            for z, text, _ in page:
                size = text.count(" ") + 1 if judged(z) else 0
                covers.append(cover[at : at + size])
                at += size
            texts.append(main_text(page, covers, notices))
        return pa.table([group.column("id"), group.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    out = dealt.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInArrow(strip, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _repeated_runs(source: DataFrame, large: DataFrame, shard: Column) -> DataFrame:
    """host, shard, run: hashes of the runs of large hosts that stand on RUN_PAGES distinct pages of the
    host at least, for each shard in which one stands on a page without an article, and of the blocks
    that `shared_blocks` would give for the whole host, for each shard in which one stands in an article."""

    def factory():
        hashes = RunHashes()

        def work(page: str | None):
            found = all_blocks(page) if page else []
            bare = all(z != ARTICLE for z, _, _ in found)
            return page_hash(found), bare, np.unique(hashes(outside(found))), sorted(long_blocks(found, True)), sorted(long_blocks(found, False))

        return work

    parsed = map_text(source, ["id", "url", "host"], "html", factory, "page bigint, bare boolean, runs array<bigint>, inside array<bigint>, beyond array<bigint>")
    kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("run"))
    kinds = F.concat(*[F.transform(c, kind(k)) for k, c in enumerate(["runs", "inside", "beyond"])])
    rows = parsed.join(large, "host").select("host", shard, "page", "bare", F.explode(kinds).alias("k")).select("host", "shard", "page", "bare", "k.*")
    folder = shared_dir(source.sparkSession)
    rows = saved(rows, folder, "runs").withColumn("key", F.xxhash64("host", "run"))
    often = rows.groupBy("key", "kind").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= RUN_PAGES)
    notices = often.where("kind > 0").groupBy("key").agg(F.count("*").alias("n")).where("n = 2")
    wanted = saved(often.where("kind = 0").select("key", "kind").unionByName(notices.select("key", F.lit(1).alias("kind"))), folder, "wanted")
    few = wanted.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    there = rows.where("kind = 0 and bare or kind = 1").join(F.broadcast(wanted) if few else wanted, ["key", "kind"])
    return there.select("host", "shard", "run").distinct()
