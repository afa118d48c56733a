"""Main text of web pages: blocks outside page furniture, without the runs of words that most pages of the host repeat."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.bytehash import U64, mix, salts, signed, text_steps, word_hashes
from tablecraft.llm.registry import query, stored, table
from tablecraft.session import materialize

# A run of RUN words (a block's end counts as one) is furniture if at least SHARE of the host's pages have it; hosts of
# under LEAST_PAGES pages are too few to tell. SHARE is above a third, so a group of copies is not taken for furniture.
RUN, SHARE, LEAST_PAGES, SHARD_PAGES = 8, 0.5, 20, 256
BROADCAST_BYTES = 16 << 20
END = "\x01"

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript template xmp noembed noframes".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog button select object svg canvas audio video map datalist".split())
ROOT = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NEVER_HINTED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
LIST_ITEM = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",)}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "sidebar widget widgets breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer masthead topbar comment comments "
    "respond disqus replies toolbar skip".split())
HEADER_NAMES = frozenset(("header", "site-header", "page-header", "global-header", "top-header"))


def _is_furniture(name: str, attributes: str, in_root: bool) -> bool:
    if name in FURNITURE:
        return not (name == "header" and in_root)  # an article's own header has its title
    if name in NEVER_HINTED or not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            names = value.split()
            if not HEADER_NAMES.isdisjoint(names) or not HINTS.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I) is not None


def blocks_of(html: str) -> list[str]:
    """Texts of the blocks of the main part in page order: those in article or main elements, or all where there are none.

    Character references are decoded and white space in a block is one space. Elements may be left open: a paragraph
    ends at the next block, an item at the next item, and furniture that is never closed ends at the article.
    """
    inside: list[str] = []
    outside: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, in the main part
    gone, root = False, False

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                (inside if root else outside).append(text)

    def shut(depth: int) -> None:
        nonlocal gone, root
        flush()
        del stack[depth:]
        gone, root = stack[-1][1:] if stack else (False, False)

    at = 0
    for_end = len(html)
    while at < for_end:
        tag = TAG.search(html, at)
        if not gone:
            held.append(html[at:tag.start() if tag else for_end])
        if tag is None:
            break
        at = tag.end()
        closing, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in BLOCK or stack[depth][1] != (stack[depth - 1][1] if depth else False):
                        shut(depth)
                    else:
                        del stack[depth:]
                        gone, root = stack[-1][1:] if stack else (False, False)
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else for_end
            continue
        if name in ("br", "td", "th") and not gone:
            held.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        is_root = name in ROOT or 'role="main"' in attributes
        if name == "body" or is_root and gone:
            for depth, (open_, furniture, _) in enumerate(stack):
                if furniture:
                    if name == "body" or not re.compile(rf"</{open_}\s*>", re.I).search(html, at):
                        shut(depth)
                    break
        if name in BLOCK:
            flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    shut(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
        if name in LIST_ITEM:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    shut(depth)
                    break
                if stack[depth][0] in LIST_ITEM[name]:
                    break
        if attributes.endswith("/"):
            continue
        now_gone = gone or _is_furniture(name, attributes, root)
        if now_gone and not gone and name not in BLOCK:
            held.append(" ")
        now_root = root or is_root and not now_gone
        if now_root != root:
            flush()
        stack.append((name, now_gone, now_root))
        gone, root = now_gone, now_root
    flush()
    return inside or outside


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            page_id, url, html = batch.slice(row, 256).columns
            blocks = [blocks_of(h.as_py() or "") for h in html]
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(blocks, pa.list_(pa.string()))], ["page_id", "url", "blocks"])


_PLACE = salts(RUN, 808)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of every RUN words in a row."""
    n = max(0, len(words) - RUN + 1)
    total = np.zeros(n, U64)
    for j in range(RUN):
        total += words[j:j + n] * _PLACE[j]
    return mix(total)


def _stream(blocks) -> str:
    return "".join(f"{b} {END} " for b in blocks)


def common_runs(pages: list[np.ndarray], least: float) -> np.ndarray:
    """Hashes of the runs of RUN words on at least ``least`` of the pages, from a suffix array of their joined words.

    Suffixes are ordered by their first 1, 2, 4 and 8 words in turn, by ranks of halves; suffixes of one rank share RUN
    words. Pages are kept apart by ends of their own.
    """
    if not pages:
        return np.zeros(0, U64)
    words = np.concatenate(pages)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < RUN:
        both = rank[:-length] * (rank.max(initial=0) + 1) + rank[length:]
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        length *= 2
    n = len(rank)
    if n <= 0:
        return np.zeros(0, U64)
    whole = np.flatnonzero(page[:n] == page[RUN - 1:RUN - 1 + n])
    order = whole[np.lexsort((page[whole], rank[whole]))]  # the suffix array, cut at RUN words
    r, p = rank[order], page[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    ranks, first, on = np.unique(r[new], return_index=True, return_counts=True)
    starts = order[new][first[on >= least]]
    return run_hashes(words)[starts]


def _shard_runs(frame: pd.DataFrame) -> pd.DataFrame:
    pages = []
    for _, _, data, bounds in text_steps(pa.array([_stream(b) for b in frame["blocks"]], pa.large_string())):
        words, first = word_hashes(data, bounds)
        pages += [words[a:b] for a, b in zip(first, first[1:])]
    runs = np.unique(common_runs(pages, SHARE * len(pages)))
    host = pd.Series([frame["host"].iloc[0]] * len(runs), dtype=object)
    return pd.DataFrame({"host": host, "run": signed(runs)})


def _on_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate runs that each page has."""
    for batch in batches:
        hosts, found = [], [np.zeros(0, np.int64)]
        for host, blocks, runs in zip(*(c.to_pylist() for c in batch.columns)):
            for _, _, data, bounds in text_steps(pa.array([_stream(blocks)], pa.large_string())):
                here = np.intersect1d(signed(run_hashes(word_hashes(data, bounds)[0])), np.array(runs, np.int64))
                hosts += [host] * len(here)
                found.append(here)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.concatenate(found))], ["host", "run"])


def without_runs(blocks: list[str], runs: np.ndarray) -> list[str]:
    """The words of the blocks that no furniture run covers."""
    words = [w for b in blocks for w in (*b.split(), END)]
    hashed = np.zeros(0, U64)
    for _, _, data, bounds in text_steps(pa.array([" ".join(words)], pa.large_string())):
        hashed = word_hashes(data, bounds)[0]
    if len(hashed) != len(words):
        return blocks  # words with control characters in them; the run hashes do not tell their places
    hit = np.flatnonzero(np.isin(run_hashes(hashed), runs))
    if not len(hit):
        return blocks
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + RUN, -1)
    covered = np.cumsum(covered)[:-1] > 0
    out, line = [], []
    for word, gone in zip(words, covered):
        if word == END:
            if line:
                out.append(" ".join(line))
            line = []
        elif not gone:
            line.append(word)
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, blocks, runs = batch.columns
        texts = [
            "\n".join(b if r is None else without_runs(b, np.array(r, np.int64).view(U64))) for b, r in zip(blocks.to_pylist(), runs.to_pylist())]
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Text is the blocks of the page's main part, joined by line feeds: without menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, comments and markup, and without runs of eight or more words that at least
    half of the pages of the same host have (hosts of 20 pages or more). A null or empty page has an empty text; a page
    without url belongs to no host. Repeated rows repeat and count as pages each. Other columns are not read.

    A host's pages are dealt to shards of about 256 by a hash, however many there are. A run on half of all pages is on
    half of the pages of some shard, so the suffix arrays of the shards find every candidate; these are then counted
    exactly over all pages of the host. A host has few candidates, at most twice the words of a page for each shard.
    Pages are parsed anew in each pass, which costs less than keeping their texts.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    sizes = pages.select(host.alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    sizes = materialize(sizes.where(F.col("pages") >= LEAST_PAGES))
    parsed = pages.mapInArrow(_parse, "page_id long, url string, blocks array<string>").withColumn("host", host)
    shard = F.pmod(F.xxhash64("page_id", "url", "blocks"), F.ceil(F.col("pages") / SHARD_PAGES)).alias("shard")
    dealt = _beside_host(parsed, sizes, "inner").select("host", shard, "blocks").repartition("host", "shard")
    candidates = stored(dealt.groupBy("host", "shard").applyInPandas(_shard_runs, "host string, run long").distinct())
    if candidates.isEmpty():
        stripped = parsed.select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    else:
        listed = candidates.groupBy("host").agg(F.collect_list("run").alias("runs"))
        counted = _beside_host(parsed, listed, "inner").select("host", "blocks", "runs").mapInArrow(_on_page, "host string, run long")
        counted = counted.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
        runs = counted.join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("run").alias("runs"))
        stripped = _beside_host(parsed, materialize(runs), "left").select("page_id", "url", "blocks", "runs").mapInArrow(
            _strip, "page_id long, url string, text string")
    return stripped.withColumn("n_chars", F.length("text").cast("long"))


def _beside_host(pages: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """Pages with a row for each host; sent to all tasks if its size is small, joined by shuffle otherwise."""
    size = F.coalesce(F.size("runs"), F.lit(0)) if "runs" in hosts.columns else F.lit(0)
    held = hosts.agg(F.coalesce(F.sum(F.lit(64) + 8 * size + F.length("host")), F.lit(0))).first()[0]
    return pages.join(F.broadcast(hosts) if held <= BROADCAST_BYTES else hosts, "host", how)


@query("op6_host_suffix_array")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
