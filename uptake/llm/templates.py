"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements and its runs of text, each qualified by the path of elements above it (containers, and other
elements with a class, id or role; numbers of three digits and more in those do not count). Over the pages of one host a token has an
occurrence vector, how often it stands in each page; tokens with equal vectors form an equivalence class. A class is
valid if at least half of the host's pages hold it and it is closed under nesting, i.e. the elements around its
own are in valid classes too. The valid classes nest into the host's template. Runs of text in the class of the very
element they stand in, so wherever it does, are template text; what lies between template tokens, and varies, are slots.

The main text is found by its slots: from the outermost element on, as long as one element holds most of the varying
text and no heading is left outside, that element is entered. Template elements without varying text (menus, adverts,
notices) and template text inside the result are removed. What an element is called (its tag, or the last part of a name in its
class) only decides where the pages do not: whether a varying element beside or inside the main text, such as comments, is part of it,
and which element to enter if none holds most of the text.

Vectors are never built: each task sums a digest of (page, count) per host and token, so a host with a third
of all pages costs one row per token and task. A run that misses one of the task's pages of the host cannot be template text
and is not handed on.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import words
from uptake.llm.chunks import written
from uptake.llm.url_filters import host_and_path

# Quoted values end at the next tag at the latest: a quote that is never closed does not swallow the page.
_PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^<>]*)(?:>|(?=<)|$)"
    r"|<[!?][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

# Elements whose content is no text of the page; the first ones reach to the page's end if they are not closed.
RAW = frozenset("script style textarea title".split())
SKIPPED = RAW | frozenset("noscript template svg iframe select button object canvas math audio video".split())
# Elements that hold others, whether they have a class or not.
CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside form ul ol dl table figure "
    "fieldset dialog details menu blockquote center".split())
# Other elements that begin a new block of text.
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre hr address figcaption summary hgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that end where one of these begins.
_ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# What the standard's elements mean, and last parts of names that mean the same.
MAIN_TAGS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("head nav footer aside menu dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent notice popup modal newsletter subscribe "
    "share sharing social related recommended comment comments disqus reply replies respond widget "
    "pagination pager toolbar login search skip".split())


class Node(NamedTuple):
    path: int
    parent: int
    name: str
    aside: bool


class Run(NamedTuple):
    node: int
    block: int
    text: str
    heading: bool


class Template(NamedTuple):
    """What a host's pages have in common: the path to enter, if any, the paths and the runs to leave out."""

    main: int | None = None
    paths: frozenset = frozenset()
    runs: frozenset = frozenset()


def _digest(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _named(name: str, rest: str):
    """The element with its class, id and role, and whether their names end like those of an aside."""
    if not rest or rest.isspace():
        return name, False
    found, aside = {}, False
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        parts = (a or b or c).lower().split()
        found.setdefault(key.lower(), " ".join(sorted(re.sub("[0-9]{3,}", "#", p) for p in parts)))
        aside |= any(re.split("[^a-z]+", p.rstrip("0123456789-_"))[-1] in ASIDE_NAMES for p in parts)
    return name + "".join(f"|{k}={v}" for k, v in sorted(found.items()) if v), aside


def parse(source: str, known: dict | None = None):
    """(nodes, runs) of a page. The first node is the page itself, with path 0. ``known`` keeps paths between pages."""
    known = {} if known is None else known
    nodes, runs, stack, text = [Node(0, -1, "", False)], [], [0], []
    block, heading, at, unclosed = 0, False, 0, set()

    def end_run():
        if text:
            runs.append(Run(stack[-1], block, "".join(text), heading))
            text.clear()

    def close(upto):
        """Leave all elements from stack position ``upto`` on."""
        nonlocal block
        end_run()
        if any(nodes[i].name in BLOCKS for i in stack[upto:]):
            block += 1
        del stack[upto:]

    def position(name):
        """Where in the stack an element of that name is open, within the innermost container."""
        for i in range(len(stack) - 1, 0, -1):
            if nodes[stack[i]].name == name:
                return i
            if name not in CONTAINERS and nodes[stack[i]].name in CONTAINERS:
                return 0
        return 0

    while at < len(source):
        m = _PIECE.search(source, at)
        if m is None:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["close"] or m["close2"]:
            if name in BLOCKS:
                end_run()
                block += 1
                heading = heading and name not in HEADINGS
            found = position(name)
            if found:
                close(found)
            continue
        alone = rest.endswith("/")
        if name in SKIPPED:
            if alone and name not in RAW or name in unclosed:
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(source, at)
            if end:
                at = end.end()
            elif name in RAW:
                at = len(source)
            else:
                unclosed.add(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        for ended, by in _ENDED_BY.items():
            if name in by and (found := position(ended)):
                close(found)
        if name in BLOCKS:
            end_run()
            block += 1
            heading = name in HEADINGS
        if name in VOID:
            continue
        token, aside = _named(name, rest)
        # Elements without a name of their own are no part of paths, but count where they hide in one of their kind.
        plain = name not in CONTAINERS and token == name
        if alone or plain and not position(name):
            continue
        end_run()
        above = nodes[stack[-1]]
        path = above.path if plain else known.get((above.path, token))
        if path is None:
            path = known[above.path, token] = _digest(above.path, token)
        aside = name in ASIDE_TAGS or aside and name not in ("html", "body")
        nodes.append(Node(path, stack[-1], name, aside and not plain))
        stack.append(len(nodes) - 1)
    end_run()
    return nodes, runs


def _run_token(path: int, text: str) -> int:
    return _digest(path, " ".join(text.split()))


class Stats(NamedTuple):
    """A path over some pages: its parent, element, whether it is an aside by name, pages and words, of these in
    headings, and its occurrence vector's digest."""

    parent: int
    name: str
    aside: bool
    pages: int
    words: int
    headings: int
    vector: tuple = ()


def page_stats(nodes, runs) -> dict:
    """{path: Stats} of one page, words counting those of all elements inside."""
    count = np.zeros((len(nodes), 2), dtype=np.int64)
    for run in runs:
        n = len(run.text.split())
        count[run.node] += (n, n if run.heading else 0)
    for i in range(len(nodes) - 1, 0, -1):
        count[nodes[i].parent] += count[i]
    out = {}
    for (path, parent, name, aside), (n, h) in zip(nodes, count.tolist()):
        above = nodes[parent].path if parent >= 0 else -1
        if above == path:
            continue  # a plain element inside one of its kind: counted there
        old = out.get(path)
        out[path] = Stats(above, name, aside, 1, n + old.words, h + old.headings) if old else Stats(above, name, aside, 1, n, h)
    return out


def deduce(pages: int, paths: dict, runs: dict) -> Template:
    """The template of some pages, from their ``paths`` {path: Stats} and the runs {token: (path, words, headings, pages)}
    in the classes of their elements. One page alone has slots only."""
    paths = {p: s for p, s in paths.items() if 2 * s.pages >= pages}
    children, order = {}, [0]
    for path, s in paths.items():
        children.setdefault(s.parent, []).append(path)
    for path in order:  # the valid classes: those whose surroundings are valid
        order.extend(children.get(path, ()))
    if 0 not in paths:
        return Template()
    fixed = {p: [0, 0] for p in order}
    for path, n, h, times in runs.values():
        while path in fixed and times > 1:
            fixed[path][0] += n
            fixed[path][1] += h
            path = paths[path].parent
    if 2 * fixed[0][0] > paths[0].words:
        # Copies of one page: what they have in common is no template.
        fixed, runs = {p: [0, 0] for p in order}, {}
    slots = {p: paths[p].words - fixed[p][0] for p in order}
    headings = {p: paths[p].headings - fixed[p][1] for p in order}
    weigh = 5 * slots[0]

    def is_aside(path):
        s = paths[path]
        return s.name in ASIDE_TAGS or (s.aside or s.name == "form") and weigh > 0 and 25 * slots[path] < 4 * weigh
    aside = {p for p in order if is_aside(p)}
    constant = {p for p in order if paths[p].pages > 2 and paths[p].words and not slots[p]}
    # Varying text outside of asides; a page's header counts as one here.
    open_words, open_headings = dict(slots), dict(headings)
    for path in reversed(order):
        if path in aside or paths[path].name == "header":
            open_words[path] = open_headings[path] = 0
        else:
            inner = children.get(path, ())
            open_words[path] = slots[path] - sum(slots[c] - open_words[c] for c in inner)
            open_headings[path] = headings[path] - sum(headings[c] - open_headings[c] for c in inner)
    main = 0
    while paths[main].name not in MAIN_TAGS:
        inner = [c for c in children.get(main, ()) if open_words[c] > 0]
        if not inner:
            break
        best = max(inner, key=lambda c: (open_words[c], c))
        told = [c for c in inner if paths[c].name in MAIN_TAGS]
        if 3 * open_words[best] >= 2 * open_words[main] and open_headings[best] == open_headings[main]:
            main = best
        elif len(told) == 1:
            main = told[0]
        else:
            break
    return Template(main, frozenset(aside | constant), frozenset(t for t, run in runs.items() if run[3] > 2))


def extract(source: str, template: Template | None = None) -> str:
    """The main text of a page under its host's template, blocks joined by line breaks. Where the
    page lacks the template's main element, or there is no template, its own elements decide."""
    nodes, runs = parse(source)
    stats = page_stats(nodes, runs)
    own = deduce(1, stats, {})
    template = template or Template()
    main = template.main if template.main in stats else own.main
    left_out = template.paths | own.paths
    inside, kept = [], []
    for path, parent, name, _ in nodes:
        above = parent >= 0 and inside[parent]
        # The page's header is no main text, one inside the main element is.
        header = name == "header" and not (above and stats.get(main) and stats[main].name not in ("", "html", "body"))
        inside.append(above or path == main)
        kept.append((parent < 0 or kept[parent]) and (path == main or path not in left_out and not header))
    blocks = {}
    for run in runs:
        if inside[run.node] and kept[run.node] and not (template.runs and _run_token(nodes[run.node].path, run.text) in template.runs):
            blocks.setdefault(run.block, []).append(run.text)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(t for t in texts if t)


# ---- over hosts -------------------------------------------------------------------------------

_MOST_TOKENS = 500_000
_TOKENS = (
    "host string, path bigint, run bigint, parent bigint, name string, aside boolean, d1 bigint, d2 bigint, pages bigint, "
    "words bigint, headings bigint")


def _occurrences(batches):
    """Per host and token of a task: digests of its occurrence vector, pages and words. Paths have no run; runs that
    miss one of these pages in which their element stands are left out, as their vectors differ."""
    hosts, held, known = {}, 0, {}

    def rows():
        out = []
        for host, (paths, runs) in hosts.items():
            out += [(host, path, None, *row) for path, row in paths.items()]
            out += [(host, path, run, None, None, None, *row) for path, found in runs.items() for run, row in found.items()]
        columns = list(zip(*out)) or [[]] * 11
        hosts.clear()
        known.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 5)
        names = [x.split()[0] for x in _TOKENS.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for host, source, key in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "page_key"))):
            if not source:
                continue
            nodes, found = parse(source, known)
            paths, runs = hosts.setdefault(host, ({}, {}))
            stats, times, here = page_stats(nodes, found), {}, {}
            for node in nodes:
                times[node.path] = times.get(node.path, 0) + 1
            for run in found:
                n = len(run.text.split())
                if n:
                    path = nodes[run.node].path
                    row = here.setdefault((path, _run_token(path, run.text)), [0, 0, 0])
                    for i, x in enumerate((1, n, n if run.heading else 0)):
                        row[i] += x
            count = np.array([*times.values(), *(row[0] for row in here.values())], dtype=np.uint64)
            digest = words.pair_up(np.full(len(count), key & (2 ** 64 - 1), dtype=np.uint64), count)
            low, high = (digest & np.uint64(0x3FFFFFFF)).tolist(), (digest >> np.uint64(34)).tolist()
            fresh = set()
            for path, one, two in zip(times, low, high):
                s = stats[path]
                row = paths.get(path)
                if row is None:
                    row = paths[path] = [s.parent, s.name, s.aside, 0, 0, 0, 0, 0]
                    runs[path] = {}
                    fresh.add(path)
                for i, x in enumerate((one, two, 1, s.words, s.headings), 3):
                    row[i] += x
            held += len(fresh)
            mine = {path: {} for path in times}
            for ((path, token), (_, n, h)), one, two in zip(here.items(), low[len(times):], high[len(times):]):
                old = [0] * 5 if path in fresh else runs[path].get(token)
                # Only what stood in the element on all pages so far may be of its class.
                if old is not None:
                    mine[path][token] = [a + b for a, b in zip(old, (one, two, 1, n, h))]
            held += sum(len(new) - len(runs[path]) for path, new in mine.items())
            runs.update(mine)
            if held > _MOST_TOKENS:
                yield rows()
                held = 0
    yield rows()


def _deduced(key, table):
    paths, runs, pages, rows = {}, {}, 0, table.to_pylist()
    for row in rows:
        pages = row["n"]
        if row["run"] is None:
            vector = (row["d1"], row["d2"])
            paths[row["path"]] = Stats(row["parent"], row["name"], row["aside"], row["pages"], row["words"], row["headings"], vector)
    for row in rows:
        if row["run"] is not None and row["path"] in paths and paths[row["path"]].vector == (row["d1"], row["d2"]):
            runs[row["run"]] = (row["path"], row["words"], row["headings"], row["pages"])
    found = deduce(pages, paths, runs)
    return pa.table({
        "host": pa.array([key[0].as_py()], pa.string()), "main": pa.array([found.main], pa.int64()),
        "paths": pa.array([sorted(found.paths)], pa.list_(pa.int64())), "runs": pa.array([sorted(found.runs)], pa.list_(pa.int64()))})


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, paths, runs): the template of every host of ``pages`` (host, html, page_key).

    A host's deduction reads the tokens that half of its pages hold, at most two pages' worth.
    """
    seen = pages.select("host", "html", "page_key").mapInArrow(_occurrences, _TOKENS)
    sums = [F.sum(c).alias(c) for c in ("d1", "d2", "pages", "words", "headings")]
    firsts = [F.min(c).alias(c) for c in ("parent", "name", "aside")]
    seen = written(seen.groupBy("host", "path", "run").agg(*firsts, *sums))
    hosts = seen.where("path = 0 AND run IS NULL").select("host", F.col("pages").alias("n"))
    frequent = seen.join(hosts, "host").where("2 * pages >= n")
    return frequent.groupBy("host").applyInArrow(_deduced, "host string, main bigint, paths array<bigint>, runs array<bigint>")


def _extract(batches):
    for batch in batches:
        texts, made = [], {}
        for source, host, main, paths, runs in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "main", "paths", "runs"))):
            if host not in made:
                made[host] = Template(main, frozenset(paths or ()), frozenset(runs or ()))
            texts.append(extract(source or "", made[host]))
        yield pa.record_batch({
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    NULL and empty pages have an empty text and are no evidence. Pages without a host in their url share one template.
    A host of one page, or of copies of one page, has no template text. Rows without page_id are extracted; other columns are ignored; an empty table gives
    an empty table. Character references are decoded, white space inside a block becomes one space.
    """
    host, _ = host_and_path(F.col("url"))
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    keyed = pages.withColumn("page_key", F.xxhash64("page_id", "url", "html"))
    found = written(templates(keyed))  # its size is then known, and small ones are broadcast by Spark
    return pages.join(found, "host", "left").select("page_id", "url", "html", "host", "main", "paths", "runs").mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint")
