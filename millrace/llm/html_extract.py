"""Main text of web pages: containers are scored page by page, their paths voted on host by host, and pages read again by the winning paths."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import bound_batches, free_name, join_sized, lean_worker, materialize
from millrace.llm.url_filter import url_host

#: Share of a container's own text that a child must hold to stand for it; that an article must hold of its page.
TIGHT, ARTICLE = 0.6, 0.25
#: Share of a host's pages that must vote for a path; so a host has 20 at most.
VOTES = 0.05
#: Hosts whose paths are broadcast (20 numbers a host); beyond it pages meet them by host, large hosts dealt out.
HOSTS = 100_000

#: Fixed values of the language: elements without content, elements whose content is no markup, and elements that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li listing main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of an element closes, if it is open, and the elements that hide it.
_P_ENDS = BLOCK - frozenset("button caption legend optgroup option select tbody td tfoot th thead tr".split())
_CLOSES = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table td th".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset("dl table td th".split()))),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), frozenset({"table", "tr"}))),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_SCOPE = frozenset("caption table td th".split())

#: Elements and roles that are no part of an article.
ASIDE = frozenset("nav aside footer form button select fieldset dialog menu noscript template object svg canvas audio video map head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words that name such parts when a class or an id begins or ends with them.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses discussion feedback reactions guestbook".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promoted promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager masthead topbar header footer colophon sidebar sidebars widget widgets"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast announcement notification disclaimer newsletter subscribe subscription"
    " signup login form search searchform share sharing social related recommended recommendations skip copyright".split()
)
#: Words before such a word that say something of the page instead.
ABOUT = frozenset("with has no without".split())
ARTICLES = frozenset("article main".split())
STORY = frozenset("article post entry story content main".split())
#: Elements that can be the container of an article.
CONTAINER = frozenset("article main section div table tbody tr td center".split())

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<more>(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numbers of an article or its place in a list; a single digit tells columns apart.
_DIGITS = re.compile(r"\d\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _part(names: str) -> int:
    """Of a class or id attribute: 2 if it names reader comments, 1 another part that is no article, 0 otherwise."""
    found = 0
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words:
            continue
        if words[0] in COMMENTS or words[-1] in COMMENTS and words[0] not in ABOUT:
            return 2
        if words[0] in PARTS or words[-1] in PARTS and words[0] not in ABOUT:
            found = 1
    return found


class Page:
    """The elements of a page in order, its text runs, and which of them are no part of an article.

    A forgiving reading of the markup: comments, declarations and the content of scripts and styles are skipped, ends
    that are left out (of paragraphs, list items, cells and all that is open when an outer element ends) are
    supplied, and ends without a start are ignored. Nothing recurses, so depth does not matter.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.step, self.drop, self.names = [-1], ["body"], [""], [0], [""]
        self.runs: list[tuple[int, str] | None] = []
        stack, tags = [0], ["body"]
        runs, at, size, find = self.runs, 0, len(source), _TAG.search

        def close(down_to: int) -> None:
            for t in tags[down_to:]:
                if t in BLOCK:
                    runs.append(None)
                    break
            del stack[down_to:], tags[down_to:]

        def close_open(which: frozenset, hidden: frozenset) -> None:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in which:
                    close(k)
                    return
                if tags[k] in hidden:
                    return

        while at < size:
            met = find(source, at)
            text = source[at : met.start() if met else size]
            if text:
                if tags[-1] == "head" and not text.isspace():
                    close(len(tags) - 1)
                runs.append((stack[-1], text))
            if not met:
                break
            at = met.end()
            name = met["start"]
            if name is not None:
                name = name.lower()
                if name in ("html", "body"):
                    close_open(frozenset({"head"}), frozenset())
                    continue
                if "head" in tags and name not in HEAD:
                    close_open(frozenset({"head"}), frozenset())
                if name in _P_ENDS:
                    close_open(frozenset({"p"}), frozenset({"button", *_SCOPE}))
                if (ends := _CLOSES.get(name)) is not None:
                    close_open(*ends)
                if name in VOID:
                    if name in ("br", "hr"):
                        runs.append(None)
                    continue
                if name in BLOCK:
                    runs.append(None)
                self._open(name, met["more"], stack[-1], tags)
                stack.append(len(self.tag) - 1)
                tags.append(name)
                if name in RAW:
                    ended = _RAW_END[name].search(source, at)
                    at = ended.start() if ended else size
            elif (name := met["end"]) is not None:
                name = name.lower()
                if name in ("br", "p") and name not in tags:
                    runs.append(None)
                block = name in BLOCK
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == name:
                        close(k)
                        break
                    if tags[k] in _SCOPE if block and name not in _SCOPE and name not in ("tr", "tbody", "thead", "tfoot") else not block and tags[k] in BLOCK:
                        break
        self._mark()

    def _open(self, name: str, more: str, parent: int, tags: list[str]) -> None:
        step, drop, names, role = name, 3 if name in ASIDE else 0, "", ""
        if more and not more.isspace():
            found = {}
            for key, *values in _ATTRIBUTE.findall(more):
                found.setdefault(key.lower(), next((v for v in values if v), ""))
            classes, own = found.get("class", ""), found.get("id", "")
            names = f"{classes} {own}" if own else classes
            if names:
                step = ".".join([name, *sorted({_DIGITS.sub("0", c) for c in classes.split()})]) + (f"#{_DIGITS.sub('0', own)}" if own else "")
                drop = max(drop, _part(names))
            role = found.get("role", "").lower()
            if role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "style" in found and _HIDDEN.search(found["style"]):
                drop = 3
            if found.get("itemprop") == "comment" or found.get("itemtype", "").endswith("Comment"):
                drop = max(drop, 2)
            if role == "main" or found.get("itemprop") == "articleBody":
                names += " main"
        self.parent.append(parent)
        self.tag.append(name)
        self.step.append(step)
        self.drop.append(1 if name == "header" and not drop else drop)
        self.names.append(names)

    def _mark(self) -> None:
        """Sums text from the leaves up and settles, from the root down, what is no part of an article."""
        parent, tag, n = self.parent, self.tag, len(self.tag)
        holds = [False] * n  # an article or main element inside, that is not set aside itself
        for i in range(n - 1, 0, -1):
            if holds[i] or tag[i] in ARTICLES and not self.drop[i]:
                holds[parent[i]] = holds[parent[i]] or self.drop[i] < 2
        story, head = [False] * n, [False] * n
        self.gone = gone = [False] * n
        link = [False] * n
        for i in range(1, n):
            up, drop = parent[i], self.drop[i]
            words = _WORD.findall(self.names[i].lower()) if self.names[i] else ()
            story[i] = story[up] or tag[i] in ARTICLES or any(w in STORY for w in words) and not drop
            link[i] = link[up] or tag[i] == "a"
            if drop == 1 and holds[i]:
                drop = 0
            if drop == 1 and story[up] and (tag[i] == "header" or "header" in words):
                head[i], drop = True, 0  # the head of an article: its headings are the article's
            head[i] = head[i] or head[up]
            if tag[i] in HEADINGS and head[i] and not gone[up]:
                head[i] = False
            gone[i] = gone[up] or drop > 0
        self.silent = [g or h for g, h in zip(gone, head)]
        self.text = total = [0] * n
        for run in self.runs:
            if run is not None and not self.silent[run[0]] and not link[run[0]]:
                total[run[0]] += len(run[1].strip())
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]

    def best(self) -> int:
        """The container that stands for the article.

        The outermost article or main element of most text, if it has a quarter of the page's. Otherwise from the body
        down to the child container of most text, as long as it has three fifths of what its parent has and the parent has no heading.
        """
        parent, tag, total, gone = self.parent, self.tag, self.text, self.gone
        n, inside = len(tag), [False] * len(tag)
        for kind in ("article", "main"):
            found = []
            for i in range(1, n):
                own = tag[i] == kind or kind == "main" and self.names[i].endswith(" main")
                inside[i] = inside[parent[i]] or own
                if own and not gone[i] and not inside[parent[i]]:
                    found.append(i)
            if found and total[top := max(found, key=lambda i: (total[i], -i))] >= ARTICLE * total[0] and total[top]:
                return top
            inside = [False] * n
        children: dict[int, list[int]] = {}
        headed = set()
        for i in range(1, n):
            if not gone[i]:
                if tag[i] in CONTAINER:
                    children.setdefault(parent[i], []).append(i)
                elif tag[i] in ("h1", "h2"):
                    headed.add(parent[i])
        at = 0
        while (own := children.get(at)) and total[at]:
            top = max(own, key=lambda i: (total[i], -i))
            if total[top] < TIGHT * total[at] or at and at in headed:
                break
            at = top
        return at

    def path(self, i: int) -> str:
        steps = []
        while i > 0:
            steps.append(self.step[i])
            i = self.parent[i]
        return "/".join(["body", *reversed(steps)])

    def at_path(self, paths: Sequence[int]) -> list[int]:
        """The containers of the first of some path numbers that the page has. Where the last step names neither class,
        id nor article, that is the one of most text."""
        wanted, ids, found = {p: k for k, p in enumerate(paths)}, [path_id("body")] * len(self.tag), {}
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            ids[i] = path_id(self.step[i], ids[up])
            if self.tag[i] in CONTAINER and not self.gone[i] and ids[i] in wanted:
                found.setdefault(wanted[ids[i]], []).append(i)
        if not found:
            return []
        first = found[min(found)]
        bare = self.step[first[0]] == self.tag[first[0]] not in ARTICLES
        return [max(first, key=lambda i: (self.text[i], -i))] if bare else first

    def told(self, containers: Sequence[int]) -> str:
        """The text of containers, in page order: a space between blocks, white space as one space, references decoded."""
        inside = [False] * len(self.tag)
        for i in containers:
            inside[i] = True
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        out = []
        for run in self.runs:
            if run is None:
                out.append(" ")
            elif inside[run[0]] and not self.silent[run[0]]:
                out.append(html.unescape(run[1]) if "&" in run[1] else run[1])
        return " ".join("".join(out).split())


def path_id(step: str, above: int = 0) -> int:
    """A number of a path, from its last step and the number of what is above."""
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), above & ((1 << 64) - 1)) - (1 << 63)


def number_of(page: Page, i: int) -> int:
    steps = []
    while i > 0:
        steps.append(page.step[i])
        i = page.parent[i]
    number = path_id("body")
    for step in reversed(steps):
        number = path_id(step, number)
    return number


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, html) to (host, path_id, path, share): the best container of each page that has text in one."""
    lean_worker()
    for batch in batches:
        hosts, ids, paths, shares = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py() or "")
            if i := page.best():
                hosts.append(host)
                ids.append(number_of(page, i))
                paths.append(page.path(i))
                shares.append(page.text[i] / page.text[0])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path_id", "path", "share"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", votes: float = VOTES) -> DataFrame:
    """The winning paths: (host, path_id, path, votes, share, place), those that a twentieth of a host's voting pages or more are for.

    A path is the tags of a container and of all around it, with their classes and id; runs of two digits or more are one 0. Every
    page votes for that of its best container (``Page.best``), whose score is its share of the page's own text, without links and parts
    that are no article. Places go by votes, then the mean score, then the number of the path. Pages without a host have no say.
    """
    bound_batches(pages.sparkSession)
    named = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> ''")
    cast = named.mapInArrow(_vote, "host string, path_id long, path string, share double")
    counted = materialize(cast.groupBy("host", "path_id").agg(F.min("path").alias("path"), F.count("*").alias("votes"), F.avg("share").alias("share")), "html-votes")
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("share", 9)), "path_id")
    placed = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(1 / votes))
    total = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    return placed.join(total, "host").where(F.col("votes") >= F.col("all") * votes).drop("all")


_ADDED = {"main_text": T.StringType(), "main_path": T.StringType(), "by_host": T.BooleanType()}


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", hosts: int = HOSTS) -> DataFrame:
    """Adds the main text of every page: ``main_text``, ``main_path`` (where it stood) and ``by_host`` (whether a path of the host found it).

    A page is read by the first winning path of its host that it has (``host_paths``); pages that have none, and pages
    without a host, by their own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    comments and hidden parts inside it are left out, by element, role, class or id; of the header of an article its
    headings stay. Character references are decoded, white space (as ``str.split`` has it) inside a block becomes one
    space, and blocks are joined in page order by one space. Elements inside a line separate nothing; a line break does.

    Hosts' paths are broadcast if there are ``hosts`` at most; otherwise pages meet them by host, large hosts dealt out.

    Cases: null and empty pages have the text '' and the path ``body``; null urls, and urls without a host, vote for nothing; broken markup
    is read as far as it goes; columns of the added names are replaced, other columns, repeated rows and empty tables pass as they are.
    """
    bound_batches(pages.sparkSession)
    pages = pages.drop(*_ADDED)
    host, paths = free_name(pages, "host"), free_name(pages, "host_paths")
    won = host_paths(pages, url_col, html_col)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "path_id"))), lambda p: p["path_id"])
    size = materialize(pages.select(url_host(F.col(url_col)).alias(host)).groupBy(host).agg(F.count("*").alias("n")), "html-hosts")
    known = materialize(won.groupBy(F.col("host").alias(host)).agg(ids.alias(paths)).join(size, host), "html-paths")
    named = pages.withColumn(host, url_host(F.col(url_col)))
    if known.limit(hosts + 1).count() <= hosts:
        met = named.join(F.broadcast(known.drop("n")), host, "left")
    else:
        met = join_sized(named, known, host, how="left")
    met = met.select(*pages.columns, paths)
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            texts, told, voted = [], [], []
            for source, wanted in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist()):
                page = Page(source.as_py() or "")
                found = page.at_path(wanted) if wanted else []
                voted.append(bool(found))
                found = found or [page.best()]
                texts.append(page.told(found))
                told.append(page.path(found[0]))
            added = [pa.array(texts, pa.string()), pa.array(told, pa.string()), pa.array(voted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *_ADDED])

    return met.mapInArrow(run, T.StructType([*pages.schema.fields, *(T.StructField(n, k) for n, k in _ADDED.items())]))
