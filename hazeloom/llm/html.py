"""HTML extraction: pages of a host vote on the path of their main container, then all are extracted with it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut
from hazeloom.llm.urls import url_host

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Elements that a slash at the end of the start tag closes.
FOREIGN = frozenset("svg math path g circle rect line polygon polyline ellipse use defs stop mi mo mn mtext mspace mrow".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body".split())
#: Elements that are never main text.
SKIP = frozenset("head script style textarea title noscript iframe noembed noframes template svg annotation annotation-xml nav header footer aside form button select menu dialog".split())
#: What a class, id or role says an element is: its last word, after words that only say that it is a part of the page.
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter pagination popup promo promoted sidebar signup social sponsor sponsored subscribe".split()
)
#: Words that page builders and authors use for text as well: they count for elements that are mostly links, as a role, or after one of the words above.
USED_WORDS = frozenset("notice notices related search share sharing widget".split())
NOTICES = frozenset("notice notices".split())
COMMENTS = frozenset("comment comments disqus".split())
PART_WORDS = frozenset(
    "area articles bar block body box button buttons col container content form group holder inner item items link links list outer panel posts row section slot stories text thread unit wrap wrapper".split()
)
#: A header of these is the head of the text, not of the page.
TEXT_WORDS = frozenset("article chapter content entry post section story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group others, whose ids name them.
GROUPS = frozenset("article aside center details div dl fieldset figure li main ol section span table tbody td tr ul".split())
#: What a start tag closes if it is open: (open element, at most up to).
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The attributes and the end of a tag, where they are written well.
PLAIN = re.compile(r"((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++))?+)*+)\s*+(/?)>")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(=?[^\s/>=]*+)(\s*+=\s*+)?+)?+")
MARK = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
COMMENT_END = re.compile(r"--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>|\Z", re.I) for t in RAW}
HUMP = re.compile(r"([a-z])([A-Z])")


#: What an element's names come to: nothing, no main text, no main text where it is mostly links, a notice, no main text unless its id is that of its own heading.
NOTHING, SKIPPED, IF_LINKS, NOTICE, ANCHOR = range(5)


def last_words(name: str) -> list[str]:
    """The words of a class, id or role, without those at the end that only say that it is a part of the page."""
    words = re.findall(r"[a-z]+", HUMP.sub(r"\1-\2", name).lower())
    while len(words) > 1 and words[-1] in PART_WORDS:
        words.pop()
    return words


@lru_cache(100_000)
def says(tag: str, classes: str, roles: str, ids: str) -> tuple[int, bool]:
    """(what the names say that an element is, whether that is readers' comments).

    Ids count on containers only: on headings and paragraphs they are places to link to.
    """
    found, comments = NOTHING, False
    for kind, names in (("role", roles), ("class", classes), ("id", ids if tag in GROUPS else "")):
        for name in names.split():
            words = last_words(name)
            last = words[-1] if words else ""
            if last == "header" and (tag in HEADINGS or TEXT_WORDS & set(words[:-1])):
                continue
            if last in SKIP_WORDS or (last in USED_WORDS and (kind == "role" or SKIP_WORDS & set(words[:-1]))):
                now = SKIPPED if kind != "id" else ANCHOR
            elif last in USED_WORDS:
                now = NOTICE if last in NOTICES and kind == "class" else IF_LINKS
            else:
                continue
            comments |= last in COMMENTS
            found = now if found == NOTHING or now == SKIPPED else found
    return found, comments


def tag_end(html: str, at: int) -> tuple[str, str, bool]:
    """(end, class, id and role, whether a slash closes it) of the tag whose name ends at ``at``, by HTML's rules for attributes.

    A quoted value without its second quote counts as unquoted. A tag that nothing closes is left out (end 0).
    """
    marks, closed, n = [], False, len(html)
    while at < n:
        m = ATTRIBUTE.match(html, at)
        closed = m.end() > at and html[m.end() - 1] == "/"
        at, value = m.end(), ""
        if at < n and m[2]:
            quote = html[at]
            to = html.find(quote, at + 1) if quote in "\"'" else -1
            if to >= 0:
                value, at = html[at + 1 : to], to + 1
            else:
                start = at
                while at < n and html[at] != ">" and not html[at].isspace():
                    at += 1
                value = html[start:at]
        if m[1] and m[1].lower() in ("class", "id", "role"):
            marks.append((m[1].lower(), value))
        if at < n and html[at] == ">":
            return at + 1, marks, closed
    return 0, marks, closed


class Page:
    """A page's blocks of text and the containers around them.

    Containers are numbered from 0, the whole page, parents before children; each has its
    tag, its parent and the number of its generalised path: the tags and first classes of the
    containers around, digits as #. Every start and end tag is handled in constant time.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path = [""], [-1], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.raw_blocks: list[tuple[list[tuple[str, int, bool]], int, str]] = []
        #: Of each marked element: the marked one around it, what it is, if it is comments, its id, its names, whether inside an article or main.
        self.marks: list[tuple[int, int, bool, str, tuple, bool]] = [(0, NOTHING, False, "", (), False)]
        self.holds = [False]
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        # An open element: tag, skip, in a link, mark, container.
        stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]
        open_at: dict[str, list[int]] = defaultdict(list)
        blocks_at = [0]
        parts: list[tuple[str, int, bool]] = []
        last = html.rfind(">")

        def flush() -> None:
            if parts:
                self.raw_blocks.append((parts.copy(), stack[-1][4], stack[blocks_at[-1]][0]))
                parts.clear()

        def add(raw: str) -> None:
            _, skip, link, mark, _ = stack[-1]
            if raw and not skip:
                parts.append((unescape(raw) if "&" in raw else raw, mark, link))

        def close(to: int) -> None:
            if blocks_at[-1] >= to:
                flush()
            while len(stack) > to:
                tag = stack.pop()[0]
                open_at[tag].pop()
                if blocks_at[-1] == len(stack):
                    blocks_at.pop()

        def newest(tags: list[str]) -> int:
            return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

        at = 0
        while True:
            here = html.find("<", at)
            if here < 0 or (here > last and not html.startswith("<!--", here)):
                add(html[at:])
                break
            name = NAME.match(html, here) if here < last else None
            if not name:
                if html.startswith("<!--", here):
                    add(html[at:here])
                    end = COMMENT_END.search(html, here + 2)
                    at = end.end() if end else len(html)
                elif html[here + 1 : here + 2] in ("!", "?", "/"):
                    add(html[at:here])
                    at = html.find(">", here) + 1
                else:
                    add(html[at : here + 1])
                    at = here + 1
                continue
            add(html[at:here])
            tag = name[2].lower()
            plain = PLAIN.match(html, name.end())
            if plain:
                at, closed = plain.end(), bool(plain[2])
                marks = [(k.lower(), a or b or c) for k, a, b, c in MARK.findall(plain[1])] if plain[1] else []
            else:
                end, marks, closed = tag_end(html, name.end())
                at = end or html.find(">", here) + 1
            if name[1]:
                i = open_at[tag][-1] if open_at[tag] else 0
                if i and (tag in BLOCK or i > blocks_at[-1]):
                    close(i)
                continue
            if tag in BLOCK:
                if stack[blocks_at[-1]][0] == "p":  # a paragraph ends where a block begins
                    close(blocks_at[-1])
                flush()
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                i = newest(ends)
                if i > newest(within):
                    close(i)
            if tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            if tag in RAW:
                at = RAW_END[tag].search(html, at).end()
                continue
            _, skip, link, mark, container = stack[-1]
            skip = skip or tag in SKIP
            if tag in ("article", "main"):
                self._holds_text(mark)
            elif marks and tag not in ("html", "body"):
                names = tuple(" ".join(v for k, v in marks if k == kind) for kind in ("class", "role", "id"))
                what, comments = says(tag, *names)
                if what:
                    inside = bool(open_at["article"] or open_at["main"])
                    self.marks.append((mark, what, comments, names[2], (tag, *names[:2], re.sub(r"\d+", "#", names[2])), inside))
                    self.holds.append(False)
                    mark = len(self.marks) - 1
            if tag in CONTAINER:
                first = next((v.split() for k, v in marks if k == "class"), [])[:1]
                step = re.sub(r"\d+", "#", ".".join([tag, *first])).replace(">", "")
                key = (self.path[container], step)
                if key not in self.paths:
                    self.paths[key] = len(self.steps)
                    self.steps.append(key)
                self.tag.append(tag)
                self.parent.append(container)
                self.path.append(self.paths[key])
                container = len(self.tag) - 1
            if not (closed and tag in FOREIGN):
                open_at[tag].append(len(stack))
                if tag in BLOCK:
                    blocks_at.append(len(stack))
                stack.append((tag, skip, link or tag == "a", mark, container))
        flush()

    def _holds_text(self, mark: int) -> None:
        while mark and not self.holds[mark]:
            self.holds[mark] = True
            mark = self.marks[mark][0]

    def _settle(self) -> None:
        """Blocks without the elements that their names mark as no main text.

        A mark does not count where the element holds an `article` or `main`, or where all elements of its
        names hold more than half of the page's characters outside links. Names that are used for text as
        well count where more than half of the element is links; a notice also where it
        is outside of an `article` or `main`. An id does not count where the element begins with a heading
        of the same words, unless elements in it are marked as comments.
        """
        n = len(self.marks)
        weight, links = [0] * n, [0] * n
        first: list[tuple[str, str] | None] = [None] * n
        for parts, _, tag in self.raw_blocks:
            for raw, mark, link in parts:
                if link:
                    links[mark] += len(raw)
                else:
                    weight[mark] += len(raw)
            text, mark = "".join(raw for raw, _, _ in parts), parts[0][1]
            while mark and first[mark] is None and not text.isspace():
                first[mark] = (tag, text)
                mark = self.marks[mark][0]
        total = sum(weight)
        answered = [False] * n
        for i in range(n - 1, 0, -1):
            up = self.marks[i][0]
            weight[up] += weight[i]
            links[up] += links[i]
            answered[up] |= answered[i] or (self.marks[i][2] and self.marks[i][1] == SKIPPED)
        alike: dict[tuple, int] = defaultdict(int)
        for i in range(1, n):
            if self.marks[self.marks[i][0]][4] != self.marks[i][4]:  # one inside another of its names counts once
                alike[self.marks[i][4]] += weight[i]
        gone = [False] * n
        for i in range(1, n):
            up, what, _, own_id, names, inside = self.marks[i]
            if what == ANCHOR and not answered[i] and first[i] and first[i][0] in HEADINGS and words_of_anchor(first[i][1]) == words_of_anchor(own_id):
                what = NOTHING
            elif what == NOTICE and not inside:
                what = SKIPPED
            if what in (IF_LINKS, NOTICE):
                what = SKIPPED if links[i] > weight[i] else NOTHING
            gone[i] = gone[up] or (what != NOTHING and not self.holds[i] and 2 * max(weight[i], alike[names]) <= total)
        #: (text, characters in links, container)
        self.blocks: list[tuple[str, int, int]] = []
        for parts, container, _ in self.raw_blocks:
            kept = [(raw, link) for raw, mark, link in parts if not gone[mark]]
            if words := " ".join("".join(raw for raw, _ in kept).split()):
                self.blocks.append((words, sum(len(raw) for raw, link in kept if link), container))
        self.raw_blocks = []

    def path_name(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self.steps[path]
            steps.append(step)
        return ">".join(reversed(steps))

    def path_number(self, name: str) -> int:
        """The number of a generalised path, -1 if the page has none such."""
        at = 0
        for step in name.split(">"):
            at = self.paths.get((at, step), -1)
            if at < 0:
                break
        return at

    def scores(self) -> list[int]:
        """The characters of each container's blocks, those inside links counting against them twice."""
        score = [0] * len(self.tag)
        for text, linked, container in self.blocks:
            score[container] += own_score(text, linked)
        for i in range(len(score) - 1, 0, -1):
            score[self.parent[i]] += score[i]
        return score

    def best(self) -> tuple[str, int] | None:
        """Path and score of the main container; None if only the whole page holds its text.

        The main `article` is chosen if containers with three quarters of the score lead to
        one. Else the choice goes from the whole page inward as long as no block that scores is
        left out, except that a `div` next to one with three quarters of the score may be where
        both are parts of the page's frame (in the body or in no container).
        """
        score = self.scores()
        inner: list[list[int]] = [[] for _ in score]
        for i in range(1, len(score)):
            inner[self.parent[i]].append(i)
        here = 0
        while inner[here] and self.tag[here] != "article":
            most = max(inner[here], key=lambda i: (score[i], -i))
            if here and score[most] < 0.75 * score[here]:
                break
            here = most
        if self.tag[here] == "article":
            return self.path_name(self.path[here]), score[here]
        group, path, tag, total = [0], 0, "body", score[0]
        own = [0] * len(score)
        for text, linked, container in self.blocks:
            own[container] += own_score(text, linked)
        while True:
            by_path: dict[int, list[int]] = defaultdict(list)
            for i in group:
                for child in inner[i]:
                    if score[child]:
                        by_path[self.path[child]].append(child)
            if not by_path:
                break
            sums = {p: sum(score[i] for i in children) for p, children in by_path.items()}
            most = max(sums, key=lambda p: (sums[p], -p))
            beside = [self.tag[children[0]] for p, children in by_path.items() if p != most]
            bare = any(own[i] for i in group)
            if (beside or bare) and not (tag == "body" and not bare and sums[most] >= 0.75 * total and all(t == "div" for t in beside)):
                break
            group, path, tag, total = by_path[most], most, self.tag[by_path[most][0]], sums[most]
        return (self.path_name(path), total) if path else None

    def main_text(self, path: str | None) -> str:
        """The blocks inside containers of the path, or of the page's own if it has none such; all blocks without containers."""
        number = self.path_number(path) if path is not None else -1
        if number < 0:
            own = self.best()
            if own is None:
                return "\n".join(text for text, _, _ in self.blocks)
            number = self.path_number(own[0])
        inside = [False] * len(self.tag)
        for i in range(1, len(inside)):
            inside[i] = inside[self.parent[i]] or self.path[i] == number
        return "\n".join(text for text, _, container in self.blocks if inside[container])


def words_of_anchor(name: str) -> list[str]:
    """The words of a heading, without a number like `2.` or `2.1` before them, or of the id made from it."""
    return re.findall(r"[^\W_]+", re.sub(r"^\s*(?:\d+\.)+\d*(?=\s)", "", name).lower())


def own_score(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def extract_pages(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_hosts: int = 100_000,
    salts: int = 16,
) -> DataFrame:
    """page_id, url, text, n_chars per page row.

    Each page votes for its container's path with the container's score; votes are added up
    by (host, path), in every task first, and the path with most wins its host (the first by
    name on ties). Then pages are extracted with their host's path; a page without such a
    container uses its own. Paths are broadcast to the pages only for up to
    ``broadcast_hosts`` hosts; beyond, the join is shuffled with every host in ``salts`` parts.

    Null, empty and textless pages have an empty text. Pages without a host vote as one.
    Repeated rows keep a row each; null ids stay null; empty tables give no rows; other columns
    are not read. Pages are read in time proportional to their length, however long or deep.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    votes_schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if html.is_valid and (best := Page(html.as_py()).best()):
                    sums[host, best[0]] += best[1]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.float64())], schema=votes_schema)

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, score double")
    winners = (
        votes.groupBy("host", "path")
        .agg(F.sum("score").alias("score"))
        .groupBy("host")
        .agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"))
    )
    winners = cut(winners)
    won = winners.select(F.col("host").alias("w_host"), "path")
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(won), F.col("host") == F.col("w_host"), "left")
    else:
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(
            won.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), (F.col("host") == F.col("w_host")) & (F.col("salt") == F.col("w_salt")), "left"
        )
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py()).main_text(p) if h.is_valid else "" for h, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
