"""Main text of web pages by consensus container paths of their host.

1. Each page is read into blocks of text, each with the path of its containers:
   tags with their first class, digits generalised.
2. Each page scores its containers by the text in them, less its links, and votes
   with the shares. Votes are added up by host and path on Spark.
3. The winning path is climbed to the container of the whole article: the outermost
   article or else main on it, or else the highest container below the body that
   adds text other than links on that host. If that is no article or main, the other
   containers beside it that hold ``SHARE`` of a page's text on most pages are joined.
4. Each page is extracted again from everything under these paths; a page that has
   less than ``LEAST`` of its text there climbs from its own best one. A page's last
   main heading before its article belongs to it if the article has none.

Menus, headers, footers, sidebars, forms, scripts, styles and reader comments are
left out wherever they stand, by tag, role or name. What only its class or id calls a
notice, advert, menu or the like is left out of an article if the evidence agrees:
its text is short, or mostly links, or repeats on the host. Such text is counted by
host and hash in the votes; it repeats if it is on two different pages and on
``REPEATS`` of the host's pages, so a host has at most 1 / ``REPEATS`` times as many
hashes as a page has such containers on average, and they travel with its paths.

Nulls: a null page has no text; a null or odd address is a host of its own kind
(the empty host). Repeated rows vote and are returned one by one. Pages may end
inside a tag or comment, and elements may stay open to any number: containers
deeper than ``DEPTH`` count as their ancestor there, as browsers flatten them too.
An end tag that is looked for in vain is not looked for again, so reading takes time
in proportion to the page. An empty table gives no rows. Extra columns are passed by.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import slices

RESULT = "page_id long, url string, text string, n_chars long"
#: Paths and hashes of all hosts up to which they are broadcast (about 100 bytes each); beyond that they are joined by a shuffle.
BROADCAST_HOSTS = 100_000

# Element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
MATH = frozenset(
    "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics".split()
)
INLINE |= MATH
RAW = frozenset("script style textarea title noscript template svg annotation annotation-xml iframe object select canvas".split())
#: Of these, the ones that reach to the end of the page if they aren't ended; of the others the tag alone is left out then.
TO_THE_END = frozenset("script style textarea title".split())
LEFT_OUT = frozenset("nav header footer aside form button dialog menu head".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th figcaption caption".split())
#: A start tag that ends an open element of these names.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|footer|side-?bar|aside|widget\w*|"
    r"cookies?\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|newsletter|subscri\w*|share|sharing|social\w*|related|recommend\w*)(?=$|[-_\s])",
    re.I,
)
#: Names of reader comments, which are always left out, as whole words.
COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|respond|repl(?:y|ies))(?=$|[-_\s])", re.I)
#: A class or id that is one of these words and no more is left out wherever it stands.
FIRM = re.compile(r"nav(?:bar|igation)?|menu|footer|side-?bar|breadcrumbs?", re.I)
#: Characters under which a named container is short: a class or id that is the name itself, or one that only holds it.
SHORT, SHORT_PART = 400, 40
#: Share of the host's pages on which text must stand to repeat, share of a page's text that makes a container part of it, least share of a page's text under the host's paths.
REPEATS, SHARE, LEAST = 0.01, 0.05, 0.05
#: Names that are left out of a page but not of an article, whose own header holds its title.
HEADERS = re.compile(r"(?:^|[-_\s])(?:header|masthead)(?=$|[-_\s])", re.I)
#: Quotes count after an equals sign alone: an apostrophe elsewhere in a tag is a letter like others.
_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)|([^<]+|<)", re.S)
#: The end of an empty tag's attributes; a slash that ends an unquoted value is not one.
_EMPTY = re.compile(r"(?<!=)(?:^|[\s\"'])/\Z|(?:^|\s)[^\s=\"'/]+/\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
#: Nested containers that are told apart, and characters of a class name.
DEPTH = 256
CLASS_LENGTH = 60


class Block:
    """Text between block boundaries: ``path`` of its containers, how much of it is links, the named container that it is in (0: none; below 0: the class or id is the name itself), and whether it is a main heading."""

    __slots__ = ("heading", "links", "named", "path", "text")

    def __init__(self, text: str, path: str, links: int, named: int = 0, heading: bool = False):
        self.text, self.path, self.links, self.named, self.heading = text, path, links, named, heading


class _Open:
    """An open element: ``path`` of its containers, whether it is left out, the named container that it is or is in, and whether an end tag has met it already."""

    __slots__ = ("closed", "depth", "left_out", "name", "named", "path")

    def __init__(self, name: str, path: str, depth: int, left_out: bool, named: int):
        self.name, self.path, self.depth, self.left_out, self.named, self.closed = name, path, depth, left_out, named, False


class _Page:
    """The state of reading a page: open elements, found by name and by place, and the text since the last boundary."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.outer: list[int] = []  # places of the open elements that aren't inline
        self.text: list[str] = []
        self.links = self.hidden = self.numbered = 0

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                last = self.open[-1] if self.open else None
                self.found.append(Block(words, last.path if last else "", self.links, last.named if last else 0, bool(self.places.get("h1"))))
            self.text.clear()
        self.links = 0

    def say(self, piece: str) -> None:
        if not self.hidden:
            self.text.append(piece)
            if self.places.get("a"):
                self.links += len(piece)

    def end(self, element: _Open) -> None:
        """Take an element's effect away once."""
        if not element.closed:
            element.closed = True
            self.hidden -= element.left_out
            self.places[element.name].pop()

    def close(self, place: int) -> None:
        """End all elements from this place on."""
        while len(self.open) > place:
            self.end(self.open.pop())
        while self.outer and self.outer[-1] >= place:
            self.outer.pop()

    def ended(self, name: str) -> None:
        """An end tag: of the last open element of its name, if there is one."""
        places = self.places.get(name)
        if not places:
            return
        if name not in INLINE:
            self.flush()
            self.close(places[-1])
        elif places[-1] == len(self.open) - 1:
            self.close(places[-1])
        else:  # an inline end inside other elements ends itself alone
            self.end(self.open[places[-1]])

    def start(self, name: str, attributes: str) -> None:
        """A start tag."""
        names = role = ""
        if attributes.strip():
            for key, *values in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key == "role":
                    role = "".join(values).lower()
                elif key in ("class", "id"):
                    names = f"{names} {''.join(values)}"
        if name not in INLINE:
            self.flush()
            if name not in ("html", "body"):
                ended = ENDS.get(name, {"p"})
                while self.outer and self.open[self.outer[-1]].name in ended:
                    self.close(self.outer[-1])
        in_article = bool(self.places.get("article"))
        left_out = name in LEFT_OUT and not (name == "header" and in_article) or role in ROLES
        above = self.open[-1] if self.open else None
        named = above.named if above else 0
        if names and name not in ("html", "body", "article", "main"):
            left_out = left_out or bool(COMMENTS.search(names)) or any(map(FIRM.fullmatch, names.split())) or not in_article and bool(HEADERS.search(names))
            if not named and NAMES.search(names):
                self.numbered += 1
                whole = any((m := NAMES.match(x)) and m.end() == len(x) for x in names.split())
                named = -self.numbered if whole else self.numbered
        path, depth = (above.path, above.depth) if above else ("", 0)
        if name not in INLINE and name not in LEAVES and depth < DEPTH:
            first = names.split()[:1]
            label = name + ("." + re.sub(r"[\d>]+", "#", first[0][:CLASS_LENGTH]) if first else "")
            path, depth = f"{path}>{label}" if path else label, depth + 1
        place = len(self.open)
        self.open.append(_Open(name, path, depth, left_out, named))
        self.places.setdefault(name, []).append(place)
        if name not in INLINE:
            self.outer.append(place)
        self.hidden += left_out


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without what is left out."""
    state = _Page()
    at, size = 0, len(page)
    unended: set[str] = set()  # names without a further end tag
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            if not state.hidden:
                state.say(entities.unescape(m[4]))
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            state.ended(name)
        elif name in VOID:
            if name == "hr":
                state.flush()
            else:
                state.say(" ")
        elif (name in MATH or name in ("svg", "annotation", "annotation-xml")) and _EMPTY.search(m[3]):
            continue
        elif name in RAW:
            end = None if name in unended else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not end:
                unended.add(name)
            at = end.end() if end else size if name in TO_THE_END else at
        else:
            state.start(name, m[3])
            if not m[0].endswith(">"):
                break
    state.flush()
    return state.found


def container_scores(found: list[Block]) -> dict[str, float]:
    """Shares of the page's text by container: all for the nearest one, half for the next, links taken off."""
    scores: dict[str, float] = {}
    for block in found:
        if block.named:
            continue
        weight = max(len(block.text) - 2 * block.links, 0)
        path, share = block.path, 1.0
        for _ in range(2):
            scores[path] = scores.get(path, 0.0) + weight * share
            if ">" not in path:
                break
            path, share = path.rpartition(">")[0], share / 2
    total = sum(scores.values())
    return {k: v / total for k, v in scores.items()} if total else {}


def article_path(path: str) -> str | None:
    """The outermost article on a path, or else its outermost main."""
    labels = path.split(">")
    for name in ("article", "main"):
        for i, label in enumerate(labels):
            if label.partition(".")[0] == name:
                return ">".join(labels[: i + 1])
    return None


def above(path: str, other: str) -> str | None:
    """The nearest container below the body that holds both paths."""
    labels: list[str] = []
    for a, b in zip(path.split(">"), other.split(">"), strict=False):
        if a != b:
            break
        labels.append(a)
    return ">".join(labels) if labels and labels[-1].partition(".")[0] not in ("", "html", "body") else None


def climbed(path: str, others: Iterable[str]) -> str:
    """The container of the whole article around ``path``; ``others`` are paths with text other than links."""
    return article_path(path) or min((x for o in others if (x := above(path, o)) is not None), key=len, default=path)


def beside(path: str) -> str | None:
    """The container just below the body that a path is or is in; none if there is no body or an article or main holds it."""
    labels = path.split(">")
    for i, label in enumerate(labels[:-1]):
        if label.partition(".")[0] == "body":
            return None if article_path(path) else ">".join(labels[: i + 2])
    return None


def block_hash(block: Block) -> int:
    """64 bits of a block's text."""
    return int.from_bytes(hashlib.blake2b(block.text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def named_groups(found: list[Block]) -> dict[int, list[Block]]:
    """Blocks by the named container they are in."""
    out: dict[int, list[Block]] = {}
    for block in found:
        if block.named:
            out.setdefault(block.named, []).append(block)
    return out


def plainly_out(named: int, group: list[Block]) -> bool:
    """Whether a named container goes by itself: its text is short or mostly links."""
    size = sum(len(b.text) for b in group)
    return size < (SHORT if named < 0 else SHORT_PART) or 2 * sum(b.links for b in group) > size


def kept_blocks(found: list[Block], repeated: frozenset[int]) -> list[Block]:
    """The blocks without named containers that are short, mostly links or mostly repeated on the host."""
    out = set()
    for named, group in named_groups(found).items():
        again = sum(len(b.text) for b in group if block_hash(b) in repeated) if repeated else 0
        if plainly_out(named, group) or 2 * again > sum(len(b.text) for b in group):
            out.add(named)
    return [b for b in found if b.named not in out]


def under(block: Block, paths: Iterable[str]) -> bool:
    """Whether a block lies under one of some paths."""
    return any(block.path == p or block.path.startswith(f"{p}>") for p in paths)


def extracted(found: list[Block], winners: Iterable[str] | None, repeated: frozenset[int] = frozenset()) -> str:
    """Blocks under the host's paths, or under the page's own best one if they hold little of the page."""
    found = kept_blocks(found, repeated)
    inside = [i for i, b in enumerate(found) if winners and under(b, winners)]
    weight = lambda some: sum(max(len(b.text) - 2 * b.links, 0) for b in some)
    if not inside or weight(found[i] for i in inside) < LEAST * weight(found):
        own = container_scores(found)
        if own:
            best = min(own, key=lambda k: (-own[k], k))
            best = climbed(best, {b.path for b in found if len(b.text) > 2 * b.links and not b.named})
            inside = [i for i, b in enumerate(found) if under(b, [best])]
    if inside and not any(found[i].heading for i in inside):
        inside = [*[i for i in range(inside[0]) if found[i].heading][-1:], *inside]
    return "\n\n".join(found[i].text for i in inside)


def host(url: Column) -> Column:
    """Lower-cased host of an address, without its port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score, held, wide, pages) summed over pages, and the same table's rows of named text: (host, hash, pages, first, last).

    ``held`` tells whether the container itself has text other than links, ``wide`` counts the pages of which it holds
    ``SHARE`` just below the body, ``first`` and ``last`` are hashes of pages with the text.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            total: dict[tuple[str, str], list] = {}
            named: dict[tuple[str, int], list] = {}
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = blocks(page or "")
                whole, tops = 0, {}
                for b in found:
                    if not b.named:
                        weight = max(len(b.text) - 2 * b.links, 0)
                        whole += weight
                        if top := beside(b.path):
                            tops[top] = tops.get(top, 0) + weight
                at = lambda path: total.setdefault((name, path), [0.0, False, 0, 0])  # noqa: B023, E731
                for path, share in container_scores(found).items():
                    at(path)[0] += share
                for b in found:
                    if len(b.text) > 2 * b.links and not b.named:
                        at(b.path)[1] = True
                for top, weight in tops.items():
                    at(top)[2] += weight >= SHARE * whole > 0
                at("")[3] += 1
                own = hash_of_page(page or "")
                for h in {block_hash(b) for n, group in named_groups(found).items() if not plainly_out(n, group) for b in group}:
                    seen = named.setdefault((name, h), [0, own, own])
                    seen[:] = seen[0] + 1, min(seen[1], own), max(seen[2], own)
            rows = [(*k, None, *v, None, None) for k, v in total.items()] + [(k[0], None, k[1], 0.0, False, 0, *v) for k, v in named.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(VOTES.names, r, strict=True)) for r in rows], schema=VOTES)

    scored = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(score, "host string, path string, hash long, score double, held boolean, wide long, pages long, first long, last long")
    return scored.groupBy("host", "path", "hash").agg(F.sum("score").alias("score"), F.bool_or("held").alias("held"), F.sum("wide").alias("wide"), F.sum("pages").alias("pages"), F.min("first").alias("first"), F.max("last").alias("last"))


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("hash", pa.int64()), ("score", pa.float64()), ("held", pa.bool_()), ("wide", pa.int64()), ("pages", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def hash_of_page(page: str) -> int:
    """64 bits of a page."""
    return int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths, repeated): the containers of the article, and hashes of named text that repeats on the host.

    The winning path, climbed, comes first; equal scores go to the first path by name.
    """
    every = written(votes(pages), "host-votes")
    found = every.where("path IS NOT NULL")
    size = found.where("path = ''").select("host", F.col("pages").alias("of"))
    best = found.where("score > 0").groupBy("host").agg(F.min_by("path", F.struct(-F.round("score", 6), F.col("path"))).alias("best"))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [climbed(b, [p]) for b, p in zip(batch.column("best").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(top, pa.string())], names=["host", "path"])

    # Each path with text gives the container it shares with the winner; the highest holds them all.
    tops = found.where("held").join(best, "host").select("host", "best", "path").mapInArrow(climb, "host string, path string")
    first = tops.groupBy("host").agg(F.min_by("path", F.length("path")).alias("path"))
    # Beside a winner just below the body: what is wide on most pages, so at most 2 / SHARE containers a host.
    wide = found.join(size, "host").where(F.col("wide") * 2 > F.col("of")).groupBy("host").agg(F.collect_set("path").alias("wide"))
    # No more than 1 / REPEATS times the named blocks of a page.
    named = every.where("hash IS NOT NULL AND first <> last").join(size, "host").where(F.col("pages") >= REPEATS * F.col("of")).groupBy("host").agg(F.collect_set("hash").alias("repeated"))
    return first.join(wide, "host", "left").join(named, "host", "left").select("host", "path", "wide", "repeated")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    winners = written(consensus(pages), "host-paths")
    some = lambda c: F.coalesce(F.size(c), F.lit(0))
    small = (winners.agg(F.sum(1 + F.greatest(some("wide"), F.lit(0)) + F.greatest(some("repeated"), F.lit(0)))).first()[0] or 0) <= BROADCAST_HOSTS
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    both = named.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "html", "path", "wide", "repeated")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            texts = []
            for page, path, wide, repeated in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "wide", "repeated")), strict=True):
                paths = [path, *(wide or [] if beside(path) == path else [])] if path else None
                texts.append(extracted(blocks(page or ""), paths, frozenset(repeated or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return both.mapInArrow(again, RESULT)
