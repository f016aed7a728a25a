"""Main-text extraction by consensus host paths.

Each page is parsed into containers; its vote goes to the deepest container that
holds nearly all of the text outside boilerplate.  Votes are counted by host
over generalised tag-class paths (digits in class names don't tell containers
apart), and every page is extracted again from the containers on its host's
winning path.  Pages without one use their own choice.  Pages vote on boilerplate
too: a path whose containers hold far fewer different texts than the host has
pages with different texts (a disclaimer, a box of links) is left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_limits, if_small, stored, table, widened

#: Share of a page's text that its chosen container holds at least.
HOLDS = 0.9
#: A path is boilerplate on a host of RECUR_PAGES different pages or more if it is on that many
#: pages, and its different texts are at most this share of the different pages it is on.
RECUR_PAGES = 8
RECUR_SHARE = 0.2
PIECE_CHARS = 4_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
DIGITS = re.compile(r"\d+")
NAME_PART = re.compile(r"[a-z]+|\d+")

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset option optgroup".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these, if no other container lies between.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
#: Containers whose recurrence is voted on; headings and paragraphs may recur in articles.
BOXES = frozenset("address center details dialog div dl figure fieldset ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "footer foot gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup popover promo promoted promotion "
    "reactions related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar trackbacks widget widgets".split()
)
#: Words that also name subjects: they count only beside words of WORDS or PLAIN.
SUBJECTS = frozenset("banner banners cookie cookies consent foot header menu menus notice notices promotion reactions related reply responses share sharing skip social subscription".split())
PLAIN = frozenset("area bar block bottom box button buttons container content feed fixed group icon icons inner item items label left link links list main media outer page panel post posts right row section side site text title top wrap wrapper".split())
#: On elements within a line only these count.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored".split())


def names_boilerplate(names: str) -> bool:
    """Whether any of the class names and ids says so."""
    for name in names.split():
        parts = set(NAME_PART.findall(name))
        found = parts & WORDS
        if found - SUBJECTS or (found and all(x in WORDS or x in PLAIN or x.isdigit() for x in parts)):
            return True
    return False


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, source: str):
        self.parent, self.path, self.junk, self.tag = [-1], [""], [False], [""]
        self.inline = [False]  # pushed for its junk, not for being a container
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self.stack = [0]
        self.text: list[str] = []
        self.links = 0
        self.in_link = 0
        self.read(source)

    def read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            self.add(source[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self.close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(source)
            else:
                self.open(tag, m.group(3) or "")
        self.add(source[at:])
        self.end_block()

    def add(self, raw: str) -> None:
        if raw and not self.junk[self.stack[-1]]:
            self.text.append(raw)
            if self.in_link:
                self.links += len(raw)

    def end_block(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.links, len(text))))
            self.text, self.links = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_block()
            if not self.inline[self.stack[-1]]:
                if tag not in ("option", "optgroup") and self.tag[self.stack[-1]] in ("option", "optgroup"):
                    self.drop_open("option", frozenset(("option", "optgroup")))
                self.drop_open("p", frozenset(("p",)))
            if tag in ENDS:
                self.drop_open(tag, ENDS[tag])
        elif tag == "br":
            self.add(" ")
            return
        if tag in VOID:
            return
        if tag == "a":
            self.in_link += 1
        if tag not in BLOCKS:
            self.open_inline(tag, attributes)
            return
        found = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        classes = found.get("class", "").lower()
        above = self.stack[-1]
        junk = self.junk[above] or tag in BOILERPLATE_TAGS or found.get("role", "").lower() in ROLES
        if not junk and found and tag not in ("html", "body", "main", "article"):
            junk = names_boilerplate(classes + " " + found.get("id", "").lower())
        junk = junk or self.hidden(attributes, found)
        label = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in classes.split()})])
        # the whole path, however deep, as a digest of the path above and the label
        self.push(above, hashlib.blake2b(f"{self.path[above]}/{label}".encode("utf-8", "replace"), digest_size=12).hexdigest(), junk, tag, False)

    def push(self, above: int, path: str, junk: bool, tag: str, inline: bool) -> None:
        self.parent.append(above)
        self.path.append(path)
        self.junk.append(junk)
        self.tag.append(tag)
        self.inline.append(inline)
        self.stack.append(len(self.parent) - 1)

    @staticmethod
    def hidden(attributes: str, found: dict[str, str]) -> bool:
        return "hidden" in DIGITS.sub("", attributes).split() or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))

    def open_inline(self, tag: str, attributes: str) -> None:
        """An element within a line is kept track of only if its text is left out."""
        above = self.stack[-1]
        if self.inline[above]:
            self.push(above, self.path[above], True, tag, True)
        elif attributes.strip() and not self.junk[above]:
            found = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            if self.hidden(attributes, found) or not INLINE_WORDS.isdisjoint(NAME_PART.findall(names)):
                self.push(above, self.path[above], True, tag, True)

    def drop_open(self, tag: str, ends: frozenset[str]) -> None:
        """Ends the innermost open element of those named, unless another container is inside it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            here = self.tag[self.stack[depth]]
            if here in ends:
                del self.stack[depth:]
                return
            if here not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag not in BLOCKS:
            if self.inline[self.stack[-1]]:
                for depth in range(len(self.stack) - 1, 0, -1):
                    if not self.inline[self.stack[depth]]:
                        return
                    if self.tag[self.stack[depth]] == tag:
                        del self.stack[depth:]
                        return
            return
        self.end_block()
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[depth]] == tag:
                del self.stack[depth:]
                return

    def choice(self) -> tuple[str, int]:
        """(path, characters) of the deepest container with at least HOLDS of the text that
        isn't in links or boilerplate; the root's path is ''."""
        held = [0] * len(self.parent)
        for node, text, links in self.blocks:
            held[node] += len(text) - links
        for node in range(len(held) - 1, 0, -1):
            held[self.parent[node]] += held[node]
        self.held = held
        total, best = held[0], 0
        if not total:
            return "", 0
        for node in range(1, len(held)):
            if self.parent[node] == best and held[node] >= HOLDS * total and self.tag[node] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
                best = node
        return self.path[best], held[best]

    def boxes(self) -> list[tuple[str, int]]:
        """(path, digest of its texts) of the containers whose recurrence is voted on."""
        texts: dict[str, list[str]] = {}
        for node, text, _ in self.blocks:
            while node > 0:
                if self.tag[node] in BOXES:
                    texts.setdefault(self.path[node], []).append(text)
                node = self.parent[node]
        return [(path, digest("\n".join(own))) for path, own in texts.items()]

    def extract(self, path: str, recurring: frozenset[str] = frozenset()) -> str:
        """The blocks inside containers on the path, in page order, but for those in containers
        below it whose path recurs."""
        if path not in self.path:
            path = self.choice()[0]
        inside = [p == path for p in self.path]
        for node in range(1, len(inside)):
            inside[node] = inside[node] or (inside[self.parent[node]] and self.path[node] not in recurring)
        return "\n".join(text for node, text, _ in self.blocks if inside[node])


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    at, size = 0, 0
    for k, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= PIECE_CHARS or k == batch.num_rows - 1:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, chars, texts): each page's vote for its container, and, with chars null, a row
    for each path of its boxes; texts is a digest of the page's text or of the path's."""
    for batch in batches:
        for part in pieces(batch, "html"):
            rows: list[tuple[str, str, int | None, int]] = []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page = Page(html or "")
                path, chars = page.choice()
                rows.append((host, path, chars, digest("\n".join(b[1] for b in page.blocks))))
                rows += [(host, p, None, t) for p, t in page.boxes()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "path", "chars", "texts"])


def extraction(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__html"):
                given = zip(*(part.column(c).to_pylist() for c in ("__html", "path", "recurring")))
                text = [Page(h or "").extract(p or "", frozenset(r or ())) for h, p, r in given]
                yield pa.RecordBatch.from_arrays([*(part.column("row").field(k) for k in range(len(names))), pa.array(text, pa.string())], [*names, "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """The rows of pages with text added (a column of that name is replaced).

    Null and empty html give ''; a null url's pages form a host of their own; repeated
    rows vote and come out each, but equal texts count once as signs of recurrence; of paths
    with as many votes the one with more characters wins, then the lesser digest of a path; an
    empty table gives an empty result.
    """
    arrow_limits(pages.sparkSession)
    names = [c for c in pages.columns if c != "text"]
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    base = pages.select(F.struct(*names).alias("row"), F.col("html").alias("__html"), host.alias("__host"))
    given = base.select(F.col("__host").alias("host"), F.col("__html").alias("html")).mapInArrow(votes, "host string, path string, chars long, texts long")
    # equal votes are added up before they are shuffled, so a host with a third of the pages is no hot spot
    given = stored(given.groupBy("host", "path", "chars", "texts").agg(F.count(F.lit(1)).alias("pages")), "votes")
    tally = given.where("chars > 0").groupBy("host", "path").agg(F.sum("pages").alias("votes"), F.sum(F.col("chars") * F.col("pages")).alias("chars"))
    # negated, so that the least struct has most votes, then most characters, then the least path
    won = tally.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), F.col("path"))).alias("best")).select("host", "best.path")
    # different texts of the host's pages against those of each path on it
    different = given.where("chars is not null").groupBy("host").agg(F.count_distinct("texts").alias("all_texts"), F.sum("pages").alias("all_pages"))
    paths = given.where("chars is null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("texts"), F.sum("pages").alias("pages"))
    often = paths.join(different, "host").where(
        (F.col("all_texts") >= RECUR_PAGES) & (F.col("pages") >= RECUR_PAGES)
        # of the different pages, as many have the path as its share of all pages
        & (F.col("texts") <= RECUR_SHARE * F.col("all_texts") * F.col("pages") / F.col("all_pages"))
    )
    recurring = often.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("recurring"))
    won = stored(won.join(recurring, "host", "left"), "host-paths")
    joined = base.join(if_small(won), base["__host"] == won["host"], "left").select("row", "__html", "path", "recurring")
    return joined.mapInArrow(extraction(names), widened(pages.select(*names), text="string"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Every page's main text; see ``extract`` for nulls, ties and repeats."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
