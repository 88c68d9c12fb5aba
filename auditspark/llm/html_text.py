"""Main text of web pages by two-pass block rules.

First pass: each block is judged alone by its length, its stop-word density, its link density and the kind of container
that it stands in: good, bad or undecided. Where the stop words do not cover a page's language, sentences, length and links
decide. Second pass: undecided blocks, mostly short ones, inherit the label of the
nearest decided neighbours in the same region of the page.

Defined results: a null or empty page has an empty text; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored. Comments and scripts that are never closed end where the page ends; a < that begins
no complete tag is text. Of two decided neighbours equally near the good one counts. Pages are read whole, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column_or_null

#: Where markup may begin: a comment, a tag or a declaration.
OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)(?![a-zA-Z0-9])|[!?])")
#: The rest of a tag up to its end; an unquoted < stops it, so a tag that never ends costs no more than its own length.
ATTRIBUTES = re.compile(r"""(?:[^"'<>]|"[^"]*"|'[^']*')*+""")
#: Elements whose content is no markup, up to their closing tag.
RAW = frozenset("iframe noscript script style template textarea title".split())
CLOSES = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
#: Elements within a line whose text is no text of the page.
CONTROLS = frozenset("button select svg".split())
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|$)(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[a-z]+")
#: Containers, whose open ones are kept on a stack; other block tags only end a block.
CONTAINERS = frozenset("article aside body div dialog dl fieldset figure footer form header main menu nav ol section table ul".split())
BREAKS = CONTAINERS | frozenset("address blockquote caption center dd details dt figcaption h1 h2 h3 h4 h5 h6 hr html head li p pre summary tbody td tfoot th thead tr".split())
BAD_TAGS = frozenset("aside dialog footer form header menu nav".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login menu modal nav navbar navigation "
    "newsletter notice notification pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar tracking widget".split()
)
#: An article's own classes may name its layout; these say that it is none.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments promo promoted recommended related reply replies respond sponsor sponsored".split())
GOOD_NAMES = frozenset(["article", "content", "main", "post", "story"])
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or our she so that the their there they this to was we were which who will with you",
    "fr": "à au aux avec ce cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "de": "als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir wird zu zum zur",
    "es": "a al como con de del el ella en entre era es esta este ha la las le lo los más me no o para pero por que se sin sobre son su sus también un una y ya",
}
ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
#: Ends of sentences, and scripts without spaces between words.
SENTENCE = re.compile(r"[.!?…:;。！？；؟۔।॥։።](?=\s|$|[\"'”’»)\]]|[^\x00-\x7f])|[。！？]")
DENSE = re.compile(r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.12, 0.25, 0.5
GOOD, BAD, SHORT_BLOCK, NEAR_GOOD = 1, 0, -1, -2


class Block:
    __slots__ = ("text", "linked", "inside", "barred", "region")

    def __init__(self, text, linked, inside, barred, region):
        self.text, self.linked, self.inside, self.barred, self.region = text, linked, inside, barred, region


def names_of(attributes: str) -> set[str]:
    return {w for m in NAMES.finditer(attributes) for w in PARTS.findall((m[1] or m[2] or m[3] or "").lower())}


def markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup; the name is empty where there is nothing to do. A <
    that begins no complete tag is text. Linear: what is not found once is not looked for again."""
    at, last = 0, page.rfind(">")
    while m := OPEN.search(page, at):
        start, tag = m.start(), (m[3] or "").lower()
        if m[1]:
            stop = page.find("-->", m.end())
            at = len(page) if stop < 0 else stop + 3
            yield start, at, False, "", ""
        elif start > last:
            return
        elif not tag:
            at = page.find(">", m.end()) + 1
            yield start, at, False, "", ""
        else:
            stop = ATTRIBUTES.match(page, m.end()).end()
            if page[stop : stop + 1] != ">":
                at = m.end()
                continue
            attributes, at = page[m.end() : stop], stop + 1
            if tag in RAW:
                if not m[2] and not attributes.rstrip().endswith("/"):
                    close = CLOSES[tag].search(page, at)
                    stop = page.find(">", close.end()) if close else -1
                    at = len(page) if stop < 0 else stop + 1
                yield start, at, False, "", ""
            else:
                yield start, at, bool(m[2]), tag, attributes


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the characters of them that are links, and the state of their containers."""
    found: list[Block] = []
    # name, in an article, barred, region
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    opened: Counter = Counter()
    pieces: list[tuple[str, bool]] = []
    links, controls, regions, at, marked = 0, 0, 0, 0, False

    def end() -> None:
        nonlocal links, marked
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(" ".join(p.split())) for p, link in pieces if link)
                _, inside, barred, region = stack[-1]
                found.append(Block(text, linked, inside, barred or marked, -1 if marked else region))
            pieces.clear()
        links, marked = 0, False

    def add(raw: str) -> None:
        if raw and not controls:
            pieces.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    for start, stop, closing, tag, attributes in markup(page):
        add(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in CONTROLS:
            controls = max(0, controls - 1) if closing else controls + (not attributes.rstrip().endswith("/"))
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "br":
            pieces.append((" ", False))
        elif tag in BREAKS:
            end()
            # A control that was left open ends with the container around it.
            controls = 0 if tag in CONTAINERS else controls
            if tag not in CONTAINERS:
                # A paragraph or heading may say of itself that it is an advert or the like.
                if not closing and attributes:
                    marked = bool(names_of(attributes) & BAD_NAMES - ({"header"} if stack[-1][1] else set())) or bool(HIDDEN.search(attributes))
                continue
            if closing:
                # A closing tag without an opening one is ignored; else all that was left open within it ends too.
                if opened[tag]:
                    name = ""
                    while name != tag:
                        name = stack.pop()[0]
                        opened[name] -= 1
            elif not attributes.rstrip().endswith("/"):
                _, inside, barred, region = stack[-1]
                names = names_of(attributes)
                bad = names & (NO_ARTICLE if tag in ("article", "main") else BAD_NAMES) - ({"header"} if inside else set())
                barred = barred or (tag in BAD_TAGS and not (tag == "header" and inside)) or (bool(bad) and tag != "body") or bool(HIDDEN.search(attributes))
                regions += 1
                inside_now = inside or tag in ("article", "main") or bool(names & GOOD_NAMES and tag in ("div", "section"))
                # An article is one region with all it holds but barred containers; elsewhere each container is a region.
                opened[tag] += 1
                stack.append((tag, inside_now, barred, region if inside and not barred else regions))
    add(page[at:])
    end()
    return found


def stop_density(text: str, stop_words: frozenset[str]) -> float:
    words = re.findall(r"\w+", text.lower())
    return sum(w in stop_words for w in words) / len(words) if words else 0.0


def first_pass(block: Block, article: bool, density: float, known: bool) -> int:
    """article: the page marks an article, which then holds the main text. known: the stop words cover the page's language."""
    if block.barred or (article and not block.inside):
        return BAD
    n = len(block.text)
    if block.linked > LINKS * n:
        # An article may hold a paragraph that is one link; its neighbours decide.
        return SHORT_BLOCK if block.inside else BAD
    # A character of a script without spaces says about as much as three letters.
    weight = n + 2 * len(DENSE.findall(block.text))
    if weight < SHORT:
        return SHORT_BLOCK if block.inside or not block.linked else BAD
    if known:
        if density >= HIGH:
            return GOOD if weight > LONG or block.inside else NEAR_GOOD
        if density >= LOW:
            return NEAR_GOOD
    # Without stop words length, punctuation and links decide. Prose has sentences; tables and lists have few.
    sentences = len(SENTENCE.findall(block.text))
    if sentences and weight > LONG:
        return NEAR_GOOD if known else GOOD
    if sentences and not known:
        return NEAR_GOOD
    return SHORT_BLOCK if block.inside else BAD


def first_passes(blocks: list[Block], stop_words: frozenset[str]) -> list[int]:
    article = any(b.inside and not b.barred for b in blocks)
    densities = [stop_density(b.text, stop_words) if len(b.text) >= SHORT // 3 and not b.barred else 0.0 for b in blocks]
    prose = [(len(b.text), d) for b, d in zip(blocks, densities) if not b.barred and b.linked <= LINKS * len(b.text) and len(b.text) >= SHORT // 3 and SENTENCE.search(b.text)]
    # Over all that looks like prose: few stop words mean a language that they do not cover.
    known = sum(n * d for n, d in prose) >= LOW / 2 * sum(n for n, _ in prose)
    return [first_pass(b, article, d, known) for b, d in zip(blocks, densities)]


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels without undecided ones."""
    out = list(labels)
    before: list[int | None] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.region))
        if labels[i] >= 0:
            last[b.region] = i
    last = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if labels[i] >= 0:
            last[b.region] = i
            continue
        near = [(abs(j - i), j) for j in (before[i], last.get(b.region)) if j is not None]
        if not near:
            out[i] = GOOD if b.inside or labels[i] == NEAR_GOOD else BAD
        elif len({labels[j] for _, j in near}) == 1:
            out[i] = labels[near[0][1]]
        elif labels[i] == NEAR_GOOD or b.inside or near[0][0] == near[1][0]:
            out[i] = GOOD
        else:
            out[i] = labels[min(near)[1]]
    return out


def main_text(page: str | None, stop_words: frozenset[str] = ALL_STOP_WORDS) -> str:
    blocks = blocks_of(page or "")
    labels = second_pass(blocks, first_passes(blocks, stop_words))
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def extract_text(pages: DataFrame, stop_words: frozenset[str] = ALL_STOP_WORDS) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    rows = pages.select(column_or_null(pages, "page_id", "long").alias("page_id"), column_or_null(pages, "url", "string").alias("url"), column_or_null(pages, "html", "string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, stop_words) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
