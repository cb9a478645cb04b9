"""Main text of web pages (operator 5).

A page is cut into leaf blocks: runs of text between block-level tags, each with the
elements that are open around it.  A linear-chain conditional random field labels the
sequence of blocks as main text or not, from features of the open elements and of the text;
its best labelling is found by Viterbi.

It is trained on pages that label themselves: those with an ``article`` or ``main`` element.
Blocks in it count as main text unless they sit in an element made for something else.
Each such page is used twice, the second time without what the label was read from, so that
the model also learns to tell by text, neighbours and the other elements.  At most
``SAMPLE`` pages are learnt from; every page is labelled, whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import map_batches, text_or_empty, values

SAMPLE = 400
LONGEST = 400
STEPS = 150

# HTML element names by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup; they run to the page's end if nothing ends them.
RAW = frozenset("script style textarea title".split())
# Elements without main text.  They need an end tag of their own, or only the tag goes.
DROPPED = frozenset("noscript template iframe svg canvas object select button".split())
# Those of them that can't hold another of their kind.
FLAT = frozenset("noscript iframe select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
# An open element of the first kind ends when one of these begins.
ENDS = {
    "p": BLOCK - {"td", "th", "tr"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = ("article", "main", "nav", "header", "footer", "aside", "form", "head", "p", "li", "table", "blockquote", "pre")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
DROPPED_START = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
HINTS = frozenset("class id role aria-label".split())
# Attribute texts longer than this aren't cached.
SHORT = 500
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|hidden|login|"
    r"menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|"
    r"sponsor\w*|subscribe|toolbar|widget|banner|complementary|contentinfo|navigation|search)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry|main|post\w*|story\w*|text)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"(?<!overflow-)(?<!overflow-[xy]-)\bhidden\b", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Element:
    name: str
    other: bool
    main: bool
    hidden: bool


@dataclass(frozen=True)
class Block:
    """A leaf block: its text, the elements around it, and how much of it is in links."""

    text: str
    around: tuple[Element, ...]
    linked: float


def _element(name: str, rest: str) -> Element:
    """An element by its attributes, all of them; what data and scripts hold says nothing about it."""
    hints, hidden = [], False
    for key, *quoted in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(quoted)
        if key in HINTS:
            hints.append(value)
        if key in ("class", "id"):
            hidden = hidden or bool(HIDDEN.search(value))
        elif key == "style":
            hidden = hidden or bool(HIDDEN_STYLE.search(value))
        else:
            hidden = hidden or key == "hidden" or (key == "aria-hidden" and value.lower() != "false")
    said = " ".join(hints)
    return Element(name, bool(OTHER.search(said)), bool(MAIN.search(said)), hidden)


_cached_element = lru_cache(maxsize=4096)(_element)


def _closes_itself(rest: str) -> bool:
    """Whether a start tag ends with a slash that isn't the end of a value without quotes."""
    rest = rest.rstrip()
    return rest.endswith("/") and "=" not in re.split(r"[\s\"']", rest)[-1]


def _tags(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Name (empty for comments and the like), whether an end tag, attributes, start and end of every tag.

    Raw elements count as one tag, with their content.
    """
    at = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name, ends, rest = (m["name"], m["end"], m["rest"]) if m["name"] else (m["name2"], m["end2"], m["rest2"])
        name = (name or "").lower()
        if name in RAW and not ends and not _closes_itself(rest):
            closing = RAW_END[name].search(page, at)
            at = closing.end() if closing else len(page)
        yield name, bool(ends), rest or "", m.start(), at


def _dropped(page: str) -> dict[int, int]:
    """Start and end of the elements of ``DROPPED`` that have an end tag."""
    out: dict[int, int] = {}
    if DROPPED_START.search(page):
        open_: dict[str, list[int]] = {name: [] for name in DROPPED}
        for name, ends, rest, start, end in _tags(page):
            if name not in DROPPED:
                continue
            if ends:
                if open_[name]:
                    out[open_[name].pop()] = end
            elif not _closes_itself(rest):
                if name in FLAT:
                    open_[name].clear()
                open_[name].append(start)
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with any visible text, in page order."""
    out: list[Block] = []
    open_: list[Element] = []
    pieces: list[str] = []
    in_links = at = 0

    def text_until(end: int) -> None:
        nonlocal in_links
        if end > at:
            pieces.append(page[at:end])
            if any(e.name == "a" for e in open_):
                in_links += end - at

    def flush() -> None:
        nonlocal in_links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not any(e.hidden for e in open_):
                length = sum(map(len, pieces))
                out.append(Block(text, tuple(open_), in_links / length))
            pieces.clear()
            in_links = 0

    dropped = _dropped(page)
    for name, ends, rest, start, end in _tags(page):
        if start < at:
            continue
        text_until(start)
        at = dropped.get(start, end)
        if not name or name in RAW or name in DROPPED:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
        if ends:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
        elif name not in VOID:
            if name in BLOCK:
                for i in range(len(open_) - 1, -1, -1):
                    if name in ENDS.get(open_[i].name, ()):
                        del open_[i:]
                        break
                    if open_[i].name in BLOCK:
                        break
            if not rest.rstrip().endswith("/") or name in BLOCK or name == "a":
                open_.append((_cached_element if len(rest) < SHORT else _element)(name, rest))
    text_until(len(page))
    flush()
    return out


FEATURES = [
    "bias", *(f"in_{n}" for n in MARKED), "heading", "first_heading", "other", "main", "linked", "half_linked",
    "words_1", "words_3", "words_8", "words_20", "words_50", "more", "sentence", "several", "copyright", "first", "last",
]
LABELLED_BY = [FEATURES.index(f) for f in ("in_article", "in_main", "main")]


def features(page: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    out = np.zeros((len(page), len(FEATURES)), np.float32)
    headed = False
    for i, block in enumerate(page):
        names = {e.name for e in block.around}
        words, text = block.text.count(" ") + 1, block.text
        heading = not HEADINGS.isdisjoint(names)
        row = [
            True, *(n in names for n in MARKED), heading, heading and not headed, any(e.other for e in block.around),
            any(e.main for e in block.around), block.linked > 0, block.linked > 0.5,
            words <= 1, 1 < words <= 3, 3 < words <= 8, 8 < words <= 20, 20 < words <= 50, words > 50,
            text[-1] in ".!?…。", text.count(". ") >= 2, "©" in text, i == 0, i == len(page) - 1,
        ]
        headed |= heading
        out[i] = row
    return out


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels by the page's own article or main element; None without one."""
    names = [[e.name for e in b.around] for b in page]
    root = "article" if any("article" in n for n in names) else "main"
    if not any(root in n for n in names):
        return None
    other = ("nav", "aside", "footer", "form")
    return np.array(
        [
            root in n and not any(x in n for x in other) and not any(e.other for e in b.around)
            for n, b in zip(names, page)
        ],
        np.int64,
    )


@dataclass(frozen=True)
class Crf:
    """Weights of features for each label (2 x features) and of label pairs (2 x 2)."""

    state: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labelling of a sequence of feature rows, by Viterbi."""
        scores = (x @ self.state.T).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        a, b = scores[0]
        for s0, s1 in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = s0 + (b + m10 if from0 else a + m00), s1 + (b + m11 if from1 else a + m01)
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = int(pair[label])
            labels.append(label)
        return np.array(labels[::-1], np.int64)


def fit(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Crf:
    """Maximum-likelihood weights for (features, labels) sequences, all pages at once."""
    n, width = len(FEATURES), max(len(y) for _, y in pages)
    x = np.zeros((len(pages), width, n), np.float32)
    y = np.zeros((len(pages), width), np.int64)
    here = np.zeros((len(pages), width), bool)
    for i, (rows, labels) in enumerate(pages):
        x[i, : len(labels)], y[i, : len(labels)], here[i, : len(labels)] = rows, labels, True
    state, move = np.zeros((2, n)), np.zeros((2, 2))
    moment, square = np.zeros(2 * n + 4), np.zeros(2 * n + 4)
    seen = np.stack([x[here & (y == k)].sum(0) for k in (0, 1)])
    pairs = here[:, 1:]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for step in range(1, steps + 1):
        node = x @ state.T
        forward, backward = np.zeros_like(node), np.zeros_like(node)
        forward[:, 0] = node[:, 0]
        for t in range(1, width):
            into = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1)
            forward[:, t] = np.where(here[:, t, None], into + node[:, t], forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            out = np.logaddexp.reduce(move + (node[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(here[:, t + 1, None], out, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None]) * here[:, :, None]
        expected = np.einsum("ptk,ptf->kf", chance, x)
        edge = forward[:, :-1, :, None] + move + (node[:, 1:] + backward[:, 1:])[:, :, None, :]
        edge = np.exp(edge - total[:, None, None, None]) * pairs[:, :, None, None]
        slope = np.concatenate([(seen - expected).ravel(), (moved - edge.sum((0, 1))).ravel()]) / len(pages)
        weights = np.concatenate([state.ravel(), move.ravel()])
        slope -= 0.002 * weights
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights += 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        state, move = weights[: 2 * n].reshape(2, n), weights[2 * n :].reshape(2, 2)
    return Crf(state, move)


#: What is used when no page labels itself: elements speak for themselves.
def fallback() -> Crf:
    state = np.zeros((2, len(FEATURES)))
    for name in ("in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_head", "other", "half_linked"):
        state[0, FEATURES.index(name)] = 4
    for name in ("in_article", "in_main", "in_p", "heading", "sentence", "more", "words_50"):
        state[1, FEATURES.index(name)] = 2
    return Crf(state, np.eye(2))


def train(pages: DataFrame, id_column: str = "page_id", column: str = "html", size: int = SAMPLE) -> Crf:
    """A model of at most ``size`` pages with an article or main element, chosen by a hash of their id."""
    labelled = pages.where(F.lower(column).rlike("<(article|main)[ >]")).select(id_column, column)
    rows = labelled.orderBy(F.xxhash64(id_column), F.xxhash64(column)).limit(size).collect()
    sequences = []
    for row in rows:
        page = blocks(row[1])
        labels = own_labels(page) if page else None
        if labels is not None and len(page) <= LONGEST:
            x = features(page)
            bare = x.copy()
            bare[:, LABELLED_BY] = 0
            sequences += [(x, labels), (bare, labels)]
    return fit(sequences) if sequences else fallback()


def main_blocks(page: str, model: Crf) -> list[str]:
    found = blocks(page)
    if not found:
        return []
    return [b.text for b, label in zip(found, model.decode(features(found))) if label]


def main_text(pages: DataFrame, model: Crf, column: str = "html") -> DataFrame:
    """``text`` and ``n_chars`` of every page, in place of its HTML.

    ``text`` joins the blocks labelled as main text by line feeds, in page order, character
    references decoded and white space inside a block turned into single spaces; empty if
    there is none, as for null, empty or blank pages.  ``n_chars`` counts its code points.
    Pages may be of any length and cut off anywhere; repeated rows get the same text; empty
    tables give empty results; other columns pass through, those named like a result are
    replaced.
    """
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        texts = ["\n".join(main_blocks(page, shared.value)) for page in values(batch.column("__page"))]
        lengths = pa.array(map(len, texts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), lengths], [*kept, "text", "n_chars"]
        )

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    source = pages.select(*kept, text_or_empty(column).alias("__page"))
    return map_batches(source, run, f"{schema}text string, n_chars long")
