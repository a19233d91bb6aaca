"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: text between block borders, with the open tags
around it. A chain model over the blocks, with features of the ancestors and of the text, decides by
Viterbi which blocks are the article. It is trained on labelled pages: a bounded sample of the given
pages, labelled by what their own mark-up says (see :func:`own_label`), and the same texts set in
other layouts, where the label of every block is known because we put it there. Some of these have no
telling name anywhere, and on such pages the size, links and end of the texts and their order decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import table

#: Pages that train at most.
SAMPLE = 200
#: Characters of a page that trains at most.
LONGEST = 1_000_000
#: Blocks of a chain in training at most; a longer page is cut into several, none of it left out.
CHAIN = 256
STEPS = 250

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select".split())
#: Elements of other languages, which are empty if their tag ends in "/>"; in HTML that slash means nothing.
_FOREIGN = frozenset("svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*)>|[!?/][^>]*(?:>|\Z))",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for name in _RAW}


@dataclass
class Block:
    """A leaf block: its text and the features the model sees."""

    text: str
    features: list[str]
    path: frozenset = field(default_factory=frozenset)


def _bucket(value: float, limits: tuple) -> int:
    return sum(value >= x for x in limits)


def _self_closed(rest: str) -> bool:
    """Does the slash before ">" end the tag? In an unquoted value it is part of the value."""
    return rest.endswith("/") and "=" not in re.split(r"[\s\"']", rest)[-1]


class _Open:
    """The open tags, however many, with what is asked of them at hand: every step costs the tags it opens or closes."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.tags: Counter = Counter()
        #: Features of the open tags, with the number of tags that have them.
        self.features: Counter = Counter()
        #: Names of the open blocks, and the inline tags open directly in each; the first is the page.
        self.blocks = [""]
        self.inline: list[Counter] = [Counter()]

    def push(self, name: str, names: tuple[str, ...]) -> None:
        features = tuple(x for x in {f"<{name}", *names} if self.known is None or x in self.known)
        self.stack.append((name, features))
        self.tags[name] += 1
        self.features.update(features)
        if name in _INLINE:
            self.inline[-1][name] += 1
        else:
            self.blocks.append(name)
            self.inline.append(Counter())

    def close(self, name: str) -> None:
        """Ends the nearest tag of that name with all in it; an inline tag only inside its block."""
        if not (self.inline[-1] if name in _INLINE else self.tags)[name]:
            return
        last = None
        while last != name:
            last, features = self.stack.pop()
            self.tags[last] -= 1
            for x in features:
                self.features[x] -= 1
                if not self.features[x]:
                    del self.features[x]
            if last in _INLINE:
                self.inline[-1][last] -= 1
            else:
                self.blocks.pop()
                self.inline.pop()


def blocks(html: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks with text in page order. No tag is left out, however deep; a block costs the
    different features around it, of ``known`` if given, and all else is linear in the page.

    Character references are decoded and white space collapsed. Comments, declarations and the
    content of scripts, styles and the like are no text. Tags that are never closed end with what
    encloses them.
    """
    tags = _Open(known)
    found: list[Block] = []
    buffer: list[str] = []
    linked = [0]

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            own = tags.blocks[-1]
            path = frozenset(tags.features)
            n = len(text.split())
            size = _bucket(n, (3, 6, 11, 21, 51))
            link = _bucket(min(1.0, linked[0] / len(text)), (0.01, 0.3, 0.7))
            features = ["1", f"own {own}", f"size {size}", f"link {link}", f"own {own} size {size}", *sorted(path)]
            if text[-1] in ".!?":
                features.append("sentence")
            if re.search("©|(?i:copyright|cookie)", text):
                features.append("sign")
            found.append(Block(text, features, path))
        linked[0] = 0

    at = 0
    raw = None
    last = html.rfind(">")
    while at < len(html):
        if raw:
            end = _RAW_END[raw].search(html, at)
            at, raw = (end.end(), None) if end else (len(html), None)
            continue
        less = html.find("<", at)
        if less < 0:
            less = len(html)
        if less > at:
            buffer.append(html[at:less])
            if tags.tags["a"]:
                linked[0] += less - at
        if less == len(html):
            break
        # beyond the last > nothing but a comment or an end tag can begin
        tag = _TAG.match(html, less) if less < last or html.startswith(("<!", "<?", "</"), less) else None
        if not tag:
            buffer.append("<")
            at = less + 1
            continue
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if not name:
            continue
        name = name.lower()
        closing = bool(tag["end"] or tag["end2"])
        if name not in _INLINE and name != "br":
            flush()
        elif name == "br":
            buffer.append(" ")
            continue
        if closing:
            tags.close(name)
            continue
        rest = tag["rest"] or tag["rest2"] or ""
        if name in _VOID or name in _FOREIGN and _self_closed(rest):
            continue
        if name in _RAW:
            raw = name
            continue
        if name not in _INLINE:
            # a new block ends an open paragraph, a new item an open item, with what is in them
            ends = {"p", name} if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") else {"p"}
            if tags.blocks[-1] in ends:
                tags.close(tags.blocks[-1])
        names = tuple(
            f".{x}" for m in _NAMED.finditer(rest) for x in _TOKEN.findall((m[1] or m[2] or m[3] or "").lower())
        ) if "=" in rest else ()
        tags.push(name, names)
    flush()
    if not any(b.path & _MAIN for b in found):
        # no name tells where the article is: the texts have weights of their own here
        for block in found:
            shape = [x for x in block.features if x.startswith(("size", "link", "sentence", "sign"))]
            block.features += ["plain", *[f"plain {x}" for x in shape], "plain " + " ".join(shape)]
    return found


_MAIN = {"<article", "<main", ".main", ".article", ".post", ".content", ".story", ".entry"}
_NOT = {
    "<nav", "<header", "<footer", "<aside", "<form", "<button", "<head", "<dialog", ".ad", ".ads", ".advert",
    ".advertisement", ".sponsored", ".promo", ".banner", ".sidebar", ".menu", ".nav", ".navigation", ".breadcrumb",
    ".footer", ".header", ".cookie", ".cookies", ".notice", ".consent", ".newsletter", ".comment", ".comments",
    ".share", ".social", ".related", ".widget", ".login", ".search",
}


def own_label(block: Block) -> int:
    """What a page's own mark-up says about a block: inside an article and nothing that is set apart."""
    return int(bool(block.path & _MAIN) and not block.path & _NOT)


def other_layouts(html: str, turn: int) -> list[tuple[list[Block], list[int]]]:
    """A page's texts in other layouts, labelled as they are placed; ``turn`` picks names and order."""
    parts = blocks(html)
    body = [b.text for b in parts if own_label(b)]
    rest = [b.text for b in parts if not own_label(b)] or ["Home"]
    if not body:
        return []
    short = [" ".join(t.split()[: 3 + i % 9]) for i, t in enumerate(body)]

    def pick(names: str) -> str:
        choices = names.split()
        return choices[turn % len(choices)]

    def menu(name: str) -> str:
        return f"<{name}><ul>" + "".join(f'<li><a href="/{i}">{escape(t[:30])}</a></li>' for i, t in enumerate(rest[:6])) + f"</ul></{name}>"

    def part(tag: str, names: str, texts: list[str], inner: str = "p") -> str:
        inside = "".join(f"<{inner}>{escape(t)}</{inner}>" for t in texts)
        return f'<{tag} class="{pick(names)}">{inside}</{tag}>'

    marked = "\x01"  # put before the texts that are the article; blocks() keeps it
    main = [f"{marked}{t}" for t in body]
    paragraphs = "".join(f"<p>{escape(t)}" + "</p>" * (turn % 3 > 0) for t in main[1:])
    heading = f"<{pick('h1 h2 h1')}>{escape(main[0])}</{pick('h1 h2 h1')}>"
    quote = f"<blockquote>{escape(marked + body[-1])}</blockquote>" if turn % 2 else ""
    listed = "<ul>" + "".join(f"<li>{escape(marked + t)}</li>" for t in short[:3]) + "</ul>" if turn % 4 == 1 else ""
    cells = f"<table><tr><td>{escape(marked + short[0])}</td><td>{escape(marked + short[-1])}</td></tr></table>" if turn % 5 == 2 else ""
    comments = part(pick("div section div ol"), "comments comment comments-list user-comments", [body[-1], short[0]], pick("p div p li"))
    side = part(pick("aside div"), "sidebar widget related sidebar-box", [short[0], rest[0]], pick("p div"))
    ad = part("div", "ad ads advert advertisement sponsored promo banner", [rest[turn % len(rest)]], pick("p span"))
    notice = part("div", "cookie cookie-banner notice consent newsletter", [rest[-1], short[-1]], pick("p span"))
    form = f"<form class='{pick('search login newsletter')}'><label>{escape(short[0])}</label><button>OK</button></form>"
    top = f"<header><h2>{escape(rest[0])}</h2>{menu('nav')}</header>" if turn % 2 else menu("nav") + part("div", "header banner", rest[:1])
    bottom = f"<footer><p>&copy; {escape(rest[-1])}</p></footer>" if turn % 2 else part("div", "footer", [f"© {rest[-1]}"])
    text = heading + paragraphs + quote + listed + cells
    middle = [
        f"<article>{text}{comments}</article>{side}",
        f"<main><article>{heading}{ad}{paragraphs}{quote}{cells}{form}</article></main>{comments}",
        f'<div id="{pick("content main post")}">{text}{ad}</div>{side}{comments}',
        f'<div class="{pick("post article story entry")}">{text}</div>{form}{comments}',
    ][turn % 4]
    page = f"<html><body>{notice if turn % 3 == 0 else ''}{top}{ad if turn % 3 == 1 else ''}{middle}{notice if turn % 3 == 2 else ''}{bottom}</body></html>"
    made = [blocks(page), blocks(_bare_layout(main, rest, turn))]
    return [(found, [int(marked in b.text) for b in found]) for found in made]


def _bare_layout(main: list[str], rest: list[str], turn: int) -> str:
    """A menu, the article and a foot in blocks without any telling name; ``turn`` picks the blocks."""

    def pick(names: str) -> str:
        choices = names.split()
        return choices[turn % len(choices)]

    def part(texts: list[str]) -> str:
        tag, around = pick("div p td div div"), pick("div div table div section")
        inside = "".join(f"<{tag}>{t}</{tag}>" for t in texts)
        return f"<{around}>{f'<tr>{inside}</tr>' if tag == 'td' else inside}</{around}>"

    words = [w.rstrip(".,;:!?") or "Home" for t in rest for w in t.split()]
    items = [escape(" ".join(words[i : i + 1 + (i + turn) % 3])) for i in range(3 + turn % 4)]
    menu = [f'<a href="/{i}">{t}</a>' if turn % 2 else t for i, t in enumerate(items)]
    # a heading is short and no sentence, the texts below it are as they come
    title = " ".join(main[0].split()[: 3 + turn % 7]).rstrip(".,;:!?")
    heading = f"<h1>{escape(title)}</h1>" if turn % 3 == 1 else part([escape(title)])
    sign = ["&copy; 2020 " + items[0], "Copyright " + escape(rest[-1]), items[-1], "&copy; " + escape(rest[-1])][turn % 4]
    return f"<html><body>{part(menu)}{heading}{part([escape(t) for t in main[1:] or main])}{part([sign, *items[: turn % 3]])}</body></html>"


@dataclass
class Model:
    """Weights of a chain over two states: 0 something else, 1 article."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def scores(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, block in enumerate(page):
            ids = [self.names[f] for f in block.features if f in self.names]
            out[i] = self.emit[ids].sum(axis=0)
        return out

    def label(self, page: list[Block]) -> list[int]:
        """The most likely states, by Viterbi; ties go to state 0."""
        if not page:
            return []
        (a00, a01), (a10, a11) = self.step.tolist()
        emit = self.scores(page).tolist()
        x, y = self.first[0] + emit[0][0], self.first[1] + emit[0][1]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = int(y + a10 > x + a00), int(y + a11 > x + a01)
            back.append((from0, from1))
            x, y = (y + a10 if from0 else x + a00) + e0, (y + a11 if from1 else x + a01) + e1
        path = [int(y > x)]
        for choice in reversed(back):
            path.append(choice[path[-1]])
        return path[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, decay: float = 2e-4) -> Model:
    """Maximum conditional likelihood with a small quadratic penalty, by full-batch Adam."""
    pages = [(b[i : i + CHAIN], y[i : i + CHAIN]) for b, y in pages for i in range(0, len(b), CHAIN)]
    names = {f: i for i, f in enumerate(sorted({f for b, _ in pages for x in b for f in x.features}))}
    model = Model(names, np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return model
    longest = max(len(b) for b, _ in pages)
    n = len(pages)
    row, col, here, real = [], [], np.zeros((n, longest, 2)), np.zeros((n, longest))
    for p, (page, labels) in enumerate(pages):
        for i, (block, y) in enumerate(zip(page, labels)):
            here[p, i, y], real[p, i] = 1, 1
            ids = [names[f] for f in block.features]
            row += [p * longest + i] * len(ids)
            col += ids
    row, col = np.array(row), np.array(col)
    pairs = np.einsum("pia,pib->ab", here[:, :-1], here[:, 1:])
    theta = [model.emit, model.step, model.first]
    moment = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]

    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        emit = np.stack([np.bincount(row, weights=model.emit[col, s], minlength=n * longest) for s in (0, 1)], axis=1)
        emit = emit.reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = model.first + emit[:, 0]
        for i in range(1, longest):
            new = total(forward[:, i - 1, :, None] + model.step, 1) + emit[:, i]
            forward[:, i] = np.where(real[:, i, None] > 0, new, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            new = total(model.step + (emit[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(real[:, i + 1, None] > 0, new, 0)
        whole = total(forward[:, -1], 1)
        state = np.exp(forward + backward - whole[:, None, None]) * real[:, :, None]
        both = np.exp(
            forward[:, :-1, :, None] + model.step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        ) * real[:, 1:, None, None]
        off = (here - state).reshape(-1, 2)
        gradient = [
            np.stack([np.bincount(col, weights=off[row, s], minlength=len(names)) for s in (0, 1)], axis=1),
            pairs - both.sum(axis=(0, 1)),
            (here[:, 0] - state[:, 0]).sum(axis=0),
        ]
        for t, g, m in zip(theta, gradient, moment):
            g = g / n - decay * t
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            t += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` different pages, chosen by a hash of their html; null,
    very long (over LONGEST characters) pages and those without a telling name do not train. Only these pages reach the driver."""
    own = pages.select(F.col(html_col).alias("__html")).where(f"__html IS NOT NULL AND length(__html) <= {LONGEST}")
    own = own.select(F.xxhash64("__html").alias("__key"), "__html")
    # hashes first: a task sends the driver numbers, not pages
    keys = [r[0] for r in own.select("__key").distinct().orderBy("__key").limit(sample).collect()]
    drawn = own.where(F.col("__key").isin(keys)).groupBy("__key").agg(F.min("__html")).collect()
    labelled = []
    for i, (_, html) in enumerate(sorted(map(tuple, drawn))):
        page = blocks(html)
        own_labels = [own_label(b) for b in page]
        if any(own_labels):  # else its mark-up says nothing
            labelled.append((page, own_labels))
        labelled += other_layouts(html, i)
    return fit(labelled)


def main_text(html: str | None, model: Model) -> str:
    page = blocks(html or "", model.names)
    return "\n\n".join(b.text for b, y in zip(page, model.label(page)) if y)


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per row: the columns ``keep``, text (blocks of the article joined by an empty line, empty if
    there are none or the html is null) and n_chars, its code points. Whole pages are read, each row
    for itself; repeated rows give repeated results; other columns are not read."""
    frame = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "__html"]
    return frame.mapInArrow(run, ", ".join([*fields, "text string, n_chars bigint"]))


def op5_chain_field(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
