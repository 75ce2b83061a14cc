"""Main text of web pages by a linear-chain conditional random field over the page's leaf blocks.

A leaf block is text between the starts and ends of block elements. Each has features from its ancestors (tags, words of
class and id) and from its text; the chain's transitions let a block's neighbours speak. Weights are learnt from
labelled pages, pages whose blocks' roles are known, by the exact gradient of the likelihood, and Viterbi decodes.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a run of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas math".split())
#: An element that starts closes an open one of these, up to the nearest of the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LABEL = "data-block-label"
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: list[str]
    names: list[str]
    linked: float
    label: int | None = None


@dataclass
class BlockParser(HTMLParser):
    """Leaf blocks of a page in page order, character references decoded, white space as one space."""

    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str], int | None]] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0

    __hash__ = object.__hash__

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            names = [x for _, more, _ in self.stack for x in more]
            label = next((x for *_, x in reversed(self.stack) if x is not None), None)
            self.blocks.append(Block(text, [tag for tag, *_ in self.stack], names, min(1.0, self.linked / len(text)), label))
        self.parts, self.linked = [], 0

    def pop_to(self, at: int) -> None:
        for tag, *_ in self.stack[at:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            open_, scope = CLOSES.get(tag, ({"p"}, BLOCKS - {"p"}))
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in open_:
                    self.pop_to(at)
                    break
                if self.stack[at][0] in scope:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        given = dict(attrs)
        names = WORDS.findall(" ".join(given.get(x) or "" for x in ("class", "id", "role")).lower())
        label = given.get(LABEL)
        self.stack.append((tag, names, int(label) if label in ("0", "1") else None))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "script", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.pop_to(at)
                return
            if tag not in BLOCKS and self.stack[at][0] in BLOCKS:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def page_blocks(html: str | None) -> list[Block]:
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


#: Words in class and id that tell a container's role.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion footer form header "
    "login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article body content entry main post prose story text".split())


@lru_cache(maxsize=20_000)
def structure_features(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    """Names of the features of a block's place in the tree; elements called x-... are not seen."""
    tags = tuple(x for x in tags if not x.startswith("x-"))
    blocks = [x for x in tags if x in BLOCKS]
    nearest = next((x for x in reversed(tags) if x in ("article", "main", "nav", "aside", "footer", "header", "form", "section")), "none")
    return (
        "bias",
        f"tag={blocks[-1] if blocks else 'none'}",
        *sorted({f"in={x}" for x in tags}),
        *sorted({f"name={x}" for x in names}),
        *["other-name"] * bool(OTHER_WORDS.intersection(names)),
        *["main-name"] * bool(MAIN_WORDS.intersection(names)),
        f"nearest={nearest}",
    )


NOTICE = re.compile(r"©|\(c\)|all rights reserved|cookie", re.IGNORECASE)


def block_features(block: Block, at: int, count: int) -> list[str]:
    """Names of the block's features: its place in the tree, then its text."""
    return [
        *structure_features(tuple(block.tags), tuple(block.names)),
        f"words={min(6, (block.text.count(' ') + 2).bit_length() - 1)}",
        f"linked={int(block.linked * 4)}",
        f"stop={block.text[-1] in '.!?…”»'}",
        "mark" if NOTICE.search(block.text) else "no-mark",
        f"place={'first' if at == 0 else 'last' if at == count - 1 else 'inner'}",
    ]


@dataclass
class ChainField:
    """Weights of the features for label 1 (label 0 has their negatives), of transitions and of the first label."""

    weights: dict[str, float]
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        sums = np.array([sum(get(name, 0.0) for name in row) for row in rows])
        return np.column_stack([-sums, sums])

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        scores = self.emissions(rows)
        best, back = self.start + scores[0], []
        for row in scores[1:]:
            paths = best[:, None] + self.transitions
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        labels = [int(best.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def marginals(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each label and of each pair of neighbouring labels, by forward-backward."""
        scores = self.emissions(rows)
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[0] = self.start + scores[0]
        for k in range(1, len(scores)):
            forward[k] = np.logaddexp.reduce(forward[k - 1][:, None] + self.transitions, axis=0) + scores[k]
        for k in range(len(scores) - 2, -1, -1):
            backward[k] = np.logaddexp.reduce(self.transitions + (scores[k + 1] + backward[k + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        pairs = np.exp(forward[:-1, :, None] + self.transitions[None] + (scores + backward)[1:, None, :] - total)
        return np.exp(forward + backward - total), pairs


def train(pages: list[list[Block]], rounds: int = 12, rate: float = 0.2, seed: int = 3) -> ChainField:
    """Adagrad on the conditional log-likelihood, one page at a time, with a small ridge penalty. All blocks have labels."""
    model = ChainField({}, np.zeros((2, 2)), np.zeros(2))
    data = []
    for blocks in pages:
        rows = [block_features(x, k, len(blocks)) for k, x in enumerate(blocks)]
        data.append((rows, np.array([x.label for x in blocks])))
    seen: dict[str, float] = {}
    seen_t, seen_s, shuffle = np.full((2, 2), 1e-2), np.full(2, 1e-2), random.Random(seed)
    for _ in range(rounds):
        shuffle.shuffle(data)
        for rows, labels in data:
            if not rows:
                continue
            single, pairs = model.marginals(rows)
            truth = np.eye(2)[labels]
            slope = truth - single
            gradient: dict[str, float] = {}
            for row, (a, b) in zip(rows, slope, strict=True):
                for name in row:
                    gradient[name] = gradient.get(name, 0.0) + b - a
            for name, g in gradient.items():
                g -= 1e-3 * model.weights.get(name, 0.0)
                seen[name] = seen.get(name, 1e-2) + g * g
                model.weights[name] = model.weights.get(name, 0.0) + rate * g / math.sqrt(seen[name])
            gt = -pairs.sum(0)
            np.add.at(gt, (labels[:-1], labels[1:]), 1)
            for value, g, s in ((model.transitions, gt - 1e-3 * model.transitions, seen_t), (model.start, slope[0], seen_s)):
                s += g * g
                value += rate * g / np.sqrt(s)
    return model


def labelled_pages(count: int = 500, seed: int = 11) -> list[str]:
    """Pages whose blocks carry their label (1 main text, 0 other) in an attribute, which features never see.

    Layouts are drawn at random: where the article stands, what is around it, how containers are called, and where
    tags are left open. Words are random syllables: only structure and shape can be learnt.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "be", "co", "du", "en", "fi", "gra", "ho", "is", "ka", "lo", "mi", "no", "or", "pa"]) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 7)))
    maybe = lambda p, make: make() if r.random() < p else ""

    def named(tag: str, names: list[str], inner: str, label: int) -> str:
        name = r.choice(names)
        attribute = f' {r.choice(["class", "id"])}="{name}"' if name else ""
        return f'<{tag}{attribute} {LABEL}="{label}">{inner}</{tag}>'

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(r.randint(a, b))]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), " | ".join(items)])

    def paragraph() -> str:
        text = prose()
        kind = r.random()
        if kind < 0.15:
            return f"<p><b>{text}<br>"
        if kind < 0.25:
            return f"<p>{text} <a href='/x'>{words(1, 3)}</a> {sentence()}</p>"
        if kind < 0.3:
            return "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.34:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.38:
            return f"<h{r.randint(2, 4)}>{words(1, 6)}</h{r.randint(2, 4)}>"
        if kind < 0.41:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def page() -> str:
        title = f"<h1>{sentence(2, 10)}</h1>" if r.random() < 0.9 else ""
        story = title + "".join(paragraph() for _ in range(r.randint(0 if title else 1, 9)))
        tag, names = r.choice([("article", [""]), ("article", ["", "post"]), ("main", ["", "content"]), ("div", ["content", "article-body", "post", "entry-content", "main", "story"]), ("section", ["story", "article", "main-text"]), ("div", [""]), ("x-main", [""])])
        inner = [named(tag, names, story, 1)]
        if r.random() < 0.15:
            inner[0] = inner[0].replace(f"</{tag}>", named(r.choice(["div", "aside"]), ["ad", "promo", "related", "share"], prose(), 0) + f"</{tag}>")
        ad = lambda: named("div", ["ad", "ads", "advert", "banner-ad", "sponsored", "promo"], r.choice([prose(), sentence(), links(1, 3)]), 0)
        before = [
            maybe(0.4, lambda: named("header", ["", "header", "top"], f"<div>{words(1, 4)}</div>" + maybe(0.5, lambda: f"<p>{sentence()}</p>"), 0)),
            maybe(0.2, lambda: named("div", ["header", "masthead", "topbar"], words(1, 6), 0)),
            maybe(0.8, lambda: named("nav", ["", "menu", "nav"], links(2, 8), 0)),
            maybe(0.2, lambda: named("div", ["menu", "navigation", "breadcrumbs"], links(2, 8), 0)),
            maybe(0.2, lambda: named("div", ["notice", "cookie-notice", "alert", "consent"], f"<p>{prose()}</p>" + maybe(0.5, lambda: f"<button>{words(1, 2)}</button>"), 0)),
            maybe(0.6, ad),
        ]
        after = [
            maybe(0.3, lambda: named("aside", ["", "sidebar", "related"], r.choice([links(2, 6), f"<p>{prose()}</p>"]), 0)),
            maybe(0.15, lambda: named("div", ["sidebar", "widget", "related-posts"], f"<h3>{words(1, 3)}</h3>" + links(2, 6), 0)),
            maybe(0.3, lambda: named(r.choice(["section", "div", "ul"]), ["comments", "comment-list", "discussion", "replies"], "".join(f"<{t}>{prose()}</{t}>" for t in [r.choice(["p", "div", "li"]) for _ in range(r.randint(1, 5))]), 0)),
            maybe(0.2, lambda: f'<form {LABEL}="0"><label>{words(1, 4)}</label><p>{sentence()}</p><button>{word()}</button></form>'),
            maybe(0.3, ad),
            maybe(0.85, lambda: named("footer", ["", "footer"], r.choice([f"&copy; {word()}.com &middot; {prose()}", links(2, 6), f"<p>{sentence()}</p>"]), 0)),
            maybe(0.15, lambda: named("div", ["footer", "copyright"], f"&copy; {prose()}", 0)),
        ]
        r.shuffle(before)
        if r.random() < 0.12:
            before, after = [], []
        side = after[:2]
        if r.random() < 0.3:
            before, after = before + side, after[2:]
        body = "".join([*before, *inner, *after])
        return f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var t="</p>";</script></head><body>{body}' + maybe(0.8, lambda: "</body></html>")

    return [page() for _ in range(count)]


def train_on_labelled_pages(pages: list[str]) -> ChainField:
    parsed = [page_blocks(html) for html in pages]
    return train([[x for x in blocks if x.label is not None] for blocks in parsed])


def main_text(html: str | None, model: ChainField) -> str:
    """The blocks labelled 1, in page order, one per line."""
    blocks = page_blocks(html)
    labels = model.decode([block_features(x, k, len(blocks)) for k, x in enumerate(blocks)])
    return "\n".join(block.text for block, label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame, model: ChainField | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, null ids and repeated rows included.

    Null and empty pages, and pages without main text, have an empty text. The whole page is read. n_chars counts
    code points. The model is trained on the driver on a fixed number of labelled pages, unless one is given.
    """
    model = model or train_on_labelled_pages(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for batch in batches:
            texts = [main_text(html.as_py(), shared.value) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
