"""Main-text extraction with a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks: runs of text between block
element boundaries, in page order.  Features of a block are its ancestors' tags
and class, id and role words, and its text's length, links and punctuation.
The field is trained by maximum likelihood on labelled pages, which are written
by `labelled_pages`: many page layouts with invented words, where every block's
label is known.  Viterbi decoding marks the blocks of the main text.

Defined cases: null or empty html gives an empty text; unclosed tags are closed
as browsers do for p, li and table parts; an unclosed comment, script, style,
textarea or title runs to the end; of other hidden elements (template, select,
button) without an end tag only the start tag is dropped; head needs no end tag; a
page without markup is one block of main text; what follows the last ">" is text;
where both labels score alike Viterbi takes boilerplate; repeated rows are
extracted alike; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z][^>"'<]*(?:"[^"<]*"[^>"'<]*|'[^'<]*'[^>"'<]*)*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
    + "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split()
    + "svg g path rect circle ellipse line polyline polygon text tspan use defs symbol object param canvas audio video picture".split()
)
HIDDEN = frozenset("script style template textarea select button title".split())
#: Hidden elements whose content is not markup: unclosed, they run to the end.
RAW = frozenset("script style textarea title".split())
CONTAINERS = frozenset("article aside body div dl fieldset figure footer form header html main nav ol section table td th tr ul li".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOLD = frozenset("article main nav header footer aside form ul ol table section figure figcaption blockquote pre dialog dl menu h1 h2 h3 h4 h5 h6 address details fieldset p li td".split())


@dataclass
class Block:
    text: str
    tag: str
    around: frozenset
    link_chars: int
    position: float = 0.0


class _Stack:
    """Open elements; each knows the features of all its ancestors."""

    def __init__(self):
        self.items: list[tuple[str, frozenset]] = []
        self.count: dict[str, int] = {}

    def around(self) -> frozenset:
        return self.items[-1][1] if self.items else frozenset()

    def push(self, tag: str, raw: str) -> None:
        new = {f"in:{tag}"} if tag in TOLD else set()
        if tag not in INLINE and len(raw) > len(tag) + 2:
            for _, *values in ATTR.findall(raw):
                new.update("c:" + w.lower() for v in values for w in WORD.findall(v))
        old = self.around()
        self.items.append((tag, old if new <= old else old | new))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop_to(self, tags: tuple, stops=()) -> bool:
        """Close the nearest of `tags`, unless one of `stops` is nearer."""
        if not any(self.count.get(t) for t in tags):
            return False
        for k in range(len(self.items) - 1, -1, -1):
            t = self.items[k][0]
            if t in tags:
                for tag, _ in self.items[k:]:
                    self.count[tag] -= 1
                del self.items[k:]
                return True
            if t in stops:
                return False
        return False


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack, parts, links, tag_of = _Stack(), [], 0, ""
    pos, n = 0, len(page)
    endless: set[str] = set()  # hidden elements without a further end tag

    def flush() -> None:
        nonlocal parts, links
        if parts:
            raw = "".join(parts)
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                block_tag = next((t for t, _ in reversed(stack.items) if t not in INLINE), "")
                out.append(Block(text, block_tag, stack.around(), links))
        parts, links = [], 0

    last = page.rfind(">")
    while pos < n:
        m = None if pos > last and not page.startswith("<!--", pos) else TOKEN.match(page, pos)
        # No tag ends after the last ">": the rest is text.
        token, pos = (m.group(), m.end()) if m else (page[pos:], n)
        if m is None or token[0] != "<" or token == "<":
            parts.append(token)
            if stack.count.get("a"):
                links += len(token)
            continue
        name = NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag not in INLINE:
                flush()
            if tag == "p" or tag in INLINE:
                stack.pop_to((tag,), CONTAINERS)
            else:
                stack.pop_to((tag,))
            continue
        if tag == "head":  # what it holds is hidden by itself
            flush()
            continue
        if tag in HIDDEN:
            if not token.endswith("/>") and tag not in endless:
                again = rf"|<{tag}\b" if tag in ("button", "select") else ""  # these do not nest
                end = re.compile(rf"</{tag}\b[^>]*>{again}", re.I).search(page, pos)
                if end:
                    pos = end.end() if end[0][1] == "/" else pos
                elif tag in RAW:
                    pos = n
                else:
                    endless.add(tag)
            if tag in ("button", "select"):
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                stack.pop_to(("p",), CONTAINERS)
            if tag in CLOSES and tag != "p":
                stack.pop_to(CLOSES[tag], STOPS.get(tag, ()))
        if tag not in VOID and not token.endswith("/>"):
            stack.push(tag, token)
    flush()
    for k, b in enumerate(out):
        b.position = k / len(out)
    return out


#: Words that page authors put in class and id attributes, by kind of block.
KINDS = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs tabs toc pagination pager links skip megamenu submenu",
    "header": "header masthead banner topbar logo brand site branding tagline hero",
    "footer": "footer foot copyright legal colophon bottom sitemap credits",
    "side": "sidebar side aside widget related recommended recommendations popular trending rail tags categories archive recent more readmore",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast paywall disclaimer warning message privacy",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola dfp adsense adslot commercial",
    "form": "form search login signin signup subscribe newsletter subscription contact register poll feedback",
    "comment": "comment comments discussion replies reply respond disqus thread responses reader readers commentlist",
    "share": "share sharing social follow facebook twitter buttons toolbar print",
}
MAIN = "content article post entry main body story text page copy maincontent articlebody postcontent entrycontent storybody"
_BOILER = frozenset({f"c:{w}" for own in KINDS.values() for w in own.split()} | {f"in:{t}" for t in ("nav", "header", "footer", "aside", "form", "menu", "dialog")})
_MAIN = frozenset({f"c:{w}" for w in MAIN.split()} | {"in:article", "in:main"})


def features(b: Block, before: Block | None) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    dense = b.link_chars / max(1, n)
    out = [
        "bias", f"tag:{b.tag}", f"words:{min(6, words.bit_length())}", f"links:{min(3, int(dense * 3.01))}",
        f"end:{b.text[-1] in '.!?…:;'}", f"commas:{min(3, b.text.count(','))}",
        f"long:{words > 12}&links:{dense > 0.5}", f"place:{int(b.position * 4)}",
    ]
    if any(c in b.text for c in "©®™"):
        out.append("mark:copyright")
    if "in:article" not in b.around and "in:main" not in b.around:
        out.append("outside")
        out.append(f"outside&words:{min(6, words.bit_length())}")
    if before is not None and before.around == b.around:
        out.append("same")
    boiler, main = not _BOILER.isdisjoint(b.around), not _MAIN.isdisjoint(b.around)
    out += [f"boiler:{boiler}", f"main:{main}", f"main:{main}&boiler:{boiler}", f"main:{main}&boiler:{boiler}&words:{min(6, words.bit_length())}"]
    out.extend(b.around)
    return out


@dataclass
class Field:
    """Two labels: 0 boilerplate, 1 main text."""

    index: dict[str, int]
    weights: np.ndarray  # features x 2
    trans: np.ndarray  # 2 x 2
    start: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        w, index = self.weights, self.index
        t00, t01, t10, t11 = self.trans.ravel().tolist()
        memo: dict = {}
        a = b = 0.0
        back: list[tuple[int, int]] = []
        before = None
        for k, block in enumerate(blocks):
            ids = [index[f] for f in features(block, before) if f in index]
            key = tuple(sorted(ids))
            if key not in memo:
                memo[key] = w[ids].sum(0).tolist()
            e0, e1 = memo[key]
            before = block
            if k == 0:
                a, b = e0 + float(self.start[0]), e1 + float(self.start[1])
                continue
            from0 = 0 if a + t00 >= b + t10 else 1
            from1 = 0 if a + t01 >= b + t11 else 1
            a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
            back.append((from0, from1))
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 160, l2: float = 0.02, rate: float = 0.1) -> Field:
    """Maximum likelihood by full-batch Adam; the forward and backward passes
    run over all pages at once."""
    names: dict[str, int] = {}
    rows, cols = [], []
    longest, n = max(len(b) for b, _ in pages), len(pages)
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        before = None
        for t, block in enumerate(blocks):
            for f in features(block, before):
                rows.append(i * longest + t)
                cols.append(names.setdefault(f, len(names)))
            before = block
            y[i, t], mask[i, t] = labels[t], True
    rows, cols = np.array(rows), np.array(cols)
    nf, total = len(names), n * longest
    params = [np.zeros((nf, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, rounds + 1):
        w, trans, start = params
        emit = np.stack([np.bincount(rows, w[cols, k], total) for k in (0, 1)], 1).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            new = lse(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = lse(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        gold = np.eye(2)[y] * mask[:, :, None]
        diff = (marginal - gold).reshape(total, 2)
        gw = np.stack([np.bincount(cols, diff[rows, k], nf) for k in (0, 1)], 1) / n + l2 * w / n
        gt = l2 * trans / n
        for t in range(1, longest):
            live = mask[:, t]
            pair = np.exp(alpha[live, t - 1, :, None] + trans + (emit[live, t] + beta[live, t])[:, None, :] - z[live, None, None])
            gt = gt + (pair.sum(0) - np.einsum("ni,nj->ij", gold[live, t - 1], gold[live, t])) / n
        gs = diff.reshape(n, longest, 2)[:, 0].sum(0) / n
        for k, g in enumerate((gw, gt, gs)):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(names, *params)


def labelled_pages(count: int = 420, seed: int = 11, unnamed: float = 0.2) -> list[tuple[str, dict[str, int]]]:
    """Pages in invented words and the label of each block's text.  On a share
    `unnamed` of them class and id words say nothing; one in twenty is text without
    markup."""
    rng = random.Random(seed)
    silent = False
    syllables = ["".join(p) for a in "bdfglmnprst" for p in ((a, v) for v in "aeiou")] + ["é", "ü", "ß", "th", "ing", "ción", "ß"]
    serial = 0

    def words(lo: int, hi: int, plain: bool = False) -> str:
        nonlocal serial
        serial += 1
        some = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, max(lo, hi)))]
        if not plain:
            some = [w + "," if rng.random() < 0.06 else w for w in some]
            some[0] = some[0].capitalize()
        some[-1] = some[-1] + f"{serial}"  # makes each block's text unique
        noise = rng.random()
        if rng.random() < 0.03:
            some.insert(1, "©")
        if noise < 0.06:
            some = [w.upper() + "!!" for w in some]
        elif noise < 0.12:
            some = [w + rng.choice(["$$$", "%%%", "***", "###"]) for w in some]
        return " ".join(some) + ("" if plain else rng.choice([".", ".", ".", "", "!"]))

    def attr(kind: str) -> str:
        if silent:
            return f'class="{"".join(rng.choices("bcdfgjkqvwxyz", k=5))}"'
        own = KINDS.get(kind, MAIN).split()
        w = rng.choice(own)
        if rng.random() < 0.4:
            w += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "area", "list", "inner", "block", "container", rng.choice(own)])
        if rng.random() < 0.15:
            w = rng.choice(["site", "page", "block", "js", "l", "m"]) + "-" + w
        return f'{rng.choice(["class", "class", "id"])}="{w}"'

    pages = []
    for _ in range(count):
        labels: dict[str, int] = {}
        silent = rng.random() < unnamed
        if rng.random() < 0.05:
            text = words(3, 80)
            pages.append((text, {text: 1}))
            continue

        def leaf(tag: str, label: int, lo: int, hi: int, plain: bool = False, link: bool = False, labels=labels) -> str:
            text = words(lo, hi, plain)
            labels[text] = label
            inner = f'<a href="/x">{text}</a>' if link else text
            if not link and rng.random() < 0.2:
                cut = text.find(" ", len(text) // 2)
                inner = text if cut < 0 else f"{text[:cut]} <b>{text[cut + 1:]}</b>" if rng.random() < 0.7 else f'{text[:cut]} <a href="#">{text[cut + 1:]}</a>'
            if tag == "p" and rng.random() < 0.12:
                return f"<p><b>{inner}<br>"
            return f"<{tag}>{inner}</{tag}>" if tag else inner

        def links(label: int = 0) -> str:
            return "<ul>" + "".join(f"<li>{leaf('', label, 1, 3, True, True)}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"

        def paragraphs(label: int, lo: int, hi: int) -> str:
            return "".join(leaf("p", label, rng.choice([1, 2, 6, 15]), rng.choice([4, 12, 30, 60])) for _ in range(rng.randint(lo, hi)))

        def boiler(kind: str) -> str:
            semantic = rng.random() < 0.5
            tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comment": "section"}.get(kind, "div")
            if not semantic and kind != "form":
                tag = rng.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
            known = f" {attr(kind)}" if not semantic or tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
            if kind == "menu":
                inner = links()
            elif kind == "header":
                inner = leaf(rng.choice(["div", "h1", "h2", "p"]), 0, 1, 5, True, rng.random() < 0.5) + (links() if rng.random() < 0.4 else "") + (leaf("p", 0, 3, 10) if rng.random() < 0.4 else "")
            elif kind == "footer":
                inner = leaf(rng.choice(["p", "div", ""]), 0, 2, 14) + (links() if rng.random() < 0.4 else "")
            elif kind == "side":
                inner = leaf(rng.choice(["h2", "h3", "h4"]), 0, 1, 4, True) + (links() if rng.random() < 0.6 else paragraphs(0, 1, 3))
            elif kind == "form":
                inner = leaf("label", 0, 1, 5, True) + '<input type="text">' + (leaf("p", 0, 3, 20) if rng.random() < 0.5 else "")
            elif kind == "comment":
                inner = (leaf(rng.choice(["h2", "h3"]), 0, 1, 3, True) if rng.random() < 0.7 else "") + "".join(
                    f"<{t}>" + (leaf("b", 0, 1, 2, True) if rng.random() < 0.3 else "") + leaf("p", 0, 3, 40) + f"</{t}>" for t in [rng.choice(["div", "li", "article"]) for _ in range(rng.randint(1, 4))]
                )
            else:
                inner = leaf(rng.choice(["p", "div", "", "span"]), 0, 2, 25) if rng.random() < 0.7 else paragraphs(0, 1, 2)
            return f"<{tag}{known}>{inner}</{tag}>"

        body = leaf("h1", 1, 2, 10, True) if rng.random() < 0.9 else ""
        for _ in range(rng.randint(1, 4)):
            body += paragraphs(1, 1, 6)
            kind = rng.random()
            if kind < 0.12:
                body += "<ul>" + "".join(leaf("li", 1, 2, 20) for _ in range(rng.randint(2, 5))) + "</ul>"
            elif kind < 0.2:
                body += f"<blockquote>{leaf('p', 1, 5, 30)}</blockquote>"
            elif kind < 0.3:
                body += leaf(rng.choice(["h2", "h3"]), 1, 1, 7, True)
            elif kind < 0.35:
                body += "<table>" + "".join(f"<tr>{leaf('td', 1, 1, 6)}{leaf('td', 1, 1, 6)}</tr>" for _ in range(3)) + "</table>"
            elif kind < 0.5:
                body += boiler(rng.choice(["advert", "side", "share", "form", "notice"]))
        if rng.random() < 0.15:
            body += boiler("comment")
        shape = rng.random()
        if shape < 0.5:
            main = f"<article{' ' + attr('main') if rng.random() < 0.3 else ''}>{body}</article>"
            main = f"<main>{main}</main>" if rng.random() < 0.3 else main
        elif shape < 0.65:
            main = f"<main>{body}</main>"
        elif shape < 0.72:
            main = body
        else:
            main = f"<div {attr('main')}>{body}</div>"
        top = [boiler(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "side"], rng.randint(0, 4))]
        end = [boiler(k) for k in rng.sample(["footer", "footer", "comment", "comment", "side", "menu", "advert", "share", "form", "notice"], rng.randint(0, 5))]
        inner = "".join(top) + main + "".join(end)
        if rng.random() < 0.3:
            inner = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "container", "page", "outer", "layout", "site"])}">{inner}</div>'
        title = words(2, 8, True)
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{inner}</body></html>", labels))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on `labelled_pages`."""
    data = []
    for page, labels in labelled_pages():
        blocks = blocks_of(page)
        data.append((blocks, [labels[b.text] for b in blocks]))
    return train(data)


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    common.ship(pages.sparkSession)
    field = field or default_field()

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([main_text(p, field) for p in some], dtype=object)

    return pages.select("page_id", "url", text_of("html").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
