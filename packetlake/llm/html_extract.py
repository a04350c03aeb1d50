"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks of text. Each block is a vector of hashed tag-path elements (tags with their class and id
words), hashed words and a few measures, among them how much of the page's text stands under the same tags. A
bidirectional LSTM in numpy reads a page's blocks and labels each one as main text or not, so a block is judged in the
context of the whole page.

It is trained here on pages of which the truth is known because they are built here: texts of a bounded sample of the pages
(PAGES of them, chosen by a hash of the html) become articles and, around and inside them, menus, notices, adverts, forms,
shares and comments, in VARIANTS layouts each: with telling names, with made-up ones, with an article of made-up name or
none among telling tags, and without classes; some laid out by tables, some with an article of line breaks, some with
nothing beside it. So places, links and lengths must decide. No label comes from the sample's own markup.

Edge cases: a null or empty page has an empty text; unclosed, misnested and unescaped markup is read as far as it goes, and
a stray quote ends with its tag; scripts, styles and comments never become blocks; pages of any number of blocks are read
whole; repeated pages agree; an empty table gives an empty result; extra columns are ignored.
"""

import functools
import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

PAGES, VARIANTS, HIDDEN, PATH, WORDS, EPOCHS = 120, 10, 16, 96, 32, 14
EXTRA = 10
SIZE = PATH + WORDS + EXTRA

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>][^\s<>]*))?)*(?=[\s/]*>)|[^>]*)[\s/]*>|<[!?][^>]*>|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
#: Elements that stand inside a line, that have no content, and that a new one of their kind closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
OPENS_BLOCK = frozenset("address article aside blockquote body center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
def blocks(page: str) -> list[tuple[str, list[str], int]]:
    """(text, path, letters inside links) of every leaf block with text, in page order. The path holds tags and tag.name words."""
    out: list = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = depth = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, [x for _, names in stack for x in names], linked))
            parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if depth:
                linked += len(piece)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag in INLINE:
            if tag == "br":
                parts.append("\n")
            elif tag == "a":
                depth = 0 if closing else 1
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            depth = 0
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in OPENS_BLOCK else ())
        if shut:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in ("div", "table", "ul", "ol", "article", "section", "main", "aside", "nav"):
                    break
        if tag not in VOID:
            names = [tag]
            for kind, *value in _NAMES.findall(m.group(4)) if m.group(4) else ():
                names += [f"{kind.lower()}.{w.lower()}" for w in _WORD.findall("".join(value))]
            stack.append((tag, names))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@functools.lru_cache(200_000)
def _place(word: str) -> int:
    return zlib.crc32(word.encode())


def vectors(page: list[tuple[str, list[str], int]]) -> np.ndarray:
    x = np.zeros((len(page), SIZE), np.float32)
    sizes = np.array([len(text) for text, _, _ in page], float)
    links = np.array([linked for _, _, linked in page], float)
    outer = ["/".join(path[:-1]) for _, path, _ in page]
    # text under the same tags, as a share of the page's, and the links in it
    own, under, linked_under = defaultdict(list), defaultdict(float), defaultdict(float)
    for k, (_, path, _) in enumerate(page):
        own[outer[k]].append(k)
        at = ""
        for name in path:
            at += "/" + name
            under[at] += sizes[k]
            linked_under[at] += links[k]
    total = sizes.sum() or 1.0
    marks: dict[str, list[int]] = {}
    for k, (text, path, linked) in enumerate(page):
        whole = "/".join(path)
        if whole not in marks:
            marks[whole] = [at for name in path for h in (_place(name.split(".")[-1]),) for at in (h % PATH, (h >> 12) % PATH)]
        x[k, marks[whole]] = 1
        words = text.split()
        if words:
            x[k, PATH : PATH + WORDS] = np.bincount([_place(w) % WORDS for w in words], minlength=WORDS) * (3 / len(words))
        n = len(text)
        near = own[outer[k]]
        at = "".join("/" + name for name in path[:-1])
        x[k, PATH + WORDS :] = (
            np.log1p(n) / 6, min(1, linked / n), np.log1p(len(words)) / 5, text.count(".") / max(1, len(words)), k / max(1, len(page) - 1), text[-1:] in ".!?",
            sizes[near].sum() / total, min(1, links[near].sum() / max(1, sizes[near].sum())), under[at] / total, np.log1p(len(near)) / 3,
        )
    return x


class Labeller:
    """Bidirectional LSTM over a batch of block sequences, padded; logistic output for each block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        scale = 1 / np.sqrt(SIZE)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = r.normal(0, scale, (SIZE, 4 * hidden))
            self.p["u" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1
            self.p["b" + d] = b
        self.p["v"] = r.normal(0, 0.2, (2 * hidden,))
        self.p["s"] = r.normal(0, scale, (SIZE,))  # the block itself also speaks directly
        self.p["c"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x, mask, d):
        p, h = self.p, self.h
        n, t, _ = x.shape
        gates = x @ p["w" + d] + p["b" + d]
        hs, cs, acts = (np.zeros((n, t, k), np.float32) for k in (h, h, 4 * h))
        hp, cp = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[:, k] + hp @ p["u" + d]
            a = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            a[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            i, f, o, g = a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :]
            m = mask[:, k, None]
            c = (f * cp + i * g) * m
            hh = o * np.tanh(c) * m
            hs[:, k], cs[:, k], acts[:, k] = hh, c, a
            hp, cp = hh, c
        return hs, cs, acts

    def forward(self, x, mask):
        f, b = self._pass(x, mask, "f"), self._pass(x, mask, "b")
        both = np.concatenate([f[0], b[0]], 2)
        z = both @ self.p["v"] + x @ self.p["s"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (f, b, both)

    def gradients(self, x, mask, y):
        out, (f, b, both) = self.forward(x, mask)
        h = self.h
        dz = (out - y) * mask / mask.sum()
        g = {"v": np.einsum("nt,nth->h", dz, both), "s": np.einsum("nt,nth->h", dz, x), "c": np.array([dz.sum()])}
        dh_all = dz[..., None] * self.p["v"]
        for d, (hs, cs, acts), dh_own in (("f", f, dh_all[..., :h]), ("b", b, dh_all[..., h:])):
            t = x.shape[1]
            dgates = np.zeros_like(acts)
            dh_next, dc_next = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            order = list(range(t)) if d == "f" else list(range(t - 1, -1, -1))
            for q in range(t - 1, -1, -1):
                k = order[q]
                prev = order[q - 1] if q else None
                cp = cs[:, prev] if prev is not None else 0.0
                a, m = acts[:, k], mask[:, k, None]
                i, fg, o, gg = a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :]
                tc = np.tanh(cs[:, k])
                dh = (dh_own[:, k] + dh_next) * m
                dc = (dh * o * (1 - tc * tc) + dc_next) * m
                dgates[:, k] = np.concatenate([dc * gg * i * (1 - i), dc * cp * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dh_next, dc_next = dgates[:, k] @ self.p["u" + d].T, dc * fg
            hp = np.zeros_like(hs)
            if d == "f":
                hp[:, 1:] = hs[:, :-1]
            else:
                hp[:, :-1] = hs[:, 1:]
            g["w" + d] = np.einsum("ntx,ntg->xg", x, dgates, optimize=True)
            g["u" + d] = np.einsum("nth,ntg->hg", hp, dgates, optimize=True)
            g["b" + d] = dgates.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02, size: int = 48):
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        r = np.random.default_rng(3)
        for e in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k][0]) + r.integers(0, 8)))
            groups = [order[k : k + size] for k in range(0, len(order), size)]
            r.shuffle(groups)
            for group in groups:
                x, mask, y = _pad([pages[k][0] for k in group], [pages[k][1] for k in group])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= np.float32(rate) * (0.98**e) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, xs: list[np.ndarray], size: int = 128) -> list[np.ndarray]:
        """For each page, which blocks are main text."""
        out: list = [np.zeros(0, bool)] * len(xs)
        order = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, min(size, 60_000 // len(xs[order[min(at + size, len(order)) - 1]])))]
            x, mask, _ = _pad([xs[k] for k in group])
            got = self.forward(x, mask)[0] > 0.5
            for n, k in enumerate(group):
                out[k] = got[n, : len(xs[k])]
            at += len(group)
        return out


def _pad(xs, ys=None):
    t = max(len(x) for x in xs)
    x, mask, y = np.zeros((len(xs), t, SIZE), np.float32), np.zeros((len(xs), t), np.float32), np.zeros((len(xs), t), np.float32)
    for k, v in enumerate(xs):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
        if ys is not None:
            y[k, : len(v)] = ys[k]
    return x, mask, y


#: Layouts of built pages: containers of an article, and of what is not one, with the leaves that go into each.
BOXES = (["article"], ["main"], ["main", "article"], ["div", "class.content"], ["div", "class.post"], ["div", "id.content"], ["div", "class.article", "class.body"], ["div", "class.entry", "class.content"], ["section", "class.story"], ["main", "div", "class.text"])
BARS = (["nav"], ["header"], ["ul", "class.menu"], ["div", "id.menu"], ["div", "class.breadcrumb"], ["div", "class.site", "class.header"], ["div", "class.top"], ["div", "class.skip"])
ASIDES = (["aside"], ["div", "class.sidebar"], ["div", "class.ad"], ["div", "id.ad"], ["div", "class.advert"], ["div", "class.banner"], ["div", "class.promo"], ["div", "class.sponsored"], ["div", "class.related"], ["div", "class.newsletter"], ["div", "class.social"], ["div", "class.share"], ["div", "class.widget"])
NOTICES = (["div", "class.cookie"], ["div", "class.cookie", "class.notice"], ["div", "id.consent"], ["form"], ["form", "class.search"], ["div", "class.login"], ["div", "class.subscribe"])
ENDS = (["footer"], ["div", "class.footer"], ["div", "id.footer"])
TALKS = (["section", "class.comments"], ["div", "id.comments"], ["div", "class.comment"], ["div", "class.respond"], ["ol", "class.commentlist"])
SAYINGS = ("Copyright 2024", "© 2023 All rights reserved", "We use cookies", "Accept", "Subscribe", "Share", "Search", "Read more", "Log in", "Sign up", "Leave a reply", "Reply", "Home", "About", "Contact", "Privacy policy", "Terms", "Previous", "Next", "Advertisement")


#: How a built page names things: telling names; made-up ones, tags too in most; an article of made-up name among telling tags; no classes at all.
STYLES = ("telling", "plain", "opaque", "bare")


def variant(texts: list[str], r: np.random.Generator, style: str) -> tuple[list[tuple[str, list[str], int]], list[int]]:
    """The blocks of a page built from given texts, and which of them are the article."""
    pick = lambda x: x[r.integers(len(x))]
    some = lambda: texts[r.integers(len(texts))]
    short = lambda: " ".join(some().split()[: r.integers(1, 9)]) or "x"
    saying = lambda: pick(SAYINGS) if r.random() < 0.5 else short()
    page, labels = [], []

    def add(text, path, linked=0, label=0):
        page.append((text, path, linked))
        labels.append(label)

    base = ["html", "body"] + pick(([], [], ["div", "id.page"], ["div", "class.wrapper"], ["div", "class.container"]))
    cells = r.random() < 0.12  # laid out by a table
    if cells:
        base = base + ["table", "tbody", "tr", "td"]
    alone = r.random() < 0.08  # nothing but the article

    def junk(kinds, linked, at=(), long=0.2):
        box = base + list(at) + ([] if cells and r.random() < 0.7 else pick(kinds))
        leaf = pick((["ul", "li"], ["p"], ["div"], ["h3"], [], [], ["label"]))
        for _ in range(r.integers(1, 7)):
            t = some() if r.random() < long else saying()
            add(t, box + leaf, len(t) if r.random() < linked else 0)

    if r.random() < 0.6:
        add(short(), ["html", "head", "title"])
    for kinds, chance, linked in ((NOTICES, 0.2, 0.2), (BARS, 0.8, 0.9), (ASIDES, 0.4, 0.4), (NOTICES, 0.2, 0.2)):
        if r.random() < chance and not alone:
            junk(kinds, linked)
    box = [] if cells and r.random() < 0.7 else pick(BOXES)
    if style == "opaque":
        box = pick((["div"], ["div", "class." + chr(97 + r.integers(26)) + chr(97 + r.integers(26))], ["div", "class." + chr(97 + r.integers(26)) + str(r.integers(9))], ["div", "div"], ["section"]))
    listed = r.random() < 0.12  # an article that is a list
    breaks = r.random() < (0.4 if style == "bare" else 0.2)  # an article of text and line breaks: a few long blocks right in its box
    if r.random() < 0.8:
        add(short(), base + box + pick(([], [], ["header"])) + [pick(("h1", "h1", "h2"))], 0, 1)
    leaves = (["p"], ["p"], ["p"], ["p"], ["p"], ["div", "p"], ["ul", "li"], ["blockquote", "p"], ["h2"], ["h3"], ["pre"], ["section", "p"], ["table", "tbody", "tr", "td"], ["figure", "figcaption"])
    for _ in range(r.integers(1, 4) if breaks else r.integers(1, 14)):
        if breaks:
            add(" ".join(some() for _ in range(r.integers(2, 8))), base + box, 0, 1)
            continue
        leaf = pick((["ol", "li"], ["ul", "li"])) if listed and r.random() < 0.8 else pick(leaves)
        t = short() if leaf[-1] in ("h2", "h3", "td", "figcaption") or r.random() < 0.25 else some()
        add(t, base + box + leaf, 0 if r.random() < 0.9 else len(t) // 2, 1)
        if r.random() < 0.1:
            junk(ASIDES + NOTICES[:3], 0.4, box)
    if r.random() < 0.15:
        junk(TALKS, 0.1, box, 0.4)
    for kinds, chance, linked, long in ((TALKS, 0.35, 0.1, 0.5), (ASIDES, 0.4, 0.5, 0.2), (NOTICES, 0.15, 0.2, 0.2), (ENDS, 0.8, 0.3, 0.2)):
        if r.random() < chance and not alone:
            junk(kinds, linked, (), long)
    if style == "bare":
        level = r.random() < 0.5  # nor any tag that tells
        flat = lambda x: "div" if level and x in ("nav", "header", "footer", "aside", "article", "main", "section", "form") else x
        page = [(t, [flat(x) for x in path if "." not in x], linked) for t, path, linked in page]
    if style == "plain":
        made: dict[str, str] = {}
        tags = {"nav": "div", "aside": "div", "footer": "div", "header": "div", "article": "div", "main": "div", "section": "div"} if r.random() < 0.7 else {}
        name = lambda x: made.setdefault(x, f"{x.split('.')[0]}.{chr(97 + r.integers(26))}{chr(97 + r.integers(26))}") if "." in x else tags.get(x, x)
        page = [(t, [name(x) for x in path], linked) for t, path, linked in page]
    return page, labels


def train(pages: DataFrame, sample: int = PAGES) -> Labeller:
    """Learn from VARIANTS built pages for each of the `sample` pages with the smallest hash (a top-k of a fixed size)."""
    rows = pages.where("html is not null").select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(sample).collect()
    r = np.random.default_rng(17)
    data = []
    for row in rows:
        texts = [t for t, _, _ in blocks(row["html"])]
        for k in range(VARIANTS if texts else 0):
            page, labels = variant(texts, r, STYLES[(0, 1, 2, 3, 3)[k % 5]])
            data.append((vectors(page), np.array(labels, float)))
    model = Labeller()
    return model.fit(data) if data else model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                cut = [blocks(x or "") for x in part.column(2).to_pylist()]
                main = model.label([vectors(p) for p in cut])
                texts = ["\n".join(t for (t, _, _), ok in zip(p, m) if ok) for p, m in zip(cut, main)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
