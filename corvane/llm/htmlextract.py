"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each block is
two hashed vectors, one of the tags, classes and ids on its path and one of its words, with a few counts.
A bidirectional LSTM (numpy) reads the whole sequence, so that a block is judged by all that stands before and
after it, and says for each block whether it belongs to the article. It is trained on page layouts drawn from a rule
(below), the same for every run, and pages are labelled where they lie.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

PATH_DIM, WORD_DIM, COUNTS = 512, 64, 4
#: Slots of names that are not in the training vocabulary: they tell nothing, so they share a few.
UNKNOWN = 32
HIDDEN = 16

# HTML's elements by how they break text.
RAW = {"script", "style", "textarea", "title", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br "
    "math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot semantics annotation svg g text tspan object iframe".split()
)
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What a start tag ends if it is still open, and the elements that shield it.
LISTS = {"ul", "ol", "dl", "table", "menu", "select"}
ENDS = (({"p"}, {"td", "th", "li", "div", "section", "article", "button"}), ({"li"}, LISTS), ({"dt", "dd"}, LISTS), ({"td", "th"}, LISTS), ({"tr"}, LISTS), ({"option"}, LISTS))
ENDED_BY = {"li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACES = re.compile(r"\s+")

#: A block: the set of its path's features as bits, its text, the share of it in links.
Block = tuple[int, str, float]


@lru_cache(maxsize=100_000)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(maxsize=100_000)
def _path_slot(token: str) -> int:
    """Each token of the training vocabulary has a slot of its own; all others share UNKNOWN slots, which no known one uses."""
    at = vocabulary().get(token)
    return PATH_DIM // 2 - UNKNOWN + zlib.crc32(token.encode()) % UNKNOWN if at is None else at


def path_bits(tokens: Iterable[str], before: int = 0) -> int:
    """``before`` and the bits of the tokens of one element."""
    for t in tokens:
        before |= 1 << _path_slot(t)
    return before


def leaf_bit(token: str) -> int:
    """The token of the leaf, in the other half of the slots."""
    return 1 << (PATH_DIM // 2 + _path_slot(token))


def path_of(tokens: tuple[str, ...]) -> int:
    """The features of a whole path; its last token counts as the leaf's as well."""
    return path_bits(tokens) | (leaf_bit(tokens[-1]) if tokens else 0)


@lru_cache(maxsize=20_000)
def path_vector(path: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(path.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


class _Open:
    """The open elements. What a block needs of them is kept for each level, so neither depth nor breadth of a page matters."""

    def __init__(self) -> None:
        # name, bits of the path down to here, the leaf's bit, places of the elements that a start tag would end
        self.levels: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.names: Counter[str] = Counter()

    @property
    def path(self) -> int:
        return self.levels[-1][1] | self.levels[-1][2] if self.levels else 0

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        _, bits, leaf, ends = self.levels[-1] if self.levels else ("", 0, 0, (-1,) * len(ENDS))
        if name not in INLINE:
            bits, leaf = path_bits((name, *marks), bits), leaf_bit(marks[-1] if marks else name)
        at = len(self.levels)
        ends = tuple(at if name in ended else -1 if name in shield else e for e, (ended, shield) in zip(ends, ENDS, strict=True))
        self.levels.append((name, bits, leaf, ends))
        self.names[name] += 1

    def cut(self, at: int) -> None:
        for level in self.levels[at:]:
            self.names[level[0]] -= 1
        del self.levels[at:]

    def close(self, name: str) -> None:
        """Ends the innermost element of this name, and all in it, if there is one."""
        if self.names[name]:
            at = len(self.levels) - 1
            while self.levels[at][0] != name:
                at -= 1
            self.cut(at)

    def end(self, kind: int) -> None:
        if self.levels and (at := self.levels[-1][3][kind]) >= 0:
            self.cut(at)


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order; time is linear in the page's length, whatever is nested or broken in it."""
    opened = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((opened.path, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = TOKEN.search(page, at) if at <= last else None  # beyond the last > there is no tag
        if at > last and (begun := page.find("<!--", at)) >= 0:
            n = begun
        data = page[at : m.start() if m else n]
        if data:
            parts.append(data)
            if opened.names["a"]:
                linked += len(data)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1] or m[4]:
            opened.close(name)
            continue
        attributes = m[3] or m[6] or ""
        if (name in RAW or name == "xmp") and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "xmp":  # shown as it is written
                parts.append(html.escape(page[at : end.start() if end else n]))
                flush()
            at = end.end() if end else n
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P:
            opened.end(0)
        if name in ENDED_BY:
            opened.end(ENDED_BY[name])
        if name in ("article", "main"):  # neither stands in a menu: what was open was left open
            opened.close("nav")
        if name == "body":
            opened.cut(1 if opened.levels and opened.levels[0][0] == "html" else 0)
        opened.push(name, tuple(w for a in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", "".join(a).lower()) if w))
    flush()
    return out


def text_vector(text: str, linked: float) -> np.ndarray:
    v = np.zeros(WORD_DIM + COUNTS, np.float32)
    words = text.split(" ")
    for w in words:
        v[_slot(w.lower().strip(".,!?:;()|"), WORD_DIM) if len(w) < 40 else 0] += 1
    v[:WORD_DIM] /= len(words)
    v[WORD_DIM:] = (np.log1p(len(words)) / 4, linked, text[-1] in ".!?:;", any(c.isdigit() for c in text))
    return v


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Bidirectional LSTM with one sigmoid output per block, trained by back-propagation through time."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + COUNTS
        self.p: dict[str, np.ndarray] = {"o": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32)}
        for k in "fb":
            self.p[f"x{k}"] = rng.normal(0, 0.1, (d, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{k}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{k}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)

    def _pass(self, gates: np.ndarray, mask: np.ndarray, k: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN) from input gates; padding leaves the state as it is."""
        steps, pages, _ = gates.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        hs, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p[f"h{k}"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep:
                tape.append((t, i, f, o, g, c, tanh_c, h))
            c, h = np.where(on, new_c, c), np.where(on, o * tanh_c, h)
            hs[t] = h
        return hs, tape

    def scores(self, gates: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        hs = np.concatenate([self._pass(gates[k], mask, k, False)[0] for k in "fb"], axis=2)
        return _sigmoid(hs @ self.p["o"] + self.p["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        both = {k: self._pass(x @ self.p[f"x{k}"] + self.p[f"c{k}"], mask, k, True) for k in "fb"}
        hs = np.concatenate([both[k][0] for k in "fb"], axis=2)
        out = (_sigmoid(hs @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
        grads = {"o": np.tensordot(out, hs, ((0, 1), (0, 1))), "ob": out.sum(keepdims=True).ravel()}
        for n, k in enumerate("fb"):
            into = out[:, :, None] * self.p["o"][n * HIDDEN : (n + 1) * HIDDEN]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{k}"])
            for t, i, f, o, g, c, tanh_c, h in reversed(both[k][1]):
                on = mask[t][:, None]
                total = dh + into[t]
                d = total * on
                dcell = dc * on + d * o * (1 - tanh_c**2)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), d * tanh_c * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dz @ self.p[f"h{k}"].T + total * (1 - on)
                dc = dcell * f + dc * (1 - on)
            grads |= {f"x{k}": np.tensordot(x, dz_all, ((0, 1), (0, 1))), f"h{k}": gh, f"c{k}": dz_all.sum((0, 1))}
        return grads

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are article."""
        done: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        paths = {path: n for n, path in enumerate(dict.fromkeys(b[0] for k in order for b in pages[k]))}
        if not paths:
            return done
        table = np.stack([path_vector(t) for t in paths])
        known = {k: table @ self.p[f"x{k}"][:PATH_DIM] + self.p[f"c{k}"] for k in "fb"}
        at, group = 0, []
        while at < len(order):
            group = order[at : at + 64]
            while len(group) > 1 and len(pages[group[-1]]) * len(group) > 20_000:
                group = group[: len(group) // 2]
            at += len(group)
            steps = len(pages[group[-1]])
            mask = np.zeros((steps, len(group)), bool)
            which = np.zeros((steps, len(group)), np.int64)
            texts = np.zeros((steps, len(group), WORD_DIM + COUNTS), np.float32)
            for col, k in enumerate(group):
                for t, (path, text, linked) in enumerate(pages[k]):
                    mask[t, col], which[t, col], texts[t, col] = True, paths[path], text_vector(text, linked)
            s = self.scores({k: known[k][which] + texts @ self.p[f"x{k}"][PATH_DIM:] for k in "fb"}, mask)
            for col, k in enumerate(group):
                done[k] = s[: len(pages[k]), col] > 0.5
        return done


# The vocabulary of the layouts that the labeller is trained on.
BAD_TAGS = "nav header footer aside form menu dialog button select fieldset address noscript".split()
BAD_NAMES = (
    "ad ads advert advertisement adslot banner sponsor sponsored promo promotion sidebar widget menu menubar navbar navigation navigation nav breadcrumb breadcrumbs header masthead topbar "
    "footer foot copyright cookie cookies consent notice notices alert gdpr privacy popup modal overlay newsletter subscribe subscription signup login search share sharing social buttons related "
    "recommended more comments comment commentlist respond disqus reply replies discussion reader user tags toolbar pagination pager skip legal disclaimer announcement warning complementary contentinfo"
).split()
GOOD_TAGS = "article article article main section div".split()
GOOD_NAMES = "content article post entry story text body main page prose copy".split()
NEUTRAL = "wrapper container page layout row col site root inner outer wrap grid box block section".split()
LEAVES = "p p p p li li li div h2 h3 h4 h1 h5 h6 blockquote pre td th dd dt figcaption section span address".split()
GOOD_LEAVES = [x for x in LEAVES if x not in ("span", "address")]
INSIDE = {
    "li": (("ul", "li"), ("ol", "li"), ("li",)), "td": (("table", "tr", "td"), ("table", "tbody", "tr", "td")), "th": (("table", "tr", "th"),),
    "figcaption": (("figure", "figcaption"),), "dd": (("dl", "dd"),), "dt": (("dl", "dt"),), "span": ((),), "p": (("p",), ("p",), ("blockquote", "p"), ("li", "p"), ("div", "p")),
}


@lru_cache(maxsize=1)
def vocabulary() -> dict[str, int]:
    """The known tags and names, numbered."""
    structure = ("html", "body", "table", "tbody", "thead", "tr", "ul", "ol", "dl", "figure", "span")
    inside = [t for ways in INSIDE.values() for way in ways for t in way]
    known = dict.fromkeys([*structure, *inside, *BAD_TAGS, *GOOD_TAGS, *LEAVES, *BAD_NAMES, *GOOD_NAMES, *NEUTRAL])
    assert len(known) <= PATH_DIM // 2 - UNKNOWN
    return {t: i for i, t in enumerate(known)}


#: What menus, notices and the like say, and common words of running text in some languages.
BAD_WORDS = (
    "home about contact login logout register sign menu search share tweet like follow subscribe newsletter email more read next previous back top skip content navigation "
    "cookies cookie accept privacy policy terms conditions copyright rights reserved advertisement sponsored ad related posts popular recent comments comment reply leave tags "
    "category categories archives author posted filed views print download app language english all help faq jobs careers press support sitemap powered"
).split()
TEXT_WORDS = (
    "the of and to in a is that for was with as on by it from be at which are this had not have or an were their has but "
    "le la les de des et en un une que qui dans pour sur pas est plus par il der die das und zu den von mit sich auf ist nicht ein eine als auch es an werden aus "
    "el los las del se por con una para como su al lo más pero sus"
).split()


def drawn_page(rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page layout with the label of each block: what the labeller learns from."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]

    def words(lo: int, hi: int, good: int = 1) -> str:
        n = int(rng.integers(lo, hi))
        known, share = (TEXT_WORDS, 0.35) if good or rng.random() < 0.5 else (BAD_WORDS, 0.6)
        if rng.random() < 0.3:  # in a language of which nothing is known
            share = 0.0
        said = [pick(known) if rng.random() < share else pick(BAD_WORDS) if rng.random() < 0.03 else "w%d" % rng.integers(100_000) for _ in range(n)]
        return " ".join(said) + pick([".", ".", "", "!"] if good or share == 0 else ["", "", "."])

    blocks: list[Block] = []
    labels: list[int] = []
    same = words(1, 4) if rng.random() < 0.15 else ""  # pages of one short line again and again
    unknown = lambda: "x%d" % rng.integers(1_000_000)  # noqa: E731  a name that tells nothing
    base: tuple[str, ...] = ("html", "body") if rng.random() < 0.9 else ()
    for _ in range(int(rng.integers(0, 3))):
        base += ("div", *([pick(NEUTRAL) if rng.random() < 0.7 else unknown()] if rng.random() < 0.7 else []))
    if rng.random() < 0.1:  # laid out by a table
        base += pick([("table", "tr", "td"), ("table", "tbody", "tr", "td")])
    named = rng.random() < 0.25  # pages that name every element

    def leaf(path: tuple[str, ...], name: str, good: int) -> None:
        inner = pick(INSIDE[name]) if name in INSIDE and (name != "p" or rng.random() < 0.2) else (name,)
        if named and rng.random() < 0.7:
            inner += (unknown(),)
        long = good and name in ("p", "li", "blockquote", "td") and rng.random() < 0.8
        text = words(8, 90) if long else words(1, 14, good) if rng.random() < 0.8 else words(10, 60, good)
        if same and rng.random() < 0.6:
            text = same
        linked = float(rng.random() < 0.6) if not good and name in ("li", "span") else float(rng.random() < 0.05)
        blocks.append((path_of(path + inner), text, linked))
        labels.append(good)

    def bad(path: tuple[str, ...]) -> None:
        kind = rng.random()
        if kind < 0.4:
            box: tuple[str, ...] = (pick(BAD_TAGS),) + ((pick(BAD_NAMES),) if rng.random() < 0.3 else ())
        else:
            box = (pick(["div", "div", "section", "ul", "p", "aside", "span", "ol"]), pick(BAD_NAMES)) + ((pick(BAD_NAMES),) if rng.random() < 0.2 else ())
            box = tuple(t for t in box if t not in INLINE)
        if rng.random() < 0.3:
            box += (pick(["div", "div", "section", "p", "li"]), *((pick(BAD_NAMES if rng.random() < 0.6 else NEUTRAL),) if rng.random() < 0.7 else ()))
        for _ in range(int(rng.integers(1, 5))):
            leaf(path + box, pick(LEAVES), 0)

    for _ in range(int(rng.integers(0, 4))):
        bad(base)
    n_good = int(rng.integers(1, 20)) if rng.random() < 0.9 else int(rng.integers(40, 160)) if rng.random() < 0.4 else 0
    if n_good:
        bare = rng.random() < 0.12
        box = () if bare else (pick(GOOD_TAGS),)
        if box and (box[0] in ("div", "section") or rng.random() < 0.3):
            names = pick(["known", "known", "unknown", "both", "none"])
            box += (*([unknown()] if names in ("unknown", "both") else []), *([pick(GOOD_NAMES)] if names in ("known", "both") else []))
        if box and rng.random() < 0.15:
            box += ("div", unknown())
        elif box and rng.random() < 0.4:
            box += ("div", pick(GOOD_NAMES), pick(GOOD_NAMES)) if rng.random() < 0.7 else ("section",)
        if rng.random() < 0.8:
            place = rng.random()  # headlines may stand in an element of their own, in the article or before it
            leaf(base + box if place < 0.7 else base + box + ("div", unknown()) if place < 0.85 else base + ("div", unknown()), pick(["h1", "h1", "h1", "h2"]), 1)
        for _ in range(n_good):
            if rng.random() < 0.14:
                bad(base + box)
            name = pick(GOOD_LEAVES) if rng.random() < 0.6 else "p"
            own = ("div", unknown()) if rng.random() < 0.08 else ()  # an info box, a list of references
            for _ in range(int(rng.integers(1, 5)) if name == "li" else 1):
                leaf(base + box + own, name, 1)
        if rng.random() < 0.25:  # a container that is never closed
            bad(base + box)
    for _ in range(int(rng.integers(0, 4))):
        bad(base)
    return blocks, labels


@lru_cache(maxsize=4)
def trained(n_pages: int = 2048, epochs: int = 6, seed: int = 7) -> Labeller:
    """A labeller fitted to ``n_pages`` drawn layouts by Adam; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    pages = [p for p in (drawn_page(rng) for _ in range(n_pages)) if p[0]]
    model, moments, step = Labeller(seed), {}, 0
    by_length = np.array(sorted(range(len(pages)), key=lambda k: len(pages[k][0])))
    parts = np.array_split(by_length, len(pages) // 24)  # alike in length, so little is padding
    for _ in range(epochs):
        for part in (parts[k] for k in rng.permutation(len(parts))):
            steps = max(len(pages[k][0]) for k in part)
            x = np.zeros((steps, len(part), PATH_DIM + WORD_DIM + COUNTS), np.float32)
            mask, y = np.zeros((steps, len(part)), np.float32), np.zeros((steps, len(part)), np.float32)
            for col, k in enumerate(part):
                for t, ((path, text, linked), good) in enumerate(zip(*pages[k], strict=True)):
                    x[t, col, :PATH_DIM], x[t, col, PATH_DIM:], mask[t, col], y[t, col] = path_vector(path), text_vector(text, linked), 1, good
            step += 1
            rate = 0.02 * (1 - step / (epochs * len(parts))) + 0.0005
            for name, g in model.gradients(x, mask > 0, y).items():
                m, v = moments.get(name, (0, 0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moments[name] = (m, v)
                model.p[name] = (model.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every whole page.

    Null or empty html gives an empty text; references are decoded, white space inside a block is one space,
    blocks are joined by a line feed. Repeated rows get equal results, other columns are ignored, and
    pages are labelled independently of each other (no shuffle). A very long page is read whole; an empty
    table gives an empty result; ids may be text.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained() if model is None else model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                blocks = [blocks_of(h or "") for h in part.column("html").to_pylist()]
                texts = ["\n".join(x[1] for x, ok in zip(p, keep, strict=True) if ok) for p, keep in zip(blocks, sent.value.label(blocks), strict=True)]
                cols = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    kind = id_type(pages, page_id)
    rows = pages.select(F.col(page_id).cast(kind).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
