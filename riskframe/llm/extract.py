"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text that no block-level tag parts. For each block a bidirectional LSTM in numpy reads vectors of its hashed tag path
(tags, words of class, id and role), of its hashed words and a few measures; each block is classified with both directions' states, hence in the context of the
whole page. The model is trained on the driver from a bounded sample of pages: those whose own article or main element tells which blocks count, and pages that
layouts.py composes from their texts. All pages are then labelled, whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layouts
from .common import BY_SPACE, Words, small_batches, text_bytes

#: The most pages that are learned from, those of the least hashes of their ids, and the most characters of such a page: at most 26 MB reach the driver.
SAMPLE, SAMPLE_CHARS = 400, 1 << 16
#: Composed pages to learn from.
COMPOSED = 1200
BUCKETS = 4096
PATH, LEAF, WORD, HIDDEN = 16, 8, 12, 24

# Tags of HTML.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_REGIONS = frozenset("article aside body footer form header html main nav section".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style template noscript svg canvas iframe object audio video select button textarea datalist head title".split())
#: Of these no tag is read until their own end tag.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: A start tag ends the open element of these kinds, up to the container.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}

_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*>)|/?[a-zA-Z][^>]*\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")
#: Blanks and digits count as one blank and one digit.
_FOLDED = bytes(48 if 48 <= b <= 57 else BY_SPACE[b] for b in range(256))


@lru_cache(1 << 14)
def _tokens(name: str, attributes: str) -> tuple[int, ...]:
    """Buckets of a tag, and of the words in its class, id and role and how they begin."""
    found = [name]
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("hidden", "aria-hidden") or key.lower() == "style" and re.search(r"display\s*:\s*none", value):
            found.append(".hidden")
        elif key.lower() != "style":
            pieces = sorted({x.lower() for x in _PIECES.findall(value)})
            found += [f".{x}" for x in pieces] + [f".{x[:4]}~" for x in pieces if len(x) > 4]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in found)


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    leaf: tuple[int, ...]
    links: int
    depth: int
    parent: int
    heading: bool
    names: tuple[str, ...] = ()


def blocks(page: str) -> list[Block]:
    """Blocks of a page in their order, with character references decoded and white space turned into single blanks; empty ones left out. Tags may be unclosed
    or misplaced, comments, quotes and raw elements unfinished."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], int]] = [("", (), 0)]
    pieces: list[str] = []
    links = skipped = at = seen = 0
    link: int | None = None  # the depth at which a link was opened
    hidden: list[str] = []  # dropped elements that are open

    def close() -> None:
        nonlocal links
        if pieces:
            if text := " ".join("".join(pieces).split()):
                near = stack[-32:]  # of deeper nesting the innermost elements count
                out.append(Block(text, tuple(t for x in near for t in x[1]), stack[-1][1], min(links, len(text)), len(stack), stack[-2][2] if len(stack) > 1 else 0, stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit(), tuple(x[0] for x in near)))
            pieces.clear()
            links = 0

    def cut(depth: int) -> None:
        nonlocal link
        del stack[depth:]
        if link is not None and link > len(stack):
            link = None

    def say(text: str) -> None:
        nonlocal links
        if text and not hidden:
            if "&" in text:
                text = entities.unescape(text)
            pieces.append(text)
            if link is not None:
                links += len(text)

    while m := _MARKUP.search(page, at):
        say(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if hidden:
                if name in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                    continue
                if name not in _REGIONS or _RAW & set(hidden):
                    continue
                hidden.clear()  # an unclosed button or select ends with its region
            if name == "a":
                link = None
            elif name in _BLOCKS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0) if name in (x[0] for x in stack[-64:]) else 0
                close()
                if depth:
                    cut(depth)
            continue
        if name in _DROPPED and not m[3].endswith("/>"):
            hidden.append(name)
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if hidden:
            if name == "body":
                hidden.clear()  # an unclosed head
            else:
                continue
        if name == "br":
            say(" ")
        elif name == "a":
            link = len(stack)
        elif name in _BLOCKS:
            close()
            if stack[-1][0] == "p":
                cut(len(stack) - 1)
            if name in _ENDS:
                same, bounds = _ENDS[name]
                for i in range(len(stack) - 1, max(0, len(stack) - 64), -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in same:
                        cut(i)
                        break
            if name not in _VOID:
                seen += 1
                stack.append((name, _tokens(name, m[3]), seen))
    say(page[at:])
    close()
    return out


@dataclass
class Sequences:
    """Blocks of some pages, one after the other: tokens of block i are path[path_at[i]:path_at[i + 1]], and so on."""

    lengths: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    leaf: np.ndarray
    leaf_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    measures: np.ndarray
    _uses: list | None = None

    def uses(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind of token: how many a block has; the blocks that use the tokens, token by token; where each token starts; the tokens."""
        if self._uses is None:
            self._uses = []
            for found, at in ((self.path, self.path_at), (self.leaf, self.leaf_at), (self.words, self.words_at)):
                order = np.argsort(found, kind="stable")
                own, starts = np.unique(found[order], return_index=True)
                n = np.diff(at)
                self._uses.append((n, np.repeat(np.arange(len(n)), n)[order], starts, own))
        return self._uses


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))))
    return np.fromiter((x for part in lists for x in part), np.int64, int(at[-1])), at


def sequences(pages: list[list[Block]]) -> Sequences:
    every = [b for page in pages for b in page]
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    texts = [b.text.encode("utf-8", "replace") for b in every]
    words = Words(texts, _FOLDED)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[edges])
    size = np.diff(edges).astype(np.float64)
    chars = np.fromiter((len(b.text) for b in every), np.float64, len(every))
    n_words = np.diff(words.bounds).astype(np.float64)
    page = np.repeat(np.arange(len(pages)), lengths)
    plain = chars - np.fromiter((b.links for b in every), np.float64, len(every))
    total = np.bincount(page, plain, len(pages))[page] + 1
    parents = np.fromiter((b.parent for b in every), np.int64, len(every)) + page * (1 << 32)
    _, of = np.unique(parents, return_inverse=True)
    beside = np.bincount(of, plain)[of] if len(every) else plain
    count = lengths[page].astype(np.float64)
    place = np.arange(len(every)) - (np.cumsum(lengths) - lengths)[page]
    tail = np.frombuffer(b"".join(t[-1:] for t in texts), np.uint8)
    measures = np.stack([
        np.log1p(chars) / 4, np.log1p(n_words) / 3, 1 - plain / np.maximum(chars, 1), share(np.isin(raw, list(b".,;:!?"))) / np.maximum(n_words, 1), np.isin(tail, list(b".!?:")).astype(float), 4 * share((raw >= 48) & (raw <= 57)) / np.maximum(size, 1),
        share((raw >= 65) & (raw <= 90)) / np.maximum(n_words, 1), place / np.maximum(count, 1), np.log1p(count) / 4, np.fromiter((b.depth for b in every), np.float64, len(every)) / 10, np.fromiter((b.heading for b in every), np.float64, len(every)), plain / total, beside / total,
    ], axis=1).astype(np.float32) if every else np.zeros((0, MEASURES), np.float32)
    return Sequences(lengths, *_ragged([b.path for b in every]), *_ragged([b.leaf for b in every]), (words.hashes >> np.uint64(52)).astype(np.int64), words.bounds, measures)


MEASURES = 13
_INPUT = PATH + LEAF + WORD + MEASURES


def _means(table: np.ndarray, found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean row of the table for each part; in slices, as blocks may be long."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1)
        some = np.flatnonzero(at[lo + 1 : hi + 1] > at[lo:hi])
        if len(some):
            sums = np.add.reduceat(table[found[at[lo] : at[hi]]], at[lo:hi][some] - at[lo], axis=0)
            out[lo + some] = sums / (at[lo + 1 : hi + 1] - at[lo:hi])[some, None]
        lo = hi
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _steps(lengths: np.ndarray, back: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Blocks in the order in which the LSTM reads them, longest pages first, and the slice of each step."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    parts, slices, done = [], [], 0
    for t in range(int(lengths[0]) if len(lengths) else 0):
        k = int(np.searchsorted(-lengths, -t, "left"))
        parts.append(starts[:k] + (lengths[:k] - 1 - t if back else t))
        slices.append((done, done + k))
        done += k
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), slices


class _Direction:
    """An LSTM over packed steps; gates in the order input, forget, output, candidate."""

    def __init__(self, weights: dict[str, np.ndarray], name: str):
        self.w, self.u, self.b, self.name = weights[f"w{name}"], weights[f"u{name}"], weights[f"b{name}"], name

    def read(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        self.at, self.slices = _steps(lengths, self.name == "b")
        self.x = x[self.at]
        self.z = self.x @ self.w + self.b
        n = len(x)
        self.c, self.h, self.c0, self.h0 = (np.zeros((n, HIDDEN), np.float32) for _ in range(4))
        h = c = np.zeros((len(lengths), HIDDEN), np.float32)
        for a, b in self.slices:
            h, c = h[: b - a], c[: b - a]
            self.h0[a:b], self.c0[a:b] = h, c
            z = self.z[a:b]
            z += h @ self.u
            z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            c = f * c + i * g
            h = o * np.tanh(c)
            self.c[a:b], self.h[a:b] = c, h
        out = np.empty_like(self.h)
        out[self.at] = self.h
        return out

    def learn(self, d: np.ndarray, gradients: dict[str, np.ndarray]) -> np.ndarray:
        """Adds to the gradients; returns that of x."""
        d, dz = d[self.at], np.empty_like(self.z)
        after_h = after_c = np.zeros((0, HIDDEN), np.float32)
        for a, b in reversed(self.slices):
            i, f, o, g = (self.z[a:b, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh, dc = d[a:b].copy(), np.zeros((b - a, HIDDEN), np.float32)
            dh[: len(after_h)] += after_h
            dc[: len(after_c)] += after_c
            t = np.tanh(self.c[a:b])
            dc += dh * o * (1 - t * t)
            dz[a:b] = np.concatenate([dc * g * i * (1 - i), dc * self.c0[a:b] * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            after_h, after_c = dz[a:b] @ self.u.T, dc * f
        gradients[f"w{self.name}"] += self.x.T @ dz
        gradients[f"u{self.name}"] += self.h0.T @ dz
        gradients[f"b{self.name}"] += dz.sum(axis=0)
        out = np.empty((len(dz), _INPUT), np.float32)
        out[self.at] = dz @ self.w.T
        return out


class Labeller:
    """Probability of each block to be main text."""

    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        table = lambda d: (rng.standard_normal((BUCKETS, d)) * 0.3).astype(np.float32)
        self.weights = {"path": table(PATH), "leaf": table(LEAF), "word": table(WORD), "out": small(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.weights |= {f"w{k}": small(_INPUT, 4 * HIDDEN), f"u{k}": small(HIDDEN, 4 * HIDDEN), f"b{k}": np.zeros(4 * HIDDEN, np.float32)}
            self.weights[f"b{k}"][HIDDEN : 2 * HIDDEN] = 1

    def _read(self, s: Sequences) -> tuple[np.ndarray, list[_Direction], np.ndarray]:
        w = self.weights
        x = np.concatenate([_means(w["path"], s.path, s.path_at), _means(w["leaf"], s.leaf, s.leaf_at), _means(w["word"], s.words, s.words_at), s.measures], axis=1)
        both = [_Direction(w, k) for k in "fb"]
        h = np.concatenate([d.read(x, s.lengths) for d in both], axis=1)
        return _sigmoid(h @ w["out"] + w["bias"])[:, 0], both, h

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        s = sequences(pages)
        return np.split(self._read(s)[0], np.cumsum(s.lengths)[:-1]) if len(pages) else []

    def gradients(self, s: Sequences, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of the blocks."""
        p, both, h = self._read(s)
        w, out = self.weights, {k: np.zeros_like(v) for k, v in self.weights.items()}
        d = ((p - y) / max(1, len(y))).astype(np.float32)[:, None]
        out["out"], out["bias"] = h.T @ d, d.sum(axis=0)
        dh = d @ w["out"].T
        dx = sum(x.learn(dh[:, k * HIDDEN : (k + 1) * HIDDEN], out) for k, x in enumerate(both))
        lo = 0
        for (name, width), (n, rows, starts, found) in zip((("path", PATH), ("leaf", LEAF), ("word", WORD)), s.uses()):
            if len(found):
                out[name][found] = np.add.reduceat((dx[:, lo : lo + width] / np.maximum(n, 1)[:, None])[rows], starts, axis=0)
            lo += width
        return out

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], *, epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam, with a rate that falls to nothing. Pages of like lengths go together, so that few steps are read by few pages."""
        rng = np.random.default_rng(seed)
        kept = sorted((i for i, page in enumerate(pages) if page), key=lambda i: (len(pages[i]), rng.random()))
        groups = [kept[a : a + batch] for a in range(0, len(kept), batch)]
        ready = [(sequences([pages[i] for i in g]), np.concatenate([labels[i] for i in g]).astype(np.float32)) for g in groups]
        mean, square = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        steps, t = epochs * len(ready), 0
        for _ in range(epochs):
            for i in rng.permutation(len(ready)):
                g = self.gradients(*ready[i])
                t += 1
                lr = rate * (1 - (t - 1) / steps)
                for k, v in self.weights.items():
                    mean[k] += 0.1 * (g[k] - mean[k])
                    square[k] += 0.001 * (g[k] * g[k] - square[k])
                    v -= lr * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _own_labels(page: list[Block]) -> np.ndarray | None:
    """Where a page has main text by its own article or main element: 1 for its blocks, but not for those of elements that say they are something else."""
    inside = np.array([layouts.says_main(b.names) for b in page], bool)
    if not inside.any() or inside.all():
        return None
    other = {zlib.crc32(f".{w}".encode()) % BUCKETS for w in layouts.OTHER_WORDS}
    return np.array([m and not (layouts.says_other(b.names) or other & set(b.path)) for m, b in zip(inside, page)], np.float32)


def _disguised(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with some of its telling tags called div: what tags don't tell has to be learned from the rest."""
    div = _tokens("div", ">")[0]
    gone = {_tokens(t, ">")[0] for t in ("article", "main", "nav", "header", "footer", "aside", "section") if rng.random() < 0.5}
    return [Block(b.text, tuple(div if t in gone else t for t in b.path), tuple(div if t in gone else t for t in b.leaf), b.links, b.depth, b.parent, b.heading, b.names) for b in page]


def fit(pages: DataFrame, *, sample: int = SAMPLE, composed: int = COMPOSED, page_id: str = "page_id", html: str = "html") -> Labeller:
    """The labeller that a sample of the pages gives, the same however they are dealt. Without any, it learns from composed pages alone."""
    known = pages.select(F.col(page_id).cast("string").alias("id"), F.col(html).alias("h")).where(F.length("h").between(1, SAMPLE_CHARS))
    known = known.withColumn("k", F.concat_ws(":", F.md5(F.coalesce(F.col("id"), F.lit("")).cast("binary")), F.md5(F.col("h").cast("binary"))))
    # The sample is drawn from hashes; no other page is moved. Rows that repeat a page count once.
    drawn = known.groupBy("k").agg(F.lit(1).alias("one")).orderBy("k").limit(sample).select("k")
    rows = sorted(known.join(F.broadcast(drawn), "k").groupBy("k").agg(F.min("h").alias("h")).collect())
    own = [blocks(r["h"]) for r in rows]
    rng = np.random.default_rng(11)
    texts = [b.text.split() for page in own for b in page if len(b.text) > 60 and b.links * 2 < len(b.text)]
    learned, labels = [], []
    for page in own:
        if (y := _own_labels(page)) is not None:
            learned += [page, _disguised(page, rng)]
            labels += [y, y]
    for k in range(composed):
        page = blocks(layouts.compose(k, texts))
        y = np.array([layouts.MARK in b.text for b in page], np.float32)
        for b in page:
            b.text = " ".join(b.text.replace(layouts.MARK, "").split())
            b.links = min(b.links, len(b.text))
        learned.append(page)
        labels.append(y)
    return Labeller().fit(learned, labels)


def main_text(page: list[Block], probabilities: np.ndarray) -> str:
    return " ".join(b.text for b, p in zip(page, probabilities) if p >= 0.5)


def extract(pages: DataFrame, model: Labeller | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; a row for each row of pages, repeated ones alike.

    text is the page's main blocks in their order, joined by a blank: character references decoded, all Unicode white space within a block turned into one blank.
    Null and empty pages, and pages without main text, have an empty text. Whole pages are read, however long or malformed; bytes that aren't UTF-8 become
    U+FFFD. Null ids and urls stay; other columns aren't looked at. Without a model, one is fitted on the pages.
    """
    spark = pages.sparkSession
    known = spark.sparkContext.broadcast(model or fit(pages, page_id=page_id, html=html))
    small_batches(spark)
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(t.decode("utf-8", "replace")) for t in batch["t"].to_pylist()]
            texts = [main_text(page, p) for page, p in zip(found, known.value.probabilities(found))]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(html).alias("t")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
