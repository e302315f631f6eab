"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine on sentences.

The kernel of two segments (a word, or two short fragments with the blank between them) compares
their common subsequences of three letters with up to two characters between neighbours, each gap
costing a factor DECAY, normalised to 1 for equal segments; the sum of its powers SHARPEN is taken, a tolerant and a strict one (kernel values under LEAST count as 0).
Characters that aren't letters, blanks among them, are gaps themselves (common digit and sign stand-ins
count as letters), and doubled letters count once, so insults with inserted or doubled characters, or broken by a blank, keep much of their
kernel value. The kernel of two sentences is the sum over their distinct segments (a convolution
kernel), mapped by Nystroem landmarks.

Training: sentences of a bounded sample of labelled documents, which carry their document's label. In a clean
document all are negative; in a toxic one at least one is positive, but not known which: the machine is fitted in rounds, in
which a toxic document's positives are its highest sentence and the others beyond the boundary (multiple-instance
learning), each also with but one of its telling words, and that disguised. A document's score is the margin of its highest
sentence, calibrated on documents that a machine of the rest of the sample hasn't seen (the landmarks come from the whole sample).
As the decision function is a sum over segments, a segment's share is computed once and kept.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.7
GAP = 3
SHARPEN = (3, 10)
LEAST = 0.3
LONGEST = 24
STRETCH = 50
FOLDS = 3
SIZE = 32**3
#: Characters that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_][ ]){2,}[^\W_](?![^\W_])")
_DOUBLED = re.compile(r"([^\W\d_])\1+")
_DOTTED = re.compile(r"(?:[^\W_][-._*])+[^\W_]")
_MARKED = re.compile(r"([^\W_])[-._*]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


#: A worker's store of shares, kept from task to task of one model.
_SHARES: dict[int, tuple[dict[str, float], dict[str, float]]] = {}


def sentences_of(text: str, usual: frozenset[str] = frozenset()) -> Iterator[set[str]]:
    """The segments of each sentence, lower-cased: words, pairs of fragments of at most four characters that aren't both usual words, and letters spelled out one by one.

    Sentences end at line ends and at marks before white space; one of more than STRETCH words is cut into stretches.
    """
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        for k in range(0, len(words), STRETCH):
            part = words[k : k + STRETCH]
            own = set(part)
            if len(part) > 1:
                own.update([f"{x} {y}" for x, y in zip(part, part[1:]) if len(x) < 5 and len(y) < 5 and not (x in usual and y in usual)])
                if min(map(len, part)) == 1:
                    own.update(m[0].replace(" ", "") for m in _SPELLED.finditer(" ".join(part)))
            yield own


def bare(segment: str) -> str:
    """A segment without outer punctuation, without marks between single letters, and with doubled letters once."""
    out = segment.strip(_EDGES).rstrip("!")
    if len(out) > 4 and out[1] in "-._*" and _DOTTED.fullmatch(out):
        out = _MARKED.sub(r"\1", out)
    return _DOUBLED.sub(r"\1", out)


def _codes() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        ch = STAND_INS.get(chr(c), chr(c))
        if "a" <= ch <= "z":
            table[c] = ord(ch) - 96
        elif ch.isalpha():
            table[c] = 27 + c % 5
    return table


CODES = _codes()
#: Which keys are triples of three letters.
WHOLE = (np.arange(SIZE) >= 1024) & (np.arange(SIZE) // 32 % 32 > 0) & (np.arange(SIZE) % 32 > 0)


def letters_of(tokens: list[str]) -> np.ndarray:
    """Letter codes of tokens (of at most LONGEST characters, so that the table stays narrow), 0 for gaps and after the end."""
    size = np.array([len(t) for t in tokens], np.int64)
    width = max(3, int(size.max(initial=0)))
    raw = np.zeros((len(tokens), width), np.int32)
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    raw[np.arange(width)[None, :] < size[:, None]] = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], 27 + points % 5)
    return raw


def places(raw: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps the triple that begins at each letter, and its value. Places with a gap in the triple have a key with a zero digit."""
    width = raw.shape[1]
    for d in range(1, GAP + 1):
        pair = raw[:, : width - d] * 1024 + raw[:, d:] * 32
        for e in range(1, GAP + 1):
            if d + e < width:
                yield pair[:, : width - d - e] + raw[:, d + e :], DECAY ** (d + e - 2)


def occurrences(tokens: list[str], kept: np.ndarray = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, triple and value of each place of a subsequence whose triple is kept, and for each row the sum of squared values of all places."""
    rows, keys, values, total = [], [], [], np.zeros(len(tokens))
    for key, value in places(letters_of(tokens)):
        total += WHOLE[key].sum(1) * value**2
        at = np.nonzero(kept[key])
        rows.append(at[0])
        keys.append(key[at])
        values.append(np.full(len(at[0]), value))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), total
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(values), total


def triples(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, triple and value of the normalised feature vectors of tokens."""
    row, key, value, _ = occurrences(tokens)
    both, where = np.unique(row * SIZE + key, return_inverse=True)
    value = np.bincount(where, value, len(both))
    row, key = both // SIZE, both % SIZE
    norm = np.sqrt(np.bincount(row, value**2, len(tokens)))
    return row, key, value / norm[row]


def pieces(token: str) -> list[str]:
    """A long token's overlapping windows."""
    if len(token) <= LONGEST:
        return [token]
    return [token[k : k + LONGEST] for k in range(0, len(token) - LONGEST // 2, LONGEST // 2)]


def dense(tokens: list[str]) -> np.ndarray:
    out = np.zeros((len(tokens), SIZE), np.float32)
    row, key, value = triples(tokens)
    out[row, key] = value
    return out


@dataclass
class Landmarks:
    """The kernel with fixed strings: for each triple the landmarks that have it, and their values there."""

    starts: np.ndarray
    counts: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def of(cls, strings: list[str]) -> Landmarks:
        row, key, value = triples(strings)
        order = np.argsort(key, kind="stable")
        counts = np.bincount(key, minlength=SIZE)
        return cls(np.cumsum(counts) - counts, counts, row[order], value[order], len(strings))

    def near(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, landmark and kernel value of the pairs from LEAST on, in the order of tokens."""
        row, key, value, total = occurrences(tokens, self.counts > 0)
        # A vector is at least as long as if its repeated triples were apart: few tokens need the exact length.
        bound = np.sqrt(total)
        n = self.counts[key]
        at = np.repeat(self.starts[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.bincount(np.repeat(row, n) * self.n + self.column[at], np.repeat(value, n) * self.value[at], len(tokens) * self.n)
        hit = np.flatnonzero(sums.reshape(len(tokens), self.n) >= LEAST * np.maximum(bound, 1e-9)[:, None])
        row, which = np.unique(hit // self.n, return_inverse=True)
        own, key, value, _ = occurrences([tokens[k] for k in row])
        both, where = np.unique(own * SIZE + key, return_inverse=True)
        norm = np.sqrt(np.bincount(both // SIZE, np.bincount(where, value, len(both)) ** 2, len(row)))
        exact = sums[hit] / norm[which]
        keep = exact >= LEAST
        return (hit // self.n)[keep], (hit % self.n)[keep], exact[keep]

    def kernel(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, column and value: for each power a column a landmark; the values of a long segment's windows stand one by one."""
        cut = [pieces(t) for t in segments]
        row, column, value = self.near([p for c in cut for p in c])
        home = np.repeat(np.arange(len(cut)), [len(c) for c in cut])[row]
        return np.tile(home, len(SHARPEN)), np.concatenate([column + k * self.n for k in range(len(SHARPEN))]), np.concatenate([value**p for p in SHARPEN])


@dataclass
class Model:
    """Margin of a sentence: the sum of its segments' shares, plus bias. Score of a document: sigmoid(a * tanh(highest margin) + b), as far beyond the margin a document is toxic either way."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    usual: frozenset[str] = frozenset()
    cache: dict[str, float] = field(default_factory=dict, repr=False)
    older: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "older": {}}

    def shares(self, segments: list[str]) -> np.ndarray:
        out = np.zeros(len(segments))
        by = sorted(range(len(segments)), key=lambda k: len(segments[k]))  # tables of one width
        for k in range(0, len(by), 800):
            part = by[k : k + 800]
            row, column, value = self.landmarks.kernel([segments[x] for x in part])
            out[part] = np.bincount(row, value * self.beta[column], len(part))
        return out

    def learn(self, segments: Iterable[str], most: int = 250_000) -> None:
        """Keep the shares of these segments. Once the store has ``most`` it begins a new generation, and keeps one older."""
        if len(self.cache) > most:
            self.older.clear()
            self.older.update(self.cache)
            self.cache.clear()
        fresh = set(segments).difference(self.cache)
        known = fresh.intersection(self.older)
        self.cache.update(zip(known, map(self.older.__getitem__, known)))
        missing = {w: bare(w) for w in fresh - known}
        words = list(set(missing.values()).difference(self.cache))
        self.cache.update(zip(words, self.shares(words).tolist()))
        self.cache.update([(w, self.cache[b]) for w, b in missing.items()])

    def documents(self, texts: list[str]) -> np.ndarray:
        """The highest margin of a sentence in each text; the bias for texts without words."""
        out, k = np.empty(len(texts)), 0
        while k < len(texts):
            n, chars = 0, 0
            while k + n < len(texts) and (not n or chars + len(texts[k + n]) < 2_000_000):
                chars += len(texts[k + n])
                n += 1
            own = [list(sentences_of(t, self.usual)) for t in texts[k : k + n]]
            self.learn(set().union(*(s for ss in own for s in ss)))
            share = self.cache.__getitem__
            out[k : k + n] = [max([sum(map(share, s)) for s in ss], default=0.0) + self.bias for ss in own]
            k += n
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.tanh(margin) + self.b, -30, 30)))


def disguised(word: str, rng: np.random.Generator) -> str:
    """The word with a character inserted or doubled, with marks between its letters, or broken by a blank."""
    letters = "abcdefghijklmnopqrstuvwxyz.-*_"
    k = int(rng.integers(1, max(2, len(word))))
    way = rng.integers(8)
    if way == 0:
        return "-.*"[rng.integers(3)].join(word)
    if way == 1:
        return word[:k] + word[k - 1] + word[k:]
    if way == 2:
        return word[:k] + " " + word[k:]
    return word[:k] + letters[rng.integers(len(letters))] + word[k:]


Rows = tuple[np.ndarray, np.ndarray, float, float]


def svm(parts: list[Rows], w: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Squared-hinge machine by Newton steps from w on the rows inside the margin.

    Each part has features (the last one is 1), the rows of them that count, their label and the weight of each.
    """
    for _ in range(steps):
        gram, target = ridge * np.eye(len(w)), np.zeros(len(w))
        for x, rows, y, c in parts:
            inside = rows[y * (x @ w.astype(np.float32))[rows] < 1]
            for k in range(0, len(inside), 4096):
                a = x[inside[k : k + 4096]]
                gram += c * (a.T @ a)
                target += c * y * a.sum(0)
        new = np.linalg.solve(gram, target)
        if np.abs(new - w).max() < 1e-3:
            break
        w = new
    return w


Sentence = Sequence[str]
Document = list[Sentence]


def document(text: str, usual: frozenset[str] = frozenset()) -> Document:
    """The sentences of a training text; equal segments share one string."""
    return [tuple(map(sys.intern, sorted(s))) for s in sentences_of(text, usual)]


def usual_words(texts: Iterable[str]) -> frozenset[str]:
    """Words of at most four characters that stand in one of fifty texts at least."""
    seen, n = Counter(), 0
    for n, t in enumerate(texts, 1):
        seen.update({w for w in t.lower().split() if len(w) < 5})
    return frozenset(w for w, k in seen.items() if 50 * k >= n)


def distinct_documents(docs: list[Document]) -> list[Document]:
    """Copies count once: documents that agree in the minima of two hashes of their segments."""
    seen, out = set(), []
    for d in docs:
        words = {w.encode("utf-8", "surrogatepass") for s in d for w in s}
        key = tuple(min((zlib.crc32(salt + w) for w in words), default=0) for salt in (b"a", b"b"))
        if key not in seen:
            seen.add(key)
            out.append(d)
    return out


def telling(toxic: list[Document], clean: list[Document]) -> tuple[dict[str, float], list[str]]:
    """For words: log ratio of the shares of toxic and clean documents that hold it; and those in at least two toxic ones, the most telling first."""
    count = [Counter(w for d in docs for w in {bare(w) for s in d for w in s if " " not in w}) for docs in (toxic, clean)]
    ratio = {w: float(np.log((n + 0.5) / (len(toxic) + 1)) - np.log((count[1][w] + 0.5) / (len(clean) + 1))) for w, n in count[0].items()}
    often = [w for w, n in count[0].items() if n >= 2 and len(w) >= 3 and ratio[w] > 0]
    return ratio, sorted(often, key=lambda w: (-ratio[w] * count[0][w], w))


class Sentences:
    """The sentences of a sample in the landmarks' feature space, and machines fitted on a part of its documents."""

    def __init__(self, toxic: list[Document], clean: list[Document], landmarks: int, negatives: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.ratio, often = telling(toxic, clean)
        common = sorted({bare(w) for d in clean for s in d for w in s} - set(often))
        # Three eighths are telling words, as many those with a gap at a third, the half or two thirds, the rest any words of clean documents.
        part = 3 * landmarks // 8
        words = [pieces(w)[0] for w in often[:part]]
        gapped = [w[:k] + "*" + w[k:] for w in words for k in sorted({max(1, len(w) * f // 6) for f in (2, 3, 4)})][:part]
        others = [common[k][:LONGEST] for k in self.rng.permutation(len(common))[: landmarks - len(words) - len(gapped)]]
        lands = list(dict.fromkeys([*words, *gapped, *others]))
        self.marks = Landmarks.of(lands)
        # Nystroem: the inverse square root of the landmarks' kernel, for each power.
        row, column, value = self.marks.kernel(lands)
        width = len(lands)
        self.root = np.zeros((width * len(SHARPEN), width * len(SHARPEN)), np.float32)
        for k in range(0, len(self.root), width):
            whole, own = np.zeros((width, width)), (column >= k) & (column < k + width)
            whole[row[own], column[own] - k] = value[own]
            values, vectors = np.linalg.eigh((whole + whole.T) / 2)
            self.root[k : k + width, k : k + width] = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
        self.bad = [s for d in toxic for s in d]
        self.home = np.repeat(np.arange(len(toxic)), [len(d) for d in toxic])
        self.home_good = np.repeat(np.arange(len(clean)), [len(d) for d in clean])
        good = [s for d in clean for s in d]
        self.x_bad, self.x_good = self.mapped(self.bad), self.mapped(good)
        # The clean sentences fitted on: half of them those that look worst, the others any.
        looks = np.array([max([self.ratio.get(bare(w), -9.0) for w in s], default=-9.0) for s in good])
        worst = np.argsort(-looks, kind="stable")[: negatives // 2]
        others = np.setdiff1d(np.arange(len(good)), worst)
        self.fitted = np.sort(np.concatenate([worst, self.rng.permutation(others)[: negatives - len(worst)]]))

    def mapped(self, sentences: list[Sentence]) -> np.ndarray:
        """Nystroem features of sentences, and a one. The kernel values of each distinct segment are computed once."""
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for s in sentences for w in s], np.int64)
        home = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        by = np.argsort(at, kind="stable")
        home, first = home[by], np.searchsorted(at[by], np.arange(len(place) + 1))
        out, words = np.zeros((len(sentences), len(self.root)), np.float32), list(place)
        for k in range(0, len(words), 4000):
            word, column, value = self.marks.kernel([bare(w) for w in words[k : k + 4000]])
            n = (first[k + 1 :] - first[k:-1])[word]  # sentences that hold the word
            rows = home[np.repeat(first[k + word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            np.add.at(out, (rows, np.repeat(column, n)), np.repeat(value.astype(np.float32), n))
        return np.concatenate([out @ self.root, np.ones((len(sentences), 1), np.float32)], 1)

    def machine(self, own_toxic: np.ndarray, own_clean: np.ndarray, rounds: int) -> np.ndarray:
        """Weights, the bias last, from the documents that the two masks name."""
        own, good = np.flatnonzero(own_toxic[self.home]), self.fitted[own_clean[self.home_good[self.fitted]]]
        home = self.home[own]
        margin = np.array([max([self.ratio.get(bare(w), 0.0) for w in self.bad[k]], default=0.0) for k in own])
        w = np.zeros(self.x_good.shape[1])
        for turn in range(rounds):
            top = np.full(len(own_toxic), -np.inf)
            np.maximum.at(top, home, margin)
            # The highest of each document, unless it is far on the clean side, and all beyond the boundary.
            chosen = own[margin == top[home] if turn == 0 else (margin > 0) | (margin == top[home]) & (margin > -0.7)]
            x_more = self.x_bad[:0]
            if turn:
                model, more = self.model(w), []
                model.learn({w for k in chosen for w in self.bad[k]})
                for k in chosen:
                    share = {w: model.cache[w] for w in self.bad[k] if len(bare(w)) > 2}
                    told = [w for w, v in share.items() if v > 0.2 and v >= 0.2 * max(share.values())]
                    for word in self.rng.permutation(told)[:2]:
                        more.append([*(x for x in self.bad[k] if x not in told), disguised(bare(str(word)), self.rng)])
                x_more = self.mapped(more)
            of_one = 4000 / max(1, len(chosen) + len(x_more))
            w = svm([(self.x_bad, chosen, 1.0, of_one), (x_more, np.arange(len(x_more)), 1.0, of_one), (self.x_good, good, -1.0, 40_000 / max(1, len(good)))], w)
            margin = (self.x_bad @ w.astype(np.float32))[own]
        return w

    def model(self, w: np.ndarray) -> Model:
        return Model(self.marks, self.root @ w[:-1], float(w[-1]))


def fit(bad: list[str], good: list[str], *, odds: float | None = None, landmarks: int = 192, negatives: int = 12_000, rounds: int = 3, seed: int = 11) -> Model:
    """A calibrated model from toxic and clean texts; ``odds``: how many clean ones there are for a toxic one, if not as given.

    At most ``negatives`` of the clean sentences are fitted on; all of them count in the calibration.
    """
    odds = odds or len(good) / max(1, len(bad))
    usual = usual_words(good)
    toxic, clean = (distinct_documents([d for d in (document(t, usual) for t in texts) if d]) for texts in (bad, good))
    if not toxic or not clean:
        # Nothing tells the classes apart: the score is the rate of toxic documents.
        rate = (len(toxic) + 0.5) / (len(toxic) * (1 + odds) + 1) if toxic else 0.5 / (len(clean) + 1)
        return Model(Landmarks.of(["none"]), np.zeros(len(SHARPEN)), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    data = Sentences(toxic, clean, landmarks, negatives, seed)
    folds = min(FOLDS, len(toxic), len(clean))
    fold_of = np.arange(len(toxic)) % folds, np.arange(len(clean)) % folds
    top = np.full(len(toxic), -np.inf), np.full(len(clean), -np.inf)
    for fold in range(folds):
        w = data.machine(*((f != fold) | (folds == 1) for f in fold_of), rounds).astype(np.float32)
        for k, x, home in ((0, data.x_bad, data.home), (1, data.x_good, data.home_good)):
            rows = fold_of[k][home] == fold
            np.maximum.at(top[k], home[rows], x[rows] @ w)
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weight = np.where(y > 0, 1.0, odds * len(toxic) / len(clean))
    model = data.model(data.machine(*(np.ones(len(f), bool) for f in fold_of), rounds))
    model.usual = usual
    model.a, model.b = platt(np.tanh(np.concatenate(top)), y, weight)
    return model


def platt(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by damped Newton steps."""
    a, b = 4.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * top * top).sum() + 0.1, (h * top).sum()], [(h * top).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, np.array([(r * top).sum() + 0.1 * (a - 4), r.sum()]))
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, *, most: int = 1000) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) mod 5 isn't 0.

    ``most`` bounds the sample: at most so many toxic and so many clean doc_ids, in the order of a hash of the doc_id,
    with their distinct texts, the first 4 of a doc_id that repeats. Of contradicting labels toxic counts. Their
    texts come to the driver whole.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    marked = marked.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    count = {r["_toxic"] == 1: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    some = [marked.filter(c).orderBy(F.xxhash64("_id"), "_id").limit(most) for c in ("_toxic = 1", "_toxic <> 1")]
    sample = F.broadcast(some[0].unionByName(some[1]))  # so many rows of 12 bytes, twice
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "_id")
    each = rows.groupBy("_id", F.xxhash64("text").alias("h")).agg(F.min("_toxic").alias("_toxic"), F.min("text").alias("text"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("_id").orderBy("h"))).filter("r <= 4")
    own: tuple[list, list] = ([], [])
    for row in first.orderBy("_id", "h").toLocalIterator():
        own[row["_toxic"] == 1].append(row["text"])
    return fit(own[1], own[0], odds=count.get(False, 0) / max(1, count.get(True, 0)) or None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts count as empty; these and others without words get the score of the bias. Null doc_ids
    aren't held out. Repeated rows are scored alike; other columns are ignored. Nothing is shuffled.
    """

    number = zlib.crc32(model.beta.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _SHARES:
            _SHARES.clear()
        model.cache, model.older = _SHARES.setdefault(number, (model.cache, model.older))
        for b in batches:
            tops = [np.zeros(0)]
            for k in range(0, b.num_rows, 1000):
                tops.append(model.documents([x or "" for x in b.column(2).slice(k, 1000).to_pylist()]))
            s = model.score(np.concatenate(tops))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
