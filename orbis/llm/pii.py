"""Personal data: base patterns, and candidates judged by boosted trees.

Generators with high recall propose overlapping spans: every run of digit groups, with all usual
separators, that has the length of a kind and holds no base span, however long the chain of groups
is; and addresses whose at sign or dots are spelled out. Trees over format and context
features judge them, one model for each kind, fitted on generated examples (a fixed seed; a
bounded number of them) and calibrated on a held-out part; the cutoff of a kind is the lowest with
the wanted precision there. Spans of the base patterns stay in any case; accepted candidates are
added where they touch neither those nor a better candidate.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbis.llm.boosting import BoostedTrees, threshold

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match starts where its run of digits does, and takes each run whole: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]++")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, found from each at sign: a local part holds none."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    found = list(base_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


# --- Candidates and their features ------------------------------------------------------------

_CHAIN = re.compile(r"[(+]?[0-9](?:(?:[ ()./-]|\[\.\]|\(\.\)){0,3}[0-9])++")
_LEFT = re.compile(r"([0-9]+)([^0-9A-Za-z]{1,4})$")
_RIGHT = re.compile(r"([^0-9A-Za-z]{1,4})([0-9]+)")
_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]| at ", re.I)
_DOT_BEFORE = re.compile(r" ?[(\[{]? ?(?:dot|DOT) ?[)\]}]? ?$")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]++(?:(?: ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| dot | DOT |\.)[A-Za-z0-9-]++)++")
#: Words beside a span that speak for or against each kind.
FOR = {"email": ("mail", "contact", "write", "reach", "address", "correo"), "ip": ("ip", "server", "host", "address", "login"), "card": ("card", "visa", "credit", "pay", "karte", "carte"), "phone": ("call", "phone", "tel", "mobile", "fax", "cell", "contact", "whatsapp")}
AGAINST = ("order", "invoice", "version", "isbn", "page", "date", "serial", "ticket", "chapter", "section", "build", "commit", "hash", "ratio", "total", "year", "release")


def local_part(text: str, at: int) -> int | None:
    """Where the local part of a spelled-out address begins that ends at ``at``, a blank left out: a word, or two with a dot in letters between."""

    def word(end: int) -> int:
        start = end
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < end and not text[start].isalnum():
            start += 1
        return start

    end = at - (at > 0 and text[at - 1] == " ")
    start = word(end)
    if start == end:
        return None
    dot = _DOT_BEFORE.search(text, max(0, start - 8), start)
    if dot and (first := word(dot.start())) < dot.start():
        return first
    return start


def candidates(text: str, taken: Taken | None = None) -> Iterator[Span]:
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
            for i, (s, _) in enumerate(groups):
                lead, n = s - (s > m.start() and text[s - 1] in "(+"), 0
                for j in range(i, len(groups)):
                    e = groups[j][1]
                    n += e - groups[j][0]
                    if n > 19 or taken and not taken.free(s, e):
                        break
                    if 7 <= n <= 15:
                        yield "phone", lead, e
                    if n >= 13:
                        yield "card", s, e
                    if j - i == 3 and n <= 12:
                        yield "ip", s, e
    for m in _AT.finditer(text):
        right = _AFTER_AT.match(text, m.end())
        left = local_part(text, m.start()) if right else None
        if left is not None:
            yield "email", left, right.end()


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    lengths = [len(g) for g in groups] or [0]
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    left, right = _LEFT.search(text, max(0, start - 24), start), _RIGHT.match(text, end, end + 24)  # numbers beside the span
    parts = re.split(r"(?:[^A-Za-z0-9]|\b(?:dot|DOT)\b)+", s)
    date = len(groups) >= 3 and (1900 <= int(groups[0][:4] or 0) <= 2100 and lengths[0] == 4 and int(groups[1][:4]) <= 12 or lengths[2] == 4 and int(groups[0][:4]) <= 31 and int(groups[1][:4]) <= 31)
    return [
        len(s), len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
        len(set(seps)), max(map(len, seps), default=0), s.count("."), s.count("-"), s.count(" "), s.count("("), s[:1] == "+", s[:1] == "(",
        len(digits) >= 12 and luhn(digits), bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups), lengths == [3, 3, 4] or lengths == [1, 3, 3, 4], lengths == [4, 4, 4, 4] or lengths == [4, 6, 5], bool(date),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ".-/$#" and before != "", after[:1] in "-/%" and after != "",
        len(left[1]) if left else 0, bool(left and seps and left[2] in seps), len(right[2]) if right else 0, bool(right and seps and right[1] in seps),
        any(w in before for w in FOR[kind]), any(w in before for w in AGAINST),
        "@" in s, bool(re.search(r"[(\[{] ?(?:at|dot)", s, re.I)), bool(re.search(r" (?:at|dot) ", s, re.I)), len(parts[-1]) if parts[-1].isalpha() else 0, parts[-1].lower() in ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk"),
    ]


# --- Fitting ----------------------------------------------------------------------------------


def examples(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of n generated candidates in made-up sentences, half of them hard negatives.

    Numbers stand alone or beside others; half of their negatives are runs of groups cut out of, or across, true spans.
    """
    rng = np.random.default_rng([seed, KINDS.index(kind)])
    pick = lambda *xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))

    def card() -> str:
        d = pick("4", "5", "37") + num(13)
        d = d[:15]
        return d + next(c for c in "0123456789" if luhn(d + c))

    def positive(kind: str = kind) -> str:
        if kind == "email":
            at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("@", "."), (" at ", ".") if rng.random() < 0.1 else ("[at]", "."))
            return f"{word()}{pick('', '.' + word(), num(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'io', 'edu')}"
        if kind == "ip":
            return pick(".", "[.]", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
        if kind == "card":
            d, sep = card(), pick("", " ", "-", ".", "  ")
            return sep.join(d[k : k + 4] for k in range(0, 16, 4))
        sep = pick("-", ".", " ", "-")
        return pick(f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"1{sep}{num(3)}{sep}{num(3)}{sep}{num(4)}", f"+{num(2)} {num(3)} {num(6)}", f"+{num(1)} ({num(3)}) {num(3)}{sep}{num(4)}")

    def negative() -> str:
        if kind == "email":
            return pick(f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} @ {num(2)}.{num(2)}", f"{word()}@{num(1)}.{num(1)}", f"{word()} at {word()} dot {word()}{word()}")
        if kind == "ip":
            return pick(f"{num(1)}.{num(1)}.{num(1)}.{num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(2)}/{num(2)}/{num(2)}/{num(2)}", f"{num(1)}-{num(1)}-{num(1)}-{num(1)}", f"3{num(2)}.{num(3)}.9{num(2)}.{num(3)}")
        if kind == "card":
            d = num(15)
            d += next(c for c in "0123456789" if not luhn(d + c))
            return pick(d, num(14), num(18), " ".join(d[k : k + 4] for k in range(0, 16, 4)), f"97{num(1)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}.{num(2)}.{num(2)}")
        year = str(rng.integers(1950, 2030))
        return pick(f"{year}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{year}", num(7), num(9), num(10), num(12), f"{num(3)}.{num(6)}", f"{num(1)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(1)}-{num(4)}-{num(4)}", f"{year}-{year}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"{num(5)}-{num(4)}")

    def beside() -> str:
        other = pick(*KINDS[1:], "", "")
        return positive(other) if other else pick(f"{rng.integers(1950, 2030)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{rng.integers(1950, 2030)}", num(1), num(2), num(4), negative())

    def cut_or_across(before: str, span: str, after: str, start: int, end: int) -> tuple[int, int] | None:
        """A candidate of this kind that overlaps the true span from start to end and isn't it."""
        found = [(s, e) for k, s, e in candidates(before + span + after) if k == kind and (s, e) != (start, end) and s < end and e > start]
        return found[rng.integers(len(found))] if found else None

    xs, ys = [], []
    for k in range(n):
        true = k % 2 == 0
        cut = kind != "email" and not true and rng.random() < 0.5
        span = positive(pick(*KINDS[1:])) if cut else positive() if true else negative()
        lead = pick(*FOR[kind]) if rng.random() < (0.5 if true or cut else 0.15) else pick(*AGAINST) if rng.random() < (0.05 if true or cut else 0.5) else word()
        before, after = f"{word()} {lead}{pick(':', '', ' no')} ", pick(" ", ", ", ". ", "") + (word() if rng.random() < 0.8 else "")
        if not after[:1].strip(" ,.") == "" and true:
            after = " " + after
        if kind != "email":
            gap = lambda: pick(" ", " ", " / ", ", ", "  ")
            before += beside() + gap() if rng.random() < (0.6 if cut else 0.35) else ""
            after = gap() + beside() + after if rng.random() < (0.6 if cut else 0.35) else after
        start, end = len(before), len(before) + len(span)
        if cut:
            found = cut_or_across(before, span, after, start, end)
            if not found:
                span = negative()
            start, end = found or (start, start + len(span))
        xs.append(features(before + span + after, kind, start, end))
        ys.append(true)
    return np.array(xs, float), np.array(ys, float)


@lru_cache(maxsize=4)
def fitted(n: int = 3000, precision: float = 0.99, seed: int = 7) -> dict[str, tuple[BoostedTrees, float]]:
    """Model and cutoff of each kind, from n generated examples a kind: two thirds fit, the rest calibrates."""
    out = {}
    for kind in KINDS:
        x, y = examples(kind, n, seed)
        k = 2 * n // 3
        model = BoostedTrees().fit(x[:k], y[:k]).calibrate(x[k:], y[k:])
        out[kind] = model, threshold(model.probability(x[k:]), y[k:], precision)
    return out


# --- Spans of texts ---------------------------------------------------------------------------


class Taken:
    """Disjoint stretches of a text in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect_right(self.ends, s)
        return k == len(self.starts) or self.starts[k] >= e

    def add(self, s: int, e: int) -> None:
        insort(self.starts, s)
        insort(self.ends, e)


def find(texts: list[str], models: dict[str, tuple[BoostedTrees, float]]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by kind and start."""
    bases, todo = [], {k: [] for k in KINDS}
    for row, text in enumerate(texts):
        bases.append(base_spans(text))
        taken = Taken(bases[-1])
        for kind, s, e in candidates(text, taken):
            if taken.free(s, e):
                todo[kind].append((row, s, e, features(text, kind, s, e)))
    added: dict[int, list] = {}
    for kind, rows in todo.items():
        if rows:
            model, least = models[kind]
            for (row, s, e, _), p in zip(rows, model.probability(np.array([r[3] for r in rows], float))):
                if p >= least:
                    added.setdefault(row, []).append((-p, s - e, s, kind))
    out = []
    for row, base in enumerate(bases):
        spans, taken = list(base), Taken(base)
        for _, size, s, kind in sorted(added.get(row, ())):
            e = s - size
            if taken.free(s, e):
                spans.append((kind, s, e))
                taken.add(s, e)
        rank = lambda x: (KINDS.index(x[0]), x[1])
        out.append((sorted(base, key=rank), sorted(spans, key=rank)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    for k in range(0, len(column), 500):
        yield [x or "" for x in column.slice(k, 500).to_pylist()]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row.

    Null texts count as empty; repeated rows and null doc_ids are treated like others; other
    columns are ignored. Nothing is shuffled.
    """
    models = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for part in _chunks(b.column(1)) for x in find(part, models)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array([listed(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with its columns, all spans in text replaced and n_chars, if there, counted anew. Null texts stay null."""
    models, names = fitted(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            texts = [redacted(t, s) for part in _chunks(b.column(at)) for t, (_, s) in zip(part, find(part, models))]
            columns = list(b.columns)
            there = columns[at].is_valid().to_pylist()
            columns[at] = pa.array([t if v else None for t, v in zip(texts, there)], columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if v else old for t, v, old in zip(texts, there, columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
