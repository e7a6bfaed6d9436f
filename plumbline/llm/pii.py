"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 3).

The base patterns give certain spans. What is left around digits, at-signs and written-out at-signs, as many
tokens on either side as a segment can have, is looked at in windows; in each the field scores whole candidate segments (digit counts, group
shapes, Luhn sums, separators, neighbouring words) of at most MAX_TOKENS tokens, and a dynamic program
over all segmentations picks boundaries and kinds jointly. The field's weights are learnt on the driver,
by its exact likelihood, from windows that a fixed grammar writes: personal data in unusual dress, and
numbers that are none (versions, dates, prices, keys, card-like numbers with a wrong check digit).
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest segment that the field considers.
MAX_TOKENS = 16
#: A segment must beat leaving its tokens alone by so much (log odds).
MARGIN = 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A plain "at" counts only before a dot no further off than a label of a domain can be long.
ANCHOR = re.compile(r"[0-9]+|@|[\[({]\s?at\s?[\])}]|\sat\s(?=[^@]{1,64}?(?:\sdot\s|[\[({]\s?dot\s?[\])}]|\.[^\W\d_]))", re.IGNORECASE)
#: Four groups of digits with nothing but signs between them.
FOUR = re.compile(r"[0-9]+(?:[^\w]{1,7}[0-9]+){3}")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
AT = re.compile(r"[\[({]\s?at\s?[\])}]|\sat\s", re.IGNORECASE)
DOT = re.compile(r"[\[({]\s?dot\s?[\])}]|\sdot\s", re.IGNORECASE)

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if "0" <= c <= "9"]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _count(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def _emails(text: str) -> list[Span]:
    """From at-sign to at-sign, so that long runs without one cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    return found


def _ips(text: str) -> list[Span]:
    found = []
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        if len(parts) < 4:
            continue
        starts = [at]
        for p in parts[:-1]:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((1, starts[i], starts[i + 3] + len(four[3])))
                i += 4
            else:
                i += 1
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start; each kind is searched by itself."""
    found = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        found += _ips(text)
        found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= _count(m[0]) <= 19 and luhn(m[0])]
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= _count(m[0]) <= 15]
    return found


# --- the field -----------------------------------------------------------------------------------


def _bucket(n: int) -> str:
    return str(n) if n <= 4 or 7 <= n <= 11 or n in (13, 14, 15, 16) else "5-6" if n < 7 else "12" if n == 12 else "17-19" if n < 20 else "20+"


class Marks:
    """Where at-signs stand, written out or not."""

    def __init__(self, text: str):
        found = sorted([(m.start(), m.end()) for m in AT.finditer(text)] + [(m.start(), m.end()) for m in re.finditer("@", text)])
        self.starts = [a for a, _ in found]
        self.nearest = [b for _, b in found]  # the first end of what starts here or later
        for i in range(len(found) - 2, -1, -1):
            self.nearest[i] = min(self.nearest[i], self.nearest[i + 1])

    def inside(self, start: int, end: int) -> bool:
        """Whether one lies within, touching neither end."""
        i = bisect_right(self.starts, start)
        return i < len(self.starts) and self.nearest[i] < end


def candidates(text: str, tokens: list[re.Match] | None = None, marks: Marks | None = None) -> tuple[list[re.Match], list[tuple[int, int, int, tuple[str, ...]]]]:
    """Tokens, and segments ``(first, after last, kind, features)`` that could be of a kind at all. All tokens and marks of the text unless given."""
    tokens = list(TOKEN.finditer(text)) if tokens is None else tokens
    marks = marks or Marks(text)
    out = []
    for i, first in enumerate(tokens):
        head = first[0]
        numeric, dotted, groups, n = head.isdigit() or head in "+(", head.isdigit(), 0, 0
        start = first.start()
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            last = tokens[j - 1]
            word, end = last[0], last.end()
            if word.isdigit():
                groups += 1
                n += _count(word)
            elif j > i + 1:
                numeric = numeric and word in "+()-./"
                dotted = dotted and word in "()[]{}-./"
            if (numeric or dotted) and word.isdigit() and n >= 4:
                span = text[start:end]
                if len(span) - span.count(" ") < 40:
                    kinds = [1] * (dotted and groups == 4) + [2, 3] * (numeric and n >= 7)
                    if kinds:
                        common = _numeric(text, span, start, end, n)
                        out += [(i, j, kind, common) for kind in kinds]
            if head[0].isalnum() and word.isalpha() and marks.inside(start, end):
                out.append((i, j, 0, _written(text, text[start:end], start, end)))
    return tokens, out


def _touches(text: str, start: int, end: int) -> list[str]:
    left, right = text[start - 1 : start], text[end : end + 1]
    f = []
    if left and not left.isspace() and left not in ",;:\"'([<":
        f.append("left-touches")
    if right and not right.isspace() and right not in ",;.:\"')]>!?":
        f.append("right-touches")
    word = re.search(r"([^\W\d_]+)[\s:=.]*$", text[max(0, start - 16) : start])
    f.append("after-" + (word[1].lower() if word else "nothing"))
    return f


def _numeric(text: str, span: str, start: int, end: int, n: int) -> tuple[str, ...]:
    groups = [len(x) for x in re.findall(r"[0-9]+", span)]
    separators = "".join(sorted(set(re.sub(r"[0-9]", "", span).replace(" ", "_"))))
    f = ["bias", "n-" + _bucket(n), "groups-" + "-".join(map(str, groups[:8])), "by-" + separators, f"parts-{min(len(groups), 8)}", *_touches(text, start, end)]
    if 13 <= n <= 19:
        f.append("luhn" if luhn(span) else "no-luhn")
    if len(groups) == 4 and all(int(x) <= 255 for x in re.findall(r"[0-9]{1,9}", span)):
        f.append("octets-by-" + separators)
    if span[0] in "+(":
        f.append("starts-" + span[0])
    return tuple(f)


def _written(text: str, span: str, start: int, end: int) -> tuple[str, ...]:
    f = ["bias", *_touches(text, start, end)]
    bracketed = bool(re.search(r"[\[({]\s?at\s?[\])}]", span, re.IGNORECASE))
    f.append("at-bracketed" if bracketed else "at-sign" if "@" in span else "at-word")
    f.append(f"dots-{min(len(DOT.findall(span)), 3)}")
    f.append(f"points-{min(span.count('.'), 3)}")
    f.append(f"spaces-{min(len(re.findall(r'\s+', span)), 6)}")
    f.append("tail-" + ("known" if re.search(r"(com|net|org|edu|info|io|de|fr|es|uk)$", span, re.IGNORECASE) else "other"))
    f.append("odd" if re.search(r"[^\w\s@.\[\](){}%+-]", span) else "plain")
    return tuple(f)


class Field:
    """Log-linear weights of (kind, feature) and the exact sums and maxima over segmentations."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def score(self, kind: int, features: tuple[str, ...]) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in features)

    def best(self, tokens: list, segments: list) -> list[tuple[int, int, int]]:
        """The segmentation of the highest score, ties to fewer segments; a token outside segments scores zero."""
        ending: dict[int, list] = {}
        for i, j, kind, f in segments:
            if (s := self.score(kind, f) - MARGIN) > 0:
                ending.setdefault(j, []).append((i, kind, s))
        if not ending:
            return []
        top, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            value, link = top[-1], None
            for i, kind, s in ending.get(j, ()):
                if top[i] + s > value:
                    value, link = top[i] + s, (i, kind)
            top.append(value)
            back.append(link)
        found, j = [], len(tokens)
        while j:
            if back[j]:
                i, kind = back[j]
                found.append((i, j, kind))
                j = i
            else:
                j -= 1
        return found[::-1]

    def learn(self, examples: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Gradient ascent on the likelihood, by forward and backward sums over all segmentations."""
        names: dict[tuple[int, str], int] = {}
        cases = []
        for text, gold in examples:
            tokens, segments = candidates(text)
            want = {(s, e, k) for k, s, e in gold}
            ids = [np.array([names.setdefault((k, f), len(names)) for f in fs]) for _, _, k, fs in segments]
            hit = [(tokens[i].start(), tokens[j - 1].end(), k) in want for i, j, k, _ in segments]
            cases.append((len(tokens), [(i, j) for i, j, _, _ in segments], ids, hit))
        w, seen = np.zeros(len(names)), np.full(len(names), 1e-3)
        for _ in range(rounds):
            slope = -decay * len(cases) * w
            for n, places, ids, hit in cases:
                if not places:
                    continue
                scores = [w[x].sum() for x in ids]
                to: list[list[int]] = [[] for _ in range(n + 1)]
                out: list[list[int]] = [[] for _ in range(n + 1)]
                for s, (i, j) in enumerate(places):
                    to[j].append(s)
                    out[i].append(s)
                ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
                for j in range(1, n + 1):
                    ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[places[s][0]] + scores[s] for s in to[j])])
                for i in range(n - 1, -1, -1):
                    behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[places[s][1]] + scores[s] for s in out[i])])
                for s, (i, j) in enumerate(places):
                    p = np.exp(ahead[i] + scores[s] + behind[j] - ahead[n])
                    slope[ids[s]] += hit[s] - p
            seen += slope**2
            w += rate * slope / np.sqrt(seen)
        return Field({k: float(w[i]) for k, i in names.items() if abs(w[i]) > 1e-6})


def training_windows(n: int = 360, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts of a fixed grammar with their spans: about half hold personal data, the rest numbers that are none."""
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "la", "que", "ung", "der", "ción", "men", "tion", "ou", "st", "ich"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(right: bool) -> str:
        body = r.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if right else r.choice([c for c in "0123456789" if c != check]))

    def fours(x: str, by: str) -> str:
        return by.join(x[i : i + 4] for i in range(0, 16, 4))

    def mail() -> str:
        a, b, tail = word(), word(), r.choice(["com", "net", "org"])
        at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", "."), (" at ", " dot "), (" @ ", ".")])
        return a + at + b + dot + tail

    def phone() -> str:
        a, b, c = r.choice("23456789") + digits(2), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}"])

    def ip() -> str:
        return r.choice([" . ", "[.]", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4))

    some = [(0, mail), (3, phone), (1, ip), (2, lambda: fours(card(True), r.choice([".", " - ", "/"])))]
    none = [
        lambda: f"{r.randint(0, 30)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1, 999)},{digits(3)},{digits(3)}.{digits(2)}",
        lambda: fours(card(False), r.choice([".", " ", "-", "", " - ", "/"])),
        lambda: digits(r.choice([7, 8, 9, 10, 11, 12, 20])),
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)),
        lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: f"License, version {r.randint(1, 9)}.{r.randint(0, 9)}. {r.randint(1990, 2030)} {word()}",
        lambda: f"{word()} at {word()} {word()}",
        lambda: f"{word()} at {word()}. {word()}",
        lambda: f"@{word()} {word()} {word()}.",
        lambda: " ".join(str(r.randint(1, 9999)) for _ in range(r.randint(3, 7))),
        lambda: r.choice([" ", " - ", "] [", "][", ") (", ")("]).join(str(r.randint(0, r.choice([9, 255]))) for _ in range(4)),
        lambda: "-".join([digits(3), digits(1), digits(2), digits(6), digits(1)]),
    ]
    out = []
    for x in range(n):
        before = " ".join(word() for _ in range(r.randint(0, 4)))
        before += " " if before else ""
        if x % 2:
            kind, write = some[(x // 2) % len(some)]
            body = write()
            gold = [(kind, len(before), len(before) + len(body))]
        else:
            body, gold = none[(x // 2) % len(none)](), []
        after = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((before + body + r.choice([" ", ". ", ", "]) * bool(after) + after, gold))
    return out


@functools.cache
def trained() -> Field:
    return Field().learn(training_windows())


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field finds outside the base spans."""
    taken = sorted((s, e) for _, s, e in base)
    marks = Marks(text)
    tokens, runs = [], []  # runs of tokens that no base span touches: (first, after last)
    at = 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        parted = tokens and any(s < m.start() and tokens[-1].end() < e for s, e in taken[max(0, at - 1) : at])
        if not tokens or parted:
            runs.append([len(tokens), len(tokens)])
        tokens.append(m)
        runs[-1][1] = len(tokens)
    starts = [m.start() for m in tokens]
    areas: list[list[int]] = []
    run = 0
    for m in ANCHOR.finditer(text):
        i = max(bisect_right(starts, m.start()) - 1, 0)
        j = bisect_left(starts, m.end())
        while run < len(runs) and runs[run][1] <= i:
            run += 1
        if run == len(runs):
            break
        low, high = max(i - MAX_TOKENS, runs[run][0]), min(j + MAX_TOKENS, runs[run][1])
        if low >= high:
            continue
        if areas and low < areas[-1][1] and runs[run][0] <= areas[-1][0]:
            areas[-1][1] = max(high, areas[-1][1])
        else:
            areas.append([low, high])
    found = []
    for low, high in areas:
        part = text[tokens[low].start() : tokens[high - 1].end()]
        if _count(part) < 7 and "@" not in part and not AT.search(part) and not FOUR.search(part):
            continue
        here, segments = candidates(text, tokens[low:high], marks)
        found += [(k, here[i].start(), here[j - 1].end()) for i, j, k in field.best(here, segments)]
    return found


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``: personal data of every whole text, in code points, by kind (email, ip, card, phone) and start.

    ``base`` tells the fixed patterns' spans from those the field added. A null text is empty; empty
    texts have an empty array; the time a text takes is in proportion to its length. Each row is handled by itself, so repeated rows give repeated results;
    an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    field = trained()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [as_rows(spans_of(text or "", field)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, ARROW)], names=["id", "spans"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, spans {SPANS}")


def spans_of(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    if ANCHOR.search(text):
        found += [(k, s, e, False) for k, s, e in added_spans(text, base, field)]
    return sorted(found)


def as_rows(found: list[tuple[int, int, int, bool]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in found]


def digest(spans: Column, only_base: bool) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for k, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; ``length_col`` gets the new length where that column exists.

    A null text stays null. Rows, other columns and the schema stay as they are.
    """
    small_batches(docs.sparkSession)
    field = trained()
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            texts = [x if x is None else redact(x, spans_of(x, field)) for x in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array([x if x is None else len(x) for x in texts], pa.int64()).cast(columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
