"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns find email, ip, card and phone spans exactly as stated in
``base_spans``.  The semi-Markov CRF (Sarawagi and Cohen, 2004) then segments the
tokens around digits, @ and spelled-out addresses: a segment of up to ``LONGEST``
tokens is scored as a whole (its shape, digits, check sums, key words, what the
patterns say of it), neighbours are tied by transition weights, and dynamic
programming over segment ends chooses boundaries and types together.  It finds
what the patterns miss: spelled-out addresses, national phone numbers, cards
with other separators, and secrets (keys, passwords, tokens).

Weights are trained by gradient ascent on the exact conditional likelihood, over
sentences generated from the templates below, so they depend on no corpus.  A
span is kept if it gains ``GAIN`` or more over leaving its tokens unmarked and
does not overlap a span of the patterns, which all stay.

A segment without any trigger (digits, @, key words with a sign of assignment, spelled-out
signs, long hex) is evidence of no type: the model leaves it unmarked.  So tokens
further than a segment from every trigger are unmarked in the best segmentation of the
whole text, and decoding the zones around triggers finds just that one.  A zone is
decoded in one pass whatever its length, which takes time in proportion to it and
some hundred bytes a token.

Defined cases: null text is empty; empty text has no spans; rows are handled each
by itself, so duplicates and null ids need nothing; other columns are ignored.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import functools
import random
import re
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "secret")
LONGEST = 6
GAIN = 2.0
EPOCHS = 8
SENTENCES = 260

# Fixed patterns, possessive where giving back could not help.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    """Equal to a left-to-right search for local@domain, but linear: the local part is read backwards from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_BEFORE:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, each kind searched for itself, by start and then kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g) < 1000 and int(g) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# Where a segment can hold more than plain words: digits, @, spelled-out at and dot, assigned key words, long hex.
_TRIGGER = re.compile(r"[0-9@]|[\[(<{](?:at|dot|\.)[\])>}]|\sdot\s|\sat\s+[\w-]+\.[\w-]|(?:pass(?:word|wd)?|pwd|secret|token|key|bearer)[\"']?\s*[=:]|[a-f]{16}", re.I)
_AT_WORD = re.compile(r"^[\[(<{]?(?:at|@)[\])>}]?$", re.I)
_DOT_WORD = re.compile(r"^[\[(<{]?(?:dot|\.)[\])>}]?$", re.I)
_KEY_WORD = re.compile(r"pass(?:word|wd)?|secret|token|api[_-]?key|key|pwd|bearer", re.I)
_ASSIGNED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?[^\s\"']{8,}", re.I)
_HEX = re.compile(r"[0-9a-f]{16,}", re.I)
_RANDOM = re.compile(r"(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}")
_GROUPS = re.compile(r"[0-9]+")
_MONEY = re.compile(r"^[$€£]?[0-9]{1,3}(?:[.,][0-9]{1,3})*[.,]?%?$")
_DATE = re.compile(r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}[.,]?$|^[0-9]{1,2}:[0-9]{2}")
_SPELLED_MAIL = re.compile(r"^[\w.+-]+(?:\s+at\s+|\s?[\[(<{](?:at|@)[\])>}]\s?)[\w-]+(?:(?:\s+dot\s+|\s?[\[(<{](?:dot|\.)[\])>}]\s?|\.)[\w-]+)+(?<=\w\w)[.,;]?$", re.I)
_ENDING = re.compile(r"\b(?:com|org|net|edu|gov|info|io)[.,;]?$", re.I)  # fixed values: frequent top-level domains
_ALL_ASSIGNED = re.compile(r"^(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?[^\s\"']{8,}\S*$", re.I)
_NATIONAL = re.compile(r"^\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}[.,;]?$")


def features(span: str, n: int, base: str) -> list[str]:
    """What holds of a whole segment of n tokens; ``base`` is the pattern that matches just it, if any."""
    digits = _NO_DIGIT.sub("", span)
    groups = _GROUPS.findall(span)
    letters = sum(c.isalpha() for c in span)
    f = [] if _TRIGGER.search(span) else ["plain"]
    f += ["bias", f"n{n}", f"base={base}", f"digits={'0' if not digits else '1-4' if len(digits) < 5 else '5-8' if len(digits) < 9 else '9-11' if len(digits) < 12 else '12-19' if len(digits) < 20 else '20+'}", f"groups={min(len(groups), 6)}", f"at={span.count('@') if '@' in span else 0}", f"letters={'none' if not letters else 'few' if letters < 4 else 'many'}"]
    if 12 <= len(digits) <= 19 and not letters:
        f.append("luhn" if luhn(digits) else "not luhn")
    if _SPELLED_MAIL.match(span):
        f.append("spelled mail")
        f.append("known ending" if _ENDING.search(span) else "unknown ending")
    if _NATIONAL.match(span):
        f.append("national phone")
    if span[:1] == "+" and digits:
        f.append("plus")
    if _ASSIGNED.search(span):
        f.append("assigned")
        if _ALL_ASSIGNED.match(span):
            f.append("all assigned")
            if n > 1 and re.search(r"[=:]\s+[\"']", span):
                f.append("quoted value")
    if n <= 3 and _HEX.search(span) and letters:
        f.append("long hex")
    if n == 1 and _RANDOM.search(span):
        f.append("random")
    if _KEY_WORD.search(span):
        f.append("key word")
    if _MONEY.match(span) or _DATE.match(span):
        f.append("plain number")
    if len(groups) == 4 and span.count(".") >= 3:
        f.append("dotted quad" if all(int(g) <= 255 for g in groups if len(g) < 9) else "large quad")
    if n > 1 and not re.search(r"[0-9@]|[\[(]|\bat\b|\bdot\b", span):
        f.append("words only")
    return f


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in "\"'.,;:!?":
        b -= 1
    while a < b and text[a] in "\"'":
        a += 1
    return a, b


class Field:
    """Weights of the semi-Markov CRF: a row per type (0: unmarked, one token) for features, and transitions."""

    def __init__(self):
        self.index: dict[str, int] = {"plain": 0}
        self.weights = np.zeros((len(TYPES) + 1, 256))
        self.moves = np.zeros((len(TYPES) + 1, len(TYPES) + 1))

    def ids(self, found: list[str], grow: bool) -> list[int]:
        if grow:
            for f in found:
                self.index.setdefault(f, len(self.index))
        return [self.index[f] for f in found if f in self.index]

    def segments(self, text: str, tokens: list[tuple[int, int]], base: dict[tuple[int, int], str], grow: bool = False) -> Iterator[list[list[int]]]:
        """Feature ids of the segments that end behind token j, for each length."""
        for j in range(1, len(tokens) + 1):
            row = []
            for n in range(1, min(LONGEST, j) + 1):
                a, b = _trim(text, tokens[j - n][0], tokens[j - 1][1])
                row.append(self.ids(features(text[a:b], n, base.get((a, b), "")), grow))
            yield row

    def scores(self, row: list[list[int]]) -> np.ndarray:
        s = np.array([self.weights[:, ids].sum(1) for ids in row])
        s[1:, 0] = -np.inf  # unmarked segments are single tokens
        s[[ids[0] == 0 for ids in row], 1:] = -np.inf  # nothing speaks for any type
        return s

    def decode(self, segments: Iterable[list[list[int]]]) -> list[tuple[int, int, int, float]]:
        """(first token, past the last, type, gain over unmarked tokens) of the best segmentation's marked segments."""
        k = len(TYPES) + 1
        start = np.full(k, -np.inf)
        start[0] = 0
        best = deque([start], LONGEST)  # the last one is that of the token before
        plain, length, before, alone = array("d"), array("b"), array("b"), array("d")
        for row in segments:
            scores = self.scores(row)
            top, frm, n_best, own = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
            for n in range(1, len(scores) + 1):
                through = best[-n][:, None] + self.moves
                origin = through.argmax(0)
                total = through[origin, np.arange(k)] + scores[n - 1]
                better = total > top
                top[better], frm[better], n_best[better], own[better] = total[better], origin[better], n, scores[n - 1][better]
            best.append(top)
            plain.append(scores[0, 0])
            length.extend(n_best.tolist())
            before.extend(frm.tolist())
            alone.extend(own.tolist())
        out, j, y = [], len(plain), int(best[-1].argmax())
        while j > 0:
            at = (j - 1) * k + y
            n, origin = length[at], before[at]
            if y:
                out.append((j - n, j, y, float(alone[at] + self.moves[origin, y] - sum(plain[j - n : j]))))
            j, y = j - n, origin
        return out[::-1]

    def gradient(self, segments: list[list[list[int]]], gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: observed minus expected counts, by forward and backward sums over segments."""
        m, k = len(segments), len(TYPES) + 1
        scores = [self.scores(row) for row in segments]
        ahead, behind = np.full((m + 1, k), -np.inf), np.full((m + 1, k), -np.inf)
        ahead[0, 0] = 0
        behind[m] = 0
        lse = lambda x, axis: np.log(np.exp(x - (top := np.maximum(x.max(axis, keepdims=True), -1e30))).sum(axis)) + top.squeeze(axis)
        with np.errstate(divide="ignore"):
            for j in range(1, m + 1):
                ahead[j] = lse(np.stack([lse(ahead[j - n][:, None] + self.moves, 0) + scores[j - 1][n - 1] for n in range(1, len(scores[j - 1]) + 1)]), 0)
            for j in range(m - 1, -1, -1):
                behind[j] = lse(np.stack([lse(self.moves + (scores[j + n - 1][n - 1] + behind[j + n])[None], 1) for n in range(1, min(LONGEST, m - j) + 1)]), 0)
            z = lse(ahead[m][None], 1)[0]
            g, moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
            y_before, cut = 0, 0
            spans = dict(sorted(gold.items()))
            while cut < m:
                end, y = next(((b, t) for (a, b), t in spans.items() if a == cut), (cut + 1, 0))
                g[y, segments[end - 1][end - cut - 1]] += 1
                moves[y_before, y] += 1
                cut, y_before = end, y
            for j in range(1, m + 1):
                for n in range(1, len(scores[j - 1]) + 1):
                    p = np.exp(ahead[j - n][:, None] + self.moves + (scores[j - 1][n - 1] + behind[j])[None] - z)
                    moves -= p
                    for i in segments[j - 1][n - 1]:
                        g[:, i] -= p.sum(0)
        return g, moves


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its marked spans (start, end, type)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        n = d(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        return sep.join(n[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        n = d(15)
        return n + next(c for c in "0123456789" if not luhn(n + c))

    def letters_of(least: int, most: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))

    def spelled(at: str, dot: str) -> str:
        return f"{letters_of(2, 8)}{at}{letters_of(2, 10)}{dot}{rng.choice(['com', 'org', 'net', 'ORG'])}"

    marked = [
        (1, lambda: f"{word()}.{d(2)}@{word()}{d(1)}.example.com"),
        (1, lambda: f"{word()}xy at {word()}xy dot {rng.choice(['com', 'org', 'net'])}"),
        (1, lambda: f"{word()}xy{rng.choice(['[at]', '(at)', ' [at] ', ' (at) '])}{word()}xy{rng.choice(['[dot]', '(dot)', ' [dot] ', '.'])}com"),
        (1, lambda: spelled(rng.choice([" at ", " AT ", " At ", "[AT]", " [AT] "]), rng.choice([" dot ", " DOT ", " Dot ", "[DOT]", " [DOT] "]))),
        (1, lambda: spelled(rng.choice([" at ", " AT "]), ".")),
        (2, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (3, lambda: card(rng.choice(["", " ", "-", "."]))),
        (4, lambda: f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
        (4, lambda: f"({d(3)}) {d(3)}-{d(4)}"),
        (4, lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (4, lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}"),
        (5, lambda: f"{rng.choice(['password', 'secret', 'token', 'api_key'])}={''.join(rng.choice('0123456789abcdef') for _ in range(18))}"),
        (5, lambda: f"{rng.choice(['token', 'secret', 'api_key'])} = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\""),
        (5, lambda: f"{rng.choice(['password', 'Secret', 'token', 'api_key', 'pwd'])}{rng.choice('=:')}{letters_of(8, 24)}"),
        (5, lambda: f"{rng.choice(['password', 'secret', 'Token', 'api_key', 'passwd'])}{rng.choice([' = ', ' = ', ': '])}\"{letters_of(8, 24)}\""),
        (5, lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + "7"),
    ]
    plain = [
        lambda: d(rng.randint(1, 4)) + rng.choice(["", ".", ",", "%"]),
        lambda: f"{d(1)}.{d(1)}.",
        lambda: f"{d(4)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}:{d(2)}",
        lambda: f"{d(2)}.{d(3)},{d(2)}",
        bad_card,
        lambda: f"{d(3)}.{d(1)}.{d(1)}",
        lambda: f"9{d(2)}.{d(3)}.4{d(2)}.{d(2)}",
        lambda: d(rng.randint(5, 8)),
        lambda: f"at {word()}",
        lambda: f"at {word()}.{letters_of(1, 8)}",
        lambda: f"{word()} dot {word()}",
        lambda: f"@{word()}",
        lambda: f"{d(4)} {d(4)}",
        lambda: f"{word()}{d(2)}",
        lambda: f"key {word()}",
        lambda: f"{rng.choice(['password', 'secret', 'token'])} {rng.choice(['is', 'of', 'was'])} {word()}",
        lambda: f"{rng.choice(['password', 'secret'])}: {letters_of(1, 6)} {word()}",
        lambda: f"{d(1)}, {d(1)}, {d(1)}",
    ]
    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
        if rng.random() < 0.65:
            kind, make = rng.choice(marked)
            piece = make()
            spans.append((len(text), len(text) + len(piece), kind))
        else:
            piece = rng.choice(plain)()
        text += piece + rng.choice([" ", " ", ". ", ", "])
    return text + word(), spans


@functools.cache
def trained(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = 5) -> Field:
    rng, field, data = random.Random(seed), Field(), []
    for _ in range(sentences):
        text, spans = _sentence(rng)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        base = {(a, b): k for k, a, b in base_spans(text)}
        begins = [a for a, _ in tokens]
        gold = {(bisect_right(begins, a) - 1, bisect_right(begins, b - 1)): t for a, b, t in spans}
        if all(b - a <= LONGEST for a, b in gold):
            data.append((list(field.segments(text, tokens, base, grow=True)), gold))
    seen = [np.full_like(field.weights, 1e-3), np.full_like(field.moves, 1e-3)]
    for _ in range(epochs):
        rng.shuffle(data)
        for segments, gold in data:
            for x, g, s in zip((field.weights, field.moves), field.gradient(segments, gold), seen, strict=True):
                g -= 1e-3 * x
                s += g * g
                x += 0.3 * g / np.sqrt(s)
    return field


def _zones(text: str, tokens: list[tuple[int, int]]):
    """Runs (first token, past the last) within a segment of a trigger."""
    begins = [a for a, _ in tokens]
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        t = bisect_right(begins, m.end() - 1) - 1
        if t < 0:
            continue
        if hi >= 0 and t - LONGEST > hi:
            yield max(0, lo), min(len(tokens), hi)
            lo = -1
        lo = t - LONGEST + 1 if lo < 0 or hi < 0 else lo
        lo, hi = max(0, lo), max(hi, t + LONGEST)
    if hi >= 0:
        yield max(0, lo), min(len(tokens), hi)


def find_spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether of the patterns) of a text, by start and then kind."""
    base = base_spans(text)
    found = [(k, a, b, True) for k, a, b in base]
    if not _TRIGGER.search(text):
        return found
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    by_span = {(a, b): k for k, a, b in base}
    taken = [(a, b) for _, a, b in base]
    starts = [a for a, _ in sorted(taken)]
    taken.sort()
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    free = lambda a, b: not (i := bisect_right(starts, b - 1)) or reach[i - 1] <= a
    for lo, hi in _zones(text, tokens):
        for a, b, y, gain in field.decode(field.segments(text, tokens[lo:hi], by_span)):
            s, e = _trim(text, tokens[lo + a][0], tokens[lo + b - 1][1])
            if gain >= GAIN and s < e and free(s, e):
                found.append((TYPES[y - 1], s, e, False))
    return sorted(found, key=lambda s: (s[1], TYPES.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def _find(field, batches):
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "text_"]
        rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find_spans(t, field)] if t else [] for t in batch.column("text_").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(rows, kind)], names=[*kept, "spans"])


def _mask(field, batches):
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            pieces, at = [], 0
            for kind, a, b, _ in find_spans(text, field) if text else ():
                if a >= at:
                    pieces += [text[at:a], f"<{kind}>"]
                at = max(at, b)
            out.append("".join(pieces) + text[at:] if pieces else text)
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in names], names=names)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").alias("text_")).mapInArrow(functools.partial(_find, trained()), f"doc_id long, spans {SPANS}")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; all other columns as they are."""
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # mapInArrow resolves names, which may hold dots
    return plain.mapInArrow(functools.partial(_mask, trained()), plain.schema).toDF(*docs.columns)
