"""Operator 4: personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns give spans that always stay. The field reads the stretches that can hold an entity at all (numbers with their
separators, and what stands around an at sign, both of bounded length to a candidate): each candidate segment is scored as a whole (its digit
groups, separators, check sum, what it touches), and dynamic programming over bounded segments chooses boundaries and types
together. Its segments that touch no base span are added, so it finds numbers and addresses that the patterns' forms miss.

The field's weights are fitted here, by exact conditional likelihood (forward and backward sums over all segmentations), on made-up
sentences from a fixed seed: TRAINING of them, whatever the corpus. No document is needed for it.

Defined results: null text counts as empty and has no spans; rows that come twice have equal spans; a null doc_id stays null; extra
columns are dropped; an empty table gives no rows. Places are code points.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import per_chunk, texts

KINDS = ("email", "ip", "card", "phone")
#: Production parameters: made-up sentences, passes over them, step, penalty, longest segment in characters and atoms.
TRAINING, PASSES, STEP, PENALTY, MOST_CHARS, MOST_ATOMS, SEED = 400, 8, 0.25, 1e-3, 64, 24, 11

# The patterns below are fixed values. Each finds what the plain form of its pattern finds, in time linear in the text: an address from its at
# sign outwards, and numbers only where a run of digits begins (a match never begins within one).
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9().+-]|\x20(?=[0-9(+-]))*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_GROUP = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base patterns' matches: by kind, then start."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", low, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- the field

FEATURES = 30
STATES = 1 + len(KINDS)  # outside, then the kinds


def features(text: str, a: int, b: int) -> list[float]:
    """What is seen of a whole segment text[a:b] and of its two neighbours."""
    s = text[a:b]
    before, after, beyond = text[a - 1 : a], text[b : b + 1], text[b + 1 : b + 2]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    n, sizes = len(digits), [len(g) for g in groups]
    seps = {c for c in s if not c.isalnum()}
    letters = any(c.isalpha() for c in s)
    local, _, domain = s.partition("@")
    mail = s.count("@") == 1 and bool(_LOCAL_END.fullmatch(local)) and bool(_DOMAIN.fullmatch(domain))
    dotted = seps == {"."}
    ip = dotted and not letters and len(groups) == 4 and "".join(s.split(".")) == digits and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [
        1.0,
        n / 10,
        float(8 <= n <= 15 and not letters),
        float(n == 10 and not letters),
        float(16 <= n <= 19 and not letters),
        float(13 <= n <= 19 and not letters and luhn(digits)),
        float(13 <= n <= 19 and not letters and not luhn(digits)),
        float(s[:1] == "+"),
        float("(" in s and s.count("(") == s.count(")") == 1),
        float(s.count("(") != s.count(")")),
        float(ip),
        float(dotted and not ip and not letters),
        float(mail),
        float("@" in s and not mail),
        float(letters and "@" not in s),
        float(before.isalnum() or before in "@_" and before != ""),
        float(after.isalnum() or after in "@_" and after != ""),
        float(before in ".-+/:" and before != ""),
        float(after in ".-/:" and after != "" and beyond.isalnum()),
        float(" " in s),
        float(len(seps) > 1),
        float(sizes[-2:] == [3, 4]),
        float(sizes[-3:] == [3, 3, 4]),
        float(sizes in ([4, 2, 2], [2, 2, 4], [2, 2, 2], [4, 2, 2, 2, 2])),
        float(len(sizes) >= 3 and set(sizes) == {4}),
        float(len(sizes) == 1),
        len(sizes) / 4,
        float(bool(sizes) and max(sizes) > 8 and n < 13),
        float(before == " " and a > 1 and text[a - 2 : a - 1].isdigit() or after == " " and beyond.isdigit()),
        len(s) / 20,
    ]


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity: numbers of four digits or more, and what stands around at signs."""
    found = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            low, high = at, at + 1
            while low > 0 and at - low < MOST_CHARS and not text[low - 1].isspace():
                low -= 1
            while high < len(text) and high - at < MOST_CHARS and not text[high].isspace():
                high += 1
            found.append((low, high))
            at = text.find("@", high)
    for m in _NUMBERS.finditer(text):
        if sum(map(len, _GROUP.findall(m[0]))) >= 4:
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def candidates(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Borders of the atoms of a window, and the segments (by numbers of borders) that are scored."""
    edges = [low, *(low + m.end() for m in _ATOM.finditer(text[low:high]))]
    heads = [text[e] for e in edges[:-1]]
    tails = [text[e - 1] for e in edges[1:]]
    out = []
    for i, head in enumerate(heads):
        if not (head.isalnum() or head in "+(._%-"):
            continue
        digits, mail = 0, False
        for j in range(i, min(i + MOST_ATOMS, len(heads))):
            if edges[j + 1] - edges[i] > MOST_CHARS or heads[j].isspace() and mail:
                break
            digits += (edges[j + 1] - edges[j]) * heads[j].isdigit()
            mail |= heads[j] == "@"
            if tails[j].isalnum() and (mail or digits >= 4):
                out.append((i, j + 1))
    return edges, out


class Field:
    """Weights: kinds by features, what an atom outside is worth, and transitions between states."""

    def __init__(self) -> None:
        self.kinds = np.zeros((len(KINDS), FEATURES))
        self.steps = np.zeros((STATES, STATES))
        self.outside = np.zeros(3)  # atoms of digits, of letters, others

    @staticmethod
    def atom(text: str, edge: int) -> int:
        return 0 if text[edge].isdigit() else 1 if text[edge].isalpha() else 2

    def lattice(self, text: str, low: int, high: int):
        edges, some = candidates(text, low, high)
        seen = np.array([features(text, edges[i], edges[j]) for i, j in some]).reshape(len(some), FEATURES)
        ends = defaultdict(list)
        for k, (i, j) in enumerate(some):
            ends[j].append((k, i))
        return edges, some, seen, ends

    def best(self, text: str, low: int, high: int) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        edges, some, seen, ends = self.lattice(text, low, high)
        if not some:
            return []
        value = seen @ self.kinds.T
        n = len(edges) - 1
        top = np.full((n + 1, STATES), -np.inf)
        top[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            came = top[j - 1] + self.steps[:, 0]
            k = int(came.argmax())
            top[j, 0] = came[k] + self.outside[self.atom(text, edges[j - 1])]
            back[j, 0] = (j - 1, k)
            for c, i in ends[j]:
                came = top[i][:, None] + self.steps[:, 1:]
                k_best = came.argmax(0)
                scores = came[k_best, np.arange(len(KINDS))] + value[c]
                for y in np.flatnonzero(scores > top[j, 1:]):
                    top[j, 1 + y] = scores[y]
                    back[j, 1 + int(y)] = (i, int(k_best[y]))
        out, at = [], (n, int(top[n].argmax()))
        while at[0]:
            i, y = back[at]
            if at[1]:
                out.append((KINDS[at[1] - 1], edges[i], edges[at[0]]))
            at = (i, y)
        return out[::-1]

    def gradient(self, text: str, low: int, high: int, gold: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Observed less expected counts of a window; None where the truth isn't among its segmentations."""
        edges, some, seen, ends = self.lattice(text, low, high)
        n = len(edges) - 1
        number = {pair: k for k, pair in enumerate(some)}
        at = {e: k for k, e in enumerate(edges)}
        truth = [(at.get(a, -1), at.get(b, -1), 1 + KINDS.index(kind)) for kind, a, b in gold if low <= a and b <= high]
        if any((i, j) not in number for i, j, _ in truth):
            return None
        value = seen @ self.kinds.T
        own = np.array([self.outside[self.atom(text, e)] for e in edges[:-1]])
        ahead = np.full((n + 1, STATES), -np.inf)
        ahead[0, 0] = 0
        for j in range(1, n + 1):
            ahead[j, 0] = np.logaddexp.reduce(ahead[j - 1] + self.steps[:, 0]) + own[j - 1]
            for c, i in ends[j]:
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], np.logaddexp.reduce(ahead[i][:, None] + self.steps[:, 1:], axis=0) + value[c])
        after = np.full((n + 1, STATES), -np.inf)
        after[n] = 0
        begins = defaultdict(list)
        for c, (i, j) in enumerate(some):
            begins[i].append((c, j))
        for i in range(n - 1, -1, -1):
            after[i] = self.steps[:, 0] + own[i] + after[i + 1, 0]
            for c, j in begins[i]:
                after[i] = np.logaddexp(after[i], np.logaddexp.reduce(self.steps[:, 1:] + value[c] + after[j, 1:], axis=1))
        total = np.logaddexp.reduce(ahead[n])
        kinds, steps, outside = np.zeros_like(self.kinds), np.zeros_like(self.steps), np.zeros_like(self.outside)
        for i in range(n):
            p = np.exp(ahead[i] + self.steps[:, 0] + own[i] + after[i + 1, 0] - total)
            steps[:, 0] -= p
            outside[self.atom(text, edges[i])] -= p.sum()
            for c, j in begins[i]:
                p = np.exp(ahead[i][:, None] + self.steps[:, 1:] + value[c] + after[j, 1:] - total)
                steps[:, 1:] -= p
                kinds -= p.sum(0)[:, None] * seen[c]
        state, i = 0, 0
        jumps = {a: (b, y) for a, b, y in truth}
        while i < n:
            j, y = jumps.get(i, (i + 1, 0))
            steps[state, y] += 1
            if y:
                kinds[y - 1] += seen[number[i, j]]
            else:
                outside[self.atom(text, edges[i])] += 1
            state, i = y, j
        return kinds, steps, outside


def sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence and its entities."""
    word = lambda low=2, high=9: "".join(r.choice("aeiounrstlmdhcg") for _ in range(r.randint(low, high)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good: bool = True) -> str:
        n = r.choice((16, 16, 16, 17, 18, 19))
        while luhn(d := digits(n)) != good:
            pass
        sep = r.choice(("", " ", "-"))
        return sep.join(d[k : k + 4] for k in range(0, n, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}", f"({a}) {b} {c}", f"+{digits(2)}-{a}-{b}-{c}"))

    positive = {
        "email": lambda: f"{word()}{r.choice(('', '.', '_', '-', '+'))}{r.choice((word(), digits(2)))}@{word()}.{r.choice(('com', 'org', 'example.com', 'net'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    negative = (
        lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2099)}",
        lambda: f"{r.randint(10, 28)}-{r.randint(10, 12)}-{r.randint(1900, 2099)}",
        lambda: ".".join(digits(r.randint(1, 2)) for _ in range(r.choice((3, 5, 6)))),
        lambda: f"{digits(4)}.{digits(r.randint(1, 6))}",
        lambda: digits(r.randint(4, 15)),
        lambda: digits(r.randint(20, 40)),
        lambda: card(False),
        lambda: f"{digits(4)}-{digits(4)}",
        lambda: " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(3, 9))),
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)} {digits(4)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)),
        lambda: f"{word()}@{word()}",
        lambda: f"@{word()}",
        lambda: f"{r.randint(256, 999)}." + ".".join(str(r.randint(256, 999)) for _ in range(3)),
        lambda: f"{digits(5)}-{digits(5)}-{digits(5)}",
        lambda: f"{digits(1)} + {digits(4)}",
        lambda: f"({digits(4)})",
        lambda: f"{digits(3)}-{digits(4)}",
    )
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += " ".join(word() for _ in range(r.randint(1, 3))) + r.choice((" ", " ", ": ", ' "', " ("))
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            value = positive[kind]()
            if kind == "phone" and value[0] == "(" and text[-1] == "(":
                text = text[:-1]
            spans.append((kind, len(text), len(text) + len(value)))
        else:
            value = r.choice(negative)()
        text += value + r.choice((" ", ", ", ". ", ") ", '" ', "\n"))
    return text + word(), spans


@lru_cache(maxsize=4)
def fitted(sentences: int = TRAINING, passes: int = PASSES, seed: int = SEED) -> Field:
    """The field fitted to made-up sentences by stochastic steps of its conditional likelihood."""
    r, field = random.Random(seed), Field()
    data = [sentence(r) for _ in range(sentences)]
    places = [(t, low, high, gold) for t, gold in data for low, high in windows(t)]
    sums = [np.full_like(w, 1e-2) for w in (field.kinds, field.steps, field.outside)]
    for _ in range(passes):
        r.shuffle(places)
        for text, low, high, gold in places:
            found = field.gradient(text, low, high, gold)
            if found is None:
                continue
            for weights, change, squares in zip((field.kinds, field.steps, field.outside), found, sums, strict=True):
                change = change - PENALTY * weights
                squares += change**2
                weights += STEP * change / np.sqrt(squares)
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those that the field adds: by kind, then start."""
    base = base_spans(text)
    starts, ends = [], []  # of the stretches that base spans cover, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for low, high in windows(text):
        for kind, a, b in field.best(text, low, high):
            k = bisect_right(ends, a)
            if k == len(ends) or b <= starts[k]:
                added.append((kind, a, b))
    order = {kind: n for n, kind in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1], s[2]))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, text, base and spans: arrays of (kind, start, end) of every document."""
    field = field or fitted()

    def work(batch: pa.RecordBatch) -> dict:
        both = [all_spans(t, field) for t in batch.column("text").to_pylist()]
        base, spans = ([[{"kind": k, "start": a, "end": b} for k, a, b in x[n]] for x in both] for n in (0, 1))
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "base": base, "spans": spans}

    span = "array<struct<kind: string, start: long, end: long>>"
    return per_chunk(texts(docs), work, f"doc_id long, text string, base {span}, spans {span}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one, named after the first) replaced by its kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced in text (and n_chars, where there is one, set right); null text stays null."""
    from pyspark.sql import functions as F

    field = field or fitted()

    @F.pandas_udf("string")
    def mask(column):
        return column.map(lambda t: None if t is None else masked(t, all_spans(t, field)[1]))

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
