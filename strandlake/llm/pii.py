"""Operator 9, PII: patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The base are four patterns with checks (email, ip, card, phone).  The network is trained from labelled
spans - base spans in a bounded sample of texts, and spans written in further formats into the same
contexts - and adds spans that the patterns don't know: telephone numbers without a country code, card
numbers of other lengths or with other separators, addresses with blanks around the @ or with (at) or [at]
for it.  Numbers without a country code are those of 3-3-4 digits, of five pairs with a leading 0
(French), of nine digits in 3-3-3 or 3-2-2-2 from 6 on (Spanish), and of 9 to 11 digits in groups after an
area code with a leading 0 (British, German).  Ungrouped ones, but for 3-3-4, and ip spans are never added.

A text is read in clusters of digits, @ and (at) with some context.  What the network may add needs one of
these signs or nine digits, so clusters with less can't gain a span and are not read; all others are cut into windows that
overlap by half, the windows' scores are averaged by their distance from the windows' ends, and one Viterbi
pass over the whole cluster settles the labels.  An added span is kept if its kind's check holds and it
touches no base span, so base spans always stay.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.  Rows that repeat a doc_id are
read one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .tokens import sized_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, CONTEXT, GAP = 64, 32, 16, 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_ANY = re.compile(r"[0-9@]").search


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN(text, at + 1)
        start = at
        if domain:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            last = domain.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, kind by kind and then by start."""
    found: list[tuple[str, int, int]] = []
    if not _ANY(text):
        return found
    if "@" in text:
        found += [("email", *x) for x in _emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in _IP(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# What the network may add.

_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|(?i:\(at\)|\[at\])) ?[A-Za-z0-9-]+(?:(?:\.| ?(?i:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+").fullmatch
_NUMBER = re.compile(r"[(]?[0-9](?:[ ().\-/]*[0-9])+").fullmatch
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .\-/]?[0-9]{3}[ .\-/][0-9]{4}").fullmatch
_GROUPED = re.compile(
    r"0[1-9](?:[ .\-][0-9]{2}){4}"
    r"|[6-9][0-9]{2}(?:[ \-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ \-][0-9]{2}){3}"
    r"|(?:0[1-9][0-9]{1,3}(?: ?[\-/] ?| )|\(0[1-9][0-9]{1,3}\) ?)[0-9]{2,8}(?:[ \-][0-9]{2,6}){0,3}"
).fullmatch
_SIGNS = re.compile(r"([0-9]+)|@|(?i:\(at\)|\[at\])").finditer


def plausible(kind: str, text: str) -> bool:
    """The check of an added span."""
    digits = _digits(text)
    if kind == "email":
        return bool(_ADDRESS(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and bool(_NUMBER(text)) and luhn(digits)
    if kind == "phone":
        return len(digits) == 10 and bool(_NATIONAL(text)) or 9 <= len(digits) <= 11 and bool(_GROUPED(text))
    return False


def clusters(text: str):
    """(start, end) around digits, @ and (at) that lie at most GAP apart, where a span could be added."""
    begin = end = None
    digits = signs = 0
    for m in _SIGNS(text):
        if begin is not None and m.start() - end > GAP:
            if digits >= 9 or signs:
                yield max(0, begin - CONTEXT - STRIDE * bool(signs)), min(len(text), end + CONTEXT + STRIDE * bool(signs))
            begin, digits, signs = None, 0, 0
        begin = m.start() if begin is None else begin
        end = m.end()
        digits += len(m[1] or "")
        signs += m[1] is None
    if begin is not None and (digits >= 9 or signs):
        yield max(0, begin - CONTEXT - STRIDE * bool(signs)), min(len(text), end + CONTEXT + STRIDE * bool(signs))


# The network.

#: Characters with a class of their own; then digits, a-z, A-Z, other letters and all else.
_OWN = "@.-_+()[]/ \n,:%"
CLASSES = len(_OWN) + 6
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_ASCII = np.full(128, len(_OWN) + 4, np.int64)
_ASCII[48:58] = len(_OWN)
_ASCII[97:123] = len(_OWN) + 1
_ASCII[65:91] = len(_OWN) + 2
for _i, _c in enumerate(_OWN):
    _ASCII[ord(_c)] = _i
PAD = len(_OWN) + 5


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.where(codes >= 0xC0, len(_OWN) + 3, len(_OWN) + 4))


def allowed() -> np.ndarray:
    """Transitions [from, to] that label sequences can have."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            ok[:, j] = [x[1:] == to[1:] for x in LABELS]
    return ok


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int = 20, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p["x" + way] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            p["h" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p["x" + way][:, hidden : 2 * hidden] += 1.0  # open forget gates
        p["o"] = rng.normal(0, 0.3, (2 * hidden, len(LABELS)))
        p["c"] = np.zeros(len(LABELS))
        p["t"] = np.zeros((len(LABELS), len(LABELS)))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [step, row, unit] of one direction over x [row, step]."""
        n, steps = x.shape
        wx, wh = self.p["x" + way], self.p["h" + way]
        size = wh.shape[0]
        h = c = np.zeros((n, size), np.float32)
        out = np.zeros((steps, n, size), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = wx[x[:, t]] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        return out

    def _back(self, x, way, keep, dout, grad):
        wh = self.p["h" + way]
        size = wh.shape[0]
        dh = dc = np.zeros((len(x), size), np.float32)
        for t, i, f, o, g, before, tc, h in reversed(keep):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            np.add.at(grad["x" + way], x[:, t], dz)
            grad["h" + way] += h.T @ dz
            dh, dc = dz @ wh.T, dc * f

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores [row, step, label]."""
        both = np.concatenate((self._run(x, "f"), self._run(x, "b")), axis=2)
        return (both @ self.p["o"] + self.p["c"]).transpose(1, 0, 2)

    def transitions(self) -> np.ndarray:
        return np.where(allowed(), self.p["t"], -1e4)

    def loss(self, x: np.ndarray, y: np.ndarray, m: np.ndarray):
        """CRF negative log-likelihood a step, and gradients.  m: which steps are text."""
        keep_f, keep_b = [], []
        both = np.concatenate((self._run(x, "f", keep_f), self._run(x, "b", keep_b)), axis=2)
        e = (both @ self.p["o"] + self.p["c"]).astype(np.float64)  # [step, row, label]
        trans = self.transitions()
        steps, n, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        start = np.where(np.array([x[0] == "I" for x in LABELS]), -1e4, 0.0)
        lse = lambda v, axis: (top := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis=axis))
        a[0] = e[0] + start
        for t in range(1, steps):
            a[t] = np.where(m[:, t, None], lse(a[t - 1][:, :, None] + trans, 1) + e[t], a[t - 1])
        for t in range(steps - 2, -1, -1):
            b[t] = np.where(m[:, t + 1, None], lse(trans + (e[t + 1] + b[t + 1])[:, None, :], 2), b[t + 1])
        z = lse(a[-1], 1)
        total = m.sum()
        rows = np.arange(n)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - z[:, None]) * m.T[:, :, None]
        gold = 0.0
        dt = np.zeros_like(trans)
        for t in range(steps):
            on = m[:, t]
            gold += e[t][rows, y[:, t]][on].sum()
            de[t][rows[on], y[on, t]] -= 1
            if t:
                pair = np.exp(a[t - 1][:, :, None] + trans + (e[t] + b[t])[:, None, :] - z[:, None, None])[on]
                dt += pair.sum(axis=0)
                np.add.at(dt, (y[on, t - 1], y[on, t]), -1)
                gold += trans[y[on, t - 1], y[on, t]].sum()
        de = (de / total).astype(np.float32)
        grad["t"] += (np.where(allowed(), dt, 0) / total).astype(np.float32)
        grad["o"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, de.shape[2])
        grad["c"] += de.sum(axis=(0, 1))
        dboth = de @ self.p["o"].T
        size = self.p["hf"].shape[0]
        self._back(x, "f", keep_f, dboth[:, :, :size], grad)
        self._back(x, "b", keep_b, dboth[:, :, size:], grad)
        return (z.sum() - gold) / total, grad

    def fit(self, x, y, m, epochs: int = 20, batch: int = 48, rate: float = 0.02, seed: int = 5) -> list[float]:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                value, grad = self.loss(x[rows], y[rows], m[rows])
                losses.append(float(value))
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        trans = self.transitions()
        score = e[0] + np.where(np.array([x[0] == "I" for x in LABELS]), -1e4, 0.0)
        back = np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            all_ = score[:, None] + trans
            back[t] = all_.argmax(axis=0)
            score = all_.max(axis=0) + e[t]
        path = [int(score.argmax())]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return np.array(path[::-1])

    def read(self, texts: list[str], most_rows: int = 512) -> list[list[tuple[str, int, int]]]:
        """Spans of each of several stretches of text: overlapping windows, averaged, then decoded as one."""
        rows, owner, place = [], [], []
        coded = [classes(t) for t in texts]
        for k, x in enumerate(coded):
            for at in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE):
                w = np.full(WINDOW, PAD)
                part = x[at : at + WINDOW]
                w[: len(part)] = part
                rows.append(w)
                owner.append(k)
                place.append(at)
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
        total = [np.zeros((len(x), len(LABELS))) for x in coded]
        mass = [np.zeros(len(x)) for x in coded]
        for i in range(0, len(rows), most_rows):
            e = self.emissions(np.array(rows[i : i + most_rows]))
            for r, k, at in zip(e, owner[i : i + most_rows], place[i : i + most_rows], strict=True):
                n = min(WINDOW, len(coded[k]) - at)
                total[k][at : at + n] += r[:n] * weight[:n, None]
                mass[k][at : at + n] += weight[:n]
        return [spans_of(self.viterbi(t / m[:, None])) if len(m) else [] for t, m in zip(total, mass, strict=True)]


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    found, open_ = [], None
    for i, k in enumerate([*labels, 0]):
        name = LABELS[k]
        if open_ and name != f"I-{open_[0]}":
            found.append((*open_, i))
            open_ = None
        if name[0] == "B":
            open_ = (name[2:], i)
    return found


# Labelled spans.


def _written(rng) -> tuple[str, str]:
    """A span in a format that the patterns may not know, with its kind; "O" for numbers that are none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def w() -> str:
        word = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(3, 9)))
        return word.title() if rng.integers(0, 4) == 0 else word

    def name() -> str:
        return [w, lambda: f"{w()}.{w()}", lambda: f"{w()}{d(2)}"][rng.integers(0, 3)]()

    def card(n, sep):
        body = d(n - 1)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return sep.join(digits[i : i + 4] for i in range(0, n, 4))

    kind = rng.integers(0, 12)
    if kind == 0:
        return "phone", f"({d(3)}) {d(3)}-{d(4)}"
    if kind == 1:
        sep = "-. "[rng.integers(0, 3)]
        return "phone", sep.join((d(3), d(3), d(4)))
    if kind == 2:
        return "phone", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"
    if kind == 3:
        return "email", f"{name()} @ {w()}.{w()[:3]}"
    if kind == 4:
        return "email", f"{w()}.{d(2)}@{w()}.{w()}.com"
    if kind == 5:
        return "card", card(int(rng.choice([13, 14, 15, 16, 16, 16])), ["", " ", "-", "."][rng.integers(0, 4)])
    if kind == 6:
        return "ip", ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == 7:
        return "O", ["{}-{}-{}".format(d(4), d(2), d(2)), f"{d(1)}.{d(2)}.{d(1)}", d(int(rng.integers(1, 8)))][rng.integers(0, 3)]
    if kind == 8:
        return "O", f"{d(3)},{d(3)},{d(3)}.{d(2)}"
    if kind == 9:
        at, dot = [("(at)", "."), ("[at]", "."), ("(at)", "(dot)"), ("[at]", "[dot]")][rng.integers(0, 4)]
        gap = " " * int(rng.integers(0, 2))
        return "email", f"{name()}{gap}{at}{gap}{w()}{gap if dot != '.' else ''}{dot}{gap if dot != '.' else ''}{w()[:3]}"
    n = lambda low: str(rng.integers(low, 10))
    sep = "- "[rng.integers(0, 2)]
    if kind == 10:
        return "phone", [sep.join(("0" + n(1), d(2), d(2), d(2), d(2))), sep.join((n(6) + d(2), d(3), d(3))), sep.join((n(6) + d(2), d(2), d(2), d(2)))][rng.integers(0, 3)]
    return "phone", [f"0{n(1)}{d(1)} {d(7)}", f"0{n(1)}{d(2)}{'/- '[rng.integers(0, 3)]}{d(6)}", f"02{d(1)} {d(4)} {d(4)}", f"0{n(1)}{d(2)} {d(3)} {d(4)}", f"0{n(1)}{d(3)} {d(6)}"][rng.integers(0, 5)]


def examples(texts: list[str], written: int = 1600, seed: int = 11, spans_each: int = 8):
    """x, y, m of training windows: base spans where they stand, and written spans put between words.

    Of a text with more base spans `spans_each` are drawn.
    """
    rng = np.random.default_rng(seed)
    made: list[tuple[str, list[tuple[str, int, int]]]] = []
    contexts = []
    for t in texts:
        spans = base_spans(t)
        drawn = rng.permutation(len(spans))[:spans_each] if len(spans) > spans_each else range(len(spans))
        for _, s, _e in (spans[k] for k in drawn):
            at = max(0, s - int(rng.integers(4, 32)))
            made.append((t[at : at + WINDOW], [(k, a - at, min(b - at, WINDOW)) for k, a, b in spans if a >= at and a - at < WINDOW]))
        blanks = [m.start() for m in re.finditer(" ", t)]
        if blanks:
            contexts.append((t, blanks))
    for _ in range(written if contexts else 0):
        t, blanks = contexts[rng.integers(0, len(contexts))]
        at = blanks[rng.integers(0, len(blanks))]
        kind, s = _written(rng)
        before = t[max(0, at - int(rng.integers(4, 28))) : at + 1]
        if base_spans(before):
            before = " "
        window = (before + s + t[at : at + WINDOW])[:WINDOW]
        made.append((window, [] if kind == "O" else [(kind, len(before), min(len(before) + len(s), WINDOW))]))
    x, y, m = np.full((len(made), WINDOW), PAD), np.zeros((len(made), WINDOW), np.int64), np.zeros((len(made), WINDOW), bool)
    for r, (t, spans) in enumerate(made):
        x[r, : len(t)], m[r, : len(t)] = classes(t), True
        for kind, s, e in spans:
            y[r, s:e] = LABELS.index(f"I-{kind}")
            y[r, s] = LABELS.index(f"B-{kind}")
    return x, y, m


def train(docs: DataFrame, most_texts: int = 400, longest: int = 20_000, written: int = 1600, seed: int = 3) -> Network:
    """Fit on at most `most_texts` texts of at most `longest` code points that hold a digit or @, chosen by a hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tells = F.col("text").rlike("@|\\+[0-9]|[0-9]{10}") & (F.length("text") <= longest)
    texts = [r.text for r in hashed_sample(rows, "doc_id", most_texts, tells).select("text").collect()]
    net = Network.fresh(seed=seed)
    x, y, m = examples(texts, written)
    if len(x):
        net.fit(x, y, m)
    return net


class _Taken:
    """Disjoint stretches of a text in order; each question is a bisection."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) if it touches nothing that is taken."""
        k = bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a or k < len(self.starts) and self.starts[k] < b:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def find(text: str, net: Network) -> tuple[list, list]:
    """(base, all) spans of a text; all are in the order of kinds, then starts."""
    base = base_spans(text)
    parts = list(clusters(text))
    if not parts:
        return base, base
    found, taken = list(base), _Taken((y, z) for _, y, z in base)
    for (s, _e), spans in zip(parts, net.read([text[s:e] for s, e in parts]), strict=True):
        for kind, a, b in spans:
            a, b = s + a, s + b
            if plausible(kind, text[a:b]) and taken.add(a, b):
                found.append((kind, a, b))
    return base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def detect(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, and the base spans and all spans as lists of "kind:start:end"."""

    def run(batches):
        for b in sized_batches(batches):
            bases, alls = [], []
            for text in b.column(1).to_pylist():
                base, full = find(text or "", net)
                bases.append([f"{k}:{s}:{e}" for k, s, e in base])
                alls.append([f"{k}:{s}:{e}" for k, s, e in full])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, pa.list_(pa.string())), pa.array(alls, pa.list_(pa.string()))], names=["doc_id", "base", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, base array<string>, spans array<string>")
