"""Secret scans: fixed patterns, plus a small convolutional network over every other candidate.

Candidates are all token-like runs and all values after a separator, from six characters, with or without
digits. Those that patterns confirm are the labelled findings; the network (numpy, characters in, pooled
convolutions out) starts from made-up keys, learns from every window of four fifths of the texts, half the time
with the surroundings blanked, is calibrated on all windows of the other fifth, and adds candidates above the
threshold that keeps the wanted recall there. What a pattern covers only in part is scored like any other candidate.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeframe.llm.common import bounded_batches, mix64, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: "=" ends a run (as padding); before a value it is a separator, and the value a candidate of its own.
RUN = re.compile(r"[A-Za-z0-9+/_.-]{6,}=*")
_IN_RUN, _IN_HEX, _EQUALS = (np.array([i > 0 and re.fullmatch(of, chr(i + 31)) is not None for i in range(97)]) for of in ("[A-Za-z0-9+/_.-]", "[0-9a-f]", "="))
VALUE = re.compile(r"""[:=]\x20*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"']{6,}))""")
KINDS = ("assign", "access", "hex", "model")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEFT, BODY, RIGHT, STEP = 20, 40, 8, 32
#: Bodies up to this length are scored without the places behind them.
SHORT = 12
WIDTH = LEFT + BODY + RIGHT
#: Of a stretch of so many places: which of 2, 4, 8 and 16 is the largest that fits into it.
LEVEL = np.array([max(0, min(3, n.bit_length() - 2)) for n in range(BODY)])


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and non-overlapping per kind, by start and kind.

    ``hexes`` is false only where no hex match is known to be.
    An access or hex match is a maximal run, so asking for its least length at once drops what failing
    matches would; an assignment consumes its text even where its value is too short.
    """
    lowered = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(h in lowered for h in _HINTS) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the candidates, whether a pattern touches each and whether patterns cover all of it."""
    laid = Laid.of([text], [spans])
    return laid.start - laid.base[0], laid.end - laid.base[0], laid.touched, laid.whole


def encode(text: str) -> np.ndarray:
    """Character classes: 0 padding, 1 … 95 printable ASCII, 96 any other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 31, 96)).astype(np.uint8)


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end; the first and last value are false."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


def pieces_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows that cover each whole candidate begin and stop; how many each has."""
    times = np.maximum(1, -(-(end - BODY + STEP - start) // STEP))
    own = np.repeat(np.arange(len(start)), times)
    at = start[own] + STEP * (np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times))
    return at, np.minimum(end[own], at + BODY), times


def cut_out(laid: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Windows of bodies ``at`` … ``stop`` with what stands before and after; ``laid`` is padded with 0 on both sides."""
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :LEFT + BODY] = laid[at[:, None] + np.arange(-LEFT, BODY)]
    out[:, LEFT:LEFT + BODY][np.arange(BODY) >= (stop - at)[:, None]] = 0
    out[:, LEFT + BODY:] = laid[stop[:, None] + np.arange(RIGHT)]
    return out


def windows_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover each whole candidate, with what stands before and after, padded with 0; how many each has."""
    at, stop, times = pieces_of(start, end)
    return cut_out(np.concatenate([np.zeros(LEFT, np.uint8), codes, np.zeros(BODY + RIGHT, np.uint8)]), at + LEFT, stop + LEFT), times


@dataclass
class Laid:
    """Candidates of several texts, which lie one after the other with padding between them."""

    codes: np.ndarray
    spans: Sequence[list[tuple[int, int, int]]]
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    touched: np.ndarray
    whole: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str], spans: Sequence[list[tuple[int, int, int]]] | None = None) -> Laid:
        """Candidates by start and end; ``spans`` are the pattern matches, found here if not given."""
        base = LEFT + np.cumsum([0, *(len(t) + LEFT for t in texts)], dtype=np.int64)[:-1]
        gap = "\0" * LEFT
        codes = np.concatenate([encode(gap + gap.join(texts)), np.zeros(BODY + RIGHT, np.uint8)])
        if spans is None:
            start, end = runs_of(_IN_HEX[codes])
            hexes = set((np.searchsorted(base, start[end - start >= 24], "right") - 1).tolist())
            spans = [base_spans(t, i in hexes) for i, t in enumerate(texts)]
        start, end = runs_of(_IN_RUN[codes])
        long = end - start >= 6
        start, end = start[long], end[long]
        equals, stop = runs_of(_EQUALS[codes])
        if len(equals):
            k = np.minimum(np.searchsorted(equals, end), len(equals) - 1)
            end = np.where(equals[k] == end, stop[k], end)
        values = [(m.start(m.lastindex) + low, m.end(m.lastindex) + low) for t, low in zip(texts, base.tolist()) if ":" in t or "=" in t for m in VALUE.finditer(t)]
        if values:
            values = np.array(values, np.int64)
            found = np.sort(np.concatenate([start << 32 | end, values[:, 0] << 32 | values[:, 1]]), kind="stable")
            found = found[np.r_[True, found[1:] != found[:-1]]]
            start, end = found >> 32, found & 0xFFFFFFFF
        touched, whole = np.zeros(len(start), bool), np.zeros(len(start), bool)
        merged: list[list[int]] = []
        for own, low in zip(spans, base.tolist()):
            for s, _, e in own:
                if merged and s + low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e + low)
                else:
                    merged.append([s + low, e + low])
        if merged:
            low, high = np.array([[-1, -1], *merged, [len(codes)] * 2], np.int64).T
            k = np.searchsorted(low, start, "right") - 1
            whole, touched = high[k] >= end, (high[k] > start) | (low[k + 1] < end)
        return cls(codes, spans, np.searchsorted(base, start, "right") - 1, start, end, touched, whole, base)


def made_up(findings: int, others: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of invented keys and of invented words, names, numbers, dates and addresses.

    They stand in where a table has few findings or few other candidates of its own.
    """
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda of, low, high: "".join(rng.choice(list(of), rng.integers(low, high)))
    word = lambda: "".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) + rng.choice(["", "", "n", "s", "r"]) for _ in range(rng.integers(3, 6)))
    digits = "0123456789"
    alphabets = ("0123456789abcdef", letters + letters.upper() + digits, letters + digits, letters.upper() + digits, letters + letters.upper() + digits + "+/_-!@#$%")
    key = lambda: pick(alphabets[rng.integers(5)], 12, 41)
    plain = (word, lambda: word().title(), lambda: f"{word()}-{word()}", lambda: pick(digits, 6, 12), lambda: f"20{pick(digits, 2, 3)}-0{pick('12345678', 1, 2)}-1{pick(digits, 1, 2)}",
             lambda: f"{word()}.{pick(digits, 1, 3)}", lambda: f"mail{pick(digits, 1, 2)}.example.com", lambda: f"www.{word()}.org/{word()}/{word()}.html", lambda: word().upper())
    before = ("token = ", "password: ", "", "secret=", "api_key = ")
    rows = []
    for i in range(findings + others):
        body = key() if i < findings else plain[rng.integers(len(plain))]()
        lead = f"{word()} {word()} " + (before[rng.integers(5)] if i < findings else "")
        rows.append(windows_of(encode(lead + body + " " + word()), np.array([len(lead)]), np.array([len(lead) + len(body)]))[0][0])
    return np.array(rows, np.uint8).reshape(-1, WIDTH), np.r_[np.ones(findings, np.int64), np.zeros(others, np.int64)]


@dataclass
class CharNet:
    """Embedding → convolution of five characters → max and mean pools → logistic, with its threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0
    tables: tuple | None = field(default=None, repr=False)

    SPAN = 5

    def forward(self, codes: np.ndarray):
        inside = ((np.arange(WIDTH) >= LEFT) & (np.arange(WIDTH) < LEFT + BODY)).astype(float)
        x = np.concatenate([self.embed[codes], np.broadcast_to(inside[None, :, None], (*codes.shape, 1))], 2)
        cols = np.lib.stride_tricks.sliding_window_view(x, self.SPAN, axis=1).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        pooled = np.concatenate([z.max(1), z.mean(1), np.ones((len(x), 1))], 1)
        return cols, z, pooled, pooled @ self.out

    def prepared(self) -> tuple[np.ndarray, ...]:
        """What two neighbours, the fifth character and a place add to the filters; the last row by row for a stretch inside a body.

        What the first place adds is in the first table, and 0 in that of the places.
        """
        size = WIDTH - self.SPAN + 1
        if self.tables is None:
            kernel = self.conv.reshape(self.embed.shape[1] + 1, self.SPAN, -1)
            inside = ((np.arange(WIDTH) >= LEFT) & (np.arange(WIDTH) < LEFT + BODY)).astype(float)
            one = [self.embed @ kernel[:-1, k] for k in range(self.SPAN)]
            two = [(one[k][:, None] + one[k + 1][None]).reshape(-1, self.conv.shape[1]).astype(np.float32) for k in (0, 2)]
            base = sum(inside[k:k + size, None] * kernel[-1, k] for k in range(self.SPAN)).astype(np.float32)
            two[0] += self.bias.astype(np.float32)
            self.tables = (*two, one[4].astype(np.float32), base, np.tile(base[LEFT], (PLACES + WIDTH, 1)))
        return self.tables

    def pooled_logit(self, codes: np.ndarray, reach: int = BODY - 4) -> np.ndarray:
        """The last value of ``forward`` in single precision, from tables of what two neighbours add to the filters.

        Bodies of at most ``reach`` characters leave the places behind them all padding: the same for every window.
        """
        size = WIDTH - self.SPAN + 1
        first, second, last, base, _ = self.prepared()
        pair = codes[:, :-1].astype(np.intp) * len(self.embed) + codes[:, 1:]
        at = np.r_[0:LEFT + reach, LEFT + BODY - 4:size]
        z = first.take(pair[:, at], axis=0, mode="clip")
        z += second.take(pair[:, at + 2], axis=0, mode="clip")
        z += last.take(codes[:, at + 4], axis=0, mode="clip")
        z += base[at]
        np.maximum(z, 0, out=z)
        top, total = z.max(1), z.sum(1)
        if len(at) < size:
            padding = np.maximum(first[0] + second[0] + last[0] + base[LEFT + reach:LEFT + BODY - 4], 0)
            top, total = np.maximum(top, padding.max(0)), total + padding.sum(0)
        f = z.shape[2]
        return top @ self.out[:f] + total / size @ self.out[f:-1] + self.out[-1]

    def logits(self, laid: np.ndarray, at: np.ndarray, stop: np.ndarray, blank: bool = False) -> np.ndarray:
        """``pooled_logit`` of the windows with bodies ``at`` … ``stop`` of laid texts, or of their bodies alone.

        Filters run once along the text and are pooled over the stretches of each window; only the four places at
        either end of a body are its own. Bodies that reach the last places of a window are cut out.
        """
        out = np.empty(len(at))
        long = stop - at > BODY - self.SPAN + 1
        for rows in np.array_split(np.flatnonzero(long), long.sum() // 96 + 1) if long.any() else ():
            codes = cut_out(laid, at[rows], stop[rows])
            out[rows] = self.pooled_logit(blanked(codes) if blank else codes)
        order = np.argsort(at, kind="stable")
        order = order[~long[order]]
        cuts = np.searchsorted(at[order], np.arange(0, len(laid) + PLACES, PLACES))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                out[order[lo:hi]] = self._along(laid, at[order[lo:hi]], stop[order[lo:hi]], blank)
        return out

    def _along(self, laid: np.ndarray, at: np.ndarray, stop: np.ndarray, blank: bool) -> np.ndarray:
        """``logits`` of bodies that begin within PLACES of one another, in order.

        Means are linear in the filters, so running sums of one number a place give those of any stretch; the largest
        of a stretch is that of two overlapping ones of 2, 4, 8 or 16 places.
        """
        first, second, last, base, inside = self.prepared()
        filters, chars = self.conv.shape[1], len(self.embed)
        low = at[0] - LEFT
        c = laid[low:stop.max() + RIGHT].astype(np.intp)
        s, e = at - low, stop - low
        pair, n = c[:-1] * chars + c[1:], len(c) - 4
        raw = first.take(pair[:n], axis=0, mode="clip")
        raw += second.take(pair[2:2 + n], axis=0, mode="clip")
        ends = raw.take(e - 4, axis=0, mode="clip")
        raw += last.take(c[4:], axis=0, mode="clip")
        wide, most, width = np.empty((4, n, filters), np.float32), raw, 1
        for level in wide:
            most = np.maximum(most[:-width], most[width:], out=level[:len(most) - width])
            width *= 2
        wide, level = wide.reshape(-1, filters), LEVEL[e - 4 - s]
        top = wide.take(level * n + s, axis=0, mode="clip")
        np.maximum(top, wide.take(level * n + e - 4 - (2 << level), axis=0, mode="clip"), out=top)
        top += base[LEFT]
        share = (self.out[filters:-1] / (WIDTH - self.SPAN + 1)).astype(np.float32)
        z = raw + inside[:n]
        sums = np.concatenate([[0.0], np.cumsum(np.maximum(z, 0, out=z) @ share, dtype=np.float64)])
        total = sums[e - 4] - sums[s]

        own = np.empty((8 if blank else 12, len(s), filters), np.float32)
        padding = second[0] + last[0] + base[LEFT]
        own[0] = ends
        own[0] += last[0] + base[LEFT]
        first.take(pair[e - 3], axis=0, mode="clip", out=own[1])
        own[1] += (second[::chars] + (last[0] + base[LEFT])).take(c[e - 1], axis=0, mode="clip")
        first.take(pair[e - 2], axis=0, mode="clip", out=own[2])
        own[2] += padding
        (first[::chars] + padding).take(c[e - 1], axis=0, mode="clip", out=own[3])
        padding = np.maximum(first[0] + padding, 0)
        # The four places at which padding comes before what is read: the body itself, or what stands behind it.
        x, place = (s, LEFT - 4) if blank else (e, LEFT + BODY - 4)
        (last + (first[0] + second[0] + base[place])).take(c[x], axis=0, mode="clip", out=own[4])
        second[:chars].take(c[x], axis=0, mode="clip", out=own[5])
        second.take(pair[x], axis=0, mode="clip", out=own[6])
        second.take(pair[x + 1], axis=0, mode="clip", out=own[7])
        own[7] += first[:chars].take(c[x], axis=0, mode="clip")
        for k in (1, 2, 3):
            own[4 + k] += (last + (base[place + k] + (first[0] if k < 3 else 0))).take(c[x + k], axis=0, mode="clip")
        if blank:
            outside = np.maximum(first[0] + second[0] + last[0] + np.concatenate([base[:LEFT - 4], base[LEFT + BODY - 4:]]), 0)
            np.maximum(top, outside.max(0), out=top)
            total += float((outside @ share).sum())
        else:
            for k in range(4):
                raw.take(s - 4 + k, axis=0, mode="clip", out=own[8 + k])
                own[8 + k] += base[LEFT - 4 + k]
            np.maximum(top, wide.take(3 * n + s - LEFT, axis=0, mode="clip"), out=top)
            np.maximum(top, wide.take(n + e, axis=0, mode="clip"), out=top)
            sums = np.concatenate([[0.0], np.cumsum(np.maximum(raw, 0, out=raw) @ share, dtype=np.float64)])
            total += sums[s - 4] - sums[s - LEFT] + sums[e + 4] - sums[e]
        np.maximum(own, 0, out=own)
        total += (own.reshape(-1, filters) @ share).reshape(len(own), -1).sum(0)
        np.maximum(top, own.max(0), out=top)
        times = BODY - 4 - (e - s)
        np.maximum(top, np.where(times[:, None] > 0, padding, 0), out=top)
        return top @ self.out[:filters] + total + times * float(padding @ share) + self.out[-1]

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        short = ~codes[:, LEFT + SHORT:LEFT + BODY].any(1)
        logit = np.empty(len(codes))
        for rows, reach in ((np.flatnonzero(short), SHORT), (np.flatnonzero(~short), BODY - 4)):
            for i in range(0, len(rows), 96):
                part = rows[i:i + 96]
                logit[part] = self.pooled_logit(codes[part], reach)
        return self.chance(logit)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out]

    def slopes(self, c: np.ndarray, cols: np.ndarray, z: np.ndarray, pooled: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """How the loss changes with each of ``params``, where it changes with the logits by ``d``; the rest is from ``forward``."""
        filters = self.conv.shape[1]
        d_pool = d[:, None] * self.out[:-1]
        dz = np.broadcast_to(d_pool[:, None, filters:] / z.shape[1], z.shape).copy()
        np.put_along_axis(dz, z.argmax(1)[:, None], np.take_along_axis(dz, z.argmax(1)[:, None], 1) + d_pool[:, None, :filters], 1)
        dz *= z > 0
        d_cols = (dz @ self.conv.T).reshape(len(c), z.shape[1], self.embed.shape[1] + 1, self.SPAN)
        d_embed = np.zeros_like(self.embed)
        for k in range(self.SPAN):
            np.add.at(d_embed, c[:, k:k + z.shape[1]], d_cols[:, :, :-1, k])
        return [d_embed, np.einsum("nij,nik->jk", cols, dz, optimize=True), dz.sum((0, 1)), pooled.T @ d]

    @classmethod
    def fit(cls, codes: np.ndarray, y: np.ndarray, recall: float = 0.98, rounds: int = 10, filters: int = 16, dims: int = 8, seed: int = 3) -> CharNet:
        """Adam on the first four fifths; calibration and threshold on the rest.

        The threshold is the largest that keeps ``recall`` of the held-back findings, of invented ones too only where
        fewer than five others are held back. Below 200 findings or 200 other windows, invented ones fill up
        (``made_up``).
        """
        own = len(y)
        more, label = made_up(max(0, 200 - int(y.sum())), max(0, 200 - int((1 - y).sum())))
        codes, y = np.concatenate([codes, more]), np.concatenate([y, label])
        rng = np.random.default_rng(seed)
        net = cls(rng.normal(0, 0.3, (97, dims)), rng.normal(0, 0.2, ((dims + 1) * cls.SPAN, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters + 1))
        order = rng.permutation(len(y))
        part, held = order[: 4 * len(y) // 5], order[4 * len(y) // 5:]
        steps = Steps(net)
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(part), max(1, len(part) // 128)):
                c = codes[rows].copy()
                blank = rng.random(len(rows)) < 0.5
                c[blank] = blanked(c[blank])
                cols, z, pooled, logit = net.forward(c)
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
                steps.take(net.slopes(c, cols, z, pooled, d))
        logit = np.concatenate([net.forward(codes[held[i:i + 512]])[3] for i in range(0, len(held), 512)])
        net.scale = platt(logit, y[held])
        seen = held[(y[held] == 1) & (held < own)]
        found = np.sort(net.probability(codes[seen if len(seen) >= 5 else held[y[held] == 1]]))
        if len(found):
            net.threshold = float(found[int((1 - recall) * len(found))])
        return net


class Steps:
    """Adam on the parameters of a network."""

    def __init__(self, net: CharNet, rate: float = 0.01):
        self.net, self.rate, self.done = net, rate, 0
        self.first, self.second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))

    def take(self, slopes: Sequence[np.ndarray], ease: float = 1.0) -> None:
        self.done += 1
        for p, g, m, v in zip(self.net.params(), slopes, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= ease * self.rate * (m / (1 - 0.9**self.done)) / (np.sqrt(v / (1 - 0.999**self.done)) + 1e-8)
        self.net.tables = None


def blanked(codes: np.ndarray) -> np.ndarray:
    """Windows of bodies alone."""
    out = codes.copy()
    out[:, :LEFT], out[:, LEFT + BODY:] = 0, 0
    return out


def platt(logit: np.ndarray, y: np.ndarray, rounds: int = 200, times: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and shift that turn logits, each standing ``times`` over, into probabilities, with smoothed targets."""
    times = np.ones(len(y)) if times is None else times
    t = np.where(y == 1, ((times * y).sum() + 1) / ((times * y).sum() + 2), 1 / ((times * (1 - y)).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = times * (p * (1 - p) + 1e-6)
        h = np.array([[(w * logit**2).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(times * (t - p) * logit).sum(), (times * (t - p)).sum()])
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


#: Places that filters run along at once; windows that a step of the learning takes, at first and later.
PLACES, FEW, MANY = 1 << 13, 1 << 4, 1 << 11
#: Logits within this distance of the border, on the right side, have no slope left.
MARGIN = 3.0
#: Findings that come again with every step.
AGAIN = 128
#: Small tables are gone through again until so many windows were met, at most so often.
ENOUGH, TURNS = 1 << 21, 8
#: Logits of held-back windows are counted in steps of 1 / FINE up to MOST.
FINE, MOST = 256, 40


def held_back(text: str) -> bool:
    """Whether a text is kept from learning: every fifth of the distinct ones."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 5 == 0


def hashed(w: np.ndarray) -> np.ndarray:
    words = np.pad(w, ((0, 0), (0, -WIDTH % 8))).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(words ^ mix64(np.arange(words.shape[1]))).sum(1, dtype=np.uint64)).view(np.int64)


def in_groups(texts: Iterable[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """Texts in groups of bounded length; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def windows_met(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Laid codes, begin, stop and label of all windows, by groups of texts."""
    for group in in_groups(texts):
        laid = Laid.of(group)
        at, stop, times = pieces_of(laid.start, laid.end)
        yield laid.codes, at, stop, np.repeat(laid.touched, times)


def learn_along(net: CharNet, texts: Iterable[str], invented: np.ndarray, turn: int = 0) -> tuple[int, int]:
    """One turn over all windows of the texts, changing ``net``; how many there were and how many are findings.

    Every window is scored, every other step without surroundings, and enters the step by the slope of a loss that is
    flat from MARGIN on: a window beyond it has none, so only the others cost a way back. Findings are few beside the
    others: all of a step's and the last AGAIN before them stand against its other windows, with ``invented`` keys.
    """
    steps, rng, again = Steps(net), np.random.default_rng([7, turn]), {}
    met = findings = 0
    flat = lambda x: np.clip((x + MARGIN) / MARGIN, 0, 1)
    for codes, at, stop, label in windows_met(texts):
        order, done = np.argsort(at, kind="stable"), 0
        while done < len(order):
            rows = order[done:done + min(MANY, max(FEW, met // 16))]
            done, met, findings = done + len(rows), met + len(rows), findings + int(label[rows].sum())
            alone = (steps.done + turn) % 2 == 1
            other = rows[~label[rows]]
            other = other[net.logits(codes, at[other], stop[other], alone) > -MARGIN]
            own = cut_out(codes, at[rows[label[rows]]], stop[rows[label[rows]]])
            wanted = np.concatenate([own, *[w[None] for w in again.values()], invented[rng.integers(len(invented), size=32)]])
            again.update((w.tobytes(), w) for w in own)
            for gone in list(again)[:-AGAIN]:
                del again[gone]
            hidden = rng.random(len(wanted)) < 0.5
            wanted[hidden] = blanked(wanted[hidden])
            total = None
            for side, sign, part in [(wanted, -1, wanted[i:i + 512]) for i in range(0, len(wanted), 512)] + [
                    (other, 1, other[i:i + 512]) for i in range(0, len(other), 512)]:
                if sign > 0:
                    part = cut_out(codes, at[part], stop[part])
                    part = blanked(part) if alone else part
                cols, z, pooled, logit = net.forward(part)
                d = sign * flat(sign * logit) / max(32, len(side))
                some = d != 0
                if some.any():
                    slopes = net.slopes(part[some], cols[some], z[some], pooled[some], d[some])
                    total = slopes if total is None else [a + b for a, b in zip(total, slopes)]
            if total is None:
                steps.done += 1
            else:
                steps.take(total, (1 + steps.done / 64) ** -0.5)
    return met, findings


def learn(docs: DataFrame, recall: float = 0.98) -> CharNet:
    """Fit on every window of the texts that are not held back; threshold and calibration from every held-back window.

    Each task takes its rows' windows step by step (``learn_along``) from the same start, a network of made-up keys and
    words; the mean of the parameters, weighted by windows, is the next start. Only parameters and counts of logits
    reach the driver. The threshold keeps ``recall`` of the held-back findings, equal ones counted once; where fewer than
    five are held back, invented ones count with them. Invented keys take part in every step. The same files give the same network.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.filter("text is not null").select("text")
    keys, label = made_up(500, 1500)
    net = CharNet.fit(keys, label)
    invented, seen = keys[label == 1], 0
    for turn in range(TURNS):
        def along(batches, start=net, turn=turn):
            own = CharNet(*[p.copy() for p in start.params()])
            met, _ = learn_along(own, (t for pdf in batches for t in pdf["text"] if not held_back(t)), invented, turn)
            if met:
                yield pd.DataFrame({"met": [met], "params": [np.concatenate([p.ravel() for p in own.params()]).tobytes()]})

        got = sorted((r["met"], bytes(r["params"])) for r in texts.mapInPandas(along, "met long, params binary").collect())
        if not got:
            break
        mean = np.average([np.frombuffer(p) for _, p in got], axis=0, weights=[n for n, _ in got])
        ends = np.cumsum([p.size for p in net.params()])[:-1]
        net = CharNet(*[x.reshape(p.shape) for x, p in zip(np.split(mean, ends), net.params())])
        seen += sum(n for n, _ in got)
        if seen >= ENOUGH:
            break

    def counted(batches):
        for codes, at, stop, y in windows_met(t for pdf in batches for t in pdf["text"] if held_back(t)):
            step = np.floor(np.clip(net.logits(codes, at, stop), -MOST, MOST) * FINE).astype(np.int64)
            h = np.zeros(len(at), np.int64)
            h[y] = hashed(cut_out(codes, at[y], stop[y]))
            rows = pd.DataFrame({"y": y.astype(np.int64), "step": step, "h": h, "n": 1})
            yield rows.groupby(["y", "step", "h"], as_index=False)["n"].sum()

    once = texts.mapInPandas(counted, "y long, step long, h long, n long").groupBy("y", "step", "h").agg(F.sum("n").alias("n"))
    counts = once.groupBy("y", "step").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(F.col("n"))).alias("n")).toPandas()
    y, at, n = (counts[c].to_numpy(np.int64) for c in ("y", "step", "n"))
    more, label = made_up(max(0, 40 - int(n[y == 1].sum())), max(0, 40 - int(n[y == 0].sum())), seed=12)
    extra = np.floor(np.clip(net.pooled_logit(more), -MOST, MOST) * FINE).astype(np.int64)
    net.scale = platt(np.r_[at, extra] / FINE, np.r_[y, label], times=np.r_[n, np.ones(len(label), np.int64)])
    found, times = at[y == 1], n[y == 1]
    if times.sum() < 5:
        found, times = np.r_[found, extra[label == 1]], np.r_[times, np.ones(int(label.sum()), np.int64)]
    order = np.argsort(found, kind="stable")
    rank = np.searchsorted(np.cumsum(times[order]), int((1 - recall) * times.sum()), side="right")
    net.threshold = float(net.chance(found[order][rank:rank + 1] / FINE)[0])
    return net


def spans_of(texts: Sequence[str], net: CharNet) -> list[tuple[list, list]]:
    """(start, kind, end) of the pattern matches of each text, and of the candidates not wholly covered by them that
    the network calls secrets.
    """
    out = []
    for group in in_groups(texts):
        laid = Laid.of(group)
        open_ = np.flatnonzero(~laid.whole)
        added: list[list] = [[] for _ in group]
        if len(open_):
            at, stop, times = pieces_of(laid.start[open_], laid.end[open_])
            best = np.maximum.reduceat(net.chance(net.logits(laid.codes, at, stop)), np.cumsum(times) - times)
            for i in open_[best >= net.threshold]:
                low = laid.base[laid.text[i]]
                added[laid.text[i]].append((int(laid.start[i] - low), 3, int(laid.end[i] - low)))
        out += zip(laid.spans, added)
    return out


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Other columns of ``docs`` with n_assign, n_access, n_hex, base_sha256 and spans of each whole text.

    Null and empty texts have no spans; repeated rows give equal results; a null doc_id stays null; an empty
    table gives no rows. Pattern spans are never dropped. Each text is read three times (small tables more often): to
    learn from its windows, for those held back, and to score its candidates.
    """
    net = learn(docs)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for own, added in spans_of(texts, net):
            kinds = [k for _, k, _ in own]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spelled(own).encode()).hexdigest(), spelled(own + added)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rest = [c for c in docs.columns if c != "text"]
    return docs.withColumn("__found", run(F.coalesce("text", F.lit("")))).select(*rest, "__found.*")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; rows and other columns stay as they are."""
    net = learn(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        spans = spans_of([t or "" for t in texts], net)
        return pd.Series([None if t is None else without(t, own + added, mark) for t, (own, added) in zip(texts, spans)], dtype=object)

    return docs.withColumn("text", clean("text"))


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    spans = sorted(spans)
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def op9(spark, folder: str) -> DataFrame:
    """Secrets of every whole document, pattern spans and those the network adds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
