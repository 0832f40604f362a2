"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The base patterns give spans that always stay. The tagger reads characters as classes, and
adds spans that the patterns miss: numbers in another writing, and secrets (keys, tokens and passwords), a
kind without a base pattern. Windows in which no span could pass its kind's check (no digit, no ``@``, no run of a key)
aren't scored unless a span reaches into them: the result is that of scoring all, which a test holds. It is trained in numpy, once for a driver process, from labelled spans: texts put
together from templates with a fixed seed, so no corpus row is read for training. ``measured`` reports
precision and recall by kind on labelled texts of other templates than the trainer's.

A text is cut into overlapping windows, ``STEP`` characters apart. Windows are scored in batches and decoded by Viterbi. A
bound over two tags, "outside" and the best of all others with the dearest transitions, leaves the windows that may hold
a span; of these the best score is made first, and the way back only where "outside" throughout isn't best.
Each character has the tag of the window that sees most around it, and spans are read from the tags of all windows
in a row, so that they may be of any length; a secret goes on to the ends of the run of key characters that it is
in. Spans are then reconciled over the text: of spans that overlap, the longer and then the earlier one stays, none
that overlaps a base span, and none that fails its kind's check (number of digits, an ``@``, a secret's length and
changes between small letters, capitals and digits, of which a random key of 20 characters has fewer than four
in less than one case of a million).

The fitted weights are kept as a table in the shared folder, under a name that its parameters and the trainer's code
give, so that a later process reads them.

Defined results: null and empty texts have no spans; long texts are read whole, window after window; rows
are judged one by one, so repeated rows agree; other columns are kept, and one with the output's name is
replaced; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import exists, shared_folder, tidy

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STEP, UNIT, BATCH, SHOWN = 1024, 960, 64, 512, 80  # SHOWN: characters of a training text
MARGIN = (WINDOW - STEP) // 2  # of a window, what its neighbour sees better
#: Fixed classes of characters for the tagger; every other one is the last class, ASCII letters and digits have their own.
MARKS = " \n\t@.-_+%()/:=\"',;#*&$!?"
WIDE, LETTER, DIGIT = len(MARKS), len(MARKS) + 1, len(MARKS) + 3
CLASSES = len(MARKS) + 4

# -- base patterns ---------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A match can only start where a run of digits does, so no place inside a run is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: around each @, the whole run before it that no earlier match has."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP(text) if all(map(small_part, m[0].split(".")))]
    for m in _CARD(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# -- the tagger --------------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    table = np.full(128, WIDE, np.int8)
    for i, c in enumerate(MARKS):
        table[ord(c)] = i
    for c in range(128):
        if chr(c).isalpha():
            table[c] = LETTER + chr(c).isupper()
        elif chr(c).isdigit():
            table[c] = DIGIT
    return table


TABLE = _table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], WIDE)


def allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of the same kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, two LSTM directions, tag scores, CRF transitions; weights in one dict."""

    def __init__(self, hidden: int = 16, size: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        self.hidden = hidden
        self.w = {"e": normal(CLASSES + 1, size), "out": normal(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.w[d] = normal(size + hidden, 4 * hidden)
            self.w[d + "0"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.closed = np.where(allowed(), 0, -1e4).astype(np.float32)
        self.first = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0).astype(np.float32)
        self.first[0] = 0

    def run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time for inputs (batch, time, size)."""
        h_n, (n, steps, _) = self.hidden, x.shape
        w, b = self.w[way], self.w[way + "0"]
        given = x @ w[: x.shape[2]] + b
        h, c = np.zeros((n, h_n), np.float32), np.zeros((n, h_n), np.float32)
        out = np.empty((n, steps, h_n), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ w[x.shape[2] :]
            i, f, o = sigmoid(z[:, :h_n]), sigmoid(z[:, h_n : 2 * h_n]), sigmoid(z[:, 2 * h_n : 3 * h_n])
            g = np.tanh(z[:, 3 * h_n :])
            old, before = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, old, s, before))
        return out

    def states(self, x: np.ndarray, way: str) -> np.ndarray:
        """Hidden states (time, hidden, batch) for windows of classes (time, batch), as ``run`` gives them, without what training keeps.

        Gates are rows, so that all work is on whole rows. A gate is 0.5 + 0.5 tanh(z / 2): one tanh serves gates and cells.
        """
        h_n, size, (steps, n) = self.hidden, self.w["e"].shape[1], x.shape
        half = np.concatenate([np.full(3 * h_n, 0.5), np.ones(h_n)])[:, None]
        given = np.ascontiguousarray(((self.w["e"] @ self.w[way][:size] + self.w[way + "0"]).T * half).astype(np.float32))
        w = np.ascontiguousarray((self.w[way][size:].T * half).astype(np.float32))
        c, out = np.zeros((h_n, n), np.float32), np.empty((steps, h_n, n), np.float32)
        z, seen, held = np.empty((4 * h_n, n), np.float32), np.empty((4 * h_n, n), np.float32), np.empty((h_n, n), np.float32)
        gates, keep, cell = z[: 3 * h_n], z[h_n : 2 * h_n], z[3 * h_n :]
        h = c
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            np.matmul(w, h, out=z)
            z += np.take(given, x[t], 1, out=seen, mode="clip")
            np.tanh(z, out=z)
            gates *= 0.5
            gates += 0.5
            np.multiply(z[:h_n], cell, out=held)
            c = c * keep
            c += held
            h = np.tanh(c, out=out[t])
            h *= z[2 * h_n : 3 * h_n]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(time, tag, batch) for windows of classes (time, batch)."""
        h_n, out = self.hidden, self.w["out"].astype(np.float32)
        s = np.matmul(np.ascontiguousarray(out[:h_n].T), self.states(x, "f"))
        s += np.matmul(np.ascontiguousarray(out[h_n:].T), self.states(x, "b"))
        s += self.w["bias"].astype(np.float32)[:, None]
        return s

    def near(self, s: np.ndarray) -> np.ndarray:
        """Windows of scores (time, tag, batch) in which a path with a span could be better than "outside" throughout.

        Spans between two places outside are bounded one by one: at each place the best tag that isn't outside counts, between
        places the most that any transition gives, so that no path has more.
        """
        moves = self.w["t"] + self.closed - self.w["t"][0, 0]
        enter, leave, stay = moves[0, 1::2].max(), moves[1:, 0].max(), moves[1:, 1:].max()
        begin = s[:, 1::2].max(1) - s[:, 0]
        other = np.maximum(begin, s[:, 2::2].max(1) - s[:, 0])
        begin += enter
        other += stay
        run = begin[0] - enter
        best = run + max(leave, 0.0)
        for a, b in zip(begin[1:], other[1:]):
            run = np.maximum(run + b, a)
            np.maximum(best, run + leave, out=best)
        return np.maximum(best, run) > -1e-3  # a span may go on beyond the last place

    def may_hold(self, s: np.ndarray) -> np.ndarray:
        """Which windows of scores (time, tag, batch) have a better path than "outside" throughout: Viterbi without the way back.

        An inside tag only follows its kind's begin or inside; all other tags may follow any.
        """
        moves, free = self.w["t"] + self.closed, [0, *range(1, TAGS, 2)]
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        from_begin, from_inside = moves[begin, inside][:, None], moves[inside, inside][:, None]
        best = s[0] + self.first[:, None]
        outside, new = best[0], np.empty_like(best)
        for now in s[1:]:
            for k in free:
                (best + moves[:, k, None]).max(0, out=new[k])
            np.maximum(best[1::2] + from_begin, best[2::2] + from_inside, out=new[2::2])
            outside = outside + moves[0, 0] + now[0]
            best = new + now
        return best.max(0) > outside

    def decode(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """The best tags of those windows (batch, time) that hold a span, by Viterbi."""
        s = self.scores(np.ascontiguousarray(x.T))
        open_, moves = np.flatnonzero(self.near(s)), self.w["t"] + self.closed
        if len(open_):
            open_ = open_[self.may_hold(np.ascontiguousarray(s[:, :, open_]))]
        s = np.ascontiguousarray(s[:, :, open_].transpose(0, 2, 1))
        best = s[0] + self.first
        back = np.empty(s.shape, np.int8)
        for t in range(1, len(s)):
            ways = best[:, None, :] + moves.T
            back[t] = ways.argmax(2)
            best = ways.max(2) + s[t]
        tags = np.empty(s.shape[:2], np.int8)
        tags[-1] = best.argmax(1)
        for t in range(len(s) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t, :, None].astype(np.int64), 1)[:, 0]
        return dict(zip(open_.tolist(), tags.T))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood over the batch."""
        w, n, steps, h_n = self.w, *x.shape, self.hidden
        e, kept = w["e"][x], {"f": [], "b": []}
        states = np.concatenate([self.run(e, d, kept[d]) for d in "fb"], 2)
        s, moves = states @ w["out"] + w["bias"], w["t"] + self.closed
        # forward and backward over probabilities, each place scaled to a sum of 1
        step, p = np.exp(moves), np.exp(s - s.max(2, keepdims=True)).transpose(1, 0, 2)
        ahead, scale = np.empty_like(p), np.empty((steps, n, 1), p.dtype)
        for t in range(steps):
            now = p[t] * (ahead[t - 1] @ step if t else np.exp(self.first))
            scale[t] = now.sum(1, keepdims=True)
            ahead[t] = now / scale[t]
        behind, grad_t = np.ones_like(p[0]), np.zeros_like(moves)
        share = np.empty_like(s)
        share[:, -1] = ahead[-1]
        for t in range(steps - 1, 0, -1):
            held = p[t] * behind / scale[t]
            grad_t += ahead[t - 1].T @ held
            behind = held @ step.T
            share[:, t - 1] = ahead[t - 1] * behind
        grad_t = grad_t * step - np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        rows = np.arange(n)
        share[rows[:, None], np.arange(steps), y] -= 1
        d = share / n
        out = {"t": grad_t / n * allowed(), "bias": d.sum((0, 1)), "out": np.einsum("nth,ntk->hk", states, d)}
        d_states, d_e = d @ w["out"].T, np.zeros_like(e)
        for half, way in enumerate("fb"):
            size, own = e.shape[2], w[way]
            d_h, d_c = np.zeros((n, h_n), np.float32), np.zeros((n, h_n), np.float32)
            grad, grad0 = np.zeros_like(own), np.zeros_like(w[way + "0"])
            for t, i, f, o, g, old, c, before in reversed(kept[way]):
                d_h = d_h + d_states[:, t, half * h_n : (half + 1) * h_n]
                d_c = d_c + d_h * o * (1 - c * c)
                z = np.concatenate([d_c * g * i * (1 - i), d_c * old * f * (1 - f), d_h * c * o * (1 - o), d_c * i * (1 - g * g)], 1)
                grad[:size] += e[:, t].T @ z
                grad[size:] += before.T @ z
                grad0 += z.sum(0)
                d_e[:, t] += z @ own[:size].T
                d_h, d_c = z @ own[size:].T, d_c * f
            out[way], out[way + "0"] = grad, grad0
        out["e"] = np.zeros_like(w["e"])
        np.add.at(out["e"], x, d_e)
        return out


def _pick(rng, xs):
    return xs[rng.integers(len(xs))]


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _letters(rng, a: int, b: int) -> str:
    return "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(a, b)))


def _of(rng, alphabet: str, a: int, b: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(a, b)))


HEX, MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def card_number(rng, seps=("", " ", "-")) -> str:
    n = int(rng.integers(16, 20))
    body = _number(rng, n - 1)
    body += next(c for c in "0123456789" if luhn(body + c))
    return _pick(rng, list(seps)).join(body[k : k + 4] for k in range(0, n, 4))


def makers(rng) -> dict:
    """A written form of each kind, for training."""
    pick, number, letters = (lambda xs: _pick(rng, xs)), (lambda n: _number(rng, n)), (lambda a, b: _letters(rng, a, b))

    def email() -> str:
        local = pick([letters(2, 8), letters(1, 6) + pick("._-+") + letters(2, 6), letters(1, 5) + pick("._-") + letters(1, 5) + number(int(rng.integers(1, 3))), letters(2, 6) + number(2), number(2), number(3), letters(2, 5) + "." + number(2)])
        return local + pick(["@", "@", " @ ", " @ ", "@ "]) + pick([letters(3, 8), letters(3, 6) + number(1), letters(2, 5) + "-" + letters(1, 5), letters(3, 7) + "." + letters(3, 7)]) + pick([".com", ".org", ".net", ".example.com", number(1) + ".example.com", "." + letters(2, 5)])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1{a}{b}{c}", f"{number(3)} {number(3)} {number(4)}", f"0{number(2)} {number(4)} {number(4)}"])

    def secret() -> str:
        return pick([_of(rng, HEX, 32, 41), _of(rng, HEX.upper(), 32, 41), _of(rng, MIXED, 20, 41), _of(rng, MIXED, 16, 33), _of(rng, MIXED[:52], 20, 33), "AKIA" + _of(rng, MIXED[:26] + "0123456789", 16, 17), _of(rng, MIXED + "_-", 24, 41)])

    return {"email": email, "ip": lambda: ".".join(str(k) for k in rng.integers(0, 256, 4)), "card": lambda: card_number(rng), "phone": phone, "secret": secret}


def fillers(rng) -> list:
    """Look-alikes that are none, for training."""
    number, letters = (lambda n: _number(rng, n)), (lambda a, b: _letters(rng, a, b))
    return [
        lambda: number(int(rng.integers(1, 5))), lambda: f"{number(2)}.{number(2)}", lambda: f"20{number(2)}-0{number(1)}-1{number(1)}", lambda: "@" + letters(3, 8),
        lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: number(int(rng.integers(20, 30))), lambda: f"{number(6)} {number(6)}",
        lambda: letters(20, 40), lambda: letters(3, 9) + number(2), lambda: "-".join(letters(3, 8) for _ in range(4)), lambda: f"{number(2)}:{number(2)}:{number(2)}",
        lambda: "".join(letters(3, 8).title() for _ in range(4)), lambda: "/".join(letters(3, 8) for _ in range(4)), lambda: letters(18, 30).upper(), lambda: "_".join(letters(2, 7) for _ in range(4)) + number(1),
    ]


#: What stands between words and forms in training texts.
GAPS = (" ", " ", " ", ". ", ", ", "\n", ": ", "; ", " - ", " | ", "! ", "? ", "* ", "# ", "> ", "\n\n", ") ", "... ", "\t", "!! ", "### ")


def example(rng: np.random.Generator, shown: int = SHOWN, made=None, none=None) -> tuple[str, list[tuple[str, int, int]]]:
    """A labelled text: filler with some written forms of personal data, and look-alikes that are none."""
    pick, made, none = (lambda xs: _pick(rng, xs)), made or makers(rng), none or fillers(rng)
    text, spans = "", []
    case = pick([str, str, str, str.upper, str.title])
    while len(text) < shown:
        text += case(" ".join(_letters(rng, 1, 9) for _ in range(rng.integers(1, 6)))) + pick(GAPS)
        r = rng.random()
        if r < 0.55:
            kind = pick((*KINDS, "phone", "email"))
            held = made[kind]()
            before, after = pick([("", "")] * 3 + [('"', '"'), ("(", ")")]) if kind != "secret" else pick([("", ""), ("", ""), ('= "', '"'), ("= ", ""), (": ", ""), (":", ""), ('"', '"'), ("'", "'"), ("(", ")"), ("[", "]"), ("<", ">"), (_letters(rng, 3, 9) + pick("=:"), ""), (_letters(rng, 3, 9).upper() + "=", ""), (_letters(rng, 3, 9) + pick(["='", "=\"", ": '", ":\""]), pick("'\""))])
            text += before
            spans.append((kind, len(text), len(text) + len(held)))
            held += after
        else:
            held = pick(none)() if r < 0.9 else ""
        text += held + pick(GAPS)
    shift = int(rng.integers(0, max(1, len(text) - shown + 1)))
    cut = [(k, a - shift, b - shift) for k, a, b in spans if a >= shift and b <= shift + shown]
    broken = [(a - shift, b - shift) for k, a, b in spans if (a < shift) != (b <= shift) or (a < shift + shown < b)]
    text = list(text[shift : shift + shown])
    for a, b in broken:  # a form that the edge cuts is not shown
        for k in range(max(a, 0), min(b, shown)):
            text[k] = "x"
    return "".join(text), cut


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    rng = np.random.default_rng(seed)
    made, none = makers(rng), fillers(rng)
    drawn = [example(rng, SHOWN if rng.random() < 0.6 else int(rng.integers(20, SHOWN)), made, none) for _ in range(n)]
    x = np.full((n, SHOWN), CLASSES, np.int64)  # what stands behind a text's end
    for row, (t, _) in zip(x, drawn):
        row[: len(t)] = classes(t)
    y = np.zeros(x.shape, np.int64)
    for row, (_, spans) in zip(y, drawn):
        for kind, a, b in spans:
            row[a:b] = 2 + 2 * KINDS.index(kind)
            row[a] -= 1
    return x, y, [t for t, _ in drawn], [s for _, s in drawn]


@lru_cache(maxsize=2)
def train(examples: int = 5120, rounds: int = 14, seed: int = 11, batch: int = 128) -> Tagger:
    """The fitted tagger: Adam over batches of the labelled texts, the same for the same parameters."""
    tagger, (x, y, _, _) = Tagger(), labelled(examples, seed)
    order, moments, step = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.w.items()}, 0
    for turn in range(rounds):
        rate = 0.03 * (1 - turn / rounds) + 0.001
        for rows in np.array_split(order.permutation(examples), max(1, examples // batch)):
            step += 1
            for k, g in tagger.gradient(x[rows], y[rows]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                tagger.w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


# -- windows over a text, and back ---------------------------------------------------------------------------

def windows(n: int) -> range:
    """Starts of the windows over a text of n characters."""
    return range(0, max(1, n - WINDOW + STEP), STEP) if n else range(0)


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    held = tags.tolist()
    while at < len(held):
        if held[at]:
            kind, end = (held[at] - 1) // 2, at + 1
            while end < len(held) and held[end] == 2 + 2 * kind:
                end += 1
            out.append((KINDS[kind], at, end))
            at = end
        else:
            at += 1
    return out


_KEY = re.compile(r"[A-Za-z0-9_+/-]++={0,2}").fullmatch
_KEY_PART = re.compile(r"[A-Za-z0-9_+/-]*+").match
_BACK = re.compile(r"[A-Za-z0-9_+/-]").match


def whole_key(text: str, a: int, b: int) -> tuple[int, int]:
    """The span out to the ends of its run of key characters."""
    while a > 0 and _BACK(text, a - 1):
        a -= 1
    return a, _KEY_PART(text, b).end() if _BACK(text, b - 1) else b


def changes(text: str) -> int:
    """How often a text goes from one of small letters, capitals and digits to another; other characters don't count."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in text if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def plausible(kind: str, text: str) -> bool:
    """The check of a kind for spans that the tagger adds."""
    n = len(digits_of(text))
    if kind == "email":
        return bool(re.fullmatch(r"\S+ ?@ ?\S+\.\S+", text))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text)) and all(map(small_part, text.split(".")))
    if kind == "secret":
        return 16 <= len(text) and bool(_KEY(text)) and changes(text) >= 4
    if kind == "card":
        return 16 <= n <= 19 and luhn(digits_of(text))
    return 8 <= n <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and not re.fullmatch(r"[0-9]+", text)


def reconcile(text: str, base: list, found: list) -> list[tuple[str, int, int]]:
    """Added spans over the whole text: none that meets a base span or a longer or earlier one."""
    taken, out = sorted((a, b) for _, a, b in base), []
    for kind, a, b in sorted(set(found), key=lambda s: (s[1] - s[2], s[1], KINDS.index(s[0]))):
        if plausible(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return out


def stitched(parts) -> list[tuple[str, int, int]]:
    """Spans of tags (start, tags) of a text in order, where parts that follow one another are read as one."""
    out, at = [], 0
    parts = list(parts)
    while at < len(parts):
        start, held = parts[at][0], [parts[at][1]]
        end = start + len(held[0])
        while at + 1 < len(parts) and parts[at + 1][0] == end:
            at += 1
            held.append(parts[at][1])
            end += len(held[-1])
        at += 1
        out += [(kind, start + a, start + b) for kind, a, b in spans_of(np.concatenate(held))]
    return out


_SIGN = re.compile("[0-9@]").search
_RUN = re.compile(r"[A-Za-z0-9_+/-]{14,}+").finditer  # up to two = may follow in a secret


def hopeful(text: str) -> Iterator[int]:
    """Numbers of the windows that hold anything that a check asks of a span: a digit, an @, or part of a key's run.

    What the tagger finds in others alone, ``plausible`` takes away, whatever it is.
    """
    runs = [m.span() for m in _RUN(text) if changes(m[0]) >= 4]
    keys = {k for a, b in runs for k in range(max(0, (a - WINDOW) // STEP), b // STEP + 1) if a < k * STEP + WINDOW and k * STEP < b}
    return (k for k, start in enumerate(windows(len(text))) if k in keys or _SIGN(text, start, start + WINDOW))


def find(texts, weights: dict) -> list[list[dict]]:
    """The spans of each text, by kind as listed and then start.

    Windows that aren't ``hopeful`` are read by the tagger where a span comes out of a neighbour, so that spans are whole.
    """
    tagger = Tagger()
    tagger.w = weights
    texts = [x or "" for x in texts]
    base, opened = [base_spans(x) for x in texts], {}
    waiting: dict[int, tuple[list, list]] = {}  # by the windows' size: a text's last one is as long as it must be
    met: set[tuple[int, int]] = set()

    def put(i: int, k: int) -> None:
        start, text = k * STEP, texts[i]
        if (i, k) in met or not 0 <= k < len(windows(len(text))):
            return
        met.add((i, k))
        size = min(WINDOW, -(-(len(text) - start) // UNIT) * UNIT)
        row = np.full(size, CLASSES, np.int8)
        coded = classes(text[start : start + size])
        row[: len(coded)] = coded
        where, rows = waiting.setdefault(size, ([], []))
        where.append((i, k))
        rows.append(row)
        if len(rows) == BATCH:
            flush(size)

    def flush(size: int) -> None:
        where, rows = waiting.pop(size)
        for row, tags in tagger.decode(np.stack(rows)).items():
            i, k = where[row]
            start = k * STEP
            a = MARGIN if start else 0
            b = min(len(texts[i]) - start, WINDOW if start + WINDOW >= len(texts[i]) else WINDOW - MARGIN)
            opened.setdefault(i, []).append((start + a, tags[a:b]))
            if tags[a] and tags[a] % 2 == 0:  # inside a span that began before
                put(i, k - 1)
            if tags[b - 1]:
                put(i, k + 1)

    for i, text in enumerate(texts):
        for k in hopeful(text):
            put(i, k)
    while waiting:
        flush(next(iter(waiting)))
    out = []
    for i, text in enumerate(texts):
        # the windows of a text come in the order of their sizes, not of their places
        found = [(kind, *whole_key(text, a, b)) if kind == "secret" else (kind, a, b) for kind, a, b in stitched(sorted(opened.get(i, ()), key=lambda part: part[0]))]
        new = reconcile(text, base[i], found)
        all_spans = [(k, a, b, True) for k, a, b in base[i]] + [(k, a, b, False) for k, a, b in new]
        all_spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append([dict(zip(("kind", "start", "end", "base"), s)) for s in all_spans])
    return out


def measured(weights: dict, texts: list[str], spans: list[list[tuple[str, int, int]]]) -> dict[str, tuple[int, int, int]]:
    """(right, given, labelled) spans of each kind over labelled texts, base spans included."""
    out = {k: [0, 0, 0] for k in KINDS}
    for made, want in zip(find(texts, weights), spans):
        given = {(s["kind"], s["start"], s["end"]) for s in made}
        for k in KINDS:
            a, b = {s for s in given if s[0] == k}, {s for s in want if s[0] == k}
            out[k] = [x + y for x, y in zip(out[k], (len(a & b), len(a), len(b)))]
    return {k: tuple(v) for k, v in out.items()}


def fitted(spark: SparkSession) -> dict[str, np.ndarray]:
    """The fitted weights, from the shared folder if this trainer has left them there."""
    trainer = "".join(inspect.getsource(x) for x in (Tagger, makers, fillers, example, labelled, train.__wrapped__))
    path = f"{shared_folder(spark)}/tagger-{hashlib.sha256((trainer + repr(GAPS)).encode()).hexdigest()[:16]}"
    if exists(spark, f"{path}/_SUCCESS"):
        return {r["name"]: np.frombuffer(bytes(r["held"]), np.float32).reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}  # nine arrays of fixed size
    weights = train().w
    rows = [(name, list(w.shape), bytearray(w.astype(np.float32).tobytes())) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, held binary").coalesce(1).write.mode("overwrite").parquet(path)
    return weights


def detect(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``docs`` with the spans of personal data in a text, in code points, the end exclusive."""
    weights = fitted(docs.sparkSession)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(find(texts, weights), dtype=object)

    return docs.withColumn(to, F.pandas_udf(tidy(found), SPANS, F.PandasUDFType.SCALAR_ITER)(F.col(text)))


def mask(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; spans that overlap by one mark for their union, with the kind of the first (of equal starts the longest)."""

    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for x, rows in zip(texts, found):
            parts, done = [], 0
            for s in sorted(rows, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= done:
                    parts += [x[done : s["start"]], f"[{s['kind'].upper()}]"]
                done = max(done, s["end"])
            out.append("".join([*parts, x[done:]]) if parts else x)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(masked, "string")(F.col(text), F.col(spans)))
