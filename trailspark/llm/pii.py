"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions that adds what patterns miss.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers.  The network, trained in numpy on labelled
spans, scores a tag (outside, or a kind) for every character of every text, in overlapping windows; it adds other spellings of these kinds, and secrets
(keys, tokens, passwords), for which there is no pattern.  Scores of overlapping windows
are averaged, weighed by the distance to the window's edge, and one Viterbi pass over the whole text decides all of its spans, so
that a span never depends on where a window happens to end.  (Most characters are outside in the best path for certain, by a bound on what any tagged segment could gain;
the pass steps through the others alone.)

An added span needs a mean probability of ``SURE``, doesn't overlap a pattern's span, doesn't begin or end within a word, and obeys what values of its kind obey
(a card's check digit, an address's bytes).

Defined results: a null text is empty and has no spans; repeated rows get repeated results; any length is read whole, windows being scored in slices (about
60 bytes are held for a character of the longest text of a step); columns other than the text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailspark.llm.common import steps

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that patterns find; secrets (keys, tokens, passwords) are found by the network alone.
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, so only the first digit of a run is tried: long runs cost no more than their length.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STRIDE, SLICE = 512, 464, 512  # slices small enough that products stay on one thread, as a worker has one core
#: A text's last window is as long as what it reads, to the next multiple of this.
TAIL = 128
HIDDEN, EMBEDDING = 12, 8
TAGS = 1 + len(KINDS)
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0@.+-() \n_%:/,=\"'#[]|"
OTHER_LETTER, OTHER = len(SYMBOLS), len(SYMBOLS) + 1
TRAIN_WINDOW, TRAIN_WINDOWS, EPOCHS, BATCH = 112, 5000, 12, 100
#: Least mean probability of a span's tags.
SURE = 0.8

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping for each kind, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- network ---------------------------------------------------------------------------------------------------------

_CODE = np.full(0x110000, OTHER, np.uint8)
_CODE[[c for c in range(0xAA, 0x2FA20) if chr(c).isalpha()]] = OTHER_LETTER
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i
_CODE[[ord(_c) for _c in "0123456789"]] = SYMBOLS.index("0")


def encode(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@dataclass
class Network:
    """An embedding of characters, one LSTM for each direction (row 0 forward, 1 backward), an output layer, and CRF transitions.

    A gate is (1 + tanh) / 2 of its input, that is 1 / (1 + exp(-2 x)), and the candidate's tanh is two of those less one: one call serves all four of a step.
    """

    embedding: np.ndarray  # D x symbols
    loops: np.ndarray  # 2 x 4H x (H + D + 1): weights of input, forget and output gate and of the candidate, for the state, the character and a bias
    output: np.ndarray  # tags x 2H
    bias: np.ndarray  # tags
    moves: np.ndarray  # tags x tags

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.loops, self.output, self.bias, self.moves]


def sigmoid(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place of x, which is the sigmoid's input with its sign turned; an exp beyond all bounds gives 0.  Costs three fifths of tanh."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(1, x, out=x)


#: A float's bits, as an integer, are 2 ** 23 times its logarithm to base 2 and this, straight between powers of two.
ONE, PER_E = 127 << 23, float((1 << 23) / np.log(2))


def quick_sigmoid(bits: np.ndarray, x: np.ndarray, spare: np.ndarray) -> None:
    """1 / (1 + exp(-2 a)) = e^a / (e^a + e^-a) in place of x, which is ``PER_E * a + ONE``; within 0.003, as the errors of the two all but cancel.

    bits and spare are integers of x's shape.  For a between -80 and 80 only.
    """
    np.copyto(bits, x, casting="unsafe")
    np.subtract(2 * ONE, bits, out=spare)
    up, down = bits.view(np.float32), spare.view(np.float32)
    down += up
    np.divide(up, down, out=x)


def hidden_states(net: Network, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """codes: windows x steps; both directions' states as steps x 2H x windows, and, if they are to be kept, what the way back needs."""
    n, width = codes.shape
    size, wide = net.loops.shape[1] // 4, len(net.embedding)
    seen = np.take(net.embedding, codes.T.astype(np.intp), axis=1, mode="clip")  # D x steps x windows
    x = np.zeros((2, size + wide + 1, n), np.float32)
    x[:, -1] = 1
    h, c = x[:, :size], np.zeros((2, size, n), np.float32)
    g = np.empty((2, 4 * size, n), np.float32)
    # no state is beyond 1, so this bounds the inputs of gates; training needs the exact ones
    most = (np.abs(net.loops) * np.concatenate([np.ones(size), np.abs(net.embedding).max(axis=1), [1]])).sum(axis=2).max()
    quick = not keep and most < 80
    loops = net.loops * np.float32(PER_E if quick else -2)
    if quick:
        loops[:, :, -1] += ONE
    bits, spare = np.empty(g.shape, np.int32), np.empty(g.shape, np.int32)
    out, kept = np.empty((width, 2 * size, n), np.float32), []
    for t in range(width):
        x[0, size:-1], x[1, size:-1] = seen[:, t], seen[:, width - 1 - t]
        np.matmul(loops, x, out=g)
        if quick:
            quick_sigmoid(bits, g, spare)
        else:
            sigmoid(g)
        candidate = g[:, 3 * size :]
        candidate *= 2
        candidate -= 1
        before = (x.copy(), c.copy(), g.copy()) if keep else ()
        c *= g[:, size : 2 * size]
        c += g[:, :size] * g[:, 3 * size :]
        if quick:
            np.clip(c, -40, 40, out=h)
            h *= PER_E
            h += ONE
            quick_sigmoid(bits[:, :size], h, spare[:, :size])
        else:
            np.multiply(c, -2, out=h)
            sigmoid(h)
        h *= 2
        h -= 1
        if keep:
            kept.append((*before, h.copy()))
        h *= g[:, 2 * size : 3 * size]
        out[t, :size], out[width - 1 - t, size:] = h[0], h[1]
    return out, kept


def _back(net: Network, d_hidden: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the embedded characters (steps x D x windows) and of the loops."""
    width, both, n = d_hidden.shape
    size = both // 2
    d_seen, dloop = np.zeros((width, len(net.embedding), n), np.float32), np.zeros_like(net.loops)
    dh, dc = np.zeros((2, size, n), np.float32), np.zeros((2, size, n), np.float32)
    back = net.loops.transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        x, c, g, th = kept[t]
        i, f, o, z = (g[:, k * size : (k + 1) * size] for k in range(4))
        dh = dh + np.stack([d_hidden[t, :size], d_hidden[width - 1 - t, size:]])
        dc = dc + dh * o * (1 - th * th)
        dg = np.concatenate([dc * z * 2 * i * (1 - i), dc * c * 2 * f * (1 - f), dh * th * 2 * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        dloop += dg @ x.transpose(0, 2, 1)
        dx = back @ dg
        d_seen[t] += dx[0, size:-1]
        d_seen[width - 1 - t] += dx[1, size:-1]
        dh, dc = dx[:, :size], dc * f
    return d_seen, dloop


def scores(net: Network, codes: np.ndarray) -> np.ndarray:
    """codes: windows x steps; tag scores as steps x tags x windows."""
    out = net.output @ hidden_states(net, codes)[0]
    out += net.bias[:, None]
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities (steps x batch x tags), and expected moves."""
    n = len(unary)
    a, b = np.empty_like(unary), np.zeros_like(unary)
    a[0] = unary[0]
    for t in range(1, n):
        a[t] = _lse(a[t - 1][:, :, None] + moves, 1) + unary[t]
    for t in range(n - 2, -1, -1):
        b[t] = _lse(moves + (unary[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    p = np.exp(a + b - z[None, :, None])
    pair = np.zeros(moves.shape)
    for t in range(1, n):
        pair += np.exp(a[t - 1][:, :, None] + moves + (unary[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return p, pair


def train(labelled: list[tuple[str, list[Span]]], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """A network from (text, spans) windows of TRAIN_WINDOW characters, by Adam on the CRF likelihood."""
    r = np.random.default_rng(seed)
    v, h = OTHER + 1, HIDDEN
    init = lambda *s: (r.standard_normal(s) * 0.25).astype(np.float32)
    net = Network(init(EMBEDDING, v) * 2, init(2, 4 * h, h + EMBEDDING + 1), init(TAGS, 2 * h), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    net.loops[:, h : 2 * h, -1] += 0.5
    codes = np.stack([encode(t) for t, _ in labelled])
    tags = np.zeros(codes.shape, np.int64)
    for i, (_, spans) in enumerate(labelled):
        for a, k, b in spans:
            tags[i, a:b] = 1 + k
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = r.permutation(len(codes))
        rate = 0.012 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = codes[pick], tags[pick].T
            hidden, kept = hidden_states(net, x, keep=True)
            p, pair = marginals(np.ascontiguousarray((net.output @ hidden + net.bias[:, None]).transpose(0, 2, 1)), net.moves)
            d = p.astype(np.float32)
            np.subtract.at(d, (np.arange(len(y))[:, None], np.arange(len(pick))[None, :], y), 1)
            d = np.ascontiguousarray(d.transpose(0, 2, 1)) / len(pick)  # steps x tags x windows
            true = np.zeros_like(pair)
            np.add.at(true, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
            d_seen, dloop = _back(net, net.output.T @ d, kept)
            hot = np.zeros((x.size, v), np.float32)
            hot[np.arange(x.size), x.T.reshape(-1)] = 1
            flat = lambda z: z.transpose(1, 0, 2).reshape(z.shape[1], -1)
            grads = [flat(d_seen) @ hot, dloop, flat(d) @ flat(hidden).T, d.sum(axis=(0, 2)), ((pair - true) / len(pick)).astype(np.float32)]
            step += 1
            for q, grad, m, s in zip(net.parts(), grads, first, second, strict=True):
                grad = np.clip(grad, -1, 1)
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def labelled_items(r: random.Random) -> tuple[str, int]:
    """One piece of personal data or one secret in some spelling, with its kind."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: some(lower, r.randint(2, 9))
    kind = r.choice((0, 0, 1, 2, 3, 3, 4, 4, 4))
    if kind == 0:
        user = name() + r.choice(["", ".", "_", "-", "."]) + r.choice([digits(r.randint(1, 3)), name(), ""])
        user = user.rstrip("._-") if r.random() < 0.9 else user.title().rstrip("._-")
        host = [name() + r.choice(["", "", digits(1)]) for _ in range(r.choice((1, 1, 2)))] + [r.choice(["com", "org", "net", "de", "fr", "es", "io", "example"])]
        at = r.choice(["@", "@", " @ ", " (at) ", " [at] ", "(at)", "[at]", "(AT)"])
        dot = "." if "@" in at or r.random() < 0.3 else {"(at)": "(dot)", "[at]": "[dot]", "(AT)": "(DOT)"}.get(at, r.choice([" (dot) ", " [dot] ", " dot "]))
        return user + at + dot.join(host), 0
    if kind == 1:
        parts = [str(r.randrange(256)) for _ in range(4)]
        return r.choice([".", ".", " . ", "[.]", "(.)", ". "]).join(parts), 1
    if kind == 2:
        n = digits(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        return r.choice(["", " ", ".", "-", "/", "  "]).join(n[i : i + 4] for i in (0, 4, 8, 12)), 2
    if kind == 3:
        a, b, c, land = digits(3), digits(3), digits(4), str(r.randint(1, 99))
        return r.choice([f"+{land} ({a}) {b}-{c}", f"+{land} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{land} {a} {b} {c}", f"00{r.randint(30, 49)} {a} {b}{c}", f"{a} {b} {c}",
                         f"0{digits(2)}-{digits(7)}", f"+{land}/{a}/{b}{c}", f"({a}){b}-{c}", f"+{land}{a}{b}{c}", f"1-{a}-{b}-{c}"]), 3
    hexa, wide = "0123456789abcdef", lower + lower.upper() + "0123456789"
    word = r.choice(["token", "secret", "api_key", "apikey", "key", "password", "passwd", "pwd", "access_token", "auth", "client_secret", "Password", "TOKEN", "SECRET_KEY"])
    value = r.choice([some(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))), some(hexa, 18), some(hexa, 40), some(wide, r.randint(12, 40))])
    return r.choice([f'{word} = "{value}"', f"{word}={value}", f"{word}: {value}", f"{word}='{value}'", "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + some(wide, 36), "sk-" + some(wide, r.choice((32, 48))), f'token = "{some(hexa, 40)}"', f"password={some(hexa, 18)}"]), 4


def labelled_windows(count: int = TRAIN_WINDOWS, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """A bounded set of labelled windows, made from a seed: personal data and secrets in many spellings among prose of several languages, and look-alikes that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    syllables = ("th an er on st ch de la qu ing and of wh re ti sh he ha in or nd ble ly tion ent al le es os dad ción ñ í ó ue mente é è ê ç oi eau aux ou ai ß ä ö ü ung heit keit lich sch ge ver ei ie be en pf tz "
                 "a e i o u x y z k b c d f g j m p s t v w").split()  # fmt: skip
    common = "the of and to in a that is for on with as by at from dot key token secret password der die das und von zu mit den ein el la de que los y en por con le les des et une pour dans sur au".split()

    def word() -> str:
        w = r.choice(common) if r.random() < 0.4 else "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        x = r.random()
        return w.capitalize() if x < 0.13 else w.upper() if x < 0.15 else w

    def decoy() -> str:
        n = lambda a, b: r.randint(a, b)
        return r.choice([
            lambda: f"version {n(1, 9)}.{n(0, 9)}", lambda: f"v{n(1, 9)}.{n(0, 20)}.{n(0, 99)}", lambda: str(n(1, 2100)), lambda: f"{n(1, 31)}.{n(1, 12)}.{n(1990, 2030)}",
            lambda: f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", lambda: f"{n(1, 999)},{digits(3)}", lambda: f"{n(1, 99)},{digits(3)},{digits(3)}", lambda: digits(n(4, 8)), lambda: f"@{word()}",
            lambda: f"{n(1, 12)}:{digits(2)}", lambda: f"{n(0, 23)}:{digits(2)}:{digits(2)}", lambda: f"{digits(6)}-{digits(2)}", lambda: f"{n(0, 9)}.{digits(n(1, 6))}", lambda: f"CC BY-NC {n(1, 4)}.0",
            lambda: f"https://www.{word()}.com/{word()}/{n(1, 9999)}", lambda: f"{word()}_{n(1, 9999)}.jpg", lambda: f"{n(1, 100)}%", lambda: f"${n(1, 999)}.{digits(2)}", lambda: f"#{digits(n(1, 6))}",
            lambda: f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", lambda: f"{n(1, 200)}-{n(200, 400)}", lambda: f"x = {word()}({n(1, 99)}, {n(1, 99)});", lambda: f"at {n(1, 12)} dot {word()}", lambda: f"{word()} at {word()}",
            lambda: f"{word()}.{word()}", lambda: f"key {word()}", lambda: f"the password {word()}", lambda: f"{word()} = {n(1, 99)}", lambda: f"{word()}: {word()}", lambda: f"({n(1, 99)})", lambda: f"{n(1900, 2030)}/{n(10, 99)}",
            lambda: f"{n(1, 9)} {n(100, 999)} {n(100, 999)}", lambda: f"| {word()} | {word()} | {n(1, 999)} |", lambda: f"(c) {n(1990, 2030)} {word()}", *[lambda: r.choice([" ", ", "]).join([word()] * n(3, 30))] * 3, lambda: " ".join(r.choice(["at", "dot", "that", "and"]) for _ in range(n(3, 9))), lambda: word() + r.choice(["%%%", "###", "&&&", "$$$", "***", "@@@", "!!!"]), lambda: " ".join(word().upper() for _ in range(n(1, 4))) + r.choice(["!!", "!", "", ":"]),
        ])()

    out = []
    while len(out) < count:
        text, spans = "", []
        share = r.choice((0.0, 0.05, 0.12, 0.2))
        while len(text) < TRAIN_WINDOW + 60:
            x = r.random()
            if x < share:
                s, k = labelled_items(r)
                spans.append((len(text), k, len(text) + len(s)))
                text += s
            else:
                text += decoy() if x < share + 0.12 else word()
            text += r.choice([" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n", "### ", " | ", "\n", '" '])
        at = r.randrange(60)
        out.append((text[at : at + TRAIN_WINDOW], [(max(a - at, 0), k, min(b - at, TRAIN_WINDOW)) for a, k, b in spans if b > at and a < at + TRAIN_WINDOW]))
    return out


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(labelled_windows())


# ---- whole texts -----------------------------------------------------------------------------------------------------


def window_scores(net: Network, texts: list[str]) -> list[np.ndarray]:
    """Tag scores (characters x tags) of whole texts: those of overlapping windows, averaged by the distance to the window's edge.

    A text's windows begin with the text and hold nothing of the next one, so its scores don't depend on its neighbours.  Windows are scored ``SLICE`` at a time, and nothing of a slice but its scores is kept.
    """
    first = np.cumsum([0, *map(len, texts)]).tolist()
    padded = np.full(first[-1] + WINDOW, SYMBOLS.index(" "), np.uint8)
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of windows, by their length: start and text's end
    for at, end, text in zip(first, first[1:], texts, strict=False):
        padded[at:end] = encode(text)
        while end - at > WINDOW:
            places[WINDOW].append((at, end))
            at += STRIDE
        places[max(TAIL, -(-(end - at) // TAIL) * TAIL)].append((at, end))
    sums, weights = np.zeros((len(padded), TAGS), np.float32), np.zeros((len(padded), 1), np.float32)
    for width, own in sorted(places.items()):
        seen = np.lib.stride_tricks.sliding_window_view(padded, width)
        centre = (np.minimum(np.arange(width), np.arange(width)[::-1]) + 1).astype(np.float32)[:, None]
        for k in range(0, len(own), SLICE):
            starts, ends = np.array(own[k : k + SLICE]).T
            codes = seen[starts]
            codes[np.arange(width) >= (ends - starts)[:, None]] = SYMBOLS.index(" ")  # what follows is the next text's
            unary = scores(net, codes)
            unary *= centre[:, None]
            unary = np.ascontiguousarray(unary.transpose(2, 0, 1))
            for x, at, n in zip(unary, starts.tolist(), np.minimum(ends - starts, width).tolist(), strict=True):
                sums[at : at + n] += x[:n]
                weights[at : at + n] += centre[:n]
    return [sums[at:end] / weights[at:end] for at, end in zip(first, first[1:], strict=False)]


def possible(mean: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Characters that the best path of all may tag as something: the others are outside in it for certain.

    Against staying outside, a tagged segment gains at most ``inner`` by each move within it and ``edge`` by the two that enter and leave it; so
    a segment whose margins and moves sum to less than nothing loses, and a character that only such segments hold is outside.
    """
    stay = float(moves[0, 0])
    inner, edge = float(moves[1:, 1:].max()) - stay, float(moves[0, 1:].max() + moves[1:, 0].max()) - 2 * stay
    best = mean[:, 1]
    for k in range(2, TAGS):
        best = np.maximum(best, mean[:, k])
    upto = np.concatenate([[0.0], np.cumsum((best - mean[:, 0]).astype(np.float64) + inner)])
    highest = np.maximum.accumulate(upto[:0:-1])[::-1]
    return highest - np.minimum.accumulate(upto[:-1]) >= inner - edge


def viterbi(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best path of characters that lie between two outside ones."""
    back = np.empty(unary.shape, np.int8)
    best = unary[0].astype(np.float64) + moves[0]
    for t in range(1, len(unary)):
        x = best[:, None] + moves
        back[t] = x.argmax(axis=0)
        best = x.max(axis=0) + unary[t]
    tags = np.empty(len(unary), np.int64)
    tags[-1] = (best + moves[:, 0]).argmax()
    for t in range(len(unary) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def probabilities(unary: np.ndarray, tags: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability of each character's tag, among all paths of characters that lie between two outside ones (forward-backward)."""
    n = len(unary)
    # likelihoods, each step's scaled: its largest score counts as 1, and what comes from before sums to 1
    step, move = np.exp(unary - unary.max(axis=1, keepdims=True), dtype=np.float64), np.exp(moves.astype(np.float64))
    ahead, behind = np.empty((n, TAGS)), np.empty((n, TAGS))
    ahead[0], behind[-1] = step[0] * move[0], move[:, 0]
    for t in range(1, n):
        x = (ahead[t - 1] @ move) * step[t]
        ahead[t] = x / x.sum()
    for t in range(n - 2, -1, -1):
        x = move @ (step[t + 1] * behind[t + 1])
        behind[t] = x / x.sum()
    both = ahead * behind
    return both[np.arange(n), tags] / both.sum(axis=1)


def best_path(mean: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The best path over a whole text (which begins and ends outside), as (start, tags) of the runs of characters that may be something; all others are outside in it."""
    edges = np.flatnonzero(np.diff(possible(mean, moves).astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    for a, b in edges.reshape(-1, 2).tolist():
        yield a, viterbi(mean[a:b], moves)


def _spans(tags: np.ndarray) -> Iterator[Span]:
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if tags[a]:
            yield a, int(tags[a]) - 1, b


def holds(kind: int, found: str) -> bool:
    """What the values of a kind obey in any spelling: a card's check digit, and an address's bytes."""
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        digits = re.sub("[^0-9]", "", found)
        return 14 <= len(digits) <= 19 and luhn(digits)
    return True


def added_spans(texts: list[str], bases: list[list[Span]], net: Network) -> list[list[Span]]:
    """What the network adds to the patterns' spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    group: list[int] = []
    size = 0

    def work() -> None:
        for i, own in zip(group, window_scores(net, [texts[i] for i in group]), strict=True):
            text = texts[i]
            taken = sorted((a, b) for a, _, b in bases[i])
            for a, tags in best_path(own, net.moves):
                if not tags.any():
                    continue
                chances = None
                for x, k, y in _spans(tags):
                    piece = text[a + x : a + y]
                    start, end = a + x + len(piece) - len(piece.lstrip()), a + y - len(piece) + len(piece.rstrip())
                    if start >= end or not holds(k, text[start:end]):
                        continue
                    # not a part of a longer run of letters or digits
                    if (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
                        continue
                    p = bisect.bisect_left(taken, (end, -1))
                    if any(start < b for _, b in taken[max(0, p - len(BASE_KINDS)) : p]):
                        continue
                    if chances is None:
                        chances = probabilities(own[a : a + len(tags)], tags, net.moves)
                    if chances[x:y].mean() >= SURE:
                        out[i].append((start, k, end))

    for i, text in enumerate(texts):
        if not text:
            continue
        group.append(i)
        size += len(text)
        if size > 1 << 21:
            work()
            group, size = [], 0
    if group:
        work()
    return out


def find(texts: list[str | None], net: Network | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans and all spans of each text."""
    plain = [x or "" for x in texts]
    bases = [base_spans(x) for x in plain]
    added = added_spans(plain, bases, net if net is not None else default_network())
    return bases, [sorted(b + a) for b, a in zip(bases, added, strict=True)]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in its place; spans that overlap become the first one's kind."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SPAN = "struct<start:bigint,end:bigint,kind:string>"


def detect(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, net: Network | None = None) -> DataFrame:
    """The columns in ``keep`` (all but the text where not given) with base_spans, spans and the redacted text; columns of those names are replaced."""
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_column]) if c not in ("base_spans", "spans", "redacted")]
    sent = docs.sparkSession.sparkContext.broadcast(net if net is not None else default_network())  # of fixed size
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"base_spans array<{SPAN}>, spans array<{SPAN}>, redacted string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    # a text that stays is sent once
    own = text_column in kept
    text_at, batch_text = (kept.index(text_column), text_column) if own else (len(kept), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, batch_text):
            texts = batch.column(text_at).to_pylist()
            bases, spans = find(texts, sent.value)
            rows = [pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in x] for x in y], kind) for y in (bases, spans)]
            clean = [None if t is None else redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *rows, pa.array(clean, pa.string())], names=[*kept, "base_spans", "spans", "redacted"])

    return docs.select(*kept, *([] if own else [docs[text_column].alias("__text")])).mapInArrow(run, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
