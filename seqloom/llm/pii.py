"""Personal data: fixed patterns plus a character BiLSTM with CRF transitions.

The base finds email, ip, card and phone by pattern in every whole text. A
bidirectional LSTM over characters with a CRF on top, trained here in numpy from
labelled spans, adds spans written in ways that the patterns miss (a number without
its country code, a spelt-out at-sign, broken-up card digits). Base spans always stay;
a model span that touches one is dropped.

The network reads every text whole, in overlapping windows of ``WINDOW`` characters at
every ``STRIDE``. Scores of a character from the windows over it are averaged, the ones
far from a window's edge weighing most, and decoding is global: Viterbi over the whole
text. It is computed only around characters where another tag than "outside" comes near:
where outside leads by more than any path of transitions can win back, and for longer
than any emissions can make good, the best path is outside (``safe``), so skipping it
changes no tag. A text of more than ``PIECE`` characters is read in pieces that overlap
by ``LAP``; a span belongs to the piece it starts in.

Labelled spans: base matches in a bounded sample of documents (``sample`` rows in hash
order, of a longer text a stretch of ``chars`` characters from a place that a hash of its
doc_id chooses; both are parameters of ``fit``, and these are the only texts that are cut) and
spans of made-up values written into stretches of the same documents.

Defined cases: null and empty texts have no spans; offsets are code points, end
exclusive; repeated rows are answered as often as they occur; other columns are
ignored; a group of more than three digits after its leading zeros is no part of an ip,
however long; the memory of a text is bounded by ``PIECE`` beyond the text itself, also
for one unbroken run of digits; with no documents the network trains on the made-up
values alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, STRIDE = 512, 464
#: Characters of a training window.
SHORT = 112
HIDDEN, EMBED = 16, 8
ALPHABET = 130
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
STEPS, BATCH = 400, 96
LOCAL = 0.5
#: Least mean probability of a model span's tags.
SURE = 0.8
#: Windows that run through the network at once, and characters that are decoded together.
CHUNK, TOGETHER = 384, 1 << 20
#: Characters of a piece of a very long text, and what it shares with its neighbours.
PIECE, LAP = 1 << 19, 464
#: What outside must lead by, beyond what transitions can win, to be safe.
CLEAR = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches, leftmost and non-overlapping for each kind, in linear time."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", at + 1 if not m else m.end())
    if _ANY_DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts = m.group().split(".")
            place = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = place + sum(map(len, four)) + 3
                if all(map(octet, four)):
                    out.append((place, end, "ip"))
                place = end + 1
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PLUS.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the network ---------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """ASCII as it is, other letters 128, the rest 129, padding 0."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODES[np.minimum(raw, len(_CODES) - 1)]


_CODES = np.array([max(c, 1) if c < 128 else 128 for c in range(0x2000)] + [129])


def allowed() -> np.ndarray:
    """Penalty of a transition: an inside tag follows its own kind only."""
    bad = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside, inside - 1):
                bad[before, inside] = -1e4
    return bad


class Net:
    """Two LSTMs over characters (from the left and from the right), emission layer, CRF transitions.

    Arrays are (direction, feature, window): a gate is one contiguous block. One product a step
    gives the gates from the hidden state and the character's embedding. Sigmoid gates are (tanh + 1) / 2 of half their input,
    the halves being part of the weights. Windows come in order of length; the second LSTM is
    held at its start in what pads a window, so padding has no influence on scores.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        w = lambda scale, *s: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "emb": w(0.7, EMBED + 1, ALPHABET), "wx": w(EMBED**-0.5 * 0.5, 2, 4 * HIDDEN, EMBED + 1), "wh": w(HIDDEN**-0.5 * 0.7, 2, 4 * HIDDEN, HIDDEN),
            "out": w((2 * HIDDEN) ** -0.5, TAGS, 2 * HIDDEN), "ob": np.zeros((TAGS, 1), np.float32), "tr": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["emb"][-1] = 1  # what it is multiplied with is a bias
        self.p["wx"][:, :, -1] = 0
        self.p["wx"][:, HIDDEN : 2 * HIDDEN, -1] = 0.5
        self.bad = allowed()

    def run(self, x: np.ndarray, lens: np.ndarray, keep: bool = False):
        """x (time, window) codes, each filled up to its ``lens``, which ascend -> emissions (time, tags, window), and what the gradient needs."""
        p, h = self.p, HIDDEN
        t, n = x.shape
        waits = np.searchsorted(lens, t - 1 - np.arange(t), "right")  # windows that the second has not entered
        # what is carried is twice the hidden state (o + 1 times tanh, o a tanh); the emissions of a
        # step come out of the same product as the gates of the next one
        half = np.concatenate([p["wh"], np.stack([p["out"][:, :h], p["out"][:, h:]])], 1) * np.float32(0.5)
        both = np.concatenate([half, np.pad(p["wx"], ((0, 0), (0, TAGS), (0, 0)))], 2)
        letters = np.take(p["emb"], x, axis=1, mode="clip")
        em = np.empty((t, TAGS, n), np.float32)
        em[:] = p["ob"]
        full, (c, u) = np.zeros((2, h + EMBED + 1, n), np.float32), np.zeros((2, 2, h, n), np.float32)
        product = np.empty((2, 4 * h + TAGS, n), np.float32)
        g, state = product[:, : 4 * h], full[:, :h]
        if keep:
            hs, cs, gates = np.zeros((t + 1, 2, h, n), np.float32), np.zeros((t + 1, 2, h, n), np.float32), np.empty((t, 2, 4 * h, n), np.float32)
        for i in range(t + 1):
            if i < t:
                full[0, h:], full[1, h:] = letters[:, i], letters[:, t - 1 - i]
            np.matmul(both, full, out=product)
            if i:
                em[i - 1] += product[0, 4 * h :]
                em[t - i] += product[1, 4 * h :]
            if i == t:
                break
            np.tanh(g, out=g)
            g[:, : 3 * h] += 1
            c *= g[:, h : 2 * h]
            np.multiply(g[:, :h], g[:, 3 * h :], out=u)
            c += u
            c *= 0.5
            np.tanh(c, out=u)
            np.multiply(g[:, 2 * h : 3 * h], u, out=state)
            if waits[i]:
                c[1, :, : waits[i]] = state[1, :, : waits[i]] = 0
            if keep:
                gates[i], cs[i + 1], hs[i + 1] = g, c, state
        if not keep:
            return em, None
        hs *= 0.5
        gates[:, :, : 3 * h] *= 0.5
        return em, (x, waits, hs, cs, gates)

    def grad(self, d_em: np.ndarray, kept) -> dict[str, np.ndarray]:
        """d_em (time, tags, window), zero beyond each window's end."""
        p, h = self.p, HIDDEN
        x, waits, hs, cs, gates = kept
        t, _, n = d_em.shape
        sides = (d_em, d_em[::-1])
        out = np.concatenate([np.einsum("ian,ihn->ah", sides[d], hs[1:, d], optimize=True) for d in (0, 1)], 1)
        d_hs = np.stack([np.matmul(p["out"][:, d * h : (d + 1) * h].T, sides[d]) for d in (0, 1)], 1)
        dz = np.empty((t, 2, 4 * h, n), np.float32)
        dh, dc = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        wh_t = np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
        for i in range(t - 1, -1, -1):
            a = gates[i]
            gi, gf, go, gg = a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :]
            tc = np.tanh(cs[i + 1])
            dh = dh + d_hs[i]
            dh[1, :, : waits[i]] = dc[1, :, : waits[i]] = 0
            dc = dc + dh * go * (1 - tc * tc)
            # derivatives by the inputs of tanh, which hold half of a sigmoid gate's input
            dz[i, :, :h] = 2 * dc * gg * gi * (1 - gi)
            dz[i, :, h : 2 * h] = 2 * dc * cs[i] * gf * (1 - gf)
            dz[i, :, 2 * h : 3 * h] = 2 * dh * tc * go * (1 - go)
            dz[i, :, 3 * h :] = dc * gi * (1 - gg * gg)
            dc = dc * gf
            dh = np.matmul(wh_t, dz[i])
        wh = np.stack([np.einsum("ign,ihn->gh", dz[:, d], hs[:-1, d], optimize=True) for d in (0, 1)])
        rows = [dz[:, d].transpose(1, 0, 2).reshape(4 * h, -1) for d in (0, 1)]
        every = np.stack([[np.bincount((x, x[::-1])[d].ravel(), r, ALPHABET) for r in rows[d]] for d in (0, 1)])
        emb = np.einsum("dge,dga->ea", p["wx"], every)
        emb[-1] = 0
        return {"emb": emb, "wx": np.matmul(every, p["emb"].T), "wh": wh, "out": out, "ob": d_em.sum((0, 2))[:, None]}

    def crf(self, em: np.ndarray, gold: np.ndarray, lens: np.ndarray):
        """Mean negative log likelihood of gold (time, window); gradients of emissions and transitions.

        A window ends at its own length: beyond it the only tag is outside, at no cost. To the
        gradient of emissions comes ``LOCAL`` times that of each character's own softmax: under the
        CRF alone, inside tags go unpunished in prose, as nothing begins there.
        """
        em = em.transpose(0, 2, 1).copy()  # (time, window, tags)
        t, n, k = em.shape
        inside = np.arange(t)[:, None] < lens
        em[~inside] = np.where(np.arange(k) == 0, 0, -1e4)
        tr = self.p["tr"] + self.bad
        move = np.exp(tr)
        local = np.exp(em - em.max(-1, keepdims=True))
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((t, n, 1), np.float32)
        a = local[0] * np.where(self.bad[0] < 0, 0, 1)  # a window may not start inside a span of nothing
        for i in range(t):
            if i:
                a = (alpha[i - 1] @ move) * local[i]
            scale[i] = a.sum(-1, keepdims=True)
            alpha[i] = a / scale[i]
        for i in range(t - 2, -1, -1):
            beta[i] = ((local[i + 1] * beta[i + 1]) @ move.T) / scale[i + 1]
        p = alpha * beta
        p /= p.sum(-1, keepdims=True)
        d_tr = np.zeros((k, k))
        for i in range(1, t):
            d_tr += (alpha[i - 1].T @ (local[i] * beta[i] / scale[i])) * move
        one = np.eye(k, dtype=np.float32)[gold]
        np.add.at(d_tr, (gold[:-1], gold[1:]), -1)
        score = (em * one).sum((0, 2)) + tr[gold[:-1], gold[1:]].sum(0)
        log_z = np.log(scale[..., 0]).sum(0) + em.max(-1).sum(0)
        own = local / local.sum(-1, keepdims=True)
        d_em = np.where(inside[..., None], p - one + LOCAL * (own - one), 0).transpose(0, 2, 1)
        return float((log_z - score).mean()), (d_em / n).astype(np.float32), (d_tr / n).astype(np.float32)


def train(texts: list[str], seed: int = 3, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Parameters of a network trained with Adam on labelled windows."""
    rng = random.Random(seed)
    net = Net(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        drawn = sorted((labelled_window(texts, rng) for _ in range(BATCH)), key=lambda d: len(d[0]))
        lens = np.array([max(1, len(d[0])) for d in drawn])
        x, gold = np.zeros((2, SHORT, BATCH), np.int64)
        for k, (part, tags) in enumerate(drawn):
            x[: len(part), k], gold[: len(tags), k] = part, tags
        em, kept = net.run(x, lens, keep=True)
        _, d_em, d_tr = net.crf(em, gold, lens)
        grads = net.grad(d_em, kept) | {"tr": d_tr}
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        rate = 0.015 * min(1, step / 20) * (1 - 0.95 * step / steps)
        for key, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[key] = 0.9 * m[key] + 0.1 * g
            v[key] = 0.99 * v[key] + 0.01 * g * g
            move = rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
            net.p[key] = (net.p[key] - move).astype(np.float32)
    return net.p


# --- labelled spans ------------------------------------------------------------


def _digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))


def _card(rng):
    body = rng.choice("3456") + _digits(rng, rng.choice((13, 14, 14, 14)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def made_up(rng: random.Random) -> tuple[str, str | None]:
    """A value and its kind; None: something alike that is no personal data."""
    kind = rng.choice(KINDS + (None, None))
    if kind == "email":
        local = _name(rng) + rng.choice(("", ".", "_", "-")) + rng.choice((_name(rng), _digits(rng, 2), ""))
        host, end = _name(rng), rng.choice(("com", "org", "net", "de", "fr", "es", "io", "example.com"))
        at = rng.choice(("@", "@", "@", " @ ", " [at] ", " (at) ", "[at]", "(at)", " AT ", " at "))
        dot = "." if "@" == at else rng.choice((".", " . ", " [dot] ", " (dot) ", "[dot]", " dot ", " DOT "))
        if at.strip().lower() == "at":
            dot = rng.choice((" dot ", " DOT "))
        return local.strip("._-") + at + dot.join([host] + end.split(".")), kind
    if kind == "ip":
        dot = rng.choice((".", ".", ".", "[.]", " . ", "(.)"))
        return dot.join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        digits = _card(rng)
        gap = rng.choice(("", "", " ", "-", ".", "  ", "_"))
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4)), kind
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        country = rng.choice(("+1 ", "+49 ", "+", "001 ", "", "", "", "1-"))
        country = "+" + _digits(rng, 2) + " " if country == "+" else country
        form = rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "({a}){b}-{c}", "{a}/{b}-{c}"))
        return country + form.format(a=a, b=b, c=c), kind
    hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 32, 40))))
    upper = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    return rng.choice(
        (
            f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 30)}",
            str(rng.randint(1900, 2030)), f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
            f"password={hexed[:18]}", f'token = "{hexed}"', upper, _digits(rng, rng.randint(1, 6)), _digits(rng, rng.randint(20, 30)),
            f"{rng.randint(1, 99)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"${rng.randint(1, 999)}", f"section {rng.randint(1, 40)}",
            "@" + _name(rng), f"{_name(rng)} at {_name(rng)}", f"{_name(rng)} dot {_name(rng)}", f"CC BY-NC 4.0.", f"{_digits(rng, 2)}%",
            f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"id{_digits(rng, 9)}", hexed,
        )
    ), None


def labelled_window(texts: list[str], rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of one window: a stretch of a document, most with a value written in."""
    text = rng.choice(texts) if texts else ""
    at = rng.randrange(max(1, len(text) - SHORT))
    stretch = text[at : at + SHORT]
    spans = base_spans(stretch)
    if rng.random() < 0.8:
        for _ in range(rng.choice((1, 1, 2))):
            value, kind = made_up(rng)
            cut = rng.randrange(len(stretch) + 1)
            while 0 < cut < len(stretch) and not stretch[cut - 1].isspace():
                cut -= 1
            if any(a < cut < b for a, b, _ in spans):
                continue
            lead = rng.choice(("", "", "(", ": ", "<")) if cut else ""
            tail = rng.choice((" ", " ", ". ", ", ", "\n", ") ", ""))
            stretch = stretch[:cut] + lead + value + tail + stretch[cut:]
            grown = len(lead) + len(value) + len(tail)
            spans = [(a + grown, b + grown, k) if a >= cut else (a, b, k) for a, b, k in spans]
            if kind:
                spans.append((cut + len(lead), cut + len(lead) + len(value), kind))
    off = rng.randint(0, max(0, len(stretch) - SHORT))
    x = codes(stretch[off : off + SHORT])
    gold = np.zeros(len(x), np.int64)
    for a, b, kind in spans:
        tag = 1 + 2 * KINDS.index(kind)
        a, b = max(a - off, 0), min(b - off, len(x))
        if b > a:
            gold[a:b] = tag + 1
            gold[a] = tag
    return x, gold


# --- decoding ------------------------------------------------------------------


def viterbi(em: np.ndarray, tr: np.ndarray, first: np.ndarray) -> np.ndarray:
    """em (time, batch, tags) -> best tags (time, batch)."""
    t, n, _ = em.shape
    score, back = em[0] + first, np.zeros(em.shape, np.int8)
    for i in range(1, t):
        every = score[:, :, None] + tr
        back[i] = every.argmax(1)
        score = every.max(1) + em[i]
    out = np.zeros((t, n), np.int8)
    out[-1] = score.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        out[i - 1] = back[i, rows, out[i]]
    return out


def marginals(em: np.ndarray, tr: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of each tag at each place under the CRF, of the same shape as ``em``."""
    t = len(em)
    move = np.exp(tr)
    alpha, beta = np.empty_like(em), np.ones_like(em)
    local = np.exp(em - em.max(-1, keepdims=True))
    alpha[0] = local[0] * np.exp(first)
    alpha[0] /= alpha[0].sum(-1, keepdims=True)
    for i in range(1, t):
        a = (alpha[i - 1] @ move) * local[i]
        alpha[i] = a / a.sum(-1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (local[i + 1] * beta[i + 1]) @ move.T
        beta[i] = b / b.sum(-1, keepdims=True)
    both = alpha * beta
    return both / both.sum(-1, keepdims=True)


def plausible(kind: str, value: str) -> bool:
    """A model span must still hold what its kind cannot do without."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "email":
        lower = value.lower()
        return ("@" in value or "at" in lower) and ("." in value or "dot" in lower) and any(c.isalpha() for c in value[:1])
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(map(octet, parts)) and not value[0].isalpha()
    if any(c.isalpha() for c in value):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(value) > len(digits)


def safe(tr: np.ndarray, out: np.ndarray) -> tuple[float, int]:
    """(lead, length): where outside leads every other tag by ``lead`` the best path is outside,
    unless a place without that lead is within ``length``.

    A span of L characters has L + 1 transitions; ``lead`` exceeds, a character, what they can
    gain over staying outside. A longer span could be held up by other places: cut out
    its safe middle and begin anew after it, and it loses at most the difference of two
    emissions and three transitions, which ``length`` leads outweigh.
    """
    open_ = np.where(tr[1:, 1:] > -1e3, tr[1:, 1:], -np.inf).max() - tr[0, 0]
    begin = np.where(tr[0, 1:] > -1e3, tr[0, 1:], -np.inf).max() - tr[0, 0]
    end = tr[1:, 0].max() - tr[0, 0]
    lead = max(begin + end, (begin + end + open_) / 2, open_, 0.0) + CLEAR
    spread = max(np.abs(out[a] - out[b]).sum() for a in range(TAGS) for b in range(TAGS)) + 2 * np.abs(tr[tr > -1e3]).max() * 3
    return float(lead), int(np.ceil(spread / CLEAR))


def others(em: np.ndarray) -> np.ndarray:
    """The highest score of a tag other than outside."""
    out = np.maximum(em[:, 1], em[:, 2])
    for k in range(3, TAGS):
        np.maximum(out, em[:, k], out=out)
    return out


class Finder:
    def __init__(self, params: dict[str, np.ndarray]):
        self.net = Net()
        self.net.p = params
        self.tr = params["tr"] + self.net.bad
        self.first = np.where(self.net.bad[0] < 0, -1e4, 0).astype(np.float32)
        self.lead, self.reach = safe(self.tr, np.concatenate([params["out"], params["ob"]], 1))
        near = 1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2)
        self.near = (near + 0.05).astype(np.float32)[:, None]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Model spans of each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        group, held = [], 0
        for i, text in enumerate(texts):
            for a in range(0, len(text), PIECE):
                low, high = max(0, a - LAP), min(len(text), a + PIECE + LAP)
                group.append((i, a, low, text[low:high]))
                held += high - low
                if held >= TOGETHER:
                    self._decode(group, out)
                    group, held = [], 0
        if group:
            self._decode(group, out)
        return out

    def emissions(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all characters of the parts, where each part begins): (character, tags).

        Where every window over a character is safe throughout, so is their average, and outside's
        lead stands in for it: what is averaged are unsafe windows and their neighbours.
        """
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        x = np.concatenate([codes(p) for p in parts])
        n = np.array([max(1, -(-(len(p) - (WINDOW - STRIDE)) // STRIDE)) for p in parts])
        owner = np.repeat(np.arange(len(parts)), n)
        starts = (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * STRIDE + at[owner]
        lens = np.minimum(at[owner + 1] - starts, WINDOW)
        order = np.argsort(lens, kind="stable")  # windows of a run are of like length
        unsafe, runs = np.zeros(len(starts), bool), []
        for i in range(0, len(order), CHUNK):
            some = order[i : i + CHUNK]
            longest = int(lens[some[-1]])
            place = np.minimum(starts[some] + np.arange(longest)[:, None], len(x) - 1)
            em, _ = self.net.run(x[place], lens[some])
            unsafe[some] = ((em[:, 0] - others(em) < self.lead) & (np.arange(longest)[:, None] < lens[some])).any(0)
            runs.append(em)
        needed = unsafe.copy()
        needed[1:] |= unsafe[:-1] & (owner[1:] == owner[:-1])
        needed[:-1] |= unsafe[1:] & (owner[1:] == owner[:-1])
        total, weight = np.zeros((len(x), TAGS), np.float32), np.zeros((len(x), 1), np.float32)
        for i, em in zip(range(0, len(order), CHUNK), runs):
            for j in np.flatnonzero(needed[order[i : i + CHUNK]]):
                k = order[i + j]
                s, m = starts[k], lens[k]
                total[s : s + m] += em[:m, :, j] * self.near[:m]
                weight[s : s + m] += self.near[:m]
        seen = weight[:, 0] > 0
        total[seen] /= weight[seen]
        total[~seen, 0] = self.lead
        return total, at

    def stretches(self, em: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of characters in which the best path may leave outside."""
        weak = np.flatnonzero(em[:, 0] - others(em) < self.lead)
        if not len(weak):
            return []
        part = np.searchsorted(at, weak, "right") - 1
        new = np.concatenate([[True], (np.diff(weak) > 2 * self.reach) | (np.diff(part) > 0)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(weak)) - 1
        low = np.maximum(weak[first] - self.reach, at[part[first]])
        high = np.minimum(weak[last] + self.reach + 1, at[part[first] + 1])
        return list(zip(low.tolist(), high.tolist()))

    def _decode(self, group, out) -> None:
        em, at = self.emissions([g[3] for g in group])
        ranges = sorted(self.stretches(em, at), key=lambda r: r[1] - r[0])
        i = 0
        while i < len(ranges):
            j = i + 1  # ranges ascend by length: the longest decides what padding takes
            while j < len(ranges) and (j - i + 1) * (ranges[j][1] - ranges[j][0]) <= TOGETHER // 4:
                j += 1
            some, longest = ranges[i:j], ranges[j - 1][1] - ranges[j - 1][0]
            padded = np.full((longest, len(some), TAGS), -1e3, np.float32)
            padded[:, :, 0] = 0  # nothing beyond the text
            for k, (a, b) in enumerate(some):
                padded[: b - a, k] = em[a:b]
            tags = viterbi(padded, self.tr, self.first)
            hit = np.flatnonzero(tags.any(0))
            sure = marginals(padded[:, hit], self.tr, self.first) if len(hit) else None
            for h, k in enumerate(hit):
                column, a = tags[:, k], some[k][0]
                owner = int(np.searchsorted(at, a, "right")) - 1
                text_no, begins, low, part = group[owner]
                for s in np.flatnonzero((column > 0) & (column % 2 == 1)):
                    tag = int(column[s])
                    e = s + 1
                    while e < longest and column[e] == tag + 1:
                        e += 1
                    kind = KINDS[(tag - 1) // 2]
                    here = int(a - at[owner] + s)  # in the part
                    e -= len(part[here : here + e - s]) - len(part[here : here + e - s].rstrip())
                    p = sure[s:e, h, tag] + sure[s:e, h, tag + 1]
                    if begins <= low + here < begins + PIECE and e > s and p.mean() >= SURE and plausible(kind, part[here : here + e - s]):
                        out[text_no].append((low + here, int(low + here + e - s), kind))
            i = j


def all_spans(base: list[tuple[int, int, str]], model: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept = list(base)
    for a, b, kind in sorted(model):
        if all(b <= c or d <= a for c, d, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))


def stretch(text: Column, key: Column, chars: int) -> Column:
    """At most ``chars`` characters of a text, from a place anywhere in it that a hash of the key chooses."""
    places = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(key), places).cast("int") + 1, F.lit(chars))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, np.ndarray]:
    """Train on stretches of at most ``chars`` characters of at most ``sample`` documents, taken in hash order.

    Rows without a doc_id are not drawn; of the rows of one doc_id the least stretch is taken.
    """
    # ids first: every task sends its smallest ones to the driver, not their texts
    ids = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
    ids = ids.where("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), stretch(F.coalesce("text", F.lit("")), F.col("doc_id").cast("bigint"), chars).alias("text"))
        .join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    )
    return train([r.text for r in rows])


SPANS = "array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"


def find_pii(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """Per row of ``docs``: doc_id and spans, base and model ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(params)

    def run(batches):
        import pyarrow as pa

        finder = Finder(sent.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            model = finder.find(texts)
            spans = []
            for b, m in zip(base, model):
                own = set(b)
                spans.append([{"start": s[0], "end": s[1], "kind": s[2], "base": s in own} for s in all_spans(b, m)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        tidy(run), f"doc_id bigint, spans {SPANS}"
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """The thin result of the query: counts of base spans, their digest, and all spans."""
    found = find_pii(docs, fit(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text)).encode()).hexdigest()


def redact(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with every span replaced by ``<kind>``, all columns kept; n_chars follows the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(params)

    def run(batches):
        import pyarrow as pa

        finder = Finder(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            model = finder.find([t or "" for t in texts])
            clean = []
            for text, m in zip(texts, model):
                at, parts = 0, []
                for a, b, kind in all_spans(base_spans(text or ""), m):
                    if b > at:  # base spans of two kinds may overlap
                        parts += [text[at : max(a, at)], f"<{kind}>" if a >= at else ""]
                        at = b
                clean.append(text if not parts else "".join(parts) + text[at:])
            columns = []
            for name in batch.schema.names:
                if name == "text":
                    columns.append(pa.array(clean, batch.schema.field(name).type))
                elif name == "n_chars":
                    lens = [old if new is was or new == was else len(new) for old, new, was in zip(batch.column(name).to_pylist(), clean, texts)]
                    columns.append(pa.array(lens, batch.schema.field(name).type))
                else:
                    columns.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
