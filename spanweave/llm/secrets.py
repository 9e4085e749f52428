"""Secrets in text: fixed base patterns, and a linear-chain conditional random field that adds further ones.

The text is cut into tokens; each gets one of the tags outside, begin, inside. Features: the token's shape (character
classes, length, share of digits, entropy), the words and signs before it, and features of the whole file (share of
code signs, mention of keys). Viterbi decoding picks the tags. Weights maximise the conditional likelihood of generated
lines (`examples`, a fixed number).

The best tags are those of the whole text. Most of it need not be scored for that: from the weights follows how much a
token can gain at most by not being outside, whatever is around it (`_Gains`), and the chain is decoded only in stretches
in which a run of such tokens can gain anything.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, digests, masked, ordered, with_spans

KINDS = ("assign", "access", "hex", "secret")
EXAMPLES, STEPS = 500, 30
#: Tokens whose bounds are remembered.
_CACHE = 200_000
#: Longer tokens (characters) are not kept there.
_LONGEST = 64
TAGS = ("O", "B", "I")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping within each kind; too short matches are dropped."""
    out: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


_TOKEN = re.compile(r"[A-Za-z0-9+/_=~.-]+|[^\sA-Za-z0-9+/_=~.-]")
_WORDS = frozenset((
    "password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "bearer", "authorization", "auth", "credential", "credentials",
    "private", "access", "client_secret", "signature",
))


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def _shape(token: str) -> list[str]:
    n = len(token)
    digits, upper, lower = sum(map(str.isdigit, token)), sum(map(str.isupper, token)), sum(map(str.islower, token))
    signs = n - digits - upper - lower
    classes = (digits > 0) + (upper > 0) + (lower > 0)
    out = [f"len={min(n // 4, 12)}", f"digits={min(4, 8 * digits // n)}", f"upper={min(4, 8 * upper // n)}", f"classes={classes}{signs > 0}", f"signs={min(3, signs)}"]
    if n >= 12:
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
        words = len(re.findall(r"[A-Za-z][a-z]{3,}", token)) > 1
        out += [f"entropy={int(2 * _entropy(token))}", f"changes={min(6, 12 * changes // n)}", f"words={words}"]
        out += [f"dots={min(3, token.count('.'))}", f"slash={min(3, token.count('/'))}", f"dash={min(4, token.count('-'))}"]
    return out


def _own(token: str) -> str:
    own = token.lower()
    return f"own={'=' in own and any(map(own.startswith, _WORDS))}"


def file_features(text: str) -> list[str]:
    signs = sum(map(text.count, "={};\"'"))
    return [f"code={min(3, 40 * signs // max(1, len(text)))}"]


def _observed(tokens: list[str], t: int, whole: list[str]) -> list[str]:
    """Features of token t: its shape, neighbours and the file."""
    return [*_shape(tokens[t]), _own(tokens[t]), *_around(tokens, t, whole)]


def _around(tokens: list[str], t: int, whole: list[str]) -> list[str]:
    before = [w.lower().strip("=:-_.") for w in tokens[max(0, t - 4) : t]]
    out = [f"{x}&{len(tokens[t]) >= 16}" for x in whole]
    out.append(f"prev={tokens[t - 1][-1] if t and not tokens[t - 1][-1].isalnum() else 'word' if t else 'none'}")
    out.append(f"next={tokens[t + 1][0] if t + 1 < len(tokens) and not tokens[t + 1][0].isalnum() else 'word'}")
    out.append(f"hint={any(w in _WORDS or w.rpartition('_')[2] in _WORDS for w in before)}&{len(tokens[t]) >= 12}")
    return out


#: Openings of keys and what announces them in the generated examples, and others that only tests use.
PREFIXES, ANNOUNCED = ("ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "AIza"), ("Bearer ", "key: ", "Authorization: ", "client_secret = ", 'private_key: "', "auth ")
BARE = ("Authorization: Bearer ", "Bearer ", "pwd = ", 'pwd: "', 'private_key: "', "private_key: ", "auth ", "client_secret = ")
UNSEEN_PREFIXES, UNSEEN_ANNOUNCED = ("npm_", "hf_", "pk_test_", "dop_v1_", "gho_"), ("credentials: ", "signature = ", "access key: ", "Authorization: Basic ")
UNSEEN_BARE = ("credentials = ", "key = ", "Authorization: Basic ", 'credential: "')


def examples(
    n: int = EXAMPLES, seed: int = 11, prefixes: tuple[str, ...] = PREFIXES, announced: tuple[str, ...] = ANNOUNCED, bare: tuple[str, ...] = BARE
) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the spans of their secrets, and look-alikes without any. `bare` announces short keys and
    keys without digits."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def pick(a: str, k: int) -> str:
        return "".join(r.choice(a) for _ in range(k))

    def word() -> str:
        return pick(low, r.randint(2, 10))

    keys = (
        lambda: pick(low + up + dig, r.randint(24, 44)), lambda: pick(low + up + dig + "+/", r.randint(28, 64)) + r.choice(("", "=", "==")),
        lambda: r.choice(prefixes) + pick(low + up + dig, r.randint(24, 40)), lambda: r.choice(prefixes) + pick(low + up + dig, 36),
        lambda: f"eyJ{pick(low + up + dig, 20)}.eyJ{pick(low + up + dig, 40)}.{pick(low + up + dig + '_-', 40)}",
    )
    weak = (lambda: pick(low + up + dig, r.randint(12, 15)), lambda: pick(low + up, r.randint(20, 44)), lambda: pick(low + up, r.randint(12, 19)))
    decoys = (
        lambda: f"https://{word()}.com/{word()}/{word()}/{r.randint(1, 999)}", lambda: f"/usr/{word()}/{word()}/{word()}.{r.randint(1, 9)}",
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 99)}", lambda: f"{word()}_{word()}_{word()}{r.randint(1, 9)}",
        lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", lambda: pick(dig, r.randint(8, 20)),
        lambda: f"{word()}{word()}{word()}{word()}", lambda: f"{word()}.{word()}.{word()}{r.randint(1, 9)}.{word()}",
        lambda: f"{word()}.{r.randint(1, 99)}-{word()}.example.com", lambda: "".join(word().title() for _ in range(4)) + pick(dig, 1),
        lambda: f"v{r.randint(1, 9)}.{r.randint(10, 99)}.{r.randint(10, 99)}-{word()}", lambda: word().upper() + "-" + word().upper() + pick(dig, 3),
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() + r.choice(("", "", ",", ".")) for _ in range(r.randint(1, 5))) + " "
            kind = r.random()
            if kind < 0.58:
                before, x = (r.choice(bare), r.choice(weak)()) if kind < 0.15 else (r.choice(("", "", *announced)), r.choice(keys)())
                text += before
                spans.append((len(text), len(text) + len(x)))
                text += x
            else:
                text += r.choice(("", "", "see ", "key ", "id: ", "name = ")) + r.choice(decoys)()
            text += r.choice((" ", '" ', ", ", "; "))
        out.append((text + word(), spans))
    return out


def viterbi(unary: np.ndarray, trans: np.ndarray, start: np.ndarray) -> list[int]:
    """Best tags for unary (n, tags), trans (from, to) and start scores; of equal paths the one with lower tags last."""
    n = len(unary)
    score, back = start + unary[0], np.zeros((n, len(start)), int)
    for t in range(1, n):
        x = score[:, None] + trans
        back[t] = x.argmax(0)
        score = x.max(0) + unary[t]
    tags = [int(score.argmax())]
    for t in range(n - 1, 0, -1):
        tags.append(int(back[t, tags[-1]]))
    return tags[::-1]


@functools.cache
def model() -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(weights per feature and tag, transitions, start scores), by Adagrad ascent on the conditional log likelihood."""
    w: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    past: dict[str, np.ndarray] = defaultdict(lambda: np.full(3, 1e-6))
    trans, start = np.zeros((3, 3)), np.zeros(3)
    trans[0, 2], start[2] = -20.0, -20.0  # inside follows begin or inside
    past_t = np.full((3, 3), 1e-6)
    data = []
    for text, spans in examples():
        m = list(_TOKEN.finditer(text))
        tokens, whole = [x.group() for x in m], file_features(text)
        gold = np.zeros(len(m), int)
        for s, e in spans:
            inside = [t for t, x in enumerate(m) if x.start() >= s and x.end() <= e]
            gold[inside[:1]], gold[inside[1:]] = 1, 2
        data.append(([_observed(tokens, t, whole) for t in range(len(m))], gold))
    lse = lambda x, a: (k := x.max(a, keepdims=True)).squeeze(a) + np.log(np.exp(x - k).sum(a))
    for _ in range(STEPS):
        grad: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        grad_t = np.zeros((3, 3))
        for feats, gold in data:
            n = len(gold)
            u = np.array([sum((w[f] for f in fs), np.zeros(3)) for fs in feats])
            a, b = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = start + u[0]
            for t in range(1, n):
                a[t] = lse(a[t - 1][:, None] + trans, 0) + u[t]
            for t in range(n - 2, -1, -1):
                b[t] = lse(trans + (u[t + 1] + b[t + 1])[None], 1)
            z = lse(a[-1], 0)
            p = np.eye(3)[gold] - np.exp(a + b - z)
            for t, fs in enumerate(feats):
                if np.abs(p[t]).max() > 1e-3:
                    for f in fs:
                        grad[f] += p[t]
            for t in range(1, n):
                grad_t -= np.exp(a[t - 1][:, None] + trans + (u[t] + b[t])[None] - z)
                grad_t[gold[t - 1], gold[t]] += 1
        for f, g in grad.items():
            g = g - 0.02 * w[f]
            past[f] += g * g
            w[f] = w[f] + 0.5 * g / np.sqrt(past[f])
        grad_t -= 0.02 * trans
        grad_t[0, 2] = 0
        past_t += grad_t**2
        trans = trans + 0.5 * grad_t / np.sqrt(past_t)
    return dict(w), trans, start


class _Gains(dict):
    """Token -> the most it can add to a path's score as part of a secret instead of outside, in any surroundings."""

    def __init__(self, fitted):
        super().__init__()
        w, trans, start = fitted
        self.w = {f: tuple(map(float, x)) for f, x in w.items()}
        #: What a token adds by itself, per tag: by token, or by the counts that its shape depends on if it is short.
        self.own: dict[str | tuple[int, ...], tuple[float, ...]] = {}
        #: What entering or staying in a secret, and what leaving one, can add.
        self.inner = max(float((trans[:, 1:] - trans[0, 0]).max()), float((start[1:] - start[0]).max()))
        self.leave = max(0.0, float((trans[1:, 0] - trans[0, 0]).max()))
        self.around = {}
        for long, medium in ((False, False), (False, True), (True, True)):
            groups = (("code=", f"&{long}"), ("prev=", ""), ("next=", ""), ("hint=", f"&{medium}"))
            best = [np.max([np.zeros(2), *(x[1:] - x[0] for f, x in w.items() if f.startswith(a) and f.endswith(z))], axis=0) for a, z in groups]
            self.around[long, medium] = tuple(map(float, sum(best) + self.inner))

    def _sum(self, features: list[str], start: tuple[float, ...] = (0.0, 0.0, 0.0)) -> tuple[float, ...]:
        a, b, c = start
        for f in features:
            if f in self.w:
                x, y, z = self.w[f]
                a, b, c = a + x, b + y, c + z
        return a, b, c

    def of(self, token: str) -> tuple[float, ...]:
        """What a token adds by itself, per tag."""
        n = len(token)
        if n >= 12 or "=" in token:
            key = token
        elif token.isalpha() and token.islower():
            key = (n, 0, 0, n)
        else:
            key = (n, sum(map(str.isdigit, token)), sum(map(str.isupper, token)), sum(map(str.islower, token)))
        out = self.own.get(key)
        if out is None:
            out = self._sum([*_shape(token), _own(token)])
            if n <= _LONGEST:
                if len(self.own) >= _CACHE:
                    self.own.clear()
                self.own[key] = out
        return out

    def __missing__(self, token: str) -> float:
        own, around = self.of(token), self.around[len(token) >= 16, len(token) >= 12]
        gain = max(own[1] - own[0] + around[0], own[2] - own[0] + around[1])
        if len(token) <= _LONGEST:
            if len(self) >= _CACHE:
                self.clear()
            self[token] = gain
        return gain

    def unary(self, tokens: list[str], t: int, whole: list[str]) -> tuple[float, ...]:
        return self._sum(_around(tokens, t, whole), self.of(tokens[t]))


def _stretches(gains: np.ndarray, leave: float) -> list[tuple[int, int]]:
    """(first, end) of the tokens through which some run gains: all others are outside on the best path."""
    total = np.concatenate([[0.0], np.cumsum(gains)])
    behind = total - np.minimum.accumulate(total)  # the best run that ends before a token, and after it
    ahead = np.maximum.accumulate(total[::-1])[::-1] - total
    inside = np.concatenate([[False], behind[:-1] + gains + ahead[1:] + leave > -1e-6, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def model_spans(text: str, fitted, gains: _Gains | None = None) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the chain finds."""
    gains = _Gains(fitted) if gains is None else gains
    tokens = _TOKEN.findall(text)
    values = np.fromiter(map(gains.__getitem__, tokens), float, len(tokens))
    if not len(values) or values.max() + gains.leave <= -1e-6:
        return []
    _, trans, start = fitted
    whole, runs = file_features(text), []
    for first, end in _stretches(values, gains.leave):
        u = [gains.unary(tokens, t, whole) for t in range(first, end)]
        # The same bound with the surroundings as they are: without any gain all of the stretch is outside.
        if not any(max(x[1], x[2]) - x[0] + gains.inner + gains.leave > -1e-6 for x in u):
            continue
        u = np.array(u)
        if end < len(tokens):
            u[-1] += trans[:, 0]
        last = 0
        for t, tag in enumerate(viterbi(u, trans, trans[0] if first else start), first):
            if tag == 1 or tag == 2 and not last:
                runs.append((t, t))
            elif tag == 2:
                runs[-1] = (runs[-1][0], t)
            last = tag
    at = [x.span() for x in _TOKEN.finditer(text)] if runs else []
    return [(at[a][0], at[b][1]) for a, b in runs]


def clear_of(found: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """Those of the ascending spans `found` that overlap none of `base`, which is ordered by start."""
    out, k, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the one looked at ends
    for s, e in found:
        while k < len(base) and base[k][1] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            out.append((s, e))
    return out


def finder(fitted=None):
    """A function text -> all spans: the base ones, and kind `secret` for what the model finds clear of them."""
    fitted = model() if fitted is None else fitted
    gains: list[_Gains] = []  # made where it is used

    def find(text: str) -> list[Span]:
        if not gains:
            gains.append(_Gains(fitted))
        base = base_spans(text)
        return ordered(base + [("secret", s, e, False) for s, e in clear_of(model_spans(text, fitted, gains[0]), base)], KINDS)

    return find


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end, base) for every row, whole texts; null text: empty list.

    Offsets are code points; base spans of different kinds may overlap. Repeated rows give repeated results; other
    columns are not read; an empty table gives no rows.
    """
    return with_spans(docs, finder(), id_col, text_col)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with secrets replaced by <ASSIGN>, <ACCESS>, <HEX> or <SECRET>; nulls and all other columns stay."""
    return masked(docs, finder(), text_col)


def secret_digests(found: DataFrame) -> DataFrame:
    return digests(found, KINDS[:3])
