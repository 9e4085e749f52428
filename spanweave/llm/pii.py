"""Personal data in text: fixed base patterns, and a semi-Markov conditional random field that adds unusual writings.

The model labels whole segments. Every segment of a bounded number of tokens that can be an entity (`candidates`: a number
of 8 to 20 digits in groups, or words around an "at" with a dot after it) is scored by features of the entire span (groups of
digits, separators, check sum, form, neighbours) and its type; everything else is outside and scores 0. Bounded-entity
dynamic programming picks the segmentation with the highest total, so boundaries and types are chosen jointly. Base spans
stand; the model labels only what lies between them. Weights maximise the conditional likelihood of generated examples
(`examples`, a fixed number), by forward-backward sums.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, digests, masked, ordered, with_spans

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
#: Size of the generated training set and steps of ascent.
EXAMPLES, STEPS, RIDGE = 480, 40, 0.02
#: Groups of features whose scores are remembered.
_CACHE = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += int(d) * 2 - 9 * (d > "4")
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping within each kind, in time linear in the text."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # the local part is the run of its characters before the sign
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end, True))
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", end)
    for m in _CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append(("ip", start, start + size, True))
            start += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), True))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end(), True))
    return ordered(out, KINDS)


# --- the model -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
#: Digits with anything but letters between them; a number in a segment has MIN_DIGITS at least.
MIN_DIGITS, MAX_DIGITS, MAX_GROUPS = 8, 20, 6
_NUMBERS = re.compile(r"\(?(?:[0-9][^A-Za-z0-9]*+){%d,}" % MIN_DIGITS)
_AT = re.compile(r"(?<![A-Za-z])[Aa][Tt](?![A-Za-z])|@")
#: Signs inside a spelled-out address, by what they do there; any other sign ends it.
_JOINS, _OPENS, _CLOSES = "._-+", "([{<", ")]}>"
#: Tokens before and after the "at", and characters that are looked at for them.
_OWN, _OTHER, _NEAR = 6, 14, 240
_ENDS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk"))
#: Words before a segment that tell its kind.
_HINTS = {
    "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "cell": "phone",
    "mail": "email", "email": "email", "contact": "email", "write": "email",
    "card": "card", "visa": "card", "mastercard": "card", "amex": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
}
#: A candidate: start, end, and groups of features, each of which is scored once per distinct group.
Candidate = tuple[int, int, tuple[tuple, ...]]


def _side(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def _hints(text: str, s: int) -> tuple[str, ...]:
    """Kinds that the four tokens before position s hint at."""
    cut_at = max(0, s - 60)
    words = _TOKEN.findall(text, cut_at, s)[-4:]
    return ("hints", *sorted({_HINTS[w] for x in words if (w := x.lower()) in _HINTS}))


def _gap(text: str, a: int, b: int) -> str:
    return "" if a == b else " " if b == a + 1 and text[a] == " " else "wide"


def _left(text: str, s: int) -> tuple[str, str, bool]:
    c = text[s - 1 : s] if s else ""
    return "left", _side(c), c != "" and c in _JOINS


#: Groups of features that do not depend on what a segment holds, by the part of it that is seen first.
_AROUND = {"number": ("left", "right", "hints"), "form": ("own", "left", "hints")}


def _numbers(text: str, start: int, end: int, scores: _Scores | None) -> list[Candidate]:
    """Every run of digit groups and signs within a stretch without letters, of MIN_DIGITS to MAX_DIGITS digits,
    MAX_GROUPS groups and MAX_TOKENS tokens at most; it ends with a digit and starts with one or with a bracket before
    one. With `scores`, those that no surroundings can lift above 0 are left out."""
    out: list[Candidate] = []
    for m in _NUMBERS.finditer(text, start, end):
        tokens = [(x.group(), x.start(), x.end()) for x in _TOKEN.finditer(text, m.start(), m.end())]
        for i, (first, s, _) in enumerate(tokens):
            if not (first.isdigit() or first == "(" and i + 1 < len(tokens) and tokens[i + 1][0].isdigit()):
                continue
            digits, groups, marks, gaps, mark, e = "", (), [], set(), "", 0
            head = None
            for token, a, b in tokens[i : i + MAX_TOKENS]:
                if e:
                    gap = _gap(text, e, a)
                    gaps.add(gap)
                    mark += gap
                e = b
                if not token.isdigit():
                    mark += token
                    continue
                if groups:
                    marks.append(mark)
                mark, digits, groups = "", digits + token, (*groups, min(len(token), MAX_DIGITS))
                if len(digits) > MAX_DIGITS or len(groups) > MAX_GROUPS:
                    break
                if len(digits) < MIN_DIGITS:
                    continue
                octets = len(groups) == 4 and max(groups) <= 3 and all(int(x) <= 255 for x in _octets(digits, groups))
                check = 12 <= len(digits) <= 19 and luhn(digits)
                shape = ("number", groups, tuple(marks), tuple(sorted(gaps)), check, octets, first == "(")
                if scores is not None and not scores.hopeful("number", (shape,)):
                    continue
                if head is None:
                    head = (_left(text, s), _hints(text, s))
                out.append((s, e, (shape, ("right", _side(text[e : e + 1])), *head)))
    return out


def _octets(digits: str, groups: tuple[int, ...]) -> list[str]:
    at = [sum(groups[:k]) for k in range(len(groups) + 1)]
    return [digits[a:b] for a, b in zip(at, at[1:], strict=False)]


def _addresses(text: str, start: int, end: int, scores: _Scores | None) -> list[Candidate]:
    """Every segment around an "at" of words, dots, joining signs and brackets that holds a dot after the "at". With
    `scores`, those that nothing before the "at" can lift above 0 are left out."""
    out: list[Candidate] = []
    for m in _AT.finditer(text, start, end):
        low, high = max(start, m.start() - _NEAR), min(end, m.end() + _NEAR)
        before = text[m.start() - 1 : m.start()] if m.start() > low else ""
        spaced = before == " " and m.start() - 1 > low
        opened = text[m.start() - 1 - spaced : m.start() - spaced] if before else ""
        closed = _TOKEN.match(text, m.end() + (text[m.end() : m.end() + 1] == " "), high)
        if not (opened and opened in _OPENS and closed and closed.group() in _CLOSES):
            opened = ""
        at_s, at_e = (m.start() - 1 - spaced, closed.end()) if opened else (m.start(), m.end())
        at_gap = "none" if at_s <= low else " " if text[at_s - 1] == " " and at_s - 1 > low and not text[at_s - 2].isspace() else "wide" if text[at_s - 1].isspace() else ""
        form = (m.group().lower(), opened, at_gap)
        ends = _domains(text, at_e, high, end, form, scores)
        if not ends:
            continue
        left = [(x.group(), x.start(), x.end()) for x in _TOKEN.finditer(text, low, at_s)]
        if left and left[0][1] == low > start and text[low - 1].isalnum():
            left = left[1:]  # cut off by the window
        own = 0
        for k, (token, s, e) in enumerate(reversed(left[-_OWN:])):
            word = token.isalnum() and token.lower() != "dot"
            if not word and token not in _JOINS and token.lower() != "dot" or own == 4:
                break
            own += word
            if word:
                joined = _gap(text, e, left[len(left) - k][1]) if k else at_gap
                first = (("own", own, k + 1, joined, min(len(token), 4), token.isdigit()), _left(text, s), _hints(text, s))
                out += [(s, x, (*first, *g)) for x, g in ends]
    return out


def _domains(text: str, at: int, high: int, end: int, form: tuple, scores: _Scores | None) -> list[tuple[int, tuple[tuple, ...]]]:
    """(end, groups of features) of what may follow an "at" that ends at `at`."""
    ends, words, dots, turns, depth, before, last_e, gaps = [], 0, (), True, "", "at", at, set()
    for k, x in enumerate(_TOKEN.finditer(text, at, high)):
        token, s, e = x.group(), x.start(), x.end()
        if k == _OTHER or e == high < end and text[high].isalnum():  # the second: cut off by the window
            break
        kind = "dot" if token == "." or token.lower() == "dot" else "word" if token.isalnum() else token
        if kind not in ("dot", "word") and kind not in "_-()[]{}<>":
            break
        gap = _gap(text, last_e, s)
        gaps.add(gap)
        last_e = e
        if kind == "dot":
            turns = turns and before == "word"
            dots, before = (*dots, (token.lower(), depth, gap)), "dot"
        elif kind == "word":
            turns = turns and before in ("at", "dot", "-", "_")
            words, before = words + 1, "word"
            if dots and token.isalpha() and len(token) > 1:
                groups = (
                    ("form", form, dots[-1], len(set(dots))), ("other", words, len(dots), turns, tuple(sorted(gaps))),
                    ("last", token.lower() in _ENDS, min(len(token), 5)), ("right", _side(text[e : e + 1])),
                )
                if scores is None or scores.hopeful("form", groups):
                    ends.append((e, groups))
        elif kind in _OPENS:
            depth = kind
        elif kind in _CLOSES:
            depth = ""
        else:
            before = kind
        if words > 6 or len(dots) > 4:
            break
    return ends


def features(group: tuple) -> list[str]:
    """The features that a group of a candidate stands for."""
    name, *x = group
    if name == "number":
        groups, marks, gaps, check, octets, opened = x
        n, k, same = sum(groups), len(groups), len(set(marks)) < 2
        signs = "".join(sorted(set("".join(marks)) - {" "}))
        sizes = "-".join(map(str, groups))
        return [
            f"groups={sizes}", f"n={n}", f"k={min(k, 6)}", f"signs={signs}", f"n={n}&k={min(k, 6)}", f"gaps={gaps}", f"same={same}&k={min(k, 6)}",
            f"check={check}&long={12 <= n <= 19}", f"check={check}&n={n}&k={min(k, 6)}", f"octets={octets}&same={same}&signs={bool(signs)}", f"octets={octets}&k={min(k, 6)}&{'.' in signs}",
            f"open={opened}&{sizes}", f"open={opened}&closed={')' in signs}", f"first={groups[0]}&last={groups[-1]}", f"many={len(signs) > 2}",
        ]
    if name == "own":
        words, tokens, gap, size, digits = x
        return [f"own={words}", f"owntokens={words}&{tokens}", f"owngap={words}&{gap}", f"ownsize={size}&{digits}"]
    if name == "form":
        (at, opened, at_gap), (dot, dot_opened, dot_gap), styles = x
        return [
            f"at={at}&dot={dot}", f"brackets={bool(opened)}{bool(dot_opened)}", f"at={at}&dot={dot}&brackets={bool(opened)}{bool(dot_opened)}",
            f"like={opened == dot_opened}", f"gaps={at_gap}&{dot_gap}", f"at={at}&dot={dot}&{at_gap}&{dot_gap}&{bool(opened)}", f"styles={styles}",
        ]
    if name == "other":
        words, dots, turns, gaps = x
        return [f"other={words}", f"turns={turns}&dots={dots}", f"turns={turns}", f"left over={words - dots}", f"othergaps={'wide' in gaps}"]
    if name == "hints":
        return [f"hint={h}" for h in x] or ["hint="]
    if name == "left":
        return [f"left={x[0]}", f"leftjoin={x[1]}"]
    return [f"{name}={'&'.join(map(str, x))}"]


def candidates(text: str, taken: list[tuple[int, int]] = (), scores: _Scores | None = None) -> list[Candidate]:
    """All segments that can be an entity and touch nothing of `taken` (start, end), in time linear in the text; with
    `scores` none that cannot score above 0."""
    out, at = [], 0
    for s, e in [*sorted(taken), (len(text), len(text))]:
        if at < s:
            out += _numbers(text, at, s, scores)
            out += _addresses(text, at, s, scores)
        at = max(at, e)
    return out


def decode(scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The segmentation with the highest sum: scored segments (start, end, kind, score), all else 0; ends are exclusive.
    Of equal sums the one with fewer and earlier segments wins."""
    points = sorted({0} | {x for s, e, _, _ in scored for x in (s, e)})
    rank = {x: i for i, x in enumerate(points)}
    ends = defaultdict(list)
    for s, e, kind, score in scored:
        ends[rank[e]].append((rank[s], kind, score))
    best, back = [0.0] * len(points), [None] * len(points)
    for t in range(1, len(points)):
        best[t] = best[t - 1]
        for i, kind, score in ends[t]:
            if best[i] + score > best[t]:
                best[t], back[t] = best[i] + score, (i, kind)
    out, t = [], len(points) - 1
    while t > 0:
        if back[t]:
            out.append((points[back[t][0]], points[t], back[t][1]))
            t = back[t][0]
        else:
            t -= 1
    return out[::-1]


#: Writings that the generated examples use (a, b, c: groups of digits; o: an octet; w: a word; t: a top-level domain),
#: and others that only tests use.
WRITINGS = {
    "phone": ("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "({a}){b}-{c}", "1-{a}-{b}-{c}", "({a}) {b} {c}", "{a} {b} {c}", "1 ({a}) {b}-{c}"),
    "email": ("{w} at {w} dot {t}", "{w} [at] {w} [dot] {t}", "{w}(at){w}(dot){t}", "{w} @ {w} . {t}", "{w}[at]{w}[dot]{t}", "{w}.{w} at {w} dot {t}", "{w} at {w} dot {w} dot {t}"),
    "ip": ("{o}[.]{o}[.]{o}[.]{o}", "{o} . {o} . {o} . {o}", "{o}[.]{o}.{o}.{o}", "{o}, {o}. {o}. {o}"),
    "card": ("{d}.{d}.{d}.{d}", "{d}/{d}/{d}/{d}", "{d}  {d}  {d}  {d}", "{d}.{d}-{d}.{d}"),
}
UNSEEN = {
    "phone": ("{a} {b}-{c}", "1 ({a}) {b} {c}", "{a} - {b} - {c}", "1.{a}.{b}.{c}"),
    "email": ("{w} (at) {w} (dot) {t}", "{w} AT {w} DOT {t}", "{w}{{at}}{w}{{dot}}{t}", "{w}_{w} [at] {w} [dot] {t}"),
    "ip": ("{o}(.){o}(.){o}(.){o}", "{o} [.] {o} [.] {o} [.] {o}", "{o}{{.}}{o}{{.}}{o}{{.}}{o}"),
    "card": ("{d}_{d}_{d}_{d}", "{d}:{d}:{d}:{d}", "{d} / {d} / {d} / {d}"),
}
_HINTS_BEFORE = {"phone": ("call", "phone", "tel:"), "email": ("mail", "contact", "write"), "card": ("card", "visa"), "ip": ("host", "ip")}


def examples(n: int = EXAMPLES, seed: int = 7, writings: dict[str, tuple[str, ...]] = WRITINGS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with their spans: unusual writings of each kind, and look-alikes without any."""
    r = random.Random(seed)

    def d(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def octet() -> str:
        return str(r.randint(0, 255))

    def filled(writing: str, good: bool = True) -> str:
        while luhn(card := r.choice("3456") + d(15)) != good:
            pass
        fours = iter([card[i : i + 4] for i in range(0, 16, 4)])
        out, slots = "", {"a": lambda: d(3), "b": lambda: d(3), "c": lambda: d(4), "o": octet, "w": word, "d": lambda: next(fours)}
        slots["t"] = lambda: r.choice(("com", "org", "net", "de", "edu"))
        for text, name, _, _ in string.Formatter().parse(writing):
            out += text + (slots[name]() if name else "")
        return out

    decoys = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1900, 1990)}-{r.randint(1991, 2030)}",
        lambda: d(r.randint(8, 16)), lambda: filled(r.choice(writings["card"]), False), lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}.{d(3)}",
        lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{r.randint(1, 9)}.{d(1)}.{d(1)}.{d(4)}", lambda: f"{d(1)}, {d(2)}, {d(3)}, {d(4)}",
        lambda: f"{word()} at {word()} {word()}. {word().title()}", lambda: f"{word()} {word()} at {word()}. {word().title()}",
        lambda: f"{word()} at {word()} {word()} {word()}.\n{word().title()} at {word()}.", lambda: f"{d(4)} {d(4)}", lambda: f"({d(4)}-{d(4)})",
        lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{300 + r.randint(0, 600)} . {octet()} . {octet()} . {octet()}",
        lambda: f"{d(3)}-{d(2)}-{d(2)}-{d(2)}-{d(3)}", lambda: f"look at {word()} {word()} dot {word()}", lambda: f"{word()}@{word()}. {word().title()}",
        lambda: " ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 9))), lambda: "\n".join(d(r.randint(1, 6)) for _ in range(r.randint(3, 9))),
        lambda: ", ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 9))), lambda: f"{word()} {d(2)}:{d(2)} at {word()} {d(3)}. {word()}",
    )
    out = []
    for k in range(n):
        spans, text = [], ""
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + r.choice((" ", " ", ". ", ", "))
            if r.random() < 0.55:
                kind = KINDS[k % 4]
                x = filled(r.choice(writings[kind]))
                if r.random() < 0.4:
                    text += r.choice(_HINTS_BEFORE[kind]) + " "
                elif kind == "email":  # without a word before it nobody can tell where the own part begins
                    text += r.choice(("- ", ": ", "\n"))
                spans.append((kind, len(text), len(text) + len(x)))
                text += x
            else:
                text += r.choice(decoys)()
            text += r.choice((" ", ", ", ". "))
        out.append((text + word(), spans))
    return out


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


@functools.cache
def weights() -> dict[tuple[str, str], float]:
    """(kind, feature) -> weight: Adagrad ascent on the conditional log likelihood with a small ridge."""
    data = []
    for text, spans in examples():
        gold = {(s, e): kind for kind, s, e in spans}
        found = candidates(text)
        points = sorted({0} | {x for s, e, _ in found for x in (s, e)})
        rank = {x: i for i, x in enumerate(points)}
        data.append((len(points), [(rank[s], rank[e], [y for g in groups for y in features(g)], gold.get((s, e))) for s, e, groups in found]))
    numbered = {y: i for i, y in enumerate(sorted({y for _, segs in data for x in segs for y in x[2]} | {"bias"}))}
    data = [(n, [(i, j, np.array([numbered[y] for y in f] + [numbered["bias"]]), np.array([kind == t for t in KINDS], float)) for i, j, f, kind in segs]) for n, segs in data if segs]
    w, past = np.zeros((len(numbered), len(KINDS))), np.full((len(numbered), len(KINDS)), 1e-6)
    for _ in range(STEPS):
        grad = -RIDGE * w
        for n, segs in data:
            begin, end = defaultdict(list), defaultdict(list)
            for x in segs:
                score = w[x[2]].sum(0)
                one = (x[0], x[1], _logsum(score.tolist()), score, x)
                begin[x[0]].append(one)
                end[x[1]].append(one)
            alpha, beta = [0.0] * n, [0.0] * n
            for t in range(1, n):
                alpha[t] = _logsum([alpha[t - 1], *(alpha[x[0]] + x[2] for x in end[t])])
            for t in range(n - 2, -1, -1):
                beta[t] = _logsum([beta[t + 1], *(beta[x[1]] + x[2] for x in begin[t])])
            for xs in begin.values():
                for i, j, _, score, (_, _, f, is_gold) in xs:
                    p = is_gold - np.exp(np.minimum(0.0, alpha[i] + score + beta[j] - alpha[-1]))
                    if np.abs(p).max() > 1e-4:
                        np.add.at(grad, f, p)
        past += grad * grad
        w += 0.5 * grad / np.sqrt(past)
    return {(t, y): float(w[i, k]) for y, i in numbered.items() for k, t in enumerate(KINDS) if w[i, k]}


class _Scores(dict):
    """Group of features -> its score per kind; starts anew when full, so memory is bounded."""

    def __init__(self, w: dict[tuple[str, str], float]):
        super().__init__()
        self.w = w
        self.bias = tuple(w.get((t, "bias"), 0.0) for t in KINDS)
        most: dict[tuple[str, str], float] = defaultdict(float)
        for (t, y), x in w.items():
            name = y.partition("=")[0]
            most[t, name] = max(x, 0.0) + most[t, name] if name == "hint" else max(x, most[t, name])
        parts = {"left": ("left", "leftjoin"), "right": ("right",), "hints": ("hint",), "own": ("own", "owntokens", "owngap", "ownsize")}
        #: What bias and surroundings can add at most, per kind.
        self.rest = {part: tuple(self.bias[k] + sum(most[t, y] for g in _AROUND[part] for y in parts[g]) for k, t in enumerate(KINDS)) for part in _AROUND}

    def hopeful(self, part: str, groups: tuple[tuple, ...]) -> bool:
        """Whether some kind can score above 0 in some surroundings."""
        found = [self[g] for g in groups]
        return any(x + sum(f[k] for f in found) > 0 for k, x in enumerate(self.rest[part]))

    def __missing__(self, group: tuple) -> tuple[float, ...]:
        if len(self) >= _CACHE:
            self.clear()
        names = features(group)
        out = self[group] = tuple(sum(self.w.get((t, y), 0.0) for y in names) for t in KINDS)
        return out


def model_spans(text: str, w: dict[tuple[str, str], float] | _Scores, taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that the model finds outside `taken` (start, end)."""
    scores = w if isinstance(w, _Scores) else _Scores(w)
    scored = []
    for s, e, groups in candidates(text, taken, scores):
        parts = [scores[g] for g in groups]
        scored += [(s, e, t, x) for k, t in enumerate(KINDS) if (x := scores.bias[k] + sum(p[k] for p in parts)) > 0]
    return [(kind, s, e, False) for s, e, kind in decode(scored)] if scored else []


def finder(w: dict[tuple[str, str], float] | None = None):
    """A function text -> all spans, base ones kept, by start, then kind."""
    w = weights() if w is None else w
    scores: list[_Scores] = []  # made where it is used

    def find(text: str) -> list[Span]:
        if not scores:
            scores.append(_Scores(w))
        base = base_spans(text)
        return ordered(base + model_spans(text, scores[0], [(s, e) for _, s, e, _ in base]), KINDS)

    return find


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end, base) for every row, whole texts; null text: empty list.

    Offsets are code points. Spans of different kinds may overlap where base patterns do. Repeated rows give repeated
    results; other columns are not read; an empty table gives no rows.
    """
    return with_spans(docs, finder(), id_col, text_col)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with personal data replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; null texts and all other columns stay."""
    return masked(docs, finder(), text_col)


def pii_digests(found: DataFrame) -> DataFrame:
    return digests(found, KINDS)
