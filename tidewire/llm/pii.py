"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans are those of four patterns (email, ip, card, phone), found in time linear in the text, with their checks on digits. The
field looks at windows around what may be an address or a number (an at sign, a spoken dot, seven or more digits, four numbers with dots) and cuts
them into tokens. Candidate segments are runs of at most `LONGEST` tokens with such evidence, in which numbers pass the patterns' checks; features are of the whole
span: the pattern of digit groups, separators, check digits, number ranges, at signs and dots, its ending, whether a word announces it, and what stands at
its borders. Dynamic programming over the tokens, with segments bounded by `LONGEST`, takes the best set of segments and
kinds at once; base spans are fixed, and no added segment touches one.

Training maximises the likelihood of the segments of bounded samples of windows by gradient steps, with the expected features of
the forward and backward sums. Labels are the base spans of the sampled windows, and spans rewritten in other ways of writing the same thing ("a at b dot c",
"1[.]2[.]3[.]4", other groupings of digits); what is no base span is labelled as nothing. Kinds that the sample lacks are
filled in by made-up spans. No label column is used.

Defined cases: null and empty texts have no spans; repeated rows have equal spans; an empty table gives an empty result and the
field is then trained on made-up spans alone; extra columns are ignored. Offsets are code points, ends exclusive.
Scale: one narrow pass; the driver holds at most `most` windows of at most `WIDE` characters; the weights (some thousand numbers) are broadcast.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import edited, mapped, plain

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    """A number of at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match of an at sign begins with the run of local characters before it, behind the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.fullmatch(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by dots, four at a time; what is left of a run is none."""
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, at + size
            at += size + 1


def base(text: str) -> list[Span]:
    """The base spans by start, then by kind."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    out += [("ip", *s) for s in _ips(text)]
    for m in GROUPED.finditer(text):
        digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PLUS.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
EVIDENCE = re.compile(r"@|[\[(](?:at|dot)[\])]| dot |[0-9](?:[ ()./_-]{0,3}[0-9]){6,}|[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}", re.I)
AROUND, WIDE, LONGEST, WIDEST = 60, 400, 20, 80


def windows(text: str, fixed: list[Span]) -> list[tuple[int, int]]:
    """Stretches around evidence that lie between the fixed spans."""
    near: list[list[int]] = []
    for m in EVIDENCE.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if near and a <= near[-1][1]:
            near[-1][1] = b
        else:
            near.append([a, b])
    out, cuts = [], [(s[1], s[2]) for s in fixed]
    k = 0
    for a, b in near:
        while k and cuts[k - 1][1] > a:
            k -= 1
        while k < len(cuts) and cuts[k][0] < b:
            lo, hi = cuts[k]
            if lo > a:
                out.append((a, lo))
            a = max(a, hi)
            k += 1
        if a < b:
            out.append((a, b))
    return [(a, b) for a, b in out if EVIDENCE.search(text, max(0, a - 1), min(len(text), b + 1))]


#: Words that announce a span.
CUES = frozenset(("tel", "phone", "call", "fax", "mobile", "ip", "host", "server", "mail", "email", "e-mail", "contact", "card", "visa", "account"))
AT = re.compile(r"@|[\[( ]at[\]) ]", re.I)
DOT = re.compile(r"\.|[\[( ]dot[\]) ]", re.I)
SPOKEN = re.compile(r"[\[( ]dot[\]) ]", re.I)
DIGITS = re.compile(r"[0-9]+")


def _edge(text: str, i: int) -> str:
    """The kind of character at a border of a span."""
    c = text[i] if 0 <= i < len(text) else " "
    return "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else "." if c in ".,;:!?" else "#"


@lru_cache(maxsize=200_000)
def _features(span: str, before: str, cut: str, on: str) -> tuple[str, ...]:
    """Features of a whole span; none if it can be of no kind. `cut` and `on` tell what stands directly before and behind it."""
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    ats, dots = len(AT.findall(span)), len(DOT.findall(span))
    mail = ats == 1 and dots > 0 and (" at " not in span.lower() or bool(SPOKEN.search(span)))
    four = len(groups) == 4 and not re.search(r"[^\W\d_]", re.sub("dot", "", span, flags=re.I)) and dots == 3 and all(map(_small, groups))
    check = 14 <= len(digits) <= 19 and luhn(digits)
    number = (7 <= len(digits) <= 15 or check) and not re.search(r"[^\W\d_]", span)
    if not (mail or four or number):
        return ()
    can = (mail, four, number and check, number and len(digits) <= 15)
    out = ["can " + "".join(str(int(x)) for x in can), "any", f"before {before}", f"cut {cut}", f"on {on}"]
    if mail:
        host = AT.split(span)[1]
        end = DOT.split(host)[-1].strip()
        out += ["mail", "mail at " + AT.search(span)[0].lower().strip(), "mail dot " + DOT.search(host)[0].lower().strip() if DOT.search(host) else "mail no dot"]
        out += [f"mail end {end.isascii() and end.isalpha()} {min(len(end), 7)}", f"mail blanks {min(8, len(span.split()) - ats - len(re.findall(r' dot ', span, re.I)))}", f"mail first {span[0].isalnum()}"]
        out += [f"mail odd {bool(re.search(r'[^A-Za-z0-9._%+@ ()\[\]-]', span))}", f"mail local words {min(4, len(AT.split(span)[0].split()))}", f"mail host words {min(6, len(re.sub(DOT, '.', host).split()))}"]
    if four:
        out += ["four", f"four ends {span[0].isdigit() and span[-1].isdigit()}", "four by " + "".join(sorted(set(re.sub(r"[0-9\s]", "", span.lower()))))]
    if number:
        shape = "-".join(str(len(g)) for g in groups[:8])
        marks = "".join(sorted(set(re.sub("[0-9]", "", span))))
        out += ["number", f"digits {len(digits)}", f"groups {shape}", f"groups of {len(digits)}: {min(len(groups), 9)}", f"marks {marks}", f"check {check} {len(digits) > 13}", f"plus {span[0] == '+'}"]
        out += [f"ends {span[0] if not span[0].isdigit() else '9'}{span[-1] if not span[-1].isdigit() else '9'}", f"last group {len(groups[-1])}", f"brackets {span.count('(') == span.count(')')}", f"inside {max((len(x) for x in DIGITS.split(span)[1:-1]), default=0)}"]
    return tuple(out)


def segments(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens of a window, and its candidates (first token, one behind the last, features)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
    hot = [bool(re.match(r"[0-9@.]|(?:at|dot)\Z", text[s:e], re.I)) for s, e in tokens]
    out = []
    for i, (s, _) in enumerate(tokens):
        known = False
        before = text[max(0, s - 24) : s].split()[-1:] if s else []
        word = before[0].strip(":.,").lower() if before else ""
        word = word if word in CUES else ""
        cut = _edge(text, s - 1)
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            e = tokens[j - 1][1]
            if e - s > WIDEST:
                break
            known = known or hot[j - 1]
            if known and (found := _features(text[s:e], word, cut, _edge(text, e))):
                out.append((i, j, found))
    return tokens, out


@lru_cache
def _possible(feature: str) -> np.ndarray:
    """0 for the kinds that a segment can be of by its evidence, which its first feature tells, else a score that none survives."""
    return np.array([0.0 if x == "1" else -1000.0 for x in feature.removeprefix("can ")])


class Field:
    """Weights of features by kind."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self._known: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        known = self._known.get(features)
        if known is None:
            if len(self._known) > 100_000:
                self._known.clear()
            known = self._known[features] = _possible(features[0]) + np.sum([self.weights[f] for f in features if f in self.weights] or [np.full(len(KINDS), -9.0)], axis=0)
        return known

    def best(self, text: str, fixed: list[Span]) -> list[Span]:
        """The segments of the best cutting, window by window."""
        out = []
        for a, b in windows(text, fixed):
            tokens, found = segments(text, a, b)
            value, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
            ending: dict[int, list] = {}
            for i, j, features in found:
                s = self.scores(features)
                k = int(s.argmax())
                if s[k] > 0:
                    ending.setdefault(j, []).append((i, k, float(s[k])))
            for j in range(1, len(tokens) + 1):
                value[j] = value[j - 1]
                for i, k, s in ending.get(j, ()):
                    if value[i] + s > value[j]:
                        value[j], back[j] = value[i] + s, (i, k)
            j, own = len(tokens), []
            while j:
                if back[j] is None:
                    j -= 1
                else:
                    i, k = back[j]
                    own.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
                    j = i
            out += own[::-1]
        return out


def _sums(n: int, found: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums and, of each candidate, the probabilities of its kinds."""
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    ends, starts = {}, {}
    for x, (i, j, s) in enumerate(found):
        ends.setdefault(j, []).append(x)
        starts.setdefault(i, []).append(x)
    all_kinds = np.array([np.logaddexp.reduce(s) for _, _, s in found])
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[found[x][0]] + all_kinds[x] for x in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[found[x][1]] + all_kinds[x] for x in starts.get(i, ()))])
    return alpha, np.array([np.exp(alpha[i] + s + beta[j] - alpha[n]) for i, j, s in found]).reshape(-1, len(KINDS))


#: Other ways of writing: of the at sign, of dots, and of what stands between groups of digits.
ATS, DOTS, POINTS, GAPS = (" at ", "(at)", "[at]", " (at) ", " [at] ", " @ "), (" dot ", "(dot)", "[dot]", " (dot) ", " . ", "."), ("[.]", "(.)", " . ", " dot ", "[dot]"), (".", "/", "  ", " - ", "_", " . ")
PHONES = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}) {} {}", "{}/{}-{}", "1 {} {} {}", "1-{}-{}-{}", "001 {} {} {}")


def rewritten(kind: str, span: str, r: random.Random) -> str:
    """The same thing in a way that no base pattern finds."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        local, host = span.split("@")
        at = r.choice(ATS)
        dot = r.choice(DOTS[:4] if at == " at " else DOTS)
        return local.strip(".") + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", r.choice(POINTS))
    if kind == "card":
        size = r.choice((4, 4, 4, 5, 6))
        return r.choice(GAPS).join(digits[i : i + size] for i in range(0, len(digits), size))
    d = (digits[1:] + "5555555")[:10]
    return r.choice(PHONES).format(d[:3], d[3:6], d[6:])


def made_up(kind: str, r: random.Random) -> str:
    """A base span by rule."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    if kind == "email":
        return f"{word()}{r.choice(('.', '_', ''))}{r.choice((word(), number(2)))}@{word()}.{r.choice(('com', 'org', 'net', 'de', 'io'))}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "phone":
        return f"+{r.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}"
    head = number(15)
    return next(head + c for c in "0123456789" if luhn(head + c))


def examples(texts: list[str], seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Windows with the spans to be found: as they stand, and with their spans rewritten. What is no span is nothing."""
    r, out = random.Random(seed), []
    have = Counter(k for t in texts for k, _, _ in base(t))
    plainer = [t for t in texts if not base(t)] or ["so it was in those days, and 12345678 or 2024-05-06 of 1.2.3 it is at rest. not a dot of it"]
    for kind in KINDS:
        for _ in range(max(0, 60 - have[kind])):
            words = r.choice(plainer)[:150].split(" ")
            words.insert(r.randrange(len(words) + 1), made_up(kind, r))
            texts = [*texts, " ".join(words)]
    for text in texts:
        own = [s for i, s in enumerate(base(text)) if not i or s[1] >= base(text)[i - 1][2]]
        out.append((text, own))
        for _ in range(2 if own else 0):
            new, at, spans = "", 0, []
            for kind, a, b in own:
                new += text[at:a]
                word = rewritten(kind, text[a:b], r)
                spans.append((kind, len(new), len(new) + len(word)))
                new, at = new + word, b
            out.append((new + text[at:], spans))
    for _ in range(120):  # neighbours, which the patterns may take for one
        a, b = r.choice(KINDS), r.choice(KINDS)
        head, one, two = r.choice(plainer)[:40].rstrip() + " ", made_up(a, r), made_up(b, r)
        at = len(head) + len(one) + 1
        out.append((f"{head}{one} {two} and so on", [(a, len(head), at - 1), (b, at, at + len(two))]))
    # numbers that look like the others and aren't: other check digits, ranges and lengths
    for _ in range(240):
        like = r.choice((lambda: "".join(r.choice("0123456789") for _ in range(r.randint(7, 19))), lambda: r.choice((".", "[.]", " . ")).join(str(r.choice((r.randint(0, 255), r.randint(256, 999)))) for _ in range(3)) + f".{r.randint(256, 999)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 999)},{r.randint(100, 999)},{r.randint(100, 999)}.{r.randint(10, 99)}", lambda: f"{r.randint(1900, 2030)}{r.choice(' /')}{r.randint(1900, 2030)}", lambda: " ".join(str(r.randint(0, 99)) for _ in range(r.randint(5, 12)))))()
        text = f"{r.choice(plainer)[:60]} {like} {r.choice(plainer)[:60]}"
        if not base(text):
            out.append((text, []))
    r.shuffle(out)
    return out


def train(texts: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Field:
    """A field trained on the examples of these windows, by AdaGrad steps with a small shrinkage."""
    weights: dict[str, np.ndarray] = {}
    squares: dict[str, np.ndarray] = {}
    start = np.full(len(KINDS), -1.0)
    cases = []
    for text, spans in examples(texts, seed):
        for a, b in windows(text, []):
            tokens, found = segments(text, a, b)
            if not found:
                continue
            at = {(s, e): k for k, s, e in spans}
            gold = np.zeros((len(found), len(KINDS)))
            for x, (i, j, _) in enumerate(found):
                if kind := at.get((tokens[i][0], tokens[j - 1][1])):
                    gold[x, KINDS.index(kind)] = 1
            cases.append((len(tokens), found, gold))
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(cases)
        for n, found, gold in cases:
            scored = [(i, j, _possible(features[0]) + np.sum([weights.setdefault(f, start * (f == "any")) for f in features], axis=0)) for i, j, features in found]
            _, p = _sums(n, scored)
            step: dict[str, np.ndarray] = {}
            for (_, _, features), g in zip(found, gold - p, strict=True):
                if np.abs(g).max() > 1e-4:
                    for f in features:
                        step[f] = step.get(f, 0.0) + g
            for f, g in step.items():
                squares[f] = squares.get(f, 1e-2) + g * g
                weights[f] = weights[f] * (1 - 1e-4) + rate * g / np.sqrt(squares[f])
    return Field(weights)


def sampled(docs: DataFrame, most: int = 400, seed: int = 11) -> list[str]:
    """At most `most` windows of at most WIDE characters, half with base spans and half without, in an order by a hash of what they hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                spans = base(text or "")
                some = [(max(0, a - 100), min(len(text), b + 100)) for _, a, b in spans] + [(max(0, a - 40), b + 40) for a, b in windows(text or "", spans)]
                for a, b in some[:64]:
                    piece = text[a : min(b, a + WIDE)]
                    out.append((piece, bool(base(piece))))
            if out:
                yield pd.DataFrame(out, columns=["text", "has"])

    found = mapped(plain(docs).select("text"), run, "text string, has boolean", "text")
    h = F.xxhash64("text", F.lit(seed))
    parts = [found.filter(F.col("has") == x).dropDuplicates(["text"]).orderBy(h, "text").limit(most // 2) for x in (True, False)]
    return [r["text"] for r in parts[0].unionByName(parts[1]).collect()]


def spans_of(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that the field adds."""
    fixed = base(text or "")
    return fixed, field.best(text, fixed) if text else []


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def report(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the base spans' numbers by kind and digest, all spans, and how many of them were added."""
    sent = docs.sparkSession.sparkContext.broadcast(field.weights)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(sent.value)
        for pdf in frames:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                fixed, added = spans_of(text, own)
                n = Counter(s[0] for s in fixed)
                out.append((i, *(n[k] for k in KINDS), hashlib.sha256(_joined(fixed).encode()).hexdigest(), _joined(fixed + added), len(added)))
            yield pd.DataFrame(out, columns=names)

    return mapped(plain(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", "text")


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of `docs`, each span, or run of overlapping ones, replaced by its first kind in angle brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(field.weights)

    def edit(texts: list[str | None]) -> tuple[list[str | None], None]:
        own, out = Field(sent.value), []
        for text in texts:
            spans = sorted(sum(spans_of(text, own), []), key=lambda s: (s[1], KINDS.index(s[0])))
            new, at = [], 0
            for kind, a, b in spans:
                if a >= at:
                    new += [text[at:a], f"<{kind}>"]
                at = max(at, b)
            out.append("".join(new) + text[at:] if spans else text)
        return out, None

    return edited(docs, docs, edit)
