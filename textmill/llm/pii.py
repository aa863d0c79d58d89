"""Personal data by candidate gradient boosting.

1. Base spans: four exact formats (fixed values below), leftmost and non-overlapping for each kind, with their checks. They always stay.
2. High-recall generators propose further, overlapping spans: emails spelled with "at" and "dot", telephone and identity numbers in
   other forms, addresses of sixteen-bit groups, keys, tokens and passwords.
3. Boosted trees score each candidate by its format (lengths, character classes, separators, checksums, entropy) and its context (words
   before it, neighbouring characters). They are trained here, on candidates drawn from a fixed grammar of true and
   look-alike spans, half for the trees and half for the thresholds.
4. For each kind the threshold is the lowest score above which the calibration half is surely (at 95 %) right in 98 of 100; what passes, highest
   score first and clear of base spans, is redacted too.

Offsets are code points, ends exclusive. Kinds, in order: email, ip, card, phone, secret, national_id.

Defined results: a null text is an empty one and has no spans; rows are read one by one, so repeated rows get equal results; an empty table
gives an empty result; very long texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone", "secret", "national_id")
RANK = {k: i for i, k in enumerate(KINDS)}

# The base formats.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
#: The same matches: a run of digits either matches from its start or not at all, so no other start is tried, and no run is cut.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """As the email pattern's leftmost matches: the local part is the whole run before an @."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def _plain(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _plain(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_plain(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], RANK[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# High-recall generators.
_SPELLED = re.compile(r"(?: ?[(\[{](?:at|AT)[)\]}] ?| (?:at|AT) )[A-Za-z0-9-]+(?:(?: ?[(\[{](?:dot|DOT)[)\]}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().\-/]{5,40}[0-9]")
_GROUPS16 = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
_TOKEN = re.compile(r"[A-Za-z0-9_\-]{12,}")
_KNOWN = re.compile(r"(?:AKIA|ASIA|ghp_|sk-|glpat-|AIza)[A-Za-z0-9_\-]{12,}")
_ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd)?|secret|token|api[_-]?key|bearer)\W{1,4}[\"']?([^\s\"']{6,})")


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal; the same place can be proposed for several kinds."""
    out: list[Span] = []
    if "at" in text or "AT" in text:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
    if ":" in text:
        out += [("ip", *m.span()) for m in _GROUPS16.finditer(text) if m.end() - m.start() >= 9]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    out += [("secret", *m.span()) for m in _KNOWN.finditer(text)]
    if not _DIGIT.search(text):
        return out  # what follows takes a digit of its own
    for m in _NUMBERS.finditer(text):
        n = len(_plain(m[0]))
        if 7 <= n <= 15:
            out += [("phone", *m.span()), ("national_id", *m.span())]
        if 13 <= n <= 19:
            out.append(("card", *m.span()))
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]):
            out.append(("secret", *m.span()))
    return out


_CUES = {
    "mail": ("mail", "contact", "reach", "write"),
    "call": ("tel", "phone", "call", "fax", "mobile", "whatsapp", "dial"),
    "card": ("card", "visa", "iban", "account", "payment"),
    "key": ("key", "token", "secret", "password", "passwd", "bearer", "auth"),
    "id": ("ssn", "social", "passport", "national id", "tax id", "insurance"),
    "host": ("ip", "host", "server", "address", "ping"),
    "thing": ("version", "isbn", "order", "invoice", "page", "ticket", "commit", "date", "build", "part no"),
}
FEATURES = [*(f"is_{k}" for k in KINDS), "length", "digits", "letters", "upper", "lower", "dots", "dashes", "spaces", "slashes", "parens", "colons", "groups", "first_group", "last_group",
            "plus", "luhn", "entropy", "hex_only", "known_prefix", "alternations", "year_like", "left_word", "right_word", *(f"cue_{c}" for c in _CUES)]


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    count = Counter(s)
    digits, upper, lower = sum(count[c] for c in "0123456789"), sum(map(str.isupper, s)), sum(map(str.islower, s))
    groups = re.findall("[0-9]+", s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in count.values()) if s else 0.0
    kinds = ["d" if c.isdigit() else "l" if c.isalpha() else "o" for c in s]
    before = text[max(0, a - 40) : a].lower()
    return [
        *(float(kind == k) for k in KINDS), len(s), digits, sum(map(str.isalpha, s)), upper, lower, count["."], count["-"], count[" "], count["/"], count["("] + count[")"], count[":"],
        len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, float(s[:1] == "+"), float(digits > 12 and luhn(_plain(s))), entropy,
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))), float(bool(re.match("AKIA|ASIA|ghp_|sk-|xox|eyJ|AIza|glpat", s))), sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)),
        float(bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")), float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()),
        *(float(any(w in before for w in words)) for words in _CUES.values()),
    ]


class Examples:
    """The grammar of labelled candidates, from a fixed seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, *lengths: int, sep: str = "") -> str:
        return sep.join("".join(self.r.choice("0123456789") for _ in range(n)) for n in lengths)

    def chars(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(low, high)))

    def word(self) -> str:
        return self.chars("abcdefghilmnoprstu", 2, 9)

    def mixed(self) -> str:
        """Letters of both cases, without a digit, perhaps with a sign."""
        s = list(self.chars("abcdefghijklmnopqrstuvwxyz", 6, 14) + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1, 4) + self.r.choice(["", "", "!", "_", "#"]))
        if self.r.random() < 0.5:
            self.r.shuffle(s)
        return "".join(s)

    def card(self, valid: bool) -> str:
        """A number of card length whose Luhn sum is right or not, in spellings that are mostly outside the base format."""
        r = self.r
        lengths = r.choice([(13,), (4, 3, 3, 3), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3)])
        body = self.digits(sum(lengths) - 1)
        right = next(c for c in "0123456789" if luhn(body + c))
        number = body + (right if valid else r.choice([c for c in "0123456789" if c != right]))
        sep = r.choice([".", "  ", "/", " - "] if lengths[1:] and sum(lengths) > 13 else [".", "  ", "/", " ", "-"])
        ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
        return sep.join(number[b - n : b] for n, b in zip(lengths, ends, strict=True))

    def positive(self) -> tuple[str, str, str]:
        """(kind, cue, span)."""
        r, w = self.r, self.word
        at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", ".")])
        alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return r.choice([
            lambda: ("email", r.choice(["mail", "contact", "reach me", ""]), f"{w()}{r.choice(['.', '_', ''])}{w()}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"),
            lambda: ("phone", r.choice(["call", "tel:", "phone", "fax"]), r.choice([f"({self.digits(3)}) {self.digits(3, 4, sep='-')}", self.digits(3, 3, 4, sep=r.choice("-. ")), f"0{self.digits(2, 3, 4, sep=' ')}"])),
            lambda: ("national_id", r.choice(["ssn", "social security", "national id", "tax id"]), self.digits(3, 2, 4, sep="-")),
            lambda: ("card", r.choice(["card", "visa", "payment", "account", ""]), self.card(True)),
            lambda: ("ip", r.choice(["server", "host", "ping", "address"]), ":".join(self.chars("0123456789abcdef", 1, 4) for _ in range(8))),
            lambda: ("secret", r.choice(["key", "aws key", "", "uses"]), "AKIA" + self.chars(alnum[:26] + "234567", 16, 16)),
            lambda: ("secret", r.choice(["password=", "secret:", "passwd="]), self.chars(alnum[26:], 9, 20) + self.digits(2)),
            lambda: ("secret", r.choice(['token = "', "bearer ", "api_key="]), self.chars(alnum if r.random() < 0.5 else "0123456789abcdef", 24, 44) + self.digits(1)),
            lambda: ("secret", r.choice(["password=", "my password=", "passwd=", "pwd: secret="]), self.mixed()),
            lambda: ("secret", "", r.choice(["ghp_", "sk-", "glpat-", "AIza"]) + self.chars(alnum, 20, 36) + self.digits(1)),
        ])()

    def negative(self) -> tuple[str, str, str]:
        r, w = self.r, self.word
        year = str(r.randint(1900, 2099))
        return r.choice([
            lambda: ("email", r.choice(["look", "we met", ""]), f"{w()} at {w()}.{w()}"),
            lambda: ("phone", r.choice(["date", "on", "since", ""]), f"{year}-{self.digits(2, 2, sep='-')}"),
            lambda: ("phone", r.choice(["pages", "years", "from", ""]), f"{year} - {r.randint(1900, 2099)}"),
            lambda: ("phone", r.choice(["invoice", "order", "part no", "ticket", "isbn"]), self.digits(r.randint(7, 13))),
            lambda: ("phone", r.choice(["about", "sold", "", "was"]), self.digits(3, 3, 3, sep=" ")),
            lambda: ("phone", "", self.digits(r.randint(7, 15))),
            lambda: ("national_id", r.choice(["call", "invoice", "", "order", "since"]), r.choice([self.digits(3, 3, 4, sep="-"), self.digits(9), f"{year}-{self.digits(2, 2, sep='-')}", self.digits(4, 4, sep="-")])),
            lambda: ("card", r.choice(["order", "isbn", "", "part no"]), self.digits(r.randint(13, 19))),
            lambda: ("card", r.choice(["order", "isbn", "", "part no", "card", "account"]), self.card(False)),
            lambda: ("ip", r.choice(["at", "from", ""]), self.digits(2, 2, 2, 2, sep=":")),
            lambda: ("secret", r.choice(["", "the", "in", "version", "commit", "see"]), r.choice([f"{w()}{w()}{w()}{self.digits(1)}", f"{w()}-{w()}-{year}", f"{w()}_{w()}_{self.digits(2)}", f"{w()}-{self.digits(1)}-{w()}", self.digits(r.randint(12, 20))])),
            lambda: ("secret", r.choice(["token:", "secret:", "password:", "the secret: "]), w() + w()[:6]),
        ])()

    def draw(self, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        for _ in range(n):
            true = self.r.random() < 0.5
            kind, cue, s = self.positive() if true else self.negative()
            left = f"{self.word()} {self.word()} {cue}{'' if cue[-1:] in ('=', chr(34), ' ') else ' '}"
            text = f"{left}{s} {self.word()} {self.word()}."
            span = (kind, len(left), len(left) + len(s))
            x.append(features(text, span))
            y.append(float(true))
            kinds.append(kind)
        return np.array(x), np.array(y), kinds


@dataclass
class Boosted:
    """Depth-limited regression trees on the log loss; nodes are (feature, cut, left, right) or a leaf value."""

    start: float
    trees: list

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), out)
        return out

    def _add(self, node, x, rows, out) -> None:
        if not len(rows):
            return
        if not isinstance(node, tuple):
            out[rows] += node
            return
        f, cut, left, right = node
        low = x[rows, f] <= cut
        self._add(left, x, rows[low], out)
        self._add(right, x, rows[~low], out)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, least: int = 8, l2: float = 1.0) -> Boosted:
    """Second-order gradient boosting over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    model = Boosted(float(np.log(y.mean() / (1 - y.mean()))), [])
    raw = np.full(len(y), model.start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * total_g / (total_h + l2))
        if not left or len(rows) < 2 * least:
            return leaf
        best, at = 1e-6, None
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            lg, lh, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
            gain = lg**2 / (lh + l2) + (total_g - lg) ** 2 / (total_h - lh + l2) - total_g**2 / (total_h + l2)
            gain[(n < least) | (len(rows) - n < least)] = 0
            if gain.max() > best:
                best, at = gain.max(), (f, int(gain.argmax()))
        if at is None:
            return leaf
        low = binned[rows, at[0]] <= at[1]
        return (at[0], float(cuts[at[0]][at[1]]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        model.trees.append(tree)
        model._add(tree, x, np.arange(len(y)), raw)
    return model


class Taken:
    """Disjoint intervals in order; overlaps are found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for a, b in sorted(spans):
            if self.end and a < self.end[-1]:
                self.end[-1] = max(b, self.end[-1])
            else:
                self.start.append(a)
                self.end.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.start, b)
        return i > 0 and self.end[i - 1] > a

    def add(self, a: int, b: int) -> None:
        """An interval that meets none."""
        i = bisect.bisect_left(self.start, a)
        self.start.insert(i, a)
        self.end.insert(i, b)


@dataclass
class Detector:
    model: Boosted
    thresholds: dict[str, float]

    def scores(self, text: str, found: list[Span], step: int = 10_000) -> list[float]:
        """The candidates' scores, a bounded matrix of features at a time."""
        return [x for i in range(0, len(found), step) for x in self.model.score(np.array([features(text, s) for s in found[i : i + step]])).round(9).tolist()]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The candidates that pass their kind's threshold, best first, clear of base spans and of each other."""
        taken = Taken([(a, b) for _, a, b in base])
        found = [s for s in dict.fromkeys(candidates(text)) if not taken.meets(s[1], s[2])]
        out: list[Span] = []
        for p, s in sorted(zip(self.scores(text, found), found, strict=True), key=lambda x: (-x[0], x[1][1], RANK[x[1][0]], -x[1][2])):
            if p >= self.thresholds[s[0]] and not taken.meets(s[1], s[2]):
                out.append(s)
                taken.add(s[1], s[2])
        return out


def surely(right: int, n: int, z: float = 1.645) -> float:
    """The lower end of the Wilson interval of a share."""
    p = right / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score above which precision is surely reached, halfway to the next lower one; 2 if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, right = scores[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(s[1:] < s[:-1], True))
    good = [i for i in ends.tolist() if surely(int(right[i]), i + 1) >= precision]
    if not good:
        return 2.0
    i = good[-1]
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def train(n: int = 6000, precision: float = 0.98, seed: int = 5) -> Detector:
    """Fits trees on n drawn candidates, and calibrates each kind's threshold on n others that the trees have not seen."""
    model = boost(*Examples(seed).draw(n)[:2])
    x, y, kinds = Examples(seed + 1).draw(n)
    p = model.score(x)
    own = {k: np.array([k == kind for kind in kinds]) for k in KINDS}
    return Detector(model, {k: threshold(p[own[k]], y[own[k]], precision) for k in KINDS})


def all_spans(text: str, detector: Detector) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    return base, sorted([*base, *detector.added(text, base)], key=lambda s: (s[1], RANK[s[0]], s[2]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind}>" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, detector: Detector | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, base counts, base_sha256, spans and their number, and the number of those beyond the base, of every row; with_text adds the redacted text.
    A null text is an empty one; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(detector or train())  # a few hundred tree nodes
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added", *["redacted"] * with_text]
    kinds = [*[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 2, *[pa.string()] * with_text]

    def run(batches):
        for batch in batches:
            rows = []
            for text in text_of(batch).to_pylist():
                base, spans = all_spans(text, shared.value)
                n = Counter(k for k, _, _ in base)
                rows.append((n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), len(spans) - len(base), *([redact(text, spans)] if with_text else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")
