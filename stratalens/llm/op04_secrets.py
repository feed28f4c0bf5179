"""Secret scans: fixed patterns, and a guess-cost estimate of values in a credential context.

Three base kinds come from fixed patterns. The method reads further values that
stand where a credential would (``login: ...``, ``pwd=...``), splits each into
dictionary words, dates, repeats, keyboard walks and brute-force spans at the
least total guess cost (dynamic programming over its characters), and reports
those that would take at least MIN_LOG10 powers of ten of guesses. Such a span
has the kind ``guess`` and covers the value; base spans stay as they are.

A brute-force span is charged for the character classes it has, upper and lower
case being two. Dictionary words are WORDS, then the whole words of a public
tokenizer's vocabulary in its order: a fixed list, so that a text has the same spans in
any corpus, and a leaked value's copies in prose can't make a word of it.

Spans are code points, end exclusive. Null text counts as empty. Rows may repeat,
other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, bytes_of, table

KINDS = ("assign", "access", "hex", "guess")
#: Least log10 of guesses of a reported value: over any seven letters, capitalised or not (10.2), under seven letters and digits (10.9).
MIN_LOG10 = 10.25

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs that are long enough
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|login|private[_-]?key)["']?\x20*(?::|=>?)\x20*["']?([^\s"'<>,;]{4,})""",
    re.ASCII | re.IGNORECASE,
)
#: One of these is in every text that ASSIGN or CONTEXT can match.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"credential", b"login", b"private")
#: Hexadecimal digits to one byte, so that a long run is a plain substring.
_HEX_RUN = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))

#: Common words of passwords, most used first (fixed values).
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou sunshine princess football baseball shadow superman michael jordan "
    "secret summer winter spring autumn hello freedom whatever trustno1 starwars computer internet server database system user root test guest default changeme example "
    "access key token pass word love money happy orange purple silver golden flower cookie pepper ginger hunter ranger soccer hockey killer george charlie andrew thomas robert "
    "daniel jessica ashley nicole jennifer amanda matthew joshua the and for you this that with from have your home work life time world"
).split()
RANK = {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(WORDS))}
#: Letters of a dictionary word.
SHORTEST, LONGEST = 3, 24
#: Letters of a word taken from the public vocabulary: shorter ones turn up in random values.
PUBLIC_SHORTEST = 5
WORD = re.compile(r"[^\W\d_]+")
#: Rows of a keyboard, each key a half step right of the one above (fixed values).
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
#: Keys and directions that a walk may begin with, and what each key adds for turns.
WALKS, WALK_STEP = 47 * 6, 0.075
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Forms of dates and the log10 of their guesses: days of two centuries, and years.
DATES = [(re.compile("[-/.]?".join(form), re.ASCII), guesses) for form, guesses in (((_YEAR, _MONTH, _DAY), 4.6), ((_DAY, _MONTH, _YEAR), 4.6), ((_MONTH, _DAY, _YEAR), 4.6), ((_YEAR,), 2.1))]
LEET = str.maketrans("@4301!$57", "aaeoiisst")


def _beside(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and p != q and (abs(p[1] - q[1]) <= 1 and p[0] == q[0] or q[0] - p[0] == 1 and q[1] - p[1] in (-1, 0) or p[0] - q[0] == 1 and q[1] - p[1] in (0, 1)))


def _brute(c: str) -> float:
    """log10 of the characters of c's class."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def _class(c: str) -> int:
    """The bit of c's character class: digits, lower case, upper case, other ASCII, all else."""
    if c.isdigit():
        return 1
    if not c.isascii():
        return 16
    return 8 if not c.isalpha() else 4 if c.isupper() else 2


#: log10 of the characters of every set of classes.
ALPHABET = [0.0, *(math.log10(sum(size for k, size in enumerate((10, 26, 26, 33, 100)) if m >> k & 1)) for m in range(1, 32))]


def _charges(value: str) -> list[list[float]]:
    """For every set of classes, what each character of value adds to a brute-force span over that set.

    A capital where letters begin is also a lower-case letter, for twice the guesses.
    """
    classes = [_class(c) for c in value]
    capital = [c == 4 and (not i or classes[i - 1] not in (2, 4)) for i, c in enumerate(classes)]
    found = 0
    for c, first in zip(classes, capital, strict=True):
        found |= c | (2 if first else 0)
    sets = [m for m in range(1, 32) if m & found == m]
    return [[ALPHABET[m] if c & m else ALPHABET[m] + math.log10(2) if first and m & 2 else math.inf for c, first in zip(classes, capital, strict=True)] for m in sets]


class Lengthening:
    """Segments over a run of alike neighbours, at any length from least on, at log10(2) for each doubling of the length.

    For each range of lengths from one power of two to the next, a queue of starts
    keeps the cheapest in reach first, so that a place takes as many steps as the
    run's length has binary digits.
    """

    def __init__(self, least: int, base: float, slope: float, begin: int):
        self.least, self.base, self.slope, self.begin = least, base, slope, begin
        self.queues: list[deque[tuple[float, int]]] = []

    def step(self, j: int, best: list[float], joint: float) -> tuple[float, int]:
        """The cheapest cost of a segment that ends at j, what is before it included, and its start."""
        top = (j - self.begin).bit_length()
        while len(self.queues) < top:
            self.queues.append(deque())
        out = (math.inf, 0)
        for k, queue in enumerate(self.queues):
            shortest, longest = max(self.least, 1 << k), (2 << k) - 1
            i = j - shortest
            if shortest <= longest and i >= self.begin:
                cost = best[i] + (joint if i else 0.0) - self.slope * i
                while queue and queue[-1][0] > cost:
                    queue.pop()
                queue.append((cost, i))
            while queue and queue[0][1] < j - longest:
                queue.popleft()
            if queue:
                cost, i = queue[0]
                out = min(out, (cost + self.slope * j + self.base + k * math.log10(2), i))
        return out


def guess_cost(value: str, rank: dict[str, float] = RANK, by_class: bool = False) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for value, and the cheapest segments (start, end, kind).

    Adding a segment doubles the guesses. Words (plain or with signs for letters),
    dates of every form, repeats of three and more and walks of four and more keys, of
    any length, are offered at every place. rank has the log10 of the guesses of
    dictionary words. A brute-force span is charged character by character, or with
    by_class for all the classes it has; no two of them meet, so the least cost up to a
    place is kept apart for what ends there in such a span and in anything else. The
    result is the least of all segmentations. A value of n characters takes n log n steps.
    """
    n, low = len(value), value.lower()
    low = low if len(low) == n else value  # a few letters grow
    plain = low.translate(LEET)
    charges = _charges(value) if by_class else [[_brute(c) for c in value]]
    # the least cost up to a place after a brute-force span, after any other segment, and of both
    brute, other, best = [math.inf] * (n + 1), [0.0] + [math.inf] * n, [0.0] + [math.inf] * n
    start, back = [0] * (n + 1), [(0, "")] * (n + 1)
    spans = [(math.inf, 0)] * len(charges)  # open ones: cost and start
    joint = math.log10(2)
    repeat = walk = None

    def offer(j: int, cost: float, i: int, kind: str) -> None:
        if cost < other[j]:
            other[j], back[j] = cost, (i, kind)

    for i in range(n):
        best[i] = min(brute[i], other[i])
        fresh = (other[i] + (joint if i else 0.0), i)
        for k, charge in enumerate(charges):
            cost, at = min(spans[k], fresh)
            spans[k] = cost + charge[i], at
            if spans[k][0] < brute[i + 1]:
                brute[i + 1], start[i + 1] = spans[k]
        before = best[i] + (joint if i else 0.0)
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            known = min(rank.get(low[i:j], math.inf), rank.get(plain[i:j], math.inf) + 0.5)
            if known < math.inf:
                offer(j, before + known + (0.3 if value[i:j] != low[i:j] else 0.0), i, "word")
        if low[i].isdigit():
            for form, guesses in DATES:
                if m := form.match(low, i):
                    offer(m.end(), before + guesses, i, "date")
        if not i or low[i] != low[i - 1]:
            repeat = Lengthening(3, _brute(low[i]), 0.0, i)
        if not i or not _beside(low[i - 1], low[i]):
            walk = Lengthening(4, math.log10(WALKS), WALK_STEP, i)
        offer(i + 1, *repeat.step(i + 1, best, joint), "repeat")
        offer(i + 1, *walk.step(i + 1, best, joint), "walk")
    best[n] = min(brute[n], other[n])
    parts, j, after = [], n, False
    while j:
        if not after and brute[j] < other[j]:
            i, kind, after = start[j], "brute", True  # what is before it is no such span
        else:
            (i, kind), after = back[j], False
        parts.append((i, j, kind))
        j = i
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def guess_spans(text: str, min_log10: float = MIN_LOG10, rank: dict[str, float] = RANK) -> list[tuple[int, int, str]]:
    return [(*m.span(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], rank, by_class=True)[0] >= min_log10]


def _hinted(low: bytes) -> bool:
    """Whether ASSIGN or CONTEXT can match a text of these lower-case bytes."""
    return (b":" in low or b"=" in low) and any(h in low for h in HINTS)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def public_words(path: str | None = None) -> list[str]:
    """The whole words, of PUBLIC_SHORTEST letters or more, of a tokenizer file with word ends, in order of its ids; the public 49k one where no path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ended = (t.removesuffix("</w>") for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    return [w for w in ended if PUBLIC_SHORTEST <= len(w) <= LONGEST and WORD.fullmatch(w)]


def word_ranks(path: str | None = None) -> dict[str, float]:
    """log10 of the guesses of WORDS and of public_words(path). The documents teach no words: a text has the same spans in any corpus."""
    return {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys([*WORDS, *public_words(path)]))}


def scan_secrets(df: DataFrame, text: str = "text", min_log10: float = MIN_LOG10, rank: dict[str, float] | None = None) -> DataFrame:
    """df with n_assign, n_access, n_hex, n_guess, base_sha256 (of the base spans' line) and spans (all, one line).

    rank has the dictionary words, those of word_ranks() by default.
    """
    fields = [(f"n_{k}", "long") for k in KINDS] + [("base_sha256", "string"), ("spans", "string")]
    shared = df.sparkSession.sparkContext.broadcast(word_ranks() if rank is None else rank)

    def factory():
        known = shared.value

        def row(raw: bytes) -> list:
            low = raw.lower()
            hints = _hinted(low)
            if not (hints or b"akia" in low or b"h" * 24 in raw.translate(_HEX_RUN)):
                spans = base = []
            else:
                t = raw.decode()
                base = base_spans(t)
                spans = base + (guess_spans(t, min_log10, known) if hints else [])
            return [*(sum(s[2] == k for s in spans) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]

        def compute(batch):
            rows = [row(raw) for raw in bytes_of(batch, text)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

        return compute

    return append_columns(df, fields, factory)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")
