"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds select.

Generators favour recall: whatever looks like an address, a number of some length, or a secret is proposed, often
several spans over the same characters. A candidate is described by its format (length, digits, separators, variety,
check digits) and its context (the characters and words around it). Gradient-boosted trees, trained here, give each candidate a
score; the scores of each kind are calibrated on candidates kept aside, and a span is selected from the score on at
which the selected ones are right often enough. Overlapping selections of one kind give way to the best one.

What the fixed patterns of a kind match stays in any case. These matches also teach the trees: on a bounded sample of
the corpus a candidate is a positive example if a check, such as a checksum, speaks for it, and a negative one if it
speaks against it. Kinds that a corpus may lack are taught by examples written by rule, right and wrong ones.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.batches import slices, with_columns
from siftwell.llm.shared import ship

KINDS = ("email", "ip", "card", "phone", "secret", "iban")
#: Documents whose candidates the trees learn from.
SAMPLE_DOCUMENTS = 4_000
TREES, DEPTH, RATE, LEAST_LEAF, BINS = 40, 3, 0.2, 8, 16
#: How many of a hundred selected spans of a kind must be right, as far as the calibration tells.
PRECISION = 0.97
CONTEXT = 24
#: Characters of the shortest IBAN.
MIN_IBAN = 15


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# --- fixed patterns --------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits match as a whole or not at all, so a match never begins inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards; the part before it reaches back to the end of the match before at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _parts_fit(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlaps within a kind; failing ones are dropped."""
    found = [Span("email", a, b) for a, b in _emails(text)]
    found += [Span("ip", *m.span()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


# --- candidates ------------------------------------------------------------------------------------

# How national phone numbers are grouped: the area code in brackets or after 00, North America, a leading
# zero, pairs after it, three groups without one, local numbers, one run.
_LAYOUTS = "|".join((
    r"(?:00[1-9][0-9]{0,2}[ ./-]?)?\([0-9]{2,5}\)[ ./-]?[0-9]{3,8}(?:[ .-][0-9]{2,5}){0,2}",
    r"00[1-9][0-9]{0,2}[ ./-][0-9]{2,5}(?:[ ./-]?[0-9]{2,8}){1,4}",
    r"(?:1[ .-])?[2-9][0-9]{2}(?P<sep>[ .-])[0-9]{3}(?P=sep)[0-9]{4}",
    r"0[1-9](?:[ .-][0-9]{2}){4}",
    r"0[1-9][0-9]{0,4}[ /.-][0-9]{3,8}(?:[ .-][0-9]{2,5}){0,3}",
    r"[6-9][0-9]{2}(?: [0-9]{3}){2}|[6-9][0-9]{2}(?: [0-9]{2}){3}",
    r"[2-9][0-9]{2}[ .-][0-9]{4}",
    r"0[1-9][0-9]{7,10}|[2-9][0-9]{9}",
))
_LAYOUT = re.compile(_LAYOUTS)
_BRACKETED = re.compile(r"00|\([0-9]{3}\)[ ./-]?[0-9]{3}[ .-][0-9]{4}\Z")
_PHONE_CUE = re.compile(r"\b(?:tele?[pf]|tel\b|tél|phone|call|mobil|fax|cell|handy|dial|ring\b|sms\b|whatsapp|anruf|appel|llam)", re.I)

# What generators look for, besides the fixed patterns. Possessive repeats keep failing attempts linear.
_GENERATORS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{2,63}+)+", re.I)),
    # Without a sentence that begins after the address.
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}+(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?)[\w-]{2,63}+)+", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ -])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")),
    ("phone", re.compile(rf"(?<![0-9A-Za-z+])(?<![0-9][./-])(?:{_LAYOUTS})(?![0-9A-Za-z]|[./-][0-9])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[0-9A-Za-z_+/=-]{16,}+(?![0-9A-Za-z_+/=-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
)

# Words that announce personal data or a secret, by kind.
_CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server", "login"),
    "card": ("card", "visa", "credit", "pay", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
_QUOTES = "\"'`"
N_FEATURES = 20


# Whatever any pattern finds holds one of these.
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every generator."""
    found = [Span(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]
    return [Span(s.kind, s.start, _iban_end(text, s)) if s.kind == "iban" else s for s in found]


def _iban_end(text: str, span: Span) -> int:
    """Where the check digits come out right: capitals or digits after the last space may be no part of the number."""
    found = text[span.start : span.end]
    ends = [len(found), *(i for i in range(len(found) - 1, MIN_IBAN - 1, -1) if found[i] == " ")]
    return span.start + next((end for end in ends if _mod97(found[:end])), len(found))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    found = text[span.start : span.end]
    before, after = text[max(0, span.start - CONTEXT) : span.start].lower(), text[span.end : span.end + 2]
    n = len(found)
    digits = sum(c.isdigit() for c in found)
    letters = sum(c.isalpha() for c in found)
    upper = sum(c.isupper() for c in found)
    hexadecimal = sum(c in "0123456789abcdefABCDEF" for c in found)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(found, found[1:]))
    cue = any(word in before for word in _CUES[span.kind])
    other = any(word in before for kind, words in _CUES.items() if kind != span.kind for word in words)
    return [
        KINDS.index(span.kind), n, digits, digits / n, letters / n, upper / max(1, letters), hexadecimal / n,
        len(set(found)) / n, turns / n, n - digits - letters, float(found[0] == "0"), float(cue), float(other),
        float("=" in before[-4:] or ":" in before[-4:]), float(before[-1:] in tuple(_QUOTES) and after[:1] in tuple(_QUOTES)),
        float(not before or before[-1].isspace()), float(_checked(text, span)),
        float(_announced(text, span)), float(_well_formed(span.kind, found)), float(span.kind == "phone" and bool(_BRACKETED.match(found))),
    ]


def _announced(text: str, span: Span) -> bool:
    """Whether a word for a phone stands around the number, a number before it perhaps between."""
    return span.kind == "phone" and bool(_PHONE_CUE.search(text[max(0, span.start - 2 * CONTEXT) : span.start]) or _PHONE_CUE.search(text[span.end : span.end + CONTEXT // 2]))


def _well_formed(kind: str, found: str) -> bool:
    """Whether a phone number is grouped as one, an IP address has all eight groups, and an email's dots stand as in one."""
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in found) <= 15 and bool(_LAYOUT.fullmatch(found))
    if kind == "ip":
        return found.count(":") == 7
    return kind == "email" and not re.search(r"(?<! )\. ", found)


def _mod97(found: str) -> bool:
    plain = found.replace(" ", "")
    return MIN_IBAN <= len(plain) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _checked(text: str, span: Span) -> bool:
    """Whether the check digits of a card or IBAN come out right; no other kind has any."""
    found = text[span.start : span.end]
    if span.kind == "card":
        return luhn(_DIGITS.sub("", found)) and not re.search(r"[0-9][ -]?\Z", text[max(0, span.start - 2) : span.start])
    return span.kind == "iban" and _mod97(found)


def _right(text: str, span: Span, base: set[Span]) -> bool | None:
    """What a check says of a candidate of the corpus; None if it says nothing, and the trees do not learn from it."""
    found = text[span.start : span.end]
    if span.kind in ("card", "iban"):
        return _checked(text, span)
    if span.kind == "secret":
        # Named as one, and of a variety that words and numbers do not have.
        before = text[max(0, span.start - CONTEXT) : span.start].lower()
        return any(w in before for w in _CUES["secret"]) and entropy(found) > 3.0
    if any(b.kind == span.kind and b.start < span.end and span.start < b.end for b in base):
        return True
    if not _well_formed(span.kind, found):
        return False
    # A number grouped as a phone number may be one without a word that says so.
    return True if span.kind != "phone" or _announced(text, span) else None


def entropy(found: str) -> float:
    """Bits per character."""
    counts = np.unique(list(found), return_counts=True)[1] / len(found)
    return float(-(counts * np.log2(counts)).sum())


def _drawn_iban(rng: np.random.Generator) -> str:
    """An IBAN of any country's length, half of them with right check digits, in one piece or in fours."""
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    country, bank = "".join(rng.choice(letters, 2)), "".join(rng.choice(letters, 4)) if rng.random() < 0.5 else ""
    bank += "".join(map(str, rng.integers(0, 10, int(rng.integers(11, 31)) - len(bank))))
    plain = next(v for k in range(2, 99) if _mod97(v := f"{country}{k:02d}{bank}"))
    if rng.random() < 0.5:
        plain = f"{country}{(int(plain[2:4]) + int(rng.integers(1, 96))) % 97:02d}{bank}"
    return plain if rng.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))


def _drawn_phone(rng: np.random.Generator, right: bool) -> str:
    """A number grouped as phone numbers are, or one of another length or grouping."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    lead = str(rng.integers(2, 10))
    if right:
        sep = str(rng.choice([" ", "-", "."]))
        layouts = (
            f"({lead}{d(2)}) {d(3)}-{d(4)}", f"{lead}{d(2)}{sep}{d(3)}{sep}{d(4)}", f"0{lead}{d(2)}{rng.choice([' ', '/', '-'])}{d(int(rng.integers(6, 9)))}",
            f"0{lead}{d(1)} {d(4)} {d(4)}", f"0{lead}{d(3)} {d(6)}", f"0{lead} " + " ".join(d(2) for _ in range(4)), f"0{lead}{d(2)} {d(3)} {d(2)} {d(2)}",
            f"(0{lead}{d(int(rng.integers(1, 4)))}) {d(int(rng.integers(6, 9)))}", f"00{lead}{d(1)} {d(3)} {d(int(rng.integers(4, 8)))}", f"{rng.integers(6, 10)}{d(2)} {d(3)} {d(3)}",
            f"{lead}{d(2)}-{d(4)}", f"0{lead}{d(int(rng.integers(8, 10)))}", f"{lead}{d(9)}",
        )
    else:
        layouts = (f"({d(2)}) {d(2)}-{d(2)}", f"({d(4)}) {d(4)} {d(4)} {d(4)} {d(4)}", f"00{lead} {d(2)} {d(2)}", f"({d(3)}) {d(2)}.{d(2)}", f"({d(2)}){d(4)}.{d(2)}.{d(2)}.{d(2)}")
    return str(rng.choice(layouts))


def drawn(rng: np.random.Generator) -> list[tuple[str, Span, bool]]:
    """Examples written by rule, and whether they are right: formats with right and wrong checks, after cues and after plain words.

    They stand beside those of the corpus, where some kinds may not occur at all. Phone numbers are right by how they
    were written: with a bracketed or international area code, or after a word for a phone; without either, or
    of odd length, they are wrong.
    """
    out = []
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for k in range(1800):
        kind = KINDS[k % len(KINDS)]
        announced = rng.random() < 0.5
        cue = str(rng.choice(_CUES[kind])) + str(rng.choice([" = \"", ": ", " ", "="])) if announced else str(rng.choice(["and the ", "of ", "in ", "("]))
        number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        group = lambda n: "".join(rng.choice(list(alphabets[0]), n))
        right = None
        if kind == "card":
            value = number(int(rng.integers(13, 20)))
        elif kind == "phone":
            fits = rng.random() < 0.75
            value = _drawn_phone(rng, fits)
            cue += str(rng.choice(["", "", "me at ", "is ", "number "])) if announced else ""
            right = fits and (announced or bool(_BRACKETED.match(value)))
        elif kind == "secret":
            letters = alphabets[int(rng.integers(2))]
            value = "".join(rng.choice(list(letters), int(rng.integers(16, 64))))
            if rng.random() < 0.3:
                value = str(rng.choice(["step", "version", "chapter"])) + "-" + number(2) + "-of-the-long-title"
        elif kind == "iban":
            value = _drawn_iban(rng)
        elif kind == "ip":
            # Fewer groups are hardware addresses and times; eight of two digits are longer hardware addresses.
            right = rng.random() < 0.6
            if right:
                value = ":".join(group(int(rng.integers(1, 5))) for _ in range(7)) + ":" + group(4)
            else:
                value = ":".join(group(2) for _ in range(8 if rng.random() < 0.3 else 6)) if rng.random() < 0.6 else ":".join(number(2) for _ in range(5))
        else:
            right = rng.random() < 0.6
            at, dot = str(rng.choice(["(at)", "[at]", " (at) ", " [at] "])), str(rng.choice([".", " . ", " (dot) ", "[dot]"]))
            value = f"{number(2)}abc{at}mail{dot}example" if rng.random() < 0.5 else f"bob.smith{at}mail{dot}example{dot}org"
            if not right:
                value = str(rng.choice(["we met", "a rate", "stayed"])) + f" (at) {rng.choice(['noon', 'home', 'three'])}. {rng.choice(['Then', 'They', 'Nobody'])} went"
        text = cue + value + str(rng.choice(["\"", " ", ".", ", and"]))
        own = candidates(text)
        base = set(base_spans(text))
        out += [(text, s, bool(_right(text, s, base)) if right is None or s.kind != kind else right) for s in own]
    return out


# --- boosted trees ---------------------------------------------------------------------------------


class Trees(NamedTuple):
    """Trees as flat arrays: feature and threshold of each inner node, values of the leaves, and per kind what to select."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    scale: np.ndarray
    shift: np.ndarray
    least: np.ndarray


def _leaves(feature: np.ndarray, threshold: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return node - (2**DEPTH - 1)


def raw_scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), trees.start)
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        out += leaf[_leaves(feature, threshold, x)]
    return out


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree by second-order gains over binned features."""
    inner = 2**DEPTH - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for k in range(inner):
        rows = np.flatnonzero(node == k)
        best = 1e-6
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, cuts in enumerate(edges):
            for cut in cuts:
                left = x[rows, f] <= cut
                if min(left.sum(), len(rows) - left.sum()) < LEAST_LEAF:
                    continue
                a, b = g[rows][left].sum(), h[rows][left].sum()
                gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                if gain > best:
                    best, feature[k], threshold[k] = gain, f, cut
        node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
    at = node - inner
    leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
    return feature, threshold, leaf


def _calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through the scores of one kind."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        v = p * (1 - p)
        slope = np.array([((p - y) * score).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        curve = np.array([[(v * score**2).sum() + 0.1, (v * score).sum()], [(v * score).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(curve, slope)
        a, b = float(np.clip(a - step[0], 0.1, 5)), b - float(step[1])
    return a, b


def train(x: np.ndarray, y: np.ndarray, seed: int = 9) -> Trees:
    """Trees, and for each kind the least probability from which on PRECISION of the candidates kept aside are right."""
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.3
    learn, t = x[~aside], y[~aside].astype(float)
    start = float(np.log((t.sum() + 1) / (len(t) - t.sum() + 1)))
    edges = [np.unique(np.quantile(learn[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(learn) else np.zeros(0) for f in range(N_FEATURES)]
    score, grown = np.full(len(learn), start), []
    for _ in range(TREES if 0 < t.sum() < len(t) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(learn, edges, p - t, p * (1 - p))
        grown.append(tree)
        score += tree[2][_leaves(tree[0], tree[1], learn)]
    inner = 2**DEPTH - 1
    stack = [np.array([tree[k] for tree in grown]).reshape(len(grown), -1) for k in range(3)]
    scale, shift, least = np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), 2.0)
    trees = Trees(stack[0].reshape(-1, inner).astype(int), stack[1].reshape(-1, inner), stack[2].reshape(-1, inner + 1), start, scale, shift, least)
    score = raw_scores(trees, x[aside])
    for k in range(len(KINDS)):
        own = x[aside][:, 0] == k
        s, right = score[own], y[aside][own].astype(float)
        if right.sum() < 5:
            continue
        scale[k], shift[k] = _calibrated(s, right) if right.sum() < len(right) else (1.0, 0.0)
        p = 1 / (1 + np.exp(-np.clip(scale[k] * s + shift[k], -30, 30)))
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        ends = np.append(np.diff(p[order]) != 0, True)  # equal scores are selected together
        good = np.flatnonzero((share >= PRECISION) & ends)
        if len(good):
            least[k] = max(0.5, p[order][good[-1]])
    return trees


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Trees:
    """Train on the candidates of about `documents` documents chosen by hash, and on examples drawn by rule.

    Only features and labels of candidates come to the driver; the number of documents bounds them, and each brings
    at most one of each kind, its first in order of a hash of the text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.count(F.lit(1)).alias("n")).first().n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, y = [], []
                for text in part.column("text").to_pylist():
                    own = {}
                    for span in candidates(text or ""):
                        key = hashlib.blake2b(f"{span.start}".encode() + text[span.start : span.end].encode(), digest_size=8).digest()
                        own[span.kind] = min(own.get(span.kind, (b"\xff" * 9, span)), (key, span))
                    base = set(base_spans(text)) if own else set()
                    known = [(span, right) for _, span in own.values() if (right := _right(text, span, base)) is not None]
                    x += [features(text, span) for span, _ in known]
                    y += [right for _, right in known]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], ["x", "y"])

    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.where(draw < min(1.0, documents / max(1, rows))).select("text").mapInArrow(run, "x array<double>, y boolean")
    found = sorted((tuple(r.x), r.y) for r in picked.collect())
    examples = drawn(np.random.default_rng(1))
    x = [list(v) for v, _ in found] + [features(text, span) for text, span, _ in examples]
    y = [right for _, right in found] + [right for _, _, right in examples]
    return train(np.array(x, float).reshape(-1, N_FEATURES), np.array(y, bool))


# --- spans of documents ----------------------------------------------------------------------------


def _order(span: Span) -> tuple[int, int, int]:
    return span.start, KINDS.index(span.kind), span.end


def find(texts: list[str | None], trees: Trees) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each whole text, in order; null has none."""
    texts = [t if t and _ANY.search(t) else "" for t in texts]
    proposed = [candidates(t) if t else [] for t in texts]
    flat = [features(t, s) for t, spans in zip(texts, proposed) for s in spans]
    chance = np.zeros(0)
    if flat:
        x = np.array(flat)
        kind = x[:, 0].astype(int)
        chance = 1 / (1 + np.exp(-np.clip(trees.scale[kind] * raw_scores(trees, x) + trees.shift[kind], -30, 30)))
        chance = np.where(chance >= trees.least[kind], chance, 0)
    out, at = [], 0
    for text, spans in zip(texts, proposed):
        base = base_spans(text) if text else []
        taken = list(base)
        scored = sorted(zip(-chance[at : at + len(spans)], spans), key=lambda x: (x[0], _order(x[1])))
        at += len(spans)
        fixed_starts, fixed_ends = _merged(base)
        starts: list[int] = []
        ends: list[int] = []
        for score, span in scored:
            # What base spans cover or a better one meets needs no second redaction; what reaches beyond a base span does.
            i, j = bisect_left(starts, span.end), bisect_right(fixed_starts, span.start)
            if score < 0 and not (i and ends[i - 1] > span.start) and not (j and fixed_ends[j - 1] >= span.end):
                taken.append(span)
                starts.insert(i, span.start)
                ends.insert(i, span.end)
        out.append((sorted(base, key=_order), sorted(taken, key=_order)))
    return out


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for span in sorted(spans, key=_order):
        if ends and span.start < ends[-1]:
            ends[-1] = max(ends[-1], span.end)
        else:
            starts.append(span.start)
            ends.append(span.end)
    return starts, ends


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _mapped(docs: DataFrame, text: str, trees: Trees, name: str, field: T.StructField, make: Callable) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                values = [make(t, *spans) for t, spans in zip(texts, find(texts, trees))]
                yield with_columns(part, **{name: pa.array(values, T_ARROW[name] if name in T_ARROW else pa.string())})

    kept = [f for f in docs.schema.fields if f.name != name]
    return docs.mapInArrow(run, T.StructType([*kept, field]))


T_ARROW = {"pii": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))}


def annotate(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """`docs` with `pii`: an array of kind, start, end (code points, end exclusive) and whether a fixed pattern matched.

    Null and empty texts have none. A column of that name is replaced; repeated rows are read one by one.
    """
    kind = T.ArrayType(T.StructType.fromDDL("kind string, start long, end long, base boolean"))
    make = lambda t, base, spans: [{"kind": s.kind, "start": s.start, "end": s.end, "base": s in fixed} for fixed in [set(base)] for s in spans]
    return _mapped(docs, text, trees, "pii", T.StructField("pii", kind), make)


def redact(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets; overlapping ones by that of the first."""

    def make(t: str | None, base: list[Span], spans: list[Span]) -> str | None:
        if not spans:
            return t
        out, at = [], 0
        for s in spans:
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind}]"]
            at = max(at, s.end)
        return "".join([*out, t[at:]])

    columns = docs.columns
    return _mapped(docs, text, trees, text, T.StructField(text, T.StringType()), make).select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, and all spans as text."""
    found = annotate(docs.select("doc_id", "text"), fit(docs))
    base = F.filter("pii", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
