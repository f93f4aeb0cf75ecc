"""Personal data: high-recall generators propose overlapping spans, boosted trees select among them.

Base kinds (email, ip, card, phone) follow fixed rules and are always kept. Every generator also proposes what its rule
rejects, and looser forms: bare phone and card numbers, long mixed tokens, key-like values. Trees over format and context
features, trained on a bounded sample of the corpus that the rules themselves label, score the candidates; thresholds
calibrated per kind on rows that training left out select the spans that are added to the base.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm import boosting, sampling

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Documents whose candidates the trees are trained on, at most.
TRAINING_ROWS = 4_000
#: Training candidates taken from one document, at most.
TRAINING_CANDIDATES = 200
#: Share of the added spans that must be right on the calibration rows.
PRECISION = 0.98

# Linear forms of the rules: a look-behind or an anchor stands where a match can begin, and runs are possessive.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,3}(?![0-9A-Za-z])")
# A bare number that needs no word before it, also beside other numbers; not inside a dotted one.
_BARE_PHONE = re.compile(r"(?<![0-9A-Za-z(])(?<![0-9]\.)(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|\.[0-9])")
_DATE = re.compile(
    r"(?:19|20)[0-9]{2}([ .-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?:19|20)[0-9]{2}[ .-](?:19|20)[0-9]{2}\Z"
    r"|(?:0[1-9]|[12][0-9]|3[01])([ .-])(?:0[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2}(?![0-9])"
)
# Parts of runs that the rules reject as a whole, such as a phone number that a card number follows.
_CARD_PART = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")
_PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{12,}+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_CONTEXT = re.compile(r"([A-Za-z]{2,20})[\"' ]{0,2}[ ]?([=:]?)[ ]?[\"']?\Z")

_PHONE_WORD = re.compile(
    r"(?<![A-Za-z])(?:call|cell|contact|dial|fax|mobile|phone|ring|sms|tel|telephone|telefon|telefax|mobil|handy|anruf"
    r"|appel|appelez|portable|tél|téléphone|teléfono|telefono|móvil|llame)(?![A-Za-z])[^0-9]{0,20}\Z",
    re.IGNORECASE,
)

# Words that introduce credentials, and the public prefix of access key ids.
_KEY_WORDS = ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "auth", "credential")
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp", "sk")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address ends at the first domain after its ``@``; its local part begins where the run of its characters does,
    or where the last address ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at)
        if domain and start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _proposals(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, kind, whether the kind's rule holds) from the generators of the base kinds."""
    for a, b in _emails(text):
        yield a, b, "email", True
    if not any(d in text for d in "0123456789"):
        return
    for m in _IP.finditer(text):
        yield *m.span(), "ip", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) >= 7:
            # 19 digits take 37 characters at most, so no rule holds for a longer run; its parts are proposed all the same
            yield *m.span(), "card", 14 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield *m.span(), "phone", 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans that the fixed rules keep, by start and then by kind."""
    return sorted(((a, b, k) for a, b, k, holds in _proposals(text) if holds), key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """All proposals, the loose ones included."""
    out = list(_proposals(text))
    for a, b, kind, holds in list(out):
        part = {"card": _CARD_PART, "phone": _PHONE_PART}.get(kind)
        if part and not holds:
            out += [(*m.span(), kind, False) for m in part.finditer(text, a, b) if m.span() != (a, b)]
    if out or any(d in text for d in "0123456789"):
        loose = [m.span() for m in _LOOSE_PHONE.finditer(text)]
        bare = [m.span() for m in _BARE_PHONE.finditer(text)]
        out += [(a, b, "phone", False) for a, b in sorted({*loose, *bare})]
        out += [(*m.span(), "secret", False) for m in _TOKEN.finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of a candidate and what stands before it."""
    own = text[start:end]
    n = len(own)
    digits, upper = sum(c.isdigit() for c in own), sum(c.isupper() for c in own)
    counts = Counter(own)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before = text[max(0, start - 40) : start]
    context = _CONTEXT.search(before)
    word = context[1].lower() if context else ""
    only = _NOT_DIGIT.sub("", own)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:], strict=False))
    return [
        KINDS.index(kind), end - start, digits / n, upper / n, entropy, len(counts) / n, changes / n, len(only),
        sum(c in " .()-" for c in own), sum(c in "0123456789abcdef" for c in own) / n, float(own.startswith("+")),
        float(own.startswith("(")), float(any(word.endswith(k) for k in _KEY_WORDS)), float(bool(context and context[2])),
        float(before.endswith(('"', "'"))), float(own.startswith(_KEY_PREFIXES)), float(own.count(".")),
        float(14 <= len(only) <= 19 and luhn(only)), float(text[end : end + 1].isalnum()),
        float(kind == "phone" and bool(_BARE_PHONE.fullmatch(own))), float(bool(_DATE.match(own))),
        float(kind == "phone" and bool(_PHONE_WORD.search(before))), float(bool(_IP.match(own))),
    ]


def _teacher(text: str, start: int, end: int, kind: str, holds: bool) -> bool:
    """Weak label of a candidate: the rule of its kind; for bare phones a full number or one that a word announces, no date
    or dotted address; for secrets a value that a credential word or prefix marks."""
    if kind == "card" and not holds and _CARD_PART.fullmatch(text, start, end):
        return luhn(_NOT_DIGIT.sub("", text[start:end]))
    if kind == "phone" and not holds:
        own = text[start:end]
        if _PHONE_PART.fullmatch(text, start, end) or _BARE_PHONE.fullmatch(own):
            return True
        announced = _PHONE_WORD.search(text[max(0, start - 40) : start])
        return bool(announced and 7 <= len(_NOT_DIGIT.sub("", own)) <= 15 and _LOOSE_PHONE.fullmatch(own)) and not (
            _DATE.match(own) or _IP.match(own)
        )
    if kind != "secret":
        return holds
    context = _CONTEXT.search(text[max(0, start - 40) : start])
    named = context and context[2] and any(context[1].lower().endswith(k) for k in _KEY_WORDS)
    return bool(named) or (text[start : start + 4] in _KEY_PREFIXES and end - start == 20)


def _rewritten(text: str, start: int, end: int, kind: str) -> Iterator[str]:
    """A base span and what stands around it in forms that the sample may lack, so that the trees do not take the form of
    the sample for the kind: a card number in groups of four, and the same with a wrong check digit; a phone number without
    its ``+``, with and without a word that announces it, and dates and other numbers of its digits."""
    before, after, digits = text[max(0, start - 40) : start], text[end : end + 1], _NOT_DIGIT.sub("", text[start:end])
    if kind == "card" and len(digits) == 16:
        for last in (digits[-1], str((int(digits[-1]) + 1) % 10)):
            own = " ".join((digits[:4], digits[4:8], digits[8:12], digits[12:15] + last))
            yield f"{before}{own} {own}{after}"
    if kind == "phone":
        d, sep = digits[-10:], " .-"[int(digits[-1]) % 3]
        area, month, day, year = f"{2 + int(d[0]) % 8}{d[1:3]}", f"0{1 + int(d[3]) % 9}", f"1{d[4]}", f"20{d[5:7]}"
        forms = [
            (area, d[3:6], d[6:]), (f"({area}) {d[3:6]}", d[6:]), (d[:2], d[2:5], d[5:8]), (f"0{d[1:3]}", d[3:7], d[7:]),
            (d[:4], d[4:8]), (d[:3], d[3:7]), (d[:3], d[3:5]), (year, month, day), (day, month, year), (year, month, f"{day} {d[7:9]}"),
        ]
        for own in [*(sep.join(f) for f in forms), f"1{d[:2]}.1{d[2:4]}", f"3{d[:2]}.1{d[2:4]}.1{d[4:6]}.1{d[6:8]}", f"3{d[:2]}.1{d[2]}.2{d[3]}.3{d[4]}"]:
            yield f"{before}{own}{after}"
            yield f"{before[-20:]} call {own}{after}"


def _open(found: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str, bool]]:
    """The base spans and the candidates that overlap none of them, which alone can be added."""
    taken = _Free([])
    for a, b, _, holds in found:
        if holds:
            taken.put(a, b)
    return [c for c in found if c[3] or taken.holds(*c[:2])]


def _training_rows(text: str) -> list[dict]:
    """Features, kind and weak label of a text's first candidates, and of those of other forms of its first base spans."""
    found = _open(candidates(text))[:TRAINING_CANDIDATES]
    rows = [(text, *c) for c in found]
    for kind in KINDS:
        first = next((c for c in found if c[3] and c[2] == kind), None)
        for made in _rewritten(text, *first[:3]) if first else ():
            rows += [(made, *c) for c in _open(candidates(made)) if not c[3]]
    return [{"x": features(t, a, b, k), "kind": k, "y": _teacher(t, a, b, k, h), "base": h} for t, a, b, k, h in rows]


@dataclass
class Selector:
    trees: boosting.Trees = field(default_factory=boosting.Trees)
    thresholds: dict[str, float] = field(default_factory=dict)

    def added(self, text: str) -> list[Span]:
        """Candidates above their kind's threshold that overlap neither a base span nor a better candidate."""
        proposed = candidates(text)
        taken = [(a, b) for a, b, _, holds in proposed if holds]
        open_ones = [c for c in proposed if not c[3] and c[2] in self.thresholds]
        if not open_ones:
            return []
        p = self.trees.probability(np.array([features(text, a, b, k) for a, b, k, _ in open_ones]))
        good = sorted((-s, a, b, k) for s, (a, b, k, _) in zip(p, open_ones, strict=True) if s >= self.thresholds[k])
        free = _Free(taken)
        return [(a, b, k) for _, a, b, k in good if free.take(a, b)]


class _Free:
    """Positions that no taken span covers."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for a, b in taken:
            self.put(a, b)

    def put(self, a: int, b: int) -> None:
        for cell in range(a >> 8, (b >> 8) + 1):
            self.cells.setdefault(cell, []).append((a, b))

    def holds(self, a: int, b: int) -> bool:
        return not any(x < b and a < y for cell in range(a >> 8, (b >> 8) + 1) for x, y in self.cells.get(cell, ()))

    def take(self, a: int, b: int) -> bool:
        if not self.holds(a, b):
            return False
        self.put(a, b)
        return True


def train(documents: DataFrame, rows: int = TRAINING_ROWS) -> Selector:
    """Trees and thresholds from the candidates of at most ``rows`` documents. Without candidates nothing is added."""

    @F.arrow_udf("array<struct<x:array<double>,kind:string,y:boolean,base:boolean>>")
    def described(texts: pa.Array) -> pa.Array:
        out = [_training_rows(text or "") for text in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("x", pa.list_(pa.float64())), ("kind", pa.string()), ("y", pa.bool_()), ("base", pa.bool_())])))

    keys = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"))
    sample = sampling.bounded(keys.distinct(), rows, "key")
    texts = documents.select(F.col("doc_id").alias("key"), "text")
    # the sample is bounded by `rows`, so that it may be sent to every executor; of rows with one id one is taken
    once = texts.join(F.broadcast(sample), "key").groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = once.select("key", F.explode(described("text")).alias("c"))
    table = found.select("c.x", "c.kind", "c.y", "c.base").toArrow()
    if not table.num_rows:
        return Selector()
    x = np.array(table["x"].combine_chunks().flatten()).reshape(table.num_rows, -1)
    y, kinds, base = (np.array(table[c].to_pylist()) for c in ("y", "kind", "base"))
    return _fitted(x, y.astype(float), kinds, base)


def _fitted(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, base: np.ndarray) -> Selector:
    """Trees from all rows but a fold of them; thresholds from the rows of that fold that are no base spans."""
    order = np.lexsort((base, y, *x.T[::-1]))
    x, y, kinds, base = x[order], y[order], kinds[order], base[order]
    fold = np.arange(len(y)) % 4 == 0
    trees = boosting.calibrate(boosting.train(x[~fold], y[~fold], rounds=40), x[fold], y[fold])
    thresholds = {}
    p = trees.probability(x[fold])
    for kind in KINDS:
        own = (kinds[fold] == kind) & ~base[fold]
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[fold][own][order])
        scores = np.append(p[own][order], 0.0)
        # rows of equal scores are taken together
        good = np.flatnonzero((right >= PRECISION * np.arange(1, len(order) + 1)) & (scores[:-1] > scores[1:]))
        if len(good) and right[good[-1]]:
            # halfway to the next row, so that the least score of a few rows is not the least that is taken
            thresholds[kind] = max(0.5, float(scores[good[-1]] + scores[good[-1] + 1]) / 2)
    return Selector(trees, thresholds)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover replaced by the name of its first span's kind."""
    out, at, end = [], 0, -1
    for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"<{k.upper()}>"]
        at = end = b
    return "".join([*out, text[at:]])


_TYPE = pa.struct([*((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(selector: Selector, text: Column | str = "text") -> Column:
    """Struct of the counts of base spans by kind, their digest, and all spans as ``kind:start:end``.

    Positions are code points, ends exclusive. A null text counts as empty: no spans, the digest of the empty string.
    """

    @F.arrow_udf("struct<" + ",".join(f"n_{k}:bigint" for k in BASE_KINDS) + ",base_sha256:string,spans:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in (t.as_py() or "" for t in texts):
                base = base_spans(text)
                kinds = Counter(k for _, _, k in base)
                rows.append(
                    {f"n_{k}": kinds[k] for k in BASE_KINDS}
                    | {
                        "base_sha256": hashlib.sha256(_written(base).encode()).hexdigest(),
                        "spans": _written(base + selector.added(text)),
                    }
                )
            yield pa.array(rows, _TYPE)

    return found(text)


def redact(selector: Selector, text: Column | str = "text") -> Column:
    """The text with all spans replaced by the names of their kinds; null stays null."""

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = (t.as_py() for t in texts)
            yield pa.array([t and redacted(t, base_spans(t) + selector.added(t)) for t in own], pa.string())

    return cleaned(text)


def personal_data(documents: DataFrame, selector: Selector) -> DataFrame:
    """``doc_id`` and the fields of ``find`` for every row."""
    return documents.select("doc_id", find(selector).alias("found")).select("doc_id", "found.*")
