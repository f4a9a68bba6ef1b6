"""Personal data: fixed patterns, and candidates that gradient-boosted trees accept.

The fixed patterns (email, ip, card, phone) always stand.  Generators of high
recall propose further spans, which may overlap; trees boosted on format and
context score them, and those above a calibrated threshold are added.

There are no labels.  Positives are the fixed patterns' matches and rewritten
forms of them (other separators, spelt-out signs, missing prefixes) in their own
contexts, and values assigned to a name such as ``token``.  Negatives are decoys:
candidates that fail the check of their kind (Luhn, octets, digits of a phone,
randomness of a secret), which can't be personal.  Candidates that pass it and
are no fixed match are unlabelled and left out.  The checks themselves are no
features: a decoy is never accepted anyway, and what is to be learnt is which
formats and contexts decoys come in.

A score is calibrated by isotonic regression on examples left out of the fit.
There each decoy stands for the number that pass its check by chance, and the
rewritten forms together for an assumed share of the fixed matches, so that the
probability is that of a candidate met in the texts, not of an invented example.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, in_slices, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans; a secret has no fixed pattern.
ALL_KINDS = (*KINDS, "secret")
#: At most so many different examples of each label, those of least hash, are used to fit the trees.
MAX_EXAMPLES = 10_000
#: Calibrated probability from which on a candidate is accepted.
PRECISION = 0.9
#: Loose forms that are assumed to occur for each fixed match.
LOOSE_SHARE = 0.1
#: Spans that pass the check of their kind by chance for each one that fails it: one number in ten passes Luhn;
#: the other checks are failed by shape (a date, too few digits), which says little of the shapes that pass.
LUHN_ODDS, SHAPE_ODDS = 1 / 9, 0.05
CONTEXT = 40
#: A node of a tree holds so many examples: a loose form that stands alone among the negatives isn't learnt by heart.
LEAST_ROWS = 20

Span = tuple[str, int, int]

_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{5,}[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches around each @; linear also in long runs without a domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _EMAIL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                found.append(("email", start, end))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind as listed, then start.

    A dotted match lies within one run of digits and dots, and inside it can
    only begin where a run of digits does; so these are looked for there.
    """
    out = emails(text) if "@" in text else []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") > 2:
            for m in _IP.finditer(run.group()):
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                    out.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|<at>)\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?)"
#: Loose forms by kind.  They begin at a character that ends no word and are bounded in length.
GENERATORS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(rf"(?<![\w.])[A-Za-z0-9][\w.%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.IGNORECASE)),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?[.,]\s?|\[\.\]|\(dot\))[0-9]{1,3}(?:(?:\s?[.,]\s?|\[\.\]|\(dot\))[0-9]{1,3}){2}(?!\w)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("card", re.compile(r"(?<!\w)[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{2,6}){2,4}(?!\w)")),
    ("phone", re.compile(r"(?<!\w)(?:00)?[(]?[0-9]{2,4}[)]?(?:[\x20./-]{1,2}[(]?[0-9]{2,5}[)]?){2,4}(?!\w)")),
    ("phone", re.compile(r"(?<!\w)00[0-9]{8,13}(?!\w)")),
    ("secret", re.compile(r"(?<![\w/+=-])[A-Za-z0-9][A-Za-z0-9/+_-]{15,199}={0,2}(?![\w/+=-])")),
)
_ANY_DIGITS = re.compile(r"[0-9][^\w]{0,3}[0-9]")
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|(?:api|access|private|secret)[_\x20-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[\x20./-]{1,2}[01]?[0-9][\x20./-]{1,2}[0-3]?[0-9](?![0-9])|[0-3]?[0-9][\x20./-]{1,2}[01]?[0-9][\x20./-]{1,2}(?:19|20)[0-9]{2}(?![0-9])")


def entropy(own: str) -> float:
    """Bits a character of the span's own distribution of characters."""
    n = np.unique(np.frombuffer(own.encode("utf-32-le"), dtype="<u4"), return_counts=True)[1] / max(1, len(own))
    return float(-(n * np.log2(n)).sum()) if own else 0.0


def passes(kind: str, own: str) -> bool:
    """The check of its kind, without which a span is a decoy."""
    digits = _DIGITS.sub("", own)
    if kind == "email":
        return bool(re.search(r"[A-Za-z]{2,}$", own))
    if kind == "ip":
        return ":" in own or all(int(g) <= 255 for g in re.findall("[0-9]+", own))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not _DATE.match(own)
    return any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and entropy(own) > 3


def candidates(text: str) -> list[Span]:
    """Spans of all generators, overlapping or not."""
    out: list[Span] = []
    low = text.lower() if "at)" in text or "at]" in text or "at}" in text or "at>" in text or "@" in text or "AT" in text else ""
    if "@" in low or "(at)" in low or "[at]" in low or "{at}" in low or "<at>" in low:
        out += [("email", m.start(), m.end()) for m in GENERATORS[0][1].finditer(text)]
    if _ANY_DIGITS.search(text):
        for kind, pattern in GENERATORS[1:6]:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        # a long run of signs with a digit in it, or one that a name announces
        out += [("secret", m.start(), m.end()) for m in GENERATORS[6][1].finditer(text) if any(map(str.isdigit, m.group())) and not m.group().isdigit()]
    return out


#: Words that announce data of a kind.
CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "passw", "auth"),
}
FEATURES = 29
#: Place of the number of digits among the features.
N_DIGITS = len(ALL_KINDS) + 1


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context; nothing that names the data itself, and not the check of its kind."""
    kind, a, b = span
    own, left, right = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = _DIGITS.sub("", own)
    groups = re.findall(r"[0-9]+", own)
    marks = re.sub(r"[\w\s]", "", own)
    sides = left + right
    letters = sum(c.isalpha() for c in sides)
    size = max(1, len(sides))
    low = left.lower()
    return [
        *(float(kind == k) for k in ALL_KINDS),
        len(own),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(set(digits)),
        len(marks),
        len(set(marks)),
        own.count(" "),
        sum(c.isalpha() for c in own),
        float(own[:1] == "("),
        float(own[:2] == "00"),
        letters / size,
        sum(c.isdigit() for c in sides) / size,
        sum(not c.isalnum() and not c.isspace() for c in sides) / size,
        float(left[-1:].isspace() or not left),
        float(right[:1].isspace() or right[:1] in ".,;" or not right),
        float(left.rstrip()[-1:].isalpha()),
        float(right.lstrip()[:1].isalpha()),
        float(any(w in low for w in CUES[kind])),
        float(kind == "secret" and _NAMED.search(left) is not None),
        own.count("."),
        own.count("/"),
        own.count("-"),
    ]


def rewritten(kind: str, own: str) -> list[str]:
    """Loose forms of a match of a fixed pattern."""
    if kind == "email":
        name, _, domain = own.partition("@")
        return [f"{name} (at) {domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} @ {domain}"]
    if kind == "ip":
        return [own.replace(".", "[.]"), own.replace(".", " . ")]
    digits = _DIGITS.sub("", own)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "  ".join(fours), "_".join(fours)]
    parts = re.findall(r"[0-9]+", own)
    own_area = parts[1:] if len(parts) > 3 else parts
    return ["00" + digits, "00" + " ".join(parts), "-".join(own_area), ".".join(own_area), f"({parts[1] if len(parts) > 1 else parts[0]}) " + "-".join(parts[2:] or parts)]


def overlaps(a: Span, others: list[Span]) -> bool:
    return any(a[1] < o[2] and o[1] < a[2] for o in others)


#: Labels of examples: decoys, fixed matches (and named secrets), rewritten forms.
DECOY, MATCH, REWRITTEN = range(3)


def examples(text: str) -> list[tuple[int, list[float]]]:
    """(label, features) of a text's labelled candidates and of the rewritten matches in their contexts."""
    base = base_spans(text)
    out = [(MATCH, features(text, span)) for span in base]
    for span in dict.fromkeys(candidates(text)):
        kind, a, b = span
        if overlaps(span, base):
            continue
        if not passes(kind, text[a:b]):
            out.append((DECOY, features(text, span)))
        elif kind == "secret" and _NAMED.search(text, max(0, a - CONTEXT), a):
            out.append((MATCH, features(text, span)))
    for kind, a, b in base:
        for form in rewritten(kind, text[a:b]):
            left, right = text[max(0, a - 2 * CONTEXT) : a], text[b : b + 2 * CONTEXT]
            end = len(left) + len(form)
            for span in candidates(left + form + right):
                if span[0] == kind and abs(span[1] - len(left)) < 3 and abs(span[2] - end) < 3 and passes(kind, form):
                    out.append((REWRITTEN, features(left + form + right, span)))
    return out


def weights_of(labels: np.ndarray, x: np.ndarray, n: np.ndarray, loose_share: float = LOOSE_SHARE) -> np.ndarray:
    """What an example stands for: its occurrences; a decoy those that pass by chance, rewritten forms a share of their kind's matches."""
    w = n.astype(float)
    for j, kind in enumerate(ALL_KINDS):
        of_kind = x[:, j] == 1
        by_luhn = (x[:, N_DIGITS] >= 13) & (x[:, N_DIGITS] <= 19) & (kind == "card")
        w[of_kind & (labels == DECOY)] *= np.where(by_luhn, LUHN_ODDS, SHAPE_ODDS)[of_kind & (labels == DECOY)]
        loose = of_kind & (labels == REWRITTEN)
        if loose.any():
            w[loose] *= loose_share * w[of_kind & (labels == MATCH)].sum() / w[loose].sum()
    return w


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least scores of steps, ascending, and the weighted share of positives on each: monotone (pool adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    steps: list[list[float]] = []  # least score, positives, weight
    for s, hit, weight in zip(raw[order].tolist(), (y * w)[order].tolist(), w[order].tolist(), strict=True):
        if steps and steps[-1][0] == s:
            steps[-1][1] += hit
            steps[-1][2] += weight
        else:
            steps.append([s, hit, weight])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, hit_, weight_ = steps.pop()
            steps[-1][1] += hit_
            steps[-1][2] += weight_
    return np.array([x[0] for x in steps]), np.array([x[1] / x[2] if x[2] else 0.0 for x in steps])


@dataclass
class Trees:
    """Boosted trees of depth three: by tree, features and cuts of its seven nodes and values of its eight leaves."""

    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    threshold: float = np.inf

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for by, cut, leaf in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[np.arange(len(x)), by[at]] > cut[at])
            total += leaf[at - 7]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, own: np.ndarray | None = None, rounds: int = 60, rate: float = 0.2, bins: int = 32, precision: float = PRECISION) -> Trees:
    """Second-order boosting of the weighted log loss on three quarters of the rows; the rest calibrate the threshold.

    The trees are fitted with the weights ``own``, the calibration is that of
    ``w``.  The threshold is the least score whose calibrated probability
    reaches ``precision``.  Labels of one kind only: nothing is accepted.
    """
    trees = Trees()
    if len(np.unique(y)) < 2:
        return trees
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    rest, train = order[: len(x) // 4], order[len(x) // 4 :]
    w = np.ones(len(x)) if w is None else w
    own = w if own is None else own
    own = own / own.mean()
    share = np.clip(np.average(y[train], weights=own[train]), 1e-3, 1 - 1e-3)
    trees.start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[train, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[train, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(train), trees.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = own[train] * (p - y[train]), own[train] * np.maximum(p * (1 - p), 1e-6)
        by, cut, where = np.zeros(7, dtype=np.int64), np.full(7, np.inf), np.zeros(len(train), dtype=np.int64)
        for node in range(7):
            rows = np.nonzero(where == node)[0]
            best = 1e-3
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                g = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))
                h = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(c) + 1))
                n = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))
                gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain[(n[:-1] < LEAST_ROWS) | (n[-1] - n[:-1] < LEAST_ROWS)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, by[node], cut[node] = gain[k], j, c[k]
            where[rows] = 2 * node + 1 + (x[train][rows, by[node]] > cut[node])
        g, h = np.bincount(where - 7, grad, 8), np.bincount(where - 7, hess, 8)
        leaf = -rate * g / (h + 1)
        trees.nodes.append((by, cut, leaf))
        score += leaf[where - 7]
    least, probability = isotonic(trees.raw(x[rest]), y[rest], w[rest])
    good = np.nonzero(probability >= precision)[0]
    if len(good):
        trees.threshold = float(least[good[0]])
    return trees


def added_spans(text: str, base: list[Span], trees: Trees) -> list[Span]:
    """Accepted candidates clear of the base spans and of each other, best first; decoys never are."""
    if not np.isfinite(trees.threshold):
        return []
    proposed = [s for s in dict.fromkeys(candidates(text)) if not overlaps(s, base) and passes(s[0], text[s[1] : s[2]])]
    if not proposed:
        return []
    raw = trees.raw(np.array([features(text, s) for s in proposed], dtype="<f4").astype(np.float64))  # as precise as the examples were
    chosen: list[Span] = []
    for i in np.lexsort([[s[1] for s in proposed], -raw]):
        if raw[i] >= trees.threshold and not overlaps(proposed[i], chosen):
            chosen.append(proposed[i])
    return chosen


def _examples(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [e for t in batch.column(0) for e in examples(t.as_py() or "")]
    packed = [np.array(x, dtype="<f4").tobytes() for _, x in found]
    return pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array(packed, pa.binary())], ["label", "features"])


def fit_pii(docs: DataFrame, text_col: str = "text", max_examples: int = MAX_EXAMPLES) -> Trees:
    """Trees from the examples of all texts, of which at most ``max_examples`` of each label are fetched.

    Texts are read once; different examples are counted and written down.
    Null texts have none.  Empty table, or no examples: nothing is accepted.
    """
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(in_slices(_examples), "label int, features binary")
    counted = materialize(found.groupBy("label", "features").agg(F.count(F.lit(1)).alias("n")), "pii-examples")
    parts = [counted.where(F.col("label") == k).orderBy(F.xxhash64("features"), "features").limit(max_examples) for k in (DECOY, MATCH, REWRITTEN)]
    rows = reduce(DataFrame.unionByName, parts).toPandas()
    discard(counted)
    x = np.array([np.frombuffer(f, dtype="<f4") for f in rows["features"]], dtype=np.float64).reshape(-1, FEATURES)
    labels, n = rows["label"].to_numpy(), rows["n"].to_numpy()
    return fit_trees(x, (labels != DECOY).astype(float), weights_of(labels, x, n), weights_of(labels, x, n, 1.0))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the fixed patterns' matches, base_spans, spans (all) and n_spans of every row.

    Null text: empty.  Null ids and repeated rows: a row each.  Empty table:
    empty result.  Extra columns: ignored.  Very long texts are read whole.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = [base_spans(t.as_py() or "") for t in batch.column(1)]
        every = [b + added_spans(t.as_py() or "", b, trees) for b, t in zip(base, batch.column(1), strict=True)]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        texts = [pa.array([joined(s) for s in x], pa.string()) for x in (base, every)]
        total = pa.array([len(x) for x in every], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, *texts, total], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_spans"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return given.mapInArrow(in_slices(find), f"doc_id long, {counts}, base_spans string, spans string, n_spans long")


def masked(text: str | None, trees: Trees) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added_spans(text, base, trees), key=lambda s: (s[1], -s[2])):
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trees: Trees, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with masked texts (and their new lengths, if there is such a column).

    Null and empty texts stay as they are.  Repeated rows: masked alike.  Very
    long texts are read whole.  Empty table: empty result.  Extra columns stay.
    """

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = [masked(t.as_py(), trees) for t in batch.column(at)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(in_slices(mask), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
