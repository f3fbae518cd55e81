"""Personal data: high-recall generators propose spans, boosted trees with calibrated thresholds select the added ones.

Base spans (email, ip, card, phone) are fixed patterns and always stay. The generators propose further spans that may
overlap: written-out addresses (``name at host dot tld``), IPv6 addresses whole or shortened, card numbers with other
separators or in 4-6-5 groups, phone numbers without a plus sign, keys, tokens and passwords, bank accounts (IBAN) and
national numbers. Each candidate gets format features (digits, groups, separators, checksums, entropy) and context features
(cue words before and after, neighbours). Gradient-boosted trees are trained here on generated sentences, with hard
negatives of every kind. Their probabilities are calibrated on a held-out share; a kind's threshold is the least one at
which candidates of fresh sentences are right in ``PRECISION`` of the cases. Of overlapping candidates above their
thresholds the likeliest is added, unless it overlaps a base span.

Not proposed: names, street addresses, dates of birth, numbers in words.

Cases: null and empty texts have no spans; texts are read whole, every pattern runs in linear time; equal texts give
equal spans; rows are never joined or dropped, so repeated rows and null ids stay as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import map_texts, small_batches

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "id")
#: Generated training sentences per class and kind: the bound of the training set. As many again choose the thresholds.
TRAIN_ROWS = 400
#: The share of right ones that a kind's threshold must reach, and the least threshold.
PRECISION, LEAST_THRESHOLD = 0.98, 0.5
#: Code points on either side of a candidate that its context features read.
CONTEXT = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: the one before always ends at the end of its run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in twice)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, sorted."""
    if not text:
        return []
    out = []
    if "@" in text:
        at = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > at and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                at = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Generators: bounded repeats only, so each is linear in the text.
_AT = r"(?:\s?[(\[{<](?:at|arroba)[)\]}>]\s?| (?:at|arroba) )"
_DOT = r"(?:\s?[(\[{<](?:dot|punto|punkt|point)[)\]}>]\s?| (?:dot|punto|punkt|point) |\.)"
_H = r"[0-9A-Fa-f]{1,4}"
#: A text that has none of a generator's signs (in lower case), or no run of digits, is not searched.
_DIGITS = re.compile("[0-9]{2}")
GENERATORS = (
    (0, (" at ", "at)", "at]", "at}", "at>", "arroba"), re.compile(rf"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,3}}{_DOT}[A-Za-z]{{2,24}}(?!\w)", re.I)),
    (1, ("::", ":"), re.compile(rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}})(?![\w:])")),
    (2, _DIGITS, re.compile(r"(?<![\w.+])[0-9]{4}([./_ -]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![\w.])")),
    (2, _DIGITS, re.compile(r"(?<![\w.+])3[47][0-9]{2}([./_ -]{1,2})[0-9]{6}\1[0-9]{5}(?![\w.])")),
    (3, _DIGITS, re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    (3, _DIGITS, re.compile(r"(?<![\w.+-])00[1-9][0-9]{0,2}[ .-][0-9][0-9 .-]{6,14}[0-9](?![\w-])")),
    (4, ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "bearer", "credential"), re.compile(r"""(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|key|auth|bearer|credential)s?["']?(?:\s{0,2}[:=]\s{0,2}|\s)["']?([^\s"'<>,;]{6,256})""")),
    (4, ("akia", "gh", "sk-", "xox", "aiza", "eyj"), re.compile(r"(?<![\w/+-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9_-]{16,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{30,60}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,1000})(?![\w-])")),
    (4, _DIGITS, re.compile(r"(?<![\w/+-])[0-9A-Za-z_-]{24,256}(?![\w/+-])")),
    (5, _DIGITS, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)")),
    (6, _DIGITS, re.compile(r"(?<![\w.-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![\w-])")),
)
#: Cue words before or after a span, by kind (fixed values).
CUES = (
    ("mail", "e-mail", "email", "contact", "write", "reach", "correo", "courriel"),
    ("ip", "address", "host", "server", "login", "from"),
    ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "carte", "karte"),
    ("phone", "call", "tel", "mobile", "fax", "telefon", "number", "cell", "téléphone", "teléfono"),
    ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential", "login"),
    ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    ("ssn", "social", "security", "national", "insurance", "tax", "identity"),
)
#: Words before a long code that make it no secret (fixed values).
PUBLIC = ("commit", "sha", "md5", "checksum", "digest", "uuid", "revision", "isbn", "order", "version", "id ")
FEATURES = (
    "kind", "length", "digits", "groups", "letters", "separators", "brackets", "luhn", "cue before", "cue after", "cue distance", "other cue", "digits near", "at or dot written", "line start", "colon before",
    "mod 97", "entropy", "turns", "capitals", "public word before", "quoted", "last part",
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the generators propose; they may overlap each other and base spans. A group is the value."""
    low, numbered = text.lower(), _DIGITS.search(text) is not None
    out = {}
    for kind, signs, pattern in GENERATORS:
        if not (numbered if signs is _DIGITS else any(s in low for s in signs)):
            continue
        valued = kind == 4 and pattern.groups
        for m in pattern.finditer(text):
            start, end = m.span(1) if valued else m.span()
            while valued and end - start > 6 and text[end - 1] in ".!?)]}":
                end -= 1
            out[start, kind, end] = None
    return list(out)


def _mod97(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = re.sub("[^0-9]", "", span)
    near = max(before.rfind(c) for c in CUES[kind])
    others = any(c in before for k, words in enumerate(CUES) if k != kind for c in words)
    shares = np.array(list(Counter(span).values())) / len(span)
    classes = [0 if "0" <= c <= "9" else 1 if c.isalpha() else 2 for c in span]
    return [
        kind, len(span), len(digits), len(re.findall(r"[0-9]+", span)), sum(c.isalpha() for c in span), sum(c in " .-/_" for c in span), sum(c in "()[]{}<>" for c in span),
        bool(digits) and luhn(digits), near >= 0, any(c in after for c in CUES[kind]), len(before) - near if near >= 0 else 99, others,
        sum("0" <= c <= "9" for c in before + after), bool(re.search(r"\b(?:at|dot|arroba|punto|punkt|point)\b", span, re.I)), start == 0 or text[start - 1] == "\n", before.rstrip("\"' ").endswith((":", "=")),
        kind == 5 and _mod97(span), float(-(shares * np.log2(shares)).sum()), sum(x != y for x, y in zip(classes, classes[1:], strict=False)), sum("A" <= c <= "Z" for c in span),
        any(w in before[-20:] for w in PUBLIC), start > 0 and text[start - 1] in "\"'", len(re.split(r"[^A-Za-z]+", span)[-1]),
    ]


_FILLER = "the of report section table value order model total page line item house river music theory paper garden version series figure chapter market required optional count below above".split()
_ENDINGS = "com org net edu gov info io de fr es it nl ch uk eu co us me dev app biz at be pl se".split()
_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class _Sentences:
    """Generated sentences with a value of a kind, or with what only looks like one."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def words(self, n):
        return " ".join(self.pick(_FILLER) for _ in range(n))

    def chars(self, alphabet, n):
        return "".join(self.pick(alphabet) for _ in range(n))

    def digits(self, n):
        return self.chars("0123456789", n)

    def card(self, n, good):
        d = self.digits(n)
        return next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c) == good)

    def email(self, label):
        signs = [("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "{dot}"), ("<at>", "<dot>"), (" (arroba) ", " (punto) "), ("(at)", "."), (" [at] ", ".")]
        if label:
            a, b = self.pick(signs)
            local = self.pick([self.pick(_FILLER), f"{self.pick(_FILLER)}.{self.pick(_FILLER)}", f"{self.pick(_FILLER)}{self.digits(2)}", f"{self.pick(_FILLER)}_{self.pick(_FILLER)}.{self.pick(_FILLER)}{self.digits(4)}"])
            host = self.pick([self.pick(_FILLER), f"{self.pick(_FILLER)}{b}{self.pick(_FILLER)}"])
            return f"{local}{a}{host}{b}{self.pick([*_ENDINGS, self.chars('abcdefghijklmnopqrstuvwxyz', 2)])}"
        return f"{self.pick(_FILLER)} at {self.pick(_FILLER)}.{self.pick([*_FILLER, *_ENDINGS])}"

    def ip(self, label):
        if label:
            h = [f"{int(v):x}" for v in self.rng.integers(0, 65536, 8)]
            k = int(self.rng.integers(1, 4))
            return self.pick([":".join(h), "2001:" + ":".join(h[:k]) + "::" + ":".join(h[-k:]), "fe80::" + ":".join(h[: k + 1]), "::1"])
        return self.pick([":".join(self.digits(2) for _ in range(8)), f"{self.chars('abcdef', 2)}::{self.chars('abcdef', 3)}", "::", f"{self.digits(2)}::"])

    def card_number(self, label):
        sep = self.pick([".", "/", "_", "--"])
        if self.rng.random() < 0.3:
            d = "37" + self.digits(13)
            d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c) == bool(label))
            return sep.join((d[:4], d[4:10], d[10:]))
        d = self.card(16, bool(label))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self, label):
        d, sep = self.digits(10), self.pick([" ", ".", "-"])
        return self.pick([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}{sep}{d[3:6]}{sep}{d[6:]}", f"{d[:3]}{sep}{d[3:6]}{sep}{d[6:]}", f"00{1 + int(self.rng.integers(0, 9))} {d[:3]} {d[3:6]} {d[6:]}"])

    def secret(self, label):
        if label:
            n = int(self.rng.integers(10, 40))
            value = self.pick([self.chars(_HEX, 40), self.chars(_HEX, 32), self.chars(_HEX, 64).upper(), self.chars(_ALNUM, n), self.chars(_ALNUM + "-_", n + 10), "AKIA" + self.chars(_ALNUM[:26] + "0123456789", 16), "ghp_" + self.chars(_ALNUM, 36), "sk-" + self.chars(_ALNUM, 40), f"{self.pick(_FILLER)}{self.digits(3)}!{self.chars(_ALNUM, 3)}"])
            return value
        return self.pick([self.pick(_FILLER), f"{self.pick(_FILLER)}-{self.pick(_FILLER)}", f"{self.pick(_FILLER)}_{self.pick(_FILLER)}", self.chars(_HEX, 40), f"{self.chars(_HEX, 8)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 4)}-{self.chars(_HEX, 12)}", "-".join(self.pick(_FILLER) for _ in range(6)) + "-2"])

    def iban(self, label):
        country, body = self.pick(["DE", "FR", "ES", "NL", "GB", "IT", "CH"]), self.digits(int(self.rng.integers(14, 22)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        if not label:
            check = (check + int(self.rng.integers(1, 90))) % 97 + 1
        s = f"{country}{check:02d}{body}"
        return self.pick([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))]) if label == _mod97(s) else f"{country}00{body}"

    def national(self, label):
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"

    def one(self, kind: int, label: int) -> tuple[str, int, int]:
        """(text, start, end) of a sentence around a value; in four of ten, of one that looks like a value, cues stand too."""
        span = (self.email, self.ip, self.card_number, self.phone, self.secret, self.iban, self.national)[kind](label)
        lead, tail = self.words(int(self.rng.integers(2, 7))), self.words(int(self.rng.integers(1, 6)))
        if self.rng.random() < 0.3:
            lead = f"{self.pick(_FILLER)} {self.digits(int(self.rng.integers(2, 17)))} {self.pick(_FILLER)}{self.pick(['', '.', ' |', ' ***'])}"
        if self.rng.random() < 0.3:
            tail = f"{self.pick(_FILLER)} {self.digits(int(self.rng.integers(2, 17)))}"
        cue = self.rng.random() < ((0.9 if kind in (3, 6) else 0.5) if label else 0.0 if kind in (3, 6) else 0.4)
        if kind == 4:
            # A code is a secret where it is assigned or has a key's form; a plain word never is.
            keyed = span[:4] in ("AKIA", "ghp_") or span[:3] == "sk-"
            code = len(span) >= 24 and "-" not in span
            word = self.pick(["token", "secret", "password", "api_key", "API key", "auth", "Token", "access key", "pwd"])
            sign, quote = self.pick([" = ", ": ", "=", ":"]), self.pick(['"', "'", ""])
            if (label and (not keyed or cue)) or (not label and not code and "-" not in span[8:9]):
                lead, close = f"{lead} {word}{sign}{quote}", quote
            else:
                lead, close = (f"{lead} " if label else f"{lead} {self.pick(['commit', 'sha', 'md5', 'uuid', 'checksum', 'revision'])} "), ""
            return f"{lead}{span}{close} {tail}", len(lead), len(lead) + len(span)
        if cue:
            lead += f" {self.pick(CUES[kind])}{self.pick([':', '', ' is'])}"
        elif not label:
            lead += " " + " ".join(self.digits(int(self.rng.integers(1, 6))) for _ in range(3))
        return f"{lead} {span} {tail}", len(lead) + 1, len(lead) + 1 + len(span)


def _examples(seed: int, rows: int = TRAIN_ROWS):
    """(text, start, kind, end, label) of the candidates that the generators find in generated sentences."""
    make, out = _Sentences(seed), []
    for label in (1, 0):
        for kind in range(len(KINDS)):
            for _ in range(rows):
                text, start, end = make.one(kind, label)
                out += [(text, *c, int(label and c[0] < end and start < c[2])) for c in candidates(text) if c[1] == kind]
    return out


@lru_cache(1)
def model() -> tuple[gbt.FlatForest, dict[str, float]]:
    """The trees and the thresholds by kind."""
    rows = _examples(11)
    up = {FEATURES.index("cue before"): 1, FEATURES.index("luhn"): 1, FEATURES.index("mod 97"): 1, FEATURES.index("digits near"): -1, FEATURES.index("public word before"): -1}
    forest = gbt.train([features(*r[:4]) for r in rows], [r[-1] for r in rows], rounds=60, depth=4, monotone=up)
    fresh = _examples(12)
    p, y = forest.probability(np.array([features(*r[:4]) for r in fresh], float)), np.array([r[-1] for r in fresh])
    kinds = np.array([r[2] for r in fresh])
    return forest, {name: _threshold(p[kinds == k], y[kinds == k]) for k, name in enumerate(KINDS)}


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability from which candidates are right in ``PRECISION`` of the cases; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero((right >= PRECISION) & (p[order] >= LEAST_THRESHOLD))
    return float(p[order][fine[-1]]) if len(fine) else 2.0


def select(text: str | None, base: list, forest: gbt.FlatForest, thresholds: dict) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that the trees accept, sorted; of overlapping candidates the likeliest stays."""
    if not text:
        return base
    starts = [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []

    def free(s, e):
        i = bisect.bisect_left(starts, e)
        return i == 0 or reach[i - 1] <= s

    found = [c for c in candidates(text) if free(c[0], c[2])]
    if not found:
        return base
    p = np.concatenate([forest.probability(np.array([features(text, *c) for c in found[i : i + 5000]], float)) for i in range(0, len(found), 5000)])
    out, added = list(base), []
    for q, (s, k, e) in sorted(zip(p.tolist(), found, strict=True), key=lambda c: (-c[0], c[1])):
        if q < thresholds[KINDS[k]]:
            continue
        # Added spans are disjoint: only the neighbours can overlap.
        i = bisect.bisect_left(added, (s, e))
        if (i == 0 or added[i - 1][1] <= s) and (i == len(added) or e <= added[i][0]):
            added.insert(i, (s, e))
            out.append((s, k, e))
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", thresholds: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: id, counts of base spans, base_sha256, spans, n_added, n_spans. One pass, no shuffle."""
    forest, own = model()
    own = own | (thresholds or {})

    def worker():
        def process(texts):
            for text in texts:
                base = base_spans(text)
                every = select(text, base, forest, own)
                counts = [0, 0, 0, 0]
                for _, k, _ in base:
                    counts[k] += 1
                yield *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base), len(every)

        return process

    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return map_texts(docs, id_col, text_col, fields, worker)


def redact(text: str | None, spans) -> str | None:
    """The text with each maximal run of overlapping spans replaced by its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        s, k, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its texts redacted, other columns kept; ``count_col``, if there, follows the new length."""
    forest, thresholds = model()
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redact(t, select(t, base_spans(t), forest, thresholds)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    if count_col and count_col in docs.columns:
        new = F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.length(text_col)).cast(docs.schema[count_col].dataType)
        out = out.withColumn(count_col, new).select(*docs.columns)
    return out
