"""Personal data: candidate spans judged by gradient-boosted trees.

Generators of high recall propose spans, which may overlap: addresses of mail, IP and
card numbers and phone numbers in their base formats, and looser forms of the same and
of other kinds (spelled-out mail addresses, phone numbers without a country code,
social-security and bank-account numbers, keys and passwords); a kind may have several.
Trees see a candidate's format (length, share of digits, letters and separators, sizes of
its groups of digits, variety of signs, check digits, the generator) and its context
(signs on both sides, what the words before it speak of) and give a probability. For each
kind a threshold is calibrated on examples the trees were not fitted on: the lowest score
from which on ``PRECISION`` of them are personal. Candidates from there on are taken, of
those of one kind that overlap the one with the highest score. Base spans always are, and
what lies inside one is not proposed again.

The trees are fitted here, on examples written out by ``examples`` from a seed; no
document is needed and no text leaves its row.

Base formats are taken leftmost and without overlap per kind, failing ones dropped
without another try. Offsets are code points, the end exclusive.

Defined cases: a null text is empty and has no spans; repeated rows are judged each by
itself; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.boosting import Booster
from .common import kept_columns, slices, text_strings

#: Base kinds, in the order in which spans of one start are listed.
BASE = ["email", "ip", "card", "phone"]
#: Kinds the method adds, listed after them.
ADDED = ["mail_words", "phone_local", "ssn", "iban", "secret"]
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
PRECISION = 0.95
SEED = 7
EXAMPLES = 12000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

#: Looser forms, each linear in the text. Lengths of a mail address' parts and of a bank
#: account are the formats' own.
_AT, _DOT = r"(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?)", r"(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\.|\s(?:dot|DOT)\s)"
_NAME, _LABEL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
_LOOSE = [
    ("mail_words", re.compile(rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}")),
    ("mail_words", re.compile(rf"{_NAME}\s(?:at|AT|@)\s{_LABEL}(?:\s(?:dot|DOT|\.)\s{_LABEL}){{1,8}}")),
    ("phone_local", re.compile(r"(?<![0-9+(.-])(?:1[-. ])?(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![0-9+(.-])\(?0[0-9]{1,4}\)?[-/ ][0-9](?:[0-9]|[ -](?=[0-9])){4,10}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![0-9A-Za-z+(.,-])[0-9]{2,4}(?:[-. ][0-9]{2,4}){2,4}(?![0-9])")),
    ("phone_local", re.compile(r"(?<![0-9A-Za-z+(.,-])[0-9]{7,12}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_+/=-]{16,}+")),
    ("secret", re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key)[\"']?\s{0,3}(?:[:=]|is)\s{0,3}[\"']?(?P<span>[^\s\"',;]{6,}+)")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")),
]
#: Signs without which a form can't occur: a cheap first look at a text.
_NEEDS = {
    "mail_words": re.compile(r"[\[({]\s?(?:at|AT|@)\s?[\])}]|\s(?:dot|DOT|\.)\s"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{16}|[:=]|is"),
    **dict.fromkeys(("phone_local", "ssn", "iban"), re.compile("[0-9][0-9 ./)-]{5}")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        at += 1
        if m:
            yield start, m.end()
            last = at = m.end()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base formats, unordered."""
    out = [(s, "email", e) for s, e in _emails(text)]
    if text.isascii() and not any(map(text.__contains__, "0123456789")):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _DIGITS.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def candidates(text: str) -> list[tuple[int, str, int]]:
    """Spans of the looser generators; they may overlap."""
    out = []
    needed = {kind for kind, need in _NEEDS.items() if need.search(text)}
    for kind, form in _LOOSE:
        if kind in needed:
            at = "span" if "span" in form.groupindex else 0
            out += [(m.start(at), kind, m.end(at)) for m in form.finditer(text) if _may(kind, m[at], at)]
    return list(dict.fromkeys(out))


def _may(kind: str, s: str, named: str | int) -> bool:
    """What no form can say: how many digits there are."""
    if kind == "secret" and not named:
        return any(map(s.__contains__, "0123456789")) or s.startswith("-----")
    return kind != "phone_local" or 7 <= len(_DIGITS.sub("", s)) <= 15


#: What words before a span may speak of.
_TOPICS = [
    ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer"),
    ("call", "phone", "tel", "mobile", "fax", "reach", "dial", "ring", "number is", "sms"),
    ("ssn", "social", "security", "tax"),
    ("iban", "account", "bank", "transfer", "konto"),
    ("mail", "contact", "write", "address", "send"),
    ("order", "isbn", "version", "invoice", "ticket", "item", "part", "serial", "build", "model", "page", "part no"),
    ("commit", "sha", "md5", "checksum", "digest", "hash", "etag", "revision", "uuid"),
    ("date", "born", "year", "since", "until", "between", "on ", "from"),
]
#: Last labels that many mail addresses have (fixed values).
_TLDS = frozenset("com org net edu gov info io co de fr es it nl uk eu ch at us ca au br in jp".split())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: tuple[int, str, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    n = len(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    groups = re.findall("[0-9]+", s) if n < 200 else []
    digits = "".join(groups)
    sizes = [*map(len, groups), 0, 0, 0, 0][:4]
    spoken = before.lower()
    runs = len(re.findall(r"[0-9]+|[A-Z]+|[a-z]+", s))
    return [
        float(ORDER[kind]), min(n, 200), len(digits) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n,
        sum(not c.isalnum() for c in s) / n, entropy, len(counts) / n, runs / n,
        float(all(c in "0123456789abcdef" for c in s)), float(s.startswith(("AKIA", "sk_", "ghp_", "eyJ", "-----"))),
        float(kind == "iban" and _iban_ok(s)), float(digits[:3] in ("000", "666") or digits[:1] == "9"),
        float(len(digits)), float(len(groups)), *map(float, sizes), float(digits[:2] in ("19", "20")), float(digits[:1] == "0"), float("(" in s),
        float(kind == "mail_words" and re.split("[^A-Za-z0-9]+", s)[-1].lower() in _TLDS), float("[" in s or "{" in s),
        float(before[-1:] in "=:\"'"), float(before[-2:-1] in "=:"), float(after[:1] in "\"'"), float(after[:1].isalnum()),
        *[float(any(w in spoken for w in topic)) for topic in _TOPICS],
    ]


class _Writer:
    """Writes forms from a seed: words, digits, letters, and whole candidates of each kind."""

    LETTERS, LOW, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def of(self, *forms: str) -> str:
        return self.rng.choice(forms)

    def signs(self, alphabet: str, least: int, most: int | None = None) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(self.rng.randint(least, most or least)))

    def word(self) -> str:
        return self.signs(self.LOW, 2, 9)

    def digits(self, least: int, most: int | None = None) -> str:
        return self.signs(self.DIGITS, least, most)

    def number(self, low: int, high: int) -> str:
        return str(self.rng.randint(low, high))

    def mail_words(self, personal: bool) -> str:
        at, dot = self.rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "."), (" @ ", " . "), ("[at]", ".")])
        name = self.of(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.number(1, 99)}", f"{self.word()}_{self.word()}")
        last = self.rng.choice(sorted(_TLDS)) if personal else self.signs(self.LOW, 4, 9)
        return f"{name}{at}{self.word()}{dot}{last}"

    def phone_local(self, personal: bool) -> str:
        a, b, c = self.number(200, 989), self.number(200, 999), self.digits(4)
        if personal:
            return self.of(
                f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{self.digits(2, 3)} {self.digits(6, 8)}",
                f"0{self.digits(3)}-{self.digits(7)}", f"0{self.digits(3)}/{self.digits(6, 7)}", "0" + " ".join([self.number(1, 9), *[self.digits(2) for _ in range(4)]]),
                f"0{self.digits(2)} {self.digits(4)} {self.digits(4)}", f"{a}{b}{c}",
            )
        year, month, day = self.number(1950, 2035), f"{self.rng.randint(1, 12):02d}", f"{self.rng.randint(1, 28):02d}"
        return self.of(
            f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}-{day}-{year}", f"{self.digits(2, 3)} {self.digits(3)} {self.digits(3)}", f"{self.digits(2, 3)}.{self.digits(3)}.{self.digits(3)}",
            f"{year}-{self.number(1950, 2035)}-{self.digits(2)}", self.digits(7, 12), f"978-{self.digits(2)}-{self.digits(4)}-{self.digits(4)}", f"{self.digits(2)}-{self.digits(2)}-{self.digits(2)}-{self.digits(2)}",
            f"0{self.digits(2)} {self.digits(3)} {self.digits(3)}", f"{self.digits(4)} {self.digits(4)} {self.digits(4)}", f"{a}-{b}-{c}",
        )

    def ssn(self, personal: bool) -> str:
        area = self.rng.randint(1, 665) if personal else self.rng.choice([0, 666, self.rng.randint(900, 999), self.rng.randint(1, 665)])
        return f"{area:03d}{self.of('-', '-', ' ')}".replace(" ", "-") + f"{self.rng.randint(1, 99):02d}-{self.rng.randint(1, 9999):04d}"

    def iban(self, personal: bool) -> str:
        body, country = self.digits(12, 22), self.signs(self.LETTERS, 2)
        value = int("".join(str(int(c, 36)) for c in body + country + "00"))
        check = 98 - value % 97 if personal else (98 - value % 97 + self.rng.randint(1, 90)) % 97
        whole = f"{country}{check:02d}{body}"
        return self.of(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))

    def secret(self, personal: bool) -> str:
        mixed = self.LETTERS + self.LOW + self.DIGITS
        if personal:
            return self.of(
                "AKIA" + self.signs(self.LETTERS + "234567", 16), self.signs("0123456789abcdef", 16) * self.rng.randint(1, 4), self.signs("0123456789abcdef", 32, 64), self.signs(mixed, 20, 44),
                self.signs(mixed + "+/", 60, 160), "sk_live_" + self.signs(mixed, 24), "ghp_" + self.signs(mixed, 36), self.word() + self.number(1, 9999) + self.of("!", "#", ""),
                self.signs(mixed + "!#%&*", 8, 16),
            )
        return self.of(
            f"{self.word()}-{self.word()}-{self.word()}-{self.number(1, 2030)}", f"{self.word()}_{self.word()}_{self.word()}{self.number(1, 99)}", self.digits(16, 24), f"20{self.digits(2)}-0{self.number(1, 9)}-1{self.number(0, 9)}-{self.word()}{self.word()}",
            self.signs("0123456789abcdef", 40), self.signs("0123456789abcdef", 64), f"{self.word()}/{self.word()}/{self.word()}/{self.number(1, 99)}/{self.word()}", self.word() + self.word(), "-".join([self.signs("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)]),
        )


#: What stands before personal spans of a kind, and before others.
_CUES = {
    "mail_words": ["mail me: ", "contact ", "write to ", "email ", "send it to "], "phone_local": ["call ", "tel: ", "phone ", "reach me at ", "fax ", "my number is "],
    "ssn": ["SSN ", "social security ", "SSN: "], "iban": ["IBAN ", "bank account ", "transfer to "],
    "secret": ["password=", "token = \"", "api key: ", "secret: ", "pwd: ", "access_key=\""],
}
_OTHER = ["order ", "version ", "ticket ", "item ", "serial ", "page ", "part ", "invoice ", "on ", "between ", "since "]
_DIGESTS = ["commit ", "sha256 ", "checksum ", "md5 ", "revision ", "id "]


def examples(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, tuple[int, str, int], int]]:
    """(text, span, label): candidates in sentences, personal or not, from a seed.

    Some forms are personal with one lead and not with another: bare digits need a cue, a
    digest is no secret, a part number may look like a phone number.
    """
    w = _Writer(seed)
    out = []
    while len(out) < count:
        kind, label = w.rng.choice(ADDED), w.rng.randint(0, 1)
        said = getattr(w, kind)(bool(label))
        if label:
            bare = kind == "phone_local" and said.isdigit() or kind == "secret" and (len(said) < 20 or set(said) <= set("0123456789abcdef"))
            lead = w.rng.choice(_CUES[kind] if bare else _CUES[kind] + ["", "", "see ", "and "])
        else:
            plain = kind in ("mail_words", "iban") or kind == "ssn" and said[:3] in ("000", "666") or kind == "ssn" and said[0] == "9"
            hard = kind == "phone_local" and re.fullmatch("[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}", said) or kind == "ssn" and not plain
            word = kind == "secret" and said.isalpha()
            lead = w.rng.choice(["token: ", "password is "] if word else _DIGESTS if kind == "secret" else _OTHER if hard else _OTHER + ["", "see ", "and "])
        head = f"{w.word()} {w.word()} {lead}"
        tail = '"' if lead.endswith('"') else w.of("", ".", " " + w.word(), ", " + w.word())
        out.append((head + said + tail, (len(head), kind, len(head) + len(said)), label))
    return out


@functools.lru_cache(maxsize=1)
def judge() -> tuple[Booster, dict[str, float]]:
    """The trees and, per added kind, the calibrated threshold."""
    rows = examples()
    x = np.array([features(t, s) for t, s, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    fitted = np.arange(len(rows)) % 3 != 0
    trees = Booster("logistic", rounds=60, rate=0.15, depth=3, min_leaf=20).fit(x[fitted], y[fitted])
    score = trees.predict(x[~fitted])
    kinds = np.array([s[1] for _, s, _ in rows])[~fitted]
    limits = {}
    for kind in ADDED:
        own = kinds == kind
        order = np.argsort(-score[own], kind="stable")
        precision = np.cumsum(y[~fitted][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(precision >= PRECISION)
        limits[kind] = float(score[own][order][good[-1]]) if len(good) else 2.0
    return trees, limits


def find(texts: list[str], model: tuple[Booster, dict[str, float]]) -> list[tuple[list, list]]:
    """Per text its base spans and all its spans, each in listing order."""
    trees, limits = model
    base = [base_spans(t) for t in texts]
    proposed = [
        (i, s) for i, t in enumerate(texts) for s in candidates(t)
        if not any(b[0] <= s[0] and s[2] <= b[2] for b in base[i])
    ]
    added: dict[int, list] = {}
    if proposed:
        scores = trees.predict(np.array([features(texts[i], s) for i, s in proposed]))
        for p, i, s in sorted(((p, i, s) for (i, s), p in zip(proposed, scores.tolist()) if p >= limits[s[1]]), key=lambda x: (x[1], -x[0], x[2])):
            taken = added.setdefault(i, [])
            if not any(s[1] == t[1] and s[0] < t[2] and t[0] < s[2] for t in taken):
                taken.append(s)
    rank = lambda s: (s[0], ORDER[s[1]], s[2])
    return [(sorted(b, key=rank), sorted(b + added.get(i, []), key=rank)) for i, b in enumerate(base)]


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(judge())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = find(text_strings(part), shared.value)
                counts = [Counter(k for _, k, _ in b) for b, _ in found]
                sums = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in BASE],
                     pa.array(sums, pa.string()), pa.array([listed(a) for _, a in found], pa.string()),
                     pa.array([len(a) for _, a in found], pa.int64())],
                    names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"],
                )

    return kept_columns(docs, ["doc_id", "text"]).mapInArrow(scan, RESULT)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with personal data replaced by the names of its kinds."""
    shared = docs.sparkSession.sparkContext.broadcast(judge())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = part.column("text").to_pylist()
                found = find([t or "" for t in raw], shared.value)
                texts = [t if t is None else redacted(t, a) for t, (_, a) in zip(raw, found)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return kept_columns(docs, ["doc_id", "text"]).mapInArrow(scan, "doc_id long, text string")
