"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping candidate spans. Gradient-boosted trees score
each candidate on features of its format and of its context. On examples that the trees did
not see, a calibration turns scores into probabilities, and each kind gets the lowest
threshold whose candidates are right to a stated precision. The base kinds (email, ip, card,
phone) follow fixed patterns and always stay; the trees decide on the other kinds (secret,
ssn, iban, account, local phone, obfuscated email).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_steps

# The base patterns. A match of IP can only begin where a run of digits does, and takes whole runs; said so, the search is linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
BASE_KINDS = ("email", "ip", "card", "phone")

#: Candidate generators of the kinds that the trees decide on.
GENERATORS = {
    "secret": re.compile(r"[=:][\x20\"']*([A-Za-z0-9_/+-]{16,})"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}[ -][0-9]{2}[ -][0-9]{4})(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "account": re.compile(r"(?<![0-9A-Za-z.+-])([0-9]{8,20})(?![0-9A-Za-z-]|\.[0-9])"),
    "local_phone": re.compile(r"(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9-])"),
    "hidden_email": re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9.-]+(?:\x20?(?:\[dot\]|\(dot\))\x20?[A-Za-z]+)*)"),
}
KINDS = (*BASE_KINDS, *GENERATORS)
#: Share of a kind's taken candidates that are to be right, on examples that the trees did not see.
PRECISION = 0.97
#: Code points of context on each side.
CONTEXT = 40

# Words that speak for a kind in the context before a candidate.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "key", "auth", "credential"),
    "ssn": ("ssn", "social security", "social"),
    "iban": ("iban", "bank", "transfer", "account"),
    "account": ("account", "acct", "konto", "compte", "cuenta", "customer number", "passport"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "hidden_email": ("mail", "contact", "write", "reach"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost and non-overlapping per kind, by start, then kind as listed."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        domain = EMAIL_DOMAIN.match(text, at)
        if domain:
            lo = at
            while lo > done and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
                lo -= 1
            if lo < at:
                out.append(("email", lo, domain.end()))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", *m.span()))
    order = {k: i for i, k in enumerate(BASE_KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans that the generators propose; they may overlap."""
    out = []
    for kind, pattern in GENERATORS.items():
        if kind == "secret" and "=" not in text and ":" not in text or kind == "hidden_email" and "(at)" not in text and "[at]" not in text:
            continue
        out += [(kind, *m.span(1)) for m in pattern.finditer(text)]
    return out


def _entropy(s: str) -> float:
    p = np.array([s.count(c) for c in set(s)]) / len(s)
    return float(-(p * np.log2(p)).sum())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    body, left, right = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    bare = body.replace(" ", "").replace("-", "") or body
    digits = sum(map(str.isdigit, bare))
    iban = False
    if kind == "iban":
        turned = bare[4:] + bare[:4]
        iban = int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    return [
        *(float(kind == k) for k in GENERATORS),
        float(len(bare)),
        digits / len(bare),
        sum(map(str.isupper, bare)) / len(bare),
        _entropy(bare),
        float(len(set(bare))),
        float(iban),
        float(digits == len(bare) and luhn(bare)),
        float(any(c in left for c in CUES[kind])),
        float(any(c in right for c in CUES[kind])),
        float(left[-1:] in "\"'" and left != ""),
        float("=" in left[-4:]),
        float(":" in left[-4:]),
        float("-" in body or " " in body),
        float(bare[:1] == "0"),
        float(bool(re.search(r"[0-9]\s*$", left)) or bool(re.match(r"\s*[0-9]", right))),
    ]


@functools.cache
def labelled() -> list[tuple[str, str, int, int, int]]:
    """The labelled table: (text, kind, start, end, label), made by rule from values and contexts."""
    rng = np.random.default_rng(11)

    def pick(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    digits, hexes, letters = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"

    def iban(spaced: bool) -> str:
        """A country, two check digits by which the number is 1 modulo 97, and 14 to 20 digits."""
        land, body = ("DE", "GB", "FR", "ES", "IT", "NL")[rng.integers(0, 6)], pick(digits, int(rng.integers(14, 21)))
        rest = int("".join(str(int(c, 36)) for c in body + land) + "00") % 97
        whole = f"{land}{98 - rest:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if spaced else whole

    def long() -> int:
        return int(rng.integers(18, 45))

    good = {
        "secret": [lambda: ('token = "', pick(hexes, 40)), lambda: ("password: ", pick(letters + digits, long())), lambda: ("api_key=", pick(letters.upper() + digits, long())), lambda: ("secret = '", pick(letters + digits + "_", long()))],
        "ssn": [lambda: ("ssn ", f"{pick('123456', 3)}-{pick(digits, 2)}-{pick(digits, 4)}"), lambda: ("social security number ", f"{pick('123456', 3)} {pick(digits, 2)} {pick(digits, 4)}")],
        "iban": [lambda: ("iban ", iban(True)), lambda: ("transfer to ", iban(False)), lambda: ("bank ", iban(False)), lambda: ("to ", iban(True))],
        "account": [lambda: ("account ", pick(digits, 10)), lambda: ("acct no ", pick(digits, 12)), lambda: ("konto ", pick(digits, 9)), lambda: ("passport ", pick(digits, 9))],
        "local_phone": [lambda: ("call ", f"({pick('23456789', 3)}) {pick(digits, 3)}-{pick(digits, 4)}"), lambda: ("tel ", f"{pick('23456789', 3)}-{pick(digits, 3)}-{pick(digits, 4)}"), lambda: ("and ", f"({pick('23456789', 3)}) 555-{pick(digits, 4)}")],
        "hidden_email": [lambda: ("mail ", f"{pick(letters, 6)} (at) {pick(letters, 7)} (dot) com"), lambda: ("write to ", f"{pick(letters, 5)}[at]{pick(letters, 6)}[dot]org")],
    }
    bad = {
        "secret": [lambda: ("see: ", "internationalization"), lambda: ("x = ", pick(letters, 1) * long()), lambda: ("note:", pick(letters, long())), lambda: ("ratio: ", pick("-_=+/", 1) * long()), lambda: ("url: ", "".join("/" + pick(letters, 6) for _ in range(long() // 6)))],
        "ssn": [lambda: ("part no ", f"{pick(digits, 3)} {pick(digits, 2)} {pick(digits, 4)}"), lambda: ("range ", f"000-{pick(digits, 2)}-{pick(digits, 4)}")],
        "iban": [lambda: ("model ", "AB12 CDEF 3456"), lambda: ("code ", "ZX99ABCD12345678"), lambda: ("serial ", "QQ11 2222 3333 4444")],
        "account": [lambda: ("of ", pick(digits, 16)), lambda: ("and the ", pick(digits, 8)), lambda: ("id ", pick(digits, 13)), lambda: ("in ", pick(digits, 10))],
        "local_phone": [lambda: ("sum ", f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 4)}"), lambda: ("isbn ", f"{pick('01', 3)} {pick(digits, 3)} {pick(digits, 4)}"), lambda: ("9 ", f"{pick('01', 3)} {pick(digits, 3)} {pick(digits, 4)}")],
        "hidden_email": [lambda: ("was ", "sold(at)auction"), lambda: ("met ", "us (at) noon")],
    }
    rows = []
    for label, table in ((1, good), (0, bad)):
        for kind, makers in table.items():
            for i in range(160):
                before, body = makers[i % len(makers)]()
                if i % 5 == 4 and kind != "secret":  # a fifth stands in a context that says nothing
                    before = pick(letters, 4) + " "
                before = pick(letters, 5) + " " + before
                rows.append((f"{before}{body} {pick(letters, 6)}.", kind, len(before), len(before) + len(body), label))
    return rows


class Boosted:
    """Gradient-boosted regression trees of depth 3 for the logistic loss, with a calibrated output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3) -> None:
        held = np.arange(len(y)) % 4 == 3
        self.trees: list = []
        self.rate, self.start = rate, 0.0
        score = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], depth)
            self.trees.append(tree)
            score += rate * self._run(tree, x)
        # Platt scaling on the held-out quarter.
        self.a, self.b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.a * score[held] + self.b)))
            g = p - y[held]
            self.a -= 0.05 * (float(np.mean(g * score[held])) + 0.05 * (self.a - 1))
            self.b -= 0.05 * float(np.mean(g))
        self.limits: dict[str, float] = {}

    def choose_limits(self, kinds: list[str], x: np.ndarray, y: np.ndarray, precision: float) -> None:
        """For each kind the lowest threshold from which its held-out candidates are right to the precision; 1 if there is none."""
        held = np.arange(len(y)) % 4 == 3
        p, names = self.probability(x), np.array(kinds)
        for kind in GENERATORS:
            mine = held & (names == kind)
            order = np.argsort(-p[mine], kind="stable")
            right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
            last = np.append(np.diff(p[mine][order]) < 0, True)  # a threshold takes all candidates of its probability
            good = np.flatnonzero((right >= precision) & last)
            ranked = np.append(p[mine][order], 0.0)
            self.limits[kind] = float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2 if len(good) else 1.0  # midway to the next candidate

    def _grow(self, x, g, h, depth):
        value = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 6:
            return value
        best = (1e-6, None)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1) - base
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, float(v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return value
        f, t = best[1]
        left = x[:, f] <= t
        return (f, t, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _run(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, low, high = tree
        out, left = np.empty(len(x)), x[:, f] <= t
        out[left], out[~left] = self._run(low, x[left]), self._run(high, x[~left])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = self.rate * sum(self._run(t, x) for t in self.trees)
        return 1 / (1 + np.exp(-(self.a * score + self.b)))


@functools.cache
def model() -> Boosted:
    """Trained once, on the small labelled table only."""
    rows = labelled()
    order = np.random.default_rng(3).permutation(len(rows))
    x, y = np.array([features(*rows[i][:4]) for i in order]), np.array([float(rows[i][4]) for i in order])
    out = Boosted(x, y)
    out.choose_limits([rows[i][1] for i in order], x, y, PRECISION)
    return out


class Taken:
    """Disjoint spans by start; add takes one that overlaps none."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> bool:
        if not self.free(a, b):
            return False
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def covered(spans: list[tuple[str, int, int]]) -> Taken:
    """The stretches that spans, sorted by start, cover."""
    out = Taken()
    for _, a, b in spans:
        if out.ends and a < out.ends[-1]:
            out.ends[-1] = max(out.ends[-1], b)
        else:
            out.starts.append(a)
            out.ends.append(b)
    return out


def detect(texts: list[str], limits: dict[str, float] | None = None, trees: Boosted | None = None) -> list[tuple[list, list]]:
    """Base spans and all spans, (kind, start, end) each, of every text.

    A candidate counts only if it overlaps no base span; of overlapping candidates the
    most probable stays, then the first. limits: thresholds of kinds other than the
    calibrated ones.
    """
    trees = trees or model()
    limits = trees.limits | (limits or {})
    base, open_, rows = [], [], []
    for i, text in enumerate(texts):
        fixed = base_spans(text)
        base.append(fixed)
        blocked = covered(fixed)
        for kind, a, b in candidates(text):
            if blocked.free(a, b):
                open_.append((i, kind, a, b))
                rows.append(features(text, kind, a, b))
    every = [list(x) for x in base]
    if rows:
        p = trees.probability(np.array(rows))
        taken: dict[int, Taken] = {}
        more: dict[int, list] = {}
        for j in sorted(range(len(rows)), key=lambda j: (open_[j][0], -round(float(p[j]), 9), open_[j][2], KINDS.index(open_[j][1]))):
            i, kind, a, b = open_[j]
            if p[j] >= limits[kind] and taken.setdefault(i, Taken()).add(a, b):
                more.setdefault(i, []).append((kind, a, b))
        for i, found in more.items():
            every[i] = sorted(every[i] + found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return list(zip(base, every, strict=True))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in detect([text])[0][1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]




def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null or empty text has no spans. Offsets count code points, ends are exclusive; spans
    that start together come in the order of KINDS. Texts are read whole, in time in
    proportion to their length; a step holds about STEP_BYTES of them, or one longer text.
    Repeated rows give repeated rows; a null id stays null; other columns are not read; an
    empty table gives an empty result.
    """
    trees = model()  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        for batch in batches:
            for at, texts in text_steps(batch.column(1)):
                found = detect(texts, trees=trees)
                columns = [batch.column(0).slice(at, len(texts))]
                columns += [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]))
                columns.append(pa.array([joined(every) for _, every in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


#: The base kinds by regular expressions: a match begins where the pieces and matches before it end.
ORACLE = r"""
WITH k(no, kind, pattern) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (3, 'card', '[0-9]([\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
t AS (
  SELECT doc_id, 1 AS no, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS found, regexp_split_to_array(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS pieces
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
  UNION ALL SELECT doc_id, 2, regexp_extract_all(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(x, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
  UNION ALL SELECT doc_id, 3, regexp_extract_all(x, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(x, '[0-9]([\x20-]?[0-9])+')
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
  UNION ALL SELECT doc_id, 4, regexp_extract_all(x, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(x, '\+[0-9][\x20().0-9-]+[0-9]')
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
u AS (SELECT doc_id, no, generate_subscripts(found, 1) AS i, unnest(found) AS m, unnest(pieces[1:len(found)]) AS piece FROM t WHERE len(found) > 0),
s AS (
  SELECT doc_id, no, m, replace(replace(m, ' ', ''), '-', '') AS digits,
         sum(length(piece)) OVER w + sum(length(m)) OVER w - length(m) AS a
  FROM u WINDOW w AS (PARTITION BY doc_id, no ORDER BY i)),
g AS (
  SELECT doc_id, no, a, a + length(m) AS b FROM s
  WHERE no = 1
     OR no = 2 AND list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(ltrim(x, '0'), 3) AS INT), 0) <= 255))
     OR no = 3 AND length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
          lambda i: CASE WHEN i % 2 = 1 THEN ascii(substr(reverse(digits), i, 1)) - 48 ELSE (2 * (ascii(substr(reverse(digits), i, 1)) - 48)) // 10 + (2 * (ascii(substr(reverse(digits), i, 1)) - 48)) % 10 END)) % 10 = 0
     OR no = 4 AND length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15),
c AS (
  SELECT doc_id, count(*) FILTER (no = 1) AS n_email, count(*) FILTER (no = 2) AS n_ip, count(*) FILTER (no = 3) AS n_card, count(*) FILTER (no = 4) AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no, b) AS spans
  FROM g JOIN k USING (no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256
FROM documents d LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id
"""
