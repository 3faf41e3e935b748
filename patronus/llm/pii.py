"""Personal data by weak supervision.

One pass over the whole texts finds base spans by fixed patterns (scanned in
linear time) and looser candidates: keys and passwords, phone numbers without a
country code, e-mail addresses in words, and what matched a base pattern but
failed its check.  Six labelers (pattern, check, gazetteer, context before,
context against, neighbours) vote on every candidate: yes, no or nothing.

Spark counts the patterns of votes and features, a table bounded by the numbers
of kinds, labelers and features; on it expectation-maximisation estimates each
labeler's reliability per kind and with them each pattern's probability, and a
logistic span classifier is trained on features with these as soft labels.  The
classifier's weights (a few dozen numbers) then decide every candidate inside
Spark, on the narrow table of the first pass.  Base spans stay in any case; what
the classifier accepts and no base span overlaps is added.

Offsets are code points.  Defined results: a null or empty text has no spans;
repeated rows are judged one by one; extra columns are not read; with no
candidate at all nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "check", "gazetteer", "context", "against", "neighbours")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_KEY = re.compile(r"[A-Za-z0-9_/+-]{16,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,10}){1,4}")

#: Gazetteers and context words, per kind.
_TOP_DOMAINS = "com org net edu gov io info biz de fr es uk it nl eu ch at us ca au jp".split()
_CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 90 91".split()
_CARD_STARTS = "34 36 37 38 4 51 52 53 54 55 60 62 65".split()
_KEY_STARTS = "AKIA ASIA AIza ghp_ gho_ sk- sk_live_ xox eyJ glpat-".split()
_CONTEXT = {
    "email": "email e-mail mail contact write correo".split(),
    "ip": "ip host server address login from".split(),
    "card": "card visa mastercard credit karte carte tarjeta pay".split(),
    "phone": "phone tel call fax mobile telefon appel".split(),
    "secret": "password passwd token secret key api bearer pwd".split(),
}
_AGAINST = "version section isbn doi page chapter license licence no. nr.".split()


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """IPv4 spans that hold and that fail: each four parts of a run of dotted numbers."""
    good, bad = [], []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            (good if fits else bad).append((at, end))
            at = end + 1
    return good, bad


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _checked(pattern: re.Pattern, text: str, holds) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    good, bad = [], []
    for m in pattern.finditer(text):
        digits = "".join(c for c in m.group() if "0" <= c <= "9")
        (good if holds(digits) else bad).append(m.span())
    return good, bad


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(kind, start, end) of all base spans, by start then kind, and of failed matches."""
    good, bad = [], []
    if "@" in text:
        good += [("email", *s) for s in emails(text)]
    yes, no = addresses(text)
    good += [("ip", *s) for s in yes]
    bad += [("ip", *s) for s in no]
    yes, no = _checked(_CARD, text, lambda d: 14 <= len(d) <= 19 and luhn(d))
    good += [("card", *s) for s in yes]
    bad += [("card", *s) for s in no if s[1] - s[0] >= 13]
    if "+" in text:
        yes, no = _checked(_PHONE, text, lambda d: 10 <= len(d) <= 15)
        good += [("phone", *s) for s in yes]
        bad += [("phone", *s) for s in no]
    good.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return good, bad


def votes(text: str, kind: str, start: int, end: int, strict: bool, holds: bool) -> list[int]:
    """The six labelers: 1 yes, 0 no, -1 nothing."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        listed = int(span.rsplit(".", 1)[-1].lower() in _TOP_DOMAINS)
    elif kind == "ip":
        listed = 0 if span.startswith(("0.", "255.")) else -1
    elif kind == "card":
        listed = int(digits.startswith(tuple(_CARD_STARTS)))
    elif kind == "phone":
        listed = int(digits.startswith(tuple(_CALLING_CODES))) if span[0] == "+" else -1
    else:
        listed = 1 if span.startswith(tuple(_KEY_STARTS)) else -1
    before = text[max(0, start - 40):start].lower()
    near = re.split(r"[^a-zà-ÿ.-]+", before)
    left, right = text[start - 1:start], text[end:end + 1]
    glued = left.isalnum() or right.isalnum()
    return [1 if strict else -1, int(holds), listed,
            1 if any(w.rstrip(".") in _CONTEXT[kind] for w in near[-6:]) else -1,
            0 if any(w in _AGAINST for w in near[-4:]) else -1, 0 if glued else -1]


def features(text: str, kind: str, start: int, end: int, vote: list[int]) -> list[int]:
    """Active features of a span: its kind, and with it length, digits, case,
    separators, neighbours and context."""
    span, k = text[start:end], KINDS.index(kind)
    digits = sum("0" <= c <= "9" for c in span)
    share = 0 if not digits else 1 + (2 * digits > len(span)) + (digits == len(span))
    active = [min(len(span) // 6, 5), 6 + share, 10 + (span.upper() == span), 12 + any(c in " ().-" for c in span),
              14 + (vote[5] == 0), 16 + (vote[3] == 1), 18 + (vote[1] == 1), 20 + (vote[4] == 0)]
    return [k] + [len(KINDS) + 22 * k + a for a in active]


N_FEATURES = len(KINDS) + 22 * len(KINDS)


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """The base spans, and (kind, start, end, base, votes, features) of all candidates."""
    if not _ANY.search(text) and "at" not in text:
        return [], []
    base, failed = base_spans(text) if _ANY.search(text) else ([], [])
    found = [(*s, True, True, True) for s in base] + [(*s, False, True, False) for s in failed]
    starts, ends = [], []  # of the stretches that spans take, in order
    for s, e in sorted((s, e) for _, s, e, *_ in found):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        last = bisect_left(starts, e) - 1
        return last < 0 or ends[last] <= s
    loose = []
    if base or failed or _ANY.search(text):
        for m in _KEY.finditer(text):
            span = m.group()
            if any("0" <= c <= "9" for c in span) and any(c.isalpha() for c in span):
                strict = bool(re.fullmatch(r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{18,}|[0-9A-F]{32,}", span))
                loose.append(("secret", *m.span(), False, strict, len(set(span)) >= 8))
        loose += [("phone", *m.span(), False, False, True) for m in _LOCAL_PHONE.finditer(text)]
    if "at]" in text or "at)" in text:
        loose += [("email", *m.span(), False, False, True) for m in _SPELLED.finditer(text)]
    end = 0
    for c in sorted(loose, key=lambda x: (x[1], KINDS.index(x[0]))):
        if c[1] >= end and free(c[1], c[2]):
            found.append(c)
            end = c[2]
    out = []
    for kind, s, e, is_base, strict, holds in found:
        v = votes(text, kind, s, e, strict, holds)
        out.append((kind, s, e, is_base, "".join("nyx"[x if x >= 0 else 2] for x in v), features(text, kind, s, e, v)))
    return base, out


_SPANS = "array<struct<kind int, start int, end int, base boolean, votes string, features array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                               ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = []
            for text in part.column(1).to_pylist():
                _, found = candidates(text or "")
                rows.append([{"kind": KINDS.index(k), "start": s, "end": e, "base": b, "votes": v, "features": f}
                             for k, s, e, b, v, f in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["row", "spans"])


def reliabilities(votes_: np.ndarray, counts: np.ndarray, rounds: int = 100_000):
    """Expectation-maximisation for two classes over vote patterns (rows: 1, 0 or -1
    per labeler).  Returns each pattern's probability, the prior, and
    P(yes | class) per labeler.  Prior counts lean to labelers that are right more
    often than not, so the classes cannot swap."""
    yes, no = votes_ == 1, votes_ == 0
    q = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1)
    prior, rate = 0.5, np.zeros((2, votes_.shape[1]))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        lean = np.array([[1.0, 3.0], [3.0, 1.0]])  # prior yes, no votes of class 0 and class 1
        rate = (weight @ yes + lean[:, :1]) / (weight @ (yes | no) + lean.sum(1, keepdims=True))
        log = np.log([1 - prior, prior])[None, :] + yes @ np.log(rate).T + no @ np.log(1 - rate).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - q).max(initial=0) < 1e-10:
            q = new
            break
        q = new
    else:
        raise RuntimeError(f"reliabilities still move after {rounds} rounds")
    return q, prior, rate


def train(patterns) -> tuple[np.ndarray, dict]:
    """Classifier weights (the last is the bias) and the labelers' reliabilities per
    kind, from rows (kind, votes, features, n)."""
    if not patterns:
        return np.append(np.zeros(N_FEATURES), -1.0), {}
    kinds = np.array([p["kind"] for p in patterns])
    n = np.array([p["n"] for p in patterns], dtype=float)
    v = np.array([["ny".find(c) for c in p["votes"]] for p in patterns])
    x = np.zeros((len(patterns), N_FEATURES + 1))
    for i, p in enumerate(patterns):
        x[i, p["features"]] = 1
    x[:, -1] = 1
    q, known = np.zeros(len(patterns)), {}
    for k in np.unique(kinds):
        of = kinds == k
        q[of], prior, rate = reliabilities(v[of], n[of])
        known[KINDS[k]] = {"prior": prior, "yes_if_not": dict(zip(LABELERS, rate[0], strict=True)),
                           "yes_if_so": dict(zip(LABELERS, rate[1], strict=True))}
    w = np.zeros(x.shape[1])
    for _ in range(10_000):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (q - p)) - 0.5 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(w).max()):
            break
    else:
        raise RuntimeError("the span classifier did not converge")
    return w, known


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans, base): for every row all spans and the base spans, as sorted arrays
    of (start, kind, end); kind is an index into ``KINDS``."""
    kind = df.schema[key].dataType.simpleString()
    found = written(df.select(F.col(key).alias("row"), F.col(text).cast("string")).mapInArrow(_scan, f"row {kind}, spans {_SPANS}"), "pii")
    patterns = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))
    weights, _ = train(patterns.orderBy("kind", "votes", "features").collect())  # bounded by kinds, votes and features
    table = F.expr(f"array({', '.join(f'{w!r}D' for w in weights.tolist())})")
    score = lambda s: F.aggregate(F.transform(s["features"], lambda f: F.get(table, f)), F.lit(float(weights[-1])), lambda a, b: a + b)
    pick = lambda c: F.array_sort(F.transform(F.filter("spans", c), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select(F.col("row").alias("doc"), pick(lambda s: s["base"] | (score(s) > 0)).alias("spans"),
                        pick(lambda s: s["base"]).alias("base"))


def joined(spans):
    """``kind:start:end`` of every span, comma-joined."""
    names = F.expr(f"array({', '.join(repr(k) for k in KINDS)})")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
