"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier learns from what they say together."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.storage import short_batches

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# the same matches in linear time: one that starts within a run of these characters fails or succeeds as one from the run's first does
LINEAR = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
}
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE),
    "phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
ENDINGS = frozenset("com net org edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "35", "6011", "65", "62")
FOR = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile")}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "build", "release", "section")
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of the kind's base pattern counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def _votes(kind: str, found: str, text: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """+1 for, -1 against, 0 for no opinion: the strict pattern, the check on the number, the gazetteer, the words before, the neighbours, the look."""
    digits = re.sub("[^0-9]", "", found)
    before = text[max(start - 40, 0) : start].lower()
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        check, known = 0, 1 if re.split(r"[.)\]} ]", found.lower())[-1] in ENDINGS else -1
    elif kind == "ip":
        first = found.split(".")[0].lstrip("0")
        check, known = (1 if valid("ip", found) else -1), (1 if first and len(first) <= 3 and int(first) <= 223 else -1)
    elif kind == "card":
        check, known = (1 if 13 <= len(digits) <= 19 and luhn(digits) else -1), (1 if digits.startswith(ISSUERS) else -1)
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        known = (1 if digits.startswith(CALLING) else -1) if found.startswith("+") else 0
    words = -1 if any(w in before for w in AGAINST) else 1 if any(w in before for w in FOR[kind]) else 0
    joined = left.isalnum() or right.isalnum()
    look = -1 if digits and kind != "email" and len(set(digits)) <= 2 else 0
    return (1 if strict else -1), check, known, words, (-1 if joined else 1), look


def _shape(found: str) -> str:
    digits = sum(c.isdigit() for c in found)
    return f"{min(len(found) // 6, 5)}{digits * 3 // max(len(found), 1)}{int(' ' in found)}"


def _within(kind: str, found: str):
    """Valid spans in a card or phone match that fails because it runs into other numbers: runs of whole words, the shortest card, the longest phone."""
    if kind not in ("card", "phone"):
        return
    words = [m.span() for m in re.finditer(r"[^\x20]+", found)]
    i = 0
    while i < len(words):
        digits, hit = 0, None
        for j in range(i, len(words)):
            digits += sum(c.isdigit() for c in found[slice(*words[j])])
            if digits > 19:
                break
            span = words[i][0], words[j][1]
            if BASE[kind].fullmatch(found, *span) and valid(kind, found[slice(*span)]):
                hit = j, span
                if kind == "card":
                    break
        if hit:
            yield hit[1]
        i = hit[0] + 1 if hit else i + 1


def base_matches(kind: str, text: str):
    """The matches of the kind's base pattern, leftmost and not overlapping."""
    if kind not in LINEAR:
        yield from BASE[kind].finditer(text)
        return
    at, m = 0, None
    while True:
        m = (BASE[kind].match(text, at) if m and kind == "email" else None) or LINEAR[kind].search(text, at)  # an email may begin where one ended, within a run
        if not m:
            return
        yield m
        at = m.end()


def candidates(text: str):
    """(kind, start, end, strict, pattern) of all candidate spans; pattern is what labelers and classifier see."""
    lettered, numbered = "@" in text, re.search("[0-9]", text) is not None
    for kind in KINDS:
        taken = []
        if lettered if kind == "email" else numbered:
            for m in base_matches(kind, text):
                strict = valid(kind, m[0])
                if strict or kind != "card" or len(m[0]) >= 13:
                    taken.append((m.start(), m.end()))
                    yield kind, *taken[-1], strict, _pattern(kind, m[0], text, *taken[-1], strict)
                    for a, b in () if strict else _within(kind, m[0]):
                        a, b = m.start() + a, m.start() + b
                        yield kind, a, b, False, _pattern(kind, text[a:b], text, a, b, True)
        if kind in LOOSE and (numbered or kind == "email"):
            at = 0
            for m in LOOSE[kind].finditer(text) if kind == "phone" or re.search(r"[(\[{]at[)\]}]", text, re.IGNORECASE) else ():
                while at < len(taken) and taken[at][1] <= m.start():
                    at += 1
                if at == len(taken) or taken[at][0] >= m.end():
                    yield kind, m.start(), m.end(), False, _pattern(kind, m[0], text, m.start(), m.end(), False)


def _pattern(kind, found, text, start, end, strict) -> str:
    return f"{kind}|{','.join(map(str, _votes(kind, found, text, start, end, strict)))}|{_shape(found)}"


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for one kind: how sure each vote pattern is to be personal data, P(vote | class) of each labeler, and the share of the class.

    Starts from the majority; each labeler's votes are independent given the
    class, with add-one smoothing.
    """
    sure = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    for _ in range(rounds):
        share = ((n * sure).sum() + 1) / (n.sum() + 2)
        table = np.empty((2, votes.shape[1], 3))
        for c, w in enumerate((n * (1 - sure), n * sure)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = (w[:, None] * (votes == v)).sum(0) + 1
            table[c] /= table[c].sum(1, keepdims=True)
        logs = np.log(table[:, np.arange(votes.shape[1]), votes + 1]).sum(2)
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -500, 500)))
        done = np.abs(new - sure).max(initial=0) < 1e-9
        sure = new
        if done:
            break
    return sure, table, share


def _features(patterns: list[str]) -> np.ndarray:
    rows = []
    for p in patterns:
        kind, votes, shape = p.split("|")
        own = [float(kind == k) for k in KINDS]
        for v in votes.split(","):
            own += [float(v == "1"), float(v == "-1")]
        own += [float(shape[0] == str(k)) for k in range(6)] + [float(shape[1] == str(k)) for k in range(4)] + [float(shape[2])]
        rows.append(own)
    return np.array(rows).reshape(len(rows), -1)


def fit(docs: DataFrame, threshold: float = 0.5) -> dict[str, bool]:
    """What the span classifier says of each pattern in ``docs`` (text).

    Candidates of all whole texts are counted by kind, votes and shape (at most
    a few thousand patterns, whatever the input).  EM estimates what each
    labeler's votes are worth for each kind; a logistic regression on kind,
    votes and shape is trained on the result, each pattern weighing the root of
    its count.
    """

    short_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            for t in batch.column(0):
                if t.is_valid:
                    for *_, p in candidates(t.as_py()):
                        seen[p] = seen.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, n = [r.pattern for r in got], np.array([float(r.n) for r in got])
    if not patterns:
        return {}
    kinds = np.array([p.split("|")[0] for p in patterns])
    votes = np.array([[int(v) for v in p.split("|")[1].split(",")] for p in patterns])
    sure = np.zeros(len(patterns))
    for kind in KINDS:
        own = kinds == kind
        if own.any():
            sure[own] = reliabilities(votes[own], n[own])[0]
    x = np.column_stack([_features(patterns), np.ones(len(patterns))])
    weight = np.sqrt(n)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (sure - p)) - 1e-4 * w)
    said = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) >= threshold
    return dict(zip(patterns, said.tolist(), strict=True))


def spans(text: str, model: dict[str, bool]) -> tuple[list, list]:
    """Base spans, and with them those the classifier adds: (kind, start, end) in order of kind and place."""
    base, every = [], []
    for kind, start, end, strict, pattern in candidates(text):
        if strict:
            base.append((kind, start, end))
        if strict or model.get(pattern, False):
            every.append((kind, start, end))
    order = lambda x: (KINDS.index(x[0]), x[1])
    return sorted(base, key=order), sorted(every, key=order)


def _said(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_private(docs: DataFrame, model: dict[str, bool]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs`` (doc_id, text): the base spans counted and digested, and all spans as kind:start:end.

    Base spans are the leftmost non-overlapping matches of each kind's pattern
    that pass its check, and always stay.  The classifier adds candidates that
    don't overlap those: addresses with (at) and (dot), numbers without a plus,
    matches that fail a check.  Places are code points.  A null or empty text
    has none.  Each row is judged for itself; an empty table gives an empty
    result.
    """

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text"):
                base, every = spans(t.as_py(), model) if t.is_valid else ([], [])
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: dict[str, bool]) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, overlapping spans by that of the first; the other columns as they are."""

    def clean(text: str) -> str:
        found = sorted((s, -e, k) for k, s, e in spans(text, model)[1])
        out, at = [], 0
        for s, e, k in found:
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
            at = max(at, -e)
        return "".join([*out, text[at:]]) if found else text

    def run(batches):
        for batch in batches:
            texts = [clean(t.as_py()) if t.is_valid else None for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) if c != "text" else pa.array(texts, pa.string()) for c in batch.schema.names})

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
