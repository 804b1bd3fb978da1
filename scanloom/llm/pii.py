"""Personal data by weak supervision.

Regular expressions find base spans (email, ip, card, phone) and further candidates: numbers that fail a check, local
phone numbers, identity numbers, assigned secrets. Six labelers vote on each candidate: shape, check, gazetteer,
context, edges and variety. Expectation-maximisation over the counts of vote patterns of all candidates estimates each
labeler's reliability per kind, and the posteriors train a logistic classifier of spans. Base spans always stay; a
candidate is added if the classifier gives it `threshold` at least.

Texts are read once. What reaches the driver is counts of codes, of which there is a fixed number.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import raw, release, runs
from .common import stage, table

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
LABELERS = ("shape", "check", "gazetteer", "context", "edges", "variety")
THRESHOLD = 0.9
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Each of these finds what the plain pattern finds, leftmost and without overlap, but in linear time.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_]{2,20}) ?[:=] ?([\"']?)([A-Za-z0-9+/_-]{16,}+)")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
TOPS = frozenset("com org net edu gov mil int io co info biz de fr es uk eu us ca it nl ch at be".split())
SECRET_NAMES = frozenset("token secret password passwd pwd api_key apikey access_key auth key private_key credential".split())
CONTEXT = {
    "email": ("mail", "contact", "write to"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "password", "auth"), "ssn": ("ssn", "social security", "security number"),
}
AGAINST = ("order", "invoice", "isbn", "version", "page", "serial", "part no", "sku")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, end, kind) in order of start and kind, and the matches that failed a check."""
    found, failed = [], []
    if "@" in text:
        past = 0
        for m in AT.finditer(text):
            seg = text[past : m.start()]
            start = past + len(seg.rstrip(LOCAL))
            if start < m.start():
                found.append((start, m.end(), "email"))
                past = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            ok = all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))
            (found if ok else failed).append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                ok = 9 <= sum(c.isdigit() for c in m.group()) <= 15
                (found if ok else failed).append((m.start(), m.end(), "phone"))
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found, failed


def candidates(text: str, base: list, failed: list) -> list[tuple[int, int, str]]:
    """Further candidates, none of which overlaps a base span; they may overlap one another."""
    more = list(failed)
    if "=" in text or ":" in text:
        more += [(m.start(3), m.end(3), "secret") for m in SECRET.finditer(text)]
    if "-" in text or "." in text:
        if DIGIT.search(text):
            more += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text)]
            more += [(m.start(), m.end(), "phone") for m in LOCAL_PHONE.finditer(text)]
    if not more:
        return more
    taken = [(s, e) for s, e, _ in base]
    starts = np.array([s for s, _ in taken], np.int64)
    upto = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out = []
    for s, e, k in sorted(set(more), key=lambda x: (x[0], KINDS.index(x[2]), x[1])):
        at = int(np.searchsorted(starts, e)) - 1
        if at < 0 or upto[at] <= s:
            out.append((s, e, k))
    return out


def judge(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """(votes, features) of a span, as codes."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    before, after = text[start - 1 : start], text[end : end + 1]
    near = text[max(start - 40, 0) : start].lower()
    name = ""
    if kind == "secret":
        head = re.search(r"([A-Za-z_]+) ?[:=] ?[\"']?$", text[max(start - 26, 0) : start])
        name = head.group(1).lower() if head else ""
    shape = {
        "email": 2 < len(s) < 255 and ".." not in s, "ip": len(s) <= 15, "card": len(digits) in (13, 14, 15, 16, 19),
        "phone": 9 <= len(digits) <= 15, "secret": before in "\"'" and before != "", "ssn": True,
    }[kind]
    check = {
        "email": s.rsplit(".", 1)[-1].isalpha(), "ip": all(len(p) < 4 and int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0,
        "card": luhn(digits), "phone": 9 <= len(digits) <= 15, "secret": any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s),
        "ssn": digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000",
    }[kind]
    gazetteer = {
        "email": 1 if s.rsplit(".", 1)[-1].lower() in TOPS else 0, "ip": -1 if s.startswith(("0.", "255.")) else 0,
        "card": 1 if digits[:1] in ("3", "4", "5", "6") else -1, "phone": 1 if s[:1] == "+" and s[1:2] != "0" else 0,
        "secret": 1 if name in SECRET_NAMES else -1, "ssn": 0,
    }[kind]
    context = 1 if any(w in near for w in CONTEXT[kind]) else -1 if any(w in near for w in AGAINST) else 0
    edges = -1 if before.isalnum() or after.isalnum() else 1
    kinds = len(set(s.lower()))
    variety = -1 if kinds < min(4, len(s) // 2) else 1 if kinds >= 5 else 0
    votes = (2 * shape - 1, 2 * bool(check) - 1, gazetteer, context, edges, variety)
    long = (len(s) >= 12) + (len(s) >= 16) + (len(s) >= 32)
    feature = KINDS.index(kind)
    for value, size in ((long, 4), (bool(check), 2), (gazetteer + 1, 3), (context + 1, 3), ((edges + 1) // 2, 2), (min(kinds // 4, 3), 4), (sum(c.isalpha() for c in s) * 2 > len(s), 2)):
        feature = feature * size + int(value)
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code, feature


FEATURE_SIZES = (4, 2, 3, 3, 2, 4, 2)


def _one_hot(features: np.ndarray) -> np.ndarray:
    parts, rest = [], features.copy()
    for size in reversed(FEATURE_SIZES):
        parts.append(np.eye(size)[rest % size])
        rest //= size
    kind = np.eye(len(KINDS))[rest]
    crossed = [(kind[:, :, None] * p[:, None, :]).reshape(len(features), -1) for p in parts]
    return np.concatenate([kind, *crossed], 1)


def expectation_maximisation(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50):
    """Posterior of each pattern, and (kinds, labelers, 2, 3) chances of a vote given what a span is. Votes are 0 to 2
    (against, none, for); a labeler starts as right in 8 of 10 of its votes."""
    k, j = len(KINDS), votes.shape[1]
    chance = np.empty((k, j, 2, 3))
    chance[:, :, 0], chance[:, :, 1] = (0.55, 0.3, 0.15), (0.15, 0.3, 0.55)
    prior, post = np.full(k, 0.5), np.full(len(n), 0.5)
    for _ in range(rounds):
        log = np.log(np.stack([1 - prior, prior], 1))[kind]
        for i in range(j):
            log = log + np.log(chance[kind, i, :, votes[:, i]])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        for c in range(k):
            m = kind == c
            good, bad = n[m] * post[m], n[m] * (1 - post[m])
            prior[c] = (good.sum() + 1) / (n[m].sum() + 2)
            for i in range(j):
                for y, weight, start in ((0, bad, (1.1, 0.6, 0.3)), (1, good, (0.3, 0.6, 1.1))):
                    hit = np.bincount(votes[m, i], weight, 3) + np.array(start) * 5  # a prior keeps sides from changing
                    chance[c, i, y] = hit / hit.sum()
    return post, chance


def span_classifier(feature: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on one-hot features by kind, by Newton's method with a ridge."""
    x = _one_hot(feature)
    w, weight = np.zeros(x.shape[1]), n / max(n.sum(), 1) * min(float(n.sum()), 1e5)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        move = np.linalg.solve(hess, x.T @ (weight * (target - p)) - w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


SPAN = "struct<start:int,end:int,kind:string>"
CHARS = 1 << 19  # bytes of texts whose spans are held at once


def _spans_of(texts: list[str]) -> list[pa.Array]:
    """base and spans of some texts, as columns; no objects are made for spans."""
    at, n_base, n_all, found = ("start", "end", "kind"), [0], [0], ([], [], [], [], [], [])
    for text in texts:
        base, failed = base_spans(text)
        more = candidates(text, base, failed)
        for spans, own in ((base, True), (more, False)):
            for s, e, k in spans:
                for column, x in zip(found, (s, e, k, own, *judge(text, s, e, k))):
                    column.append(x)
        n_base.append(n_base[-1] + len(base))
        n_all.append(n_all[-1] + len(base) + len(more))
    types = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32())
    columns = [pa.array(c, t) for c, t in zip(found, types)]
    only = [c.filter(columns[3]) for c in columns[:3]]
    every = pa.StructArray.from_arrays(columns, [*at, "base", "votes", "feature"])
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return [lists(n_base, pa.StructArray.from_arrays(only, list(at))), lists(n_all, every)]


def _found(batches):
    """(id, text) -> (id, base, spans), in parts of about CHARS bytes of text: a worker holds no more than a part's spans."""
    for batch in batches:
        _, off = raw(batch.column(1))
        for i, j in runs(np.diff(off), CHARS):
            part = batch.slice(i, j - i)
            spans = _spans_of([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *spans], ["id", "base", "spans"])
    release()


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base array<start, end, kind>, spans array<start, end, kind, base, votes, feature>, for each row; a null text is empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_found, f"id {kind}, base array<{SPAN}>, spans array<struct<start:int,end:int,kind:string,base:boolean,votes:int,feature:int>>")


def train(found: DataFrame, threshold: float = THRESHOLD) -> list[int]:
    """The feature codes whose spans are taken."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.feature").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # of 3**6 votes and 6 * 1152 features at most
    if not rows:
        return []
    rows.sort(key=lambda r: (r.kind, r.votes, r.feature))
    kind = np.array([KINDS.index(r.kind) for r in rows])
    code = np.array([r.votes for r in rows])
    votes = np.stack([code // 3**k % 3 for k in reversed(range(len(LABELERS)))], 1)
    n, feature = np.array([r.n for r in rows], float), np.array([r.feature for r in rows])
    post, _ = expectation_maximisation(kind, votes, n)
    w = span_classifier(feature, post, n)
    codes = np.unique(feature)
    p = 1 / (1 + np.exp(-_one_hot(codes) @ w))
    return [int(c) for c in codes[p >= threshold]]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, base and spans, arrays of (start, end, kind) in code points, end exclusive, in order
    of start and kind. spans has base and what the classifier adds; of what it accepts, spans that begin within one before
    them are left out. Null and empty texts have none; repeated rows have
    a row each; a table without candidates adds none. Other columns are ignored."""
    found = stage(find_candidates(docs, id_col, text_col), "pii-candidates")
    taken = train(found, threshold)
    added = lambda s: ~s["base"] & s["feature"].isin(taken) if taken else F.lit(False)
    place = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    ordered = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    more = ordered(F.filter("spans", added))
    start = F.struct(F.lit(0).alias("last"), F.filter(more, lambda s: F.lit(False)).alias("out"))
    grown = lambda x, s: F.struct(s["end"].alias("last"), F.concat(x["out"], F.array(s)).alias("out"))
    apart = F.aggregate(more, start, lambda x, s: F.when(s["start"] >= x["last"], grown(x, s)).otherwise(x), lambda x: x["out"])
    spans = F.array_sort(F.concat(ordered(F.filter("spans", lambda s: s["base"])), apart))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(n, KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
