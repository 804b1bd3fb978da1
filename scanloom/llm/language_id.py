"""Language ID by rank-order profiles: the out-of-place distance between a document's most frequent character n-grams
and each language's.

n-grams are of one to three letters, with word boundaries, over the whole lower-cased text. Profiles are counted over
all training documents; only each language's `profile_size` most frequent n-grams reach the driver.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import runs
from .common import crc_mod, table

PROFILE = 300
UNDETERMINED = "und"
CHARS = 1_000_000  # of a run of documents that is counted at once
ENTRIES = 2_000_000  # partial counts that a task holds


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter's code point; 0 for what is no letter. Marks belong to letters, but are none:
    a text of marks alone has no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def dense_grams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, count, alphabet) in order of owner and gram, for texts and the number that owns each.

    A gram is a number in the texts' own alphabet, of which 0 is the boundary; to_grams() makes it independent of that.
    """
    points = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    own = np.concatenate([[0], np.repeat(owner, lens)])
    x = _letters()[points]
    keep = np.ones(len(x), bool)  # of several boundaries in a row, one
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    x, own = x[keep], own[keep]
    alphabet = np.flatnonzero(np.bincount(x))
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    a = len(alphabet)
    total = a + a * a + a**3
    small = (int(owner.max()) + 1 if len(owner) else 1) * total < 2**31
    x, own = number[x].astype(np.int32 if small else np.int64), own.astype(np.int32 if small else np.int64)
    base, inner = own * total, x != 0
    # No gram spans words; its owner is that of a letter of it, as a boundary before a text is its predecessor's.
    pair = x[:-1] * a + x[1:]
    ok = inner[:-1] | inner[1:]
    at = np.where(inner[1:], base[1:], base[:-1])
    parts = [(base + x)[inner], (at + pair + a)[ok]]
    if len(x) > 2:
        ok = inner[1:-1]
        parts.append((base[1:-1] + pair[:-1] * a + x[2:] + (a + a * a))[ok])
    key = np.sort(np.concatenate(parts))
    if not len(key):
        return key, key, key, alphabet
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, count = key[start], np.diff(np.append(start, len(key)))
    own = key // total
    return own, key - own * total, count, alphabet


def to_grams(dense: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code points of one to three letters in 21 bits each; a boundary is 1 as a first letter, else 0."""
    a = len(alphabet)
    first = np.where(alphabet == 0, 1, alphabet)
    one, two = np.minimum(dense, a - 1).astype(np.int64), np.clip(dense - a, 0, a * a - 1).astype(np.int64)
    three = np.maximum(dense.astype(np.int64) - a - a * a, 0)
    as_two = (first[two // a] << 21) | alphabet[two % a]
    as_three = (first[three // (a * a)] << 42) | (alphabet[three // a % a] << 21) | alphabet[three % a]
    return np.where(dense < a, alphabet[one], np.where(dense < a + a * a, as_two, as_three))


def grams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, dense, count, alphabet = dense_grams(texts, owner)
    return own, to_grams(dense, alphabet), count


def _counts(batches):
    """Arrow batches (lang, text) -> partial counts (lang, gram, n)."""
    held: dict[str, list] = {}
    size = 0

    def merged():
        for lang, parts in held.items():
            code = np.concatenate([p[0] for p in parts])
            order = np.argsort(code, kind="stable")
            code, n = code[order], np.concatenate([p[1] for p in parts])[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            held[lang] = [(code[start], np.add.reduceat(n, start))]
        return sum(len(p[0][0]) for p in held.values())

    def out():
        for lang, [(code, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        for i, j in runs(np.fromiter(map(len, texts), np.int64, len(texts)), CHARS):
            own, code, n = grams(texts[i:j], np.array([number[x] for x in langs[i:j]]))
            edges = np.searchsorted(own, np.arange(len(names) + 1))
            for k, name in enumerate(names):
                part = slice(edges[k], edges[k + 1])
                if edges[k + 1] > edges[k]:
                    held.setdefault(name, []).append((code[part], n[part]))
            size += len(code)
            if size > 2 * ENTRIES:
                size = merged()
                if size > ENTRIES:
                    yield from out()
                    held.clear()
                    size = 0
    if held:
        merged()
        yield from out()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile_size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its n-grams (as numbers), most frequent first; ties in order of the number. Rows without text or
    language teach nothing; without any row there is no language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= profile_size)
    found: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.place)):  # profile_size rows a language
        found.setdefault(r.lang, []).append(r.gram)
    return found


def predict_texts(texts: list[str], profiles: dict[str, list[int]], profile_size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. A tie goes to the first language in order of name."""
    langs = sorted(profiles)
    n = len(texts)
    pred, score = np.full(n, -1), np.zeros(n)
    tables = []
    for lang in langs:
        g = np.array(profiles[lang], np.int64)
        order = np.argsort(g)
        tables.append((g[order], order))
    for i, j in runs(np.fromiter(map(len, texts), np.int64, n), CHARS):
        own, dense, count, alphabet = dense_grams(texts[i:j], np.arange(j - i))
        if not len(own) or not langs:
            continue
        # Places by owner, then falling count, then gram (in whose order they are): one sort of packed numbers.
        bits, wide = int(len(own)).bit_length(), int(count.max()).bit_length()
        most = (1 << wide) - 1
        packed = np.sort((((own.astype(np.int64) << wide) | (most - count)) << bits) | np.arange(len(own)))
        order = packed & ((1 << bits) - 1)
        own = own[order].astype(np.int64)
        first = np.searchsorted(own, np.arange(j - i))
        place = np.arange(len(own)) - first[own]
        top = place < profile_size
        own, code, place = own[top], to_grams(dense[order[top]], alphabet), place[top]
        size = np.bincount(own, minlength=j - i)
        dist = np.empty((len(langs), j - i))
        for k, (g, rank) in enumerate(tables):
            at = np.minimum(np.searchsorted(g, code), len(g) - 1)
            off = np.where(g[at] == code, np.abs(rank[at] - place), profile_size)
            dist[k] = np.bincount(own, weights=off, minlength=j - i)
        dist /= np.maximum(size, 1) * profile_size
        best = dist.argmin(0)
        has = np.fromiter((any(map(str.isalpha, t)) for t in texts[i:j]), bool, j - i)
        pred[i:j] = np.where(has, best, -1)
        score[i:j] = np.where(has, np.clip(1 - dist[best, np.arange(j - i)], 0, 1), 0)
    return [langs[p] if p >= 0 else UNDETERMINED for p in pred], score


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", profile_size: int = PROFILE) -> DataFrame:
    """The columns in keep with lang_pred and score (1 is no n-gram out of place). A text that is null or has no letter,
    and any text if there are no profiles, is `und` with score 0. Rows that repeat have equal results; a text of any
    length is counted as a whole. The profiles' size is languages x profile_size."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        for b in batches:
            texts = [x or "" for x in b.column(b.num_columns - 1).to_pylist()]
            lang, s = predict_texts(texts, profiles, profile_size)
            cols = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    profiles = train(docs.filter("NOT held_out"))
    return predict(docs, profiles, ["doc_id", "held_out"])
