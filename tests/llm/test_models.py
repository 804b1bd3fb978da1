"""Language ID, quality, PII, mixing, SentencePiece, near dedup, the pipeline."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import language_id, mixing, near_dedup, pii, quality, sentencepiece_codec
from scanloom.llm.registry import QUERIES

TEXT = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 !? 34"), (4, "12 !? 34"), (None, "x"), (5, "\0 ü 😀 ퟿"), (6, "word " * 60_000), (7, "a" * 300_000)]


def odd(spark, more=""):
    return spark.createDataFrame([(i, t) for i, t in ODD], TEXT)


# Language ID


def plain_grams(text):
    c = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        c.update(w)
        p = f" {w} "
        c.update(p[k : k + 2] for k in range(len(p) - 1))
        c.update(p[k : k + 3] for k in range(len(p) - 2))
    return c


def test_grams(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["", "1 2", "a", "a b"]
    own, code, n = language_id.grams(texts, np.arange(len(texts)))
    for k, t in enumerate(texts):
        assert sorted(n[own == k].tolist()) == sorted(plain_grams(t).values())


def test_language_of_documents_not_seen(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in got if got[i].held_out]
    assert len(got) == len(lang) and held and np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_out_of_place_by_hand():
    profiles = {"a": [ord("x"), ord("y")], "b": [ord("y"), ord("x")]}
    lang, score = language_id.predict_texts(["xxy", "yyx", "", "7"], profiles, 2)
    assert lang == ["a", "b", "und", "und"] and score[2] == 0


def test_language_of_odd_tables(spark):
    f = odd(spark).withColumn("lang", F.lit("en")).withColumn("score", F.lit(1))
    profiles = language_id.train(f)
    got = language_id.predict(f, profiles, ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.lang_pred for r in got}[4] == "und" and {r.doc_id: r.lang_pred for r in got}[6] == "en"
    assert language_id.train(f.limit(0)) == {} and {r.lang_pred for r in language_id.predict(f, {}, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(f.limit(0), profiles, ["doc_id"]).collect() == []


# Quality


def test_quality_of_documents_not_seen(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, sf).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in label if got[i].held_out]
    assert np.mean([got[i].predicted == label[i] for i in held]) > 0.9
    assert all(got[i].predicted for i in held if label[i])


def model():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "and", "tree"]) for _ in range(rng.randint(20, 300))) for _ in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    return quality.fit([t.encode() for t in good + bad], np.array([1] * 60 + [0] * 60), epochs=1), good, bad


def test_scores_do_not_depend_on_company():
    m, good, bad = model()
    texts = [t.encode() for t in (*good[:8], *bad[:8], "", "x", "word " * 300_000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    together = quality.score_texts(m, np.frombuffer(b"".join(texts), np.uint8), off)
    alone = [quality.score_texts(m, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and (together[:8] > 0.5).all() and (together[8:16] < 0.5).all()


def test_quality_of_odd_tables(spark):
    m, *_ = model()
    got = quality.score(odd(spark).withColumn("score", F.lit("old")), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd(spark).limit(0), m).collect() == []
    labels = spark.createDataFrame([(6, 1), (7, 1), (4, 0), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    texts, y = quality.sample_labelled(odd(spark), labels, 10, 1 << 30)
    assert y.tolist() == [1, 1] and [len(t) for t in texts] == [300_000, 300_000]
    assert len(quality.sample_labelled(odd(spark), labels, 1, 1 << 30)[0]) == 1 and quality.sample_labelled(odd(spark), labels, 9, 10)[0] == []
    assert 0 < quality.score_texts(quality.train(odd(spark), labels.limit(0)), np.zeros(3, np.uint8), np.array([0, 3]))[0] < 1


def test_one_long_text_does_not_end_the_sample(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    for long in range(6):  # wherever it is in the order
        f = spark.createDataFrame([(k, "x" * (1000 if k == long else 30)) for k in range(6)], "doc_id long, text string")
        sizes = lambda docs, size: sorted(map(len, quality.sample_labelled(f, labels, docs, size)[0]))  # noqa: E731, B023
        assert sizes(9, 999) == sizes(9, 1100) == [30] * 5 and sizes(9, 1150) == [*[30] * 5, 1000] and sizes(2, 1150) == [30] * 2


# PII


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("@@..a1+-() 12345é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t)[0] == plain_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("9" * 200_000 + "@" + "a" * 200_000)[0] == [] and pii.base_spans("1." * 50_000)[0][0] == (0, 7, "ip")


def test_pii_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        base = plain_spans(r.text)
        own = [tuple(x.split(":")) for x in got[r.doc_id].spans.split(",") if x]
        assert {(k, str(s), str(e)) for s, e, k in base} <= set(own)
        assert [got[r.doc_id][f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in base) for k in PATTERNS]


def test_em_finds_reliabilities():
    rng = np.random.default_rng(5)
    n = 20_000
    truth = rng.random(n) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.6, 0.85, 0.7])
    votes = np.where(rng.random((n, 6)) < right, truth[:, None] * 2, 2 - truth[:, None] * 2)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    post, chance = pii.expectation_maximisation(np.zeros(len(rows), int), rows, counts.astype(float))
    got = (chance[0, :, 1, 2] + chance[0, :, 0, 0]) / 2
    assert np.abs(got - right).max() < 0.03
    by = {tuple(r): p for r, p in zip(rows.tolist(), post)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.97


def test_pii_adds_and_leaves_alone(spark):
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows = [(k, f'say token = "{secret[k:] + secret[:k]}" now and mail me@example.com or 10.0.0.{k}') for k in range(30)] + [(100, "plain prose, 3 cats: 12 dogs"), *ODD]
    got = pii.find_pii(spark.createDataFrame(rows, TEXT).withColumn("spans", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all("secret" in {s.kind for s in by[k].spans} for k in range(30) if k not in {i for i, _ in ODD}) and by[100].spans == []
    assert pii.find_pii(spark.createDataFrame([], TEXT)).collect() == []


def test_pii_rejected_candidates_hide_none(spark, monkeypatch):
    rows = [(1, "415-555-2671 123-45-6789"), (2, "123-45-6789 987-65-4322"), (3, "call 415-555-2671 or me@example.com")]
    feature = lambda t, kinds: {pii.judge(t, s, e, k)[1] for s, e, k in pii.candidates(t, *pii.base_spans(t)) if k in kinds}
    found = lambda: {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, TEXT)).collect()}
    monkeypatch.setattr(pii, "train", lambda *_: sorted(set().union(*(feature(t, ("phone", "ssn")) for _, t in rows))))
    assert found() == {1: [(0, 12, "phone"), (13, 24, "ssn")], 2: [(0, 11, "ssn"), (12, 23, "ssn")], 3: [(5, 17, "phone"), (21, 35, "email")]}
    monkeypatch.setattr(pii, "train", lambda *_: sorted(set().union(*(feature(t, pii.KINDS) for _, t in rows))))
    assert found()[1] == [(0, 24, "card")]  # of accepted ones the first stays


def test_pii_batch_is_left_in_parts(monkeypatch):
    texts = [f"mail a{k}@example.com, 10.0.0.{k}, 415-555-26{k:02}" if k % 7 else None for k in range(60)]
    monkeypatch.setattr(pii, "CHARS", 200)
    out = list(pii._found([pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["id", "text"]).slice(3)]))
    assert len(out) > 10 and max(x.num_rows for x in out) < 20
    rows = [r for x in out for r in x.to_pylist()]
    assert [r["id"] for r in rows] == list(range(3, 60))
    for r in rows:
        text = texts[r["id"]] or ""
        base, failed = pii.base_spans(text)
        both = [(*x, True) for x in base] + [(*x, False) for x in pii.candidates(text, base, failed)]
        assert [tuple(s.values()) for s in r["base"]] == base
        assert [tuple(s.values()) for s in r["spans"]] == [(*x, *pii.judge(text, *x[:3])) for x in both]


# Mixing


def test_targets_are_capped_and_shared_again():
    t = mixing.capped_targets({"a": 100, "b": 10, "c": 100}, {"a": 3, "b": 1, "c": 2}, 315, 2)
    assert t["b"] == 20 and t["a"] == pytest.approx(177) and t["c"] == pytest.approx(118)
    assert mixing.capped_targets({"a": 5}, {"a": 3}, 100, 2) == {"a": 10} and mixing.capped_targets({}, {}, 1, 2) == {}
    assert mixing.by_code_point([None, "b", "B", "é"]) == ["B", "b", "é", None]


def test_flow_is_the_cheapest():
    """Against all integer flows of small graphs."""
    rng = random.Random(3)
    for _ in range(25):
        patterns = {f"p{i}": (rng.sample(["a", "b"], rng.randint(1, 2)), rng.randint(1, 3)) for i in range(2)}
        quotas = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        sent = mixing.route(patterns, quotas, 2)
        cost = lambda n, used: max(0, used - n)  # noqa: E731  first use is free, the second costs 1 a word
        best = None
        choices = [[(x, y) for x in range(2 * n + 1) for y in range(2 * n + 1 - x) if (x == 0 or "a" in m) and (y == 0 or "b" in m)] for m, n in patterns.values()]
        for p in choices[0]:
            for q in choices[1]:
                if p[0] + q[0] <= quotas["a"] and p[1] + q[1] <= quotas["b"]:
                    total = sum(p) + sum(q)
                    c = sum(cost(n, sum(x)) for (_, n), x in zip(patterns.values(), (p, q)))
                    if best is None or (-total, c) < best:
                        best = (-total, c)
        used = {k: sum(v for (p, _), v in sent.items() if p == k) for k in patterns}
        assert (-sum(sent.values()), sum(cost(n, used[k]) for k, (_, n) in patterns.items())) == best


def test_mix_of_a_table(spark, sf):
    sf = sf.replace("0.001", "0.1")
    a = QUERIES["op6_mixing"](spark, sf).toPandas()
    b = QUERIES["op6_mixing"](spark, sf).toPandas()
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    g = a.merge(source, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (abs(g.taken / g.target - 1) < 0.02).all() and (g["size"] == g.said).all() and (a.taken <= 2 * a["size"]).all()


def test_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7), ["a"] if i % 3 == 0 else ["b", "a", "a"] if i % 3 == 1 else None) for i in range(3000)]
    f = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    r = mixing.mix_report(f).collect()
    total = Counter()
    for x in r:
        assert len(x.uses) <= 2 and set(x.uses) <= set(x.members)
        total.update({s: x["size"] for s in set(x.uses)} if len(set(x.uses)) == len(x.uses) else {x.uses[0]: 2 * x["size"]})
    sizes = Counter()
    for x in r:
        sizes.update({s: x["size"] for s in x.members})
    want = mixing.capped_targets(sizes, {"a": 3, "b": 1, None: 2}, 1.5 * sum(x["size"] for x in r), 2)
    for s, t in want.items():
        assert abs(total[s] - t) < 0.02 * t
    assert mixing.mix(f).count() == sum(len(x.uses) for x in r)


def test_mix_of_odd_tables(spark):
    f = odd(spark).withColumn("source", F.lit(None).cast("string")).withColumn("size", F.lit(1))
    assert mixing.mix(f).columns == f.columns and len(mixing.mix_report(f).collect()) == len(ODD)
    assert mixing.mix(f.limit(0)).collect() == [] == mixing.mix_report(f.limit(0)).collect()
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, "b")], TEXT + ", source string")
    assert {r["size"] for r in mixing.mix_report(nothing).collect()} == {0}


# SentencePiece


def hard_texts():
    rng = random.Random(3)
    fixed = ["", "  ", " a  b   c", "\n\n a\t", "▁a", "<s> </s> <unk> <0x0A>", "日本語テキスト 😀 é́", "a" * 3000, " " * 500, "aaab" * 200, "\0x", "x 　 y"]
    return fixed + ["".join(rng.choice("ab  \n\t▁éñ日😀<s>0123.,aaaeeethin") for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def proto(pieces, kind, fallback, prefix=True, extra=False):
    """A model's protobuf by hand."""

    def number(v):
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    field = lambda n, data: number(n << 3 | 2) + number(len(data)) + data
    flag = lambda n, v: number(n << 3) + number(v)
    out = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + flag(3, k)) for p, s, k in pieces)
    trainer = flag(3, kind) + flag(35, fallback) + flag(40, 0) + flag(41, 1) + flag(42, 2) + number(43 << 3) + b"\xff" * 9 + b"\1"
    return out + field(2, trainer) + field(3, field(1, b"identity") + flag(3, prefix) + flag(4, extra) + flag(5, 1))


def test_bpe_parity():
    data = sentencepiece_codec.read_model()
    c = sentencepiece_codec.Codec(sentencepiece_codec.rebuild(data), data, sentencepiece_codec.tables(data), 2)
    texts = hard_texts()
    ids = c.encode(texts)
    assert ids == c.own.encode(texts)
    data, n = [t.encode() for t in texts], np.array([len(x) for x in ids])
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    fast = c.round_trips(ids, np.frombuffer(b"".join(data), np.uint8), off)
    for t, back, said in zip(texts, c.decode(ids), fast):
        assert back == t.replace("▁", " ") and said == (back == t)
    rng = random.Random(1)
    for x in [[rng.randrange(32000) for _ in range(20)] for _ in range(500)] + [[3 + 0xE9]]:
        assert c.decode([x])[0] == c.tokenizer.decode(x, skip_special_tokens=False)


def test_marks_are_set_as_the_library_sets_them():
    """The given model's normaliser sets marks alone, and isn't run by the library."""
    from tokenizers import Tokenizer

    data = sentencepiece_codec.read_model()
    rebuilt = sentencepiece_codec.rebuild(data)
    codec = sentencepiece_codec.Codec(rebuilt, data, sentencepiece_codec.tables(data), 1)
    texts = ["", " ", "  a  b\u2581\u2581c \u2581", "\x00\u00e9\U0001f600 \t\nfoo  ", "one two", "\u2581", "x" * 300 + " y"]
    whole = Tokenizer.from_str(rebuilt)
    assert codec.marks and codec.encode(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("extra", [False, True])
def test_unigram_parity(extra):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rng = random.Random(8)
    words = ["▁", "a", "b", "e", "t", "h", "i", "n", "▁a", "▁th", "in", "the", "aa", "aab", "▁▁", "th", "▁in", "é"]
    pieces += [(w, -rng.uniform(1, 9), 1) for w in words]
    data = proto(pieces, 1, 1, extra=extra)
    c = sentencepiece_codec.Codec(sentencepiece_codec.rebuild(data), data, sentencepiece_codec.tables(data), 1)
    texts = ["".join(rng.choice("abethin  é日") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert c.encode(texts) == c.own.encode(texts)


def test_each_word_is_encoded_once(monkeypatch):
    """Texts put together of words that were encoded once have the ids of texts encoded as a whole, whatever is in them."""
    data = sentencepiece_codec.read_model()
    rng = random.Random(8)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.rebuild(data), data, sentencepiece_codec.tables(data), 1)
    assert codec.by_word
    some = ["a", "the", "Wörter", "日本語", "\u2581", "x\u2581y", "line\nline", "\n", "\t", "😀", "q" * 300, "e\u0301", "\u00a0", "\x00", "<0x41>", "<unk>", "</s>"]
    some += ["".join(rng.choice("abcdeö1.,\n") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = ["", " ", "  a", "a ", "a  b", "a\u2581 b"] + [" ".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(300)]
    want = codec.encode(texts)
    sent = []
    whole = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda words: (sent.extend(words), whole(words)))
    for known in (sentencepiece_codec.KNOWN, 50, 50):  # the last ones forget
        monkeypatch.setattr(sentencepiece_codec, "KNOWN", known)
        for k in range(0, len(texts), 60):
            flat, counts = codec.encode_flat(pa.array(texts[k : k + 60]))
            end = np.cumsum(counts)
            assert [x.tolist() for x in np.split(flat, end[:-1])] == want[k : k + 60]
            assert sentencepiece_codec.agree(want[k : k + 60], flat, end) == [True] * len(counts)
            wrong = [x[:-1] if i == 7 else [y + 1 for y in x] if i == 9 else x for i, x in enumerate(want[k : k + 60])]
            assert sentencepiece_codec.agree(wrong, flat, end) == [i not in (7, 9) for i in range(len(counts))]
        if known > 50:
            assert len(sent) == len(set(sent)) > 250


def test_words_that_are_kept_are_bounded():
    """A worker holds few distinct words, and short ones, at once; in the pipeline it has little room beside the executor."""
    data = sentencepiece_codec.read_model()
    codec = sentencepiece_codec.Codec(sentencepiece_codec.rebuild(data), data, sentencepiece_codec.tables(data), 1)
    for k in range(0, 400_000, 20_000):
        codec.encode_flat(pa.array([" ".join(f"w{x}" for x in range(k, k + 20_000))]))
        assert len(codec.words) == len(codec.at) == len(codec.counts) <= 120_000


def test_sentencepiece_of_odd_tables(spark):
    f = odd(spark).withColumn("ids", F.lit("old"))
    got = sentencepiece_codec.encode_column(f)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(ODD) and rows[1, None].ids is None and rows[1, None].parity is None and rows[2, ""].ids == []
    assert all(r.parity and r.round_trip for k, r in rows.items() if k[1] is not None)
    back = sentencepiece_codec.decode_column(got.drop("text").withColumnRenamed("doc_id", "i"))
    assert Counter(r.text for r in back.collect()) == Counter(t for _, t in ODD)
    assert sentencepiece_codec.encode_column(f.limit(0)).collect() == []


# Near dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def expected_classes(rows):
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or [()]:
            where[x].append(k)
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    seen = set()
    for own in where.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
                    if both >= 0.8 * either:
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    groups = defaultdict(set)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].add(i)
    return Counter(frozenset(g) for g in groups.values())


def check_near(spark, rows, schema=TEXT):
    got = near_dedup.near_classes(spark.createDataFrame(rows, schema)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.id)
    assert len(got) == len(rows) and Counter(frozenset(g) for g in groups.values()) == expected_classes(rows)


def test_marks_are_no_letters():
    profiles = {"en": [ord(c) for c in "etaoin"], "fr": [ord(c) for c in "esaitn"]}
    texts = ["\u2764\ufe0f", "1\ufe0f\u20e3", "\u0301", "", "42", "é", "e\u0301"]
    got, score = language_id.predict_texts(texts, profiles)
    assert got[:5] == ["und"] * 5 and not score[:5].any() and all(x in profiles for x in got[5:])


def test_signatures_are_unbiased():
    rng = random.Random(5)

    def signed(texts):
        words, n = near_dedup.words_of(texts)
        return near_dedup.signatures(*near_dedup.multisets(*near_dedup.shingles_of(words, n), len(texts)), len(texts))

    off = []
    for k in range(150):
        a = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 200))]
        a = a[:30] * rng.randint(1, 12) + a[30:] if k % 2 else a
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(len(b))] = str(rng.random())
        b = b + b[: len(b) // 3] if k % 3 == 0 else b
        s = signed([" ".join(a), " ".join(b)])
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        true = sum((x & y).values()) / sum((x | y).values())
        off.append(((s[0] == s[1]).mean() - true) / max(true * (1 - true) / near_dedup.REGISTERS, 1e-6) ** 0.5)
    assert abs(np.mean(off)) < 0.3 and 0.8 < np.std([z for z in off if abs(z) < 5]) < 1.25
    assert (signed(["a b c d e f g", "x"])[0] == signed(["A b\nc d e f  g"])[0]).all()


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k * k}" for k in range(3000))
    whole = near_dedup.words_of([text])[0]
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    assert (near_dedup.words_of([text])[0] == whole).all() and len(near_dedup.words_of(["x" * 1000])[0]) == 1


def test_near_classes(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for g in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 150))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = str(rng.random())
            rows.append((n, " ".join(own)))
            n += 1
    chain = [f"c{k}" for k in range(100)]
    for k in range(30):  # each is near the next, the first and the last are not
        rows.append((n + k, " ".join(chain)))
        chain[3 * k : 3 * k + 1] = [f"d{k}"]
    rows += [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "One  TWO"), (905, "one three"), (906, "one two"), (906, "one two")]
    check_near(spark, rows)


@pytest.mark.parametrize("rows", [1024, 50])
def test_near_classes_of_a_large_group(spark, monkeypatch, rows):
    """Copies that are near their text, or only near another copy, or to none, in one block and in several."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", rows)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    texts = [base]
    while len(texts) < 350:
        own = list(rng.choice(texts[-40:]) if rng.random() < 0.3 else base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = str(rng.random())
        texts.append(own)
    check_near(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])


def test_pairs_with_the_hub_are_compared_once(spark, monkeypatch):
    """Of a bucket of two, nothing is left to compare after the stars."""
    rng, rows, held = np.random.default_rng(4), [], []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:95], *(f"v{x}" for x in rng.integers(0, 10**6, 25))]))]
    rest = near_dedup._rest_links
    monkeypatch.setattr(near_dedup, "_rest_links", lambda others, *a: held.append(others.count()) or rest(others, *a))
    met = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda star, *a: met.append(star.count()) or verified(star, *a))
    out = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.select("root").distinct().count() == 40 and met[0] > 10 and held == [0]


def test_bitmap_of_wanted_hashes(spark):
    rng = np.random.default_rng(9)
    wanted, others = (rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64) for _ in range(2))
    wanted[:4] = [0, -1, 2**63 - 1, -(2**63)]
    frame = spark.createDataFrame([(x,) for x in wanted.tolist()], "hash long")
    for most, size, let in ((26, 1 << 14, 0.1), (15, 1 << 12, 0.3)):  # bytes, share of others that come through
        bitmap = near_dedup.wanted_bits(frame, most)
        assert len(bitmap) == size
        assert near_dedup._is_wanted(bitmap, wanted).all() and near_dedup._is_wanted(bitmap, others).mean() < let
    assert not near_dedup._is_wanted(near_dedup.wanted_bits(frame.limit(0)), others).any()


def test_near_dedup_does_not_shuffle_texts(spark, monkeypatch):
    """Texts meet a bitmap before any join or aggregation; classes are the same if that lets everything through."""
    plans, whole = {}, near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and whole(df, name))
    monkeypatch.setattr(near_dedup, "_is_wanted", lambda bitmap, hashes: np.ones(len(hashes), bool))
    rng = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:-1] + [f"x{k % 9}"]) if k < 40 else f"{rng.random()} " * 30) for k in range(90)]
    check_near(spark, rows + [(100, None), (101, "")])
    below = plans["near-sets"].split("MapInArrow", 1)[1]
    assert "Join" not in below and "Aggregate" not in below


def test_near_classes_of_a_table(spark, sf):
    check_near(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_near_dedup_of_odd_tables(spark):
    f = odd(spark).withColumn("class_id", F.lit(1)).withColumn("band", F.lit("x"))
    got = near_dedup.near_dedup(f)
    assert got.columns == f.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4, 5, 6, 7]
    kept = near_dedup.near_report(f).filter("kept").collect()
    assert {r.class_id for r in kept} == {1, 4, None, 5, 6, 7}
    assert near_dedup.near_dedup(f.limit(0)).collect() == [] == near_dedup.near_report(f.limit(0)).collect()


# The pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, schema = docs.count(), docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    for k, (name, one) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(one(spark, docs, sf), name)
        if k < 4:
            assert docs.schema == schema
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
            assert len(good - {r.doc_id for r in docs.collect()}) <= 0.02 * len(good)
        if name == "near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count() < before
    assert docs.filter("NOT parity OR NOT round_trip").count() == 0 and docs.count() > 0
    assert docs.filter("n_chars <> char_length(text)").count() == 0
