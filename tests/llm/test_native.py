"""Exact dedup, line dedup, chat formatting, components."""

from __future__ import annotations

import os
import random
import string
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import chat_format, common, exact_dedup, line_dedup
from scanloom.llm.common import stage
from scanloom.llm.components import components
from scanloom.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, more="", schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema + more)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


# Exact dedup


def expected_exact(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(lower), []).append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(lower)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep))
    return sorted(out, key=str)


HARD = [
    (1, "Same"), (2, "sAME"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "a" * 9 + "b" * 9), (8, "A" * 9 + "B" * 9), (9, "a" * 9 + "b" * 10), (10, "ab" * 50),
    (11, "ab" * 50), (12, "ab" * 49 + "ba"), (12, "ab" * 49 + "ba"), (12, "other"), (None, "nobody"), (None, None), (13, "\n\n"), (14, "x😀y" * 7), (15, "X😀y" * 7),
]


@pytest.mark.parametrize("chars", [1, 3, 4, 8192])
def test_exact_dedup(spark, chars):
    got = exact_dedup.exact_dedup(docs(spark, HARD), block_chars=chars)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == expected_exact(HARD)


def test_names_do_not_collide_when_hashes_do(spark):
    """All blocks have one of two hashes; identities still are contents."""
    few = lambda b: F.struct((F.length(b) % 2).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    got = exact_dedup.exact_classes(docs(spark, HARD), block_chars=4, hashes=few).collect()
    by = {}
    for r in got:
        by.setdefault((r.level, r.name), set()).add(r.text_sha256)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({r.text_sha256 for r in got})


def test_exact_dedup_of_odd_tables(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []
    clash = docs(spark, [(1, "a", "b", 2), (2, "A", None, 3)], ", block string, name int")
    assert {(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(clash).collect()} == {(1, False), (2, True)}


# Lines


def words_of(n, rng, vocabulary=400):
    return " ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(vocabulary)}"[: rng.randint(2, 6)] for _ in range(n))


def test_simhash_is_the_majority_of_letters(spark):
    rng = random.Random(1)
    lines = [*(" ".join(rng.choice("abcdé") * rng.randint(1, 9) for _ in range(n)) for n in (1, 2, 5, 9, 254, 300)), "ab " * 16_400 + "c", "longword" * 4_200]
    f = spark.createDataFrame(list(enumerate(lines)), "place long, norm string")
    got = {r.place: r for r in line_dedup.signatures(f).collect()}
    parts = [[(w, len(w))] if len(w) < 7 else [(w[: (len(w) + 1) // 2] + "<", (len(w) + 1) // 2), (">" + w[(len(w) + 1) // 2 :], len(w) // 2)] for s in lines for w in s.split(" ")]
    every = spark.createDataFrame(sorted({(t,) for p in parts for t, _ in p}), "t string")
    hashes = {r.t: r for r in every.select("t", *[F.xxhash64(F.lit(j), F.xxhash64("t")).alias(f"h{j}") for j in range(3)]).collect()}
    parts = iter(parts)
    for k, s in enumerate(lines):
        own = [x for _ in s.split(" ") for x in next(parts)]
        total = sum(c for _, c in own)
        assert got[k].n == len(s)
        for j in range(3):
            want = sum(1 << b for b in range(64) if 2 * sum(c for t, c in own if (hashes[t][f"h{j}"] >> b) & 1) > total)
            assert want == got[k][f"s{j}"] & ((1 << 64) - 1)


def distance(a, b):
    """Edit distance, the columns' differences as bits of a number."""
    if not a:
        return len(b)
    at, mask, top = {}, (1 << len(a)) - 1, 1 << (len(a) - 1)
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & mask), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        up, down = mh | (~(xv | ph) & mask), ph & xv
    return score


def similar(s, t):
    return distance(s, t) <= int(max(len(s), len(t)) * 0.1 + 1e-9)


def similar_pairs(lines):
    """All (i, j), i < j, of the edit similarity; letters that they share bound it."""
    bags = np.zeros((len(lines), 32), np.int64)
    for i, s in enumerate(lines):
        np.add.at(bags[i], np.array([ord(c) for c in s]) % 32, 1)
    size = bags.sum(1)
    most = lambda i: (np.maximum(size[i], size[i + 1 :]) * 0.1 + 1e-9).astype(int)
    out = set()
    for i, s in enumerate(lines):
        shared = np.minimum(bags[i], bags[i + 1 :]).sum(1)
        for j in np.flatnonzero(np.maximum(size[i], size[i + 1 :]) - shared <= most(i)) + i + 1:
            if similar(s, lines[j]):
                out.add((i, int(j)))
    return out


def components_of(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_candidates_are_all_that_agree_in_two_blocks(spark):
    """Against plain loops: with a large group of near copies that is linked in itself, and two groups that meet."""
    rng = random.Random(4)
    value = lambda: [rng.getrandbits(64) - (1 << 63) for _ in range(3)]
    flip = lambda v, n: [x ^ sum({1 << rng.randrange(54) for _ in range(n)}) for x in v]
    rows, base = [], value()
    for k in range(150):
        rows.append((k, 150, *flip(base, rng.randint(0, 5))))
    for k in range(150, 300):
        rows.append((k, rng.choice([60, 64, 140, 150]), *flip(value() if rng.random() < 0.5 else list(rows[-1][2:]), rng.randint(0, 9))))
    lines = spark.createDataFrame(rows, "place long, n int, s0 long, s1 long, s2 long")
    label = {k: 0 if k < 70 else 70 for k in range(140)}
    labels = spark.createDataFrame(list(label.items()), "node long, root long")
    blocks = {r[0]: [(r[2 + i // 6] >> (9 * (i % 6))) & 511 for i in range(18)] for r in rows}
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and not (x[0] in label and label.get(x[0]) == label.get(y[0])):
                all_pairs = x[1] <= line_dedup.SHORT and y[1] <= line_dedup.SHORT
                agree = [i for i in range(18) if blocks[x[0]][i] == blocks[y[0]][i]]
                met = any(all_pairs or (j - i) % 18 in (1, 2) or (i - j) % 18 in (1, 2) for i in agree for j in agree if i < j)
                apart = sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(x[2:], y[2:]))
                if met and apart <= (line_dedup.BITS_APART if x[1] > line_dedup.MEDIUM else line_dedup.BITS_SHORT) and abs(x[1] - y[1]) <= max(x[1], y[1]) // 10:
                    want.add((x[0], y[0]))
    got = [(r.a, r.b) for r in line_dedup.candidates(lines, labels).collect()]
    assert set(got) == want and len(got) == len(want) > 500


def test_lines_of_the_edit_similarity_are_found(spark, duck):
    """Recall against all pairs of the table's lines: pairs that are linked, and lines that go because of them."""
    raw = duck.execute("SELECT DISTINCT unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL ORDER BY 1").fetchall()
    f = spark.createDataFrame(raw, "x string").select(line_dedup.normalised(F.col("x")).alias("norm")).filter(line_dedup.has_words(F.col("norm"))).distinct()
    lines = sorted(r.norm for r in f.collect())
    rng = random.Random(2)
    for s in rng.sample([s for s in lines if len(s) > 100], 120):
        k = rng.randrange(len(s))
        lines.append(s[:k] + "q" + s[k + 1 :])
        lines.append(" ".join("changed" if rng.random() < 0.03 else w for w in s.split(" ")))
    lines = sorted(set(lines))
    want = similar_pairs(lines)
    classes = spark.createDataFrame(list(enumerate(lines)), "place long, norm string")
    got = {r.node: r.root for r in line_dedup.similar_lines(classes).collect()}
    exact = components_of(want)
    found = sum(got.get(a, a) == got.get(b, b) for a, b in want)
    gone, all_gone = sum(k != v for k, v in got.items()), sum(k != v for k, v in exact.items())
    assert len(want) > 150 and found >= 0.9 * len(want) and gone >= 0.9 * all_gone
    assert all(exact[a] == exact[b] for a, b in got.items())  # nothing is linked that is not similar


def test_lines_with_changes_all_over_are_found(spark):
    """One letter in 25 is another one: nearly all bits of a SimHash may change, and such lines are found all the same."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(2, 9)))
    lines = []
    for _ in range(60):
        s = " ".join(word() for _ in range(60))
        t = list(s)
        for k in rng.sample([k for k, c in enumerate(s) if c != " "], len(s) // 25):
            t[k] = "x"
        lines += [s, "".join(t)]
    classes = spark.createDataFrame(list(enumerate(lines)), "place long, norm string")
    got = {r.node: r.root for r in line_dedup.similar_lines(classes).collect()}
    assert sum(got.get(k) == k and got.get(k + 1) == k for k in range(0, 120, 2)) > 45
    assert all(v == k - k % 2 for k, v in got.items())


def test_edits_without_common_ends(spark):
    """Leaving out words that both lines begin or end with changes no distance, also where they overlap or nothing is left."""
    rng = np.random.default_rng(11)
    line = lambda: " ".join("".join(rng.choice(list("abé"), rng.integers(1, 4))) for _ in range(rng.integers(1, 9)))
    pairs = [("a c", "a b c"), ("a", "a a"), ("a a", "a a a"), ("a b", "b"), ("ab", "a b"), ("x", "y"), ("a b", "a b")]
    for _ in range(400):
        s = line()
        t = list(s)
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(t) + 1)
            t[at : at + rng.integers(0, 2)] = list(rng.choice(["", "a", "b a", " a"]))
        pairs.append((s, " ".join("".join(t).split()) or "a"))
    rows = spark.createDataFrame(pairs, "s string, t string")
    found = rows.selectExpr(f"{line_dedup._edits('3')} AS n", "levenshtein(s, t) AS m").collect()
    assert all(r.n == (r.m if r.m <= 3 else -1) for r in found) and {r.n for r in found} == {-1, 0, 1, 2, 3}


def test_signatures_shuffle_texts_once(spark):
    """The words of a line are summed where its text is: one exchange for each width of lanes, by place."""
    held = []
    before, line_dedup.stage = line_dedup.stage, lambda df, name: held.append(df) or df
    try:
        line_dedup.signatures(spark.createDataFrame([(1, "some words here")], "place long, norm string"))
    finally:
        line_dedup.stage = before
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning(") == 2


def test_room_of_steps(spark):
    """Steps are compressed by zstd, and the signatures' goes when their copy with components is there."""
    lines = stage(spark.createDataFrame([(1, 9, 1, 2, 3), (2, 9, 1, 2, 3)], "place long, n int, s0 long, s1 long, s2 long"), "lines")
    assert any(x.endswith(".zstd.parquet") for x in os.listdir(lines._staged_at))
    labels = spark.createDataFrame([], "node long, root long")
    assert line_dedup.candidates(lines, labels).count() == 1 and not os.path.exists(lines._staged_at)


def test_garbage_of_the_driver_goes_at_half_of_its_heap(spark, monkeypatch):
    class Heap:
        total, held, runs = 400, 300, 0
        maxMemory, totalMemory = (lambda self: 1000), (lambda self: self.total)

        def gc(self):
            self.total, self.runs = self.held, self.runs + 1

    heap = Heap()
    monkeypatch.setattr(common, "_heap_after", 0)
    session = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap)))))
    assert not common.collect_garbage(session) and heap.runs == 0
    heap.total = 600
    assert common.collect_garbage(session) and (heap.runs, heap.total) == (1, 300)
    heap.total, heap.held = 600, 600
    assert common.collect_garbage(session) and heap.runs == 2
    assert not common.collect_garbage(session) and heap.runs == 2  # what is in use is not looked through at every step
    asked = []
    monkeypatch.setattr(common, "collect_garbage", asked.append)
    common.unstage(common.stage(spark.range(3), "garbage"))
    assert asked == [spark]


def test_room_that_the_driver_has_freed_goes_after_each_step(spark, monkeypatch):
    assert common.trim_native(spark)  # this JVM knows how
    monkeypatch.setattr(common, "trim_native", (asked := []).append)
    common.unstage(common.stage(spark.range(3), "trim"))
    assert asked == [spark]


def test_large_groups_of_near_lines(spark):
    """1,200 changed copies of a line, not all near each other, and one line that is near some: as by all pairs' links."""
    rng = random.Random(5)
    base = words_of(40, rng).split(" ")
    lines = {" ".join(base)}
    while len(lines) < 1200:
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(40)] = f"n{rng.randrange(9999)}"
        lines.add(" ".join(own))
    lines = sorted(lines) + [words_of(40, rng) for _ in range(300)]
    classes = spark.createDataFrame(list(enumerate(lines)), "place long, norm string")
    got = {r.node: r.root for r in line_dedup.similar_lines(classes).collect()}
    near = [i for i, s in enumerate(lines[:1200]) if similar(s, " ".join(base))]
    assert len(near) > 1000 and sum(got.get(i) == got[near[0]] for i in near) >= 0.99 * len(near)
    assert not any(i in got for i in range(1200, 1500))


def test_common_words_and_quoted_passages_make_few_pairs(spark):
    """Lines that have nothing in common but runs of short words don't meet; those that quote one passage are not all
    paired, and copies among them are found all the same."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(n))
    line = lambda between: " ".join(w for _ in range(12) for w in [word(9), word(10), *between])
    common = spark.createDataFrame([(k, line(["of", "the", "a"])) for k in range(60)], "place long, norm string")
    assert line_dedup.meetings(common).count() == 0
    passage = " ".join(word(6) for _ in range(15))
    quoting = [f"{line([])} {passage} {line([])}" for _ in range(300)]
    lines = [*quoting, *(s[:-3] + "xyz" for s in quoting[::60])]
    classes = spark.createDataFrame(list(enumerate(lines)), "place long, norm string")
    met = line_dedup.meetings(classes)
    pairs = line_dedup.other_pairs(met, spark.createDataFrame([], "node long, root long")).collect()
    assert len(pairs) < 10 * len(lines)
    assert {r.node: r.root for r in line_dedup.similar_lines(classes).collect()} == {j: i for i, k in zip(range(0, 300, 60), range(300, 305)) for j in (i, k)}


def test_steps_broadcast_by_measured_sizes(spark):
    """A step is written without broadcasts by estimates, which are those of compressed files before they are exploded."""
    seen, real = [], spark.range(3)
    keys = (common.BROADCAST, common.ADAPTIVE)
    before = [spark.conf.get(k, None) for k in keys]

    class Writer:
        option = lambda self, *_: self

        def parquet(self, path):
            seen.extend(spark.conf.get(k) for k in keys)
            real.write.parquet(path)

    common.unstage(common.stage(SimpleNamespace(sparkSession=spark, schema=real.schema, write=Writer()), "broadcasts"))
    assert seen == ["-1", before[1] or spark.conf.get(common.BROADCAST)] and [spark.conf.get(k, None) for k in keys] == before


def expected_lines(spark, frame):
    text = F.coalesce("text", F.lit(""))
    raw = F.posexplode(F.split(text, "\n")).alias("line", "raw")
    rows = frame.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), raw).withColumn("norm", line_dedup.normalised(F.col("raw"))).withColumn("words", line_dedup.has_words(F.col("norm")))
    place = {(r.id, r.hash, r.line): r.p for r in line_dedup._lines(frame, "text", "doc_id").collect()}
    first, of = {}, {}
    for r in rows.collect():
        own = (r.norm, True) if r.words else (r.raw.strip(" \t\n\v\f\r"), False)
        if own[0]:
            of[r.id, r.h, r.line] = own
            at = place[r.id, r.h, r.line]
            first[own] = min(first.get(own, at), at)
    lines = sorted(first, key=first.get)
    texts = [s for s in lines if s[1]]
    pairs = [(first[texts[i]], first[texts[j]]) for i, j in similar_pairs([s[0] for s in texts])]
    root = components_of(pairs)
    keep = {p for p in first.values() if root.get(p, p) == p}
    out = {}
    for r in frame.select("doc_id", "text", F.xxhash64(text).alias("h")).collect():
        stays = lambda i, r=r: (r.doc_id, r.h, i) not in of or place[r.doc_id, r.h, i] in keep
        out[r.doc_id, r.text] = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if stays(i))
    return out


def check_lines(spark, frame):
    want = expected_lines(spark, frame)
    got = line_dedup.line_dedup(frame.withColumn("old", F.col("text")), report=("lines", "gone"))
    rows = got.collect()
    assert got.columns == [*frame.columns, "old", "lines", "gone"] and len(rows) == frame.count()
    for r in rows:
        assert r.text == want[r.doc_id, r.old], (r.doc_id, r.old)
        assert r.lines == (0 if r.old is None else r.old.count("\n") + 1)
        assert r.gone == 0 if r.old is None else r.text == "" or r.lines - r.gone == r.text.count("\n") + 1
    return rows


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest of the north where nobody lives at all these days"
    near = [base.replace("lazy", "lazi"), base.replace("quick", "quikc"), base + "s", base.upper() + " !!"]
    rows = [(k, f"own line number {chr(97 + k)} of this text\n{x}\n\nend") for k, x in enumerate([base, *near])]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, f"{base}\n{base}\n{base}"), (24, "page 17 of 300 in this book"), (25, "Page 17 of 300, in this book!"), (26, "short"), (27, "short"), (None, base), (28, "x"), (28, "x")]
    got = check_lines(spark, docs(spark, rows))
    assert sum((r.text or "").split("\n").count(base) for r in got) <= 1


def test_line_dedup_on_a_table(spark, sf):
    """Equal lines, at least: all of the table's; what is linked is tested above."""
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in line_dedup.line_dedup(frame.withColumn("old", F.col("text"))).collect()}
    assert len(rows) == frame.count()
    lines = Counter(x.strip() for r in rows.values() for x in (r.text or "").split("\n") if x.strip())
    before = {x.strip() for r in rows.values() for x in (r.old or "").split("\n") if x.strip()}
    assert max(lines.values()) == 1 and len(lines) > 0.8 * len(before) and set(lines) <= before


def test_line_dedup_compares_short_lines_and_digits(spark):
    same = ["Les.", "short", "2024-01-05 12:30:11 4711 0815", "=====", "+49 30 1234567", "}", "é", "Page 17 of 300 in this book"]
    other = ["2024-01-05 12:30:12 4711 0815", "-----", "+49 30 1234568", "{", "Page 99 of 123, in this book!", "Total of row 1204 | 55 | 17", "Total of row 9831 | 20 | 94"]
    got = line_dedup.line_dedup(docs(spark, [(1, "\n".join([*same, "", " ", ""])), (2, "\n".join(same)), (3, "\n".join(other)), (4, " Les.\t\nLes\nPAGE 17 of 300, in this book"), (5, None)])).collect()
    lines = [x.strip() for r in got for x in (r.text or "").split("\n")]
    words = [x.lower().replace(",", "") for x in lines]
    assert all(lines.count(x) == 1 for x in [*same[:7], *other, "Les"]) and words.count("page 17 of 300 in this book") == 1
    assert {r.doc_id: (r.text or "").count("\n") for r in got}[1] >= 2 and sum(r.text is None for r in got) == 1


def test_line_dedup_of_odd_tables(spark):
    assert line_dedup.line_dedup(docs(spark, [])).collect() == []
    clash = docs(spark, [(1, "a line that repeats", 1, "x", 5), (2, "a line that repeats", 2, "y", 6)], ", line int, hash string, __gone int")
    got = {(r.doc_id, r.text, r.line, r.hash, r["__gone"]) for r in line_dedup.line_dedup(clash).collect()}
    assert got == {(1, "a line that repeats", 1, "x", 5), (2, "", 2, "y", 6)} or got == {(1, "", 1, "x", 5), (2, "a line that repeats", 2, "y", 6)}


# Chat


def conversations(rng, n=25):
    words = ["a", "bb", "</turn>", "<turn:x>", "\\", "\\l", "\\\\l/turn>", "<", ">", "\n", "</turn>\n", "ü😀", ""]
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 9)):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
            rows.append((c, k, rng.choice(["system", "user", "assistant", "to<ol>\\"]) if k else rng.choice(["system", "user"]), text))
    return rows


def plain_windows(turns, budget, most_turns, most_tokens):
    """(first, last, first of history) of each window over (role, tokens), by plain loops."""
    head = 1 if len(turns) > 1 and turns[0][0] == "system" else 0
    head_tokens = turns[0][1] if head else 0
    room = max(budget - head_tokens, 0)
    out, k = [], head
    while k < len(turns):
        h = k
        reach = min(most_tokens, max(room - turns[k][1], 0))
        while h > head and k - h < most_turns and sum(t for _, t in turns[h - 1 : k]) <= reach:
            h -= 1
        end = k + 1
        while end < len(turns) and sum(t for _, t in turns[h : end + 1]) <= room:
            end += 1
        out.append((k, end, h))
        k = end
    return head, out


@pytest.mark.parametrize("budget,turns,tokens", [(40, 2, 15), (25, 0, 0), (512, 2, 128), (1, 3, 9)])
def test_windows(spark, budget, turns, tokens):
    rows = conversations(random.Random(budget))
    w = chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history_turns=turns, history_tokens=tokens).collect()
    count = lambda t: len([x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]) + 2
    for c in {r[0] for r in rows}:
        own = [(r[2], count(r[3])) for r in sorted(r for r in rows if r[0] == c)]
        head, want = plain_windows(own, budget, turns, tokens)
        got = sorted((r for r in w if r.conv_id == c), key=lambda r: r.window)
        assert [(r.n_context, r.n_turns) for r in got] == [(head * (k > 0) + a - h, b - a + head * (k == 0)) for k, (a, b, h) in enumerate(want)]
        for r, (a, b, h) in zip(got, want):
            assert r.over_budget == (r.tokens > budget) and (not r.over_budget or b - a == 1)


def test_all_is_read_back(spark):
    rows = conversations(random.Random(9)) + [(90, None, None, None), (90, 1, "assistant", None), (None, 1, "assistant", "x"), (91, 1, "assistant", "same"), (91, 1, "assistant", "same")]
    f = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_windows(chat_format.format_windows(f, budget=30)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.targets == [x[3] for x in own if x[2] == "assistant"]


def test_chat_of_odd_tables(spark):
    assert chat_format.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    clash = spark.createDataFrame([(1, 1, "user", "a", 5, "z")], "conv_id long, turn long, role string, text string, k int, head string")
    assert chat_format.format_windows(clash).first().text == "<turn:user>a</turn>\n"


def test_long_conversation(spark):
    f = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
    r = chat_format.read_windows(chat_format.format_windows(f)).first()
    assert [t.text for t in r.turns] == [f"text {k}" for k in range(6000)] == list(r.targets)


# Components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 3)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
