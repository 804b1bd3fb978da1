"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are summed by membership pattern; a flow takes words from patterns
to the sources' quotas, where the first use of a pattern costs nothing and each further one more than the last. What a
pattern sends is then laid on a tape: use after use of its documents in seeded order of a hash, and each source takes a
stretch. Stretches begin and end at one of 2**20 hash values, found from sums over 2**10 and again 2**10 ranges, so no
source's documents meet in one task, and only sums by pattern and range reach the driver.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

WORD = r"[^\x20\x09-\x0D]+"
FINE = 10
SMALL = 10_000  # rows that may be sent to all executors; larger tables are joined as Spark chooses


def words(text: str | Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_code_point(sources) -> list:
    """Sorted by code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def capped_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """total shared by weight; what is above cap times a source's size is shared again by the others, by weight."""
    out, open_, rest = {}, by_code_point(sizes), float(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / whole if whole else 0.0 for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(cap * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in above]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest of the largest flows, by shortest augmenting paths."""
    to, cap, cost, at = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            at[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    while True:
        dist, via, queued, q = [None] * n, [-1] * n, [False] * n, deque([source])
        dist[source] = 0
        while q:
            x = q.popleft()
            queued[x] = False
            for e in at[x]:
                y = to[e]
                if cap[e] > 0 and (dist[y] is None or dist[x] + cost[e] < dist[y]):
                    dist[y], via[y] = dist[x] + cost[e], e
                    if not queued[y]:
                        queued[y] = True
                        q.append(y)
        if dist[sink] is None:
            return [arcs[i][2] - cap[2 * i] for i in range(len(arcs))]
        path, y = [], sink
        while y != source:
            path.append(via[y])
            y = to[via[y] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: dict, quotas: dict, uses: int) -> dict:
    """patterns: key -> (its sources, its words); quotas: source -> words. (key, source) -> words sent."""
    keys, names = sorted(patterns), by_code_point(quotas)
    number = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    sink = 1 + len(keys) + len(names)
    arcs = [(0, 1 + i, patterns[k][1], u * (u + 1) // 2) for i, k in enumerate(keys) for u in range(uses)]
    first = len(arcs)
    pairs = [(i, k, s) for i, k in enumerate(keys) for s in by_code_point(set(patterns[k][0])) if s in quotas]
    arcs += [(1 + i, number[s], patterns[k][1] * uses, 0) for i, k, s in pairs]
    arcs += [(number[s], sink, int(quotas[s]), 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    return {(k, s): flow[first + j] for j, (_, k, s) in enumerate(pairs)}


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _keyed(docs: DataFrame, id_col: str, sources_col: str, seed: int) -> DataFrame:
    """Adds __key (the pattern) and __h (0 to 2**20 - 1) to docs."""
    kind = dict(docs.dtypes)[sources_col]
    s = F.col(sources_col)
    members = F.array_sort(F.array_distinct(F.when(s.isNull() | (F.size(s) == 0), F.array(F.lit(None).cast("string"))).otherwise(s))) if kind.startswith("array") else F.array(s.cast("string"))
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 2 * FINE)).cast("int")
    return docs.withColumn("__members", members).withColumn("__key", F.to_json("__members")).withColumn("__h", h)


class Plan:
    """What to take: source_size and target by source, and segments (key, first hash, end hash, source), one for each
    stretch of each use of a pattern."""

    def __init__(self, sizes, targets, segments):
        self.sizes, self.targets, self.segments = sizes, targets, segments


def plan(thin: DataFrame, weights=(3, 1, 2), share: float = 1.5, uses: int = 2) -> Plan:
    """thin has __members, __key, __h and __size. weights repeat over the sources in order of code point, null last."""
    rows = thin.groupBy("__key").agg(F.first("__members").alias("m"), F.sum("__size").alias("n")).collect()  # the patterns
    patterns = {r["__key"]: (list(r.m), int(r.n)) for r in rows}
    sizes: dict = {}
    for members, n in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    order = by_code_point(sizes)
    total = sum(n for _, n in patterns.values())
    targets = capped_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share * total, uses)
    sent = route(patterns, {s: round(t) for s, t in targets.items()}, uses)
    # Marks on each pattern's tape, which is `uses` times its words long.
    marks: dict[str, list] = {}
    for k, (members, n) in sorted(patterns.items()):
        at = 0
        for s in by_code_point(set(members)):
            if f := sent.get((k, s), 0):
                marks.setdefault(k, []).append((at, at + f, s))
                at += f
    inner = {k: sorted({y % patterns[k][1] for a, b, _ in v for y in (a, b) if y % patterns[k][1]}) for k, v in marks.items()}
    coarse: dict[str, dict[int, int]] = {}
    for r in thin.groupBy("__key", F.shiftright("__h", FINE).alias("b")).agg(F.sum("__size").alias("n")).collect():  # patterns x 2**FINE
        coarse.setdefault(r["__key"], {})[r.b] = int(r.n)
    spots = {}  # (key, mark) -> (range, words before the range)
    for k, ys in inner.items():
        for y in ys:
            before = 0
            for b in range(1 << FINE):
                n = coarse[k].get(b, 0)
                if before + n >= y:
                    spots[k, y] = (b, before)
                    break
                before += n
    fine: dict = {}
    if spots:
        wanted = sorted({(k, b) for (k, _), (b, _) in spots.items()})
        small = thin.sparkSession.createDataFrame(wanted, "__key string, b int")
        near = thin.withColumn("b", F.shiftright("__h", FINE)).join(_sent(small, len(wanted)), ["__key", "b"])
        for r in near.groupBy("__key", "__h").agg(F.sum("__size").alias("n")).collect():  # marks x 2**FINE
            fine.setdefault((r["__key"], r["__h"] >> FINE), {})[r["__h"]] = int(r.n)
    cut = {}
    for (k, y), (b, before) in spots.items():
        best = (abs(y - before), b << FINE)
        at = before
        for h, n in sorted(fine[k, b].items()):
            at += n
            best = min(best, (abs(y - at), h + 1))
        cut[k, y] = best[1]
    segments = []
    for k, v in marks.items():
        n = patterns[k][1]
        for a, b, s in v:
            for use in range(uses):
                lo, hi = max(a, use * n), min(b, (use + 1) * n)
                if lo < hi:
                    x = cut[k, lo % n] if lo % n else 0
                    y = cut[k, hi % n] if hi % n else 1 << 2 * FINE
                    if x < y:
                        segments.append((k, x, y, s))
    return Plan(sizes, targets, segments)


def _with_uses(keyed: DataFrame, p: Plan) -> DataFrame:
    """Adds __uses: the source of each use of the document, once for each."""
    spark = keyed.sparkSession
    by_key: dict = {}
    for k, a, b, s in p.segments:
        by_key.setdefault(k, []).append((a, b, s))
    small = spark.createDataFrame(sorted((k, v) for k, v in by_key.items()), "__key string, __segments array<struct<a:int,b:int,s:string>>")
    joined = keyed.join(_sent(small, len(by_key)), "__key", "left")  # patterns x their sources x uses
    inside = F.filter("__segments", lambda x: (x["a"] <= F.col("__h")) & (F.col("__h") < x["b"]))
    return joined.withColumn("__uses", F.coalesce(F.transform(inside, lambda x: x["s"]), F.array().cast("array<string>")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", weights=(3, 1, 2),
    share: float = 1.5, uses: int = 2, seed: int = 1,
) -> DataFrame:
    """docs as often as the mix uses them (not at all, or up to `uses` times), with the same columns. sources_col is a
    source or an array of sources; null, or none, is a source of its own. Documents with one id share their fate. A
    document without words is used wherever its hash falls. Empty tables stay empty. See plan() for the weights."""
    keyed = _keyed(docs, id_col, sources_col, seed)
    thin = stage(keyed.select("__members", "__key", "__h", words(text_col).alias("__size")), "mix-sizes")
    out = _with_uses(keyed, plan(thin, weights, share, uses)).withColumn("__use", F.explode("__uses"))
    return out.select(*docs.columns)


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", weights=(3, 1, 2),
    share: float = 1.5, uses: int = 2, seed: int = 1,
) -> DataFrame:
    """One row per row of docs: id_col, size, members array<string>, uses array<string> (the source of each use)."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(sources_col).alias("__s"), F.col(text_col).alias("__t"))
    keyed = _keyed(rows, "__id", "__s", seed).select("__id", "__members", "__key", "__h", words("__t").alias("__size"))
    thin = stage(keyed, "mix-sizes")
    p = plan(thin, weights, share, uses)
    out = _with_uses(thin, p)
    spark = docs.sparkSession
    facts = [(s, int(p.sizes[s]), float(p.targets[s])) for s in by_code_point(p.sizes)]
    rows, facts = len(facts), spark.createDataFrame(facts, "__s string, source_size long, target double")  # a row per source
    first = F.element_at("__members", 1)
    out = out.withColumn("__s1", first).join(_sent(facts, rows), F.col("__s1").eqNullSafe(F.col("__s")), "left")
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__members").alias("members"), F.col("__uses").alias("uses"), "source_size", "target")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("uses")).alias("taken"))
