"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints of 64 bits are cut into partitions of correlated bits. For Hamming distance tau and
m partitions, any thresholds that sum to tau - m + 1 (a threshold of -1 skips the partition) find
every link: if a pair were beyond its threshold in every partition, its distance would be above
tau. Each fingerprint gets its own thresholds by dynamic programming over the estimated number of
candidates and probes; it then probes the inverted index (partition, value), and candidates are
verified on all 64 bits.

Dense groups: an index bucket with more than ``bucket_cap`` fingerprints is not paired at all.
Its members, and whoever probes it, meet on *pivots* instead: the fingerprints at distance 1 or
less from them. Two fingerprints differ in at most two bits exactly when they share a pivot, so a
star on each pivot keeps every connection with rows linear in the group. (Only for tau = 2, where
the pivot radius is 1.)

Edge cases: null or wordless text has fingerprint 0 and links like any other; repeated rows share
a fingerprint; a null doc_id gets the component's smallest non-null doc_id (null if none); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, append_arrow, fresh, shared_root, split_by, written

SEED = 42
BITS = 64
SHINGLE = 3
TAU = 2
BUCKET_CAP = 32
CELL_BITS = 12


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - width + 1
        digest, seed = xxhash.xxh64_intdigest, SEED
        hashes = np.fromiter(
            [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], np.uint64, n
        )
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at : at + 65536].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            values = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(values))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def bit_statistics(fps: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all distinct fingerprints: how often each pair of bits is set together, each bit alone, and the count.

    Each task sends 2,080 partial sums, which are added up before they reach the driver.
    """
    upper = [(a, b) for a in range(BITS) for b in range(a, BITS)]
    ia, ib = np.array([p[0] for p in upper]), np.array([p[1] for p in upper])

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            x = np.unpackbits(v.byteswap().view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += (x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]).astype(np.float64)
            n += len(v)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.arange(len(ia)), -1)), pa.array(np.append(total[ia, ib], n).astype(np.int64))], ["k", "n"]
            )

    got = dict(fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect())
    both = np.zeros((BITS, BITS))
    both[ia, ib] = [got.get(k, 0) for k in range(len(ia))]
    both = np.maximum(both, both.T)
    return both, np.diag(both).copy(), int(got.get(-1, 0))


def group_bits(both: np.ndarray, single: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of near-equal width; each is grown greedily from the most correlated free bits."""
    if n == 0:
        corr = np.zeros((BITS, BITS))
    else:
        p = single / n
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        sub = corr[np.ix_(free, free)]
        a = int(np.argmax(sub.max(1))) if len(free) > 1 else 0
        group = [free.pop(a)]
        while len(group) < width:
            best = max(range(len(free)), key=lambda i: (corr[free[i], group].sum(), -free[i]))
            group.append(free.pop(best))
        groups.append(sorted(group))
    return groups


def partition_count(n: int) -> int:
    """Fewest probes for n distinct fingerprints: three partitions of 21 bits while their buckets stay small, else two of 32."""
    cost = {m: (m if m > 2 else 1 + 33 + 1) + m * n / 2.0 ** (BITS // m) for m in (2, 3)}
    return min(cost, key=cost.get)


def gather(values: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group (0 = most significant bit), packed into one integer."""
    out = np.zeros(len(values), dtype=np.uint64)
    for b in group:
        out = (out << np.uint64(1)) | ((values >> np.uint64(63 - b)) & np.uint64(1))
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """Masks with ``radius`` set bits or fewer; the empty mask first."""
    return np.array(
        [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.uint64
    )


def allocate(values: list[np.ndarray], widths: list[int], cells: list[np.ndarray], tau: int) -> np.ndarray:
    """Thresholds per fingerprint and partition, of least estimated cost, that sum to tau - m + 1.

    Cost of threshold t in a partition: its probes plus the candidates estimated from counts of
    the leading ``CELL_BITS`` bits. The dynamic program runs over partitions; its state is the sum
    used so far, its choices -1 to tau.
    """
    m, n = len(values), len(values[0]) if values else 0
    budget, shift = tau - m + 1, m  # sums are kept non-negative by adding 1 per partition
    choices = list(range(-1, tau + 1))
    costs = []
    for v, w, c in zip(values, widths, cells):
        low = max(0, w - CELL_BITS)
        lead = v >> np.uint64(low)
        near = c[lead.astype(np.int64)].astype(np.float64) / 2.0**low
        flips = sum(c[(lead ^ np.uint64(1 << b)).astype(np.int64)] for b in range(min(w, CELL_BITS))) / 2.0**low
        per = {-1: np.zeros(n), 0: 1 + near}
        for t in range(1, tau + 1):
            probes = len(ball(w, t))
            per[t] = probes + near * len(ball(low, t)) + flips * len(ball(low, t - 1))
        costs.append(per)
    best = {0: np.zeros(n)}
    trail: list[dict[int, np.ndarray]] = []
    for per in costs:
        nxt: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for used, cost in best.items():
            for t in choices:
                s = used + t + 1
                if s > budget + shift:
                    continue
                total = cost + per[t]
                if s not in nxt:
                    nxt[s], pick[s] = total.copy(), np.full(n, t)
                else:
                    less = total < nxt[s]
                    nxt[s][less], pick[s][less] = total[less], t
        best = nxt
        trail.append(pick)
    out, state = np.zeros((m, n), dtype=np.int64), np.full(n, budget + shift)
    for k in range(m - 1, -1, -1):
        t = np.zeros(n, dtype=np.int64)
        for s, p in trail[k].items():
            t[state == s] = p[state == s]
        out[k], state = t, state - t - 1
    return out


def _cells(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Counts of the leading CELL_BITS bits of each partition: m x 4,096 numbers whatever the input."""

    def run(batches):
        sums = [np.zeros(1 << CELL_BITS, dtype=np.int64) for _ in groups]
        for b in batches:
            v = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for s, g in zip(sums, groups):
                s += np.bincount((gather(v, g) >> np.uint64(max(0, len(g) - CELL_BITS))).astype(np.int64), minlength=1 << CELL_BITS)
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(at + (k << CELL_BITS)), pa.array(s[at])], ["k", "n"])

    out = [np.zeros(1 << CELL_BITS) for _ in groups]
    for k, n in fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k >> CELL_BITS][k & ((1 << CELL_BITS) - 1)] = n
    return out


def links(fps: DataFrame, tau: int = TAU, bucket_cap: int = BUCKET_CAP, m: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``tau`` bits that keep every component.

    ``fps`` must be a written or checkpointed frame with distinct ``fp``. Pairs of small buckets
    come out one by one; a bucket over ``bucket_cap`` comes out as stars on its pivots, whose ends
    need not be the linked pair itself but are always linked to each other.
    """
    if not 1 <= tau <= 2:
        raise ValueError("links: pivots cover distances 1 and 2 only")
    both, single, n = bit_statistics(fps)
    groups = group_bits(both, single, n, m or partition_count(n))
    cells = _cells(fps, groups)
    widths = [len(g) for g in groups]

    def index(batches):
        for b in batches:
            v = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for k, g in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), k, np.int32)), pa.array(_signed(gather(v, g))), pa.array(_signed(v))], ["part", "value", "y"]
                )

    def probe(batches):
        for b in batches:
            v = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            own = [gather(v, g) for g in groups]
            least = allocate(own, widths, cells, tau)
            for k, w in enumerate(widths):
                for t in range(0, tau + 1):
                    at = np.flatnonzero(least[k] == t)
                    if len(at) == 0:
                        continue
                    masks = ball(w, t)
                    for lo in range(0, len(at), 4096):
                        some = at[lo : lo + 4096]
                        keys = (own[k][some][:, None] ^ masks[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), k, np.int32)), pa.array(_signed(keys)), pa.array(_signed(np.repeat(v[some], len(masks))))],
                            ["part", "value", "x"],
                        )

    one = fps.select("fp")
    idx = one.mapInArrow(index, "part int, value long, y long")
    prb = one.mapInArrow(probe, "part int, value long, x long")
    counts = idx.groupBy("part", "value").agg(F.count("*").alias("n"))
    cold = counts.filter(F.col("n") <= bucket_cap).select("part", "value")
    hot = counts.filter(F.col("n") > bucket_cap).select("part", "value")
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= tau
    pairs = (
        idx.join(cold, ["part", "value"], "left_semi")
        .join(prb, ["part", "value"])
        .filter((F.col("x") != F.col("y")) & close)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    dense = (
        idx.join(hot, ["part", "value"], "left_semi").select(F.col("y").alias("fp"))
        .union(prb.join(hot, ["part", "value"], "left_semi").select(F.col("x").alias("fp")))
        .distinct()
    )
    masks = [0] + [(1 << b) if b < 63 else -(1 << 63) for b in range(BITS)]
    pivots = dense.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in masks])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("pivot")
    )
    if tau == 1:  # one of the two is the pivot itself
        pivots = pivots.filter(F.col("fp") <= F.col("pivot"))
    lead = pivots.groupBy("pivot").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter(F.col("n") > 1)
    stars = pivots.join(lead, "pivot").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars).distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Every round each root hooks to its smallest neighbouring root below it, chains of roots are
    shortened by pointer jumping, and edges are renamed to their roots. Only counts reach the
    driver; each round is written to the shared folder.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct(), "edges")
    label = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "label")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return label
        hook = (
            edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
            .groupBy("a").agg(F.min("b").alias("low"))
            .select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        )
        hook = written(hook, "hook")
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), "hook")
            more = not jumped.filter("moved").isEmpty()
            hook = jumped.select("node", "up")
            if not more:
                break
        label = written(
            label.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "label"
        )
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = written(
            edges.join(left, "a").join(right, "b").filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    raise RuntimeError("components: no end within the round limit")


def _classes(docs: DataFrame, tau: int = TAU, bucket_cap: int = BUCKET_CAP, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each document, and (fp, component_id, root) of each fingerprint."""
    shared_root(docs.sparkSession)
    per_doc = written(fingerprints(docs, width), "fingerprints")
    per_fp = written(per_doc.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(per_fp, tau, bucket_cap))
    grouped = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    best = grouped.filter("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    # Fingerprints without a link have no root; they are their own class and stay out of the join.
    final = grouped.filter("root is not null").join(best, "root").select("fp", F.col("least").alias("component_id"), "root")
    final = written(final.union(grouped.filter("root is null").select("fp", "low", "fp")), "classes")
    return per_doc, final


def simhash_components(docs: DataFrame, tau: int = TAU, bucket_cap: int = BUCKET_CAP, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document, near-duplicate classes by smallest doc_id."""
    per_doc, final = _classes(docs, tau, bucket_cap, width)
    return per_doc.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One of the ``rows`` for each ``key``, that with the smallest text; combined in the map task first."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*cols))).alias("row")).select(key, "row.*")


def near_dedup(docs: DataFrame, width: int = SHINGLE, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: that with the smallest doc_id.

    Rows with a null doc_id can't be named by a class; where no row of their class has an id, one of
    them stays, and else none. Rows that repeat a doc_id count as one document. Only texts that go or
    repeat a doc_id are shuffled (and others that share their bits of a bitmap).
    """
    per_doc, final = _classes(docs, width=width, **how)
    named = docs.filter("doc_id is not null")
    classes = per_doc.filter("doc_id is not null").join(final, "fp")
    seen = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    seen = written(seen.filter("not stays or n > 1"), "seen")
    out, rest = split_by(named, "doc_id", seen.select("doc_id"))
    out = out.unionByName(_one_each(rest, "doc_id").join(seen.filter("not stays").select("doc_id"), "doc_id", "left_anti").select(*docs.columns))
    nameless = final.filter("component_id is null").select("fp", "root")
    if nameless.isEmpty():
        return out
    fp, root = fresh(docs.columns, "fp"), fresh(docs.columns, "root")
    marked = append_arrow(docs.filter("doc_id is null"), "text", [T.StructField(fp, T.LongType())], lambda texts: [pa.array(_signed(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)))])
    # One for each fingerprint first: one that many rows share then does not weigh on the join.
    some = _one_each(marked, fp).join(nameless.select(F.col("fp").alias(fp), F.col("root").alias(root)), fp).drop(fp)
    return out.unionByName(_one_each(some, root).select(*docs.columns))
