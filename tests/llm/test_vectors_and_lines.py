"""Centroid clustering, vector codes and line dedup against brute force, on rows with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symbridge.llm import centroids, lines, shared, vector_codes, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=0, n=150, size=64):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # few distinct values, so that distances tie
        v = [rng.choice([-0.25, -0.004, 0.0, 0.26, 0.5]) if i % 3 else rng.gauss(0, 0.3) for _ in range(size)]
        out.append((i, v, None if i % 5 == 0 else i % 4))
    out += [(n, out[7][1], 1), (n + 1, out[7][1], 1), (8, out[8][1], 0), (None, out[9][1], 2)]  # copies, a repeated row, no id
    nan, inf = float("nan"), float("inf")
    return out + [(n + 2, None, 1), (n + 3, [], 1), (n + 4, [0.1] * 63, 1), (n + 5, [0.1] * 65, 1), (n + 6, [nan, *[0.1] * 63], 1), (n + 7, [inf, *[0.1] * 63], 1), (n + 8, [None, *[0.1] * 63], 1), (n + 9, [0.1] * 63 + [-inf], None)]


def kept_vectors(rows, scale):
    single = lambda x: float(np.float32(x))
    return [(i, [int(np.floor(scale * single(x))) for x in v], label) for i, v, label in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]


def distance(x, c):
    return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))


def nearest(x, entries):
    return min((distance(x, c), j) for j, c in enumerate(entries))


def means(members, before):
    return [[sum(z) // len(m) for z in zip(*m, strict=True)] if (m := members.get(j)) else c for j, c in enumerate(before)]


def with_clashes(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def signed_bytes(v):
    return np.array(v, "<i4").tobytes()


# 11 centroid clustering


def expected_clusters(rows):
    kept = kept_vectors(rows, 64)
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), signed_bytes(r[1]))
    books = [v for _, v, _ in sorted(kept, key=key)[:16]]
    for _ in range(3):
        members = collections.defaultdict(list)
        for _, v, _ in kept:
            members[nearest(v, books)[1]].append(v)
        books = means(members, books)
    at = [(i, *nearest(v, books)) for i, v, _ in kept]
    per = collections.Counter()
    for _, d, j in at:
        per[j] += d
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in books]
    return sorted(((i, j, d, per[j], sum(per.values()), told[j]) for i, d, j in at), key=str)


@pytest.mark.parametrize("n", [150, 5])
def test_clusters_equal_brute_force(spark, n):
    rows = vector_rows(n=n) if n > 10 else vector_rows()[:n]
    df = with_clashes(spark.createDataFrame(rows, VECTORS), "v", "norms", "square", "cluster", "key", "distance")
    got = centroids.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected_clusters(rows)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    for none in (df.limit(0), df.where("embedding IS NULL OR size(embedding) <> 64")):
        out = centroids.cluster(none)
        assert out.count() == 0 and out.columns == [c.split()[0] for c in centroids.RESULT.split(", ")]


def test_block_norms_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 4000, (16, 64)) * (rng.random((16, 64)) < 0.15)  # sparse and of one sign, as counts of words are
    v = base[rng.integers(0, 16, 3000)] + rng.integers(0, 60, (3000, 64))
    cluster, d, exact = centroids.nearest(v, centroids.norms(v), np.einsum("nd,nd->n", v, v), base)
    full = ((v[:, None] - base[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()
    assert exact < 0.2 * full.size
    same = np.zeros((40, 64), np.int64)  # all at one place: every bound and distance ties
    assert (centroids.nearest(same, centroids.norms(same), np.zeros(40, np.int64), np.zeros((16, 64), np.int64))[0] == 0).all()


def test_bounds_hold_for_large_components():
    rng = np.random.default_rng(3)
    v = rng.integers(-vectors.LARGEST, vectors.LARGEST, (300, 64))
    c = np.concatenate([v[:8] + rng.integers(-1, 2, (8, 64)), v[:8]])
    cluster, d, _ = centroids.nearest(v, centroids.norms(v), np.einsum("nd,nd->n", v, v), c)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()


def test_too_large_components_raise():
    with pytest.raises(ValueError, match="over"):
        vectors.integers(pa.array([[1e30] * 64]), 64, 64)


# 12 vector codes


def expected_codes(rows):
    kept = kept_vectors(rows, 256)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, signed_bytes(r[1])))
    part = lambda v, p: v[4 * p : 4 * p + 4]
    books = [[part(v, p) for _, v, _ in order[:64]] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            members = collections.defaultdict(list)
            for _, v, _ in kept:
                members[nearest(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = means(members, books[p])
    out, per = [], collections.Counter()
    for i, v, label in kept:
        at = [nearest(part(v, p), books[p]) for p in range(16)]
        error = sum(d for d, _ in at)
        per[label] += error
        out.append((i, "".join(f"{j:02x}" for _, j in at), error, label))
    told = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, per[label], told) for i, code, e, label in out), key=str)


@pytest.mark.parametrize(("n", "small"), [(150, True), (150, False), (30, True)])
def test_codes_equal_brute_force(spark, monkeypatch, n, small):
    if not small:  # labels are too many to be broadcast, and one is hot
        monkeypatch.setattr(shared, "MOST_LOOKED_UP", 0)
        monkeypatch.setattr(shared, "MOST_HOT", 1)
    rows = vector_rows(seed=1)[: n if n < 100 else None]
    df = with_clashes(spark.createDataFrame(rows, VECTORS), "v", "entry", "upper", "lower", "code", "n", "_label", "_found")
    got = vector_codes.encode(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected_codes(rows)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    for none in (df.limit(0), df.where("embedding IS NULL OR size(embedding) <> 64")):
        out = vector_codes.encode(none)
        assert out.count() == 0 and out.columns == [c.split()[0] for c in vector_codes.RESULT.split(", ")]


@pytest.mark.parametrize("reach", [6, 300, 1 << 25])
def test_bounds_prune_and_keep_ties(reach):
    rng = np.random.default_rng(reach)
    x = rng.integers(-reach, reach, (4000, 4))
    book = x[:64].copy()
    book[10], book[50] = book[3], book[3]  # equal entries
    entry, upper, lower = vector_codes.begun(x, book)
    for _ in range(4):
        sums = np.zeros((64, 4), np.int64)
        np.add.at(sums, entry, x)
        new = vectors.floor_means(sums, np.bincount(entry, minlength=64), book)
        entry, upper, lower, exact = vector_codes.moved_on(x, entry, upper, lower, book, new)
        book, full = new, ((x[:, None] - new[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= full.min(1) * (1 - 1e-15)).all() and (lower.astype(float) ** 2 <= full * (1 + 1e-15)).all()
        assert exact < 0.5 * full.size or reach == 1 << 25  # beyond 65504, where lower bounds end, fewer are pruned


def test_state_goes_through_a_shared_table(spark):
    """What a round needs is in its table: the next one can begin from there on other executors."""
    rows = vector_rows(seed=2)
    kept = spark.createDataFrame([(i, v) for i, v, _ in kept_vectors(rows, 256)], "vec_id long, v array<int>")
    assert kept.count() > 64
    x = np.array([v for _, v, _ in kept_vectors(rows, 256)]).reshape(-1, 16, 4)
    for kind, m in (("<i4", x.astype("<i4")), ("<f2", x.astype("<f2"))):
        column = vectors.packed(m.reshape(len(m), -1))
        assert (vectors.unpacked(column.slice(3, 20), kind, 16, 4) == m[3:23]).all()
    assert vectors.unpacked(vectors.packed(x[:0].reshape(0, 64)), "<i8", 16, 4).shape == (0, 16, 4)


def test_rows_of_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_LOOKED_UP", 0)
    monkeypatch.setattr(shared, "MOST_HOT", 1)
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.max("id").alias("v"), F.count("*").alias("n")).where("k % 20 <> 0")
    out = shared.looked_up(rows, keyed, ["k"], ["v"])
    assert out.columns == ["k", "id", "v"]
    assert out.agg(F.count("*"), F.count("v"), F.count_if(F.col("v") == 29_999)).first() == (30_000, 28_500, 27_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shared.looked_up(rows, keyed, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
        assert all("_spread" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) and "Exchange hashpartitioning" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# 13 lines

DOCS = "doc_id long, text string"


def line_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéßÉK", k=rng.randint(3, 9)))
    shared_lines = [" ".join(word() for _ in range(9)) for _ in range(6)] + ["x" * 39, "y" * 40, "Ünïcode Line " * 4, "kelvin K sign İ line that is long enough to count"]
    dress = lambda s: rng.choice(["", " ", "\t", "\r", "\x0b "]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", "  ", "\x0c", "\r"])
    out = []
    for i in range(60):
        own = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        own += [dress(rng.choice(shared_lines)) for _ in range(rng.randint(0, 5))]
        rng.shuffle(own)
        out.append((i, "\n".join(own) + rng.choice(["", "\n", "\n\n"])))
    lone = "this line stands many times in one single document"
    four = "this line stands in four documents, which is too few"
    again = "this line stands in rows of one repeated identifier"
    out += [(100, "\n".join([lone] * 50)), *((101 + i, four + "\nz") for i in range(4)), *((200, again + f"\n{i}") for i in range(7)), (201, ""), (202, None), (203, "\n"), (None, shared_lines[0] + "\nnull id"), (None, shared_lines[0])]
    return out + [(204, "y" * 40), (205, "Y" * 40 + " " * 100), out[3], (206, "\n".join(["y" * 40, "w" * 50_000, *["tick"] * 20_000, "Y" * 40])), *((300 + i, "k" * 40 if i % 2 else "K" * 40) for i in range(6))]


def expected_lines(rows, least=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(lower)
    number = lambda i: shared.NULL_ID if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(number(i))
    out = []
    for i, t in rows:
        each = (t or "").split("\n")
        stay = [s for s in each if len(key(s)) < 40 or len(held[key(s)]) < least or max(held[key(s)]) == number(i)]
        out.append((i, len(each), len(each) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_lines_equal_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(shared, "MOST_LOOKED_UP", 0)
        monkeypatch.setattr(shared, "MOST_HOT", 2)
    df = with_clashes(spark.createDataFrame(line_rows(), DOCS), "h1", "h2", "pos", "line", "_id", "_key", "n", "holder", "dropped", "_n")
    want = expected_lines(line_rows())
    assert sum(r[2] for r in want) > 50
    assert sorted(map(tuple, lines.deduplicate(df).collect()), key=str) == want
    assert sorted(map(tuple, lines.deduplicate(df, 1, 2).collect()), key=str) != want
    assert lines.deduplicate(df.limit(0)).count() == 0


def test_line_dedup_is_native(spark):
    out = lines.deduplicate(spark.createDataFrame(line_rows(), DOCS).select(F.col("doc_id"), F.col("text")).where("doc_id > 0"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
