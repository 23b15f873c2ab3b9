"""Whitening, fingerprints and the filter audit against brute force, on awkward rows and on the smallest tables."""

import hashlib
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from kohort.llm import filter_audit, fingerprints, queries, whitening

SF = "/root/testdata/sf0.001"


def brute_audit(docs, labels, part="lang"):
    """Every order applied to the documents one filter after another."""
    rows = [(r["doc_id"], r["text"] or "", r[part] or "") for r in docs]
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failed = []
    for i, t, p in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        failed.append((i, p, {f for f, no in fails.items() if no}))
    out = {}
    for p in {p for _, p, _ in failed}:
        mine = [(i, s) for i, q, s in failed if q == p]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, s) for i, s in left if f in s]
                left = [(i, s) for i, s in left if f not in s]
                shares[f] += len(gone)
                out[p, "".join(order), step] = (
                    len(left), len(gone), sum(f in s for _, s in mine) - len(gone), sum(s == {f} for _, s in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[p, "".join(order), step] += (shares[f],)
    return out


def audited(df):
    found = [tuple(r) for r in df.collect()]
    got = {r[:3]: r[3:] for r in found}
    assert len(got) == len(found)
    return got


def test_filter_audit(spark):
    long = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "", None), (4, long, "en"), (5, long, "en"), (5, long, "en"), (5, long, "de"), (6, long.upper(), "de"),
        (7, long + " $", "de"), (8, "a b " * 80, "de"), (9, "x" * 100_000, "de"), (None, long, "en"), (None, long, ""), (10, "ÀB é c", None),
        (11, long + "\x0b\x0c\x1c#", "fr"), (0, long, "fr"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, n long, bits int, digest int")
    labels = spark.createDataFrame(
        [(5, 1, 0), (5, 0, 1), (4, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    want = brute_audit(docs.collect(), labels.collect())
    assert audited(filter_audit.filter_audit(docs.repartition(3), labels)) == want
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []
    assert audited(filter_audit.filter_audit(docs, labels.limit(0))) == brute_audit(docs.collect(), [])


def test_shapley_is_the_average_over_orders():
    rng = np.random.default_rng(3)
    for players in (2, 3, 5):
        values = [0, *map(int, rng.integers(0, 10**12, 2**players - 1))]
        orders = list(permutations(range(players)))
        want = [Fraction(0)] * players
        for order in orders:
            s = 0
            for i in order:
                want[i] += Fraction(values[s | 1 << i] - values[s], len(orders))
                s |= 1 << i
        assert filter_audit.shapley(values, players) == want


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + f[:half]
        own, edited, other = (plain_digest(x.encode()) for x in (t, changed, f))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), plain_hex(own), plain_hex(edited), alike(own, edited), alike(own, other)))
    return out


def plain_digest(text):
    counts = [0] * 256
    padded = text + b"\0\0" if text else b""
    for i in range(len(padded) - 2):
        counts[(padded[i] + 256 * padded[i + 1] + 65536 * padded[i + 2]) * 2654435761 % 2**32 >> 24] += 1
    cuts = [sorted(counts)[q] for q in (63, 127, 191)]
    length, step = 0, 1.1
    while step <= len(text):
        length, step = length + 1, step * 1.1
    return length, [sum(c > q for q in cuts) for c in counts]


def plain_hex(d):
    return f"{d[0]:02x}" + "".join(f"{sum(c << s for c, s in zip(d[1][i : i + 4], (6, 4, 2, 0))):02x}" for i in range(0, 256, 4))


def alike(a, b):
    apart = sum(abs(x - y) for x, y in zip(a[1], b[1])) + min(abs(a[0] - b[0]), 32)
    return max(0.0, 1 - apart / 320)


def test_fingerprints(spark, awkward):
    def near(df):
        return sorted(map(tuple, df.collect()), key=repr)

    rows = [(i, None if i == 7 else "x" * (i % 3) + "".join(chr(97 + (i * j * j + 7 * j) % 26) for j in range(i * 11 % 200))) for i in range(1, 60)]
    rows += [(100, "é漢😀" * 30), (101, ""), (102, "a"), (103, "zz"), (None, "first of all"), (-5, "long " * 20_000)]
    for cut in (rows, rows[:1], rows[:2], []):
        df = spark.createDataFrame([(i, t, "p", 1) for i, t in cut], "doc_id long, text string, tie string, place int").repartition(3)
        want = brute_fingerprints([(i, t or "") for i, t in cut])
        assert near(fingerprints.edited_fingerprints(df)) == sorted(want, key=repr)
    # repeated ids: same rows in every run, as many as documents
    once, again = (near(fingerprints.edited_fingerprints(awkward.repartition(n))) for n in (2, 5))
    assert once == again and len(once) == awkward.count()


def test_fingerprint_round_trip_and_bounds():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"ab", bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"the same words " * 40, b"x" * 300_000]
    digests = [fingerprints.digest(t) for t in texts]
    for d in digests:
        assert (fingerprints.from_hex(fingerprints.to_hex(d)) == d).all()
        assert fingerprints.likeness(d, d) == 1
        for other in digests:
            assert 0 <= fingerprints.likeness(d, other) <= 1
            assert fingerprints.likeness(d, other) == fingerprints.likeness(other, d)


def test_near_copies_are_nearer_than_strangers(spark):
    from kohort.llm.common import read

    texts = [r["text"] for r in read(spark, SF, "documents").where("length(text) > 300").collect()]
    digests = [fingerprints.digest(t.encode()) for t in texts]
    changed = [fingerprints.digest((t[:100] + " other words " + t[120:]).encode()) for t in texts]
    own = [fingerprints.likeness(a, b) for a, b in zip(digests, changed)]
    strange = [fingerprints.likeness(a, b) for a, b, s, t in zip(digests, digests[1:], texts, texts[1:]) if s != t]
    assert np.quantile(own, 0.05) > np.quantile(strange, 0.95)


def brute_whitening(vectors, k):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    c = ((n * x - sums) / n).astype(float)
    values, turned = np.linalg.eigh(c.T @ c / n)
    values, turned = values[::-1][:k], turned[:, ::-1][:, :k]
    return deviation, c @ turned / np.sqrt(values), values / (sum(deviation) / n**3)


@pytest.mark.parametrize("wide", [6, 64, 130])
def test_whitening(spark, wide):
    rng = np.random.default_rng(wide)
    x = (rng.normal(size=(300, wide)) @ rng.normal(size=(wide, wide)) * 0.2).astype(np.float32)
    rows = [(i, list(map(float, v)), 7, "s") for i, v in enumerate(x)]
    bad = [(900, None, 1, ""), (901, [None] * wide, 1, ""), (902, [float("nan")] * wide, 1, ""), (903, [float("inf")] + [0.0] * (wide - 1), 1, "")]
    bad += [(904, [], 1, ""), (905, [1.0], 1, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int, s string").repartition(4)
    got = whitening.whiten(df, 32).toPandas()
    k = min(32, wide)
    deviation, white, explained = brute_whitening(x, k)
    assert len(got) == 300 * k and sorted(got.columns) == sorted(c.split()[0] for c in whitening.SCHEMA.split(", "))
    assert (got.n == 300).all() and got.identity_error.max() < 1e-9 and got.residual.max() < 1e-13
    own = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for j in range(k):
        assert min(np.abs(own[:, j] - white[:, j]).max(), np.abs(own[:, j] + white[:, j]).max()) < 1e-6
    assert np.allclose(got[got.vec_id == 5].sort_values("component").explained, explained, rtol=1e-9)
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    # rank one in three dimensions, a repeated row and a null id
    found = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [2.0, 4.0, 5.0])], kind)).collect()
    assert [r.component for r in found] == [1, 1, 1] and {r.n for r in found} == {3}
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in found)


def test_iteration_restarts_and_locks():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 150)) * 0.9 ** np.arange(150)
    a = x.T @ x / 800
    values, vectors = whitening.jacobi_davidson(lambda v: a @ v, 150, 12, float(np.trace(a)), most=30)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:12], rtol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * values[0]
    with pytest.raises(ArithmeticError):
        whitening.jacobi_davidson(lambda v: a @ v, 150, 12, float(np.trace(a)), outer=2, most=30)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a = q * np.linspace(-1, 3, 40) @ q.T
    b = rng.normal(size=(40, 3))
    x = whitening.minres(lambda v, at: a @ v, b, 1e-12, 200)
    assert np.abs(a @ x - b).max() < 1e-9


def test_queries_return_the_contract_columns(spark):
    assert queries.QUERIES["op11_whitening"](spark, SF).columns[:7] == "vec_id component n deviation whitened explained identity_error".split()
    assert queries.QUERIES["op12_fingerprints"](spark, SF).columns == [n for n, _ in fingerprints.FIELDS]
