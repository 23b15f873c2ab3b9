"""Each operator against a brute-force version, on awkward rows and on the smallest tables."""

import gzip
import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import oracle
import pyarrow.fs as fs
import pytest
from kohort.llm import exact_dedup, features, jaccard, licenses, mixing, neighbours, packing, quality, queries, quotations, token_counts, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(name))


def multiset(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name]) is None


def test_token_counts(awkward):
    own, path = tokenizer("byte_bpe_50k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    want = [
        (r.doc_id, len((r.text or "").encode()), (n := len(own.encode(r.text or "", add_special_tokens=False).ids)), n > 1024)
        for r in awkward.select("doc_id", "text").collect()
    ]
    # a head of three words sends nearly everything through the join
    for head in (3, 131_072):
        assert multiset(map(tuple, token_counts.token_counts(awkward, path, head=head).collect())) == multiset(want)
    assert token_counts.token_counts(awkward.limit(0), path).collect() == []


def test_exact_duplicates(awkward):
    texts = defaultdict(list)
    for r in awkward.select("doc_id", "text").collect():
        texts[(r.text or "").translate(LOW)].append(r.doc_id)
    found = exact_dedup.exact_duplicates(awkward).collect()
    assert len(found) == sum(map(len, texts.values()))
    kept = [r for r in found if r.kept]
    assert len(kept) == len(texts)
    for text, ids in texts.items():
        own = [r for r in found if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        largest = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in own} == {(largest, len(ids))}
    left = exact_dedup.drop_exact(awkward)
    assert left.columns == awkward.columns
    assert multiset(r.doc_id for r in left.select("doc_id").collect()) == multiset(r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(awkward.limit(0)).collect() == []


def test_index_outlives_its_batch(spark, frame):
    index = exact_dedup.new_index(spark, 4)
    for rows in ([(1, "a"), (2, "A"), (3, "b")], [(9, "a"), (4, "c"), (5, "c")]):
        index.append(exact_dedup.digests(frame(rows)))
    assert sorted(r.keep_id for r in index.table().collect()) == [2, 3, 5]
    again = exact_dedup.DigestIndex(spark, index.name + "_b", spark.sql(f"DESCRIBE EXTENDED {index.name}").where("col_name = 'Location'").first()[1], 4)
    assert again.table().count() == 3


def test_warc(frame):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (7, "v", "<p>é</p>"), (4, "u", "x" * 300_000), (None, "n", "null id")]
    pages = frame(rows, "page_id long, url string, html string")
    found = [tuple(r) for r in warc.archive_pages(pages, archive_bytes=10).collect()]
    sha = lambda t: warc.sha1_base32((t or "").encode())
    want = [
        (1, 0, sha(""), "revisit", 2), (2, 0, sha(""), "response", None), (3, 9, sha("<p>é</p>"), "revisit", 7),
        (3, 9, sha("<p>é</p>"), "revisit", 7), (7, 9, sha("<p>é</p>"), "response", None), (4, 300_000, sha("x" * 300_000), "response", None),
        (None, 7, sha("null id"), "response", None),
    ]
    assert multiset(found) == multiset(want)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_normaliser_writes_members_and_index(tmp_path):
    blocks = [b"one", b"", b"two\r\n\r\nWARC/1.0\r\n", b"x" * 100_000]
    whole = b"".join(warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:{i}>"}, b) for i, b in enumerate(blocks))
    source, target = tmp_path / "in.warc.gz", tmp_path / "out.warc.gz"
    source.write_bytes(gzip.compress(whole))
    index = warc.normalise(f"file://{source}", f"file://{target}")
    raw = target.read_bytes()
    assert gzip.decompress(raw) == whole
    for x, block in zip(index, blocks, strict=True):
        packer = zlib.decompressobj(31)
        assert packer.decompress(raw[x["offset"] : x["offset"] + x["length"]]).endswith(block + b"\r\n\r\n")
        assert packer.eof and not packer.unused_data
    assert (tmp_path / "out.warc.gz.idx").read_text().count("\n") == len(blocks)
    assert fs.FileSystem.from_uri(f"file://{target}")


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("SPDX License Identifier list. MIT License", "mit", 0.95),
        ("SPDX-License-Identifier: MIT\nGNU General Public License", "gpl,mit", 0.3),
        ("SPDX-License-Identifier: LicenseRef-X\nAll rights reserved.", "licenseref-x,proprietary", 0.0),
        ("SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0", "apache,gpl,mit", 0.9),
        ("spdx-license-identifier: MIT\nSPDX-License-Identifier: GPL-2.0-or-later WITH x", "gpl-with-x,mit", 0.65),
        ("SPDX-License-Identifier:", "", 0.0),
        ("no licence at all", "", 0.0),
    ],
)
def test_strictest_of_expressions_and_notices(frame, text, labels, score):
    row = licenses.license_scan(frame([(1, text)])).first()
    assert (row.labels, row.score) == (labels, score)


def test_licences(awkward):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.license_scan(awkward.where("doc_id IS NOT NULL")).join(awkward.select("doc_id", "text"), "doc_id").collect():
        words = word.findall((r.text or "").translate(LOW))
        hits = [(i, licenses.BASE[p]) for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want = (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == want
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    "expression, labels, freedom",
    [
        ("MIT", {"mit"}, 0.95),
        ("GPL-3.0-only OR MIT", {"gpl", "mit"}, 0.95),
        ("MIT AND GPL-2.0+ OR Apache-2.0", {"mit", "gpl", "apache"}, 0.9),
        ("MIT AND (GPL-2.0 OR Apache-2.0)", {"mit", "gpl", "apache"}, 0.9),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", {"gpl-with-classpath-exception-2.0", "mit"}, 0.65),
        ("MIT )", {"mit"}, 0.95),
        ("( MIT", {"mit"}, 0.95),
        ("MIT AND", {"mit"}, 0.95),
        ("", set(), None),
    ],
)
def test_expressions(expression, labels, freedom):
    assert licenses.evaluate(expression) == (labels, freedom)


def test_quotations(frame):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a list?"), (1, 1, "assistant", "> How do I sort a list?\nUse sorted().\nIt is stable."),
        (1, 2, "user", "On Monday, bot wrote:\n>> How do I sort a list?\n> Use sorted().\n> It is stable.\n\nThanks!\n> nothing known"),
        (1, 3, "user", "> Hello   THERE.\n> How do I sort a list?\nme too"), (1, 3, "user", "> Hello   THERE.\n> How do I sort a list?\nme too"),
        (1, 400, None, ">>> Use sorted().\n\n\nok\r\n> ok"), (None, 0, "user", "a"), (None, 1, "x", "> a\nb"), (2, None, "user", None),
        (2, None, "user", "  "), (2, 1, "user", ""), (2, 2, "user", ">"), (2, 3, "u", "> \n>> a > b\n>c\n>c\nÉ"), (2, 4, "u", "c"),
        (2, 5, "u", "> É\n> c\nwrote:\n> c\nlater wrote:"), (2, 6, "u", "a > b\n> a > b"), (3, 0, "u", "long " * 50_000),
    ]
    table = frame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    found = quotations.chat(table.withColumn("message", F.lit(1)))
    assert oracle.compare(found, con, queries.ORACLES["op10_quotation_chat"]) is None
    told = {(r.conv_id, r.turn): (r.reply_to, r.body) for r in found.collect()}
    assert told[1, 2] == (1, "Thanks!") and told[1, 1][0] == 0 and told[None, 1] == (0, "b")
    assert quotations.chat(table.limit(0)).collect() == []


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(a):
        return a if up[a] == a else find(up[a])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        own = [x for x in (least.get(find(a)), i) if x is not None]
        least[find(a)] = min(own, default=None)
    return [(i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def near(frame):
    """Chains of edits of a few texts, so that links must be followed, some phrases common to all, and the awkward rows."""
    random = np.random.default_rng(3)
    rows = []
    for base in range(4):
        words = [f"w{x}" for x in random.integers(0, 400, 40 + 30 * base)]
        for i in range(40):
            rows.append((len(rows) + 100, " ".join(["all", "share", "this", "phrase", *words])))
            words = list(words)
            for _ in range(random.integers(0, 4)):
                words[random.integers(0, len(words))] = f"e{random.integers(0, 50)}"
    return rows


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50), (1, 100)])
def test_jaccard_components(frame, near, awkward, k, percent, monkeypatch):
    # small blocks, so that groups are cut
    monkeypatch.setattr(jaccard, "PREFIX_BLOCK", 8)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 8)
    rows = near + [(r.doc_id, r.text) for r in awkward.collect()]
    found = jaccard.jaccard_components(frame(rows).repartition(5), k, percent)
    assert multiset(map(tuple, found.collect())) == multiset(brute_components(rows, k, percent))


def test_drop_near_keeps_one_of_each(frame, near, awkward):
    rows = near + [(r.doc_id, r.text) for r in awkward.collect()]
    docs = frame([(i, t, i) for i, t in rows], "doc_id long, text string, slot long").repartition(5)
    want = {c for _, n, c in brute_components(rows, 5, 80) if n}
    left = jaccard.drop_near(docs)
    assert left.columns == docs.columns
    found = [r.doc_id for r in left.where("length(trim(text)) > 0 AND text RLIKE '[^\\\\s]'").select("doc_id").collect()]
    assert multiset(found) == multiset(want)
    # texts without words are linked with nothing and stay
    assert left.count() - len(found) == sum(n == 0 for _, n, _ in brute_components(rows, 5, 80))
    assert jaccard.drop_near(docs.limit(0)).collect() == []


def test_neighbours(frame, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    random = np.random.default_rng(0)
    x = random.normal(size=(600, 12))
    x[50:90] = x[0]  # a copy group larger than k
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [None, *[1.0] * 11], [float("inf")] * 12, [1.0, 2.0]]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + 100 * i, v) for i, v in enumerate(odd)] + [(5, [float(v) for v in x[5]]), (None, [1.0] * 12)]
    table = frame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.nearest(table, k=10, tables=16, probes=16).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.argsort(d, kind="stable")[:10]
        assert [r[0] for r in found[q]] == list(range(1, 11))
        assert all(math.isclose(s, d[v], abs_tol=1e-12) for _, v, s in found[q])
        hits += len(set(best) & {v for _, v, _ in found[q]})
    assert [v for _, v, _ in found[0]] == list(range(50, 60))
    assert hits >= 54 and set(found) <= set(range(0, 600, 100))
    assert neighbours.nearest(table.limit(0)).collect() == []


@pytest.mark.parametrize("n, width, block", [(2, 64, 4096), (6, 64, 4096), (11, 64, 4096), (11, 300, 4096), (30, 64, 4)])
def test_neighbours_of_few_vectors_are_whole(frame, monkeypatch, n, width, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = np.random.default_rng(n).normal(size=(n, width))
    if n == 30:
        # a lone vector beside two tight clusters
        x[1:] = x[1 + np.arange(29) % 2] + 1e-3 * x[1:]
    rows = [(100 * i, v.tolist()) for i, v in enumerate(x)]
    # another width is no candidate
    found = defaultdict(list)
    for r in neighbours.nearest(frame([*rows, (7, [1.0, 2.0])], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id))
    assert len(found) == n
    for i in range(n) if n < 30 else [0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.argsort(d, kind="stable")[: min(10, n - 1)]
        assert found[100 * i] == [(k, 100 * v) for k, v in enumerate(best, 1)]


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(neighbours.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_packing(awkward, size):
    own = tokenizer("word_bpe_49k.json")
    rows = [tuple(r) for r in packing.pack(awkward, queries.tokenizer_path("word_bpe_49k.json"), size).collect()]
    want = []
    for r in awkward.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want.append((r.doc_id, n, start, len(part), zlib.crc32(part.tobytes())))
    assert multiset(r[:5] for r in rows) == multiset(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(awkward.limit(0), queries.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_plan_uses_exact_complements():
    counts = np.zeros(101, np.int64)
    for length, n in [(100, 2), (60, 5), (40, 4), (25, 1), (15, 1), (50, 3), (30, 2), (20, 1), (10, 4)]:
        counts[length] = n
    plan = packing.fill(counts, 100)
    used = np.zeros(101, np.int64)
    for pattern, n in plan:
        assert sum(pattern) <= 100
        for length in pattern:
            used[length] += n
    assert (used == counts).all()
    total = sum(length * n for length, n in enumerate(counts.tolist()))
    assert sum(n for _, n in plan) == -(-total // 100)


def test_quality_on_rows_no_fit_has_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() > 0.99
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all()


def test_quality_defined_cases(awkward, frame):
    labels = frame([(1, 0), (4, 1), (10, 1), (12, 0), (13, None), (99, 1), (None, 1)], "doc_id long, quality int")
    found = quality.quality_scores(awkward, labels)
    rows = found.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    assert quality.keep_good(awkward.limit(0), labels).collect() == []


def test_training_sample_is_bounded_in_rows(frame):
    docs = frame([(1, f"text number {i}") for i in range(50)] + [(i, "other words") for i in range(2, 9)] + [(1, None)])
    labels = frame([(i, i % 2) for i in range(1, 9)], "doc_id long, label int")
    for most in (1, 4, 100):
        found = features.training_sample(docs, labels, F.col("label"), most, "doc_id", "text", [])
        assert len(found) == min(most, 8)


def test_sum_of_squares_identity():
    random = np.random.default_rng(0)
    x, v = random.normal(size=9), random.normal(size=(9, 4))
    pairs = sum(x[i] * x[j] * (v[i] @ v[j]) for i in range(9) for j in range(i))
    assert math.isclose(pairs, 0.5 * (((x @ v) ** 2).sum() - ((x**2) @ (v**2)).sum()))


def test_rates_meet_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    mix = mixing.fit_mix(docs, labels, queries.domain(), queries.DOMAIN_WEIGHTS, "clean")
    found = mixing.document_rates(mix).toPandas()
    p = found[["p_clean", "p_toxic", "p_poor"]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (found["rate"] >= 0).all()
    t, r, w = found["n_tokens"].to_numpy(), found["rate"].to_numpy(), np.array(list(queries.DOMAIN_WEIGHTS.values()))
    target = w / w[0] * (t @ p)[0]
    # brute force: plain projected gradient on the whole matrix
    a, z = p * t[:, None], np.ones(len(t))
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(20_000):
        z = np.maximum(0, z - step * (p @ (z @ a - target)))
    assert np.linalg.norm(r @ a - target) <= 2e-4 * np.linalg.norm(target) + np.linalg.norm(z @ a - target)
    copies = mixing.resample(docs, mix).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    many = found.set_index("doc_id")["rate"]
    assert all(math.floor(many[i]) <= n <= math.floor(many[i]) + 1 for i, n in copies.items())


@pytest.mark.parametrize("toxic", [3, 40, 400])
def test_thinning_keeps_the_anchor_and_repeats_nothing(frame, toxic):
    rng = np.random.default_rng(toxic)
    far = rng.uniform(0.6, 0.999, toxic)
    p = np.stack([np.concatenate([np.full(600, 0.9999), 1 - far]), np.concatenate([np.full(600, 0.0001), far])], axis=1)
    t = rng.integers(20, 300, len(p))
    rows = frame([(int(n), bytearray(v.tobytes())) for n, v in zip(t, p)], "tokens long, posterior binary")
    rates = mixing.fit_rates(rows, np.array([0.99, 0.01]), 0, thin=True).replay(p)[0]
    assert (rates[:600] == 1).all() and rates.min() >= 0 and rates.max() <= 1
    clean, other = (t * rates) @ p
    if toxic == 3:
        assert (rates == 1).all()
    else:
        assert math.isclose(other / clean, 1 / 99, rel_tol=1e-3)


def test_mixing_defined_cases(awkward, frame):
    weights = {"a": 0.5, "b": 0.5}
    labels = frame([(1, 0), (4, 1), (10, 1), (12, 0), (13, None), (99, 1)], "doc_id long, label int")
    mix = mixing.fit_mix(awkward, labels, F.col("label"), weights, "a")
    rates = mixing.document_rates(mix).collect()
    assert len(rates) == awkward.count() and all(r.rate >= 0 for r in rates)
    assert mixing.resample(awkward, mix).columns == awkward.columns
    none = mixing.fit_mix(awkward, labels.limit(0), F.col("label"), weights, "a")
    assert {r.rate for r in mixing.document_rates(none).collect()} == {1.0}
    assert mixing.document_rates(mixing.fit_mix(awkward.limit(0), labels, F.col("label"), weights, "a")).collect() == []
