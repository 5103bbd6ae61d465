"""Whitening, URL verdicts and spelling variants against brute force and on awkward tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashweave.llm import queries, spelling, urls, whitening

VECTORS = "vec_id long, embedding array<float>"


def brute_whitened(rows):
    """Exact integers in Python, covariances centred before multiplying."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    off = np.array([[n * r[i] - s[i] for i in range(d)] for r in x], dtype=object)
    v = np.array([[c / n ** 3 for c in row] for row in (off.T @ off).tolist()])
    values, axes = np.linalg.eigh(v)
    return off, v, values[::-1], axes[:, ::-1]


def test_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.orderBy("vec_id").collect()
            if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    off, v, values, axes = brute_whitened(rows)
    k = min(32, len(values))
    got = queries.op11_whitened_embeddings(spark, sf_dir).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i, _ in rows for c in range(k)]
    want = (off.astype(np.float64) / len(rows)) @ (axes[:, :k] / np.sqrt(values[:k]))
    ours = np.array([r["whitened"] for r in got]).reshape(-1, k)
    signs = np.sign((ours * want).sum(axis=0))
    assert np.abs(ours - want * signs).max() < 1e-6
    assert [r["deviation"] for r in got[::k]] == (off * off).sum(axis=1).tolist()
    assert {r["n"] for r in got} == {len(rows)}
    assert np.allclose([r["explained"] for r in got[:k]], values[:k] / np.trace(v), rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    assert np.abs(ours.T @ ours / len(rows) - np.eye(k)).max() < 1e-9


def test_covariance_is_exact_on_large_entries(spark):
    """Polarisation equals the exact covariance where squares leave 64 bits, under any partitioning."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-10 ** 13, 10 ** 13, 3)]) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, v, _, _ = brute_whitened(rows)
    for parts in (1, 5):
        model = whitening.fit(table.repartition(parts))
        assert model.covariance.tolist() == v.tolist()
    assert {r["deviation"] for r in whitening.whiten(table).collect()} == {None}


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 0.5]), (3, None), (4, []), (5, [None, 1.0]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [-3.0, 1.0])]
    odd = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("n", "component", "v", "id")})
    got = whitening.whiten(odd).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [
        (i, c) for i in (0, 1, 1, 2, 9) for c in (1, 2)][:2] + [(1, 1), (1, 1), (1, 2), (1, 2)] + [(2, 1), (2, 2), (9, 1), (9, 2)]
    assert {r["n"] for r in got} == {5} and got[0]["identity_error"] < 1e-9
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], VECTORS)).orderBy("vec_id").collect()
    assert [(r["component"], r["whitened"] and abs(round(r["whitened"], 9)), r["explained"]) for r in flat] == [
        (1, 1.0, 1.0), (2, None, 0.0)] * 2
    alike = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], VECTORS)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alike] == [(None, 0.0, 0.0, 0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], VECTORS)).collect()
    assert sorted(round(r["whitened"], 9) for r in huge) == [-1.0, 1.0]
    nothing = whitening.whiten(odd.where("false"))
    assert nothing.count() == 0 and nothing.columns[:2] == ["vec_id", "component"]


def brute_verdict(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    at = (url or "").find("://")
    host, path = "", ""
    if at >= 0:
        rest = re.split(r"[?#]", url[at + 3:])[0]
        cut = rest.find("/")
        host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    held = {t for t in urls.TERMS.strict + urls.TERMS.soft if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
    strict, soft = held & set(urls.TERMS.strict), held & set(urls.TERMS.soft)
    verdict = "block" if strict or len(soft) >= 2 else "allow"
    rule = max(fits, key=lambda r: len(r.name), default=None)
    if rule:
        verdict = "allow" if rule.allow else "block"
    return host, path, rule and rule.name, verdict, len(strict), len(soft), ",".join(sorted(held))


def test_urls(spark, sf_dir):
    made = [None, "", "nothing here", "http://", "http://EXAMPLE.com", "http://example.com/", "http://example.com/en/1?x=/es/",
            "https://www.example.com/en/", "https://a.WWW.example.com/en/a#b", "http://notexample.com/en/", "http://x.net/es/y",
            "http://x.net/es", "http://x.net/fr/?casino", "http://x.org?cheap=pills", "http://x.org#porn", "http://essex.org/sextant",
            "http://cheap.cheap.org/cheap", "http://a.org/free-bets", "http://a.org/freebets", "http://a.org/PORN", "a://b://c.net/es/",
            "http://a.org/\nporn\n", "http://a.org/é-xxx-é", "http://a.org/éxxxé", "http://a.org/" + "free/" * 50_000 + "bets",
            "http://user@x.org:80/a", "http://.com/", "http://com/a"]
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(made + made[:3])] + [(None, made[5])], "page_id long, url string")
    odd = odd.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "found", "terms")})
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for table, got in ((odd, urls.judge(odd, keep=("page_id",))), (real, queries.op12_url_verdicts(spark, sf_dir))):
        want = Counter((r["page_id"], *brute_verdict(r["url"])) for r in table.collect())
        assert Counter(tuple(r) for r in got.collect()) == want
    assert urls.judge(odd.where("false")).count() == 0
    bare = urls.judge(odd, (), urls.Vocabulary((), ()), keep=("page_id",))
    assert {(r["rule"], r["verdict"], r["terms"]) for r in bare.collect()} == {(None, "allow", "")}


def edits(word, alphabet):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in alphabet)


def brute_variants(n, ratio=2):
    alphabet = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        near = {e for e in edits(w, alphabet) if e in n and e != w}
        best = min(near, key=lambda e: (-n[e], e), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(near))
    found = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.add((w, form, root, n[w], near, n[form] if form else None))
    return found


def variants_of(spark, n, **kw):
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    return {tuple(r) for r in spelling.variants(words, **kw).collect()}


def test_spelling_query(spark, sf_dir):
    n = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, sf_dir).collect()} == brute_variants(n)


@pytest.mark.parametrize("bucket", [1, 4, 4096])
def test_spelling_of_dense_words(spark, bucket):
    """All buckets are split down to windows of a few letters and no link is lost or counted twice."""
    rng = np.random.default_rng(4)
    n = {"".join(rng.choice(list("abé"), rng.integers(1, 7))): int(rng.integers(1, 60)) for _ in range(500)}
    assert variants_of(spark, n, bucket=bucket) == brute_variants(n)


def test_spelling_chains_and_awkward_words(spark):
    chain = {"a" * 5 + "bcdefghij"[:i]: 2 ** i for i in range(10)}
    assert variants_of(spark, chain) == brute_variants(chain)
    assert {r[2] for r in variants_of(spark, chain)} == {"aaaaabcdefghij"}
    long = {"x" * 30_000: 3, "x" * 29_999: 9, "x" * 14_000 + "y" + "x" * 15_999: 1, "z": 5, "zz": 5, "zy": 5}
    want = {("x" * 30_000, "x" * 29_999, "x" * 29_999, 3, 2, 9), ("x" * 29_999, None, "x" * 29_999, 9, 2, None),
            ("z", None, "z", 5, 2, None), ("zz", None, "zz", 5, 2, None), ("zy", None, "zy", 5, 2, None)}
    got = variants_of(spark, long)
    assert want <= got and len(got) == 6
    odd = spark.createDataFrame([("ab", 1), ("ab", 2), ("abc", 6), (None, 3), ("", 4), ("b", None), ("c", 0)],
                                "word string, n long").withColumns({c: F.lit(1) for c in ("m", "i", "j", "key", "form", "near")})
    assert {tuple(r) for r in spelling.variants(odd).collect()} == {("ab", "abc", "abc", 3, 1, 6), ("abc", None, "abc", 6, 1, None)}
    assert spelling.variants(odd.where("false")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("Éa B1ÀÿZ",)], "t string").select(
        spelling.runs(F.col("t"))).collect()] == [[], [], ["Éa", "b", "Àÿz"]]
