"""Whitening, vector codes and the url filter against brute force, on small fixtures with nulls, ties, repeats and clashing names."""
import collections
import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter, vector_codes, whitening
from tidemark.llm.queries import URL_RULES

ROWS = "vec_id long, embedding array<float>, label int, x string, n int, error string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 7, "clash") for i, v, label in rows], ROWS)


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_whitening(rows):
    """n, S, V (exact), and per row the x vector, for rows (id, vector)."""
    x = {(i, tuple(v)): tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for i, v in rows if sound(v)}
    fit = sorted(set(x.values()))
    n, width = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(width)]
    centred = [[Fraction(n * c - s, n) for c, s in zip(v, sums)] for v in fit]
    v = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)]
    return n, sums, np.array(v), x


@pytest.mark.parametrize("kind", ["plain", "few directions", "ties", "far from zero"])
def test_whitening_against_exact_covariance(spark, kind):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(150, 20)) * np.linspace(0.5, 9, 20)
    if kind == "few directions":
        values = rng.integers(-3, 4, (150, 5)) @ rng.integers(-2, 3, (5, 20))
    elif kind == "ties":  # a cross: all eigenvalues are the same, in pairs
        values = np.vstack([np.eye(20) * 2, -np.eye(20) * 2, np.eye(20)[:10] * 5, -np.eye(20)[:10] * 5])
    elif kind == "far from zero":
        values = values + 3e5
    values = values.astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(values)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)] + [(5, rows[7][1], 2), (None, rows[3][1], None)]
    odd = [(2000, None, 1), (2001, [float("nan")] * 20, 1), (2002, [None] + [1.0] * 19, 1), (2003, [float("inf")] * 20, 1), (2004, [1.0], 1), (2005, [], 1)]
    taken = whitening.integer_rows(vectors_frame(spark, rows + odd))
    fitted = whitening.fit(taken)
    n, sums, v, x = brute_whitening([(i, v) for i, v, _ in rows])
    assert (fitted.n, fitted.sums) == (n, sums)
    want = np.linalg.eigvalsh(v)[::-1]
    k = min(16, int((want > 1e-11 * want[0]).sum()))
    assert len(fitted.eigenvalues) == k and fitted.eigenvalues == pytest.approx(want[:k], rel=1e-9)
    assert np.abs(v @ fitted.vectors.T - fitted.vectors.T * fitted.eigenvalues).max() < 1e-12 * want[0]
    assert np.abs(fitted.vectors @ fitted.vectors.T - np.eye(k)).max() < 1e-12
    got = whitening.transform(taken, fitted).collect()
    assert len(got) == k * len(rows) and {r["identity_error"] for r in got} == {fitted.identity_error} and fitted.identity_error < 1e-7
    by_row = collections.Counter((r["vec_id"], r["component"]) for r in got)
    assert by_row[5, 1] == 2 and by_row[None, k] == 1
    first = {i: v for i, v, _ in reversed(rows)}
    for r in got[:: 7]:
        if r["vec_id"] == 5:
            continue
        vector = x[r["vec_id"], tuple(first[r["vec_id"]])]
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(vector, sums)) and r["n"] == n
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(vector, sums)])
        j = r["component"] - 1
        assert r["whitened"] == pytest.approx(centred @ fitted.vectors[j] / math.sqrt(fitted.eigenvalues[j]), abs=1e-8)
        assert r["explained"] == pytest.approx(want[j] / want.sum(), rel=1e-6)


def test_whitening_of_little(spark):
    none = whitening.integer_rows(vectors_frame(spark, []))
    assert whitening.fit(none) is None and whitening.transform(none, None).count() == 0
    one = whitening.integer_rows(vectors_frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]))
    fitted = whitening.fit(one)
    assert fitted.n == 1 and whitening.transform(one, fitted).count() == 0
    line = whitening.integer_rows(vectors_frame(spark, [(1, [1.0], 1), (2, [3.0], 1)]))
    got = {r["vec_id"]: r for r in whitening.transform(line, whitening.fit(line)).collect()}
    assert got[1]["whitened"] == -1 and got[2]["whitened"] == 1 and got[1]["deviation"] == 128 ** 2 and got[1]["explained"] == 1
    huge = whitening.integer_rows(vectors_frame(spark, [(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1), (3, [0.5, 2.5], 1)]))
    rows = whitening.transform(huge, whitening.fit(huge)).collect()
    assert len(rows) == 3 and all(r["deviation"] is None or r["vec_id"] == 3 for r in rows)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 10 ** 6, 1 << 25, 1 << 40):
        y = rng.integers(-top, top + 1, (300, 4))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()
        assert (whitening.column_sums(y) == y.astype(object).sum(0)).all()


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_spectrum_by_polar_decompositions(size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    for values in (rng.random(size), np.ones(size), np.where(np.arange(size) < size // 2, 1.0, 2.0), 10.0 ** -np.arange(size), np.arange(size) - size // 2, np.zeros(size)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.spectrum(a, size)
        scale = max(1e-300, np.abs(values).max())
        assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * scale * size + 1e-300
        assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-13 * scale * size + 1e-300
        assert np.abs(vectors @ vectors.T - np.eye(size)).max() < 1e-12
        some, _ = whitening.spectrum(a, 3)
        assert some == pytest.approx(found[:3], abs=1e-12 * scale)
    sign = whitening.polar_factor(q @ np.diag(np.where(np.arange(size) % 2, -1e-3, 2.0)) @ q.T)
    assert np.abs(sign - q @ np.diag(np.where(np.arange(size) % 2, -1.0, 1.0)) @ q.T).max() < 1e-12


def brute_codes(rows):
    """(id, code, error, label error), sorted, and the digest of the codebooks; rows (id, vector, label) with sound vectors of one length."""
    x = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], label) for i, v, label in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(x[0][1]) // 8
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in x[:16]] for p in range(8)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(6):
        groups = collections.defaultdict(list)
        for _, v, _ in x:
            for p in range(8):
                groups[p, best(v, p)[1]].append(cut(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, totals = [], collections.Counter()
    for i, v, label in x:
        found = [best(v, p) for p in range(8)]
        totals[label] += sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, code, error, totals[label]) for i, code, error, label in out), key=str), digest


@pytest.mark.parametrize("kind", ["plain", "few", "ties", "large"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(8)
    number = 9 if kind == "few" else 300
    values = rng.normal(size=(number, 24)) + rng.integers(0, 3, (number, 1))
    if kind == "ties":
        values = rng.integers(0, 2, (number, 24)) / 4096
    elif kind == "large":
        values = values * 10.0 ** 7
        values[0] *= 1000
    values = values.astype(np.float32)
    rows = [(i * 3, [float(c) for c in v], [None, 4, 4, 7][i % 4]) for i, v in enumerate(values)]
    rows += [(2000 + i, rows[1][1], 4) for i in range(60 if number > 9 else 0)] + [(0, rows[4][1], 9), (None, rows[2][1], 7)]
    odd = [(-5, None, 4), (-4, [float("nan")] * 24, 4), (-3, [None] * 24, 4), (-2, [float("-inf")] * 24, 4), (-1, [1.0] * 16, 4)]
    got, books = vector_codes.codes(vector_codes.integer_rows(vectors_frame(spark, rows + odd)))
    got = got.collect()
    want, digest = brute_codes(rows)
    assert {r["codebooks_sha256"] for r in got} == {digest} == {vector_codes.digest(books)}
    long = lambda e: e if e < 1 << 63 else None
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == sorted([(i, c, long(e), long(t)) for i, c, e, t in want], key=str)


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.codes(vector_codes.integer_rows(vectors_frame(spark, [])))[0].count() == 0
    assert vector_codes.codes(vector_codes.integer_rows(vectors_frame(spark, [(1, [1.0] * 7, 1), (2, [], 1), (3, [], 1)])))[0].count() == 0


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    part = np.floor(rng.normal(size=(5000, 8)) * 4096 + rng.integers(-5, 6, (5000, 1)) * 20000).astype(np.int64)
    book = np.vstack([part[:14], part[0], part[3]])  # two entries twice
    pivots = vector_codes.far_apart(book, 4)
    to_pivots = vector_codes.floor_roots(np.stack([vector_codes.squared(part, p[None]) for p in pivots], 1))
    which, best, evaluated = vector_codes.assign(part, to_pivots, book, pivots)
    every = ((part[:, None] - book[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (best == every.min(1)).all()
    assert evaluated < 0.5 * every.size
    roots = vector_codes.floor_roots(np.array([0, 1, 3, 4, 8, 9, (1 << 30) ** 2 - 1, (1 << 30) ** 2]))
    assert roots.tolist() == [0, 1, 1, 2, 2, 3, (1 << 30) - 1, 1 << 30]


PAGES = "page_id long, url string, html string, host int, path int, node string, verdict string, component long"


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, 2, "n", "v", 3) for i, (u, h) in enumerate(rows)], PAGES)


def canonical(target):
    return f"<html><head><link rel='canonical' href=\"{target}\"></head><body>x</body></html>"


def test_urls_are_cut_and_ruled(spark):
    cases = [("https://WWW.Example.ORG/es/a?q#f", "www.example.org", "/es/a", "example.org/es/", "block"), ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
             ("http://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
             ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://example.org", "example.org", "", None, "allow"),
             ("http://org/", "org", "/", "org/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("http://x.com/DE/", "x.com", "/DE/", None, "allow"),
             ("x.com?u=http://y.com/de/1", "y.com", "/de/1", "com/de/", "block"), ("://com?a/fr/", "com", "", None, "allow"), ("http://com:80/de/", "com:80", "/de/", None, "allow"),
             ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http:///de/", "", "/de/", None, "allow"),
             ("ht\ntp://É.com/fr/\n", "É.com", "/fr/\n", "com/fr/", "allow"), ("http://a.com/de/" + "x" * 50_000, "a.com", "/de/" + "x" * 50_000, "com/de/", "block")]
    got = {r["page_id"]: r for r in url_filter.judge(pages_frame(spark, [(c[0], None) for c in cases]), URL_RULES).collect()}
    for i, (_, *want) in enumerate(cases):
        assert [got[i][c] for c in ("host", "path", "rule", "verdict")] == want
    same = [url_filter.Rule("block", "x.com", "/a"), url_filter.Rule("allow", "com", "/a/bb"), url_filter.Rule("allow", "x.com", "/a")]
    assert [r["verdict"] for r in url_filter.judge(pages_frame(spark, [("u://x.com/a", ""), ("u://x.com/a/bb", "")]), same).orderBy("page_id").collect()] == ["allow", "allow"]
    assert url_filter.judge(pages_frame(spark, []), URL_RULES).count() == 0 and url_filter.judge(pages_frame(spark, [("u://x.com/de/", "")]), []).first()["verdict"] == "allow"


def brute_verdicts(rows, redirects):
    """Verdicts by flooding classes of aliases, one page after the other."""
    def cut(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:end].lower(), rest[end:].split("#")[0]
        return host, tail.split("?")[0], host and host + (tail if tail.startswith("/") else "/" + tail)

    def rule(host, path):
        fits = [r for r in URL_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    links = [(u, t) for u, h in rows for t in (url_filter.targets(u, h or "") if u else [])] + redirects
    links = [(cut(a)[2], cut(b)[2]) for a, b in links]
    links = [(a, b) for a, b in links if a and b]
    blocked = {node for edge in links for node in edge if (r := rule(*cut("://" + node)[:2])) and r.verdict == "block"}
    grown = True
    while grown:
        more = {n for a, b in links if a in blocked or b in blocked for n in (a, b)}
        grown = not more <= blocked
        blocked |= more
    out = []
    for u, _ in rows:
        host, path, node = cut(u)
        r = rule(host, path)
        out.append((r.text, r.verdict) if r else (None, "block" if node in blocked else "allow"))
    return out


def test_block_decisions_spread_to_aliases(spark):
    rows = [("http://a.net/1", canonical("http://x.com/de/1")),  # blocked by its target
            ("http://b.net/1", canonical("/2")), ("http://b.net/2", canonical("http://a.net/1#part")),  # and by a chain of relative links
            ("http://c.org/1", canonical("http://x.com/de/1")),  # explicitly allowed, whatever its aliases
            ("http://d.net/1", canonical("http://c.org/1")),  # blocked: the class holds x.com/de/1
            ("https://A.net/1", None), ("http://e.net/1", "<meta content='0; URL=http://example.org/es/9' http-equiv=Refresh>"),
            ("http://f.net/1", "<!-- " + canonical("http://x.com/de/1") + " --><script>'" + canonical("http://x.com/de/1") + "'</script>"),
            ("http://g.net/1", "<base href='http://x.com/de/'><link REL='shortlink Canonical' href=q>"), ("http://h.net", "<link rel=canonical href='http://[bad'>"),
            ("http://i.net/1", canonical("http://ok.net/")), ("http://j.net/1", "<link rel=canonical href=''>"), ("http://a.net/1?x=1", ""), (None, canonical("http://x.com/de/1")),
            ("no scheme", canonical("http://x.com/de/1")), ("http://k.net/1", ""), ("http://l.net/", "a" * 100_000 + canonical("http://k.net/1"))]
    redirects = [("http://k.net/1", "http://x.com/de/7"), ("http://m.net/", None), ("a", "b"), ("http://n.net/", "http://n.net/")]
    rows += [(f"http://star.net/{i}", canonical("http://hub.net/")) for i in range(50)] + [("http://hub.net", canonical("http://example.org/en/1")), ("http://star.net/3", "")]
    table = pages_frame(spark, rows)
    got = url_filter.judge(table, URL_RULES, spark.createDataFrame(redirects, "source string, target string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == brute_verdicts(rows, redirects)
    verdicts = [r["verdict"] for r in got]
    assert verdicts[:8] == ["block", "block", "block", "allow", "block", "block", "block", "allow"] and verdicts[8] == "block" and verdicts[15:17] == ["block", "block"]
    assert set(verdicts[17:]) == {"block"} and all(r["by_alias"] == (r["rule"] is None and r["verdict"] == "block") for r in got)
    plain = url_filter.judge(table.select("page_id", "url", F.lit(None).cast("string").alias("html")), URL_RULES)
    assert {r["verdict"] for r in plain.where("rule IS NULL").collect()} == {"allow"}
