"""Periodic runs against a search over all periods."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from newsdesk.llm import block_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, least=6, times=4):
    """Every maximal stretch of every period, the least period of equal stretches."""
    out, seen = [], set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out)


def cut(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def numbered(w):
    names = {}
    return np.array([names.setdefault(x, len(names) + 1) for x in w], np.uint64)


@pytest.mark.parametrize("kinds", [1, 2, 3, 30])
def test_runs_equal_a_search_over_all_periods(kinds):
    rng = random.Random(kinds)
    for _ in range(250):
        w = [rng.randint(1, kinds) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randint(1, kinds) for _ in range(rng.randint(1, 25))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * 9)[: rng.randint(2 * len(unit), 7 * len(unit))]
        assert [tuple(x) for x in block_runs.runs(np.array(w, np.uint64)).tolist()] == all_runs(w)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        x, y = (rng.integers(1, block_runs.PRIME, (5, k * size)).astype(np.uint64) for k in (1, 2))
        got = block_runs.squared_differences(x, y)
        for r in range(5):
            for d in range(size):
                assert int(got[r, d]) == sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], y[r, d:])) % block_runs.PRIME
        z = rng.integers(0, block_runs.PRIME, (3, 2 * size)).astype(np.uint64)
        assert (block_runs.back(block_runs.transform(z.copy())) == z).all()


def test_zero_modulo_the_prime_alone_is_no_match(monkeypatch):
    """With a small prime many sums are zero by chance; only true matches count, and none is lost."""
    monkeypatch.setattr(block_runs, "squared_differences", lambda x, y: np.zeros((len(x), x.shape[1]), np.uint64))
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randint(1, 3) for _ in range(rng.randint(0, 80))] + [1, 2, 3, 2, 1] * rng.randint(0, 8)
        assert [tuple(x) for x in block_runs.runs(np.array(w, np.uint64)).tolist()] == all_runs(w)


def test_long_sequences():
    n = 100_000
    assert block_runs.runs(np.ones(n, np.uint64)).tolist() == [[0, n, 1]]
    assert block_runs.runs(np.arange(n, dtype=np.uint64) % np.uint64(777) + np.uint64(1)).tolist() == [[0, n, 777]]
    assert not len(block_runs.runs(np.arange(1, n, dtype=np.uint64)))
    with pytest.raises(ValueError):
        block_runs.runs(np.ones(9, np.uint64), times=3)


def expected(docs, places=None):
    out = collections.Counter()
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        order = places(doc_id, len(w)) if places else None
        w = w if order is None else [w[i] for i in order]
        found = tuple(map(tuple, block_runs.runs(numbered(w)).tolist())) if len(w) > 3000 else tuple(all_runs(w))
        out[doc_id, len(w), found, cut(w, found)] += 1
    return out


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["text"]) for r in periodic_runs.collapsed(odd).collect())
    assert got == expected(rows)
    assert periodic_runs.collapsed(nothing).count() == 0


def test_planted_places():
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        for n in (0, 1, 7, 100):
            got = periodic_runs.planted(doc_id, n)
            if h % 10 or not n:
                assert got is None
                continue
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert periodic_runs.planted(None, 5) is None


def test_query(spark, given):
    rows = {r["doc_id"]: r for r in periodic_runs.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert len(rows) == len(docs)
    for doc_id, n, found, text in expected(docs, periodic_runs.planted):
        r = rows[doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["n_words"]) == (len(found), n)
        digest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == digest
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert any(r["n_runs"] for r in rows.values())
