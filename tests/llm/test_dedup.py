"""Duplicate finders against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from newsdesk.llm import ngram_jaccard, substring_dedup, suffix_dedup
from newsdesk.llm.graph import components
from newsdesk.llm.signature_tree import Forest, SignatureTree, links
from newsdesk.llm.suffix_array import repeats, suffix_array

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def counted(rows):
    return collections.Counter(map(tuple, rows))


def jaccard_groups(rows, n, num, den):
    """By doc_id: the shingle sets of its rows, and the least id of its component."""
    sets, up = collections.defaultdict(list), {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            for a in sets[i]:
                for b in sets[j]:
                    both = len(a & b)
                    if both and den * both >= num * len(a | b):
                        p, q = root(i), root(j)
                        up[max(p, q)] = min(p, q)
    return sets, root


def jaccard_expected(rows, n, num, den):
    known = [(i, t) for i, t in rows if i is not None]
    _, root = jaccard_groups(known, n, num, den)
    size = lambda t: len(jaccard_groups([(0, t)], n, num, den)[0][0][0])
    return counted((i, size(t), None if i is None else root(i)) for i, t in rows)


@pytest.mark.parametrize("n,num,block_tokens", [(3, 90, 1_000_000), (5, 80, 400)])
def test_components_equal_all_pairs(odd, given, monkeypatch, n, num, block_tokens):
    monkeypatch.setattr(ngram_jaccard, "ANCHOR_TOKENS", min(block_tokens, 200))
    docs = odd.select("doc_id", "text").union(given.selectExpr("doc_id + 5000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    found = ngram_jaccard.similar_documents(docs, n, num, 100, block_tokens)
    assert counted(found.collect()) == jaccard_expected(rows, n, num, 100)


def test_a_large_family_of_near_copies_is_one_component(spark):
    """More members than a block holds, some of which only link through others."""
    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        base = base if i % 10 else base[: (i * 7) % 110] + ["n%d" % i] + base[(i * 7) % 110 + 1 :]
        copy = list(base)
        copy[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2_000, 1_000_000):
        assert counted(ngram_jaccard.similar_documents(docs, 3, 90, 100, size).collect()) == jaccard_expected(rows, 3, 90, 100)


def test_the_pipeline_links_near_copies_at_eighty(spark):
    """Of 100 shingles each, 90 in common (0.818); the third pair has 88 in common (0.786)."""
    base = [[f"p{p}w{i}" for i in range(104)] for p in range(3)]
    rows = []
    for p, n in enumerate((10, 10, 12)):
        rows += [(2 * p, " ".join(base[p])), (2 * p + 1, " ".join(base[p][:-n] + [f"own{p}n{i}" for i in range(n)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (corpus_pipeline.one_of_near_copies(spark, docs, ""), ngram_jaccard.one_of_each(docs)):
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 5]


def test_common_passages_do_not_make_candidates(spark, monkeypatch):
    """Half of each document is a passage that all share; keys of two documents are equal only for near copies."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(40 + i % 60)] + passage)) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, whole = [], ngram_jaccard.components
    monkeypatch.setattr(ngram_jaccard, "components", lambda edges: seen.append(whole(edges)) or seen[-1])
    found = ngram_jaccard.similar_documents(docs, 5, 80, 100)
    assert counted(found.collect()) == jaccard_expected(rows, 5, 80, 100)
    assert max(r["count"] for r in seen[0].groupBy("component").count().collect()) < 10


def test_low_thresholds_reach_every_class_of_sizes(spark):
    """60 of 100 shingles: the classes between those of the set's own size and of its least partner count too."""
    words = [f"w{i}" for i in range(102)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:62]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(ngram_jaccard.similar_documents(docs, 3, 50, 100).collect()) == jaccard_expected(rows, 3, 50, 100) == counted([(1, 100, 1), (2, 60, 1)])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def windows_expected(rows, n):
    """The one of least digest stands for its id; here ids with two texts do not occur but as equal rows."""
    known = dict((i, t) for i, t in rows if i is not None)
    seen, out = set(), {}
    for i in sorted(known):
        w = (known[i] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    whole = lambda t: (len((t or "").encode().split()), 0, hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest())
    return counted((i, *(whole(t) if i is None else out[i])) for i, t in rows)


@pytest.mark.parametrize("columns", [1 << 27, 1 << 16])
def test_later_windows_go(odd, given, columns):
    """Also with a sketch so small that it takes nearly all windows for repeated."""
    docs = odd.select("doc_id", "text").union(given.selectExpr("doc_id + 5000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert counted(substring_dedup.without_repeats(docs, 20, columns).collect()) == windows_expected(rows, 20)


def strings_expected(rows, length):
    known = {i: (t or "").encode() for i, t in rows if i is not None}
    times = collections.Counter(t[k : k + length] for t in known.values() for k in range(len(t) - length + 1))

    def result(i, t):
        edge = np.zeros(len(t) + length + 1, int)
        for k in range(len(t) - length + 1) if i is not None else ():
            if times[t[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge)[: len(t)] > 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        return len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(left).hexdigest()

    return counted((i, *result(i, (t or "").encode())) for i, t in rows)


@pytest.mark.parametrize("length,hot", [(400, 4000), (60, 1)])
def test_repeated_strings_go(odd, given, length, hot):
    docs = odd.select("doc_id", "text").union(given.selectExpr("doc_id + 5000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert counted(suffix_dedup.without_repeats(docs, length, hot).collect()) == strings_expected(rows, length)


def clashing():
    """Ids with several texts, one of which other documents hold too; and the choices of one text for id 5."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    rows = [(5, a), (5, b), (7, b), (8, f"{b} tail"), (9, f"{a} tail"), (2, a), (2, a), (11, b), (11, c), (12, c), (12, "short")]
    chosen = [dict(rows) | {5: x, 11: y, 12: c} for x in (a, b) for y in (b, c)]
    return rows, chosen


def of_choice(rows, chosen, expected):
    """What the chosen rows give; the others come back whole."""
    out = {i: k for i, *k in expected(list(chosen.items()))}
    whole = {t: k[1:] for t in {t for _, t in rows} for k in expected([(0, t)])}
    return counted((i, *(out[i] if chosen[i] == t else whole[t])) for i, t in rows)


def test_an_id_with_several_texts_is_one_of_them(spark):
    rows, chosen = clashing()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = counted(suffix_dedup.without_repeats(docs, 100).collect())
    assert found in [of_choice(rows, c, lambda x: strings_expected(x, 100)) for c in chosen]
    found = counted(substring_dedup.without_repeats(docs, 20).collect())
    assert found in [of_choice(rows, c, lambda x: windows_expected(x, 20)) for c in chosen]


def test_a_large_component_is_not_compared_pair_by_pair():
    """Node pairs within one component are not opened: near copies cost little more than a chain of them."""
    rng = np.random.default_rng(1)
    base, sets = rng.integers(0, 1 << 63, 116).astype(np.uint64), []
    for _ in range(4000):
        copy = base.copy()
        copy[rng.integers(0, 116, 5)] = rng.integers(0, 1 << 63, 5).astype(np.uint64)
        sets.append(np.unique(copy))
    tree, forest = SignatureTree(sets, np.arange(4000), 1024), Forest(4000)
    start = time.process_time()
    assert len(list(links(tree, tree, forest, 80, 100))) == 3999
    assert time.process_time() - start < 4


def test_suffix_arrays_are_sorted():
    rng = random.Random(5)
    for _ in range(400):
        s = bytes(rng.randint(0, rng.choice([1, 3, 250])) for _ in range(rng.randint(0, 50))) * rng.choice([1, 1, 3])
        assert suffix_array(np.frombuffer(s, np.uint8)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats_within_one_string():
    s = np.frombuffer(b"abcabcXabc", np.uint8)
    assert np.flatnonzero(repeats(s, 3, np.arange(10) < 8)).tolist() == [0, 3, 7]


def test_cleaned_keeps_rows_and_columns(odd):
    out = suffix_dedup.cleaned(odd, 60)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id in (19, 22)").collect()} == {""}
    assert out.where("doc_id is null and length(text) > 100").count() == 1


@pytest.mark.parametrize("size", [1, 3, 5])
def test_the_pipeline_takes_repeated_passages_of_51_words(spark, size):
    """Of 101, 203 and 305 bytes; one of 35 words and fewer than 250 bytes stays."""
    rng = random.Random(size)
    words = lambda n, k: " ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    passage, short = words(51, size), words(35, 5)
    own = [[words(40, 7) for _ in range(2)] for _ in range(4)]
    docs = spark.createDataFrame([(i, f"{a} Q {passage} Z {b}" if i < 2 else f"{a} Q {short} Z {b}") for i, (a, b) in enumerate(own)] + [(9, passage)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.no_repeated_strings(spark, docs, "").collect()}
    for i, (a, b) in enumerate(own):
        assert out[i].startswith(a) and out[i].endswith(b)
        assert (short in out[i]) == (i >= 2) and (i >= 2 or len(out[i]) <= len(a + b) + 6)
    assert out[9] == ""


def test_one_of_each_group_stays(odd):
    out = ngram_jaccard.one_of_each(odd)
    ids = sorted(r["doc_id"] for r in out.where("doc_id is not null").collect())
    assert out.columns == odd.columns and len(ids) == len(set(ids))
    assert 19 in ids and not {22, 25, 28, 1000} & set(ids)
    assert out.where("doc_id is null").count() == 2


def test_empty_tables(nothing):
    for out in (ngram_jaccard.similar_documents(nothing), ngram_jaccard.one_of_each(nothing), substring_dedup.without_repeats(nothing), suffix_dedup.without_repeats(nothing), suffix_dedup.cleaned(nothing)):
        assert out.count() == 0
