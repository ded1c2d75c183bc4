"""Tokenizers, packing, fingerprints and search against libraries and brute force."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from odd_rows import odd_rows
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from newsdesk.llm import cover_search, fingerprints, packing, pieces, token_counts, word_tokens

WORDS = "word_bpe_49k.json"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abc the\n  in_=.é中'st1!") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return [r[1] for r in odd_rows()] + made


def per_row(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_bpe_pieces_equal_the_library():
    texts = odd_texts()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.Pieces(MODEL)
    found = per_row(*own.encode(pa.array(texts, pa.string())))
    assert found == library.encode([t or "" for t in texts])
    assert all(own.decode(i).decode() == (t or "") for t, i in zip(texts, found) if "▁" not in (t or ""))


def test_unigram_viterbi_equals_the_library():
    """The public model's pieces with other scores and of type unigram."""
    rng = random.Random(6)
    model = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = -float(rng.randint(1, 60))
    own, library = pieces.Pieces.parsed(model.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [(t or "")[:5000] for t in odd_texts()]
    assert [own.encode_text(t) for t in texts] == library.encode(texts)


def test_coding_as_dataframes(odd):
    rows = pieces.decoded(pieces.encoded(odd, MODEL), MODEL).collect()
    expected = collections.Counter((r["doc_id"], (r["text"] or "").replace("▁", " ").lstrip(" ") if "▁" in (r["text"] or "") else r["text"] or "") for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["text"].lstrip(" ") if r["text"].endswith("a") and len(r["text"]) < 4 else r["text"]) for r in rows) == expected


def test_words_equal_the_library(monkeypatch):
    texts = odd_texts()
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert per_row(*word_tokens.WordTokens(WORDS).encode(pa.array(texts, pa.string()))) == expected
    monkeypatch.setattr(word_tokens, "MOST_WORDS", 40)
    monkeypatch.setattr(word_tokens, "MOST_CUTS", 30)
    small = word_tokens.WordTokens(WORDS)
    assert [per_row(*small.encode(pa.array([t], pa.string())))[0] for t in texts[-60:]] == expected[-60:]


@pytest.mark.parametrize("block,group", [(3, 2), (1 << 18, 4096)])
def test_token_counts_of_flat_files(spark, odd, tmp_path, block, group):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    zipped, plain = str(tmp_path / "zipped"), tmp_path / "plain"
    if block > 3:
        token_counts.write_token_files(pieces.encoded(odd, MODEL), zipped)
        rows = token_counts.token_counts(spark, zipped, block_tokens=block, group=group).collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(r["text"] or "")) for r in odd.collect())
    plain.mkdir()
    rng = np.random.default_rng(0)
    files = {"a": rng.integers(0, 6, 700), "b": np.array([2, 2, 5]), "c": np.array([2]), "d": np.array([], int), "e": np.full(40, 3)}
    expected = []
    for name, tokens in files.items():
        tokens.astype("<u4").tofile(plain / name)
        start = number = 0
        for end in [*np.flatnonzero(tokens == 2), *([len(tokens)] if len(tokens) and tokens[-1] != 2 else [])]:
            expected.append((name, number, start, int(end) - start))
            start, number = int(end) + 1, number + 1
    found = token_counts.token_counts(spark, str(plain), end=2, width=4, block_tokens=block, group=group)
    assert sorted((r["file"][-1], r["document"], r["start"], r["n_tokens"]) for r in found.collect()) == expected


def test_a_text_of_more_words_than_the_store_takes(monkeypatch):
    """Some of its words were known before the store is emptied for it."""
    texts = ["one two three", "two one seven four five six three eight"]
    expected = [per_row(*word_tokens.WordTokens(WORDS).encode(pa.array([t]))) for t in texts]
    monkeypatch.setattr(word_tokens, "MOST_WORDS", 5)
    small = word_tokens.WordTokens(WORDS)
    assert [per_row(*small.encode(pa.array([t]))) for t in texts + texts[:1]] == expected + expected[:1]


def test_pieces_are_packed_whole(odd, nothing):
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    rows = packing.packed(odd, WORDS, capacity=64).toPandas()
    expected = collections.Counter()
    for r in odd.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[-1 if r["doc_id"] is None else r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int).values.tolist())) == expected
    rows = rows.sort_values(["sequence_id", "offset"])
    by = rows.groupby("sequence_id").length
    assert by.sum().max() <= 64 and (rows.offset == by.cumsum() - rows.length).all()
    assert packing.packed(nothing, WORDS).count() == 0


def best_fit_decreasing(sizes, capacity):
    left = []
    for size in sorted(sizes, reverse=True):
        fit = [x for x in left if x >= size]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - size)
        else:
            left.append(capacity - size)
    return len(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([5, 17, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        used = collections.Counter()
        taken = collections.defaultdict(set)
        for size, rank, n, first, offset in packing.plan(counts, capacity):
            for i in range(n):
                used[first + i] += size
                taken[size].add(rank + i)
                assert offset + size <= capacity
        assert {s: len(r) for s, r in taken.items()} == counts and max(used.values()) <= capacity
        assert len(used) == best_fit_decreasing([s for s, n in counts.items() for _ in range(n)], capacity)


def test_fingerprints_and_neighbours(odd, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 4)
    found = fingerprints.with_neighbours(odd).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None))
    expected = collections.Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        expected[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found if r["doc_id"] is not None) == expected
    assert [r["near_next"] for r in found if r["doc_id"] is None] == [None, None]
    prints = collections.defaultdict(set)
    for r in found:
        prints[r["fingerprint"]].add(r["doc_id"])
    assert {7, None} <= prints[""] and {19, 22, None} in prints.values()
    assert fingerprints.with_neighbours(nothing).count() == 0


def test_sketches_estimate():
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(3000)]
    texts = [" ".join(base[:2000]), " ".join(base[1000:]), " ".join(base[:40]), ""]
    a, b, c, d = fingerprints.sketches(pa.array(texts))
    assert abs(fingerprints.resemblance(a, b) - 1 / 3) < 0.1 and abs(fingerprints.distinct_shingles(a) - 1996) < 400
    assert fingerprints.distinct_shingles(c) == 36 and fingerprints.containment(c, a) > 0.5
    assert fingerprints.resemblance(d, d) == 1 and fingerprints.resemblance(a, d) == 0
    whole = fingerprints.sketches(pa.array([texts[0] + " " + texts[1]]))[0]
    assert fingerprints.resemblance(fingerprints.merged(a, b), whole) > 0.98
    assert np.array_equal(fingerprints.decoded(fingerprints.encoded(a)), a)


def products_expected(rows, k, every):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = min(clean.get(i, v), v)
    whole = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in clean.items()}
    out = []
    for i in whole:
        if i % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(whole[i], w)), j) for j, w in whole.items() if j != i and len(w) == len(whole[i]))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked[:k])]
    return sorted(out)


def test_products_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cover_search, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(150)]
    rows += [(i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(200, 290)]  # ties
    rows += [(300, None), (310, []), (320, [1.0, None] * 3), (330, [float("nan")] * 6), (340, [float("inf")] * 6), (None, [1.0] * 6), (350, [2.0, 2.0]), (0, [-5.0] * 6), (370, [3e8] * 6)]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, block string")
    assert sorted(map(tuple, cover_search.best_products(vectors, 5, 10).collect())) == products_expected(rows, 5, 10)
    assert cover_search.best_products(vectors.limit(0)).count() == 0


def test_products_equal_sql(spark):
    data = "/root/testdata/sf0.1"
    found = sorted(map(tuple, cover_search.op9_cover_search(spark, data).collect()))
    with duckdb.connect() as connection:
        connection.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
        assert found == sorted(connection.execute(cover_search.ORACLE).fetchall())


def test_nodes_cover_their_members():
    x = np.random.default_rng(5).normal(size=(500, 3))
    tree = cover_search.CoverTree(x)
    for centre, radius, members in zip(tree.centre, tree.radius, tree.members):
        assert np.sqrt(((x[members] - centre) ** 2).sum(1)).max() <= radius
