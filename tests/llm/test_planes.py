"""Token files of bit and byte planes: exact round trips, and places against a plain loop."""

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from odd_rows import odd_rows
from tokenizers import Tokenizer

from newsdesk.llm import plane_files, token_planes
from newsdesk.llm.word_tokens import WordTokens

WORDS = "word_bpe_49k.json"


def made(rng, n_docs, width, high):
    sizes = rng.integers(0, 400, n_docs)
    ids = rng.integers(0, high, sizes.sum()).astype(f"<u{width}")
    return rng.integers(-(1 << 62), 1 << 62, n_docs), rng.random(n_docs) < 0.9, sizes, ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("width, high", [(2, 1 << 16), (4, 1 << 32), (2, 3)])
def test_segments_come_back(planes, width, high):
    rng = np.random.default_rng(width)
    given = [made(rng, n, width, high) for n in (50, 0, 1, 30)]
    content = b"".join(plane_files.segment(*x, planes=planes, block=1000) + b"\n" for x in given)
    read = list(plane_files.segments(content))
    assert len(read) == len(given)
    for s, (doc_ids, valid, sizes, ids) in zip(read, given):
        got_ids, got_valid, bounds = s.documents()
        assert got_ids.tolist() == doc_ids.tolist() and got_valid.tolist() == valid.tolist() and np.diff(bounds).tolist() == sizes.tolist()
        assert s.ids(0, s.n_ids).tolist() == ids.tolist()
        for a, b in ((0, 1), (999, 1001), (1500, 1500), (len(ids) // 2, len(ids))):
            assert s.ids(min(a, len(ids)), min(b, len(ids))).tolist() == ids[a:b].tolist()


def test_planes_are_transposed_numbers():
    ids = np.array([0x0102, 0x0304, 0x0506], "<u2")
    assert plane_files.to_planes(ids, plane_files.KINDS["byte"]).tolist() == [[2, 4, 6], [1, 3, 5]]
    bits = plane_files.to_planes(ids, plane_files.KINDS["bit"])
    assert bits.shape == (16, 1) and bits[:, 0].tolist() == [sum(((int(v) >> i) & 1) << k for k, v in enumerate(ids)) for i in range(16)]


def test_a_stretch_unpacks_only_its_blocks(monkeypatch):
    data = plane_files.segment(np.arange(1), np.ones(1), np.array([10_000]), np.arange(10_000).astype("<u2"), block=100) + b"\n"
    (s,) = plane_files.segments(data)
    asked = []
    monkeypatch.setattr(plane_files.Segment, "_block", lambda self, c, e, f=plane_files.Segment._block: asked.append(e[0]) or f(self, c, e))
    assert s.ids(250, 420).tolist() == list(range(250, 420))
    assert asked == [200, 300, 400]


def test_damage_is_an_error():
    data = bytearray(plane_files.segment(np.arange(1), np.ones(1), np.array([100]), np.arange(100).astype("<u2")) + b"\n")
    with pytest.raises(ValueError):
        list(plane_files.segments(bytes(data[:-1])))
    data[-plane_files.FOOTER.size - 3] ^= 1
    with pytest.raises(ValueError):
        list(plane_files.segments(bytes(data)))
    data = bytearray(plane_files.segment(np.arange(1), np.ones(1), np.array([100]), np.arange(100).astype("<u2")) + b"\n")
    data[20] ^= 1
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(plane_files.segments(bytes(data)))[0].documents()


def expected(rows):
    """``doc_id, start, ids`` in ascending order of the ids; rows of one id in any order."""
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]


def check(read, rows):
    """Every document once, one behind the other, by ascending id."""
    read = sorted(read, key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["ids"]) for r in read) == sorted((i is not None, i, x) for i, x in expected(rows))
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in read]
    assert ids == sorted(ids)
    at = 0
    for r in read:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += len(r["ids"])


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_all_documents_in_order(spark, odd, nothing, tmp_path, monkeypatch, planes):
    monkeypatch.setattr(token_planes, "RANGE_BYTES", 40_000)
    monkeypatch.setattr(token_planes, "GROUP", 2)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_planes.write_planes(odd, path, planes=planes)
    check(token_planes.read_planes(spark, path).collect(), [(r[0], r[1]) for r in odd_rows()])
    token_planes.write_planes(nothing, path + "-nothing")
    assert token_planes.read_planes(spark, path + "-nothing").count() == 0


def test_reading_gives_back_what_writing_has_kept():
    """A worker that has encoded texts holds no words while it reads files."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["some words", None])})
    for read in (token_planes._totals, lambda files: token_planes._documents(files, digests=True)):
        (packed,) = token_planes._packed(iter([batch]), WORDS, 2, 2, "byte")
        assert WordTokens.of.cache_info().currsize
        files = pa.RecordBatch.from_pydict({"path": pa.array(["f"]), "content": pa.array([packed.column("value")[0].as_py() + b"\n"], pa.binary())})
        assert sum(x.num_rows for x in read(iter([files])))
        assert not WordTokens.of.cache_info().currsize


def test_each_distinct_word_is_looked_up_once(monkeypatch):
    tokens, asked = WordTokens(WORDS), []
    monkeypatch.setattr(tokens, "_find", lambda keys, f=tokens._find: asked.append(len(keys)) or f(keys))
    texts = ["one two one", None, "", "two " * 500 + "three's one"]
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    for _ in range(2):
        ids, bounds = tokens.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(asked) == 3


def test_many_segments_and_files(spark, tmp_path):
    """Lists of ids go in as they are; the sink parts files by segments."""
    rows = [(i, [i * 20 % 70_000, 5, None] * (i % 900)) for i in range(6000)] + [(None, None), (3, [])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(7)
    token_planes.write_planes(docs, str(tmp_path / "ids"), tokenizer=None, width=4)
    read = sorted(token_planes.read_planes(spark, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    wanted = sorted(((i is not None, i or 0, [x for x in ids or [] if x is not None] + [2]) for i, ids in rows), key=lambda x: x[:2])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in read) == sorted(wanted)
    assert [r["doc_id"] for r in read][4:] == [w[1] for w in wanted][4:]
    assert [r["start"] for r in read] == np.cumsum([0] + [len(r["ids"]) for r in read])[:-1].tolist()
    with pytest.raises(Exception, match="does not fit"):
        token_planes.write_planes(docs, str(tmp_path / "narrow"), tokenizer=None, width=2)


def test_query(spark, given):
    got = sorted(tuple(r) for r in token_planes.op12_token_planes(spark, "/root/testdata/sf0.001").collect())
    start, wanted = 0, []
    for doc_id, ids in sorted(expected([(r["doc_id"], r["text"]) for r in given.collect()])):
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == wanted
