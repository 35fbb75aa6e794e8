import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, SF001, odd_rows, texts
from tokenizers import Tokenizer

from shelfspark.llm import packing
from shelfspark.llm.chunks import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunked_ids_equal_the_library(library):
    codec = ByteBpe(packing.read_tokenizer(PATH), limit=50)
    assert codec.by_chunk
    some = [t or "" for _, t in ODD] + [t or "" for t in texts(SF001).values()]
    for text, got in zip(some, codec.encode(some)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def checked(rows, want, capacity=1024):
    """Pieces are whole, sequences gapless and within capacity; ``want`` lists (doc_id, ids)."""
    left = {}
    for doc_id, ids in want:
        left.setdefault(doc_id, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == left.keys()
    for doc_id, lists in left.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        all_pieces = sorted((s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes()), len(ids)) for ids in lists for s in range(0, len(ids), capacity))
        assert got == all_pieces
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (len(by_seq) * capacity)


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.pack(docs, packing.read_tokenizer(PATH)).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts(SF001).items()]
    assert checked(rows, want) > 0.95


def test_odd_rows_groups_and_ids(spark, library):
    rows = packing.pack(odd_rows(spark), packing.read_tokenizer(PATH), group_docs=3, keep_ids=True).collect()
    checked(rows, [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ODD])
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(odd_rows(spark).where("false"), packing.read_tokenizer(PATH)).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 77, 300):
        sizes = sorted(rng.integers(1, 100, n).tolist(), reverse=True)
        room, want = [100] * n, []
        for s in sizes:
            b = next(i for i, r in enumerate(room) if r >= s)
            room[b] -= s
            want.append(b)
        assert packing.first_fit_decreasing(sizes, 100) == want
