import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import ODD, SF001, odd_rows, texts

from shelfspark.llm import piece_codec
from shelfspark.llm.chunks import PieceCodec

PROTO = piece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def brute(text, sp):
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())


def test_equal_to_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    assert PieceCodec(PROTO).by_chunk and PieceCodec(PROTO).cut_lines
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for df, want in ((docs, texts(SF001).items()), (odd_rows(spark), ODD)):
        got = piece_codec.piece_digests(df, PROTO)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *brute(t, sp))) for i, t in want)
    assert piece_codec.piece_digests(docs.where("false"), PROTO).count() == 0


def test_encode_decode_apart(spark):
    df = odd_rows(spark)
    out = piece_codec.decode_pieces(piece_codec.encode_pieces(df, "text", PROTO), "ids", PROTO).collect()
    sp = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
    for r in out:
        assert r.decoded == sp.decode(sp.encode(r.text or "", add_bos=True, add_eos=True))


def test_table_limit_changes_nothing():
    some = [t or "" for t in texts(SF001).values()]
    assert PieceCodec(PROTO, limit=10).encode(some) == PieceCodec(PROTO).encode(some)
