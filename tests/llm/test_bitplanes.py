import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import bitplanes as B


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70_001])
def test_chunk_round_trip(mode, n):
    for width in (2, 4):
        ids = np.random.default_rng(n).integers(0, 1 << (8 * width), n).astype(f"<u{width}")
        lens, data = B.encode_chunk(ids, width, mode, 4096)
        assert (B.decode_chunk(n, width, mode, lens, data, 4096) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_files_hold_every_id_in_order(spark, tmp_path, mode):
    rows = [(5, "Two words", 1), (3, None, 2), (9, "", 3), (None, "no id", 4), (3, "same id", 5), (7, "x " * 3000, 6), (5, "Two words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    B.write_token_files(docs, f"{tmp_path}/f", shard_bytes=20, chunk_ids=500, mode=mode)
    got = sorted(B.read_token_files(spark, f"{tmp_path}/f", digest=True).collect(), key=lambda r: r.start)
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d, zlib.crc32(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, _ in rows if d is not None)
    assert sorted((r.doc_id, r.ids_crc32) for r in got if r.doc_id is not None) == want
    assert [r.doc_id for r in got] == [None, 3, 3, 5, 5, 7, 9]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [len(r.ids) for r in B.read_token_files(spark, f"{tmp_path}/f").orderBy("start").collect()] == [r.n_tokens for r in got]


def test_empty_table(spark, tmp_path):
    B.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/f")
    assert B.read_token_files(spark, f"{tmp_path}/f", digest=True).count() == 0
