import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import token_packing
from panelspark.llm.queries import op12_token_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def direct(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, packed, capacity=4096, short=32):
    """Every id of every document lies in one piece, sequences have no gaps and little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, len(ids)))
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(direct(text))
    assert want.keys() == pieces.keys()
    for i, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, ids, total in sorted(pieces[i]):
                assert (start, total) == (at, len(texts[0])) and ids == texts[0][at : at + len(ids)]
                at += len(ids)
            assert at == len(texts[0])
        else:
            assert sorted(x for _, ids, _ in pieces[i] for x in ids) == sorted(x for t in texts for x in t)
    for found in sequences.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert capacity - short < at <= capacity or at & (at - 1) == 0


def test_edge_rows(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    check(rows, token_packing.pack(edge, PATH).collect())
    assert token_packing.pack(nothing, PATH).collect() == []


@pytest.mark.parametrize("capacity,open_windows,fan", [(64, 3, 2), (256, 1, 3), (1024, 8, 16)])
def test_small_windows_over_many_partitions(spark, documents, capacity, open_windows, fan):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    packed = token_packing.pack(documents.repartition(13), PATH, capacity=capacity, open_windows=open_windows, fan=fan, least=4)
    check(rows, packed.collect(), capacity, 8)


def test_words_one_by_one_are_the_whole_text(spark):
    blob = open(PATH, encoding="utf-8").read()
    texts = [
        "Don't 'S <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "a b ć ́d\x1ce\x85f​g　h", "A\tB\r\nC\x0bD\x0cE",
        "ΟΔΟΣ İstanbul ǅ ﬁ Straße 漢字かな 한국어 é \U0001f600\U0001f600 1234 ½ ²", "", "́", " \n", "a" * 5000, "١٢٣ १२३ ﻿x",
    ]
    texts += ["it's IT'S we'll'd 'sx x'tre !'s --'m ''ll don''t a1b22 x\x00y\x7fz", "Éa×b÷ c ÀÖØöøÿ Āİıŉǅȿ ªº µ «x» “y’s” naïve'll", "e\u0301 ée\u0301x x\u0300'd"]
    got = token_packing.tokenize(pa.array([*texts, None]), blob)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [direct(t)[:-1] for t in [*texts, ""]]


def test_best_window_is_taken_and_the_fullest_emitted():
    packer = token_packing.Packer(capacity=16, open_windows=2, least=2)
    piece = lambda name, n: (name, 0, bytes(4 * n), n)
    for name, n in (("a", 10), ("b", 13), ("c", 3), ("d", 5), ("e", 8), ("f", 6)):
        packer.add(piece(name, n))
    # c fills b's window, d fits beside a only, e opens a window, f tops a's last place not up, but goes beside e.
    assert [(p[0], n, at) for p, n, at in packer.done] == [("b", 0, 0), ("c", 0, 13)]
    assert [(p[0], w) for p, w, _ in packer.left()] == [("a", 0), ("d", 0), ("e", 2), ("f", 2)]
    packer.add(piece("g", 9))  # none fits: the fullest has one place, too little for a piece
    assert [p[0] for p, n, _ in packer.done if n == 1] == ["a", "d"]


def test_query(spark):
    got = op12_token_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    whole = {r.doc_id: np.array(direct(r.text), "<u4") for r in docs}
    for r in got.collect():
        assert r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
    assert got.agg(F.sum("length")).first()[0] == sum(map(len, whole.values()))
