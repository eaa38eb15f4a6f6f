"""Encoding against the library, rows against spans."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tallyframe.llm.pieces import Encoder, Normalizer, decode, encode, model_bytes
from tests.llm.cases import TEXTS, documents, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "\n\n x\ty", "▁a▁ b", "日本語 テキスト 🙂🙂 z", "</s> <s> <0x41> <unk>", "a\x00b", "é́ ﬁ ①", " " * 50 + "x" + " " * 40, "ｶﾞ ㍿ Å", "한국어 각"]
_draw = random.Random(5)
ODD += ["".join(_draw.choice("ab  \n▁é日🙂x.<>0ﬁ①") for _ in range(_draw.randint(0, 40))) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_spans_equal_the_library(library):
    encoder = Encoder(model_bytes(PATH))
    for text, (ids, begins, ends) in zip(ODD, encoder.encode([t.encode() for t in ODD])):
        assert ids.tolist() == library.encode(text, add_eos=True)
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == want


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps(rule, squeeze):
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    normalizer = Normalizer(proto.normalizer_spec, False)
    for text in ODD:
        data, align = normalizer(text.encode())
        assert data.decode() == own.normalize(text)
        assert len(align) == len(data) + 1 and align[-1] <= len(text.encode())
        assert (align[1:] >= align[:-1]).all()


def test_rows(spark, library):
    results = ("ids", "begins", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes")
    rows = encode(documents(spark), PATH, carry=("doc_id", "text", "size"), results=results)
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    want = []
    for doc, text, *_ in TEXTS:
        ids = library.encode(text or "", add_eos=True)
        plain = library.decode(ids)
        want.append((doc, ids, plain, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
    assert sorted(((r[0], r[3], r[6], *r[7:10]) for r in got), key=str) == sorted(want, key=str)
    for _, text, _, ids, begins, ends, *_, spans in got:
        data = (text or "").encode()
        assert all(0 <= a <= b <= len(data) for a, b in zip(begins, ends)) and spans == sum(b - a for a, b in zip(begins, ends))
        assert spans == len(data)  # this model keeps every byte


def test_decode_rows(spark, library):
    rows = spark.createDataFrame([(1, library.encode("Hello wörld 🙂")), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(rows, PATH).collect()} == {1: "Hello wörld 🙂", 2: None, 3: ""}
    assert encode(empty(documents(spark)), PATH).isEmpty()
