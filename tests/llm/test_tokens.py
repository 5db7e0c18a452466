import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from titlelake.llm import bpe_speculate, packing_pow2, records, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t'sab1.é½Ⅳ\x1c\x85 　日"), st.characters(exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0xFFFF)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_and_merges_match_the_library(text):
    want = ids_of(text)
    assert np.frombuffer(tokens.tokens(PATH).encode([text])[0], "<u4").tolist() == want
    codec = bpe_speculate.codec(PATH)
    got = codec.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 3_000, "the" * 5_000, "<|endoftext|>" * 3 + " x<|endoftext|>"])
def test_long_words_and_added_tokens(text):
    assert np.frombuffer(bpe_speculate.codec(PATH).encode([text])[0], "<u4").tolist() == ids_of(text)


def test_words_are_forgotten_and_made_again(monkeypatch):
    monkeypatch.setattr(bpe_speculate, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    rng, codec, own = random.Random(3), bpe_speculate.Codec(PATH), tokens.Tokens(PATH)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdet") for _ in range(rng.randint(1, 6))) for _ in range(9)) for _ in range(3)]
        for t, a, b in zip(texts, codec.encode(texts), own.encode(texts)):
            assert np.frombuffer(a, "<u4").tolist() == np.frombuffer(b, "<u4").tolist() == ids_of(t)


def test_decoding_replaces_what_is_no_text():
    codec = bpe_speculate.codec(PATH)
    for ids in ([codec.single[0xC3]], [codec.single[0xFF], 64, codec.single[0xE2], codec.single[0x82]]):
        assert codec.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_round_trip_of_documents(edge_docs, edge_rows, no_docs):
    got = sorted(bpe_speculate.round_trip(edge_docs, PATH).collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(i := ids_of(t)), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for d, t in edge_rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bpe_speculate.round_trip(no_docs, PATH).count() == 0
    back = bpe_speculate.decode_documents(bpe_speculate.encode_documents(edge_docs, PATH), PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(d), t or "") for d, t in edge_rows)


def test_packing_holds_each_id_once(edge_docs, edge_rows, no_docs, tmp_path):
    packed = packing_pow2.pack(edge_docs, PATH, size=256)
    rows = packed.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 256 and r["offset"] == 0 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            by.setdefault(r["doc_id"], []).append([])
        own = by[r["doc_id"]][-1]
        assert r["start"] == len(own)
        own += struct.unpack(f"<{r['length']}I", r["ids"])
        assert r["doc_tokens"] >= len(own)
    want = {}
    for d, t in edge_rows:
        want.setdefault(d, []).append([*ids_of(t), 0])
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing_pow2.pack(no_docs, PATH).count() == 0
    packing_pow2.write_buckets(packed, str(tmp_path / "b"))
    assert packed.sparkSession.read.parquet(str(tmp_path / "b")).count() == len(rows)


def test_cuts():
    assert packing_pow2.cuts(2049 + 5, 1024) == [1024, 1024, 4, 2]
    assert packing_pow2.cuts(1, 1024) == [1]


def test_records_round_trip(spark, edge_docs, edge_rows, no_docs, tmp_path):
    path = str(tmp_path / "r")
    got = records.encode_and_read_back(edge_docs, PATH, path).collect()
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for d, t in order:
        ids = [*ids_of(t), 0]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    # any records by the index alone
    index = spark.read.parquet(f"{path}/index")
    some = index.filter("doc_id in (1, 6, 16)")
    picked = {r["doc_id"]: list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) for r in records.read_records(spark, f"{path}/data", some).collect()}
    texts = dict(edge_rows)
    assert picked == {d: [*ids_of(texts[d]), 0] for d in (1, 6, 16)}
    assert records.encode_and_read_back(no_docs, PATH, str(tmp_path / "e")).count() == 0


def test_many_files_keep_the_order(spark, tmp_path):
    docs = spark.range(500, 0, -1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 40) as text")
    records.write_records(docs, PATH, str(tmp_path / "d"), file_bytes=9_000)
    index = records.build_index(spark, str(tmp_path / "d"), str(tmp_path / "i"))
    rows = index.orderBy("part", "offset").collect()
    assert len({r["part"] for r in rows}) > 5
    assert [r["doc_id"] for r in rows] == list(range(1, 501))


def test_damage_is_found():
    data = records.frame(7, struct.pack("<3I", 1, 2, 70_000), 4) + b"\n" + records.frame(None, struct.pack("<I", 5), 2) + b"\n"
    assert [(x[2], x[3]) for x in records.frames(data)] == [(7, struct.pack("<3I", 1, 2, 70_000)), (None, struct.pack("<I", 5))]
    for at in (0, 9, 15, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="damaged record"):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError, match="damaged record"):
        list(records.frames(data[:-2]))


def test_pieces_are_numbered_within_their_bucket(edge_docs):
    rows = packing_pow2.digests(packing_pow2.pack(edge_docs.repartition(3), PATH, size=256)).collect()
    assert all(1 << r["bucket"] == r["length"] for r in rows)
    own = {}
    for r in rows:
        own.setdefault((r["bucket"], r["bucket_sequence"] >> 40), []).append(r["bucket_sequence"] & (1 << 40) - 1)
    assert len({b for b, _ in own}) > 4 and all(sorted(x) == list(range(len(x))) for x in own.values())
