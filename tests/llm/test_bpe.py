import hashlib
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe, token_files

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
LIB = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(bpe.text_encoder(PATH).encode(text), "<u4").tolist()


def test_every_code_point_is_cut_as_the_library_does():
    for start in range(0, sys.maxunicode, 4096):
        chars = [chr(c) for c in range(start, min(start + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1 {c}{c}\n" for c in chars)
        mine, want = ids(text), LIB.encode(text, add_special_tokens=False).ids
        assert mine == want, hex(start)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abthe n'sd\n\t ", max_size=300))
def test_same_ids_as_the_library_and_back(text):
    got = ids(text)
    assert got == LIB.encode(text, add_special_tokens=False).ids
    assert bpe.vocabulary(PATH).decode(np.array(got, np.uint32)) == text


def test_long_single_pieces():
    for text in ("a" * 3000, "ab" * 2000, "=" * 2500, "\n" * 700, "lolololol" * 300, "日本" * 500):
        assert ids(text) == LIB.encode(text, add_special_tokens=False).ids


def test_decode_of_partial_characters():
    some = ids("日本🙂é")
    for k in range(len(some)):
        assert bpe.vocabulary(PATH).decode(np.array(some[k:], np.uint32)) == LIB.decode(some[k:], skip_special_tokens=False)


def test_documents(docs, no_docs, rows):
    want = sorted(((r[0], LIB.encode(r[1] or "", add_special_tokens=False).ids) for r in rows), key=repr)
    got = bpe.encode_documents(docs)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == want
    texts = sorted(((r[0], r[1]) for r in bpe.decode_documents(got).collect()), key=repr)
    assert texts == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    trip = bpe.round_trip(docs).collect()
    assert all(r.round_trip for r in trip) and len(trip) == len(rows)
    by_id = {r[0]: r for r in trip}
    for i, want_ids in want:
        assert by_id[i].ids_sha256 == hashlib.sha256(np.array(want_ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(no_docs).count() == 0


def test_token_files(spark, docs, no_docs, rows, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path)
    got = sorted(token_files.read_digests(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in rows))
    at = 0
    assert len(got) == len(ordered)
    for r, (i, text) in zip(got, ordered, strict=True):
        want = LIB.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (i, at, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    some = token_files.read_tokens(spark, path, 3, 5).collect()
    assert {r.doc_id for r in some} == {3, 4, 5}
    token_files.write_token_files(no_docs, str(tmp_path / "none"))
    assert token_files.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_token_file_layout(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "layout")
    token_files.write_token_files(docs, path)
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["token_ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_portions_are_cut_by_bytes():
    texts = pa.array(["a" * 3, None, "b" * 10, "", "cc", "d"])
    assert list(bpe.portions(texts, 4, 3)) == [(0, 2), (2, 3), (3, 6)]
    assert list(bpe.portions(texts.slice(2), 4, 2)) == [(0, 1), (1, 3), (3, 4)] and list(bpe.portions(texts.slice(6))) == []


def test_a_known_word_is_not_learned_again():
    asked = []

    def words(units):
        asked.extend(units)
        return [u.encode("utf-32-le") for u in units]

    encoder = bpe.TextEncoder({"</s>": 9}, lambda text: text.encode("utf-32-le"), words)
    long, texts = "x" * bpe.LONG_PIECE, ["a bb\nccc", "", "a  b", "bb</s>a bb", "\n\n", f"a {bpe.LONG_PIECE * 'x'}"]
    want = [t.encode("utf-32-le") if "</s>" not in t else b"".join([x.encode("utf-32-le") for x in ("bb",)] + [(9).to_bytes(4, "little")] + ["a bb".encode("utf-32-le")]) for t in texts]
    assert encoder.encode_many(texts) == want and encoder.encode_many([]) == []
    told = len(asked)
    assert encoder.encode_many(texts) == want and len(asked) == told and long not in asked
