import hashlib

import public_tokenizers as files
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import pieces, queries

PATH = files.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.model(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert MODEL.encode([text])[0] == LIBRARY.encode(text)
    assert MODEL.decode(LIBRARY.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "the", "in", "er", " ", "  ", "▁", "\n", "0", "12", "é", "<s>", "<0x41>", "aaaa", "==", "日"]), max_size=40))
def test_texts_of_pieces(parts):
    assert MODEL.encode(["".join(parts)])[0] == LIBRARY.encode("".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_decoding_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab  \n▁é日x0", max_size=200)), max_size=12))
def test_many_texts_at_once(texts):
    """Words, runs of spaces and fallbacks of texts that lie side by side don't touch each other."""
    ids, at = MODEL.encode_flat(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [LIBRARY.encode(t or "") for t in texts]


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in rows:
        ids = LIBRARY.encode(r[1] or "")
        want.append((repr(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = queries.op10_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_long_words_and_runs():
    for text in (" " * 5000, "a" * 5000, "ab" * 3000, "x " * 3000, "=" * 777, "日本" * 500):
        assert MODEL.encode([text])[0] == LIBRARY.encode(text)


def test_columns(docs, rows):
    coded = pieces.decode_column(pieces.encode_column(docs.select("doc_id", "text", F.lit(1).alias("n")), PATH), PATH)
    assert coded.columns == ["doc_id", "n", "ids", "decoded"]
    want = sorted((repr(r[0]), LIBRARY.encode(r[1] or ""), LIBRARY.decode(LIBRARY.encode(r[1] or ""))) for r in rows)
    assert sorted((repr(r.doc_id), r.ids, r.decoded) for r in coded.collect()) == want


def test_empty(empty):
    assert pieces.map_ids(empty.select("doc_id", "text"), PATH, "n bigint, a string, b string", pieces.digests).count() == 0
