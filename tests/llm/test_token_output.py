import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from silvatrack.llm import token_output as out


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_piece_encoder_equals_the_tokenizer(tokenizer, rows):
    texts = [r[1] or "" for r in rows]
    texts += ["it's don''t !!'s 's'S o'ne-two's", "a≮b ≠ ｆｕｌｌ", "Å̱ ǅ İI ß", "x y z\x1cw\x85v", "1a2b c3.4 ٣٤", "日本語テキスト、です", "<|startoftext|>", "a<|endoftext|>b c"]
    flat, sizes = out.PieceEncoder(public_tokenizers.path("word_bpe_49k.json")).encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, sizes):
        assert flat[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        at += n
    assert at == len(flat)


def test_cache_limit_does_not_change_ids(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(r[1] or "").encode() for r in rows]
    small, large = out.PieceEncoder(path, 10), out.PieceEncoder(path)
    assert [small.encode([t])[0].tolist() for t in texts] == [large.encode([t])[0].tolist() for t in texts]


def test_files_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(out, "FRAME_BYTES", 64)
    docs = [(i if i != 2 else None, np.arange(n, dtype="<u4") * 7) for i, n in enumerate([0, 3, 5, 40, 1, 2, 0, 16, 9])]
    file = io.BytesIO()
    writer = out.TokenWriter(file)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    data = file.getvalue()
    reader = out.TokenReader(io.BytesIO(data), len(data))
    assert [(i, x.tolist()) for i, x in reader.documents()] == [(i, x.tolist()) for i, x in docs]
    read = []
    frame = reader.frame
    reader.frame = lambda i: read.append(i) or frame(i)
    assert [x.tolist() for _, x in reader.documents([7, 3])] == [docs[7][1].tolist(), docs[3][1].tolist()]
    assert len(read) == 2 < len(reader.frames)
    broken = bytearray(data)
    broken[int(reader.offsets[1]) + 9] ^= 1
    with pytest.raises(Exception):
        list(out.TokenReader(io.BytesIO(bytes(broken)), len(broken)).documents())


def test_digest_matches_brute_force(documents, rows, tokenizer):
    got = [tuple(r) for r in out.token_digest(documents).orderBy("start").collect()]
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(nothing):
    assert out.token_digest(nothing).collect() == []


def test_random_pieces_encode_as_the_tokenizer_does(tokenizer):
    rng = np.random.default_rng(3)
    letters = list("abcXYZßÀéöøÿ×÷'’.,!0189٣ \n-İıſẞΣ́あ") + ["the", "ing", "’s", "'LL"]
    encode = out.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), 500).encode
    for _ in range(30):
        texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(100)]
        flat, sizes = encode([t.encode() for t in texts])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]


def test_files_are_ended_at_a_size(documents, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(out, "FILE_DOCS", 2)
    monkeypatch.setattr(out, "STEP_BYTES", 100)
    whole = out.read_tokens(out.write_tokens(documents, f"{tmp_path}/one", files=2), f"{tmp_path}/one").collect()
    table = out.write_tokens(documents, f"{tmp_path}/two", files=1)
    assert table.agg({"docs": "sum"}).first()[0] == len(rows)
    assert sorted(map(str, whole)) == sorted(map(str, out.read_tokens(table, f"{tmp_path}/two").collect()))
