"""Token operators against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cartograph.llm import bpe, packing, token_codec, token_counts

BPE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(BPE))


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_whole_encoding(tok):
    rnd = random.Random(1)
    marks = ["a", "b", " ", "  ", "\n", "\n\n", "\r\n", "Ġ", "Ċ", "\t", " \n", "é", "'s", "1", "!", "\x1c", "　", "\xa0", "<|endoftext|>", "foo"]
    texts = ["", " ", "a  b", *("".join(rnd.choices(marks, k=rnd.randint(0, 30))) for _ in range(3000))]
    enc = bpe.PieceEncoder(public_tokenizers.path(BPE), keep=50)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        ids, ends = enc.ids(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 4095, 4097, 9000])
def test_frame_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 50257).astype(np.uint16)
    frame = token_codec.write_frame([(7, ids[: n // 2]), (8, ids[n // 2 :])], 3)
    start, docs = token_codec.read_frame(frame)
    assert start == 3 and [d for d, _ in docs] == [7, 8] and np.array_equal(np.concatenate([a for _, a in docs]), ids)
    if n > 1:
        bad = bytearray(frame)
        bad[-9] ^= 4
        with pytest.raises(token_codec.CorruptFrame):
            token_codec.read_frame(bytes(bad))
    with pytest.raises(token_codec.CorruptFrame):
        token_codec.read_frame(b"nope" + frame[4:])


def test_sure_predictions_that_fail():
    """Weights at their bounds: long repeats, then each kind of surprise."""
    rng = np.random.default_rng(3)
    cycle = np.tile(np.array([5, 6, 7, 8], np.uint16), 3000)
    for k in range(30):
        ids = cycle.copy()
        at = rng.integers(100, len(ids), 40)
        ids[at] = rng.choice([5, 6, 7, 8, 9, 50_000], 40)
        _, docs = token_codec.read_frame(token_codec.write_frame([(k, ids)], 0))
        assert np.array_equal(docs[0][1], ids)


def test_frames_compress():
    ids = np.tile(np.arange(100, dtype=np.uint16), 400)
    assert len(token_codec.write_frame([(1, ids)], 0)) < len(ids) / 4


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_written_ids(which, request, spark, tok):
    df = request.getfixturevalue(which)
    path = token_codec.frames_path(spark)
    token_codec.write_ids(df, path, BPE, frame_ids=5000)
    want, at = [], 0
    for d, t in sorted(texts_of(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert rows(token_codec.read_ids(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_packing(which, request, tok):
    df = request.getfixturevalue(which)
    got = packing.pack(packing.token_pieces(df, BPE, 0, 512), 512, rows_per_salt=50).collect()
    want = []
    for d, t in texts_of(df):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want += [(d, k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 512
    assert len(by) <= -(-sum(r.length for r in got) // 512) * 1.02 + 1


def test_plan_uses_all_and_is_tight():
    rng = np.random.default_rng(0)
    counts = {}
    for x in np.minimum(2048, rng.lognormal(6.5, 1.2, 50_000).astype(int) + 1).tolist():
        counts[x] = counts.get(x, 0) + 1
    used = {}
    for inside, k in packing.plan(counts):
        assert sum(inside) <= 2048
        for x in inside:
            used[x] = used.get(x, 0) + k
    assert used == counts
    assert sum(k for _, k in packing.plan(counts)) <= sum(a * b for a, b in counts.items()) / 2048 * 1.001 + 1
    assert packing.plan({5: 3}, 4096) == [((5, 5, 5), 1)] or sum(k for _, k in packing.plan({5: 3}, 4096)) == 1
    assert packing.plan({}) == []


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
@pytest.mark.parametrize("head", [1, 100_000])
def test_token_counts(which, head, request):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = request.getfixturevalue(which)
    got = rows(token_counts.count_tokens(df, "piece_bpe_32k.model", 1000, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len(t.encode()), n := len(sp.encode(t)), n > 1000) for d, t in texts_of(df)]
    assert got == sorted(want, key=str)


def test_pre_tokens():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(2)
    for _ in range(5000):
        t = "".join(rnd.choices(["a", " ", "  ", "\n", "▁", "é", "<s>", "\x00", "the", "ing"], k=rnd.randint(0, 12)))
        assert sum(token_counts.count_piece(sp, p) for p in token_counts.pre_tokens(t)) == len(sp.encode(t)), repr(t)


def test_a_step_puts_out_one_word_at_most():
    """Improbable ids only: no step of a lane may need more room than a word of 32 bits, nor ranges run dry."""
    rng = np.random.default_rng(9)
    ids = rng.permutation(np.arange(40_000, dtype=np.uint16))
    ids[: len(ids) // 2] = np.where(rng.random(len(ids) // 2) < 0.9, 7, ids[: len(ids) // 2])
    sym, f = token_codec._frequencies(ids)
    words = token_codec.encode_blocks(ids, sym, f)
    sizes = [min(token_codec.BLOCK, len(ids) - k * token_codec.BLOCK) for k in range(len(words))]
    assert all(p.dtype == np.uint32 and len(p) <= n + 2 for p, n in zip(words, sizes, strict=True))
    assert np.array_equal(token_codec.decode_blocks(words, sizes, sym, f), ids)


def test_marks_after_words(tok):
    """Pieces that end in marks: the library is asked for a stem once, whatever marks follow, and ids are those of whole texts."""
    enc = bpe.PieceEncoder(public_tokenizers.path(BPE))
    asked = []
    for name in ("_encode", "_encode_plain", "_encode_words"):
        inner = getattr(enc, name, None)
        if inner:
            setattr(enc, name, lambda parts, inner=inner: asked.extend(parts) or inner(parts))
    for text in ("thren edreha", "x thren, edreha.!! thren%%% (thren", "y thren... edreha,\nthren? edreha: thren;"):
        ids, ends = enc.ids(pa.array([text], pa.string()))
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
    assert sum("edreha" in p for p in asked) == 1

    rnd = random.Random(4)
    stems = ["a", "Über", "don't", "x1", "12", "ſs", "ø", "×", "ª", "Ж", "日本", "é", "", "''", "n'", "'s", "\x00", "Ġ", "o\x01", "　b", "½", "ƀq"]
    marks = ["", ",", ".", "%%%", "'", "'s", ",'s", "'.", "!?\"", "<|", "\\", "_", "`~", "´", "…", ".\x1c", "|>"]
    texts = [rnd.choice(["", "\n", "\n\n"]) + "".join(rnd.choice([" ", " ", "\n", "  "]) + rnd.choice(marks[:4]) + rnd.choice(stems) + rnd.choice(marks) for _ in range(rnd.randint(0, 8))) for _ in range(4000)]
    for keep in (20, 1000):
        enc = bpe.PieceEncoder(public_tokenizers.path(BPE), keep=keep)
        for i in range(0, len(texts), 50):
            part = texts[i : i + 50]
            ids, ends = enc.ids(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


def test_weights_in_one_word():
    """Both weights move as they would apart, and stay within 32 and 4064."""
    rng = np.random.default_rng(5)
    m = token_codec._Model(1, np.arange(4), np.full(4, 16_384))
    seen = []
    for k in range(6000):
        m.predict()
        i, w1, w2, p1, p2 = int(m.iq[0]), int(m.w1[0]), int(m.w2[0]), int(m.p1[0]), int(m.p2[0])
        assert int(m.f1[0] + m.f2[0] + m.rest[0]) == 4096 and min(m.f1[0], m.f2[0], m.rest[0]) >= 1
        x = k % 4 if k % 2000 < 1500 else int(rng.integers(4))
        m.rng[:] = 2**64 - 1
        m.narrow(np.array([x], np.uint32))
        q1, q2 = int(m.q[i]) >> 16, int(m.q[i]) & 0xFFFF
        assert q2 == (w2 + ((4064 - w2) >> 5) if x == p2 else w2 - ((w2 - 1) >> 5))
        assert q1 == (w1 if x == p2 else w1 + ((4064 - w1) >> 5) if x == p1 else w1 - ((w1 - 1) >> 5))
        seen += [q1, q2]
    assert min(seen) >= 32 and max(seen) <= 4064
