"""Token operators: the memo against the library, wavelet shards, packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from entlink.llm.op1_wavelet import WaveletMatrix, decode_shards, wavelet_shards
from entlink.llm.op3_packing import best_fit_decreasing, certificate, lower_bound, pack, packed_sequences, tokenized_pieces
from entlink.llm.queries import QUERIES
from entlink.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  a  b ", "a \n b", "a\n b", "a\n  b\n", "a\t\tb \n", "é é ΑΣ ΑΣ.", "it's 's ' s", "<|endoftext|> x", "a <|endoftext|>b", " ", "\n", "a  b\x1c c", "12 345", "a ", "a\n ", "x　y", "​ a", "İstanbul ß", "ab\x00 c", "́ a ́b", "a\n\nb c\n\n", "\n\na", "a\n\n\nb c", "x.\nyy, z!\n", "A,b ;c", "don't, we'll"]


def direct(enc, text):
    return np.array(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, enc.dtype).tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_equals_library(path, corpus):
    enc = Encoder(path, memo_size=50)
    texts = [t for _, t in corpus] + ODD
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab ,.'\n\té1") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids == direct(enc, text), repr(text)


def test_plain_odd_pieces_are_put_together_from_parts(monkeypatch):
    """Of a word-end vocabulary only the runs of marks go through the whole library, not each new piece."""
    enc, asked, rng = Encoder(WORD), [], random.Random(2)
    whole = enc._whole
    monkeypatch.setattr(enc, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    texts = [" ".join("".join(rng.choice(["a", "Bc", "\xe9", "7", "45", ".", "@", "'s", "'d", "-"]) for _ in range(12)) for _ in range(50)) for _ in range(20)]
    texts += ["pass'so 'S x's9 't'ts %%% a%b", "x" * 70 + "1" + " a1" * 3]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids == direct(enc, text), repr(text)
    assert not [x for x in asked if len(x) <= 64 and any(c.isalpha() for c in x) and x[0] != "'"]


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 5), (511, 3), (512, 1), (5000, 70_000), (3000, 2**31), (2000, 2)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype("<u4")
    data = WaveletMatrix.build(ids).to_bytes()
    matrix = WaveletMatrix.from_bytes(data)
    assert (matrix.decode() == ids).all() and matrix.count(2**32 - 2) == 0
    for i in rng.integers(0, n, 15).tolist() if n else []:
        token = int(ids[i])
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        places = np.flatnonzero(ids == token)
        k = int(rng.integers(0, len(places)))
        assert matrix.access(i) == token and matrix.count(token, low, high) == int((ids[low:high] == token).sum()) and matrix.select(token, k) == places[k]
        with pytest.raises(IndexError):
            matrix.select(token, len(places))
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(bytes(broken))


def test_shards_give_all_ids_back(docs, corpus, empty):
    enc, at, want = Encoder(WORD), 0, {}
    for i, t in sorted(corpus):
        ids = [*np.frombuffer(direct(enc, t), enc.dtype).tolist(), 2]
        want[i], at = (at, len(ids), ids), at + len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in decode_shards(wavelet_shards(docs, WORD, shard_tokens=700)).collect()}
    assert got == want
    assert decode_shards(wavelet_shards(empty, WORD)).count() == 0


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for capacity in (10, 100, 2048):
        for _ in range(10):
            lengths = rng.integers(1, capacity + 1, 200)
            bins, offsets, levels = best_fit_decreasing(lengths, capacity)
            assert levels.max() <= capacity and len(levels) >= lower_bound(lengths, capacity) >= -(-lengths.sum() // capacity)
            for b in range(len(levels)):
                own = np.argsort(offsets[bins == b])
                assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == offsets[bins == b][own]).all()
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([4, 4, 4, 4]), 10) == 2 and lower_bound(np.array([], int), 10) == 0


def test_packing(docs, corpus, empty):
    enc = Encoder(BYTE)
    pieces = tokenized_pieces(docs, BYTE, capacity=256, keep_ids=True)
    packed = pack(pieces, 256, group_size=40)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in corpus:
        ids = np.array([*np.frombuffer(direct(enc, t), enc.dtype).tolist(), 0], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r.piece), 0
        for k, r in enumerate(own):
            part = ids[at : at + r.length].tobytes()
            assert (r.piece, r.start, r.ids_crc32, bytes(r.ids)) == (k, at, zlib.crc32(part), part) and (k == 0 or r.length == 256)
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    lengths = np.array([r.length for r in rows])
    made = certificate(packed, 256).first()
    assert made.sequences == len(by_sequence) and lower_bound(lengths, 256) == made.bound <= made.sequences
    assert packed_sequences(packed).where(F.col("n_tokens") * 4 != F.octet_length("ids")).count() == 0
    assert pack(tokenized_pieces(empty, BYTE)).count() == 0
    with pytest.raises(Exception, match="out of range"):
        pack(pieces.withColumn("length", F.lit(None).cast("long"))).count()


def least_bins(lengths, capacity):
    """By trying all placements, largest first, equal rooms once."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_and_certificates_against_all_packings(spark):
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.choice([7, 10, 12])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        assert lower_bound(np.array(lengths), capacity) <= least_bins(lengths, capacity) <= len(best_fit_decreasing(np.array(lengths), capacity)[2])
    claims = 0
    for seed in range(4):
        rng = random.Random(seed)
        df = spark.createDataFrame([(i, rng.randint(2, 10)) for i in range(40)], "key long, length int")
        rows = pack(df, 10, group_size=9).collect()
        assert sorted((r.key, r.length) for r in rows) == sorted(tuple(r) for r in df.collect())
        by_group = {}
        for r in rows:
            if r.certified:
                by_group.setdefault(r.sequence_id if r.sequence_id < 0 else r.sequence_id >> 24, []).append(r)
        for own in by_group.values():  # what was kept together is as few as can be
            claims += 1
            assert len({r.sequence_id for r in own}) == least_bins([r.length for r in own], 10)
    assert claims > 4


def test_exchange_saves_bins_until_none_is_saved(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(300, 900)) for i in range(3000)], "key long, length int").cache()
    lengths = np.array([r.length for r in df.collect()])
    made = certificate(pack(df, 1000, group_size=50), 1000).first()
    apart = sum(len(best_fit_decreasing(lengths[i : i + 50], 1000)[2]) for i in range(0, 3000, 50))
    assert made.bound <= made.sequences < apart and made.sequences <= 1.05 * len(best_fit_decreasing(lengths, 1000)[2])
    with pytest.raises(ValueError, match="clash"):
        pack(df.withColumn("offset", F.lit(1)))


@pytest.mark.parametrize("query", ["op1_wavelet", "op3_packing"])
def test_token_queries(spark, folder, query):
    """The contract's columns, from a folder with null and empty texts, against the library."""
    path, rows, _ = folder
    got = QUERIES[query](spark, path)
    if query == "op1_wavelet":
        assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes[:4]] == ["bigint"] * 4
        enc, at, want = Encoder(WORD), 0, {}
        for i, t in sorted(rows):
            ids = np.array([*np.frombuffer(direct(enc, t), enc.dtype).tolist(), 2], "<u4")
            want[i], at = (at, len(ids), zlib.crc32(ids.tobytes())), at + len(ids)
        assert {r.doc_id: tuple(r[1:4]) for r in got.collect()} == want
        return
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and [t for _, t in got.dtypes[:7]] == ["bigint", "int", *["bigint"] * 5]
    enc, want, filled = Encoder(BYTE), [], {}
    for i, t in rows:
        ids = np.array([*np.frombuffer(direct(enc, t), enc.dtype).tolist(), 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = got.collect()
    assert sorted(tuple(r[:5]) for r in found) == sorted(want)
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
