"""Operators 4, 8 and 9 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scoreloom.llm import sstable
from scoreloom.llm.byte_bpe import ByteTokenizer
from scoreloom.llm.common import materialise, shared_folder
from scoreloom.llm.piece_bpe import PieceModel, encode_decode
from scoreloom.llm.token_spans import allocate, line_bounds, section_tokens

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "The", "ing", " ", "  ", "\n", "é", "ß", "日", "\U0001f600", "\x00", "!", "1", "23", "'s", "\t", ".", ",", "\r\n", "　", "\x1c", "\x1f", "\xa0", "́", "<|endoftext|>", "|", "▁", " " * 17, "<s>", "<0x0A>"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 20))) for _ in range(n)] + [" " * k for k in range(40)] + ["a" * k for k in range(40)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_pieces_equal_the_library():
    ours, theirs = PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in texts(3000, 1):
        want = theirs.encode(t)
        assert ours.encode(t) == want
        assert ours.decode(",".join(map(str, want))) == theirs.decode(want)


def test_small_memory_changes_nothing():
    a, b = PieceModel(PIECES, 8), PieceModel(PIECES)
    for t in texts(100, 2):
        assert a.encode(t) == b.encode(t)


def test_pieces_query(odd, clashing, empty, documents):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (odd, clashing, documents):
        want = []
        for r in df.collect():
            ids = theirs.encode(r["text"] or "")
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids))))
        got = [tuple(r) for r in encode_decode(df, PIECES).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_decode(empty, PIECES).count() == 0
    with pytest.raises(ValueError):
        encode_decode(odd, PIECES, outputs=("nothing",))


def test_byte_tokens_equal_the_library(library):
    for ours in (ByteTokenizer(BYTES), ByteTokenizer(BYTES, 4000)):
        some = texts(3000, 3)
        for t, ids, spans in zip(some, ours.ids(some), ours.spans(some)):
            want = library.encode(t, add_special_tokens=False)
            assert np.frombuffer(ids, "<u4").tolist() == want.ids
            assert spans.tolist() == [list(o) for o in want.offsets]


def test_added_tokens_are_found_as_the_library_finds_them(library):
    ours = ByteTokenizer(BYTES)
    for t in ("a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|> y", "a\n <|endoftext|>\nb", "<|endoftext|><|endoftext|> z", "<|endoftext"):
        assert np.frombuffer(next(ours.ids([t])), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded_in_bytes(library):
    """Texts without spaces are one key each: none is kept, and short ones only up to the limit."""
    r = random.Random(6)
    ours, pieces = ByteTokenizer(BYTES, 1 << 20), PieceModel(PIECES, 1 << 20)
    for _ in range(60):
        some = ["".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(5000))] + [" ".join(str(r.random()) for _ in range(200))]
        ids = list(ours.ids(some))
        assert np.frombuffer(ids[0], "<u4").tolist() == library.encode(some[0], add_special_tokens=False).ids
        list(pieces.encode_texts(some))
        for memory in (ours.pieces, pieces.chunks):
            assert memory.size <= memory.half + 200_000
            assert max(map(len, memory.young), default=0) <= memory.longest


def test_shard_lookup():
    shard = sstable.Shard(64)
    stored = {i * 3 - 30: np.arange(i, dtype="<u4") * 40_000 for i in range(50)}
    for k in sorted(stored):
        shard.add(sstable.key_of(k, 0), stored[k])
    table = sstable.Table(shard.finish())
    assert [sstable.id_of(k) for k, _ in table] == sorted(stored)
    assert all((table.get(k)[0] == v).all() for k, v in stored.items())
    assert all(table.get(k * 3 - 29) == [] for k in range(50))
    assert len(table.blocks) > 3
    assert list(sstable.Table(sstable.Shard(64).finish())) == []
    with pytest.raises(ValueError):
        sstable.Table(bytes(64))


def test_sstable_round_trip(spark, odd, clashing, empty, library):
    for df in (odd, clashing, empty):
        folder = shared_folder(spark, "test-shards")
        manifest = materialise(sstable.write_shards(df, folder, BYTES, shard_bytes=2000, block_bytes=100, partitions=3), "manifest")
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for k, t in rows:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(map(tuple, sstable.read_shards(spark, folder, manifest).collect()), key=lambda r: r[1]) == want
        shards = sorted(((r["name"], r["first_key"]) for r in manifest.collect()), key=lambda r: bytes(r[1]))
        if want:
            assert len(sstable.lookup(folder, shards, 6)) == 2 and sstable.lookup(folder, shards, 10) == []


def test_sections(odd, empty, library):
    got = section_tokens(odd, BYTES).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in odd.dropDuplicates(["doc_id", "text"]).collect():
        t, n = r["text"] or "", len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        parts = by[r["doc_id"]]
        assert sum(p["n_tokens"] for p in parts) == n * (2 if r["doc_id"] == 6 else 1)
        assert {(p["start_char"], p["end_char"]) for p in parts} == set(zip(line_bounds(t)[:-1].tolist(), line_bounds(t)[1:].tolist()))
    assert section_tokens(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        section_tokens(odd, BYTES, rule="both")


def test_allocation_rules():
    bounds = np.array([0, 4, 8, 20])
    spans = np.array([[0, 3], [3, 6], [6, 7], [7, 9], [9, 20]])
    assert allocate(spans, bounds, "majority")[0].tolist() == [1, 3, 1]
    assert allocate(spans, bounds, "start")[0].tolist() == [2, 2, 1]
    r = random.Random(4)
    for _ in range(200):
        edges = sorted({0, 30, *(r.randint(1, 29) for _ in range(4))})
        cuts = sorted({0, 30, *(r.randint(1, 29) for _ in range(6))})
        want = [0] * (len(edges) - 1)
        for a, b in zip(cuts, cuts[1:]):
            share = [max(0, min(b, e) - max(a, s)) for s, e in zip(edges, edges[1:])]
            want[share.index(max(share))] += 1
        assert allocate(np.array(list(zip(cuts, cuts[1:]))), np.array(edges), "majority")[0].tolist() == want


def test_plain_words_go_to_the_model_without_a_detour(monkeypatch):
    """ASCII words need no mapping of bytes; ids are the library's for these and for words of other letters."""
    import public_tokenizers

    from scoreloom.llm import byte_bpe

    tokenizer = byte_bpe.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for body in ("a", "word", "Zymurgy", "straße", "naïve", "Øl", "supercalifragilistic"):
        for line in (False, True):
            assert tokenizer._word(body, line) == tokenizer._plain([("\n" if line else " ") + body])[0]
    monkeypatch.setattr(byte_bpe, "ALPHABET", None)  # not looked at for ASCII
    assert tokenizer._word("plainword", False) == tokenizer._plain([" plainword"])[0]
    assert tokenizer._pieces(["other."])["other."] == tokenizer._plain([" other."])[0]


def test_a_waiting_worker_gives_free_memory_back(monkeypatch):
    import threading

    from scoreloom.llm import recent

    told, over = [], threading.Event()
    monkeypatch.setattr(recent, "give_back", lambda real=recent.give_back: (real(), told.append("back"), over.set()))
    with recent.Rest(lambda: told.append("forgot"), 0.05):
        pass
    assert over.wait(10) and told == ["forgot", "back"]


def test_pieces_of_few_rows_are_held_at_once(documents, monkeypatch):
    import public_tokenizers

    from scoreloom.llm import piece_bpe

    assert piece_bpe.ROWS <= 500
    run = lambda: sorted(map(tuple, piece_bpe.encode_decode(documents, public_tokenizers.path("piece_bpe_32k.model")).collect()))
    whole = run()
    monkeypatch.setattr(piece_bpe, "ROWS", 7)
    assert run() == whole and len(whole) == documents.count()
