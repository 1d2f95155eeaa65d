import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from arcwise.llm.catalog import BYTE_BPE, op7_bestfit_packing, op8_packed_matrices
from arcwise.llm.matrix import RoomTree, best_fit_rows, packed_rows, unpacked
from arcwise.llm.packing import best_fit_decreasing, lower_bound, pack, packing_certificate
from arcwise.llm.tokens import Encoder, cut_documents
from tests.llm.common import FOLDER, docs_of, needs_tables

ODD = ["", " ", "  a  b", "a\n\n b", "x <|endoftext|> y", "<|endoftext|>", "don't  stop\t\n _x 1 2", "日本 語", "é   z", "\x1c a", "½ ² Ⅳ a",
       "  a", "a ́b", "z" * 5000, " ".join("abcdefg"[k % 7] for k in range(9000)), "🙂 🙂x \r\n\r\n y"]


PLAIN = Tokenizer.from_file(BYTE_BPE)


def whole_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_by_piece_equal_whole_texts():
    plain, mine = Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    assert mine.by_piece
    rng = random.Random(3)
    made = ["".join(rng.choice(" \n\tabz'.,!é_1 日") for _ in range(rng.randrange(60))) for _ in range(800)]
    for text in ODD + made:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(other.ids("A b"), "<u4").tolist() == other.tokenizer.encode("A b", add_special_tokens=False).ids


def check_packing(rows, texts, size):
    """Every document's ids in order, sequences without gaps and within the size."""
    own, sequences = {}, {}
    for row in rows:
        own.setdefault(row.doc_id, []).append(row)
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for key, text in texts:
        ids, at = whole_ids(text), 0
        pieces = sorted(own[key], key=lambda row: row.piece)
        for number, row in enumerate(pieces):
            part = np.array(ids[row.start : row.start + row.length], "<u4").tobytes()
            assert (row.piece, row.start, row.ids_crc32) == (number, at, zlib.crc32(part))
            assert row.length == size or number == 0
            at += row.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@needs_tables
def test_packing_of_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    packed = op7_bestfit_packing(spark, FOLDER)
    used = check_packing(packed.collect(), docs, 1024)
    row = packing_certificate(packed).first()
    assert row.sequences == used and used <= row.bound * 1.01 + 1


def test_packing_edges(spark, tmp_path):
    docs = [(k, text) for k, text in enumerate([None, *ODD])]
    rows = pack(cut_documents(docs_of(spark, tmp_path, docs), BYTE_BPE), rounds=2)
    check_packing(rows.collect(), docs, 1024)
    assert pack(cut_documents(docs_of(spark, tmp_path, []), BYTE_BPE)).count() == 0
    twice = docs_of(spark, tmp_path, [(1, "a"), (1, "a"), (None, "b")])
    assert pack(cut_documents(twice, BYTE_BPE)).count() == 3
    with pytest.raises(Exception, match="length"):
        pack(spark.createDataFrame([(1025,)], "length LONG")).count()


def test_exchange_wins_bins(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(rng.choice([300, 350, 400, 620, 700]),) for _ in range(3000)], "length LONG")
    once = packing_certificate(pack(frame, group_rows=40, rounds=1)).first()
    more = packing_certificate(pack(frame, group_rows=40, rounds=4)).first()
    assert more.bound == once.bound <= more.sequences <= once.sequences


def test_bound_never_exceeds_best():
    rng = random.Random(7)
    for _ in range(300):
        size = 20
        made = []
        for _ in range(rng.randrange(1, 12)):  # known optimum: full bins cut at random
            cuts = sorted(rng.sample(range(1, size), rng.randrange(0, 4)))
            made += [b - a for a, b in zip([0, *cuts], [*cuts, size], strict=True)]
        lengths = np.array(made)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        assert bound == lengths.sum() // size <= best_fit_decreasing(lengths, size)[2]
    assert lower_bound(np.bincount([600] * 7, minlength=1025), 1024) == 7


def test_room_tree_finds_tightest():
    rng = random.Random(2)
    tree, rooms = RoomTree(50), []
    for step in range(2000):
        if rng.random() < 0.5:
            room = rng.randrange(1, 51)
            tree.add(room, step)
            rooms.append(room)
        else:
            length = rng.randrange(1, 51)
            found = tree.take(length)
            best = min((room for room in rooms if room >= length), default=None)
            assert (found and found[0]) == best
            if best is not None:
                rooms.remove(best)
    assert best_fit_rows([], 5) == []


@needs_tables
def test_matrices_round_trip(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows = op8_packed_matrices(spark, FOLDER)
    check_matrices(rows, docs, 2048, 2)
    odd = [(k, text) for k, text in enumerate([None, *ODD])]
    check_matrices(packed_rows(docs_of(spark, tmp_path, odd), BYTE_BPE, size=64, width=4, block_ids=500), odd, 64, 4)
    assert packed_rows(docs_of(spark, tmp_path, []), BYTE_BPE).count() == 0


def check_matrices(rows, docs, size, width):
    for row in rows.collect():
        assert len(row.ids) == size * width and row.ids_crc32 == zlib.crc32(row.ids)
        assert row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_tokens <= size
        assert row.position_resets == [at for at in row.cu_seqlens if at < size]
    own = {}
    for row in unpacked(rows, width).collect():
        own.setdefault(row.doc_id, []).append((row.piece, row.start, bytes(row.ids)))
    for key, text in docs:
        whole = b"".join(ids for *_, ids in sorted(own[key]))
        assert np.frombuffer(whole, f"<u{width}").tolist() == whole_ids(text)


def test_pieces_add_up_to_whole_texts_of_any_signs():
    plain, mine = Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    signs = [*"aZé ×ñß.'’s\n\t_-,12²ⅷ٣中 <|>", "'s", " '", "<|endoftext|>", "  ", "don't", "word.\n\n"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(3000)]
    found = [ids for at in range(0, len(texts), 128) for ids in mine.many(texts[at : at + 128])]
    whole = plain.encode_batch_fast(texts, add_special_tokens=False)
    assert found == [np.array(one.ids, "<u4").tobytes() for one in whole]
    assert mine.many(texts) == found


def test_plain_pieces_are_put_together_from_their_tokens():
    """Unseen words are not sent through the whole tokenizer, and any mix of characters gives its ids."""
    plain, mine = Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    rng = random.Random(8)
    sent, encode = [], mine._encode
    mine._encode = lambda texts: sent.extend(texts) or encode(texts)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(12)) + rng.choice(("", ",", ".\nNext", "###", "7", "'")) for _ in range(500)]
    text = " ".join(["first", *words])
    assert np.frombuffer(mine.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sent == ["first"]
    letters = [*"aabest  \n\n\t'''.,-_#|<>`@09éßǀ×ʼ٣ª᠎\x1c\x85　\x00\x01", "<|endoftext|>", "'ll", " we're", " \n", "\n ", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    whole = plain.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in mine.many(texts)] == [one.ids for one in whole]
