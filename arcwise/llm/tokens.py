"""Token ids of whole texts by a public tokenizer, cut into pieces of bounded length."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, kept, map_batches

KEPT_PIECES = 200_000
"""Pieces of each of the two generations that a worker remembers."""
KEPT_CHARS = 40
TEXTS_AT_ONCE = 512
ID_BYTES = 4  # of an id in bytes
# U+180E was a blank in earlier Unicode, so no text is cut there.
BEFORE_VISIBLE, BLANKS = re.compile(r" (?=[^\s\u180e])"), re.compile(r" [\s\u180e]")
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(rf"(?!\n)(?:[{LETTERS}0-9{SIGNS}]++|'(?![{LETTERS}])|\n(?!\n))++")
"""Pieces whose pre-tokens are their runs of letters, digits or signs and single line breaks."""
NEXT_PIECE, NEXT_TOKEN = "\0", "\1"  # in no plain piece
PLAIN_AT_ONCE = 100
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]+|[{SIGNS}']+|\n")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in own]
    return {byte: chr(byte) for byte in own} | {byte: chr(256 + k) for k, byte in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer without normalizer starts a token at every space before a visible character,
    so such a text is the sum of its pieces between these places. The pieces of many texts are told apart
    at once, and each worker encodes a piece once and remembers it. Plain pieces go to the model as their
    pre-tokens, many in one call with bytes between them that merge with nothing; other pieces go through
    the whole tokenizer, and with any other tokenizer whole texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        before = setup.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space", True)
            and before.get("use_regex", True)
            and setup.get("normalizer") is None
            and all(" " not in added["content"] for added in setup.get("added_tokens", []))
            and not any(added.get("lstrip") or added.get("rstrip") for added in setup.get("added_tokens", []))
        )
        self.added = [added["content"] for added in setup.get("added_tokens", [])]
        own = setup["model"]
        self.marks = [self.tokenizer.token_to_id(BYTE_CHARACTERS[ord(mark)]) for mark in (NEXT_PIECE, NEXT_TOKEN)]
        plain = (
            own.get("type") == "BPE"
            and None not in self.marks
            and not any(own.get(name) for name in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(BYTE_CHARACTERS[ord(mark)] in "".join(merge) for merge in own["merges"] for mark in (NEXT_PIECE, NEXT_TOKEN))
        )
        self.model = self.tokenizer.model if plain else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def _are_plain(self, pieces: list[str]) -> list[bool]:
        if self.model is None:
            return [False] * len(pieces)
        plain = [found is not None for found in map(PLAIN.fullmatch, pieces)]
        if any(map(NEXT_PIECE.join(pieces).__contains__, self.added)):
            plain = [own and not any(map(piece.__contains__, self.added)) for own, piece in zip(plain, pieces, strict=True)]
        return plain

    def _encode_plain(self, pieces: list[str]) -> list[bytes]:
        """The ids of a space and each of some plain pieces, by the model alone."""
        done: list[bytes] = []
        for at in range(0, len(pieces), PLAIN_AT_ONCE):
            part = pieces[at : at + PLAIN_AT_ONCE]
            runs = [piece if piece.isalpha() else NEXT_TOKEN.join(RUNS.findall(piece)) for piece in part]
            characters = (" " + f"{NEXT_PIECE} ".join(runs)).encode().decode("latin-1").translate(BYTE_CHARACTERS)
            ids = np.array([token.id for token in self.model.tokenize(characters)], "<u4")
            ids = ids[ids != self.marks[1]]
            ends = (np.flatnonzero(ids == self.marks[0]) * ID_BYTES).tolist()
            whole = ids.tobytes()
            starts = [0, *[end + ID_BYTES for end in ends]]
            done += [whole[start:end] for start, end in zip(starts, [*ends, len(whole)], strict=True)]
        return done

    def _after_space(self, pieces: list[str]) -> list[bytes]:
        """The ids of a space and each of the distinct pieces."""
        if len(self.known) > KEPT_PIECES:
            # Pieces met again since the last change of generations stay, all others go.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if older:
            for k in missing:
                ids = older.get(pieces[k])
                if ids is not None:
                    found[k] = known[pieces[k]] = ids
            missing = [k for k in missing if found[k] is None]
        is_plain = self._are_plain([pieces[k] for k in missing])
        plain, others = ([k for k, own in zip(missing, is_plain, strict=True) if own is kind] for kind in (True, False))
        fresh = self._encode_plain([pieces[k] for k in plain]) + self._encode([" " + pieces[k] for k in others])
        for k, ids in zip(plain + others, fresh, strict=True):
            found[k] = ids
            if len(pieces[k]) <= KEPT_CHARS:
                known[pieces[k]] = ids
        return found

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_piece or not texts:
            return self._encode(texts)
        pieces, bounds = _pieces_of(texts)
        distinct = pieces.dictionary_encode()
        ids = self._after_space(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        # A text's first piece has no space before it.
        heads = self._encode(pieces.take(pa.array(bounds[:-1])).to_pylist())
        places = distinct.indices.to_numpy().astype(np.int64)
        places[bounds[:-1]] = len(ids) + np.arange(len(texts))
        joined = pa.array(ids + heads, pa.large_binary()).take(pa.array(places))
        _, offsets, values = joined.buffers()
        edges = np.frombuffer(offsets, np.int64)[joined.offset + bounds].tolist()
        return [values[start:end].to_pybytes() if end > start else b"" for start, end in zip(edges, edges[1:])]


def _pieces_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts one after another, and where each text's begin, with the end of the last one."""
    if any(map(BLANKS.search, texts)):
        split = [BEFORE_VISIBLE.split(text) if BLANKS.search(text) else text.split(" ") for text in texts]
        pieces = pa.array([piece for own in split for piece in own], pa.large_string())
        return pieces, np.cumsum([0, *map(len, split)])
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64)


@kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_bounds(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter than ``size``."""
    count = max(1, -(-total // size))
    first = total - size * (count - 1)
    return [(0, first)] + [(first + size * k, size) for k in range(count - 1)]


def cut_documents(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 1024,
    end_id: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32 and, if asked for, ids.

    A text is its token ids and then ``end_id``; a null text is an empty one, so every row gives a
    piece. Pieces hold at most ``size`` ids, and together all ids in order. Repeated rows give
    repeated pieces; other columns are not read.
    """
    fields = [
        T.StructField(id_column, docs.schema[id_column].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for row, ids_of_text in enumerate(encode.many([text or "" for text in part.column(1).to_pylist()])):
                    whole = ids_of_text + end
                    for piece, (start, length) in enumerate(piece_bounds(len(whole) // ID_BYTES, size)):
                        own = whole[start * ID_BYTES : (start + length) * ID_BYTES]
                        rows.append(row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                keys = part.column(0).take(pa.array(rows, pa.int64()))
                yield batch_of(schema, [keys, pieces, starts, lengths, sums] + [ids] * with_ids)

    return map_batches(docs.select(F.col(id_column), F.col(text_column)), work, schema)
