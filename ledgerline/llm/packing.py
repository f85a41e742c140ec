"""Packing of tokenised documents into training sequences of balanced attention cost.

Every partition packs its own documents in blocks of bounded size, so packing needs no shuffle. In a block, documents longer than a
sequence first give off whole sequences; what is left is ordered by descending cost (linear plus quadratic in the length) and each
piece goes to the sequence of lowest cost that still has room. A piece that fits nowhere is cut where the roomiest sequence ends.
A block that isn't a partition's last opens only as many sequences as it fills, and hands the rest on; so a partition has
less than one sequence of padding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 4096
BLOCK_TOKENS = 512 * 1024
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n; the two are equal at 2048 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Parts that a generation of the cache holds, and the longest part that is kept.
CACHE_PARTS, CACHE_CHARS = 300_000, 64

# Of the Latin-1 characters in lower case, those that are letters, numbers and white space.
_LETTERS, _NUMBERS, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PARTS = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACE}]+")
# All white space characters.
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, by way of a bounded cache of parts.

    The tokenizer drops white space and parts the rest into runs of letters, single digits, endings with an apostrophe and runs of
    anything else; no token reaches across. Texts of Latin-1 characters are parted here, by the same rule, and each part goes to the
    merge model once. Other texts are parted at white space and each word goes through the whole tokenizer. A text with a special
    token's opening goes through the whole tokenizer in one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # two generations: what the older one lacks or hasn't been asked for again is forgotten
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        one = ByteLevel(add_prefix_space=False, use_regex=False)
        #: How the tokenizer writes the UTF-8 bytes of Latin-1 characters.
        self.written = {c: one.pre_tokenize_str(chr(c))[0][0] for c in range(0x100)}

    def _slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part if part.isascii() and part.isalnum() else part.translate(self.written))]).tobytes()

    def _ids(self, parts: list[str], new: Callable[[str], bytes]) -> bytes:
        ids = self.ids
        try:
            return b"".join([ids[p] for p in parts])
        except KeyError:
            pass
        if len(ids) > CACHE_PARTS:
            self.older, self.ids = ids, {}
            ids = self.ids
        out = []
        for p in parts:
            x = ids.get(p)
            if x is None:
                x = self.older.get(p) or new(p)
                if len(p) <= CACHE_CHARS:
                    ids[p] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._slow(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # a word keeps its white space, so that words and parts don't meet in the cache
            return self._ids([f"{w} " for w in _WORDS.findall(text)], self._slow)
        return self._ids(_PARTS.findall(text.lower()), self._part)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer; its cache lasts as long as the worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cost(n: np.ndarray | float) -> np.ndarray | float:
    """Estimated cost of attending over n tokens."""
    return LINEAR * n + QUADRATIC * n * n


def pack_block(pieces: list[tuple[int, int, int]], size: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pack pieces (document, start, length) into sequences of at most `size` tokens; return sequences and pieces that are left.

    Nothing is left of a last block. Of another, all its sequences are full.
    """
    sequences = []
    rest = []
    for doc, start, n in pieces:
        while n >= size:
            sequences.append([(doc, start, size)])
            start, n = start + size, n - size
        if n:
            rest.append((doc, start, n))
    total = sum(p[2] for p in rest)
    n_open = -(-total // size) if last else total // size
    if not n_open:
        return sequences, rest
    order = sorted(rest, key=lambda p: (-p[2], p[0], p[1]))
    room = np.full(n_open, size)
    spent = np.zeros(n_open)
    opened: list[list[tuple[int, int, int]]] = [[] for _ in range(n_open)]
    left = []
    for doc, start, n in order:
        while n:
            fits = room >= n
            if fits.any():
                k, m = int(np.where(fits, spent, np.inf).argmin()), n
            else:
                k = int(room.argmax())
                m = int(room[k])
            if not m:
                left.append((doc, start, n))
                break
            opened[k].append((doc, start, m))
            room[k] -= m
            spent[k] += cost(m)
            start, n = start + m, n - m
    return sequences + opened, left


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """Tokenise documents and pack them: a row for each piece, with its token ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens
    (with the closing id), sequence_id, offset (ids before the piece in its sequence).

    Null text counts as empty: the document is its closing id alone. A null id stays null. Repeated rows are packed as often as
    they come. Documents longer than a sequence are cut, wherever a sequence ends; every id is in exactly one piece. Ties in cost
    go to the sequence opened first. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[object, bytes]] = {}
        pieces: list[tuple[int, int, int]] = []
        n_docs = n_sequences = waiting = 0
        id_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal pieces, n_sequences, waiting
            sequences, pieces = pack_block(pieces, sequence_tokens, last)
            waiting = sum(p[2] for p in pieces)
            rows: list[tuple] = []
            for seq in sequences:
                at = 0
                for doc, start, n in seq:
                    key, ids = held[doc]
                    rows.append((key, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + n_sequences, at))
                    at += n
                n_sequences += 1
            for doc in held.keys() - {p[0] for p in pieces}:
                del held[doc]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tok.encode(text.as_py() or "") + end
                held[n_docs] = key, ids
                pieces.append((n_docs, 0, len(ids) // 4))
                n_docs += 1
                waiting += len(ids) // 4
                if waiting >= BLOCK_TOKENS:
                    yield flush(False)
        if pieces:
            yield flush(True)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
