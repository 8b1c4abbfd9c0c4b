"""Byte-level BPE encoding and decoding by backtracking over an Aho-Corasick automaton.

A text is split by the tokenizer's pattern, and each piece is encoded by itself. The bytes of a piece are read as
Latin-1 letters. An automaton of all tokens, spelt backwards, reads the piece backwards once and so knows the longest
token that begins at each byte. From left to right the longest token is taken that may follow the one before it; where none
may, the token before is taken back for its next shorter prefix, and the place is never tried again. Two tokens may stand
side by side if the two together encode to just these two; that is found by unmaking their last merges, and remembered.
A sequence in which every neighbouring pair may stand so is the one that the merges make, so the result is exact, and as
each place fails at most once, the time is linear in the bytes. A piece is encoded once by a worker and then looked up. Ids
are decoded by gathering the bytes of all tokens of a batch from one array.

The rank file must hold tokens made of tokens of lower rank, as training leaves them; it is read once by each Python worker.

Defined results: a null or empty text has no ids; a text of any length is encoded whole, also a single piece of any
length; repeated rows and ids are encoded row by row; columns named in `keep` come through whatever they are called,
but for `ids` and `decoded`; bytes that are not UTF-8 count as U+FFFD; ids that the file does not have make the decoded
bytes null; null ids decode to no bytes; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import table

#: Bytes of pieces, and pairs of tokens, that a task remembers before it forgets them all.
MEMORY = 80 << 20
PAIRS = 1_000_000
#: Ids that a Python task takes or gives at once.
BATCH_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line each, base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBpe:
    """Exact byte-pair encoding of single pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.beyond = max(self.tokens, default=0) + 1
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter_of: dict[int, int] = {}
        self.parts_of: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of `token`; -1 if there is none."""
        if (known := self.shorter_of.get(token)) is None:
            whole = self.tokens[token]
            known = self.shorter_of[token] = next((self.ranks[whole[:k]] for k in range(len(whole) - 1, 0, -1) if whole[:k] in self.ranks), -1)
        return known

    def made(self, token: int) -> int:
        """The rank of the merge that makes a token; -1 for a single byte."""
        return token if len(self.tokens[token]) > 1 else -1

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a byte, or if merges do not lead to it."""
        if token not in self.parts_of:
            found, whole, left = None, self.tokens[token], self.shorter(token)
            while left >= 0 and found is None:
                right = self.ranks.get(whole[len(self.tokens[left]) :])
                if right is not None and max(self.made(left), self.made(right)) < token and self.whole(left) and self.whole(right) and self.apart(left, right, token):
                    found = left, right
                left = self.shorter(left)
            self.parts_of[token] = found
        return self.parts_of[token]

    def whole(self, token: int) -> bool:
        """Whether the bytes of `token` encode to itself."""
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank below `before` joins parts of two tokens that are made side by side.

        The later of their two last merges is unmade: what then touches must not have merged earlier. Of equal
        merges the one further left goes first.
        """
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < before:
                return False
            made_left, made_right = self.made(left), self.made(right)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                before, left = made_left, self.parts(left)[1]
            else:
                before, right = made_right + 1, self.parts(right)[0]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether `right` may stand after `left` (-1: at the beginning)."""
        key = left * self.beyond + right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.whole(right) and (left < 0 or self.apart(left, right, self.beyond))
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (one := self.ranks.get(piece)) is not None:
            return [one]
        n, beyond = len(piece), self.beyond
        # By the place where they end in the reversed piece. Matches of one place come longest first, so the last to be
        # put into the dict is the longest.
        longest = dict(reversed(list(self.automaton.iter(piece[::-1].decode("latin-1")))))
        failed = bytearray(n + 1)
        pairs, sizes, shorter = self.pairs, self.sizes, self.shorter_of
        ids: list[int] = []
        at, before, token = 0, -1, longest.get(n - 1, -1)
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not failed[end]:
                    fits = pairs.get(before * beyond + token)
                    if self.may_follow(before, token) if fits is None else fits:
                        break
                known = shorter.get(token)
                token = self.shorter(token) if known is None else known
            if token >= 0:
                ids.append(token)
                at, before, token = end, token, longest.get(n - 1 - end, -1)
            else:
                failed[at] = 1
                back = ids.pop()
                at, before = at - sizes[back], ids[-1] if ids else -1
                token = self.shorter(back)
        return ids


class Pieces(dict):
    """Pieces of the pattern and their ids, as bytes of 32-bit numbers. The older half goes when MEMORY is reached."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.bpe = ByteBpe(read_ranks(path))
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = array("i", self.bpe.encode(piece.encode())).tobytes()
        self.held += len(piece) + len(ids) + 200
        if self.held >= MEMORY // 2:
            self.held, self.old = 0, dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@cache
def pieces_of(path: str, pattern: str) -> Pieces:
    """One for each Python worker, which serves many tasks."""
    return Pieces(path, pattern)


class Vocabulary:
    """The bytes of all tokens in one array, by their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        known = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            known[rank] = token
        self.size = np.array([len(token) for token in known], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(known), dtype=np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null for a list with an id that no token has."""
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        ids = lists.flatten().fill_null(-1).to_numpy()
        odd = (ids < 0) | (ids >= len(self.size))
        ids = np.where(odd, 0, ids)
        odd |= self.size[ids] == 0
        sizes = np.where(odd, 0, self.size[ids])
        upto = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(upto[-1], dtype=np.uint8)
        for k in range(0, len(ids), BATCH_IDS):
            part = slice(k, k + BATCH_IDS)
            first = self.start[ids[part]] - (upto[:-1][part] - upto[k])
            n = upto[min(k + BATCH_IDS, len(ids))] - upto[k]
            out[upto[k] : upto[k] + n] = self.pool[np.arange(n) + np.repeat(first, sizes[part])]
        whole = np.diff(np.concatenate(([0], np.cumsum(odd)))[ends]) == 0
        valid = None if whole.all() else pa.py_buffer(np.packbits(whole, bitorder="little"))
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [valid, pa.py_buffer(upto[ends]), pa.py_buffer(out)])


@cache
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def _lists(rows: list[bytes]) -> pa.Array:
    ends = list(accumulate((len(ids) // 4 for ids in rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(rows))]))


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with `ids`, the tokens of each row's text. `ranks` is a path that every executor can read."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(ranks, pattern)
        for batch in batches:
            kept, done, begun, n = batch.column("kept"), [], 0, 0
            for k, text in enumerate(batch.column("body")):
                done.append(pieces.ids(text.as_py().decode("utf-8", "replace")))
                n += len(done[-1]) // 4
                if n >= BATCH_IDS or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([kept.slice(begun, k + 1 - begun), _lists(done)], names=["kept", "ids"])
                    done, begun, n = [], k + 1, 0

    return rows.mapInArrow(run, f"kept {rows.dtypes[0][1]}, ids array<int>").select("kept.*", "ids")


def decode_ids(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the bytes that the ids stand for."""
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(ranks)
        for batch in batches:
            lists = batch.column("ids")
            ends, begun = np.cumsum(lists.value_lengths().to_numpy()), 0
            while begun < batch.num_rows:  # slices of about BATCH_IDS ids, of one row at least
                before = ends[begun - 1] if begun else 0
                n = max(1, int(np.searchsorted(ends, before + BATCH_IDS, side="right")) - begun)
                done = vocabulary.decode(lists.slice(begun, n)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(begun, n), done], names=["kept", "decoded"])
                begun += n

    return held.mapInArrow(run, f"kept {held.dtypes[0][1]}, decoded binary").select("kept.*", "decoded")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` encoded by byte_bpe_50k.tiktoken and decoded again, with the digests of both."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = decode_ids(coded, ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
