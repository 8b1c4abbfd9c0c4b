"""Token counts by finite-state tokenizer compilation.

The byte-pair merges of a tokenizer file compile, on demand, into a deterministic transducer over bytes. A state
holds, for each place where a token that is still open may have begun: the vocabulary prefix since then, the last
token before it, and how many tokens the text so far counts more than up to there. A byte leads to the next state and
emits the change of the token count (which may be negative); the end of a pre-token emits the change that closing
it brings. A token may follow another if the two together encode to just these two, which decides every prefix's
last token. A file is read once by each Python task.

Texts are cut into chunks of bytes, anywhere. At white space, around ASCII digits and between a letter and a plain
punctuation mark every run of the tokenizer is in its first state, whatever came before: these are the places where all
states meet. So a chunk's map from the state it is entered in to (state it is left in, tokens) is fixed by three things:
the bytes before the first such place, the tokens from there to the last, the bytes after it. Maps compose by counting
what meets at a cut. Maps of a long document are composed in levels: neighbours are grouped 16 at a time, by (row,
place / 16), each group in its own task, until one map is left.

Defined results: a null or empty text has no bytes and no tokens; a text of any length is counted whole, in chunks; a
run of letters or of marks without any meeting place is carried as bytes until its ends meet; repeated rows and ids are
counted row by row; columns named in `keep` come through whatever they are called, but for n_bytes and n_tokens; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import settled, table

CHUNK = 256 << 10
LIMIT = 2048
#: Maps composed at a time.
FAN = 16
#: Bytes of runs remembered by a task, and states, before it forgets them all.
MEMORY = 96 << 20
STATES = 200_000

#: Places within a run of bytes without white space where the tokenizer starts anew. The ideographs are U+5000 to
#: U+8FFF, all letters; their marks are the ideographic comma, full stop and wide comma.
_MEETING = re.compile(rb"(?=[0-9])|(?<=[0-9])|(?<=[A-Za-z])(?=[,.;:!?])|(?<=[\xe5-\xe8][\x80-\xbf][\x80-\xbf])(?=[,.;:!?]|\xe3\x80[\x81\x82]|\xef\xbc\x8c)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Transducer:
    """Counts the tokens of one pre-token, given as a string of byte letters."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], end: str):
        self.end = end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.made = {token: self.rank[pair] for token, pair in self.parts.items()}
        self.plain: set[str] = {t for t in vocabulary if not t.endswith(end) or t == end}
        self.closing: set[str] = {t[: -len(end)] for t in vocabulary if t.endswith(end) and t != end}
        self.prefixes: set[str] = {t[:i] for t in self.plain | self.closing for i in range(len(t) + 1)}
        self.forget()

    def forget(self) -> None:
        """Start without states; they are made again when met."""
        self.fits: dict[tuple[str, str], bool] = {}
        # A state: ((prefix since a start, last token before it, tokens more than up to there), …).
        self.states: list[tuple[tuple[str, str, int], ...]] = [(("", "", 0),)]
        self.numbers = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.closes: list[int | None] = [None]

    def encode(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging as defined: the pair of least rank first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def whole(self, token: str) -> bool:
        """Whether the letters of `token` encode to itself."""
        if (known := self.fits.get(("", token))) is None:
            closing = token not in self.plain
            letters = list(token[: -len(self.end)] if closing else token)
            if closing:
                letters[-1] += self.end
            known = self.fits["", token] = self.encode(letters) == [token]
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge joins parts of `left` and `right` before the two are made.

        The two are unmade from the last merge on. The parts that then touch must not merge earlier than that
        merge; a merge of equal rank goes first where it stands further left.
        """
        before = len(self.rank)
        while True:
            if self.rank.get((left, right), len(self.rank)) < before:
                return False
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                before, left = made_left, self.parts[left][1]
            else:
                before, right = made_right + 1, self.parts[right][0]

    def may_follow(self, left: str, right: str, closing: bool) -> bool:
        if closing:
            right += self.end
        if not left:
            return self.whole(right)
        if (known := self.fits.get((left, right))) is None:
            known = self.fits[left, right] = self.whole(right) and self.apart(left, right)
        return known

    def step(self, state: int, letter: str) -> tuple[int, int]:
        """The next state and the emitted change of the count."""
        grown = [(p + letter, last, more) for p, last, more in self.states[state]]
        token, more = next((p, m) for p, last, m in grown if p in self.plain and self.may_follow(last, p, False))
        change = 1 - more
        live = tuple((p, last, m + change) for p, last, m in grown if p in self.prefixes) + (("", token, 0),)
        if (number := self.numbers.get(live)) is None:
            number = self.numbers[live] = len(self.states)
            self.states.append(live)
            self.steps.append({})
            self.closes.append(None)
        self.steps[state][letter] = number, change
        return number, change

    def close(self, state: int) -> int:
        """The change of the count when the pre-token ends here."""
        change = next(1 - m for p, last, m in self.states[state] if p in self.closing and self.may_follow(last, p, True))
        self.closes[state] = change
        return change

    def count(self, letters: str) -> int:
        if len(self.states) > STATES or len(self.fits) > STATES:
            self.forget()
        state = total = 0
        steps = self.steps
        for letter in letters:
            state, change = steps[state].get(letter) or self.step(state, letter)
            total += change
        closing = self.closes[state]
        return total + (self.close(state) if closing is None else closing)


class WordCounts(dict):
    """Tokens of a run of bytes without ASCII white space, as the tokenizer file has it; computed when first asked for."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a byte-level BPE with word ends, in lower case")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.parts = regex.compile(split["pattern"]["Regex"]).findall
        names = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(names)).split if names else lambda text: [text]
        self.merges = Transducer([tuple(m) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"])
        self.letters = byte_letters()
        self.known: dict[str, int] = {}
        self.held = 0

    def __missing__(self, run: bytes) -> int:
        pieces = self.special(run.decode("utf-8", "replace"))
        n = len(pieces) - 1
        for piece in pieces:
            # One letter at a time, as the file's Lowercase does: a final sigma has no form of its own.
            low = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            for part in self.parts(low):
                if (k := self.known.get(part)) is None:
                    k = self.known[part] = self.merges.count("".join(self.letters[b] for b in part.encode()))
                    self.held += 2 * len(part) + 100
                n += k
        self.held += len(run) + 100
        if self.held >= MEMORY:
            self.held = 0
            self.clear()
            self.known.clear()
        self[run] = n
        return n


#: Chunk map: (bytes before the first meeting place, or all; tokens between; bytes after the last, or None if none).
ChunkMap = tuple[bytes, int, bytes | None]


def chunk_map(chunk: bytes, counts: WordCounts) -> ChunkMap:
    runs = chunk.split()
    if not runs:
        return (b"", 0, b"") if chunk else (b"", 0, None)
    head = runs.pop(0) if not chunk[:1].isspace() else b""
    if not runs and len(head) == len(chunk):
        places = [m.start() for m in _MEETING.finditer(head)]
        if not places:
            return head, 0, None
        first, last = places[0], places[-1]
        return head[:first], counts[head[first:last]] if first < last else 0, head[last:]
    tail = runs.pop() if runs and not chunk[-1:].isspace() else b""
    between = sum(map(counts.__getitem__, runs))
    if place := _MEETING.search(head):
        head, rest = head[: place.start()], head[place.start() :]
        between += counts[rest] if rest else 0
    if tail and (places := [m.start() for m in _MEETING.finditer(tail)]):
        tail, rest = tail[places[-1] :], tail[: places[-1]]
        between += counts[rest] if rest else 0
    return head, between, tail


def compose(left: ChunkMap, right: ChunkMap, counts: WordCounts) -> ChunkMap:
    """The map of `left` and then `right`; associative."""
    if left[2] is None:
        return left[0] + right[0], right[1], right[2]
    if right[2] is None:
        return left[0], left[1], left[2] + right[0]
    met = left[2] + right[0]
    return left[0], left[1] + (counts[met] if met else 0) + right[1], right[2]


def composed(maps: list[ChunkMap], counts: WordCounts) -> ChunkMap:
    """The map of all chunks in order, composed pairwise, level by level."""
    while len(maps) > 1:
        pairs = [compose(a, b, counts) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = pairs + maps[len(pairs) * 2 :]
    return maps[0] if maps else (b"", 0, None)


def total(whole: ChunkMap, counts: WordCounts) -> int:
    """The tokens of a text by its map, entered in the first state."""
    return whole[1] + sum(counts[x] for x in (whole[0], whole[2]) if x)


_MAP = "head binary, between long, tail binary"


def _columns(maps: list[ChunkMap]) -> list[pa.Array]:
    return [pa.array([m[i] for m in maps], type=t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """`keep` with n_bytes and n_tokens of each row's text. `tokenizer` is a path that every executor can read."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), body.alias("body"), F.monotonically_increasing_id().alias("row"))
    kind = rows.dtypes[0][1]
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / chunk).cast("int") - 1)
    cut = rows.withColumn("nth", F.explode(F.sequence(F.lit(0), last)))
    first = F.when(F.col("nth") == 0, F.struct("kept", F.octet_length("body").cast("long").alias("n_bytes"))).alias("first")
    cut = cut.select("row", "nth", first, F.substring("body", F.col("nth") * chunk + 1, F.lit(chunk)).alias("part"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer)
        for batch in batches:
            got = [chunk_map(x.as_py(), counts) for x in batch.column("part")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "nth", "first")] + _columns(got), names=["row", "nth", "first", "head", "between", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer)
        for batch in batches:
            got = [composed([(m["head"], m["between"], m["tail"]) for m in x.as_py()], counts) for x in batch.column("maps")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "nth", "first")] + _columns(got), names=["row", "nth", "first", "head", "between", "tail"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer)
        for batch in batches:
            n = [total((a.as_py(), b.as_py(), c.as_py()), counts) for a, b, c in zip(*[batch.column(c) for c in ("head", "between", "tail")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(n, type=pa.int64())], names=["first", "n_tokens"])

    one = f"first struct<kept:{kind},n_bytes:bigint>"
    schema = f"row long, nth int, {one}, {_MAP}"
    # The maps are written: a lost executor must not number the rows anew between two levels.
    level = settled(cut.mapInArrow(maps, schema))
    most = level.agg(F.max("nth")).first()[0] or 0
    while most > 0:
        groups = level.groupBy("row", (F.col("nth") / FAN).cast("int").alias("nth")).agg(
            F.first("first", ignorenulls=True).alias("first"), F.sort_array(F.collect_list(F.struct("nth", "head", "between", "tail"))).alias("maps")
        )
        level, most = groups.mapInArrow(joined, schema), most // FAN
    return level.mapInArrow(sums, f"{one}, n_tokens long").select("first.kept.*", "first.n_bytes", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its bytes and tokens by word_bpe_49k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
