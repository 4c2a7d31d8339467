"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder."""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import map_rows, plain_names

ROOT = 0
#: Entries a worker remembers before it starts anew; forgetting costs time, not results.
#: A word or piece (of 64 characters at most) takes some 160 bytes, a state 700, a pair 130: 200 MB
#: together where all are full, as words are kept in two generations.
WORDS_KEPT, PIECES_KEPT, STATES_KEPT, PAIRS_KEPT = 250_000, 40_000, 100_000, 150_000
#: Marks that end words, and the first code point after the Latin letters.
MARKS, LATIN = frozenset(".,;:!?"), chr(0x250)
#: Rows of a batch encoded or decoded before they are sent on.
ROWS_SENT = 1000
NEVER = 1 << 60
#: Bytes after which the transducer looks for tokens to emit; above the longest token.
LOOK_BACK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class State(dict):
    """The open boundaries, and by byte the state after it with the last token of the text so far.

    Steps are made when first taken.
    """

    __slots__ = ("open", "owner")

    def __missing__(self, byte: int) -> tuple[State, int]:
        return self.owner.step(self, byte)


class Transducer:
    """Encodes one piece of text from left to right.

    The tokens of a prefix are the tokens of some shorter prefix and one more token
    that can stand after its last one, and only one pair of the two fits. So a state
    holds the boundaries still open: the token that ends there, and the trie node of
    the bytes since. Reading a byte moves every node on; where a token ends that
    fits, a new boundary opens. No open boundary is older than the longest token,
    so tokens before the last boundary that all open ones share are certain and
    emitted. States and steps are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.spines: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}
        self.pairs: dict[int, bool] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in ranks.items():
            if len(token) > 1 and self.merged(token) != [rank]:
                continue  # only ever a piece of its own
            node = ROOT
            for byte in token:
                below = self.children[node]
                node = below.get(byte, -1)
                if node < 0:
                    node = below[byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.children.append({})
            self.token_at[node] = rank
        none: dict[int, int] = {}
        self.children = [below or none for below in self.children]
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state_of(((-1, ROOT),))

    def state_of(self, open_: tuple) -> State:
        state = self.states.get(open_)
        if state is None:
            state = self.states[open_] = State()
            state.open, state.owner = open_, self
        return state

    def merges(self, piece: bytes) -> Iterator[list[bytes]]:
        """The parts after each merge: always the pair of lowest rank, the first of equals."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        yield parts
        while len(parts) > 1:
            joined = [ranks.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
            low = min(joined)
            if low == NEVER:
                break
            at = joined.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts

    def merged(self, piece: bytes) -> list[int]:
        """Tokens by the definition; for vocabularies and tests, as its time is quadratic."""
        for parts in self.merges(piece):
            pass
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts at the left and at the right edge while the token's bytes merge.

        Each with the rank of the merge that takes it up, the whole token with NEVER.
        """
        held = self.spines.get(token)
        if held is None:
            left: list[bytes] = []
            right: list[bytes] = []
            for parts in self.merges(self.bytes_of[token]):
                if not left or parts[0] != left[-1]:
                    left.append(parts[0])
                if not right or parts[-1] != right[-1]:
                    right.append(parts[-1])
            held = tuple(
                [(part, self.ranks[after] if after else NEVER) for part, after in zip(edge, [*edge[1:], b""])]
                for edge in (left, right)
            )
            self.spines[token] = held
        return held

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stay two when their bytes are merged together.

        They do unless, at some time, the parts that meet at the boundary merge with
        each other before either is taken up by its own token. Of equal ranks the
        merge further left comes first.
        """
        key = before << 32 | token
        held = self.pairs.get(key)
        if held is None:
            right, left = self.spine(before)[1], self.spine(token)[0]
            i = j = 0
            while True:
                part, taken = right[i]
                other, other_taken = left[j]
                rank = self.ranks.get(part + other, NEVER)
                held = not (rank < taken and rank <= other_taken and rank != NEVER)
                if not held or taken == other_taken == NEVER:
                    break
                if taken <= other_taken:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[key] = held
        return held

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The next state and the last token of the text so far."""
        children, token_at, pairs = self.children, self.token_at, self.pairs
        after, ended = [], -1
        for last, node in state.open:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                after.append((last, node))
            if ended < 0:
                token = token_at[node]
                if token >= 0:
                    fits = last < 0 or pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        ended = token
        if ended < 0:
            raise ValueError("the vocabulary lacks a byte")
        after.append((ended, ROOT))
        made = state[byte] = self.state_of(tuple(after)), ended
        return made

    def back(self, lasts: list[int], end: int) -> list[int]:
        """Tokens of the first ``end`` bytes, from the last token of each prefix."""
        out, size = [], self.size
        while end:
            last = lasts[end]
            out.append(last)
            end -= size[last]
        out.reverse()
        return out

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Tokens of a piece in runs, each as soon as later bytes cannot change it."""
        state, lasts = self.start, [-1]
        for byte in piece:
            state, last = state[byte]
            lasts.append(last)
            if len(lasts) > LOOK_BACK:
                if len(self.states) > STATES_KEPT:
                    self.forget()
                    state = self.state_of(state.open)
                sure = self.certain(lasts)
                if sure:
                    yield self.back(lasts, sure)
                    lasts = [-1, *lasts[sure + 1 :]]
        yield self.back(lasts, len(lasts) - 1)

    def certain(self, lasts: list[int]) -> int:
        """The last boundary on the way back from all that may still be open."""
        ends = range(max(0, len(lasts) - 1 - self.longest), len(lasts))
        return max(set.intersection(*[self.boundaries(lasts, end) for end in ends]))

    def boundaries(self, lasts: list[int], end: int) -> set[int]:
        out = {end}
        while end:
            end -= self.size[lasts[end]]
            out.add(end)
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > LOOK_BACK:
            return [token for run in self.stream(piece) for token in run]
        state, lasts = self.start, [-1]
        for byte in piece:
            state, last = state[byte]
            lasts.append(last)
        if len(self.states) > STATES_KEPT:
            self.forget()
        return self.back(lasts, len(piece))


class Pieces(dict):
    """Packed token ids of the pieces met so far."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def fresh(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8"))).tobytes()

    def __missing__(self, piece: str) -> bytes:
        packed = self.fresh(piece)
        if len(piece) < 64:
            if len(self) > PIECES_KEPT:
                self.clear()
            self[piece] = packed
        return packed


class Words(dict):
    """Packed token ids of a space and the word after it, for the words met so far.

    A full table becomes the one before; words met again move from there to the new one,
    so frequent words outlive those met once.
    """

    def __init__(self, split: Callable[[str], list[str]], pieces: Pieces):
        self.split, self.pieces = split, pieces
        self.before: dict[str, bytes] = {}
        letters = "".join(filter(str.isalpha, map(chr, range(ord(LATIN)))))
        marked = [split(f" {c}{mark}") == [f" {c}", mark] for c in letters for mark in MARKS]
        #: The pattern takes a space and Latin letters as one piece, and a mark after them as another.
        self.plain = split(f" {letters}") == [f" {letters}"] and all(marked)

    def packed(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[piece] for piece in self.split(text)])

    def bare(self, word: str) -> bytes:
        """Ids of a word with nothing before it."""
        if self.plain and (word.isascii() or max(word) < LATIN):
            if word.isalpha():
                return self.pieces[word]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return self.packed(word)

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            if self.plain and (word.isascii() or max(word) < LATIN):
                if word.isalpha():
                    packed = self.pieces.fresh(f" {word}")
                elif word[-1:] in MARKS and word[:-1].isalpha():
                    return self[word[:-1]] + self.pieces[word[-1]]
            if packed is None and "\n" in word:
                # a line end between two other signs is a piece by itself; the next word has no space
                head, tail = word.rsplit("\n", 1)
                if head and tail and not head[-1].isspace() and not tail[0].isspace():
                    return self[head] + self.pieces["\n"] + self.bare(tail)
            if packed is None:
                packed = self.packed(f" {word}")
        if len(word) < 64:
            if len(self) >= WORDS_KEPT:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder of one vocabulary."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = pattern
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One codec for each vocabulary and worker."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    @cached_property
    def words(self) -> Words:
        """Made when first needed: a decoder holds no transducer."""
        return Words(regex.compile(self.pattern).findall, Pieces(Transducer(self.ranks)))

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text.

        A piece holds a space only at its start or among white space, so a text may be
        cut before every space that follows something else.
        """
        head, *rest = re.split(r"(?<=\S) ", text) if re.search(r"\s ", text) else text.split(" ")
        packed = [self.words.packed(head)] if head else []
        if len(rest) > 1:
            packed += itemgetter(*rest)(self.words)
        elif rest:
            packed.append(self.words[rest[0]])
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of id chunks; a character cut by a chunk waits for its rest.

        Bytes that are no UTF-8 come out as U+FFFD.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for chunk in ids:
            yield decoder.decode(b"".join(map(self.bytes_of.__getitem__, chunk)))
        yield decoder.decode(b"", final=True)


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``docs`` with its text's token ids as ``ids_column`` (array of int), row by row.

    Null text counts as empty and gives an empty array. Other columns stay, whatever their
    names; one that is already named ``ids_column`` is replaced. Texts are encoded whole.
    """
    plain, named, kept = plain_names(docs, (ids_column,))
    if text_column == ids_column:
        raise ValueError("the ids need a column of their own")
    rows = plain.withColumn("text", F.col(named[text_column]))
    schema = plain.withColumn("ids", F.array().cast("array<int>")).schema

    def run(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for start in range(0, whole.num_rows, ROWS_SENT):
            batch = whole.slice(start, ROWS_SENT)
            found = [codec.encode(t.as_py() or "") for t in batch.column(len(kept))]
            ends = np.cumsum([0, *map(len, found)])
            if ends[-1] >= 1 << 31:
                raise ValueError("a batch holds over 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], ids], schema.names)

    return map_rows(rows, run, schema).toDF(*kept, ids_column)


def decode(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``text_column``; null ids give null.

    Other columns stay, whatever their names; one already named ``text_column`` is replaced.
    """
    plain, named, kept = plain_names(encoded, (text_column,))
    schema = plain.withColumn("text", F.lit("")).schema
    schema["text"].nullable = True
    at = kept.index(ids_column)

    def run(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for start in range(0, whole.num_rows, ROWS_SENT):
            batch, texts = whole.slice(start, ROWS_SENT), []
            for row in batch.column(at):
                held = None if not row.is_valid else row.values.to_numpy()
                if held is None:
                    texts.append(None)
                else:
                    chunks = (held[i : i + 65536].tolist() for i in range(0, len(held), 65536))
                    texts.append("".join(codec.decode(chunks)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return map_rows(plain, run, schema).toDF(*kept, text_column)
