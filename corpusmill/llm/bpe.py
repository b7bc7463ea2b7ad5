"""Byte-level BPE encoding and decoding.

Encoding: a text is cut into pieces by the tokenizer's pattern. In a piece, an
Aho-Corasick automaton lists every vocabulary entry that occurs. The encoder goes
from left to right, takes the longest entry at each place that may stand after the
entry before it, and steps back where none may. Whether two entries may be
neighbours is read from the table of merges alone: they may not if a merge across
their border would have come before the merges inside them. A place from which no
way leads to the end is marked and never tried again, so the work is linear in the
piece. The result is the one that applying the merges by rank gives. Pieces repeat,
so each worker remembers a bounded number of them.

Decoding: the bytes of all entries lie end to end; an offset table gives each id's
stretch, and a batch of ids is decoded by one gather.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded
each by itself; very long pieces are encoded but not remembered; an empty table
gives an empty result; further columns are ignored; unknown ids raise IndexError.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import re
from pyspark.sql import DataFrame, SparkSession

from .common import lean

#: Pieces and words that a worker remembers, and the length from which it does not.
REMEMBERED, REMEMBERED_WORDS, LONG_PIECE = 200_000, 250_000, 64
#: Bytes of texts that are encoded together.
PORTION_BYTES = 4 << 20
#: Marks that often follow a word.
MARKS = ".,;:!?"
#: White space as the tokenizer's pattern has it. Fixed values of Unicode's White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(major: str, top: int) -> str:
    """The code points up to ``top`` of the general categories that begin with ``major``, as ranges."""
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache
def piece_pattern(top: int) -> re.Pattern:
    """The pattern that cuts texts whose largest code point is at most ``top``."""
    letter, number = _class("L", top), _class("N", top)
    # Letters first: they are most, and nothing else in the pattern begins like them.
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order; together they are the text."""
    if text.isascii():
        return piece_pattern(0x7F).findall(text)
    top = max(set(text))
    return piece_pattern(0x24F if top <= "ɏ" else 0xFFFF if top <= "￿" else sys.maxunicode).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """Raise unless a tokenizer file is of the kind that this module encodes: byte-level BPE, no normalizer."""
    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["model"].get("dropout"):
        raise ValueError("not a byte-level BPE tokenizer without normalizer and prefix space")


class Vocabulary:
    """Entries, merges, automaton and offset table of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        #: Of each merged entry: the rank of its merge and the two parts; single bytes have rank -1.
        self.rank, self.parts, self.joined = {i: -1 for i in by_id}, {}, {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            whole = ids[left + right]
            pair = (ids[left], ids[right])
            self.joined[pair] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = rank, pair
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        size = max(by_id) + 1
        self.lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.compatible: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand right after ``a`` in an encoding."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the later of the merges next to the border until a merge across it would have been due.
        limit = len(self.joined)
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                # at equal rank the left one merges first: a merge of the same rank across the border is due before
                limit, b = rb + 1, self.parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            at[end - length + 1].append((token, length))  # ends rise, so lengths at a start do too
        dead = bytearray(n + 1)
        out: list[int] = []
        ends: list[int] = [0]
        choice: list[int] = [len(at[0]) - 1] if n else []
        while ends[-1] < n:
            place, last = ends[-1], out[-1] if out else -1
            options, i = at[place], choice[-1]
            while i >= 0:
                token, length = options[i]
                if not dead[place + length] and (last < 0 or self.may_follow(last, token)):
                    break
                i -= 1
            if i >= 0:
                choice[-1] = i
                out.append(token)
                ends.append(place + length)
                choice.append(len(at[place + length]) - 1 if place + length < n else -1)
            else:
                dead[place] = 1
                out.pop()
                ends.pop()
                choice.pop()
                choice[-1] -= 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.blob[at].tobytes().decode("utf-8", "replace")


class PieceMemory(dict):
    """Piece to its ids as little-endian 32-bit integers. When full, forgets what it had no use for since it was full last."""

    def __init__(self, encode: Callable[[str], Iterable[int]]) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = array("I", self.encode(piece))
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
        if len(piece) < LONG_PIECE:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class WordMemory(dict):
    """Word to the ids of ``before`` and the word, for words without white space; a text with other words does not fall apart at single spaces and line ends."""

    def __init__(self, before: str) -> None:
        self.before, self.old, self.marks = before, {}, {}

    def all_of(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct words, learned where they are not known; of a word that is not remembered, none."""
        found = list(map(self.get, words))
        rest = [i for i, x in enumerate(found) if x is None]
        self.learn([words[i] for i in rest], encode)
        for i in rest:
            found[i] = self.get(words[i], b"")
        return found

    def learn(self, words: Iterable[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        """Remember ``words``; when full, forget what there was no use for since it was full last.

        Letters and one of ``MARKS`` after them are two pieces, so only the letters are encoded.
        """
        if len(self) >= REMEMBERED_WORDS:
            self.old = dict(self)
            self.clear()
        if not self.marks:
            self.marks = dict(zip(MARKS, encode(list(MARKS)), strict=True))
        old, new, marked, marks = self.old, {}, [], self.marks
        for w in words:
            if w in self or len(w) >= LONG_PIECE:
                continue
            if w in old:
                self[w] = old[w]
            elif w[-1:] in marks and (letters := w[:-1]).isalpha():
                marked.append((w, letters))
                if letters in old:
                    self[letters] = old[letters]
                elif letters not in self:
                    new[letters] = None
            elif w.isalpha() or w.split() == [w]:
                new[w] = None
        self.update(zip(new, encode([self.before + w for w in new]), strict=True))
        for w, letters in marked:
            self[w] = self[letters] + marks[w[-1]]


class TextEncoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers: special tokens first, then words or pieces.

    No piece goes across a space that a word follows, or across a line end between two words.
    So a text in which white space comes singly, as spaces and line ends, is the same
    cut into words; only words not remembered are encoded. Any other text goes to ``encode_text``.
    """

    def __init__(self, specials: dict[str, int], encode_text: Callable[[str], bytes], encode_words: Callable[[list[str]], list[bytes]] | None = None) -> None:
        self.encode_text = encode_text
        self.encode_words = encode_words or (lambda words: list(map(encode_text, words)))
        self.first, self.later, self.end = WordMemory(""), WordMemory(" "), encode_text("\n")
        self.specials = {s: int(i).to_bytes(4, "little") for s, i in specials.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def plain(self, parts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens. Words are told apart by Arrow, a distinct word is looked up once, and ids are gathered for all words together."""
        lines = pc.split_pattern(pa.array(parts, pa.large_string()), "\n")
        split = pc.split_pattern(pc.list_flatten(lines), " ")
        line_at, word_at = lines.offsets.to_numpy(), split.offsets.to_numpy()
        held = pc.list_flatten(split).dictionary_encode()
        words, code = held.dictionary.to_pylist(), held.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(code), bool)
        first[word_at[:-1]] = True
        found: list[bytes] = []
        place = np.zeros((2, len(words)), np.int64)
        for later, memory in enumerate((self.first, self.later)):
            flags = np.zeros(len(words), bool)
            flags[code[first != later]] = True
            used = np.flatnonzero(flags)
            place[later, used] = np.arange(len(found), len(found) + len(used))
            found += memory.all_of([words[i] for i in used.tolist()], self.encode_words)
        # a line's end is a word before each line but a text's first, where it is nothing
        found += (self.end, b"")
        item = np.empty(len(code) + len(word_at) - 1, np.int64)
        starts = word_at[:-1] + np.arange(len(word_at) - 1)
        inside = np.ones(len(item), bool)
        inside[starts] = False
        item[inside] = place[np.where(first, 0, 1), code]
        item[starts] = len(found) - 2
        text_at = np.append(starts, len(item))[line_at]
        item[text_at[:-1]] = len(found) - 1
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin, size = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes[item]
        ends = np.append(0, np.cumsum(size))
        ids = ids[np.repeat(begin[item] - ends[:-1], size) + np.arange(ends[-1])]
        strange = sizes == 0  # words without ids: their texts are encoded whole
        strange[-1] = False
        odd = np.append(0, np.cumsum(strange[item]))
        cuts, odd = ends[text_at].tolist(), odd[text_at].tolist()
        return [ids[cuts[i] : cuts[i + 1]].tobytes() if odd[i] == odd[i + 1] else self.encode_text(t) for i, t in enumerate(parts)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.split(t) if self.cut is not None and any(s in t for s in self.specials) else [t] for t in texts]
        made = iter(self.plain([x for parts in cut for x in parts if x not in self.specials]))
        return [b"".join([self.specials[x] if x in self.specials else next(made) for x in parts]) for parts in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def batches(self, texts: pa.Array) -> Iterator[tuple[str, bytes]]:
        """(text, ids) of each value, null as empty; some at a time, so that no more than these are in memory."""
        for at, end in portions(texts):
            some = [t or "" for t in texts.slice(at, end - at).to_pylist()]
            yield from zip(some, self.encode_many(some), strict=True)


def portions(texts: pa.Array, most: int = PORTION_BYTES, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Where to cut a column so that each portion has ``most`` bytes, or is a single text, and ``rows`` values at most."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(upto):
        before = int(upto[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(upto, before + most, "right"))), at + rows)
        yield at, end
        at = end


@lru_cache(maxsize=4)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path or default_tokenizer())


def new_encoder(path: str | None) -> TextEncoder:
    v = vocabulary(path)
    memory = PieceMemory(lambda piece: v.encode_piece(piece.encode()))
    return TextEncoder(v.specials, lambda text: b"".join(map(memory.__getitem__, pieces(text))))


@lru_cache(maxsize=4)
def text_encoder(path: str | None) -> TextEncoder:
    """An encoder that stays with the worker, with the words that it remembers."""
    return new_encoder(path)


def default_tokenizer() -> str:
    """The path on this machine: asked for by the worker that reads the file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids array<int>: the ids of every text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            made = [ids for _, ids in encoder.batches(batch.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in made])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], [id_col, "token_ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS `{id_col}`", f"CAST(`{text_col}` AS STRING) AS _text").mapInArrow(run, f"`{id_col}` bigint, token_ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id, text: the texts of id lists; a null list has the empty text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for batch in batches:
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS `{id_col}`", f"CAST(`{ids_col}` AS ARRAY<INT>) AS _ids").mapInArrow(run, f"`{id_col}` bigint, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    schema = f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = text_encoder(tokenizer), vocabulary(tokenizer)
        for batch in batches:
            counts, ids_sha, text_sha, same = [], [], [], []
            for text, ids in encoder.batches(batch.column(1)):
                decoded = v.decode(np.frombuffer(ids, "<u4"))
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == text)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS `{id_col}`", f"CAST(`{text_col}` AS STRING) AS _text").mapInArrow(run, schema)


def tokenised(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` that ``docs`` has, n_tokens, token_ids, and whether decoding the ids gives the text back."""
    keep = tuple(c for c in keep if c in docs.columns)
    types = dict(docs.dtypes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, v = new_encoder(tokenizer), vocabulary(tokenizer)  # its words go with the task: other stages share the worker
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounds the ids in memory
                some = batch.slice(k, 256)
                texts = [t or "" for t in some.column(len(keep)).to_pylist()]
                ids = [np.frombuffer(x, "<u4") for x in encoder.encode_many(texts)]
                counts = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                same = pa.array([v.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(counts), lists, same], [*keep, "n_tokens", "token_ids", "round_trip"])

    slim = docs.select(*(f"`{c}`" for c in keep), docs[text_col].cast("string").alias("~text"))
    return slim.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + "n_tokens bigint, token_ids array<int>, round_trip boolean")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
