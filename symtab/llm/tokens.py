"""Public tokenizers inside Python workers, by segments of a text that occur again and again.

A *segment* begins with a space or a line feed that follows a character other than white space, and runs to the next such
place. Neither kind of tokenizer used here lets a token cross it: the byte-level one splits there before it merges, and no
piece of the other holds a space or a line feed after another character (its vocabulary is checked). The ids of a text are
therefore those of its segments in a row, whatever its length: a block of texts is cut and its distinct segments are
numbered by Arrow, libraries see each of them once, and the ids of the texts are put together by numpy. Memory is bounded by
the block and by the longest segment.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any version of Unicode, and a few characters that some tools count as such.
_SPACE = "\t-\r\x1c- \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Where a space or a line feed follows white space and so begins no segment; texts with a NUL go the slow way too.
_OPEN = f"[{_SPACE}][ \n]|\0"
_ENDS_OPEN = re.compile(f"[{_SPACE}]\\Z")
#: A line feed or a space, some letters and some marks: white space, word and marks are merged apart.
_SIMPLE = r"\A(?:\n ?| )[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+[!-&(-/:-@\[-`{-~]*\z"


def segments(text: str) -> list[str]:
    """The segments of a text, one by one."""
    out, held = [], ""
    for part in re.split("(?=[ \n])", text):
        held += part
        if not _ENDS_OPEN.search(part):
            out.append(held)
            held = ""
    return [*out, held]


def split(texts: pa.Array) -> pa.ListArray:
    """The segments of each text, and maybe empty strings. The usual texts are cut by Arrow."""
    is_open = pc.match_substring_regex(texts, _OPEN)
    plain = pc.filter(texts, pc.invert(is_open))
    parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n"), "\0")
    if len(plain) == len(texts):
        return parts
    others = pa.array([segments(t) for t in pc.filter(texts, is_open).to_pylist()], parts.type)
    number = np.empty(len(texts), np.int64)
    at = is_open.to_numpy(zero_copy_only=False)
    number[~at], number[at] = np.arange(len(plain)), len(plain) + np.arange(len(others))
    return pa.concat_arrays([parts, others]).take(pa.array(number))


def size_blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges with sizes of about ``limit`` together; a larger one stands alone."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class SegmentIds:
    """Ids of texts by one or more encoders, each of which gives the ids of a list of segments and how many each has."""

    def __init__(self, *encoders: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encoders = encoders

    def of(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of all texts in a row, and where each text's ids begin (and the last end)."""
        lists = split(texts)
        numbered = lists.flatten().dictionary_encode()
        place = numbered.indices.to_numpy()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for encode in self.encoders:
            ids, lengths = encode(numbered.dictionary)
            n = lengths[place]
            out.append((ids[ranges((np.cumsum(lengths) - lengths)[place], n)], np.concatenate([[0], np.cumsum(n)])[at]))
        return out


class Remembered(dict):
    """Ids of segments that a library gave one by one; forgets everything when full."""

    LIMIT, LONGEST = 200_000, 64

    def of(self, texts: list[str], make: Callable[[list[str]], Iterable[list[int]]]) -> list[list[int]]:
        if len(self) > self.LIMIT:
            self.clear()
        new = [t for t in texts if t not in self]
        made = dict(zip(new, make(new), strict=True))
        self.update((t, ids) for t, ids in made.items() if len(t) <= self.LONGEST)
        return [made[t] if t in made else self[t] for t in texts]


def in_turn(simple: np.ndarray, ids: np.ndarray, lengths: np.ndarray, others: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Puts together the ids of segments where ``simple`` holds and those of the others."""
    all_lengths = np.empty(len(simple), np.int64)
    all_lengths[simple], all_lengths[~simple] = lengths, np.fromiter(map(len, others), np.int64, len(others))
    out = np.empty(all_lengths.sum(), np.uint32)
    from_simple = np.repeat(simple, all_lengths)
    out[from_simple] = ids
    out[~from_simple] = np.fromiter(chain.from_iterable(others), np.uint32)
    return out, all_lengths


def in_a_row(texts: pa.StringArray) -> str:
    """All strings joined: Arrow holds them so."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    return texts.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode() if ends[-1] > ends[0] else ""


def cut_by_bytes(ids: np.ndarray, byte_lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many ids cover each of the segments, whose bytes are ``sizes``."""
    ends = np.searchsorted(np.cumsum(byte_lengths[ids]), np.cumsum(sizes), side="right")
    return np.diff(ends, prepend=0)


class ByteLevel:
    """The byte-level tokenizer of a file (by default ``byte_bpe_50k.json``), with one thread, as a task has one core.

    Segments that are a word of Latin letters and marks, which are most, take a short way: it is certain how the
    tokenizer splits them, and the same merges, from the same file, are done by a faster library for all of them at once.
    """

    def __init__(self, path: str | None = None, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.library.encode_special_tokens = plain_specials
        # printable bytes of Latin-1 stand for themselves, the others for characters 256, 257, ... in order
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        value = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.token_bytes = [bytes(map(value.__getitem__, self.library.id_to_token(i))) for i in range(self.library.get_vocab_size())]
        self.byte_lengths = np.array([len(b) for b in self.token_bytes])
        specials = self.library.get_added_tokens_decoder()
        ranks = {b: i for i, b in enumerate(self.token_bytes) if i not in specials}
        self.merges = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remembered = Remembered()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = pc.match_substring_regex(texts, _SIMPLE).to_numpy(zero_copy_only=False)
        words = pc.filter(texts, pa.array(simple))
        ids = self.merges.encode_to_numpy(in_a_row(words))
        lengths = cut_by_bytes(ids, self.byte_lengths, pc.binary_length(words).to_numpy())
        return in_turn(simple, ids, lengths, self.remembered.of(pc.filter(texts, pa.array(~simple)).to_pylist(), self.whole))

    def whole(self, texts: list[str]) -> Iterator[list[int]]:
        """Asked for some thousands at a time: the library's own results are large."""
        for start in range(0, len(texts), 4096):
            for found in self.library.encode_batch(texts[start : start + 4096], add_special_tokens=False):
                yield found.ids


class Pieces:
    """The piece tokenizer of a file (by default ``piece_bpe_32k.model``), which puts a space before a text.

    A line feed before a segment keeps that space away from it: both are ids of their own, and are taken off again. A
    segment whose pieces do not give its bytes has the one id BAD.
    """

    BAD = 0xFFFFFFFF
    SPACE = "\u2581"

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(self.SPACE in p.lstrip(self.SPACE) or ("\n" in p and len(p) > 1) for p in self.pieces):
            raise ValueError("a piece crosses the beginning of a segment")
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_lengths = np.array([len(b) for b in self.token_bytes])
        self.before = self.library.encode("\n")
        if [self.token_bytes[i] for i in self.before] != [b" ", b"\n"]:
            raise ValueError("a line feed is not a token of its own")
        self.remembered = Remembered()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = pc.invert(pc.match_substring_regex(texts, f"[{_SPACE}]\\z|\\0|{self.SPACE}|^$")).to_numpy(zero_copy_only=False)
        words = pc.filter(texts, pa.array(simple))
        parts = [words.slice(i, 4096) for i in range(0, len(words), 4096)]
        found = self.library.encode(["\n" + in_a_row(p) for p in parts], num_threads=1)
        ids = np.concatenate([np.array(x[2:], np.uint32) for x in found]) if parts else np.zeros(0, np.uint32)
        sizes = pc.binary_length(words).to_numpy()
        if self.byte_lengths[ids].sum() != sizes.sum():
            simple[:], ids, sizes = False, ids[:0], sizes[:0]  # some character is not kept: each segment by itself
        others = self.remembered.of(pc.filter(texts, pa.array(~simple)).to_pylist(), self.each)
        return in_turn(simple, ids, cut_by_bytes(ids, self.byte_lengths, sizes), others)

    def each(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            ids = self.library.encode("\n" + text, num_threads=1)[2:] if text else []
            yield ids if b"".join(map(self.token_bytes.__getitem__, ids)) == text.encode() else [self.BAD]
