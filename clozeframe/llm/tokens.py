"""Byte-pair ids of many short pieces at once.

A tokenizer file in which ids follow the order of merges can be read as a table of ranks, and a rank table encodes a long joined
text much faster than a call per word.  What the joined form does not cover goes to the tokenizer itself, piece by piece,
so the ids are always those of ``tokenizers`` with add_special_tokens=False.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clozeframe.llm.common import flat_words, ragged


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pieces:
    """Encodes distinct pieces of text.  A piece that ends a word carries ``mark`` in the rank table, as the file's suffix says."""

    MARK = b"\x00"

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        suffix = model["end_of_word_suffix"] or ""
        special = {t["content"] for t in told["added_tokens"]}
        characters = byte_characters()

        def raw(token: str) -> bytes:
            ends = bool(suffix) and token.endswith(suffix)
            return bytes(characters[c] for c in (token[: -len(suffix)] if ends else token)) + (self.MARK if ends else b"")

        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(ranks) != len(model["vocab"].keys() - special):
            raise ValueError(f"ids do not follow the merges in {path}")
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.ends = np.zeros(len(self.lengths), dtype=bool)
        for token, rank in ranks.items():
            self.lengths[rank], self.ends[rank] = len(token), bool(suffix) and token.endswith(self.MARK)
        if suffix:
            # The bare mark never stays alone: it joins the last byte of its word before any other merge.
            ranks = {t: r for t, r in ranks.items() if t != self.MARK} | {self.MARK: ranks.get(self.MARK, len(self.lengths))}
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def joined(self, pieces: pa.Array) -> np.ndarray:
        """Ids of the pieces written one after another."""
        _, ends, data = pieces.buffers()
        ends = np.frombuffer(ends, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        text = str(memoryview(data)[ends[0] : ends[-1]], "utf-8") if len(pieces) and ends[-1] > ends[0] else ""
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def apart(self, pieces: pa.Array) -> list[np.ndarray]:
        """Ids of each piece by the tokenizer itself."""
        found = self.tokenizer.encode_batch(pieces.to_pylist(), add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def one_by_one(self, pieces: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places, the number of ids of each, and the ids."""
        ids = self.apart(pieces.take(pa.array(places))) if len(places) else []
        return places, np.array([len(i) for i in ids], np.int64), np.concatenate([np.zeros(0, np.uint32), *ids])


Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def spread(found: list[Part], n: int) -> Part:
    """Ids, and start and length for each of ``n`` pieces, from parts (places of pieces, their lengths, ids one after another)."""
    starts, lengths, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for places, sizes, ids in found:
        lengths[places] = sizes
        starts[places] = at + np.cumsum(sizes) - sizes
        at += len(ids)
    return np.concatenate([np.zeros(0, np.uint32), *[ids for _, _, ids in found]]), starts, lengths


def assembled(coded: pa.DictionaryArray, offsets: np.ndarray, encoded: Part) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and each text's offsets, from the ids of the distinct pieces."""
    flat, starts, lengths = encoded
    at = coded.indices.to_numpy()
    sizes = lengths[at]
    return flat[ragged(starts[at], sizes)], np.concatenate([[0], np.cumsum(sizes)])[offsets]


class SpacedText:
    """Ids of whole texts for a byte-level vocabulary that keeps white space.

    No token spans the place before a blank or a line feed, unless three or more stand together or two end the text, so a
    text is cut there and its distinct pieces are encoded once, all in one string.  Texts with such runs, with other white space or with what
    may be a special token are encoded whole; pieces with characters beyond U+024F are encoded one by one.
    """

    # The tokenizer's own pattern without its case of several blanks.
    PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    WHOLE = (
        r"[ \n][ \n][ \n]|[ \n][ \n]\z|<\||[\x00-\x09\x0B-\x1F\x7F-\x{A0}\x{AD}\x{1680}\x{180E}"
        r"\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"
    )
    PLAIN = r"\A[\n\x20-\x7E\x{A1}-\x{24F}]*\z"

    def __init__(self, path: str):
        self.pieces = Pieces(path, self.PATTERN)
        self.bare = {c: self.pieces.apart(pa.array([c]))[0][0] for c in " \n"}

    def distinct(self, pieces: pa.Array) -> Part:
        """Ids, starts and lengths of distinct pieces, each of which starts with white space."""
        found, rest = [], pc.match_substring_regex(pieces, self.PLAIN).to_numpy(zero_copy_only=False).copy()
        found.append(self.pieces.one_by_one(pieces, np.flatnonzero(~rest)))
        for character, number in self.bare.items():
            places = np.flatnonzero(pc.equal(pieces, character).to_numpy(zero_copy_only=False))
            found.append((places, np.ones(len(places), np.int64), np.full(len(places), number, np.uint32)))
            rest[places] = False
        places = np.flatnonzero(rest)
        chosen = pieces.filter(pa.array(rest))
        ids = self.pieces.joined(chosen)
        ends = np.searchsorted(np.cumsum(self.pieces.lengths[ids]), np.cumsum(pc.binary_length(chosen).to_numpy())) + 1
        return spread([*found, (places, np.diff(ends, prepend=0), ids)], len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts one after another, and the offsets of each text's; a NULL text has none."""
        texts = pc.fill_null(texts, "")
        # With a line feed in front every piece starts with white space; its id is dropped again.
        led = pc.binary_join_element_wise(pa.scalar("\n"), texts, "")
        whole = pc.match_substring_regex(led, self.WHOLE)
        led = pc.if_else(whole, "\n", led)
        marked = pc.replace_substring(pc.replace_substring(led, " ", "\x00 "), "\n", "\x00\n")
        cut = pc.split_pattern(marked, "\x00")
        values, offsets = cut.flatten(), cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        full = pc.greater(pc.binary_length(values), 0)
        offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
        coded = values.filter(full).dictionary_encode()
        ids, ends = assembled(coded, offsets, self.distinct(coded.dictionary))
        inner = np.ones(len(ids), bool)
        inner[ends[:-1]] = False
        ids, ends = ids[inner], ends - np.arange(len(ends))
        places = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(places):
            parts = np.split(ids, ends[1:-1])
            for place, own in zip(places, self.pieces.apart(texts.take(pa.array(places))), strict=True):
                parts[place] = own
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends


class LowerWords:
    """Ids of words for a lower-case vocabulary that drops white space and marks the ends of pieces.

    Runs of letters, digits and runs of other characters are the pieces of a word, unless it has an apostrophe, a character beyond Latin-1
    or what may be a special token; such words are left to the tokenizer one by one.
    """

    PLAIN = r"\A[!-&(-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
    PIECE = r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[0-9]|[!-/:-@\[-`{-~]+)"

    def __init__(self, path: str):
        self.pieces = Pieces(path, "[^\\x00]+\\x00")

    def distinct(self, words: pa.Array) -> Part:
        """Ids, starts and lengths of distinct words."""
        plain = pc.and_not(pc.match_substring_regex(words, self.PLAIN), pc.match_substring(words, "<|"))
        mask = plain.to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), self.PIECE, "\\1\x00")
        ids = self.pieces.joined(marked)
        last = np.cumsum(pc.count_substring(marked, "\x00").to_numpy()) - 1
        ends = np.flatnonzero(self.pieces.ends[ids])[last] + 1
        rest = self.pieces.one_by_one(words, np.flatnonzero(~mask))
        return spread([(np.flatnonzero(mask), np.diff(ends, prepend=0), ids), rest], len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts one after another, and the offsets of each text's; no token spans white space."""
        words, offsets = flat_words(texts)
        coded = words.dictionary_encode()
        return assembled(coded, offsets, self.distinct(coded.dictionary))


@lru_cache(maxsize=2)
def spaced_text(path: str) -> SpacedText:
    """One per Python worker, kept from task to task."""
    return SpacedText(path)


@lru_cache(maxsize=2)
def lower_words(path: str) -> LowerWords:
    """One per Python worker, kept from task to task."""
    return LowerWords(path)
