"""Ids of a byte-level BPE vocabulary, with those of its pieces remembered.

The vocabulary first divides a text by a fixed rule: letters, digits or other marks, each with one space
before it if there is one, and runs of white space. Pieces never look at one another, so each distinct
piece goes through the tokenizer once. The rule is applied here to texts of ASCII and Latin-1 letters;
other texts are only cut before spaces that a word follows, where such a piece always opens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The rule of the public vocabulary, for texts of ASCII and Latin-1 letters.
RULE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+", re.ASCII
)
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: One space and letters: of many such pieces after one another, each opens with the only token that has a space.
WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Before a space that no white space follows.
CUT = re.compile(r"(?= [^\s])")


def portions(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``most`` bytes together; a longer text is a portion of its own."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        if some and size + len(text) > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


class ByteLevelIds:
    """Ids of texts as little-endian numbers of type ``dtype``.

    ``path``: null takes the public vocabulary of the environment. ``plain_specials``: strings of special
    tokens inside a text are ordinary text. ``limit`` pieces are remembered; those not met for long are
    forgotten. A vocabulary with another way of dividing texts is used on whole texts.
    """

    def __init__(self, path: str | None = None, plain_specials: bool = False, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        rules = json.loads(self.tokenizer.to_str())
        divide, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
        self.specials = [] if plain_specials else [t["content"] for t in added]
        self.divides = (
            divide.get("type") == "ByteLevel" and divide.get("use_regex", True)
            and not divide.get("add_prefix_space") and rules["normalizer"] is None
            and not any(" " in s for s in self.specials) and not any(t["lstrip"] or t["rstrip"] for t in added)
        )
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(words.values()) + 1, bool)
        self.opens[[i for w, i in words.items() if w.startswith("Ġ")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def encode_words(self, words: list[str], together: int = 64) -> list[bytes]:
        """The ids of pieces that are a space and letters, several of them in one call."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for blob in self.encode(["".join(words[i : i + together]) for i in range(0, len(words), together)]):
            starts = (np.flatnonzero(self.opens[np.frombuffer(blob, self.dtype)]) * width).tolist()
            out += [blob[a:b] for a, b in zip(starts, [*starts[1:], len(blob)])]
        return out

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def pieces(self, text: str) -> list[str]:
        """Strings that together are the text and whose ids together are its ids."""
        if not self.divides:
            return [text]
        if self.plain(text):
            return RULE.findall(text)
        out: list[str] = []
        for chunk in CUT.split(text):
            out += RULE.findall(chunk) if self.plain(chunk) else [chunk]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not known yet."""
        if len(self.known) > self.limit // 2:
            self.known, self.former = {}, self.known
        new = pieces.difference(self.known)
        if self.former:
            again = [p for p in new if p in self.former]
            self.known.update(zip(again, map(self.former.__getitem__, again)))
            new.difference_update(again)
        words = [p for p in new if self.divides and WORD.fullmatch(p)]
        others = list(new.difference(words))
        for some, encode in ((words, self.encode_words), (others, self.encode)):
            for at in range(0, len(some), 4096):
                self.known.update(zip(some[at : at + 4096], encode(some[at : at + 4096])))

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, a bounded portion of texts at a time."""
        for portion in portions(texts):
            cut = [self.pieces(t.decode("utf-8", "replace")) for t in portion]
            self.learn(set().union(*cut))
            known = self.known.__getitem__
            for pieces in cut:
                yield b"".join(map(known, pieces))


#: A space that a word does not follow, for the columns' engine of expressions.
NO_WORD = (
    r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"
)


#: A word that the rule above can divide.
PLAIN_WORD = r"^[\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"


def column_ids(texts: pa.Array, ids: ByteLevelIds) -> list[bytes]:
    """The ids of each text of a column.

    Texts are split and their words numbered by column operations, a few million bytes at a time, so that
    only the distinct words of each portion are divided and looked up.
    """
    out: list[bytes] = [b""] * len(texts)
    split = np.zeros(len(texts), bool)
    if ids.divides:
        split = ~pc.match_substring_regex(texts, NO_WORD).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(split)
    size = pc.binary_length(texts).to_numpy()[places]
    for some in np.split(places, np.flatnonzero(np.diff(np.cumsum(size) >> 22)) + 1) if len(places) else []:
        for i, blob in zip(some.tolist(), _split_ids(texts.take(pa.array(some)), ids)):
            out[i] = blob
    others = np.flatnonzero(~split).tolist()
    for i, blob in zip(others, ids.texts([texts[i].as_py().encode() for i in others])):
        out[i] = blob
    return out


def _split_ids(texts: pa.Array, ids: ByteLevelIds) -> list[bytes]:
    """The ids of texts that may be cut at every space."""
    lists = pc.split_pattern(texts, " ")
    first, words = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten()
    numbered = words.dictionary_encode()
    distinct = numbered.dictionary
    plain = pc.match_substring_regex(distinct, PLAIN_WORD).to_numpy(zero_copy_only=False)
    for special in ids.specials:
        plain &= ~pc.match_substring(distinct, special).to_numpy(zero_copy_only=False)
    # Plain words are divided in one go. Of the others, and of words that open a text, there are few.
    inside = np.flatnonzero(plain)
    simple = distinct.take(pa.array(inside))
    pieces = RULE.findall(" " + " ".join(simple.to_pylist())) if len(inside) else []
    outside = np.flatnonzero(~plain)
    rest = [ids.pieces(" " + w) if w else [] for w in distinct.take(pa.array(outside)).to_pylist()]
    rest += [ids.pieces(w) for w in words.take(pa.array(first)).to_pylist()]
    ids.learn(set(pieces).union(*rest))
    known = ids.known.__getitem__
    blobs = list(map(known, pieces))
    width = ids.dtype.itemsize
    ends = np.cumsum(np.fromiter(map(len, blobs), "int64", len(blobs))) // width
    last = np.searchsorted(
        np.cumsum(np.fromiter(map(len, pieces), "int64", len(pieces))), np.cumsum(pc.utf8_length(simple).to_numpy() + 1)
    )
    rest_blobs = [b"".join(map(known, p)) for p in rest]
    until = np.concatenate([ends[last], np.array([len(b) for b in rest_blobs], "int64").cumsum() // width + (ends[-1] if len(ends) else 0)])
    flat = np.frombuffer(b"".join(blobs + rest_blobs), ids.dtype)
    since = np.concatenate([[0], until[:-1]])

    place = np.empty(len(distinct), "int64")
    place[inside], place[outside] = np.arange(len(inside)), len(inside) + np.arange(len(outside))
    codes = place[numbered.indices.to_numpy()]
    codes[first] = len(distinct) + np.arange(len(first))
    sizes = (until - since)[codes]
    total = np.cumsum(sizes)
    at = np.repeat((since[codes] - total + sizes).astype("int32"), sizes)  # a portion has far fewer ids than 2^31
    at += np.arange(len(at), dtype="int32")
    content = flat.take(at, mode="clip").tobytes()
    stops = (np.cumsum(np.add.reduceat(sizes, first)) * width).tolist()
    return [content[a:b] for a, b in zip([0, *stops], stops)]


@cache
def byte_level_ids(path: str | None = None, plain_specials: bool = False) -> ByteLevelIds:
    """One memory for each worker process and vocabulary."""
    return ByteLevelIds(path, plain_specials)
