"""Token ids of whole texts by the tokenizers library, in a Python worker.

A BPE tokenizer first cuts a text by a pattern and merges within the cuts only. A space or a line feed is
always such a cut, or leads one, unless it belongs to three or more white-space characters in a row (two at the
text's end). So a text's ids are the ids of its words in a row. Arrow splits a group of texts and numbers its distinct
words; only words not met before go to the library, plain Latin ones without the signs at their end, and the ids of
all words are gathered by one take. The first CACHE_WORDS words, and as many without signs, are kept from group to group, which
bounds the memory and changes no result.

Texts with other runs of white space, or with the string of a special token, go to the library whole. As the library does by default,
such a string becomes the special token's id; with ``special_as_text`` it is ordinary text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 250_000
#: Texts are encoded in groups of about so many bytes; a longer text is cut between words.
GROUP_BYTES = 4_000_000
#: Longer words are not kept.
KEPT_BYTES = 64
#: ASCII signs that are never part of a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: All letters below U+0250 are in composed form, and all but U+0130 have one letter as their lower case.
_LATIN = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130)
_PLAIN = f"^(?P<before>[ \n]?)(?P<letters>[{_LATIN}]+)(?P<tail>[{re.escape(_SIGNS)}]*)$"
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_RUNS = rf"{_WHITE}{{3,}}|{_WHITE}{{2,}}\z"
_CUT = re.compile(r"(?<=\S) (?=\S)")

def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as one character: printable Latin-1 as itself, the others from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return dict(zip([b for b in range(256) if b not in plain], map(chr, range(0x100, 0x200))))


_ALPHABET = _byte_alphabet()
_loaded: dict[tuple[str, bool, bool], "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of this name lies on this machine; other paths pass through."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of values one after another."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


class Kept:
    """Words and their ids, side by side in arrays."""

    def __init__(self):
        self.words, self.values = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for those not kept."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def slices(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        met = places >= 0
        starts[met], lengths[met] = self.starts[places[met]], self.lengths[places[met]]
        return starts, lengths

    def add(self, words: pa.Array, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        room = CACHE_WORDS - len(self.words)
        if room <= 0 or not len(words):
            return
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= KEPT_BYTES)[:room]
        own = lengths[short]
        self.words = pa.concat_arrays([self.words, words.take(pa.array(short))])
        self.starts = np.append(self.starts, np.cumsum(own) - own + len(self.values))
        self.lengths = np.append(self.lengths, own)
        self.values = np.append(self.values, _gather(values, starts[short], own))


class WordEncoder:
    """spaced: words carry the space before them (byte-level BPE); else white space yields no ids."""

    def __init__(self, path: str, spaced: bool, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept, self.letters = Kept(), Kept()

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each text: all values, and how many belong to each."""
        got = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 10_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.fromiter(map(len, got), np.int64, len(got))

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters by the library's model alone: values, lengths. They are one cut each and pass every normaliser but lower case."""
        merge, lead = self.tokenizer.model.tokenize, _ALPHABET[0x20] if self.spaced else ""
        ids, lengths = array("I"), np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            before = lead
            if w[0] == " ":
                before, w = "", w[1:]
            got = merge(before + (w if w.isascii() else w.encode().decode("latin-1").translate(_ALPHABET)))
            lengths[i] = len(got)
            ids.extend([t.id for t in got])
        return np.array(ids, np.uint32), lengths

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words not met before: values, lengths. A space before a word: no space is before it in the text."""
        found = pc.extract_regex(new, pattern=_PLAIN)
        plain = pc.is_valid(found).to_numpy(zero_copy_only=False)
        at, (before, letters, tails) = np.flatnonzero(plain), found.filter(pa.array(plain)).flatten()
        segments, pool = np.zeros((len(new), 3, 2), np.int64), []

        def fill(rows: np.ndarray, column: int, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
            segments[rows, column, 0], segments[rows, column, 1] = starts + sum(map(len, pool)), lengths
            pool.append(values)

        if self.spaced:
            alone = pc.not_equal(before, "")
            heads = pc.if_else(alone, pc.binary_join_element_wise(" ", letters, ""), letters).dictionary_encode()
            breaks = at[pc.equal(before, "\n").to_numpy(zero_copy_only=False)]
            if len(breaks):
                values, lengths = self.each(["\n"])
                fill(breaks, 0, values, 0, lengths[0])
        else:
            heads = pc.utf8_lower(letters).dictionary_encode()
        values, starts, lengths = self.heads(heads.dictionary)
        which = heads.indices.to_numpy()
        fill(at, 1, values, starts[which], lengths[which])
        tails = tails.dictionary_encode()
        rest = np.flatnonzero(~plain)
        for rows, column, texts, which in ((at, 2, tails.dictionary.to_pylist(), tails.indices.to_numpy()), (rest, 1, [self.bare(w) for w in new.take(pa.array(rest)).to_pylist()], np.arange(len(rest)))):
            values, lengths = self.each(texts)
            fill(rows, column, values, (np.cumsum(lengths) - lengths)[which], lengths[which])
        return _gather(np.concatenate(pool), segments[:, :, 0].ravel(), segments[:, :, 1].ravel()), segments[:, :, 1].sum(axis=1)

    def heads(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words of letters: values, starts, lengths."""
        known = self.letters.find(words)
        starts, lengths = self.letters.slices(known)
        new = np.flatnonzero(known < 0)
        names = words.take(pa.array(new))
        values, lengths[new] = self.merged(names.to_pylist())
        starts[new] = np.cumsum(lengths[new]) - lengths[new] + len(self.letters.values)
        every = np.concatenate([self.letters.values, values])
        self.letters.add(names, every, starts[new], lengths[new])
        return every, starts, lengths

    def bare(self, word: str) -> str:
        """What stands in the text for a word of a group."""
        return word if not self.spaced or word[:1] == "\n" else word[1:] if word[:1] == " " else " " + word

    def group(self, texts: pa.Array) -> list[bytes]:
        """texts: no nulls, none to be encoded whole. The ids of each, little-endian."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "), " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        if self.spaced:  # only a first word has no space or line feed before it; no other begins with a space, so one marks it
            first = np.zeros(len(flat), bool)
            first[offsets[:-1]] = True
            flat = pc.replace_with_mask(flat, pa.array(first), pc.binary_join_element_wise(" ", flat.take(pa.array(offsets[:-1])), ""))
        coded = flat.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        known = self.kept.find(words)
        starts, lengths = self.kept.slices(known)
        old, new = self.kept.values, np.flatnonzero(known < 0)
        names = words.take(pa.array(new))
        values, lengths[new] = self.learn(names)
        starts[new] = np.cumsum(lengths[new]) - lengths[new] + len(old)
        every = np.concatenate([old, values])
        self.kept.add(names, every, starts[new], lengths[new])
        sizes = lengths[at]
        ids, ends = _gather(every, starts[at], sizes).astype("<u4", copy=False), np.append(0, np.cumsum(sizes))[offsets]
        raw = memoryview(ids).cast("B")
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must not be cut."""
        out = pc.match_substring_regex(texts, _RUNS) if self.spaced else pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            out = pc.or_(out, pc.match_substring(texts, s))
        return out.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> Iterable[bytes]:
        texts = pc.fill_null(texts, "")
        uncut, sizes = self.whole(texts), pc.binary_length(texts).to_numpy()
        at, n = 0, len(texts)
        while at < n:
            if uncut[at]:
                yield self.each([texts[at].as_py()])[0].astype("<u4", copy=False).tobytes()
                at += 1
                continue
            end, total = at + 1, int(sizes[at])
            if total > 2 * GROUP_BYTES:
                yield b"".join(b"".join(self.group(pa.array([part]))) for part in self.parts(texts[at].as_py()))
                at += 1
                continue
            while end < n and not uncut[end] and total + int(sizes[end]) <= GROUP_BYTES:
                total += int(sizes[end])
                end += 1
            yield from self.group(texts.slice(at, end - at))
            pa.default_memory_pool().release_unused()
            at = end

    @staticmethod
    def parts(text: str) -> Iterable[str]:
        """A long text in parts of about GROUP_BYTES characters, cut before spaces between two words."""
        at = 0
        while m := _CUT.search(text, at + GROUP_BYTES):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


def encoder(name: str, spaced: bool, special_as_text: bool = False) -> WordEncoder:
    """One for each worker process, kept between its tasks."""
    key = (name, spaced, special_as_text)
    if key not in _loaded:
        _loaded[key] = WordEncoder(tokenizer_path(name), spaced, special_as_text)
    return _loaded[key]


def encode_texts(texts: pa.Array | list[str | None], name: str, spaced: bool, special_as_text: bool = False) -> Iterable[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, without an end id."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return encoder(name, spaced, special_as_text).encode(column)
