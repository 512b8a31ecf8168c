"""Token ids of whole texts by a public tokenizer, with a table of the segments seen so far.

A text is cut into segments at places where the tokenizer's own splitting cuts too, so the ids of a text are those of its segments in
turn. Natural text repeats its segments, and one that was seen before costs a look-up.

byte: white space together with the word after it; this tokenizer never joins a word with the white space behind it. A comma or full stop at
the end of a word is a segment of its own where a letter or digit stands before it.
word: words between white space, which this tokenizer drops.

A segment's key is the word where one blank (byte) or nothing (word) stands before it, else a line feed and the segment as it is.

Arrow cuts and numbers the segments of a batch, so Python sees each distinct one of a batch once. byte: new ones go to the tokenizer's model many
at a time, with letters between them that no merge of the model touches.
"""

from __future__ import annotations

import codecs
import json
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from operator import attrgetter
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Segments a worker remembers; beyond it, it forgets those that few batches had.
REMEMBER = 500_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 2_000_000

# The characters that the tokenizers' patterns take for white space.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SEGMENT = {"byte": regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"), "word": regex.compile(f"[^{SPACE}]+")}
#: str.split() takes these for white space, the tokenizers don't.
ODD = regex.compile(r"[\x1c-\x1f]")
#: Texts that are not words with a blank or line feeds between them (RE2).
UNEVEN = rf"\A[ \n]|[ \n]\z|  | \n|\n |[\x1c-\x1f{SPACE.replace(' ', '').replace(chr(10), '')}]"
#: Texts in which a comma or full stop ends a word, or is one, without a letter or digit before it (RE2).
BOUND = r"(\A|[^\pL\pN])[.,]([ \n]|\z)"
#: Signs that the tokenizers' patterns cut off from the letters before them, whatever follows.
SIGNS = set(".,;:!?)")
END_KEY = "\n"
#: The pattern of byte-level tokenizers; asked of ASCII only, where all versions of Unicode agree.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Between the pieces of a segment, and behind a segment, where many go to the model as one; no piece holds them.
CUT, STOP = "\x01", "\x00"
#: Segments that go to the model as one.
AT_ONCE = 1000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


BYTES = byte_letters()
#: UTF-8 has no bytes 0xC0 and 0xC1, so their letters stand for the two marks.
LETTERS = BYTES[0xC0] + BYTES[0xC1] + "".join(BYTES[2:])


class Encoder:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold a special token's name go to the tokenizer as a whole, which gives it the token's id.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        self.model = self.tokenizer.model
        self.signs: dict[str, list[int]] = {}
        self.marks = self.unmerged(LETTERS[0], LETTERS[1]) if kind == "byte" else None
        self.forget()

    def unmerged(self, stop: str, cut: str) -> tuple[int, int] | None:
        """Ids of two letters, if the model has both and never merges them with others, and takes nothing but merges into account."""
        ids, model = (self.model.token_to_id(stop), self.model.token_to_id(cut)), json.loads(self.tokenizer.to_str())["model"]
        merges = "".join("".join(pair) for pair in model["merges"])
        besides = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return None if besides or None in ids or stop in merges or cut in merges else ids

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)
        self.used = 0

    def thin_out(self) -> None:
        """Keep the segments of more than one batch, half of the table at most."""
        names, n = list(self.place), len(self.place)
        hits = self.hits[:n]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > REMEMBER // 2:
            keep = np.sort(np.argpartition(hits, n - REMEMBER // 2)[n - REMEMBER // 2 :])
        sizes, old = self.length[keep], self.start[keep]
        first = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(old - first, sizes) + np.arange(int(sizes.sum()))]
        self.forget()
        self.add([names[i] for i in keep.tolist()], flat, sizes)

    def keys(self, text: str) -> list[str]:
        if any(name in text for name in self.special):
            return ["\n" + text if self.kind == "byte" else text]
        if self.kind == "word":
            return SEGMENT["word"].findall(text) if ODD.search(text) else text.split()
        return [s[1:] if s[0] == " " and s[1:2] and s[1] not in SPACE else "\n" + s for s in SEGMENT["byte"].findall(text)]

    def spread(self, text: str, bound: bool) -> str:
        """The keys of an even text and the end key, a blank between any two; `bound` if its commas and full stops stay with their words."""
        if self.kind == "word":
            return f"{' '.join(text.split() if chr(10) in text else [text])} {END_KEY}"
        keys = "\n" + text.replace("\n", " \n\n").replace("\n \n", "\n") + " "
        return (keys if bound else keys.replace(", ", " \n, ").replace(". ", " \n. ")) + END_KEY

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct keys, the number among them of each segment's key, and how many segments each text has, its end key included."""
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, UNEVEN)
        for name in self.special:
            uneven = pc.or_(uneven, pc.match_substring(column, name))
        aside, bound = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (uneven, pc.match_substring_regex(column, BOUND)))
        # The texts that are cut here stand behind the others at first.
        own = [[*self.keys(texts[i]), END_KEY] for i in np.flatnonzero(aside).tolist()]
        lines = [self.spread(t, b) if t else END_KEY for t, a, b in zip(texts, aside.tolist(), bound.tolist(), strict=True) if not a]
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        numbered = pa.concat_arrays([words.flatten(), pa.array([k for ks in own for k in ks], pa.large_string())]).dictionary_encode()
        codes = numbered.indices.to_numpy()
        sizes = np.zeros(len(texts), np.int64)
        sizes[~aside], sizes[aside] = np.diff(words.offsets.to_numpy()), [len(ks) for ks in own]
        if own:
            order = np.argsort(aside, kind="stable")
            first = np.empty(len(texts), np.int64)
            first[order] = np.cumsum(sizes[order]) - sizes[order]
            codes = codes[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))]
        return numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), codes, sizes

    def segment(self, key: str) -> str:
        return key[1:] if key[0] == "\n" else " " + key if self.kind == "byte" else key

    def letters(self, word: str) -> list[int] | None:
        """word: ids of a word of letters alone, from the model itself."""
        word = word.lower() if word.isascii() else "".join(c.lower() for c in normalize("NFC", word))
        if not word.isalpha():
            return None
        shown = word if word.isascii() else "".join([BYTES[b] for b in word.encode()])
        return [x.id for x in self.model.tokenize(shown)]

    def sign(self, mark: str) -> list[int]:
        ids = self.signs.get(mark)
        if ids is None:
            ids = self.signs[mark] = [x.id for x in self.model.tokenize(mark)]
        return ids

    def pieces(self, key: str) -> str | None:
        """byte: the pieces of a segment, a mark between any two; None if only the tokenizer can tell them."""
        if any(name in key for name in self.special):
            return None
        body = key.lstrip("\n")
        word = body.rstrip(string.punctuation)
        if word.isalpha():
            feeds = len(key) - len(body) - 1  # of the segment; no line feed at all stands for a blank
            before = [" ", "", f"\n{CUT}"][feeds + 1] if feeds < 2 else "\n" * (feeds - 1) + f"{CUT}\n{CUT}"
            return before + word if word == body else f"{before}{word}{CUT}{body[len(word) :]}"
        if body.isascii() and body.isprintable():
            return CUT.join(PIECE.findall(self.segment(key)))
        return None

    def learn(self, fresh: list[str]) -> None:
        """What can be cut into the tokenizer's pieces here goes to its model; the tokenizer takes the other segments."""
        odd = self.learn_words(fresh) if self.kind == "word" else self.learn_pieces(fresh) if self.marks else fresh
        if odd:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([self.segment(k) for k in odd], add_special_tokens=False)]
            self.add(odd, [i for ids in found for i in ids], [len(ids) for ids in found])

    def learn_pieces(self, fresh: list[str]) -> list[str]:
        """byte: many segments with marks between go to the model as one; the keys of the others are returned."""
        pieces = [" " + k if k.isalpha() else self.pieces(k) for k in fresh]
        odd = [k for k, p in zip(fresh, pieces, strict=True) if p is None]
        keys, parts = ([k for k, p in zip(fresh, pieces, strict=True) if p is not None], [p for p in pieces if p is not None]) if odd else (fresh, pieces)
        stop, cut = self.marks
        for at in range(0, len(keys), AT_ONCE):
            joined = STOP.join([*parts[at : at + AT_ONCE], ""])
            tokens = self.model.tokenize(codecs.charmap_decode(joined.encode(), "strict", LETTERS)[0])
            ids = np.fromiter(map(attrgetter("id"), tokens), np.int32, len(tokens))
            real = (ids != stop) & (ids != cut)
            self.add(keys[at : at + AT_ONCE], ids[real], np.diff(np.cumsum(real)[ids == stop], prepend=0))
        return odd

    def learn_words(self, fresh: list[str]) -> list[str]:
        """word: letters, with or without one sign behind them, go to the model; the keys of the others are returned."""
        flat: list[int] = []
        sizes: list[int] = []
        odd: list[str] = []
        keys: list[str] = []
        for key in fresh:
            if key.isalpha():
                ids = self.letters(key)
            elif key[-1] in SIGNS and key[:-1].isalpha():
                ids = self.letters(key[:-1])
                if ids is not None:
                    ids = ids + self.sign(key[-1])
            else:
                ids = None
            if ids is None:
                odd.append(key)
            else:
                flat += ids
                sizes.append(len(ids))
                keys.append(key)
        self.add(keys, flat, sizes)
        return odd

    def add(self, keys: list[str], flat: list[int] | np.ndarray, lengths: list[int] | np.ndarray) -> None:
        sizes = np.asarray(lengths, np.int64)
        n, total = len(self.place), len(flat)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(keys) > len(self.start):
            self.start, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hits))
        self.ids[self.used : self.used + total] = flat
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(keys)] = sizes
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used += total

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by `end`, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.place) > REMEMBER:
            self.thin_out()
        if END_KEY not in self.place:
            self.add([END_KEY], [end], [1])
        names, codes, counts = self.cut(texts)
        places = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            fresh = [names[j] for j in missing]
            self.learn(fresh)
            places[missing] = [self.place[k] for k in fresh]
        self.hits[places] += 1  # once a batch, however often it has the segment
        index = places[codes]
        sizes = self.length[index]
        first = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.start[index] - first, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, end: int) -> Encoder:
    """One for each worker process, so that what it remembers outlasts a task. `end` is part of what it remembers."""
    return Encoder(path, kind)


@dataclass
class Part:
    first: int
    texts: list[str | None]


def in_batches(column: pa.Array) -> Iterator[Part]:
    """The texts in parts of about BATCH_BYTES; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + BATCH_BYTES)))
        yield Part(first, column.slice(first, last - first).to_pylist())
        first = last
