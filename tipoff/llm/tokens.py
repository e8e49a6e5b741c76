"""Token ids of whole texts by the tokenizers library, one lookup for each word that was met before.

Both vocabularies used here cut a text before every run of white space that follows other characters, and encode the parts
on their own. So a text's ids are the ids of its words one after another, and the library only has to see each
word once. Texts with U+001C to U+001F, which Python takes for white space and the vocabularies do not, go to the library whole, and so do texts that may
hold the string of a special token, which the library gives one id. Both also cut between a letter and the stops behind it, so "word," has the ids of "word" and of ",".
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores

_ODD = re.compile("[\x1c-\x1f]")
_WORD_END = "</w>"  # how the vocabulary of words marks an id that ends a word
_STOPS = ".,;:!?"
_WITH_SPACE = re.compile(r"\s*\S+|\s+")
#: Letters and signs that normalizing keeps apart and lower case changes one by one.
_LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u012f]+")
#: Bytes of text that are split at a time.
_CHUNK = 6 << 20


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. Keeps the ids of words in about ``limit`` bytes, from one task to the next.

    When they are full, the half that was met first stays: frequent words are met early.
    """

    ENTRY = 200  # bytes of an entry besides its word

    def __init__(self, path: str, spaces: bool, limit: int = 192 << 20):
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {token.content[:2].lower() for token in self.tokenizer.get_added_tokens_decoder().values() if token.content}
        self.cased = any(mark.upper() != mark for mark in self.marks)  # none of the vocabularies used here: their strings begin with two signs
        self.spaces, self.limit = spaces, limit
        self.words = _WITH_SPACE.findall if spaces else str.split
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text that each id stands for
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token.removesuffix(_WORD_END))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _in_a_row(self, word: str) -> bool:
        """Whether the word keeps its ids and its bytes when it is encoded behind others."""
        return word[0].isspace() and not word.isspace() if self.spaces else _LATIN.fullmatch(word) is not None

    def _learn(self, words: list[str]) -> None:
        """New words are encoded in one text; the bytes that ids stand for tell where each word ends."""
        row: list[str] = []
        rest: list[str] = []
        for word in words:
            (row if self._in_a_row(word) else rest).append(word)
        if row:
            text = ("" if self.spaces else " ").join(row)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(w.encode()) for w in row])
            last = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if (ends[last] == wanted).all() and last[-1] == len(ends) - 1:
                raw, start = ids.tobytes(), 0
                for word, end in zip(row, (4 * (last + 1)).tolist()):
                    self.known[word] = raw[start:end]
                    start = end
            else:
                rest += row
        for word, coded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[word] = np.array(coded.ids, "<u4").tobytes()

    def _of_forms(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words by the vocabulary of words, which lowers case and cuts between a letter and the signs at a word's end: words
        in lower case, and the signs, are looked up."""
        low = pc.if_else(pc.match_substring_regex(words, f"^{_LATIN.pattern}$"), pc.utf8_lower(words), words)
        stems = pc.ascii_rtrim(low, string.punctuation)
        shorter = np.flatnonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(low)).to_numpy(zero_copy_only=False))
        whole, cut = _strings(low.take(pa.array(shorter))), _strings(stems.take(pa.array(shorter)))
        signed = {k: w[len(s):] for k, w, s in zip(shorter.tolist(), whole, cut) if s and s[-1].lower()[-1].isalpha()}
        # but not behind a letter whose lower case ends with a mark, which would join the signs
        stays = np.zeros(len(words), bool)
        stays[shorter] = True
        stays[list(signed)] = False
        coded = pc.if_else(pa.array(stays), low, stems).dictionary_encode()
        forms = [*_strings(coded.dictionary), *sorted(set(signed.values()))]
        ids = list(map(self.known.get, forms))
        new = {form for form, i in zip(forms, ids) if i is None and form}
        if new:
            self._make_room(new)
            self._learn(list(new))
            self.held += sum(map(len, new)) * 3 + self.ENTRY * len(new)
            ids = [self.known.get(form, b"") if i is None else i for form, i in zip(forms, ids)]  # only an empty form has none
        of = list(map(ids.__getitem__, coded.indices.to_numpy().tolist()))
        signs = dict(zip(forms[len(coded.dictionary):], ids[len(coded.dictionary):]))
        for k, sign in signed.items():
            of[k] += signs[sign]
        return of

    def encode_column(self, texts: pa.Array, end: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of a column of texts (null: empty) by the vocabulary of words, each text's followed by ``end``: for every chunk of them, each
        text's number of ids, and all ids."""
        texts = pc.fill_null(texts, "")
        chunk = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield self._encode_chunk(texts.slice(start, stop - start), end)

    def _encode_chunk(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        apart = pc.match_substring_regex(texts, "|".join([_ODD.pattern, *map(re.escape, self.marks)]), ignore_case=self.cased)
        words = pc.utf8_split_whitespace(pc.if_else(apart, "", texts))  # at what Python takes for white space
        coded = words.flatten().dictionary_encode()
        ids = self._of_forms(coded.dictionary)
        # a text's last entry is the end, after the ids of the whole text if that went to the library
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        last = np.full(len(texts), len(ids))
        ids.append(end)
        for k in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            last[k] = len(ids)
            ids.append(self.whole(texts[k].as_py()) + end)
        after = np.cumsum(counts)
        row = pa.array(ids, pa.large_binary()).take(pa.array(np.insert(coded.indices.to_numpy(), after, last)))
        ends = np.frombuffer(row.buffers()[1], np.int64)[1:len(row) + 1][after + np.arange(len(texts))] // 4
        return np.diff(ends, prepend=0), np.frombuffer(row.buffers()[2], "<u4", ends[-1])

    def _make_room(self, words: set[str]) -> None:
        """Drops the later half of what is known, if the words have no room."""
        size = sum(map(len, words)) * 3 + self.ENTRY * len(words)
        if self.held + size > self.limit:
            self.known = dict(islice(self.known.items(), len(self.known) // 2 if size < self.limit else 0))
            self.held = sum(map(len, self.known)) * 3 + self.ENTRY * len(self.known)

    def _apart(self, text: str) -> bool:
        low = text.lower() if self.cased else text
        return any(mark in low for mark in self.marks) or _ODD.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split: list[list[str]] = [[] if self._apart(t) else self.words(t) for t in texts]
        out: list[bytes] = []
        for k in range(0, len(texts), 16):
            part = split[k:k + 16]
            found = [list(map(self.known.get, words)) for words in part]
            new = set().union(*(compress(words, map(not_, ids)) for words, ids in zip(part, found)))
            if new:
                stopped = [(w, stem, w[len(stem):]) for w in new if w[-1] in _STOPS and (stem := w.rstrip(_STOPS)) and stem[-1].isalpha()]
                new.update(part for _, *parts in stopped for part in parts)
                self._make_room(new)
                whole = new.difference(self.known).difference(w for w, _, _ in stopped)
                self._learn(list(whole))
                for word, stem, stops in stopped:
                    self.known[word] = self.known[stem] + self.known[stops]
                self.held += sum(map(len, new)) * 3 + self.ENTRY * len(new)
                # ids found above stay good, though their words may have made room
                found = [[self.known[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids for words, ids in zip(part, found)]
            out += [b"".join(ids) if ids else self.whole(t) for t, ids in zip(texts[k:k + 16], found)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path, spaces)
