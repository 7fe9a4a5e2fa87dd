"""Token ids by the ``tokenizers`` library, with a bounded memory of chunks already encoded.

Both public vocabularies cut a text at white space before they merge bytes or letters, so a text's ids are those
of its chunks in order. A batch of texts is cut into chunks and these are numbered by Arrow; chunks not yet in memory
go to the library, many in one call with a separator between them whose id no chunk has. The vocabulary of bytes also
cuts between a letter and a sign, so there a word and the signs after it are chunks of their own. Texts in which the cut could
depend on more than the chunk (runs of white space, the separator, strings of special tokens) are encoded whole.
Everything equals the library's ``encode(text, add_special_tokens=False)``: a special token's string gives its id.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of each of the two generations of a worker's memory, and of an entry besides its chunk and ids, about.
MEMORY, ENTRY = 200 << 20, 190
#: Chunks in one call of the library, and of these in one string of bytes, where short strings cost less.
CALL, JOINED = 5_000, 100

# White space beyond ASCII, and two ways for a text to be cut by more than its chunks.
_WIDE = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE_WHOLE = f"[ \\n]{{2}}|[\\x00\\t\\r\\x0b\\x0c\\x1c-\\x1f{_WIDE}]|<\\|"
_WORD_WHOLE = "[\\x01\\x1c-\\x1f]|<\\|"
# Bytes of ASCII letters and digits, and of its signs but the quote, which may open a contraction.
_ALNUM = np.array([chr(x).isalnum() and x < 128 for x in range(256)])
_SIGN = np.array([32 < x < 127 and chr(x) != "'" for x in range(256)]) & ~_ALNUM
# First bytes of U+00C0 to U+024F and U+0400 to U+047F, all letters but U+00D7 and U+00F7.
_LEAD = np.array([0xC3 <= x <= 0xC9 or x in (0xD0, 0xD1) for x in range(256)])


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts for the vocabulary of bytes, and how many there are up to the end of each text.

    A space belongs to the chunk after it; a line end closes a chunk; a sign after a letter or digit opens one.
    """
    if not pc.any(pc.not_equal(texts, "")).as_py():
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    text, offset = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    opens = np.empty(len(text) + 1, bool)
    np.equal(text, 32, out=opens[:-1])
    opens[1:] |= text == 10
    # A position before the text wraps to its end, which cuts at most at the text's start.
    sign = np.flatnonzero(_SIGN[text])
    before, lead = text[sign - 1], text[sign - 2]
    wide = (before & 0xC0 == 0x80) & _LEAD[lead] & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    opens[sign[_ALNUM[before] | wide]] = True
    opens[offset] = True
    bounds = np.flatnonzero(opens)
    chunks = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds + offsets[0]), data])
    return chunks, np.searchsorted(bounds, offset[1:])


class Encoder:
    """ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.words = self.tokenizer.model.end_of_word_suffix is not None
        self.between, self.joined = (" \x01 ", CALL) if self.words else ("\x00", JOINED)
        found = self._library([self.between])[0]
        sign = self.tokenizer.id_to_token(int(found[0]))[0]
        holders = [t for t in self.tokenizer.get_vocab() if sign in t]
        added = self.tokenizer.get_added_tokens_decoder().values()
        if len(found) != 1 or len(holders) > 1 + self.words or not all(t.content.startswith("<|") for t in added):
            raise ValueError("not a vocabulary whose texts are cut at white space")
        self.mark = int(found[0])
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.memory, self.held = memory, 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks by the library."""
        # A quote at the start may open a contraction, which a separator before it would hide.
        single = [c for c in chunks if c[0] == "'"]
        learnt = {chunk: ids.tobytes() for chunk, ids in zip(single, self._library(single))}
        many = [c for c in chunks if c[0] != "'"] if single else chunks
        for k in range(0, len(many), CALL):
            own = many[k : k + CALL]
            texts = [self.between.join(own[j : j + self.joined]) for j in range(0, len(own), self.joined)]
            found, mark = self._library(texts), np.array([self.mark], np.uint32)
            ids = np.concatenate([x for text in found for x in (text, mark)][:-1])
            ends = np.flatnonzero(ids == self.mark)
            data, cuts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
            stops = [*(4 * ends).tolist(), len(data)]
            if len(stops) != len(own):
                raise ValueError("a chunk holds the separator")
            learnt.update(zip(own, [data[a:b] for a, b in zip(cuts, stops)]))
        return learnt

    def _keep(self, known: dict[str, bytes]) -> None:
        chunks, found = list(known), list(known.values())
        for k in range(0, len(chunks), CALL):
            own, ids = chunks[k : k + CALL], found[k : k + CALL]
            size = ENTRY * len(own) + sum(map(len, own)) + sum(map(len, ids))
            if self.held + size > self.memory:
                self.old, self.young, self.held = self.young, {"": b""}, 0
            if size <= self.memory:
                self.young.update(zip(own, ids))
                self.held += size

    def _numbered(self, chunks: list[str]) -> list[bytes]:
        old, found = self.old, list(map(self.young.get, chunks))
        missing = [k for k, x in enumerate(found) if x is None]
        kept, unseen = {}, []
        for k in missing:
            known = old.get(chunks[k])
            if known is None:
                unseen.append(chunks[k])
            else:
                found[k] = kept[chunks[k]] = known
        if unseen:
            learnt = self._learn(unseen)
            for k in missing:
                if found[k] is None:
                    found[k] = learnt[chunks[k]]
            kept |= learnt
        self._keep(kept)
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after the other, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WORD_WHOLE if self.words else _BYTE_WHOLE)
        plain = pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts
        if self.words:
            cut = pc.ascii_split_whitespace(plain)
            chunks, stops = cut.flatten(), np.cumsum(np.asarray(pc.list_value_length(cut)), dtype=np.int64)
        else:
            chunks, stops = _cut(plain)
        chunks = chunks.dictionary_encode()
        known = self._numbered(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        found = pa.array(known, pa.large_binary()).take(chunks.indices)
        _, ends, data = found.buffers()
        ends, ids = np.frombuffer(ends, np.int64, len(found) + 1) // 4, np.frombuffer(data or b"", np.uint32)
        last, ids = ends[np.concatenate([[0], stops])][1:], ids[: ends[-1]]
        lengths = np.diff(last, prepend=0)
        at = np.flatnonzero(np.asarray(whole))
        if len(at):
            own = self._library([texts[int(k)].as_py() for k in at])
            sizes = np.array([len(x) for x in own], np.int64)
            ids = np.insert(ids, np.repeat((last - lengths)[at], sizes), np.concatenate(own))
            lengths[at] = sizes
        return ids, lengths

    def each(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of every text with ``end`` after them, little-endian."""
        ids, lengths = self.batch(texts)
        data, stops, last = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist(), np.array([end], "<u4").tobytes()
        return [data[a:b] + last for a, b in zip([0, *stops], stops)]

    def encode(self, text: str) -> bytes:
        return self.each(pa.array([text], pa.string()), 0)[0][:-4]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One encoder per worker process, vocabulary and bound of its memory."""
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = Encoder(path, memory)
    return _ENCODERS[path, memory]
