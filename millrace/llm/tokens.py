"""Encoding with a public tokenizer file, with the ids of chunks remembered.

A column of texts is cut into chunks and dictionary-encoded by Arrow, so that Python sees each distinct chunk of some
4 MB of text once, and the ids of all chunks are put together with numpy. The chunks that a worker remembers
are one Arrow column and two arrays of numbers, some 40 bytes a chunk. When they exceed the limit, those that
were not met since the last time go; frequent chunks stay.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from millrace.llm.shared import memory, text_runs

#: Chunks whose ids one worker remembers, and characters that are encoded at once
REMEMBERED, RUN = 1_000_000, 1 << 22
_ENCODERS: dict[str, "Encoder"] = {}
#: White space, as Unicode has it, next to a blank or a line's end, in a text and in its chunks
_SPACE_RUN = re.compile(r"[ \n]\s|\s[ \n]")
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_INNER, _LAST = rf"^[ \n]{_SPACE}", rf"{_SPACE}$"
#: Chunks that are encoded in one go
GROUP = 2000
#: Up to this letter texts are in normal form, and lower-casing gives one letter for one.
_LATIN = "\u012f"
#: Byte-level tokenizers write a byte as itself where it is printable, the others as letters from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _SHOWN else chr(256 + k) for k, b in [(sum(x not in _SHOWN for x in range(b)), b) for b in range(256)]}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's own for whole texts.

    Every tokenizer here splits a text between white space and what is before it, before it looks for
    ids; so chunks that are cut there give the ids of the whole. White space next to other white space
    may go together: such texts are encoded whole, unless the tokenizer drops white space. New chunks are encoded
    many at a time, with one of the tokenizer's own special tokens between them, at which it splits first of all.
    The bulk of them, plain Latin words with at most a comma or full stop after, go to the tokenizer's
    model itself, as splitting takes longer than the model: if words tried at the start come out alike both ways.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        ids = self.tokenizer.encode("a  a", add_special_tokens=False).ids
        self.drops_space = ids == 2 * self.tokenizer.encode("a", add_special_tokens=False).ids
        self.path = path
        plain = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.between = plain[0] if plain else None
        self.lowers = self._whole(["Word"]) == self._whole(["word"])
        self.marks = dict(zip(".,\n", self._whole([".", ",", "\n"])))
        tried = ["word", "The", "Éaß", "thndhain", "reê,", "is.", *([] if self.drops_space else [" word", " Éa.", "\nOf", "\nThe,"])]
        self.plain = [self._word(c) for c in tried] == self._whole(tried)

    @property
    def width(self) -> int:
        """Bytes that every id fits in: 2 or 4."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, chunk: str) -> bytes | None:
        """The ids of a plain word from the model, else None."""
        core, head, tail, space = chunk, b"", b"", ""
        if not self.drops_space:
            first = core[:1]
            if first == " ":
                core, space = core[1:], _BYTES[32]
            elif first == "\n":
                core, head = core[1:], self.marks["\n"]
        if core[-1:] in (".", ","):
            core, tail = core[:-1], self.marks[core[-1]]
        if not core.isalpha():
            return None
        if self.lowers:
            low = core.lower()
        else:
            low = core
        if not core.isascii():
            if max(core) > _LATIN:
                return None
            low = low.encode().decode("latin-1").translate(_BYTES)
        own = array("I", [t.id for t in self.model.tokenize(space + low)]).tobytes()
        return head + own + tail if head or tail else own

    def _new(self, chunks: list[str]) -> list[bytes]:
        if not self.plain:
            return self._joined(chunks)
        out = [self._word(c) for c in chunks]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._joined([chunks[k] for k in rest])):
            out[k] = x
        return out

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks in one go."""
        if not chunks:
            return []
        if self.between is None or any("<|" in c or self.between[0] in c for c in chunks):
            return self._whole(chunks)
        content, number = self.between
        ids = np.array(self.tokenizer.encode(content.join(chunks), add_special_tokens=False).ids, "<u4")
        cut = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
        if len(cut) != len(chunks) + 1:
            return self._whole(chunks)
        raw = ids.tobytes()
        return [raw[4 * x + 4 : 4 * y] for x, y in zip(cut[:-1], cut[1:])]

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n"), "\0")

    def _remember(self, words: pa.Array, limit: int) -> tuple[dict, np.ndarray]:
        """This worker's memory with all of the distinct words, and their places in it."""
        held = memory(self.path)
        if not held:
            held.update(words=words[:0], ids=np.zeros(0, np.uint32), size=np.zeros(0, np.int64), met=np.zeros(0, bool))
        if len(held["words"]) > limit:
            stay = held["met"]
            held["ids"] = held["ids"][np.repeat(stay, held["size"])]
            held["words"], held["size"] = held["words"].filter(pa.array(stay)), held["size"][stay]
            held["met"] = np.zeros(len(held["size"]), bool)
        found = pc.index_in(words, value_set=held["words"])
        new, known = words.filter(found.is_null()), len(held["words"])
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = np.arange(known, known + len(new))
        if len(new):
            got = []
            for at in range(0, len(new), GROUP):
                got += self._new(new[at : at + GROUP].to_pylist())
            held["words"] = pa.concat_arrays([held["words"], new])
            held["ids"] = np.concatenate([held["ids"], np.frombuffer(b"".join(got), "<u4")])
            held["size"] = np.concatenate([held["size"], np.array([len(x) // 4 for x in got], np.int64)])
            held["met"] = np.concatenate([held["met"], np.zeros(len(new), bool)])
        held["met"][place] = True
        return held, place

    def _cut(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts cut into chunks, one after another, how many each has, and the texts that can't be cut (none here)."""
        chunks = self._chunks(texts)
        coded = chunks.flatten().dictionary_encode()
        words, offsets = coded.dictionary, chunks.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        index = coded.indices.to_numpy(zero_copy_only=False)
        held, place = self._remember(words, limit)
        size = held["size"][place][index]
        odd = np.zeros(len(texts), bool)
        if not self.drops_space:
            last = pc.match_substring_regex(words, _LAST).to_numpy(zero_copy_only=False)[index]
            last[offsets[1:] - 1] = False  # nothing follows
            at = np.flatnonzero(last | pc.match_substring_regex(words, _INNER).to_numpy(zero_copy_only=False)[index])
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
            for k in np.flatnonzero(odd).tolist():
                size[offsets[k] : offsets[k + 1]] = 0
        ends = np.cumsum(size)
        first = (np.cumsum(held["size"]) - held["size"])[place][index]
        total = int(ends[-1]) if len(ends) else 0
        ids = held["ids"][np.repeat(first - (ends - size), size) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[offsets]), odd

    def _long(self, text: str, limit: int) -> np.ndarray:
        """Ids of one long text, some RUN characters at a time if it may be cut."""
        if not self.drops_space and ("\0" in text or _SPACE_RUN.search(text)):
            return np.frombuffer(self._whole([text])[0], "<u4")
        out, at = [], 0
        while at < len(text):
            stop = min((x for x in (text.find(" ", at + RUN), text.find("\n", at + RUN)) if x >= 0), default=len(text))
            out.append(self._cut(pa.array([text[at:stop]], pa.large_string()), limit)[0])
            at = stop
        return np.concatenate(out)

    def ids(self, texts: pa.Array, remembered: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of a column of texts (null: empty), one text after another, and where each text's end."""
        limit = remembered or REMEMBERED
        texts = texts.fill_null("").cast(pa.large_string())
        alone = pc.greater(pc.binary_length(texts), 2 * RUN)
        if not self.drops_space:
            alone = pc.or_(alone, pc.match_substring(texts, "\0"))
        flat, size, odd = self._cut(pc.if_else(alone, "", texts) if pc.any(alone).as_py() else texts, limit)
        own = np.flatnonzero(odd | alone.to_numpy(zero_copy_only=False)).tolist()
        if not own:
            return flat, np.cumsum(size)
        before, parts, done = np.cumsum(size), [], 0
        for k in own:
            parts += [flat[done : before[k]], self._long(texts[k].as_py(), limit)]
            done, size[k] = before[k], len(parts[-1])
        return np.concatenate([*parts, flat[done:]]), np.cumsum(size)

    def runs(self, texts: pa.Array, end_id: int, remembered: int | None = None):
        """(first row, ids, ends) of some RUN bytes of a column at a time, each text's ids followed by the end id."""
        for at, own in text_runs(texts, RUN):
            ids, ends = self.ids(own, remembered)
            yield at, np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: list[str], remembered: int | None = None) -> list[bytes]:
        ids, ends = self.ids(pa.array(texts, pa.string()), remembered)
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] if texts else []


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
