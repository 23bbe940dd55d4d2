"""Token ids of whole texts, for tasks: the tokenizers library does the work, once for each distinct word of some texts, many words a call."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task

#: White space of the byte-level vocabulary's splitting rule, as fixed by Unicode.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")
# The vocabularies' rules for splitting, spelled out for Latin-1: letters, numbers and blanks there. A part has blanks at its start or has
# nothing else, so that no rule has to look ahead; where blanks are dropped, they are words without ids.
_L, _N, _B = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_RULES = {
    True: f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_B}{_L}{_N}]+|[{_B}]+",
    False: f"{_SHORT}|[{_L}]+|[{_N}]|[^{_B}{_L}{_N}]+|[{_B}]+",
}
#: Parts that only the whole library splits: beyond Latin-1, or capitals where case is dropped.
_OTHERS = {True: r"[^\x00-\x{ff}]", False: r"[^\x00-\x{ff}]|[A-ZÀ-ÖØ-Þ]"}
_LATIN1_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
_CACHE_WORDS = 300_000
#: Characters of the texts whose parts are looked up together, and words of a call of the library.
_GROUP, _CALL = 1 << 22, 1000


#: Blanks that are neither a space nor a line end.
_OTHER_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _byte_names() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable ones their own, others from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


#: Names of bytes; 255, which no text has in UTF-8, stands between words, as a space does between their names.
_NAMES = np.array([*map(ord, _byte_names()[:255]), ord(" ")], "<u4")


class _Table(dict):
    """A full table is set aside, and what is asked for again comes back from there."""

    def __init__(self):
        super().__init__()
        self.last = {}

    def lacking(self, keys: Iterable[str]) -> list[str]:
        """Those of different ``keys`` that have no value yet."""
        out = []
        for key in keys:
            if key not in self:
                value = self.last.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out

    def turn(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.last = dict(self)
            self.clear()


def vocabulary(name: str) -> str:
    """The file of a public tokenizer; ``name`` may also be a path."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(some: pa.Array) -> list[str]:
    return some.to_numpy(zero_copy_only=False).tolist()


def _latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts as the library gives them for each text alone, without special tokens.

    Both vocabularies split a text before they merge anything, and never across the boundaries used here, so the ids of a text
    are those of its parts, one after the other. Parts of byte-level vocabularies hold the blank before them; where blanks are
    anything but single spaces and line ends, the vocabulary's own rule for blanks is applied. Other vocabularies drop blanks
    and case. A part of Latin-1 characters is split by the same rule as in the library, and its words go straight to the
    library's model; others go through the whole library. Words and other parts are kept in tables of a bounded size.

    Texts are taken in groups. Arrow splits a group's texts into parts, the different parts into words, and puts ids in the places
    of words and parts; just the different words are seen one by one. New words go to the model many a call. A byte-level
    model loses no byte, so the bytes of its tokens say where each word's end.

    Strings of the vocabulary's added tokens, such as <|endoftext|>, are ordinary text, or with ``added_tokens`` those tokens, as
    the library has it by default: a text that holds such a string in any case goes through the unmodified library whole.
    """

    def __init__(self, name: str, added_tokens: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = True  # for parts, which hold none or take them as ordinary text
        self.plain = Tokenizer.from_file(vocabulary(name)) if added_tokens else None
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.keeps_blanks = self.tokenizer.normalizer is None
        #: Stands between parts and between words, and is in none of them.
        self.mark = "\0" if self.keeps_blanks else " "
        self.rule, self.others = _RULES[self.keeps_blanks], _OTHERS[self.keeps_blanks]
        self.by_words = Tokenizer(self.tokenizer.model)  # the model alone, on names of words with spaces between them
        self.by_words.pre_tokenizer = CharDelimiterSplit(" ")
        self.id_sizes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_sizes[i] = len(token.removesuffix(self.tokenizer.model.end_of_word_suffix or ""))
        self.parts, self.words = _Table(), _Table()

    def _even(self, text: str) -> bool:
        """Whether all blanks are single spaces and line ends between words."""
        if not _latin1(text):
            return " ".join(text.split()) == text.replace("\n", " ")
        ends = text[:1] + text[-1:]
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or " " in ends or "\n" in ends or any(b in text for b in _OTHER_BLANKS))

    def _line(self, text: str) -> str | None:
        """A text's parts with marks between them; none for a text that has marks itself."""
        if not self.keeps_blanks:
            return (text.lower() if _latin1(text) else text).replace("\n", " ")
        if "\0" in text:
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n") if self._even(text) else "\0".join(_PIECES.findall(text))

    def _whole(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        named = [_NAMES[np.frombuffer(b"\xff".join(raw[i : i + _CALL]), np.uint8)].tobytes().decode("utf-32-le") for i in range(0, len(raw), _CALL)]
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.by_words.encode_batch_fast(named, add_special_tokens=False)])
        ends, wanted = np.cumsum(self.id_sizes[ids]), np.cumsum([len(r) for r in raw])
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():  # a vocabulary that lacks bytes, or whose ends of words are text too
            names = ("".join(map(chr, _NAMES[list(r)].tolist())) for r in raw)
            return [np.array([t.id for t in self.tokenizer.model.tokenize(n)], self.dtype).tobytes() for n in names]
        data, stops = ids.tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        new = self.words.lacking(words)
        named = [w for w in new if w.strip("" if self.keeps_blanks else _LATIN1_BLANKS)]
        if len(named) < len(new):
            self.words.update(dict.fromkeys(new, b""))
        if named:
            self.words.update(zip(named, self._by_model(named), strict=True))
        return list(map(self.words.__getitem__, words))

    def _of_others(self, parts: list[str]) -> list[bytes]:
        if new := self.parts.lacking(parts):
            self.parts.update(zip(new, self._whole(self.tokenizer, new), strict=True))
        return list(map(self.parts.__getitem__, parts))

    def _pieces(self, strings: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of each string, from those of its pieces between marks; ``ids_of`` gives them for different pieces."""
        split = pc.split_pattern(strings, self.mark)
        coded = split.values.dictionary_encode()
        _, offsets, data = ids_of(coded.dictionary).take(coded.indices).buffers()
        at = np.frombuffer(offsets, np.int32)[split.offsets.to_numpy()]
        return pa.BinaryArray.from_buffers(pa.binary(), len(strings), [None, pa.py_buffer(at), data or pa.py_buffer(b"")])

    def _of_parts(self, parts: pa.Array) -> pa.Array:
        words = lambda some: pa.array(self._of_words(_strings(some)), pa.binary())
        other = pc.match_substring_regex(parts, self.others)
        latin = self._pieces(pc.replace_substring_regex(parts.filter(pc.invert(other)), self.rule, rf"\0{self.mark}"), words)
        if len(latin) == len(parts):
            return latin
        place = np.argsort(np.argsort(other.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([latin, pa.array(self._of_others(_strings(parts.filter(other))), pa.binary())]).take(pa.array(place))

    def _of_lines(self, lines: list[str]) -> Iterator[bytes]:
        if lines:
            _, offsets, data = self._pieces(pa.array(lines, pa.string()), self._of_parts).buffers()
            at, data = np.frombuffer(offsets, np.int32, len(lines) + 1).tolist(), data.to_pybytes()
            for a, b in zip(at, at[1:], strict=False):
                yield data[a:b]

    def _long(self, line: str) -> bytes:
        """As ``_of_lines``, of a line that is too long for one array."""
        parts = line.split(self.mark)
        return b"".join(ids for i in range(0, len(parts), 1 << 18) for ids in self._of_lines([self.mark.join(parts[i : i + (1 << 18)])]))

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        self.parts.turn()
        self.words.turn()
        alone, lines = [], []
        for text in texts:
            low = text.lower() if self.added else ""
            if any(a in low for a in self.added):
                alone += self._whole(self.plain, [text])
            elif (line := self._line(text)) is None:
                alone += self._whole(self.tokenizer, [text])
            elif len(line) > _GROUP:
                alone.append(self._long(line))
            else:
                alone.append(None)
                lines.append(line)
        rest = self._of_lines(lines)
        for ids in alone:
            yield next(rest) if ids is None else ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none), little-endian in ``dtype``."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= _GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


@lru_cache(2)
def encoder_of(name: str, added_tokens: bool = False) -> Encoder:
    """One encoder a worker process: the words of one task serve the next."""
    return Encoder(name, added_tokens)
