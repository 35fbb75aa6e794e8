"""Distinct-chunk tables for tokenizers whose pieces cannot cross certain boundaries (operators 4 and 8).

A text is cut at boundaries that no piece crosses; each distinct chunk is segmented once per task and its ids are joined
back by position. The table of a task is emptied when it holds ``LIMIT`` chunks, which bounds memory and changes no id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

LIMIT = 400_000
#: Texts go through the table in slabs of about so many characters.
SLAB_CHARS = 1 << 21


class ChunkTable:
    """Ids (little-endian unsigned 32-bit) of each chunk met."""

    def __init__(self, segment: Callable[[list[str]], list], limit: int = LIMIT):
        self.segment, self.limit, self.ids = segment, limit, {}

    def join(self, cut_texts: list[list[str]]) -> list[bytes]:
        """For each text, given as its list of chunks, the ids of all its chunks in order."""
        if len(self.ids) > self.limit:
            self.ids.clear()
        ids = self.ids
        new = list(set(chain.from_iterable(cut_texts)).difference(ids))
        ids.update(zip(new, (np.array(x, dtype="<u4").tobytes() for x in self.segment(new))))
        return [b"".join(map(ids.__getitem__, x)) for x in cut_texts]


def slabs(texts: list[str], chars: int = SLAB_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters; a longer text is a list of its own."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


# ---- SentencePiece -------------------------------------------------------------------------------------------------

MARK = "▁"


class PieceCodec:
    """SentencePiece encoding by marked words; ``proto`` is the content of the model file.

    The shortcut needs a model that only marks blanks (identity normaliser, dummy prefix) and has no piece with a marker
    after another character; the constructor tests this and otherwise each whole text is segmented by the library.
    """

    def __init__(self, proto: bytes, limit: int = LIMIT):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        probe = " a  b ﬁ \t"
        self.by_chunk = all(MARK not in p.lstrip(MARK) for p in pieces) and sp.decode(sp.encode(probe)) == probe and sp.encode("a", out_type=str)[0].startswith(MARK) and sp.piece_to_id(MARK) != sp.unk_id()
        # a line feed that is no part of any piece is a boundary on both sides
        self.cut_lines = self.by_chunk and not any("\n" in p for p in pieces) and len(sp.encode("\n")) == len(sp.encode("")) + 2
        self.table = ChunkTable(self._segment, limit)
        self.run = re.compile(f"{MARK}+[^{MARK}]*")

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """A chunk starts with a marker, which the library adds itself, or with a line feed, before which it is cut off."""
        found = self.sp.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1)
        alone = [self.sp.piece_to_id(MARK)]  # the library makes nothing of an empty text
        return [alone if c == MARK else x if c[0] == MARK else x[1:] for c, x in zip(chunks, found)]

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or "\0" in marked:
            return self.run.findall(marked)
        marked = marked.replace(MARK, "\0" + MARK)
        if self.cut_lines:
            marked = marked.replace("\n", "\0\n")
        return marked.split("\0")[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text between the begin and the end id."""
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))
        if not self.by_chunk:
            return [np.array(x, dtype="<u4").tobytes() for x in self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
        return [begin + x + end for x in self.table.join([self._cut(t) for t in texts])]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids], num_threads=1)


# ---- byte-level BPE ------------------------------------------------------------------------------------------------

#: The published split pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for
    the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Byte-level BPE ids by chunks; ``config`` is the content of a tokenizers JSON file.

    No pre-token reaches from a visible character into white space after it, so a text may be cut there. Chunks are
    segmented by tiktoken over ranks taken from the same file, where ids follow the merge order; texts with a special
    token's string or with control separators, and files of another kind, go to the tokenizers library whole.
    """

    def __init__(self, config: str, limit: int = LIMIT):
        self.config, self.library = config, None
        spec = json.loads(config)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        same = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        same = same and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if same:
            merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            same = all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 >= len(model["vocab"]) - len(self.special)
        self.by_chunk = bool(same)
        if same:
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.words = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = ChunkTable(lambda chunks: list(map(self.words.encode_ordinary, chunks)), limit)
        self.whole = re.compile("|".join(["[\0\x1c-\x1f]", *map(re.escape, filter(None, self.special))]))
        self.runs = re.compile(r"\s[ \n]")
        self.unit = re.compile(r"\s*\S+|\s+")

    def _library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.config)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self._library(t) for t in texts]
        cut = []
        for t in texts:
            if self.whole.search(t):
                cut.append([])
            elif self.runs.search(t):
                cut.append(self.unit.findall(t))
            else:
                cut.append(t.replace("\n", "\0\n").replace(" ", "\0 ").split("\0"))
        return [self._library(t) if t and not c else x for t, c, x in zip(texts, cut, self.table.join(cut))]
