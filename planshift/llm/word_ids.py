"""Token ids of whole texts from a tokenizers file, encoding every distinct word once per worker.

The pre-tokenizers of both vocabularies never join characters across a single space before a word, so the ids of a
text are the ids of its pieces, one after another. The pieces of an Arrow batch are dictionary-encoded, unknown
ones go to the tokenizer in one call, and the ids of all texts are gathered by numpy. Texts whose white space is not of
that simple kind, and texts that hold the string of an added token, are encoded whole.

Pieces are looked up without the ASCII punctuation at their ends, which both vocabularies cut off and which is a piece of
its own; those of the word vocabulary, which is without case, in ASCII lower case. A new piece of Latin letters, ASCII digits
or ASCII punctuation alone needs no pre-tokenizer and goes to the tokenizer's model at once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import path as vocabulary_path
from tokenizers import Tokenizer
from tokenizers.models import BPE

from planshift.llm.shared import listed

# Pieces kept per worker, about 200 bytes each; beyond it the store starts anew.
MOST_PIECES = 400_000
WIDE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CONTROL = r"\x00-\x09\x0b-\x1f"
# ASCII punctuation at the ends of a piece is a token run of its own; an apostrophe may be part of one with letters.
EDGE = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
SPACE_BYTE = "\u0120"  # the byte of a space in a byte-level vocabulary
LATIN_END = "\u0250"  # letters before it are in one composed form, and every version of Unicode knows them
# Byte-level vocabularies write bytes as characters: those that show in Latin-1 as they are, all others from U+0100 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _SHOWN], range(0x100, 0x200)))
# A space or line feed must stand alone between words; one empty line is simple too.
BYTE_ODD = rf"[{CONTROL}{WIDE_SPACE}]|  | \n|\n |\n\n\n|^[ \n]|[ \n]$"
WORD_ODD = r"[\x00-\x08\x0e-\x1f]"


def _without_cache(file: str) -> Tokenizer:
    """The tokenizer of a file; its own cache of pieces is off, as it costs more than it saves on pieces that are all new."""
    tokenizer = Tokenizer.from_file(file)
    with open(file, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    known = {k: model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    tokenizer.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **{k: v for k, v in known.items() if v})
    return tokenizer


class PieceIds:
    """Ids of pieces, in the order in which they were met: ``start`` and ``length`` index one flat array."""

    def __init__(self, file: str, kind: str):
        self.tokenizer = _without_cache(file)
        self.model = self.tokenizer.model
        self.kind = kind
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = "|".join(x for x in (BYTE_ODD if kind == "byte" else WORD_ODD, added) if x)
        self.marker = np.asarray(self._encode("\n" if kind == "byte" else "\x01"), dtype=np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.empty(1 << 20, dtype=np.uint32)
        self.used = 0
        self.start = np.empty(1 << 18, dtype=np.int64)
        self.length = np.empty(1 << 18, dtype=np.int64)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(self.place), self.used + len(ids)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(names) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        self.flat[self.used:total] = ids
        ends = np.cumsum(lengths)
        self.start[n:n + len(names)] = self.used + ends - lengths
        self.length[n:n + len(names)] = lengths
        self.used = total
        self.place.update(zip(names, range(n, n + len(names)), strict=True))

    def _spoken(self, piece: str) -> str:
        """What a piece stands for in its text."""
        return piece[1:] if piece[0] == "\x01" else " " + piece

    def _runs(self, piece: str) -> tuple[str, ...]:
        """What the pre-tokenizer makes of a piece of Latin letters, ASCII digits or punctuation alone; nothing for any other."""
        lead, body = "", piece
        if self.kind == "byte":
            lead, body = ("", piece[1:]) if piece[:1] == "\x01" else (SPACE_BYTE, piece)
        if not body:
            return ()
        if not body.isascii():
            if not body.isalpha() or max(body) >= LATIN_END:
                return ()
            if self.kind == "word":
                body = body.lower()
                if not body.isalpha():  # a letter that lowers to itself and a mark
                    return ()
            return (lead + body.encode().decode("latin-1").translate(BYTE_LETTERS),)
        if body.isalpha() or not body.strip(EDGE):
            return (lead + body,)
        if body.isdigit():
            return (lead + body,) if self.kind == "byte" else tuple(body)
        return ()

    def _learn(self, names: list[str]) -> None:
        """Encodes new pieces; those of several runs in one call, apart by a marker that no piece holds."""
        plain, lone, rest, flat, lengths = [], [], [], [], []
        tokenize = self.model.tokenize
        for name in names:
            if runs := self._runs(name):
                ids = [t.id for run in runs for t in tokenize(run)]
                plain.append(name)
                lengths.append(len(ids))
                flat += ids
            elif self.kind == "byte" and name in ("", "\x01", "\n"):
                lone.append(name)
            else:
                rest.append(name)
        for name in lone:
            ids = self._encode(name.removeprefix("\x01"))
            lengths.append(len(ids))
            flat += ids
        if lengths:
            self._add(plain + lone, np.asarray(flat, dtype=np.uint32), np.asarray(lengths))
        for at in range(0, len(rest), 20_000):
            part = rest[at:at + 20_000]
            if self.kind == "byte":
                ids = np.asarray(self._encode("\n".join(map(self._spoken, part))), dtype=np.uint32)
            else:
                ids = np.asarray(self._encode(" \x01 ".join(part)), dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.marker[0])
            lengths = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            self._add(part, np.delete(ids, cuts), lengths)

    def _cut(self, piece: str) -> tuple[str, ...]:
        """A piece apart from the punctuation at its ends, where that borders on letters or digits."""
        if self.kind == "byte":
            return self._cut_bytes(piece)
        core = piece.strip(EDGE)
        if not core or len(core) == len(piece):
            return (piece,)
        at = len(piece) - len(piece.lstrip(EDGE))
        head, tail = piece[:at], piece[at + len(core):]
        if head and not core[0].isalnum() or tail and not core[-1].lower()[-1].isalnum():  # a letter may lower to a mark
            return (piece,)
        return tuple(x for x in (head, core, tail) if x)

    def _cut_bytes(self, piece: str) -> tuple[str, ...]:
        """The same in the byte vocabulary, where only the first part keeps the space before it.

        A piece without that space keeps the punctuation before it, as an apostrophe there may be part of a token.
        """
        if piece[:1] in ("\n", "\x01"):
            front, body = ("\n",) if piece[0] == "\n" else (), piece[1:]
            if not body:
                return (piece,)
            core = body.rstrip(EDGE)
            if not core or len(core) == len(body) or core[-1] >= LATIN_END or not core[-1].isalnum():
                return (*front, "\x01" + body)
            return (*front, "\x01" + core, "\x01" + body[len(core):])
        core = piece.strip(EDGE)
        if not core or len(core) == len(piece):
            return (piece,)
        at = len(piece) - len(piece.lstrip(EDGE))
        tail = piece[at + len(core):]
        if core[0] >= LATIN_END or not core[0].isalnum() or core[-1] >= LATIN_END or not core[-1].isalnum():
            return (piece,)
        parts = (piece[:at], "\x01" + core) if at else (core,)
        return (*parts, "\x01" + tail) if tail else parts

    def ids_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, one piece after another, with the start and length of each."""
        if len(self.place) + len(distinct) > MOST_PIECES:
            self._clear()
        known = self.place
        at = np.fromiter((known.get(p, -1) for p in distinct), dtype=np.int64, count=len(distinct))
        counts = np.ones(len(distinct), dtype=np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            names = [distinct[i] for i in missing.tolist()]
            cuts = [(p,) if p.isalnum() else self._cut(p) for p in names]
            counts[missing] = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
            names = [part for cut in cuts for part in cut]
            new = [p for p in dict.fromkeys(names) if p not in known]
            if new:
                self._learn(new)
            at = np.repeat(at, counts)
            at[at < 0] = np.fromiter((known[p] for p in names), dtype=np.int64, count=len(names))
        lengths = self.length[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.start[at] - upto[:-1], lengths) + np.arange(upto[-1])]
        bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
        return ids, bounds[:-1], np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) in one array, and the bounds of each text in it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        if self.kind == "byte":
            marked = pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), plain, pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        else:
            lists = pc.split_pattern(pc.ascii_lower(pc.replace_substring(plain, "\n", " ")), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values[offsets[0]:offsets[-1]].dictionary_encode()
        offsets = offsets - offsets[0]
        distinct = listed(coded.dictionary, " ")
        if self.kind == "byte" or "" not in distinct:
            flat, start, length = self.ids_of(distinct)
        else:
            blank = distinct.index("")
            flat, start, length = self.ids_of(distinct[:blank] + distinct[blank + 1:])
            start, length = np.insert(start, blank, 0), np.insert(length, blank, 0)
        code = coded.indices.to_numpy(zero_copy_only=False)
        lengths = length[code]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(start[code] - bounds[:-1], lengths) + np.arange(bounds[-1])]
        bounds = bounds[offsets]
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = {i: np.asarray(self._encode(texts[int(i)].as_py()), dtype=np.uint32) for i in rows}
            parts = [whole.get(i, ids[bounds[i]:bounds[i + 1]]) for i in range(len(odd))]
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_KNOWN: dict[tuple[str, str], PieceIds] = {}


def piece_ids(file: str, kind: str) -> PieceIds:
    """The encoder of this worker for a vocabulary file; ``kind`` is ``byte`` (byte-level) or ``word`` (word ends)."""
    if (file, kind) not in _KNOWN:
        _KNOWN[file, kind] = PieceIds(file, kind)
    return _KNOWN[file, kind]


def vocabulary(name: str) -> str:
    return vocabulary_path(name)
