"""Token ids and character offsets of whole texts, with a bounded memory of what each worker has encoded before."""

from __future__ import annotations

import os
import re

import numpy as np

# Letters whose lower case and NFC form do not depend on their neighbours, and ASCII marks without the apostrophe.
SIMPLE_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE_PARTS = re.compile(rf"[{SIMPLE_LETTERS}]+|[!-&(-/:-@\[-`{{-~]+").findall


def _load(path: str, plain_specials: bool = True):
    """The tokenizer; ``plain_specials`` has the strings of its special tokens read as ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


class Remembered:
    """A two-generation memory: when the young half is full it becomes the old half.

    The bound is in bytes; ``ENTRY`` is about what a key, a value and their place in a table take besides their content.
    Keys of more than ``LONGEST`` characters are not kept, as they hardly come again.
    """

    ENTRY, LONGEST = 200, 256

    def __init__(self, most_bytes: int) -> None:
        self.half, self.bytes, self.young, self.old = most_bytes // 2, 0, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        return self.old.get(key) if found is None else found

    def put(self, key: str, value) -> None:
        if len(key) > self.LONGEST:
            return
        if self.bytes >= self.half:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.bytes += self.ENTRY + 4 * len(key) + len(value)
        self.young[key] = value


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of a word-wise BPE (lower case, white space dropped), blank-separated piece by piece.

    No match of its pattern holds white space and neither its normal form nor its lower case reaches over a blank, so the
    ids of a text are those of its pieces. Pieces of plain letters and marks skip the normaliser, unless they hold the
    string of an added token that counts (see ``plain_specials``). Added tokens with white space are not supported.
    """

    plain_specials = True

    def __init__(self, path: str, most_bytes: int = 256 << 20) -> None:
        self.tokenizer = _load(path, self.plain_specials)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and self.plain_specials)]
        if any(re.search(r"\s", content) for content in added):
            raise ValueError("an added token holds white space")
        # a token that is matched after normalising is in lower case there
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)", re.IGNORECASE).search
        self.model = self.tokenizer.model
        self.pieces, self.parts = Remembered(most_bytes // 2), Remembered(most_bytes // 2)
        self.letters = {ord(chr(b)): c for b, c in byte_letters().items()}

    def _part(self, part: str) -> bytes:
        key = part.lower()
        known = self.parts.get(key)
        if known is None:
            stand_in = key if key.isascii() else key.encode().decode("latin-1").translate(self.letters)
            known = np.array([t.id for t in self.model.tokenize(stand_in)], dtype="<u4").tobytes()
            self.parts.put(key, known)
        return known

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.old.get(piece)
        if known is None:
            parts = SIMPLE_PARTS(piece)
            if sum(map(len, parts)) == len(piece) and not self.added(piece):
                known = b"".join(map(self._part, parts))
            else:
                known = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.pieces.put(piece, known)
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found, look = [], self.pieces.young.get
        for piece in text.replace("\n", " ").split(" "):
            ids = look(piece)
            if ids is None:
                ids = self._piece(piece)
                look = self.pieces.young.get
            found.append(ids)
        return b"".join(found)


class WordTokenizerWithSpecials(WordTokenizer):
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``: special tokens in the text are found."""

    plain_specials = False


class OffsetTokenizer:
    """Character spans of the tokens of a byte-level BPE, cut before each blank that follows something else than white space.

    Spans are the token's first to last character, without a leading blank taken off; a character that
    several tokens share belongs to each of them.
    """

    def __init__(self, path: str, most_bytes: int = 256 << 20) -> None:
        from tokenizers import pre_tokenizers

        self.tokenizer = _load(path)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        self.known = Remembered(most_bytes)
        self.white = re.compile(r"\s ").search
        self.runs = re.compile(r"\s*\S+|\s+").findall

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        coded = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        found = {p: np.array(c.offsets, dtype=np.int32).reshape(-1, 2).tobytes() for p, c in zip(parts, coded, strict=True)}
        for part, spans in found.items():
            self.known.put(part, spans)
        return found

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """For each text an array of (start, end) rows, one a token, in order."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.white(text):
                cut.append(self.runs(text))
            else:
                first, *rest = text.split(" ")
                cut.append(([first] if first else []) + [" " + p for p in rest])
        local = {}
        missing = []
        for parts in cut:
            for part in parts:
                if part not in local:
                    local[part] = value = self.known.get(part)
                    if value is None:
                        missing.append(part)
        if missing:
            local.update(self._new(missing))
        out = []
        for parts in cut:
            held = [local[p] for p in parts]
            flat = np.frombuffer(b"".join(held), dtype=np.int32).reshape(-1, 2)
            counts = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 8
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            starts = np.cumsum(lengths) - lengths
            out.append(flat + np.repeat(starts, counts)[:, None])
        return out


_KNOWN: dict[tuple[type, str], WordTokenizer | OffsetTokenizer] = {}


def shared(kind: type, path: str):
    """One tokenizer of a kind a worker process, kept over tasks."""
    if (kind, path) not in _KNOWN:
        _KNOWN[kind, path] = kind(path)
    return _KNOWN[kind, path]
