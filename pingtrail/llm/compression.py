"""Compressed sizes of texts under raw-content zstandard dictionaries."""

from __future__ import annotations

import zstandard

# At most this many bytes of a text are compressed at a time, so that a dictionary weighs the same all along a long text.
PIECE_BYTES = 1024


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False,
                                    write_dict_id=False, write_checksum=False)


def pieces(data: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    return [data[at:at + size] for at in range(0, len(data), size)]


def size_under(coder: zstandard.ZstdCompressor, parts: list[bytes]) -> int:
    return sum(len(coder.compress(part)) for part in parts)
