"""Words of lower-cased text, as bytes: digits, a-z and everything outside ASCII."""

from __future__ import annotations

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of word bytes in order, after lower-casing A-Z; none for null."""
    return text.translate(_TABLE).split() if text else []
