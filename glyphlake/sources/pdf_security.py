"""Encrypted files that open without a password: the standard handler with RC4, and what its permissions allow."""

from __future__ import annotations

import hashlib

from glyphlake.sources.pdf_objects import PdfError, Stream

#: Fixed value of the format: what pads a password.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
PASSWORD = "Cannot audit a password-protected PDF without a password."
NOT_ALLOWED = "PDF permissions do not allow text extraction"
#: Bit of the permissions that allows text to be extracted.
EXTRACT = 1 << 4


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class Security:
    """The key of a file, from its Encrypt dictionary (entries resolved) and the first part of its identifier."""

    def __init__(self, entries: dict, file_id: bytes):
        number = lambda k, d: v if isinstance(v := entries.get(k), int) else d
        version, revision = number("V", 0), number("R", 0)
        if entries.get("Filter") != "Standard" or version not in (1, 2, 4) or revision not in (2, 3, 4):
            raise PdfError("PDF encryption is not supported")
        self.plain_streams = False
        length = number("Length", 40) // 8 if version > 1 else 5
        if version == 4:
            filters = entries.get("CF") if isinstance(entries.get("CF"), dict) else {}
            used = {str(entries.get(k, "Identity")) for k in ("StmF", "StrF")}
            methods = {str(filters.get(n, {}).get("CFM", "None")) if n != "Identity" else "None" for n in used}
            if methods - {"V2", "None"} or len(methods) > 1:
                raise PdfError("PDF encryption is not supported")
            self.plain_streams, length = methods == {"None"}, 16
        owner, user = (bytes(entries.get(k) or b"")[:32] for k in ("O", "U"))
        permissions = number("P", 0)
        seed = PADDING + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if revision >= 4 and entries.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = hashlib.md5(seed, usedforsecurity=False).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:length], usedforsecurity=False).digest()
        self.key = key[:length]
        if revision == 2:
            good = rc4(self.key, PADDING) == user
        else:
            told = rc4(self.key, hashlib.md5(PADDING + file_id, usedforsecurity=False).digest())
            for k in range(1, 20):
                told = rc4(bytes(c ^ k for c in self.key), told)
            good = told == user[:16]
        if not good:
            raise PdfError(PASSWORD)
        self.extraction_allowed = bool(permissions & EXTRACT)

    def decrypted(self, value, number: int, generation: int):
        """An object with its strings and its stream in the clear."""
        if self.plain_streams:
            return value
        salted = self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")
        key = hashlib.md5(salted, usedforsecurity=False).digest()[: min(16, len(self.key) + 5)]

        def clear(v):
            if isinstance(v, bytes):
                return rc4(key, v)
            if isinstance(v, list):
                return [clear(x) for x in v]
            return {k: clear(x) for k, x in v.items()} if isinstance(v, dict) else v

        if isinstance(value, Stream):
            kept = value.entries.get("Type") == "XRef"
            return value if kept else Stream(clear(value.entries), rc4(key, value.raw))
        return clear(value)
