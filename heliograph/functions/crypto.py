"""Byte functions of the envelope: key exchange, derivation, authenticated encryption, ciphertext layout, sealing and opening.

X25519 (RFC 7748) and ChaCha20-Poly1305 (RFC 8439) are neither part of Spark nor
of the Python standard library and are written here from their RFCs. They are
not hardened against timing. The time lock is external: whoever opens
envelopes brings the callable that resolves it for a round's signature.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hkdf_sha256(secret: bytes, info: bytes, length: int, salt: bytes = b"") -> bytes:
    """Extract and expand (RFC 5869)."""
    key = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, last, n = b"", b"", 1
    while len(out) < length:
        last = hmac.new(key, last + info + bytes([n]), hashlib.sha256).digest()
        out, n = out + last, n + 1
    return out[:length]


@F.pandas_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("nonce", T.BinaryType())]))
def key_and_nonce(secret: pd.Series, info: pd.Series) -> pd.DataFrame:
    """32-byte key and 12-byte nonce of each shared secret."""
    okm = [None if s is None or i is None else hkdf_sha256(bytes(s), bytes(i), 44) for s, i in zip(secret, info, strict=True)]
    return pd.DataFrame({"key": [o and o[:32] for o in okm], "nonce": [o and o[32:] for o in okm]})


def bytes_between(binary: Column, start: int, length: int) -> Column:
    """A slice of a ciphertext (0-based)."""
    return F.substring(binary, start + 1, length)


def little_endian_u64(binary: Column) -> Column:
    """Eight bytes, least significant first, as DECIMAL(20, 0)."""
    digits = F.concat(*(F.hex(F.substring(binary, i, 1)) for i in range(8, 0, -1)))
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def legacy_plaintext(text: Column) -> Column:
    """(payload, hotkey) of the form payload:::hotkey, cut at the last separator."""
    hotkey = F.regexp_extract(text, r"(?s)^.*:::(.*)$", 1)
    return F.struct(F.when(text.contains(":::"), F.regexp_replace(text, r"(?s):::(?!.*:::).*$", "")).alias("payload"), F.when(text.contains(":::"), hotkey).alias("hotkey"))


def open_envelope(opener: Callable[[str], bytes | None]) -> Callable[[Column], Column]:
    """A vectorised function that opens envelopes with an ``opener``; failures become null."""

    @F.pandas_udf(T.BinaryType())
    def opened(envelopes: pd.Series) -> pd.Series:
        def one(e: str | None) -> bytes | None:
            try:
                return None if e is None else opener(e)
            except Exception:  # any failure means: not readable
                return None

        return envelopes.map(one)

    return opened


_PRIME = 2**255 - 19


def x25519(scalar: bytes, point: bytes) -> bytes:
    """The shared secret of a private and a public key (Montgomery ladder)."""
    k = int.from_bytes(scalar, "little") & ~7 & (2**255 - 1) & ~(1 << 255) | 1 << 254
    u = int.from_bytes(point, "little") & (2**255 - 1)
    x2, z2, x3, z3, swap = 1, 0, u, 1, 0
    for t in range(254, -1, -1):
        bit = k >> t & 1
        if swap ^ bit:
            x2, x3, z2, z3 = x3, x2, z3, z2
        swap = bit
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        da, cb, aa, bb = d * a % _PRIME, c * b % _PRIME, a * a % _PRIME, b * b % _PRIME
        e = aa - bb
        x3, z3 = (da + cb) ** 2 % _PRIME, u * (da - cb) ** 2 % _PRIME
        x2, z2 = aa * bb % _PRIME, e * (aa + 121665 * e) % _PRIME
    if swap:
        x2, z2 = x3, z3
    return (x2 * pow(z2, _PRIME - 2, _PRIME) % _PRIME).to_bytes(32, "little")


def public_key(private: bytes) -> bytes:
    """The public key of a private one (base point 9)."""
    return x25519(private, (9).to_bytes(32, "little"))


def _chacha20(key: bytes, counter: int, nonce: bytes, data: bytes) -> bytes:
    """Key stream of all 64-byte blocks at once (columns), XORed onto the data."""
    blocks = -(-len(data) // 64)
    first = np.concatenate((np.frombuffer(b"expand 32-byte k", "<u4"), np.frombuffer(key, "<u4"), np.zeros(1, "<u4"), np.frombuffer(nonce, "<u4"))).astype(np.uint32)
    start = np.repeat(first[:, None], blocks, axis=1)
    start[12] = counter + np.arange(blocks, dtype=np.uint32)
    s = start.copy()

    def turn(a: int, b: int, c: int, d: int) -> None:
        for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            s[x] += s[y]
            s[z] ^= s[x]
            s[z] = s[z] << np.uint32(n) | s[z] >> np.uint32(32 - n)

    for _ in range(10):
        for i in range(4):
            turn(i, i + 4, i + 8, i + 12)
        for i in range(4):
            turn(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4)
    stream = (s + start).T.astype("<u4").tobytes()
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)[: len(data)]).tobytes()


def _poly1305(key: bytes, message: bytes) -> bytes:
    r, total = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, 0
    for at in range(0, len(message), 16):
        total = (total + int.from_bytes(message[at : at + 16] + b"\x01", "little")) * r % (2**130 - 5)
    return ((total + int.from_bytes(key[16:], "little")) % 2**128).to_bytes(16, "little")


def _tag(key: bytes, nonce: bytes, aad: bytes, sealed: bytes) -> bytes:
    padded = lambda b: b + bytes(-len(b) % 16)
    lengths = len(aad).to_bytes(8, "little") + len(sealed).to_bytes(8, "little")
    return _poly1305(_chacha20(key, 0, nonce, bytes(32)), padded(aad) + padded(sealed) + lengths)


def seal(key: bytes, nonce: bytes, plain: bytes, aad: bytes = b"") -> bytes:
    """ChaCha20-Poly1305: ciphertext and tag."""
    sealed = _chacha20(key, 1, nonce, plain)
    return sealed + _tag(key, nonce, aad, sealed)


def unseal(key: bytes, nonce: bytes, sealed: bytes, aad: bytes = b"") -> bytes | None:
    """The plaintext; None where the tag isn't right."""
    if len(sealed) < 16 or len(nonce) != 12 or not hmac.compare_digest(_tag(key, nonce, aad, sealed[:-16]), sealed[-16:]):
        return None
    return _chacha20(key, 1, nonce, sealed[:-16])


def converted(sealed: Column) -> Column:
    """Ciphertexts of 372 bytes with two length prefixes of 32 in the form without (356 bytes); others as they are."""
    old = (F.length(sealed) == 372) & (little_endian_u64(bytes_between(sealed, 96, 8)) == 32) & (little_endian_u64(bytes_between(sealed, 136, 8)) == 32)
    return F.when(old, F.concat(bytes_between(sealed, 0, 96), bytes_between(sealed, 104, 32), bytes_between(sealed, 144, 228))).otherwise(sealed)


def bound(hotkey: str, round_: int, owner: bytes, pke: bytes) -> bytes:
    """C01 for one envelope."""
    return hashlib.sha256(b":".join((hotkey.encode(), str(round_).encode(), owner, pke))).digest()


def sealed_envelope(hotkey: str, round_: int, owner: bytes, payload: dict, info: bytes, lock: Callable[[int, bytes], bytes], ske: bytes, key: bytes, nonces: tuple[bytes, bytes], alg: str) -> dict:
    """A version 2 envelope around a submission; ``lock`` is the time lock for a round. Keys and nonces are the caller's."""
    pke = public_key(ske)
    binding = bound(hotkey, round_, owner, pke)
    text = json.dumps({**payload, "hotkey": hotkey}, ensure_ascii=False, separators=(",", ":")).encode()
    wrap = hkdf_sha256(x25519(ske, owner), info, 44)[:32]
    parts = {"C": {"nonce": nonces[0].hex(), "ct": seal(key, nonces[0], text, binding).hex()}, "W_owner": {"pke": pke.hex(), "nonce": nonces[1].hex(), "ct": seal(wrap, nonces[1], key, binding).hex()}}
    return {"v": 2, "round": round_, "hk": hotkey, "owner_pk": owner.hex(), **parts, "W_time": {"ct": lock(round_, ske + key).hex()}, "binding": binding.hex(), "alg": alg}


def opener(owner: bytes, info: bytes, unlock: Callable[[int, bytes], bytes]) -> Callable[[str], bytes | None]:
    """Opens one envelope (JSON text) for ``open_envelope``; None for a wrong owner, binding, key or tag. ``unlock`` resolves the time lock of a round."""

    def one(text: str) -> bytes | None:
        e = json.loads(text)
        if isinstance(e.get("owner_pk"), str) and e["owner_pk"].lower() != owner.hex():
            return None
        wrapped, pke = e["W_owner"], bytes.fromhex(e["W_owner"]["pke"])
        binding = bound(e["hk"], int(e["round"]), owner, pke)
        if binding.hex() != e["binding"].lower():
            return None
        both = unlock(int(e["round"]), bytes.fromhex(e["W_time"]["ct"]))
        ske, key = both[:32], both[32:]
        if len(both) != 64 or public_key(ske) != pke:
            return None
        wrap = hkdf_sha256(x25519(ske, owner), info, 44)[:32]
        if unseal(wrap, bytes.fromhex(wrapped["nonce"]), bytes.fromhex(wrapped["ct"]), binding) != key:
            return None
        return unseal(key, bytes.fromhex(e["C"]["nonce"]), bytes.fromhex(e["C"]["ct"]), binding)

    return one
