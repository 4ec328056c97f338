"""Encryption of columns: AES-256-GCM built into Spark, ChaCha20-Poly1305 and X25519 in Arrow UDFs, policies, keys.

Sealed values are nonce (12 bytes), ciphertext and tag (16 bytes). Keys are given, never made silently.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.errors import EncryptionError

#: Strategy codes. Fixed values.
STRATEGIES = {"none": 0, "aes_gcm": 1, "chacha20_poly1305": 2, "ecc": 3, "kyber": 4, "aes_kyber": 5, "chacha20_kyber": 6, "custom": 7}
_P25519 = 2**255 - 19


# -- ChaCha20-Poly1305 (RFC 8439) --------------------------------------------------------------------


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def chacha20_stream(key: bytes, nonce: bytes, blocks: int, counter: int) -> bytes:
    """Key stream; all blocks are worked at once."""
    state = np.empty((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(counter, counter + blocks, dtype=np.uint64).astype(np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    v = list(state.copy())
    for _ in range(10):
        for shift in (0, 1):
            for i in range(4):
                a, b, c, d = i, 4 + (i + shift) % 4, 8 + (i + 2 * shift) % 4, 12 + (i + 3 * shift) % 4
                for x, y, z, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                    v[x] = v[x] + v[y]
                    v[z] = _turn(v[z] ^ v[x], n)
    return np.ascontiguousarray((np.array(v) + state).T.astype("<u4")).tobytes()


def poly1305(key: bytes, message: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total = 0
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\1", "little")) * r % (2**130 - 5)
    return ((total + int.from_bytes(key[16:], "little")) % 2**128).to_bytes(16, "little")


def _xor(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)[: len(a)]).tobytes()


def _tag(key: bytes, nonce: bytes, sealed: bytes, more: bytes) -> bytes:
    pad = lambda x: x + bytes(-len(x) % 16)
    return poly1305(chacha20_stream(key, nonce, 1, 0)[:32], pad(more) + pad(sealed) + len(more).to_bytes(8, "little") + len(sealed).to_bytes(8, "little"))


def chacha_seal(key: bytes, nonce: bytes, plain: bytes, more: bytes = b"") -> bytes:
    sealed = _xor(plain, chacha20_stream(key, nonce, -(-len(plain) // 64), 1)) if plain else b""
    return sealed + _tag(key, nonce, sealed, more)


def chacha_open(key: bytes, nonce: bytes, sealed: bytes, more: bytes = b"") -> bytes:
    body, tag = sealed[:-16], sealed[-16:]
    if len(sealed) < 16 or not hmac.compare_digest(tag, _tag(key, nonce, body, more)):
        raise EncryptionError("authentication failed")
    return _xor(body, chacha20_stream(key, nonce, -(-len(body) // 64), 1)) if body else b""


# -- X25519 (RFC 7748) -------------------------------------------------------------------------------


def x25519(scalar: bytes, point: bytes) -> bytes:
    k = int.from_bytes(bytes([scalar[0] & 248]) + scalar[1:31] + bytes([scalar[31] & 127 | 64]), "little")
    u = int.from_bytes(point, "little") & (2**255 - 1)
    p, x1, x2, z2, x3, z3, swap = _P25519, u, 1, 0, u, 1, 0
    for i in range(254, -1, -1):
        bit = k >> i & 1
        if swap ^ bit:
            x2, x3, z2, z3 = x3, x2, z3, z2
        swap = bit
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        aa, bb, da, cb = a * a % p, b * b % p, d * a % p, c * b % p
        e = aa - bb
        x3, z3 = (da + cb) ** 2 % p, x1 * (da - cb) ** 2 % p
        x2, z2 = aa * bb % p, e * (aa + 121665 * e) % p
    if swap:
        x2, z2 = x3, z3
    return (x2 * pow(z2, p - 2, p) % p).to_bytes(32, "little")


def public_key(secret: bytes) -> bytes:
    return x25519(secret, (9).to_bytes(32, "little"))


def ecc_seal(public: bytes, plain: bytes) -> bytes:
    """Ephemeral public key, nonce, sealed value; the key is SHA-256 of the shared secret."""
    own = os.urandom(32)
    key, nonce = hashlib.sha256(x25519(own, public)).digest(), os.urandom(12)
    return public_key(own) + nonce + chacha_seal(key, nonce, plain)


def ecc_open(secret: bytes, sealed: bytes) -> bytes:
    if len(sealed) < 60:
        raise EncryptionError("data too short")
    key = hashlib.sha256(x25519(secret, sealed[:32])).digest()
    return chacha_open(key, sealed[32:44], sealed[44:])


# -- columns -----------------------------------------------------------------------------------------


def _mapped(data: Column, act: Callable[[bytes], bytes], on_error: str) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                try:
                    rows.append(act(x.as_py()) if x.is_valid else None)
                except EncryptionError:
                    if on_error == "fail":
                        raise
                    rows.append(None)
            yield pa.array(rows, pa.binary())

    return F.arrow_udf(run, T.BinaryType()).asNondeterministic()(data)


def _key32(key: bytes) -> bytes:
    if len(key) != 32:
        raise EncryptionError("a key has 32 bytes")
    return key


def _key_column(key: bytes | Column) -> Column:
    """A key as a column. One that is given as bytes stands in plans, and so in event logs; one that is a column of the data does not."""
    return key if isinstance(key, Column) else F.lit(_key32(key))


def encrypt(data: Column, strategy: str, key: bytes | Column = b"") -> Column:
    """BINARY sealed under a key (for "ecc": the receiver's public key). For AES the key may be a BINARY column."""
    if strategy == "none":
        return data
    if strategy == "aes_gcm":
        return F.aes_encrypt(data, _key_column(key), F.lit("GCM"))
    if strategy == "chacha20_poly1305":
        _key32(key)
        return _mapped(data, lambda x: (nonce := os.urandom(12)) + chacha_seal(key, nonce, x), "fail")
    if strategy == "ecc":
        return _mapped(data, lambda x: ecc_seal(_key32(key), x), "fail")
    raise EncryptionError(f"unsupported strategy: {strategy}")


def decrypt(data: Column, strategy: str, key: bytes | Column = b"", on_error: str = "null") -> Column:
    """BINARY opened (for "ecc": by the secret key). on_error: "fail", or "null" for what doesn't authenticate."""
    if strategy == "none":
        return data
    if strategy == "aes_gcm":
        act = F.aes_decrypt if on_error == "fail" else F.try_aes_decrypt
        return act(data, _key_column(key), F.lit("GCM"))
    if strategy == "chacha20_poly1305":
        _key32(key)
        return _mapped(data, lambda x: chacha_open(key, x[:12], x[12:]), on_error)
    if strategy == "ecc":
        return _mapped(data, lambda x: ecc_open(_key32(key), x), on_error)
    raise EncryptionError(f"unsupported strategy: {strategy}")


@dataclass(frozen=True)
class FieldPolicy:
    """Strategy and key by column; the default goes for columns not named. Only strings and bytes are sealed."""

    default: str = "none"
    strategies: dict[str, str] = field(default_factory=dict)
    keys: dict[str, bytes] = field(default_factory=dict)

    def of(self, column: str) -> tuple[str, bytes]:
        strategy = self.strategies.get(column, self.default)
        return strategy, self.keys.get(column, self.keys.get("*", b""))


def encrypt_fields(df: DataFrame, policy: FieldPolicy) -> DataFrame:
    """df with its string and binary columns sealed by policy, as BINARY."""

    def of(f: T.StructField) -> Column:
        strategy, key = policy.of(f.name)
        if strategy == "none" or not isinstance(f.dataType, T.StringType | T.BinaryType):
            return F.col(f.name)
        return encrypt(F.col(f.name).cast("binary"), strategy, key).alias(f.name)

    return df.select(*map(of, df.schema.fields))


def decrypt_fields(df: DataFrame, policy: FieldPolicy, schema: T.StructType | None = None) -> DataFrame:
    """df with BINARY columns opened by policy; those that are strings in schema become strings again."""
    strings = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)} if schema else set()

    def of(f: T.StructField) -> Column:
        strategy, key = policy.of(f.name)
        if strategy == "none" or not isinstance(f.dataType, T.BinaryType):
            return F.col(f.name)
        plain = decrypt(F.col(f.name), strategy, key)
        return (plain.cast("string") if f.name in strings else plain).alias(f.name)

    return df.select(*map(of, df.schema.fields))


# -- keys --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Key:
    id: str
    kind: str
    material: bytes = field(repr=False)
    created: float = 0.0
    expires: float | None = None

    def expired(self, now: float) -> bool:
        return self.expires is not None and now >= self.expires


class KeyProvider(Protocol):
    """Keys kept elsewhere."""

    def get(self, key_id: str) -> Key: ...

    def put(self, key: Key) -> None: ...


class KeyManager:
    """Keys by id on the driver, with a primary one of each kind."""

    def __init__(self, clock: Callable[[], float] = time.time, provider: KeyProvider | None = None):
        self._keys: dict[str, Key] = {}
        self._primary: dict[str, str] = {}
        self._clock, self._provider = clock, provider

    def generate(self, kind: str, lifetime: float | None = None, key_id: str | None = None) -> Key:
        """A new key; the first of its kind is primary."""
        now = self._clock()
        key = Key(key_id or uuid.uuid4().hex, kind, os.urandom(32), now, now + lifetime if lifetime is not None else None)
        self._keys[key.id] = key
        self._primary.setdefault(kind, key.id)
        if self._provider:
            self._provider.put(key)
        return key

    def get(self, key_id: str) -> Key:
        key = self._keys.get(key_id) or (self._provider.get(key_id) if self._provider else None)
        if key is None:
            raise EncryptionError(f"no key {key_id}")
        if key.expired(self._clock()):
            raise EncryptionError(f"key {key_id} has expired")
        return key

    def primary(self, kind: str) -> Key:
        if kind not in self._primary:
            raise EncryptionError(f"no primary key of kind {kind}")
        return self.get(self._primary[kind])

    def set_primary(self, key_id: str) -> None:
        self._primary[self.get(key_id).kind] = key_id

    def remove(self, key_id: str) -> None:
        key = self._keys.pop(key_id, None)
        if key and self._primary.get(key.kind) == key_id:
            del self._primary[key.kind]

    def expire(self, key_id: str) -> None:
        self._keys[key_id] = replace(self.get(key_id), expires=self._clock())

    def list(self, kind: str | None = None) -> list[Key]:
        return sorted((k for k in self._keys.values() if kind in (None, k.kind)), key=lambda k: (k.created, k.id))

    def rotate(self, kind: str, keep: int = 0, lifetime: float | None = None) -> Key:
        """A new primary key; of the older ones the newest `keep` stay."""
        old = self.list(kind)
        new = self.generate(kind, lifetime)
        self._primary[kind] = new.id
        for key in old[: len(old) - keep] if keep else old:
            self.remove(key.id)
        return new


def newest_keys(keys: DataFrame, keep: int, kind: str = "kind", created: str = "created", key_id: str = "key_id") -> DataFrame:
    """Of a table of keys, the newest `keep` of each kind; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(created), key_id))
    return keys.withColumn("_nth", rank).where(F.col("_nth") <= keep).drop("_nth")
