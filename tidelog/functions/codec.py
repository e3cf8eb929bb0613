"""Hashes, short ids, key text and the positional row codec."""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

U = np.uint64


# native expressions


def key_hex(key: Column) -> Column:
    """First 16 bytes as lowercase hex."""
    return F.lower(F.hex(F.substring(key, 1, 16)))


def size_estimate(key: Column, value: Column) -> Column:
    return F.lit(48) + F.octet_length(key) + F.octet_length(value)


def mini_key(key: Column) -> Column:
    """First 8 bytes, little-endian, as an unsigned decimal(20,0); short keys are padded with zero bytes."""
    padded = F.rpad(F.substring(key, 1, 8), F.lit(8), F.lit(b"\x00"))
    h = F.hex(padded)
    flipped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(flipped, 16, 10).cast("decimal(20,0)")


def _flipped(h: Column) -> Column:
    """Both 8-byte halves of 32 hex digits with their bytes in reverse; each step names its input once, which keeps
    generated code small."""
    turned = F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")
    return F.regexp_replace(turned, "^(.{16})(.{16})$", "$2$1")


def short_uuid(u: Column) -> Column:
    """Canonical UUID text to 22 characters: both 8-byte halves little-endian, Base64-URL without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(_flipped(F.regexp_replace(u, "-", "")))), "+/=", "-_ "))


def short_uuid_decode(s: Column) -> Column:
    """The inverse; null for anything that is not a valid short id."""
    return _dashed(_flipped(_short_hex(s)))


def is_short_uuid(s: Column) -> Column:
    """22 signs of Base64-URL, the last with four zero bits; false for null."""
    return F.coalesce(s.rlike("^[A-Za-z0-9_-]{21}[AQgw]$"), F.lit(False))


def _short_hex(s: Column) -> Column:
    return F.lower(F.hex(F.unbase64(F.concat(F.translate(F.when(is_short_uuid(s), s), "-_", "+/"), F.lit("==")))))


def _dashed(h: Column) -> Column:
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def short_uuid_be_decode(s: Column) -> Column:
    """The inverse of short_uuid_be; null for anything that is not a valid short id."""
    return _dashed(_short_hex(s))


def short_uuid_be(u: Column) -> Column:
    """Big-endian variant."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.regexp_replace(u, "-", ""))), "+/=", "-_ "))


# hashes: numpy over whole columns; wrapping 64-bit arithmetic is not for ANSI SQL expressions


def _matrix(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(k) for k in keys], dtype=np.int64)
    width = int(n.max(initial=0))
    m = np.zeros((len(keys), width), dtype=np.uint8)
    for i, k in enumerate(keys):
        m[i, : len(k)] = np.frombuffer(k, dtype=np.uint8)
    return m, n


def fnv1a32_np(keys: list[bytes]) -> np.ndarray:
    m, n = _matrix(keys)
    h = np.full(len(keys), 0x811C9DC5, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(m.shape[1]):
            h = np.where(j < n, (h ^ m[:, j]) * np.uint32(0x01000193), h)
    return h


def mix64_np(x: np.ndarray) -> np.ndarray:
    x = x.astype(U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _rotl(x, b):
    return (x << U(b)) | (x >> U(64 - b))


SIP_SEED = 0x5AD6DCD676D23C25


def siphash24_np(keys: list[bytes], k0: int = SIP_SEED, k1: int | None = None) -> np.ndarray:
    k1 = (k0 ^ 0x9E3779B97F4A7C15) if k1 is None else k1
    m, n = _matrix(keys)
    words = int(n.max(initial=0)) // 8 + 1
    buf = np.zeros((len(keys), words * 8), dtype=np.uint8)
    buf[:, : m.shape[1]] = m
    w = buf.view("<u8")
    last = n // 8
    v = [np.full(len(keys), c ^ k, dtype=U) for c, k in ((0x736F6D6570736575, k0), (0x646F72616E646F6D, k1), (0x6C7967656E657261, k0), (0x7465646279746573, k1))]

    def rounds(v, times):
        a, b, c, d = v
        for _ in range(times):
            a = a + b
            b = _rotl(b, 13) ^ a
            a = _rotl(a, 32)
            c = c + d
            d = _rotl(d, 16) ^ c
            a = a + d
            d = _rotl(d, 21) ^ a
            c = c + b
            b = _rotl(b, 17) ^ c
            c = _rotl(c, 32)
        return [a, b, c, d]

    with np.errstate(over="ignore"):
        for j in range(words):
            x = w[:, j] | np.where(j == last, (n.astype(U) & U(0xFF)) << U(56), U(0))
            new = [*v[:3], v[3] ^ x]
            new = rounds(new, 2)
            new[0] = new[0] ^ x
            v = [np.where(j <= last, p, q) for p, q in zip(new, v, strict=True)]
        v[2] = v[2] ^ U(0xFF)
        v = rounds(v, 4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def _crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


CRC32C = _crc32c_table()


def crc32c_np(keys: list[bytes]) -> np.ndarray:
    m, n = _matrix(keys)
    c = np.full(len(keys), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(m.shape[1]):
        c = np.where(j < n, (c >> np.uint32(8)) ^ CRC32C[(c ^ m[:, j]) & np.uint32(0xFF)], c)
    return c ^ np.uint32(0xFFFFFFFF)


def murmur3_128_np(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """First 64 bits of the public-domain x64 128-bit variant."""
    m, n = _matrix(keys)
    blocks = int(n.max(initial=0)) // 16 + 1
    buf = np.zeros((len(keys), blocks * 16), dtype=np.uint8)
    buf[:, : m.shape[1]] = m
    w = buf.view("<u8").reshape(len(keys), blocks, 2)
    full = n // 16
    c1, c2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
    h1 = np.full(len(keys), seed, dtype=U)
    h2 = h1.copy()

    def fmix(x):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))

    with np.errstate(over="ignore"):
        for j in range(blocks):
            k1, k2 = _rotl(w[:, j, 0] * c1, 31) * c2, _rotl(w[:, j, 1] * c2, 33) * c1
            a = (_rotl(h1 ^ k1, 27) + h2) * U(5) + U(0x52DCE729)
            b = (_rotl(h2 ^ k2, 31) + a) * U(5) + U(0x38495AB5)
            tail = j == full
            h1, h2 = np.where(j < full, a, np.where(tail, h1 ^ k1, h1)), np.where(j < full, b, np.where(tail, h2 ^ k2, h2))
        h1, h2 = h1 ^ n.astype(U), h2 ^ n.astype(U)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = fmix(h1), fmix(h2)
        h1 = h1 + h2
    return h1


def _column_hash(fn, signed):
    def run(s: pd.Series) -> pd.Series:
        keys = [b"" if k is None else bytes(k) for k in s]
        out = pd.Series(fn(keys).astype(signed).astype("int64"), index=s.index, dtype="Int64")
        return out.mask(s.isna())

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.LongType())


fnv1a32, crc32c = _column_hash(fnv1a32_np, "uint32"), _column_hash(crc32c_np, "uint32")
siphash24, murmur3 = _column_hash(siphash24_np, "int64"), _column_hash(murmur3_128_np, "int64")
mix64 = _column_hash(lambda keys: mix64_np(np.array([int.from_bytes(k[:8].ljust(8, b'\0'), 'little') for k in keys], dtype=U)), "int64")  # of a key's first 8 bytes


# positional little-endian row codec

MAX_ITEMS, MAX_STRING = 1_000_000, 10 * 1024 * 1024
_FIXED = {T.ByteType: "<b", T.ShortType: "<h", T.IntegerType: "<i", T.LongType: "<q", T.FloatType: "<f", T.DoubleType: "<d"}
_EPOCH = dt.date(1970, 1, 1)
#: name -> (encode, decode) by a custom type's name; see register
ADAPTERS: dict[str, tuple] = {}
USES: Counter[tuple[str, str]] = Counter()


def register(name: str, encode, decode) -> None:
    """A custom adapter for struct fields whose metadata has ``{"adapter": name}``."""
    ADAPTERS[name] = (encode, decode)


def unregister(name: str) -> bool:
    return ADAPTERS.pop(name, None) is not None


def clear_adapters() -> None:
    ADAPTERS.clear()
    USES.clear()


def has_adapter(name: str) -> bool:
    return name in ADAPTERS


def adapter_stats() -> dict[str, dict[str, int]]:
    """How often this process has encoded and decoded by each registered adapter."""
    return {n: {"encoded": USES[n, "encoded"], "decoded": USES[n, "decoded"]} for n in sorted(ADAPTERS)}


def pack(c: Column, kind: T.DataType) -> Column:
    """A column's values by the row codec, in Arrow batches; null stays null."""
    return arrow_udf(lambda a: pa.array([None if v is None else encode(v, kind) for v in a.to_pylist()], pa.binary()), T.BinaryType())(c)


def unpack(c: Column, kind: T.DataType) -> Column:
    """The inverse of pack."""
    arrow = to_arrow_type(kind)
    return arrow_udf(lambda a: pa.array([None if v is None else decode(v, kind) for v in a.to_pylist()], arrow), kind)(c)


def _blob(b: bytes) -> bytes:
    return struct.pack("<i", len(b)) + b


def encode(value, kind: T.DataType, nullable: bool = False, meta: dict | None = None) -> bytes:
    if nullable:
        return b"\x00" if value is None else b"\x01" + encode(value, kind, False, meta)
    if value is None:
        raise ValueError("null in a field that is not nullable")
    if meta and meta.get("adapter") in ADAPTERS:
        USES[meta["adapter"], "encoded"] += 1
        return _blob(ADAPTERS[meta["adapter"]][0](value))
    if type(kind) in _FIXED:
        return struct.pack(_FIXED[type(kind)], value)
    if isinstance(kind, T.BooleanType):
        return b"\x01" if value else b"\x00"
    if isinstance(kind, T.StringType):
        b = value.encode()
        if len(b) > MAX_STRING:
            raise ValueError("string is too long")
        return _blob(b)
    if isinstance(kind, T.BinaryType):
        return _blob(bytes(value))
    if isinstance(kind, T.DateType):
        return struct.pack("<q", (value - _EPOCH).days)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        d = value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)
        return struct.pack("<qi", d.days * 86400 + d.seconds, d.microseconds * 1000)
    if isinstance(kind, T.DecimalType):
        sign, digits, exp = decimal.Decimal(value).as_tuple()
        n = int("".join(map(str, digits)) or 0)
        return _blob(n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")) + struct.pack("<bi", -1 if sign else 1, -exp)
    if isinstance(kind, T.ArrayType):
        return struct.pack("<i", len(value)) + b"".join(encode(v, kind.elementType, kind.containsNull) for v in value)
    if isinstance(kind, T.MapType):
        return struct.pack("<i", len(value)) + b"".join(encode(k, kind.keyType) + encode(v, kind.valueType, kind.valueContainsNull) for k, v in value.items())
    if isinstance(kind, T.StructType):
        get = value.get if isinstance(value, dict) else lambda n: value[n]
        return b"".join(encode(get(f.name), f.dataType, f.nullable, f.metadata) for f in kind.fields)
    raise TypeError(f"no adapter for {kind.simpleString()}")


def decode(buf: bytes, kind: T.DataType, nullable: bool = False, meta: dict | None = None):
    value, at = _decode(memoryview(buf), 0, kind, nullable, meta)
    if at != len(buf):
        raise ValueError(f"{len(buf) - at} bytes are left over")
    return value


def _decode(b, at, kind, nullable=False, meta=None):
    if nullable:
        return (None, at + 1) if b[at] == 0 else _decode(b, at + 1, kind, False, meta)

    def blob(at, most=None):
        n = struct.unpack_from("<i", b, at)[0]
        if n < 0 or at + 4 + n > len(b) or (most and n > most):
            raise ValueError("bad length")
        return bytes(b[at + 4 : at + 4 + n]), at + 4 + n

    def many(at):
        n = struct.unpack_from("<i", b, at)[0]
        if not 0 <= n <= MAX_ITEMS:
            raise ValueError("bad collection size")
        return n, at + 4

    if meta and meta.get("adapter") in ADAPTERS:
        x, at = blob(at)
        USES[meta["adapter"], "decoded"] += 1
        return ADAPTERS[meta["adapter"]][1](x), at
    if type(kind) in _FIXED:
        f = _FIXED[type(kind)]
        return struct.unpack_from(f, b, at)[0], at + struct.calcsize(f)
    if isinstance(kind, T.BooleanType):
        return b[at] != 0, at + 1
    if isinstance(kind, T.StringType):
        x, at = blob(at, MAX_STRING)
        return x.decode(), at
    if isinstance(kind, T.BinaryType):
        return blob(at)
    if isinstance(kind, T.DateType):
        return _EPOCH + dt.timedelta(days=struct.unpack_from("<q", b, at)[0]), at + 8
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        s, ns = struct.unpack_from("<qi", b, at)
        return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s, microseconds=ns // 1000), at + 12
    if isinstance(kind, T.DecimalType):
        x, at = blob(at)
        sign, scale = struct.unpack_from("<bi", b, at)
        return decimal.Decimal(int.from_bytes(x, "big") * sign).scaleb(-scale), at + 5
    if isinstance(kind, T.ArrayType):
        n, at = many(at)
        out = []
        for _ in range(n):
            v, at = _decode(b, at, kind.elementType, kind.containsNull)
            out.append(v)
        return out, at
    if isinstance(kind, T.MapType):
        n, at = many(at)
        out = {}
        for _ in range(n):
            k, at = _decode(b, at, kind.keyType)
            out[k], at = _decode(b, at, kind.valueType, kind.valueContainsNull)
        return out, at
    if isinstance(kind, T.StructType):
        out = {}
        for f in kind.fields:
            out[f.name], at = _decode(b, at, f.dataType, f.nullable, f.metadata)
        return out, at
    raise TypeError(f"no adapter for {kind.simpleString()}")


def deep_copy(value, kind: T.DataType):
    return decode(encode(value, kind), kind)


def new_short_uuid() -> str:
    import base64

    u = uuid.uuid4().bytes
    return base64.urlsafe_b64encode(u[7::-1] + u[:7:-1]).decode().rstrip("=")
