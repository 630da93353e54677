"""Ed25519 signature checks (RFC 8032) over columns of keys, messages and signatures; a pandas UDF, as Spark has none."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, -1, P) % P


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or not x and odd:
        return None
    return P - x if x & 1 != odd else x


def _add(a, b):
    """Extended coordinates (x, y, z, t)."""
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    u, v, w, z = f - e, h - g, h + g, f + e
    return u * v % P, w * z % P, v * w % P, u * z % P


def _times(k: int, point):
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, point)
        point = _add(point, point)
        k >>= 1
    return out


def _point(data: bytes):
    number = int.from_bytes(data, "little")
    y = number & (1 << 255) - 1
    x = _x_of(y, number >> 255)
    return None if x is None else (x, y, 1, x * y % P)


BASE = (lambda x: (x, BASE_Y, 1, x * BASE_Y % P))(_x_of(BASE_Y, 0))


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + key + message).digest(), "little") % ORDER
    left, right = _times(s, BASE), _add(r, _times(h, a))
    return not (left[0] * right[2] - right[0] * left[2]) % P and not (left[1] * right[2] - right[1] * left[2]) % P


@F.pandas_udf(T.BooleanType())
def signed(key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([k is not None and m is not None and s is not None and verify(bytes(k), bytes(m), bytes(s)) for k, m, s in zip(key, message, signature, strict=True)], dtype=bool)


def _secret(seed: bytes) -> tuple[int, bytes]:
    digest = hashlib.sha512(seed).digest()
    return int.from_bytes(digest[:32], "little") & (1 << 254) - 8 | 1 << 254, digest[32:]


def _packed(point) -> bytes:
    x, y, z, _ = point
    inverse = pow(z, -1, P)
    return (y * inverse % P | (x * inverse % P & 1) << 255).to_bytes(32, "little")


def public_key(seed: bytes) -> bytes:
    """Of a secret seed of 32 bytes."""
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _secret(seed)
    key = public_key(seed)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % ORDER
    at = _packed(_times(r, BASE))
    h = int.from_bytes(hashlib.sha512(at + key + message).digest(), "little") % ORDER
    return at + ((r + h * scalar) % ORDER).to_bytes(32, "little")
