"""Column-level crypto (FN-01..FN-11, FN-07).

All functions return ``Column`` objects built from Spark's native AES-GCM and
SHA-2 expressions, so encryption and decryption run vectorised inside whole
stage code generation. Keys always travel as *columns* (joined in), never as
literals: a literal key would be visible in ``explain`` output and event logs,
and an expression whose arguments are all literals may be constant-folded.

Formats (fixed, they must equal the reference's on-disk forms):
  * randomised vault bundle: ``key_id:base64(iv):base64(ciphertext||tag)``
  * deterministic bundle:    ``v{n}:base64(ciphertext||tag)``, IV = SHA-256(user)[0:12]
  * AES-256-GCM, 12-byte IV, 16-byte tag, AAD = UTF-8 bytes of the user id.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values shared with the reference formats.
KEY_SIZE = 32
IV_SIZE = 12
TAG_SIZE = 16
HMAC_BLOCK = 64
HMAC_IPAD = 0x36
HMAC_OPAD = 0x5C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def b64(binary: Column) -> Column:
    """Base64 text without the MIME line breaks Spark inserts every 76 chars."""
    return F.translate(F.base64(binary), "\r\n", "")


def unb64(text: Column) -> Column:
    """Base64 text → binary; malformed input gives NULL instead of failing the task."""
    return F.try_to_binary(text, F.lit("base64"))


def utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def key_ok(dek: Column) -> Column:
    """FN-07: a DEK must be exactly 32 bytes."""
    return dek.isNotNull() & (F.length(dek) == KEY_SIZE)


# --- FN-01..03 deterministic mode -------------------------------------------

def deterministic_iv(user_id) -> Column:
    """FN-01: first 12 bytes of SHA-256(user_id)."""
    return F.substring(F.unhex(F.sha2(utf8(_c(user_id)), 256)), 1, IV_SIZE)


def encrypt_deterministic(plaintext, user_id, dek) -> Column:
    """FN-02: base64(ciphertext||tag) with the user-derived IV; NULL for a bad key."""
    user = _c(user_id)
    out = F.aes_encrypt(utf8(_c(plaintext)), _c(dek), F.lit("GCM"), F.lit("DEFAULT"),
                        deterministic_iv(user), utf8(user))
    body = F.substr(out, F.lit(IV_SIZE + 1))
    return F.when(key_ok(_c(dek)), b64(body))


def deterministic_bundle(version, ciphertext_b64) -> Column:
    return F.concat(_c(version), F.lit(":"), _c(ciphertext_b64))


def decrypt_deterministic(ciphertext_b64, user_id, dek) -> Column:
    """FN-03: NULL when the tag does not verify (wrong user, wrong key, tampering)."""
    user = _c(user_id)
    body = unb64(_c(ciphertext_b64))
    full = F.concat(deterministic_iv(user), body)
    pt = F.try_aes_decrypt(full, _c(dek), F.lit("GCM"), F.lit("DEFAULT"), utf8(user))
    ok = key_ok(_c(dek)) & body.isNotNull() & (F.length(body) >= TAG_SIZE)
    return F.when(ok, pt.cast("string"))


def parse_deterministic_bundle(bundle) -> tuple[Column, Column]:
    """VAL-03 shape ``v<digits>:<base64>`` → (version, ciphertext) or NULLs."""
    b = _c(bundle)
    valid = b.rlike(r"^v\d+:[A-Za-z0-9+/=]+$")
    version = F.when(valid, F.substring_index(b, ":", 1))
    body = F.when(valid, F.regexp_extract(b, r"^v\d+:(.*)$", 1))
    return version, body


# --- FN-04..06 randomised vault mode ----------------------------------------

def encrypt_random(plaintext, user_id, dek, key_id) -> Column:
    """FN-04 bundle ``key_id:base64(iv):base64(ct||tag)``; NULL for a bad key or NULL plaintext.

    ``aes_encrypt`` draws a fresh IV on every evaluation, so it must appear
    exactly once in the expression tree: the output (iv||ct||tag) is base64'd
    whole and split textually. A 12-byte IV is base64-aligned (16 chars), so
    base64(iv||body) == base64(iv) || base64(body).
    """
    user = _c(user_id)
    out = F.aes_encrypt(utf8(_c(plaintext)), _c(dek), F.lit("GCM"), F.lit("DEFAULT"),
                        F.unhex(F.lit("")), utf8(user))
    iv_then_body = F.regexp_replace(b64(out), r"^(.{16})", "$1:")
    return F.when(key_ok(_c(dek)) & _c(plaintext).isNotNull(),
                  F.concat(_c(key_id), F.lit(":"), iv_then_body))


def decrypt_random(iv_b64, ciphertext_b64, user_id, dek) -> Column:
    """FN-05: decrypt iv/ct halves; NULL on bad tag, bad base64, short input, bad key."""
    user = _c(user_id)
    iv = unb64(_c(iv_b64))
    body = unb64(_c(ciphertext_b64))
    pt = F.try_aes_decrypt(F.concat(iv, body), _c(dek), F.lit("GCM"), F.lit("DEFAULT"), utf8(user))
    ok = (key_ok(_c(dek)) & user.isNotNull() & iv.isNotNull() & (F.length(iv) == IV_SIZE)
          & body.isNotNull() & (F.length(body) >= TAG_SIZE))
    return F.when(ok, pt.cast("string"))


def bundle_key_id(bundle) -> Column:
    """Key version named in a vault bundle (first ``:`` segment), NULL if malformed."""
    parts = F.split(_c(bundle), ":", 3)
    return F.when((F.size(parts) >= 3) & (F.length(parts[0]) > 0), parts[0])


def decrypt_bundle(bundle, user_id, dek) -> Column:
    """FN-06: vault bundle → plaintext or NULL.

    NULL for: NULL/empty bundle, NULL user, fewer than three parts, an empty
    part, no key (``dek`` NULL), a key of the wrong size, or a failed tag.
    Colons after the second one belong to the ciphertext (split limit 3).
    """
    b = _c(bundle)
    parts = F.split(b, ":", 3)
    well_formed = (b.isNotNull() & (F.length(b) > 0) & (F.size(parts) >= 3)
                   & (F.length(F.get(parts, 0)) > 0) & (F.length(F.get(parts, 1)) > 0)
                   & (F.length(F.get(parts, 2)) > 0))
    return F.when(well_formed & _c(user_id).isNotNull(),
                  decrypt_random(F.get(parts, 1), F.get(parts, 2), user_id, dek))


# --- FN-09 key wrapping -------------------------------------------------------

def wrap_key(dek, kek) -> Column:
    """FN-09: wrap a DEK under a tenant key-encryption key (AES-GCM, random IV)."""
    return F.aes_encrypt(_c(dek), _c(kek), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), F.lit(b""))


def unwrap_key(wrapped, kek) -> Column:
    """FN-09 inverse; NULL if the wrapped bytes do not verify under the tenant key."""
    return F.try_aes_decrypt(_c(wrapped), _c(kek), F.lit("GCM"), F.lit("DEFAULT"))


# --- FN-10/11 hashing -----------------------------------------------------------

def hmac_pads(key) -> tuple[Column, Column]:
    """Inner and outer HMAC-SHA256 pads of a key (keys up to 64 bytes).

    Computed with hex/conv over the 64 byte positions; meant to run once per
    key row (a tenant token key), not once per value.
    """
    khex = F.rpad(F.hex(_c(key)), HMAC_BLOCK * 2, "0")

    def pad(p: int) -> Column:
        byte_hex = F.transform(
            F.sequence(F.lit(0), F.lit(HMAC_BLOCK - 1)),
            lambda i: F.lpad(
                F.hex(F.conv(F.substr(khex, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(p))),
                2, "0"),
        )
        return F.unhex(F.array_join(byte_hex, ""))

    return pad(HMAC_IPAD), pad(HMAC_OPAD)


def hmac_sha256_hex(message, ipad_key, opad_key) -> Column:
    """FN-10: HMAC-SHA256 of a UTF-8 message given precomputed pads; hex digest."""
    inner = F.unhex(F.sha2(F.concat(_c(ipad_key), utf8(_c(message))), 256))
    return F.sha2(F.concat(_c(opad_key), inner), 256)


def sha256_hex(x) -> Column:
    """FN-11: SHA-256 hex of text (UTF-8) or binary."""
    c = _c(x)
    return F.sha2(c, 256)


# --- FN-08 random keys ----------------------------------------------------------

def random_dek() -> Column:
    """FN-08: 32 random bytes per row from the OS CSPRNG (Arrow-batched).

    Nondeterministic: results must be written and read back before a second
    use, or a retried task would hand out different keys.
    """
    @F.pandas_udf(T.BinaryType())
    def _rand(seed: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(KEY_SIZE) for _ in range(len(seed))])

    return _rand.asNondeterministic()(F.lit(0))


def seeded_dek(user_id, seed_prefix: str = "seed-") -> Column:
    """Test-only deterministic DEK: SHA-256('seed-' || user_id). Never for production."""
    return F.unhex(F.sha2(F.concat(F.lit(seed_prefix), _c(user_id)), 256))
