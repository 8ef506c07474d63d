"""Oracle SQL helpers: fixture CTEs shared with the Spark side."""

from __future__ import annotations

from shredline.sources.fixtures import fixture_sql


def with_fixtures(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = [f"{n} AS ({fixture_sql(n)})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body


def duck_hmac_pad(key_blob: str, pad: int) -> str:
    """DuckDB expression: HMAC pad (key XOR pad byte, zero-padded to 64 bytes) as a blob."""
    kh = f"rpad(hex({key_blob}), 128, '0')"
    return (f"unhex(array_to_string(list_transform(range(0, 64), lambda i: "
            f"printf('%02x', xor(('0x' || substr({kh}, 2 * i + 1, 2))::INTEGER, {pad}))), ''))")


def duck_hmac(key_blob: str, message: str) -> str:
    """DuckDB expression: hex HMAC-SHA256 of a text message under a blob key."""
    inner = f"unhex(sha256({duck_hmac_pad(key_blob, 0x36)} || encode({message})))"
    return f"sha256({duck_hmac_pad(key_blob, 0x5C)} || {inner})"


def duck_iso(ts: str) -> str:
    """DuckDB twin of util.iso: ISO-8601 with milliseconds and Z."""
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
