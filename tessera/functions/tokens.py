"""Random tokens and salts, made on the driver: they differ at each call, so they are no Columns."""

from __future__ import annotations

import base64
import secrets


def unique_token(size: int = 16) -> str:
    """A URL-safe random token of `size` bytes."""
    return secrets.token_urlsafe(size)


def salt(size: int = 16) -> str:
    """A random salt in base64url, for salted_hash()."""
    return base64.urlsafe_b64encode(secrets.token_bytes(size)).decode()


def salt_bytes(text: str) -> bytes:
    return base64.urlsafe_b64decode(text)
