"""Page tokens, percent encoding and list encoding. These are driver-side texts of bounded size, never columns."""

from __future__ import annotations

import re

from cairn.functions.errors import InvalidArgument

MAX_TOKEN_BYTES = 1024
_PLAIN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.:")


def percent_encode(text: str) -> str:
    return "".join(chr(b) if b in _PLAIN else f"%{b:02x}" for b in text.encode())


def percent_decode(text: str) -> str:
    if re.search(r"%(?![0-9a-fA-F]{2})", text) or re.search(r"[^A-Za-z0-9\-_.:%]", text):
        raise InvalidArgument("malformed percent encoding")
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()


def encode_list(items: list[str]) -> str:
    return "|".join(percent_encode(x) for x in items)


def decode_list(text: str) -> list[str]:
    return [percent_decode(x) for x in text.split("|")] if text else []


def encode_token(scope: str, filters: str, created: int, row_id: str) -> str:
    """The place after the last row that a page returned, bound to the scope and the filters it was made with."""
    token = f"v1|{scope}|{percent_encode(filters)}|{created}|{percent_encode(row_id)}"
    if len(token.encode()) > MAX_TOKEN_BYTES:
        raise InvalidArgument("the page token is too long")
    return token


def decode_token(token: str, scope: str, filters: str) -> tuple[int, str]:
    parts = token.split("|")
    if len(token.encode()) > MAX_TOKEN_BYTES or len(parts) != 5 or parts[0] != "v1" or not re.fullmatch(r"-?\d+", parts[3]):
        raise InvalidArgument("malformed page token")
    if parts[1] != scope or percent_decode(parts[2]) != filters:
        raise InvalidArgument("the page token belongs to another request")
    return int(parts[3]), percent_decode(parts[4])
