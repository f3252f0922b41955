"""A provider that lists the keys 1 to `n` in pages of `limit`, by number, offset or cursor."""

from __future__ import annotations

import json


def _keys(options: dict, first: int) -> list[int]:
    return list(range(first, min(int(options["n"]), first + int(options["limit"]) - 1) + 1))


def numbered(options: dict, page: int) -> tuple[str, int]:
    n, limit = int(options["n"]), int(options["limit"])
    return json.dumps({"items": _keys(options, (page - 1) * limit + 1)}), -(-n // limit)


def offset(options: dict, at: int) -> tuple[str, int]:
    return json.dumps({"items": _keys(options, at + 1)}), int(options["n"])


def untold(options: dict, at: int) -> tuple[str | None, None]:
    """By offset, without telling how many there are."""
    keys = _keys(options, at + 1)
    return (json.dumps({"items": keys}) if keys else None), None


def cursor(options: dict, after: str | None) -> tuple[str, str | None]:
    keys = _keys(options, int(after or 0) + 1)
    more = bool(keys) and keys[-1] < int(options["n"])
    return json.dumps({"items": keys}), str(keys[-1]) if more else None
