"""A provider over pages landed from the events table: newest first, by time, by offset, by cursor."""

import json
import os

from mergewell.sources.paged import ProviderError

SIZE = 40


def _rows(options):
    with open(os.path.join(options["folder"], "events.json")) as f:
        return json.load(f)  # (second, id), ascending


def _log(options, *what):
    with open(os.path.join(options["folder"], "calls"), "a") as f:
        f.write(json.dumps(what) + "\n")


def newest(options):
    with open(os.path.join(options["folder"], "now")) as f:
        return int(f.read())


def by_time(options, page):
    """Scrobbles up to `to`, newest first, those from `from` on if it is given."""
    _log(options, page, options.get("from"), options["to"])
    if os.path.exists(os.path.join(options["folder"], "down")):
        raise ProviderError(404, "gone")
    rows = [r for r in _rows(options) if int(options.get("from") or 0) <= r[0] <= int(options["to"])][::-1]
    return json.dumps(rows[(page - 1) * SIZE : page * SIZE]), max(1, -(-len(rows) // SIZE))


def by_offset(options, at):
    rows = _rows(options)
    return json.dumps(rows[at : at + int(options["limit"])]), len(rows)


def by_cursor(options, at):
    rows = _rows(options)
    start = int(at or 0)
    after = start + SIZE
    return json.dumps(rows[start:after]), str(after) if after <= len(rows) else None


def last_cursor(options):
    """The cursor behind the last full page."""
    return str(newest(options) // SIZE * SIZE)
