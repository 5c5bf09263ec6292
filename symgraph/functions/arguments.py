"""Arguments of queries, handled once on the driver: dates, tokens, revisions, cursors."""

from __future__ import annotations

import re

from .domain import STOP_WORDS


def parse_date(text: str) -> int:
    """``YYYY-MM-DD`` as epoch seconds at midnight UTC.

    Month 1-12 and day 1-31 are checked, not the month's length: 2024-02-31 rolls over.
    """
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    y, mo, d = map(int, m.groups())
    if not (1 <= mo <= 12 and 1 <= d <= 31):
        raise ValueError(f"not a date: {text!r}")
    from datetime import date

    return ((date(y, mo, 1) - date(1970, 1, 1)).days + d - 1) * 86_400


def format_date(epoch: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(epoch, UTC).strftime("%Y-%m-%d")


def query_tokens(query: str) -> list[str]:
    """Words of at least three bytes, lower case, without stop words; ``_`` joins."""
    words = re.split(r"[^\w]+", query, flags=re.UNICODE)
    return [w.lower() for w in words if len(w.encode()) >= 3 and w.lower() not in STOP_WORDS]


def search_terms(query: str, most: int = 32) -> list[str]:
    return [w.lower() for w in re.split(r"[\W_]+", query) if w][:most]


def check_revision(base: str) -> str:
    """A revision argument that is safe to hand to a version control tool, or an error."""
    if not base or len(base) > 256 or base.startswith("-") or any(c.isspace() or ord(c) < 32 or ord(c) == 127 for c in base):
        raise ValueError(f"not a revision: {base[:40]!r}")
    return base


def explore_budget(nodes: int) -> int:
    return min(40_000 + 12 * nodes, 64_000)


def encode_cursor(offset: int, generation: int) -> str:
    return f"{offset}.{generation}"


def decode_cursor(cursor: str | None, generation: int) -> tuple[int, str | None]:
    """The offset of a page, and a note where a cursor of another generation starts anew."""
    if not cursor:
        return 0, None
    m = re.fullmatch(r"(\d{1,7})\.(\d+)", cursor)
    if not m or int(m.group(1)) > 1_000_000:
        raise ValueError(f"not a cursor: {cursor!r}")
    if int(m.group(2)) != generation:
        return 0, "the index changed; listing from the start"
    return int(m.group(1)), None


def truncate_at(text: str, budget: int) -> str:
    """At most ``budget`` bytes, cut between characters."""
    return text.encode()[:budget].decode(errors="ignore")


def approximate_tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)
