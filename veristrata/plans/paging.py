"""Signed keyset cursors and page assembly (driver side: one page is at most 101 rows)."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from .algebra import Plan, Refused


def encode_cursor(plan: Plan, manifest: str, last: tuple, secret: bytes) -> str:
    """Unpadded base64url of a canonical payload and its HMAC-SHA-256, bound to release and plan."""
    if len(secret) < 32:
        raise ValueError("the secret is too short")
    body = json.dumps({"last": [str(v) for v in last], "manifest": manifest, "plan": plan.identity(), "release": plan.release, "v": 1}, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(body + hmac.new(secret, body, hashlib.sha256).digest()).rstrip(b"=").decode()


def decode_cursor(token: str, plan: Plan, manifest: str, secret: bytes) -> tuple[str, ...]:
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except ValueError as e:
        raise Refused("invalid_cursor") from e
    body, sign = raw[:-32], raw[-32:]
    if not hmac.compare_digest(hmac.new(secret, body, hashlib.sha256).digest(), sign):
        raise Refused("invalid_cursor")
    payload = json.loads(body)
    if (payload["manifest"], payload["plan"], payload["release"]) != (manifest, plan.identity(), plan.release):
        raise Refused("cursor_plan_mismatch")
    return tuple(payload["last"])


def page(rows: list, keys: tuple[str, ...], limit: int, total: int) -> dict:
    """Page of at most ``limit`` rows out of ``limit + 1``, with the position of the next."""
    shown, more = rows[:limit], len(rows) > limit
    order = [tuple(r[k] for k in keys) for r in shown]
    if order != sorted(set(order)):
        raise ValueError("the page is not in strict key order")
    return {"rows": shown, "has_more": more, "total": total, "next": order[-1] if more else None}
