"""Transforms from DataFrame to DataFrame; the same ones serve batch and stream."""

from tidings.operators.campaigns import (
    active_at,
    dead_letters,
    decode_campaigns,
    incomplete,
    is_active,
    message_text,
    sendable,
    stamp,
)
from tidings.operators.fanout import fan_out, fan_out_split, to_notifications
from tidings.operators.favourites import dedupe_favourites, of_restaurants
from tidings.operators.output import to_messages, with_feedback

__all__ = [
    "active_at",
    "dead_letters",
    "decode_campaigns",
    "dedupe_favourites",
    "fan_out",
    "fan_out_split",
    "incomplete",
    "is_active",
    "message_text",
    "of_restaurants",
    "sendable",
    "stamp",
    "to_messages",
    "to_notifications",
    "with_feedback",
]
