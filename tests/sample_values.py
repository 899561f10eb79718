"""Values that several tests write down. Not in conftest, whose name another folder has too."""

from datetime import datetime


def at(text: str) -> datetime:
    """`2026-06-08 10:00` and longer forms as a naive UTC time."""
    return datetime.fromisoformat(text)


def dim(name, kind="string", required=False, deprecated=False):
    return (name, name, "", kind, required, deprecated)
