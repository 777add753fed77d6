"""Edits that take personal data and secrets out of texts, as input of the edit-aware counts."""

from __future__ import annotations

import re

#: Addresses, long numbers and long hexadecimal or key-like strings.
FOUND = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\b[0-9a-fA-F]{16,}\b|\b[A-Z0-9]{16,}\b|\+?\d[\d ().-]{7,}\d")
#: Every match but an address has one of these; looking for them first is quick.
HINT = re.compile(r"\d|[A-Za-f]{16}")
PLACEHOLDER = "<removed>"


def redactions(text: str) -> list[dict]:
    """From the last match to the first, so that places hold."""
    if "@" not in text and not HINT.search(text):
        return []
    return [{"at": m.start(), "remove": m.end() - m.start(), "insert": PLACEHOLDER} for m in FOUND.finditer(text)][::-1]


def first_line(text: str) -> list[dict]:
    """A first line that others follow is dropped."""
    line = text.find("\n") + 1
    return [{"at": 0, "remove": line, "insert": ""}] if line else []
