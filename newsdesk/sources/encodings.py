"""Text of payloads that come as bytes, by their byte order mark, their shape, or what they declare."""

from __future__ import annotations

import codecs
import re

NO_CONTENT = "nothing landed"

# Byte order marks, longest first, and the first characters of XML in wide encodings without one.
MARKS = (
    (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"),
    (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"),
)
SHAPES = ((b"\x00\x00\x00<", "utf-32-be"), (b"<\x00\x00\x00", "utf-32-le"), (b"\x00<", "utf-16-be"), (b"<\x00", "utf-16-le"))
DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""")
# On the web these names mean windows-1252, whose five free places are control characters.
WESTERN = ("ascii", "iso8859-1", "cp1252")
WINDOWS = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}


def encoding_of(content: bytes) -> tuple[str, int]:
    """Name of the encoding, and the length of the mark before the text."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name, len(mark)
    for start, name in SHAPES:
        if content.startswith(start):
            return name, 0
    declared = DECLARED.match(content[:1024])
    name = declared[1].decode("ascii") if declared else "utf-8"
    # A declaration that could be read byte by byte is not in a wide encoding, whatever it says.
    return ("utf-8" if name.lower().startswith(("utf-16", "utf-32", "ucs-")) else name), 0


def payload_text(content: bytes | None) -> tuple[str | None, str | None]:
    """The text of a payload, or why there is none; bytes that fit no character become U+FFFD."""
    if not content or not content.strip():
        return None, NO_CONTENT
    name, skipped = encoding_of(content)
    try:
        known = codecs.lookup(name).name
        if known in WESTERN:
            return content[skipped:].decode("latin-1").translate(WINDOWS), None
        return content[skipped:].decode(known, "replace"), None
    except (LookupError, UnicodeError):
        return None, f"unknown encoding: {name}"
