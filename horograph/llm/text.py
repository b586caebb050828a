"""Words of dirty texts: one form for letter case, spacing, hyphenation, punctuation, markup, character forms and encodings.

A text is cut at ASCII white space and punctuation in its UTF-8 bytes, which is
a table look-up; only tokens not met before are folded one by one, so the costly
steps run once per distinct token.
"""

from __future__ import annotations

import html
import re
import unicodedata

#: A tag begins with its name, so comparisons with < and > are none.
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_HYPHEN_BREAK = re.compile("[-­‐‑][ \t]*[\r\n]+\\s*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
# A lead character of UTF-8 read as a one-byte encoding, with what follows it.
_MOJIBAKE = re.compile("[Â-ô][^\x00-\x7f]{1,3}")
#: ASCII bytes other than digits and letters to a space, capitals to small letters.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _redecode(m: re.Match) -> str:
    s = m.group(0)
    for codec in ("cp1252", "latin-1"):
        for end in range(len(s), 1, -1):
            try:
                return s[:end].encode(codec).decode("utf-8") + s[end:]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return s


def fold(token: str) -> list[str]:
    """The words of one token that holds characters beyond ASCII."""
    t = unicodedata.normalize("NFKC", _MOJIBAKE.sub(_redecode, _INVISIBLE.sub("", token)))
    return _WORD.findall(t.casefold())


def prepare(text: str) -> str:
    """Markup and hyphenation removed; the rest is done token by token."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "-\r" in text or "- \n" in text or "- \r" in text or "­" in text or "‐" in text or "‑" in text:
        text = _HYPHEN_BREAK.sub("", text)
    return text


def tokens(text: str) -> list[bytes]:
    return prepare(text).encode("utf-8", "surrogatepass").translate(_BYTES).split()


def words(text: str) -> list[str]:
    out: list[str] = []
    for t in tokens(text):
        if t.isascii():
            out.append(t.decode())
        else:
            out += fold(t.decode("utf-8", "surrogatepass"))
    return out


class WordIds(dict):
    """Token bytes to word ids; unknown words are 0.

    Tokens that fold to no word or to several get a negative number, the
    complement of an index into ``several``.
    """

    LIMIT = 1_000_000

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__((w.encode(), i) for w, i in vocabulary.items())
        self.vocabulary, self.several = vocabulary, []

    def __missing__(self, token: bytes) -> int:
        if token.isascii():
            return 0
        ids = [self.vocabulary.get(w, 0) for w in fold(token.decode("utf-8", "surrogatepass"))]
        if len(ids) == 1:
            value = ids[0]
        else:
            self.several.append(ids)
            value = -len(self.several)
        if len(self) < self.LIMIT:
            self[token] = value
        return value

    def of(self, text: str) -> list[int]:
        found = list(map(self.__getitem__, tokens(text)))
        if found and min(found) < 0:
            flat: list[int] = []
            for i in found:
                if i < 0:
                    flat += self.several[-i - 1]
                else:
                    flat.append(i)
            if len(self.several) > self.LIMIT:
                self.several.clear()
                for k in [k for k, v in self.items() if v < 0]:
                    del self[k]
            return flat
        return found
