"""Canonical words of texts in Python, as the column functions of ``text`` give them, for work on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from ..constants import CJK_STOP_FLAGS, STEMS, SYNONYMS

TOKEN = "[A-Za-z0-9]+|[一-鿿]+"
#: Cuts a run of CJK characters into words, or into (word, part of speech) pairs.
Segment = Callable[[str], Iterable]

_TOKEN = re.compile(TOKEN)
_FIRST = {w: line[0] for line in SYNONYMS for w in line}
_ENDINGS = [(re.compile(f"(?:{e})$"), left) for e, left in STEMS]
_ENDED = re.compile(f"(?:{'|'.join(e for e, _ in STEMS)})$")
#: Words whose canonical form a worker keeps; then the table is emptied.
_MOST_KNOWN = 200_000


def canonical(word: str) -> str:
    """As ``text.canonical_token``."""
    word = word.lower()
    if word in _FIRST or not word.isascii():
        return _FIRST.get(word, word)
    if len(word) > 3 and _ENDED.search(word):  # few words end so: one search for the others
        word = next((cut for e, left in _ENDINGS if e.search(word) and len(cut := e.sub(left, word)) >= 3), word)
    return _FIRST.get(word, word)


def pairs(run: str) -> list[str]:
    """The default segmentation: neighbouring characters two by two."""
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


def _segmented(run: str, segment: Segment) -> list[str]:
    """Words of a CJK run; single characters of a part of speech without content go."""
    out = []
    for x in segment(run):
        word, flag = (x, None) if isinstance(x, str) else x
        if flag not in CJK_STOP_FLAGS or len(word) > 1:
            out.append(word)
    return out


class Known(dict):
    """The canonical words that each token stands for: none for single ASCII characters, several for a CJK run."""

    def __init__(self, segment: Segment = pairs) -> None:
        super().__init__()
        self.segment = segment

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > _MOST_KNOWN:
            self.clear()
        if token.isascii():
            word = canonical(token)
            found = (word,) if len(word) > 1 else ()
        else:
            found = tuple(_segmented(token, self.segment))
        self[token] = found
        return found


def canonical_words(text: str | None, known: Known) -> list[str]:
    """All canonical words in order."""
    return [w for words in map(known.__getitem__, _TOKEN.findall(text)) for w in words] if text else []
