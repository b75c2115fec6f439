"""Terms of texts: maximal runs of ASCII letters, digits and non-ASCII characters, with only A-Z lower-cased."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes of text that are split at once.
_PIECE = 4 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists; a long text is cut between terms, so memory follows a piece."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while len(plain) - at > _PIECE:
        cut = plain.find(b" ", at + _PIECE)
        end = cut if cut >= 0 else len(plain)
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def counted(text: str | None, wanted: frozenset[bytes] | None = None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each occurs; with `wanted` only those of them are kept."""
    n, out = 0, Counter()
    for terms in term_lists(text):
        n += len(terms)
        counts = Counter(terms)
        if wanted is None:
            out.update(counts)
        else:
            for term in wanted & counts.keys():
                out[term] += counts[term]
    return n, out
