"""Text rules as plain Python, for folds over a page whose text changes from step to step.

White space, word boundaries and digits are those of the page format's origin: Unicode white space without the ASCII
separators and NEL, ASCII word boundaries and digits.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice
from operator import eq

#: White space of the page format.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = f"[{SPACE}]"
LINE_START = "(?:^|(?<=[\n\r\u2028\u2029]))"
_STRIP = "".join(chr(c) for c in range(0x10000) if re.fullmatch(_S, chr(c)))
_KEPT = re.compile("[^0-9a-z가-힣]+")
_KEEP = re.compile("[0-9a-z가-힣]")
_OTHER_ASCII = bytes(i for i in range(128) if not _KEEP.match(chr(i)))
_ENTITY = re.compile("&([a-z]+);", re.I | re.A)
#: The entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_NUMBERED = re.compile(rf"([0-9]{{1,3}})\){_S}*")


def strip(text: str) -> str:
    return text.strip(_STRIP)


def normalized(text: str | None) -> str:
    """Lower case, and only digits, a to z and Hangul syllables."""
    if not text:
        return ""
    if text.isascii():
        return text.encode().lower().translate(None, _OTHER_ASCII).decode()
    return _KEPT.sub("", text.lower())


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def decode_entities(text: str) -> str:
    return _ENTITY.sub(lambda m: ENTITIES.get(m[1].lower(), m[0]), text)


def _as_units(text: str) -> str:
    """A text whose characters are its UTF-16 units."""
    if text.isascii() or max(text) <= "\uffff":
        return text
    raw = text.encode("utf-16-be", "surrogatepass")
    return "".join(chr(raw[i] << 8 | raw[i + 1]) for i in range(0, len(raw), 2))


def _shared(a: str, b: str) -> int:
    """How many characters two texts begin with that are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _places(text: str) -> dict[str, int]:
    """Of each character the places that it has in a text, as bits."""
    at: dict[str, int] = {}
    if len(text) <= 512:
        for i, c in enumerate(text):
            at[c] = at.get(c, 0) | 1 << i
        return at
    import numpy as np

    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {c: int.from_bytes(np.packbits(x == ord(c), bitorder="little").tobytes(), "little") for c in set(text)}


def distance(a: str, b: str) -> int:
    """Levenshtein distance, in UTF-16 units, of what is left between equal beginnings and ends: by diagonals while it is
    small beside the lengths, else a column of the matrix is one integer of its steps (Myers, Hyyrö)."""
    if a == b:
        return 0
    a, b = _as_units(a), _as_units(b)
    k = _shared(a, b)
    a, b = a[k:], b[k:]
    if k := _shared(a[::-1], b[::-1]):
        a, b = a[:-k], b[:-k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    most = int((len(a) * len(b)) ** 0.5) // 16  # beyond it columns are cheaper, as where the lengths alone are further apart
    if len(a) >= 1000 and len(a) - len(b) <= most:
        import numpy as np

        from foliospark.functions.distance import diagonals

        near = diagonals(*(np.frombuffer(s.encode("utf-16-le", "surrogatepass"), np.uint16) for s in (b, a)), most)
        if near is not None:
            return near
    at = _places(a)
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(flat | up)), up & flat
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        eq |= down
        right = right << 1 | 1
        up, down = (left << 1 | ~(eq | right)) & full, right & eq & full
    return score


def one_apart(a: str, b: str) -> bool:
    """Whether :func:`distance` is one, of a text and one as long or longer by one (in UTF-16 units, as all ASCII texts are)."""
    if a == b or not 0 <= len(b) - len(a) <= 1:
        return False
    k = _shared(a, b)
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance of two texts (in code points) is ``most`` or less: a column of the matrix is one
    integer of its steps (Myers, Hyyrö), and it is given up where what is left of ``b`` cannot make up for it."""
    if a == b:
        return most >= 0
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    at = _places(a)
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, score, slack = full, 0, len(a), most + len(b)
    for j, c in enumerate(b, 1):
        eq = at.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(flat | up)), up & flat
        score += (right >> top & 1) - (left >> top & 1)
        if score + j > slack:
            return False
        eq |= down
        right = (right << 1) | 1
        up, down = ((left << 1) | ~(eq | right)) & full, right & eq & full
    return score <= most


def similarity(a: str, b: str) -> float:
    """One less the distance of the normalised texts over the longer length; 0 if both are empty."""
    a, b = normalized(a), normalized(b)
    longest = max(len(a), len(b))
    return 1 - distance(a, b) / longest if longest else 0.0


def similar(a: str, b: str, least: float) -> bool:
    """Whether two normalised texts have similarity ``least`` or more; their distance is only worked out where neither the
    lengths, below which it cannot be, nor the characters in the same place, beyond which it need not be, decide."""
    longest = max(len(a), len(b))
    if not longest:
        return least <= 0
    if 1 - (longest - min(len(a), len(b))) / longest < least:
        return False
    return 1 - (longest - sum(map(eq, a, b))) / longest >= least or 1 - distance(a, b) / longest >= least


def number_of(text: str) -> int | None:
    """The number of a text that begins with a marker such as ``3)``."""
    m = _NUMBERED.match(strip(text))
    return int(m[1]) if m else None


def place_of(document: str, at: int) -> int:
    """Where in ``document`` the character is that is number ``at`` (from 0) when it is normalised."""
    low = document.lower()
    if len(low) == len(document):  # a character is one in lower case too, so places are the same
        return next(islice(_KEEP.finditer(low), at, None)).start()
    return next(islice((i for i, c in enumerate(document) for _ in normalized(c)), at, None))


def prefix_place(document: str, text: str, size: int = 12) -> int:
    """Where in ``document`` the first ``size`` normalised characters of ``text`` begin; -1 without them."""
    target = start_of(text, size)
    at = -1 if target is None else normalized(document).find(target)
    return at if at < 0 else place_of(document, at)


def start_of(text: str, size: int = 8) -> str | None:
    """The first ``size`` normalised characters; None if there are fewer."""
    start = normalized(text[: 4 * size])[:size]  # what a text begins with is mostly in its beginning
    if len(start) < size and len(text) > 4 * size:
        start = normalized(text)[:size]
    return start if len(start) == size else None


def same_start(a: str, b: str, size: int = 8) -> bool:
    start = start_of(a, size)
    return start is not None and start == start_of(b, size)


_COMPARABLE = [
    (re.compile(r"<!--.*?-->", re.S), " "),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r" \1 "),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r" \1 "),
    (re.compile(r"</(?:td|th)>", re.I), " "),
    (re.compile(r"</tr>", re.I), "\n"),
    (re.compile(r"<[^>]+>"), " "),
    (re.compile(LINE_START + r"[\t ]{0,3}(?:#{1,6}|[-*+]|[0-9]+\.)[\t ]+"), ""),
    (re.compile(r"[*_`~>|]"), " "),
]
_SPACES = re.compile(_S + "+")


def comparable(markdown: str | None) -> str:
    """What of Markdown is compared: no markup, NFKC, no white space."""
    text = decode_entities(markdown or "")
    for pattern, by in _COMPARABLE:
        text = pattern.sub(by, text)
    return _SPACES.sub("", unicodedata.normalize("NFKC", text))


def error_rate(expected: str, actual: str) -> float:
    if not expected:
        return 1.0 if actual else 0.0
    return distance(expected, actual) / units(expected)


def natural_key(name: str, fold: bool = False) -> tuple:
    """Order of names in which runs of digits count as numbers; ``fold``: case and accents do not count."""
    flat = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower()
    parts = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall("[0-9]+|[^0-9]+", flat))
    return (parts,) if fold else (parts, name.swapcase())


def cell_text(html: str) -> str:
    """Text of a table cell: entities first, then tags, which therefore may have been entities."""
    return strip(_SPACES.sub(" ", re.sub("<[^>]+>", " ", decode_entities(html))))


def anchors(text: bytes, width: int, gram: int) -> list[int]:
    """Of each ``width`` bytes the hash of the gram that has the least one, once each; a shorter text has those of its own grams."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    if len(raw) < gram:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(raw, gram)
    words = sum(windows[:, i].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64)) for i in range(gram))
    words ^= words >> np.uint64(29)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    span = min(width, len(raw)) - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(words, span).min(1)
    return np.unique(least).view(np.int64).tolist()
