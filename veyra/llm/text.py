"""Folding of Bulgarian and English names to forms that can be compared: lookalikes, scripts, edits."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# The public transliteration of Bulgarian, and Latin letters that look like Cyrillic ones.
CYR_TO_LAT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
    "ё": "yo", "ы": "y", "э": "e", "ѝ": "i", "ј": "j", "љ": "lj", "њ": "nj", "ѓ": "gj", "ќ": "kj", "џ": "dzh", "ѕ": "dz",
}
LOOKALIKES = str.maketrans("aeopcyxkmhtbiu", "аеорсухкмнтвиу")
CYR = re.compile("[Ѐ-ӿ]")
LAT = re.compile("[a-z]")
TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


@lru_cache(maxsize=100_000)
def unmix(token: str) -> str:
    """A lower-case token that mixes scripts, with its Latin lookalikes made Cyrillic."""
    return token.translate(LOOKALIKES) if CYR.search(token) and LAT.search(token) else token


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case, lookalikes undone."""
    return [unmix(t) for t in TOKEN.findall((text or "").lower())]


@lru_cache(maxsize=100_000)
def latin(token: str) -> str:
    return "".join(CYR_TO_LAT.get(c, c) for c in token)


# Latin spellings of Cyrillic letters, longest first, and letters that spellings confuse.
LAT_TO_CYR = (("sht", "щ"), ("tsh", "ч"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("tz", "ц"), ("kh", "х"), ("yu", "ю"), ("ju", "ю"), ("iu", "ю"), ("ya", "я"), ("ja", "я"), ("ia", "я"), ("yo", "йо"), ("x", "кс"))
LAT_LETTERS = str.maketrans("abcdefghijklmnopqrstuvwyz", "абцдефгхижклмнопярстуввиз")
FOLDED = str.maketrans({"ъ": "а", "й": "и", "ь": "и", "ё": "е", "ѝ": "и", "ы": "и", "э": "е"})


@lru_cache(maxsize=200_000)
def skeleton(token: str) -> str:
    """One letter for one sound, Cyrillic, so that Latin and Cyrillic spellings of a word mostly agree."""
    t = token
    if LAT.search(t):
        for a, b in LAT_TO_CYR:
            t = t.replace(a, b)
        t = t.translate(LAT_LETTERS)
    return t.translate(FOLDED)


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words (insert, delete, replace, swap of neighbours), or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (ca != cb))
            if before is not None and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(n: int) -> int:
    """Edits at which two words of this length still count as one."""
    return 0 if n < 4 else 1 if n < 9 else 2


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and all it becomes when up to ``most`` letters are left out."""
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def calibrate(scores: np.ndarray, match: np.ndarray) -> tuple[float, float]:
    """Weights of a logistic curve from score to confidence, by Newton's method with a slight pull to zero."""
    x = np.stack([scores, np.ones_like(scores)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - match) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
