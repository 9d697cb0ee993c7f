"""Languages of documents and of the lines in them that are written in another one.

A line is a set of its 1-, 2- and 3-grams of letters (a blended spectrum, presence only); the kernel of two lines is the
size of what they share over the root of their sizes' product. Kernel ridge regression, one language against the
rest, is fitted on labelled lines through Nystrom landmarks; as the kernel is linear in the presence vector, the
landmarks' weights fold into one matrix, and batches of lines are scored by one matrix product.

Labels are noisy, so lines that a first fit puts elsewhere are left out of the second. Bulgarian in Latin letters is learnt
from Bulgarian lines spelt in the usual Latin ways. Confidences are calibrated on held-out lines cut to all lengths.

Letters beyond U+2FFF (Chinese, Japanese, Korean) are of none of these languages: they count for none, and a text of them alone has no
words here.

Defined results: null texts and texts without words give no rows; a null or unknown label is a missing one; ties go to the
language that comes first in ``LANGUAGES``; a doc_id that repeats with the same text gives its rows once; texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.llm.text import CYR_TO_LAT, calibrate

LANGUAGES = ["bg", "en", "ru", "mk", "de", "fr", "tr", "es"]
# Usual names and codes of the languages, lower case.
LABELS = {
    "bg": ["bg", "bul", "bulgarian", "български", "болгарский", "bulgarisch", "bulgare", "bulgarca", "búlgaro", "бугарски"],
    "en": ["en", "eng", "english", "английски", "английский", "englisch", "anglais", "ingilizce", "inglés", "англиски"],
    "ru": ["ru", "rus", "russian", "руски", "русский", "russisch", "russe", "rusça", "ruso"],
    "mk": ["mk", "mkd", "mac", "macedonian", "македонски", "македонский", "mazedonisch", "macédonien", "makedonca", "macedonio"],
    "de": ["de", "deu", "ger", "german", "немски", "немецкий", "deutsch", "allemand", "almanca", "alemán", "германски"],
    "fr": ["fr", "fra", "fre", "french", "френски", "французский", "französisch", "français", "fransızca", "francés", "француски"],
    "tr": ["tr", "tur", "turkish", "турски", "турецкий", "türkisch", "turc", "türkçe", "turco"],
    "es": ["es", "spa", "spanish", "испански", "испанский", "spanisch", "espagnol", "ispanyolca", "español", "шпански"],
}
# Ways in which Bulgarian is spelt in Latin letters, besides the public transliteration.
STYLES = [
    {},
    {"ш": "6", "щ": "6t", "ч": "4", "я": "q", "ъ": "y", "ж": "j", "ц": "c", "ю": "iu"},
    {"ш": "sh", "щ": "sht", "ч": "ch", "я": "ia", "ъ": "u", "ж": "j", "ц": "c", "ю": "iu", "й": "i"},
    {"ш": "6", "щ": "6t", "ч": "4", "я": "ya", "ъ": "a", "ж": "zh", "ц": "ts", "ю": "yu", "в": "v"},
    {"я": "q", "ъ": "u", "ж": "j", "ц": "c", "ю": "iu", "щ": "sht", "в": "w"},
]
_BY_NAME = {name: code for code, names in LABELS.items() for name in names}
_QUOTED = re.compile(r"„[^„“”\n]{1,120}[“”]|“[^“”\n]{1,120}”|«[^«»\n]{1,120}»|\"[^\"\n]{1,120}\"")
_MARKS, _BARE = re.compile("[„“«\"]"), re.compile(r"(?m)^[\s\W]*$")
_CYR = re.compile("[а-яѐ-џ]")


def known_label(label: str | None) -> str | None:
    """The language a label names, in any usual form (code, region, name); None if it names none."""
    s = (label or "").strip().lower()
    return _BY_NAME.get(s) or _BY_NAME.get(re.split(r"[-_ (]", s)[0]) if s else None


def latinized(line: str, style: int) -> str:
    """A Bulgarian line in Latin letters."""
    t = {**CYR_TO_LAT, **STYLES[style]}
    return "".join(t.get(c, c) for c in line.lower())


class Grams:
    """Presence of hashed n-grams, line by line, for a batch of texts at once."""

    def __init__(self, size: int = 8192, orders: tuple[int, ...] = (1, 2, 3)):
        self.size, self.orders, self.bits = size, orders, size.bit_length() - 1
        keep = np.zeros(0x3000, dtype=np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            if ch.isalpha():
                keep[c] = c
        for c in range(ord("0"), ord("9") + 1):
            keep[c] = c
        keep[10] = 10
        self.keep = keep

    def codes(self, text: str) -> np.ndarray:
        """Code points with all but letters, digits in words and line feeds as 0, runs of 0 as one."""
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        a = self.keep[np.minimum(a, 0x2FFF)]
        # digits count only beside letters, where they stand for letters
        at = np.flatnonzero((a >= 48) & (a <= 57))
        if len(at):
            before, after = a[np.maximum(at - 1, 0)], a[np.minimum(at + 1, len(a) - 1)]
            a[at[(before < 58) & (after < 58)]] = 0
        if len(a):
            keep = a != 0
            keep[1:] |= a[:-1] != 0
            a = a[keep]
        return a

    def presence(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines x size presence matrix, letters of each line) of the codes of a text."""
        feed = a == 10
        line = np.cumsum(feed, dtype=np.int32) - feed
        n = int(feed.sum()) + 1
        m = np.zeros((n, self.size), dtype=np.float32)
        flat = m.ravel()
        a = np.where(feed, np.uint32(0), a)
        base = line * np.int32(self.size)
        h = a.copy()
        for k in self.orders:
            if len(a) < k:
                break
            if k > 1:
                h = h[:-1] * np.uint32(0x9E3779B1) + a[k - 1 :]
            g = (h * np.uint32(0x85EBCA6B) + np.uint32(k)) >> np.uint32(32 - self.bits)
            if k == 1:
                flat[(base + g.view(np.int32))[a != 0]] = 1
            else:
                flat[(base[: len(g)] + g.view(np.int32))[line[: len(g)] == line[k - 1 :]]] = 1
        return m, np.bincount(line[a > 57], minlength=n)


class LanguageModel:
    """Weights of all languages by n-gram, folded out of landmarks."""

    def __init__(self, grams: Grams, weights: np.ndarray, curve: tuple[float, float] = (1.0, 0.0)):
        self.grams, self.weights, self.curve = grams, weights, curve

    def confidence(self, margin: float, letters: float) -> float:
        """How sure a margin over ``letters`` letters is, by the curve fitted to held-out lines."""
        z = self.curve[0] * margin * np.sqrt(letters) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def scores(self, text: str, lines_a_batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(lines x languages scores, letters of each line)."""
        g = self.grams
        a = g.codes(text)
        ends = np.flatnonzero(a == 10)
        out, letters, start = [], [], 0
        for cut in [*ends[lines_a_batch - 1 :: lines_a_batch], len(a)]:
            m, n = g.presence(a[start:cut])
            size = np.maximum(m.sum(1), 1)
            out.append((m @ self.weights) / np.sqrt(size)[:, None])
            letters.append(n)
            start = cut + 1
        return np.concatenate(out), np.concatenate(letters)


def fit(lines: list[str], labels: list[int], landmarks: int = 800, ridge: float = 0.1, seed: int = 3, grams: Grams | None = None, balanced: bool = True) -> LanguageModel:
    """Nystrom kernel ridge regression, one against the rest; each language weighs alike if ``balanced``, else each line."""
    g = grams or Grams()
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    codes = [g.codes(x.replace("\n", " ")) for x in lines]

    def matrix(idx) -> np.ndarray:
        m, _ = g.presence(np.concatenate([np.r_[codes[i], np.uint32(10)] for i in idx])[:-1])
        return m / np.sqrt(np.maximum(m.sum(1), 1))[:, None]

    pick = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: max(1, landmarks // len(LANGUAGES))] for k in np.unique(y)])
    land = matrix(pick)
    kmm = land @ land.T
    val, vec = np.linalg.eigh(kmm.astype(np.float64))
    ok = val > 1e-6 * val.max()
    half = vec[:, ok] / np.sqrt(val[ok])
    phi = np.concatenate([(matrix(range(s, min(s + 256, len(codes)))) @ land.T) @ half for s in range(0, len(codes), 256)])
    keep = np.ones(len(y), dtype=bool)
    def solve(w: np.ndarray) -> np.ndarray:
        target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0 / (len(LANGUAGES) - 1))
        a = phi.T @ (phi * w[:, None]) + ridge * w.sum() / len(y) * np.eye(phi.shape[1])
        return np.linalg.solve(a, phi.T @ (target * w[:, None]))

    if balanced:
        share = np.bincount(y, minlength=len(LANGUAGES))
        beta = solve(len(y) / np.maximum(share[y], 1))
    else:
        beta = solve(np.ones(len(y)))
    return LanguageModel(g, (land.T @ (half @ beta)).astype(np.float32))


def train(sample: list[tuple[str, str]], first: int = 6000, a_language: int = 1200, seed: int = 4) -> LanguageModel | None:
    """A model of labelled (text, label): a first one of ``first`` lines as they come, in whose proportions wrong labels are
    outvoted, picks the lines whose label it shares; the model is fitted to at most ``a_language`` of these for each language.
    """
    rng = np.random.default_rng(seed)
    lines, labels = [], []
    for text, label in sample:
        code = known_label(label)
        if code:
            own = [x for x in plain(text).split("\n") if sum(map(str.isalpha, x)) >= 12]
            lines += own
            labels += [LANGUAGES.index(code)] * len(own)
    if not lines:
        return None
    y = np.array(labels)
    bg = [i for i in np.flatnonzero(y == 0) if _CYR.search(lines[i].lower())]
    spelt = lambda i: latinized(lines[i], int(rng.integers(len(STYLES))))
    pick = rng.permutation(len(lines))[:first]
    some = [spelt(bg[i]) for i in rng.permutation(len(bg))[: first // 8]]
    rough = fit([lines[i] for i in pick] + some, [*y[pick], *[0] * len(some)], balanced=False)
    s, _ = rough.scores("\n".join(x.lower() for x in lines))
    agreed = np.flatnonzero(s.argmax(1) == y)
    chosen = np.concatenate([rng.permutation(agreed[y[agreed] == k])[:a_language] for k in range(len(LANGUAGES))])
    bg = [i for i in agreed[y[agreed] == 0] if _CYR.search(lines[i].lower())]
    some = [spelt(bg[i]) for i in rng.permutation(len(bg))[:a_language]]
    # a tenth of the lines picked is held out; cut to any number of words they tell how far a margin can be trusted
    chosen = rng.permutation(chosen)
    held, chosen = chosen[: len(chosen) // 10], chosen[len(chosen) // 10 :]
    model = fit([lines[i] for i in chosen] + some, [*y[chosen], *[0] * len(some)])
    model.curve = trust(model, [lines[i] for i in held], y[held], rng)
    return model


def trust(model: LanguageModel, lines: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """The logistic curve from margin times root of letters to the share of right answers, on stretches of held-out lines."""
    parts, want = [], []
    for line, k in zip(lines, labels):
        ws = line.replace("\n", " ").split()
        for n in (1, 2, 4, 8):
            if len(ws) >= n:
                at = int(rng.integers(len(ws) - n + 1))
                parts.append(" ".join(ws[at : at + n]).lower())
                want.append(k)
    if not parts:
        return 1.0, 0.0
    s, letters = model.scores("\n".join(parts))
    top = np.sort(s, axis=1)
    use = letters > 0
    z, right = ((top[:, -1] - top[:, -2]) * np.sqrt(letters))[use], (s.argmax(1) == np.array(want))[use]
    return calibrate(z, right.astype(float)) if len(z) >= 20 and 0 < right.sum() < len(z) else (1.0, 0.0)


def plain(text: str) -> str:
    """A text without quoted names; a line that is nothing but a quotation keeps it."""
    if not _MARKS.search(text):
        return text
    out = _QUOTED.sub(" ", text)
    if _BARE.search(out):
        out = "\n".join(new if any(c.isalpha() for c in new) else old for old, new in zip(text.split("\n"), out.split("\n")))
    return out


def judge(model: LanguageModel, texts: list[str], slack: float = 2.4, short: int = 22) -> list[tuple[int, float, list[tuple[int, int, float]]] | None]:
    """For each text (language, confidence, [(line, language, confidence)] of lines in another one), or None for one without words.

    A line is taken out of its document's language only by a margin that shrinks with the root of its length; below ``short``
    letters, which a single name can fill, the margin asked grows by as much as letters are missing.
    """
    clean = [plain(t).lower() for t in texts]
    scores, counts = model.scores("\n".join(clean))
    out, start = [], 0
    own_all = scores.argmax(1)
    for t in clean:
        end = start + t.count("\n") + 1
        s, letters, own = scores[start:end], counts[start:end], own_all[start:end]
        start = end
        if letters.max(initial=0) < 2:
            out.append(None)
            continue
        votes = np.bincount(own, weights=letters, minlength=s.shape[1])
        total = letters @ s / letters.sum()
        lang = int(np.lexsort((-total, -votes))[0])
        other = np.flatnonzero((own != lang) & (letters > 0))
        margin = s[other, own[other]] - s[other, lang]
        z = margin * np.sqrt(letters[other]) / slack * np.minimum(1.0, letters[other] / short)
        found = [(int(i) + 1, int(own[i]), model.confidence(m, letters[i])) for i, m, v in zip(other, margin, z) if v > 1]
        rival = max(total[k] for k in range(len(total)) if k != lang)
        out.append((lang, model.confidence(total[lang] - rival, letters.sum()), found))
    return out


def fit_model(docs: DataFrame, fit_docs: int = 6000, fit_lines: int = 40, text: str = "text", label: str = "lang") -> LanguageModel:
    """A model of at most ``fit_docs`` labelled documents, drawn evenly over the table, and at most ``fit_lines`` whole lines of each,
    drawn from anywhere in its text."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.trim(F.col(label)) != "")).select(F.col(text).alias("text"), F.col(label).alias("label"))
    n = max(1, labelled.count())
    draw = F.pmod(F.xxhash64("text", "label", F.lit(9)), F.lit(1_000_000))
    some = labelled.filter(draw < int(1_100_000 * fit_docs / n)) if n > fit_docs else labelled
    lines = F.split("text", "\n", -1)
    picked = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.struct(F.xxhash64("text", i).alias("h"), i.alias("i")))), 1, fit_lines)
    rows = some.withColumn("h", draw).select("h", "label", F.array_join(F.transform(F.array_sort(F.transform(picked, lambda x: x["i"])), lambda i: F.get(lines, i)), "\n").alias("text")).orderBy("h", "text").limit(fit_docs).collect()
    return train([(r.text, r.label) for r in rows]) or LanguageModel(Grams(), np.zeros((Grams().size, len(LANGUAGES)), dtype=np.float32))


def languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", fit_docs: int = 6000) -> DataFrame:
    """(doc_id, line_no, lang, confidence, labelled): line 0 is the document, other lines are those in another language;
    labelled is what the document's label names."""
    model = fit_model(docs, fit_docs, text=text, label=label)

    def read(batches):
        for pdf in batches:
            rows = []
            for s in range(0, len(pdf), 200):
                part = pdf.iloc[s : s + 200]
                for i, lab, got in zip(part["doc_id"], part["label"], judge(model, part["text"].tolist())):
                    if got:
                        named = known_label(lab)
                        rows.append((i, 0, LANGUAGES[got[0]], got[1], named))
                        rows += [(i, n, LANGUAGES[k], c, named) for n, k, c in got[2]]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "lang", "confidence", "labelled"]).astype({"doc_id": "int64", "line_no": "int32"})

    src = docs.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"))
    return src.mapInPandas(read, "doc_id long, line_no int, lang string, confidence double, labelled string").distinct()


def found_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): documents whose label is missing or wrong, and lines in another language."""
    out = languages(docs)
    return out.filter("line_no > 0 or labelled is null or labelled != lang").select("doc_id", "line_no", "lang").distinct()
