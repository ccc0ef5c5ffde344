"""Languages of documents and of their segments: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its words' hashed character sequences; a linear layer and a softmax give the
languages. Both layers are trained together by stochastic gradient descent in numpy, on the driver, on the small table of
clean samples (at most MOST_SAMPLES of them). Mean and layer being linear, what a word adds to each language is one
vector, which workers look up or make once. Confidences are calibrated by a temperature fitted to held-out samples, and
a text whose calibrated confidence stays below a bound is rejected.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.speech import spoken_cues

MOST_SAMPLES = 20_000
BUCKETS = 1 << 15
WORD = re.compile(r"[^\W\d_]+")
# Names of languages in labels, by two-letter code (ISO 639).
NAMES = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский",
}
_CODES = {n: c for c, names in NAMES.items() for n in names.split()}


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label in any notation, with or without a region; null if it names no language known here."""
    first = re.split(r"[-_ (]", (label or "").strip().lower(), maxsplit=1)[0]
    return _CODES.get(first) or _CODES.get((label or "").strip().lower())


def grams(word: str) -> list[int]:
    w = f"<{word}>"
    out = [zlib.crc32(w.encode()) % BUCKETS]
    for n in (2, 3, 4):
        out += [zlib.crc32(w[i : i + n].encode()) % BUCKETS for i in range(len(w) - n + 1)]
    return out


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, scale: float):
        self.languages, self.table, self.bias, self.scale = languages, table, bias, scale
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.values = np.zeros((1 << 12, len(self.languages) + 1), np.float32)

    def _row(self, w: str) -> int:
        """Row of a word in the table of what each word adds: its sequences' logits, and how many they are."""
        i = self.rows[w] = len(self.rows)
        if i == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        g = grams(w)
        self.values[i, :-1] = self.table[g].sum(axis=0)
        self.values[i, -1] = len(g)
        return i

    def log_probabilities(self, lines: list[str]) -> np.ndarray:
        """Calibrated log probability of each language for each line; short lines count for less, lines without words for
        nothing."""
        if len(self.rows) > 400_000:
            self._reset()
        get, ids, sizes = self.rows.get, [], []
        for line in lines:
            words = WORD.findall(line.lower())
            for w in words:
                i = get(w)
                ids.append(self._row(w) if i is None else i)
            sizes.append(len(words))
        n = np.array(sizes)
        z = np.zeros((len(lines), len(self.languages)), np.float32)
        if ids:
            full = n > 0
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            total = np.add.reduceat(self.values[np.array(ids)], starts, axis=0)
            weight = np.minimum(1, np.array([len(x) for x, k in zip(lines, sizes, strict=True) if k]) / 12)
            z[full] = (total[:, :-1] / total[:, -1:] + self.bias) * self.scale * weight[:, None]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# Russian letters in Latin ones, as typed by people.
ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y ' e yu ya".split(" "), strict=True))
_ROMAN = str.maketrans(ROMAN | {k.upper(): v.capitalize() for k, v in ROMAN.items()})


def unadorned(text: str) -> str:
    """How a text is typed where its letters are missing: without accents, Russian in Latin letters."""
    text = text.translate(_ROMAN)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def train(samples: list[tuple[str, str]], dim: int = 16, epochs: int = 24, rate: float = 0.6, seed: int = 11) -> LanguageModel:
    """A model of (language, text) samples. A fifth is held out to fit the temperature, then learnt too."""
    languages = sorted({x for x, _ in samples})
    rng = np.random.default_rng(seed)
    parts = [(lang, part) for lang, text in samples for part in re.split(r"(?<=[.!?…])\s+", text) + [text]]
    parts += [(lang, other) for lang, part in parts if (other := unadorned(part)) != part]
    rows = [(languages.index(lang), words) for lang, part in parts if (words := WORD.findall(part.lower()))]
    ids = [np.array([g for w in words for g in grams(w)]) for _, words in rows]
    y = np.array([i for i, _ in rows])

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = rng.normal(0, 0.1, (BUCKETS, dim))
        w = np.zeros((dim, len(languages)))
        b = np.zeros(len(languages))
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            for i in rng.permutation(keep):
                g = ids[i]
                # a word or two missing now and then, so that no single one decides
                if len(g) > 30 and rng.random() < 0.5:
                    g = rng.choice(g, size=len(g) // 2, replace=False)
                h = e[g].mean(axis=0)
                d = -_softmax((h @ w + b)[None])[0]
                d[y[i]] += 1
                dh = w @ d
                w += lr * np.outer(h, d)
                b += lr * 0.1 * d
                np.add.at(e, g, lr * dh / len(g) * 8)
        return e, w, b

    everything = np.arange(len(rows))
    held = rng.random(len(rows)) < 0.2
    e, w, b = fit(everything[~held])
    z = np.stack([e[ids[i]].mean(axis=0) @ w + b for i in everything[held]]) if held.any() else np.zeros((0, len(languages)))
    loss = lambda s: -np.log(_softmax(z * s)[np.arange(len(z)), y[held]] + 1e-9).mean() if len(z) else 0.0
    scale = min(np.geomspace(0.25, 4, 25), key=loss)
    e, w, b = fit(everything)
    return LanguageModel(languages, e @ w, b, float(scale))


#: calibrated confidence below which a text is rejected
LEAST = 0.6
#: share of spoken lines that makes a language one of a document's
SHARE = 0.2
#: documents of fewer spoken cues are no cases
LEAST_CUES = 4
#: lines that a further language needs at least
LEAST_LINES = 2
_SWITCH = 3.0


Segment = tuple[int, int, str, float]


def segments(logp: np.ndarray, languages: list[str]) -> list[Segment]:
    """(first line, last line, language, confidence) of the stretches of one language. The languages of all lines are chosen
    together, a change costing as much as evidence of exp(3) to 1, so that short lines follow their neighbours. A stretch
    that the model is not sure of is ``und``."""
    top = int(logp.sum(axis=0).argmax())
    # m stretches of other languages take m - 1 changes at least, a single one takes one: below half a change each, none pays
    gain = np.cumsum(logp - logp[:, [top]], axis=0, dtype=float)
    before = np.minimum.accumulate(np.concatenate([np.zeros_like(gain[:1]), gain[:-1]]), axis=0)
    if (gain - before).max() < _SWITCH / 2:
        path = np.full(len(logp), top)
    else:
        score, back = logp[0], []
        for row in logp[1:]:
            jump = int(score.argmax())
            move = score[jump] - _SWITCH > score
            back.append(np.where(move, jump, np.arange(len(score))))
            score = np.where(move, score[jump] - _SWITCH, score) + row
        at = int(score.argmax())
        path = [at]
        for step in reversed(back):
            at = int(step[at])
            path.append(at)
        path = np.array(path[::-1])
    out, start = [], 0
    for i in [*(np.flatnonzero(np.diff(path)) + 1), len(path)]:
        mean = logp[start:i].sum(axis=0)
        p = np.exp(np.clip(mean - mean.max(), -50, 0))
        conf = float(p[path[start]] / p.sum())
        out.append((start, int(i) - 1, languages[path[start]] if conf >= LEAST else "und", conf))
        start = int(i)
    return out


def languages_of(texts: list[str | None], model: LanguageModel) -> list[tuple[int, int, list[Segment]]]:
    """(spoken cues, spoken lines, segments of lines) of each text."""
    cues = [spoken_cues(t) for t in texts]
    lines = [[x for c in doc for x in c.split("\n") if x.strip()] for doc in cues]
    logp = model.log_probabilities([x for doc in lines for x in doc])
    out, at = [], 0
    for c, doc in zip(cues, lines, strict=True):
        out.append((len(c), len(doc), segments(logp[at : at + len(doc)], model.languages) if doc else []))
        at += len(doc)
    return out


def _spread(model: LanguageModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, label, (cues, lines, found) in zip(b["doc_id"], b["lang"], languages_of(list(b["text"]), model), strict=True):
                for k, (first, last, lang, conf) in enumerate(found):
                    rows.append((key, label, cues, lines, k, first, last, lang, conf))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "cues", "lines", "segment", "first_line", "last_line", "lang", "confidence"])

    return run


def language_segments(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Every stretch of one language of documents(doc_id, text, lang): label is the delivered one, cues and lines the numbers
    of spoken cues and lines of the document. Documents without speech have no row."""
    return documents.select("doc_id", "text", "lang").mapInPandas(_spread(model), "doc_id bigint, label string, cues int, lines int, segment int, first_line int, last_line int, lang string, confidence double")


def document_languages(lines: int, found: list[Segment]) -> list[str]:
    """Languages that at least a fifth of the spoken lines are in, the most frequent first."""
    n: Counter[str] = Counter()
    for first, last, lang, _ in found:
        n[lang] += last - first + 1
    ranked = [(x, k) for x, k in n.most_common() if x != "und" and k >= SHARE * lines]
    # a single line is no second language
    return [x for i, (x, k) in enumerate(ranked) if not i or k >= LEAST_LINES]


def _judge(model: LanguageModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, label, (cues, lines, found) in zip(b["doc_id"], b["lang"], languages_of(list(b["text"]), model), strict=True):
                if cues < LEAST_CUES:
                    continue
                langs = document_languages(lines, found)
                if langs and (len(langs) > 1 or label_code(label) != langs[0]):
                    rows += [(key, x) for x in langs]
            yield pd.DataFrame(rows, columns=["doc_id", "lang"])

    return run


def mislabelled(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang) of documents(doc_id, text, lang) whose label is missing, unusable or names another language than the
    speech, or whose speech is in several languages; one row for each language of at least a fifth of the spoken lines."""
    return documents.select("doc_id", "text", "lang").mapInPandas(_judge(model), "doc_id bigint, lang string")


def model_of(samples: DataFrame) -> LanguageModel:
    """A model of samples(lang, text): of all, or of the first MOST_SAMPLES by a hash, so that every language keeps its share."""
    some = samples.where("text is not null and lang is not null").select("lang", "text").orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(MOST_SAMPLES)
    return train(sorted((r.lang, r.text) for r in some.collect()))
