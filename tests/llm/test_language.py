import numpy as np
import pandas as pd
import pytest

from kinlink.llm import language
from kinlink.llm.language import label_code, language_segments, languages_of, mislabelled, segments, train, unadorned


@pytest.fixture(scope="module")
def samples(small):
    df = pd.read_parquet(f"{small}/lang_samples.parquet")
    return list(zip(df.lang, df.text, strict=True))


@pytest.fixture(scope="module")
def model(samples):
    return train(samples, epochs=12)


def _srt(cues):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(cues, 1))


def test_held_out_accuracy(samples):
    learnt = train([s for i, s in enumerate(samples) if i % 4], epochs=12)
    held = [s for i, s in enumerate(samples) if i % 4 == 0]
    best = learnt.log_probabilities([t for _, t in held]).argmax(axis=1)
    assert sum(learnt.languages[b] == lang for b, (lang, _) in zip(best, held, strict=True)) / len(held) > 0.97


def test_labels():
    assert [label_code(x) for x in ("en", "EN", "eng", "English", "pt-BR", "en_US", "xx", "mul", "", None, "??")] == ["en", "en", "en", "en", "pt", "en", None, None, None, None, None]
    assert unadorned("Où? Я тут") == "Ou? Ya tut"


def test_documents(spark, model):
    en = ["Where did you put the lantern?", "I can't call the captain without you.", "Nobody comes near the station anymore.", "You still owe me for the spare engine.", "She kept the letter hidden for years."]
    fr = ["Tu me dois encore quelque chose pour la clé.", "Plus personne ne vient près du puits.", "Où as-tu mis mon manteau ?", "Je ne peux pas appeler le capitaine sans toi."]
    docs = [(1, _srt(en), "en"), (2, _srt(en), "fr"), (3, _srt(en), None), (4, _srt(en + fr), "en"), (5, _srt(en[:3]), "de"), (6, None, None), (7, "", "en"), (8, _srt(en), "en-GB"), (9, _srt(en * 4 + fr[:1]), "en"), (10, "1\n00:00:01,000 --> 00:00:02,000\n" + "word " * 40_000, "en")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, lang string, confidence string")
    got = sorted((r.doc_id, r.lang) for r in mislabelled(df, model).collect())
    assert got == [(2, "en"), (3, "en"), (4, "en"), (4, "fr")]
    parts = [r for r in language_segments(df, model).collect() if r.doc_id == 4]
    assert [(r.lang, r.first_line, r.last_line) for r in sorted(parts, key=lambda r: r.segment)] == [("en", 0, 4), ("fr", 5, 8)] and all(0.6 <= r.confidence <= 1 for r in parts)
    assert mislabelled(df.limit(0), model).count() == 0


def test_no_speech(model):
    assert languages_of([None, "", "[MUSIC]"], model) == [(0, 0, [])] * 3


def _best(logp):
    """Score of the best path, by trying every change."""
    score = logp[0]
    for row in logp[1:]:
        score = np.maximum(score, score.max() - 3.0) + row
    return score.max()


def test_runs_of_slight_evidence_are_searched(monkeypatch):
    logp = np.full((30, 2), -1.0)
    logp[:20, 1] -= 2
    logp[20:, 0] -= 2
    assert [(a, b, x) for a, b, x, _ in segments(logp, ["de", "nl"])] == [(0, 19, "de"), (20, 29, "nl")]
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = int(rng.integers(1, 12))
        z = np.repeat(rng.normal(0, 1.2, (n, 3)), rng.integers(1, 4), axis=0)
        monkeypatch.setattr(language, "LEAST", 0.0)
        path = [(f, t, int(x)) for f, t, x, _ in segments(z, ["0", "1", "2"])]
        got = sum(z[f : t + 1, x].sum() for f, t, x in path) - 3.0 * (len(path) - 1)
        assert abs(got - _best(z)) < 1e-6
