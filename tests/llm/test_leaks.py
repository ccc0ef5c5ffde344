import random

from kinlink.llm.leaks import SuffixAutomaton, cleaned, leaked_items, leaked_spans
from kinlink.llm.speech import repair_encoding, spoken_cues


def test_automaton_against_brute_force():
    rng = random.Random(3)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(6)]
    sam = SuffixAutomaton(seqs)
    text = [rng.randrange(-1, 5) if rng.random() < 0.9 else -1 for _ in range(300)]
    text = [c if c < 4 else -1 for c in text]
    grams = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = []
    for e in range(len(text)):
        n = max((k for k in range(0, e + 2) if k == 0 or tuple(text[e - k + 1 : e + 1]) in grams), default=0)
        nxt = tuple(text[e - n + 1 : e + 2]) if e + 1 < len(text) else ()
        if n >= 3 and not (nxt and nxt in grams and len(nxt) == n + 1):
            want.append((e, n))
    assert [(e, n) for e, n, _ in sam.runs(text, 3)] == want
    for e, n, state in sam.runs(text, 3):
        run = text[e - n + 1 : e + 1]
        assert {(i, p) for i, s in enumerate(seqs) for p in range(len(s)) if p - n + 1 >= 0 and s[p - n + 1 : p + 1] == run} == set(sam.places(state))


def test_automaton_of_one_word_again_and_again():
    sam = SuffixAutomaton([[0] * 3000, [0, 1] * 1500])
    assert sum(map(len, sam.ends)) == 6000  # each place once, however deep the tree
    assert len({p for _, _, s in sam.runs([0] * 3000, 3) for p in sam.places(s)}) == 1


ITEM = "In the second experiment, the keepers of the lighthouse travelled 907 furlongs without rest because sulphur was scarce and the comet never returned."


def _srt(cues):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(cues, 1))


def test_documents(spark):
    whole = ["Hello there.", "In the second experiment, the keepers", "of the Iighthouse travelled 907", "Wait, where is my coat?", "furlongs without rest because", "sulphur was scarce and the comet never returned."]
    part = ["in the second experiment the keepers of the lighthouse travelled 907 furlongs without rest"]
    little = ["in the second experiment the keepers of the lighthouse"]
    spread = [w for w in ITEM.split() for w in (w, "and so we went home that evening after all")]
    docs = [(1, _srt(whole)), (2, _srt(part)), (3, _srt(little)), (4, None), (5, ""), (6, _srt(spread)), (1, _srt(whole)), (7, "x " * 100_000)]
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, ""), (12, "other words altogether here for nothing")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, item_id string"), items).collect())
    assert got == [(1, 9), (1, 9), (2, 9)]
    rows = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, item_id string")
    spans = {r.doc_id: r for r in leaked_spans(rows, items).collect()}
    assert set(spans) == {1, 2} and spans[2].first_word == 0 and spans[2].last_word == 13 and spans[2].words == 14
    assert spans[1].first_word == 2 and spans[1].coverage == 1.0
    texts = {r.doc_id: (r.text, r.removed) for r in cleaned(rows, items).collect()}
    assert texts[3] == (docs[2][1], 0) and texts[4] == (None, 0) and texts[5] == ("", 0)
    assert texts[1][0].splitlines()[0].strip() == "Hello there." and "furlongs" not in texts[1][0] and texts[2] == ("", 14)
    assert cleaned(rows, items, least_words=1000).where("removed > 0").count() == 0
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaked_items(none, items).count() == 0 and leaked_items(spark.createDataFrame([(1, "a")], none.schema), items.limit(0)).count() == 0


def test_speech():
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>- Où est-il ?</i>\r\n\r\n2\r\n00:00:03,000-->00:00:04,000\r\n[DOOR CREAKS]\r\n\r\n3\r\n00:00:05.000 -> 00:00:06.000\r\nANNA: Ici.\r\n\r\n4\r\n00:00:07,000 --> 00:00:08,000\r\nSubtitles by Bob\r\n\r\n5\r\n00:00:09,000 --> 00:00:10,000\r\nTÃ©lÃ©phone\r\n"
    assert [c.strip() for c in spoken_cues(text)] == ["Où est-il ?", "Ici.", "Téléphone"]
    assert spoken_cues(None) == [] and spoken_cues("") == []
    assert repair_encoding("Ã\x83Â©") == "é" and repair_encoding("Âge") == "Âge"
