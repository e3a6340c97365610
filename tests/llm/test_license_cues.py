"""The words and pairs of words without which a text is not compared with license templates."""

from __future__ import annotations

import random

from newsloom.llm.licenses import TEMPLATES, THRESHOLD, cue_pairs, cues, plain_bigrams, plain_words, scan

SOME, PAIRS = set(cues(TEMPLATES, THRESHOLD)), set(cue_pairs(TEMPLATES, THRESHOLD))


def dice(unit: str) -> float:
    own = set(plain_bigrams(unit))
    known = [set(plain_bigrams(t)) for t in TEMPLATES.values()]
    return max(2 * len(own & g) / (len(own) + len(g)) for g in known) if own else 0.0


def likely(text: str) -> bool:
    return bool(SOME & set(plain_words(text))) and bool(PAIRS & set(plain_bigrams(text)))


def changed(template: str, rng: random.Random) -> str:
    """The template with some words, and the longest first, left out or replaced."""
    words = template.split()
    for _ in range(rng.randint(0, max(1, len(words) // 4))):
        place = max(rng.sample(range(len(words)), min(3, len(words))), key=lambda i: len(words[i]))
        words[place : place + 1] = rng.choice([[], ["other"], ["by", "the"]])
        if not words:
            return ""
    return " ".join(words)


def test_everyday_words_are_no_cues():
    """A text of such words was cut into units and compared with all templates before."""
    assert not SOME & {"by", "under", "with", "without"}
    assert not likely("It was left by the others under a table, without a word, and in general the public liked that.")


def test_every_match_has_a_cue(frame):
    rng, met = random.Random(5), 0
    units = [changed(t, rng) for t in TEMPLATES.values() for _ in range(40)]
    hits = [u for u in units if dice(u) >= THRESHOLD]
    assert len(hits) > 200 and all(likely(u) for u in hits)
    for r in scan(frame([(i, "some words in front of it\n" + u + "\nand some more by them", "s") for i, u in enumerate(hits)])).collect():
        met += 1
        assert r.dice >= dice(hits[r.doc_id]) and r.n_notices > 0
    assert met == len(hits)
