"""Misspellings, places and learning of the toxicity operator, held to rules written out here."""

import random
import time

from twinfold.llm import toxicity

VOWELS = "aeiou"


def variants(term, rng):
    """Misspellings by the rules, and other words, made letter by letter."""
    k = rng.randrange(1, len(term) - 1)
    typed = [term[:k] + "*" + term[k + 1 :], term[:k] + term[k] + term[k:], term[:k] + "$" + term[k:]]
    inner = [i for i in range(1, len(term) - 1) if term[i] in VOWELS]
    if inner:
        i = rng.choice(inner)
        typed.append(term[:i] + term[i + 1 :])
    swap = next(x for x in "qxzw" if x != term[k])
    return typed, [term[:k] + swap + term[k + 1 :]], ["q" + term[1:], term[1:]]


def test_edits_of_a_term_are_weighed_by_what_is_near_it():
    """A crowded term takes only edits that misspellings are made of; one that nothing is near takes any; others go by length."""
    rng, term = random.Random(1), "bomente"
    for crowded, lone in ((True, False), (False, False), (False, True)):
        lexicon = toxicity.Lexicon([(term, False, 1.0)], [], 0.0, [term] * lone, [term] * crowded)
        for _ in range(50):
            typed, swapped, first = variants(term, rng)
            assert all(lexicon.weigh(w) == toxicity.MISSPELT for w in typed if w != term)
            assert all(lexicon.weigh(w) == (toxicity.FAINT if crowded else toxicity.MISSPELT) for w in swapped)
            assert all(lexicon.weigh(w) == (toxicity.FAINT if crowded else toxicity.MISSPELT) for w in first)


def test_a_stem_keeps_its_first_letter():
    lexicon = toxicity.Lexicon([("réeuxa", True, 1.0), ("achlicht", True, 1.0)], [], 0.0, [], ["achlicht"])
    assert [w for w in ("éeuxauxré", "schlichtzpf", "chlichteber") if lexicon.weigh(w) > toxicity.FAINT] == []
    assert lexicon.weigh("réeuxxaen") == lexicon.weigh("achl*chtung") == lexicon.weigh("achhlichtung") == toxicity.MISSPELT


def places_by_hand(low, hits):
    """Words as they stand; a word with signs takes the place of those inside it where it weighs more."""
    at = [(m.start(), m.end(), hits[m[0]]) for m in toxicity.word.finditer(low) if m[0] in hits]
    for start, end, w in toxicity.with_signs(low):
        if w in hits:
            inside = [p for p in at if p[0] < end and p[1] > start]
            if all(p[2] < hits[w] for p in inside):
                at = [p for p in at if p not in inside] + [(start, end, hits[w])]
    return sorted(at)


def test_places_are_those_by_hand():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon([("idiot", False, 1.0)], [], 0.0)
    pieces = ["id!ot", "you!idiot", "idiot", "a", "!", "b@d", "idiot!idiot", "$hit", "x!b", " ", "@idiot"]
    for _ in range(500):
        low = "".join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(12))
        hits = {w: rng.choice([0.2, 0.5, 0.8]) for w in toxicity.found(low) if rng.random() < 0.8}
        assert sorted(lexicon.places(low, hits)) == places_by_hand(low, hits)


def test_many_signed_words_take_time_in_proportion():
    lexicon = toxicity.Lexicon([("idiot", False, 1.0)], [], 0.0)
    took = []
    for n in (10_000, 80_000):
        began = time.time()
        assert lexicon.score("id!ot " * n) > 0.5
        took.append(time.time() - began)
    assert took[1] < 24 * max(took[0], 0.05)


def test_families_are_learned_word_by_word_where_their_beginning_is_no_term(spark):
    """``mala`` begins ordinary words as well: the words of its family that clean documents lack are learned, the others not."""
    rng = random.Random(3)
    fill = lambda: " ".join(rng.choice(["ta", "lo", "mi", "su", "re"]) * 2 + str(rng.randrange(50)) for _ in range(20))
    toxic = [f"malax{c}" for c in "bcd"] + [f"malaz{c}" for c in "bcdfg"]
    texts, labels = [], []
    for k in range(400):
        bad = k % 2
        words = [toxic[k // 2 % len(toxic)]] if bad else [rng.choice(["malazok", "malaxen", "malaz"])] if k % 6 == 0 else []
        texts.append((k, f"{fill()} {' '.join(words)} {fill()}"))
        labels.append((k, bad))
    df, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(df, lab)
    assert all(lexicon.score(f"so {w} here") >= 0.5 for w in toxic)
    assert all(lexicon.score(f"so {w} here") < 0.5 for w in ("malazok", "malaxen", "malaz"))
    # Repeated keys in either table change nothing but what is counted.
    again = toxicity.fit(df.unionByName(df.limit(30)), lab.unionByName(lab))
    assert all(again.score(f"so {w} here") >= 0.5 for w in toxic)
