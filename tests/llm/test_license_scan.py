"""Automata against regular expressions and a search over all ways to read a template, and odd rows."""

import random
import re

import pytest

from tidewheel.llm import license_scan
from tidewheel.llm.license_scan import Automaton, Matcher, labelled, parsed, scan, split

MIT = dict(license_scan.TEMPLATES)["mit"]


def readings(elements):
    """All word sequences that a template without long gaps stands for; None stands for any word."""
    if not elements:
        return [()]
    x, rest = elements[0], readings(elements[1:])
    if isinstance(x, bytes):
        first = [(x,)]
    elif isinstance(x, list):
        first = [(), *readings(x)]
    elif isinstance(x[0], list):
        first = [tuple(w) for w in x]
    else:
        first = [(None,) * n for n in range(x[0], x[1] + 1)]
    return [a + b for a in first for b in rest]


SMALL = ("a b [[c]] d", "[[x]] a {{v:0-2}} b", "a [[b [[c]] {{v:1-2}}]] a", "{{v:x|y z}} a b {{v:c|d d}}", "[[{{v:1-2}}]] b [[b]] c", "a {{v:2-3}} a")


def brute(markup, own):
    """The longest span that each place of the anchor gives: (start, stop)."""
    elements = parsed(markup)
    first = next(k for k, x in enumerate(elements) if isinstance(x, bytes))
    heads, tails = readings(elements[:first]), readings(elements[first:])
    fits = lambda want, at: at >= 0 and at + len(want) <= len(own) and all(w is None or w == o for w, o in zip(want, own[at : at + len(want)]))
    out = []
    for p in range(len(own)):
        after = [len(t) for t in tails if fits(t, p)]
        before = [len(h) for h in heads if fits(h, p - len(h))]
        if after and before:
            out.append((p - max(before), p + max(after)))
    return sorted(out)


def test_automata_against_all_readings(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices(["A", "b", "c", "d", "x", "y", "z"], k=rng.randrange(0, 30)))) for k in range(150)]
    for markup in SMALL:
        found = scan(spark.createDataFrame(docs, "doc_id long, text string"), templates=(("t", markup),), phrases={}).collect()
        for (_, text), row in zip(docs, sorted(found, key=lambda r: r.doc_id)):
            assert [(m.start, m.stop) for m in row.matches] == brute(markup, split(text)), (markup, text)


def filled(markup):
    """The text of a template with its regions left in, and with them left out."""
    names = re.sub(r"\{\{\w+:(\d+)-\d+\}\}", lambda m: " ".join(["someone"] * max(1, int(m[1]))), markup)
    names = re.sub(r"\{\{\w+:([^|{}]*)[^{}]*\}\}", r"\1", names)
    bare = names
    while (less := re.sub(r"\[\[[^\[\]]*\]\]", " ", bare)) != bare:
        bare = less
    return names.replace("[[", " ").replace("]]", " "), bare


@pytest.mark.parametrize("label, markup", license_scan.TEMPLATES)
def test_templates_match_their_own_texts_only_whole(label, markup):
    matcher = Matcher(license_scan.TEMPLATES, {})

    def labels(text):
        import numpy as np

        raw = np.frombuffer(text.encode(), np.uint8)
        return {x for x, *_ in matcher.scan(raw, np.array([0, len(raw)]))[0][2]}

    full, bare = filled(markup)
    assert label in labels(full) and label in labels(f"Some words before. {bare} And behind.") and label in labels(full.upper().replace(" ", "\n * "))
    own = split(bare)
    rng = random.Random(3)
    elements = [x for x in parsed(markup) if isinstance(x, bytes)]
    for _ in range(20):  # a mandatory word gone or another in its place
        word = rng.choice(elements)
        at = own.index(word)
        if own.count(word) > 1:
            continue
        gone, other = [*own[:at], *own[at + 1 :]], [*own[:at], b"zebra", *own[at + 1 :]]
        assert label not in labels(b" ".join(gone).decode()) and label not in labels(b" ".join(other).decode())


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(license_scan, "KEPT", 2)
    automaton, own = Automaton(parsed("a {{v:1-3}} b [[c]] d")), split("a x y b c d")
    assert automaton.longest(lambda k: own[k], len(own)) == 6 and automaton.longest(lambda k: own[k], 5) is None


def test_bad_templates():
    for bad in ("a [[b", "a ]] b", "[[a]]", "{{v:1-2}}", ""):
        with pytest.raises(ValueError):
            parsed(bad)


def test_labels_and_odd_rows(spark):
    full, bare = filled(MIT)
    long = "x " * 300_000 + "Released under the MIT License. " + bare
    docs = [(1, full), (2, "Released under the MIT License, or CC-BY-NC."), (2, "Released under the MIT License, or CC-BY-NC."), (3, None), (4, ""), (None, "under the\nMIT--license under the mit license"), (5, long), (6, "under the mit"), (7, "license")]
    df = spark.createDataFrame([(*d, "own", "own") for d in docs], "doc_id long, text string, n_words string, __text string")
    out = labelled(scan(df))
    assert out.columns[:2] == ["doc_id", "n_words"]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out.collect()), key=str)
    n = len(split(full))
    assert got == sorted([
        (0, 8, 2, 0, 4, "mit", "mit", 0.5), (1, n, 0, None, None, "", "mit", 1.0), (2, 9, 2, 1, 6, "cc-by-nc,mit", "cc-by-nc,mit", 0.5), (2, 9, 2, 1, 6, "cc-by-nc,mit", "cc-by-nc,mit", 0.5), (3, 0, 0, None, None, "", "", 0.0), (4, 0, 0, None, None, "", "", 0.0),
        (5, 300_005 + len(split(bare)), 1, 300_001, 300_001, "mit", "mit", 1.0), (6, 3, 0, None, None, "", "", 0.0), (7, 1, 0, None, None, "", "", 0.0),
    ], key=str)
    assert scan(df.limit(0)).count() == 0
    assert scan(df, keep=()).columns == ["n_words", "phrases", "matches"]
    assert [tuple(m) for m in out.filter("doc_id = 1").first().matches] == [("mit", 0, n)]
