"""Text operators on their own: look-alikes, encodings, quality, passages, packing."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import filters, increment, lookalike, mojibake, packing, passages, quality, variants
from lamina.llm.heavy import Sketch
from lamina.llm.quality_holdout import HOLDOUT


@pytest.mark.parametrize(
    "text, form",
    [
        ("ｈｔｔｐ：／／ａ．ｂ", "http://a.b"),
        ("e\u0301te\u0301", "été"),
        ("a\u200bb\u00adc\u2060d\ufeff", "abcd"),
        ("a\u00a0b\u2003c", "a b c"),
        ("раypal", "paypal"),
        ("Ѕcope", "Scope"),
        ("ⅼink", "link"),
        ("plain ASCII stays", "plain ASCII stays"),
        ("", ""),
        ("é", "é"),
        ("\u0451lan", "ëlan"),
    ],
)
def test_canonical(text, form):
    assert lookalike.canonical(text) == form


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_canonical_by_segments_equals_whole(text):
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once


def test_places():
    p = lookalike.Places([(1, "evil.test"), (2, "größe.test"), (3, "")])
    assert p.exact("ｅvil.test") == [1] and p.exact("evil.test") == [] and p.exact("Evil.test") == []
    assert p.within("see evil.test and größe.test") == set()
    assert p.within("see evil.test and ev\u0456l.test") == {1}
    assert p.within("gro\u0308ße.test") == {2}
    assert p.within("grosse.test é") == set()
    assert p.within("evil.test\u0301") == set()
    assert p.within("é evil.test\u200b é") == set()


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
@pytest.mark.parametrize("text", ["gelöscht für später", "après la fenêtre", "señal añadida", "журнал запуск"])
def test_misread_utf8_comes_back(wrong, text):
    try:
        bad = text.encode("utf-8").decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("bytes without a character in this encoding")
    out, fixed, lost = mojibake.repair(f"x = {bad} end")
    assert out == f"x = {text} end" and fixed and not lost


@pytest.mark.parametrize("wrong", ["latin-1", "cp437", "cp850", "mac_roman", "cp866"])
@pytest.mark.parametrize("text", ["→", "✓", "≥", "😀", "مرحبا", "สวัสดี", "Ελληνικό κείμενο όλων"])
def test_misread_beyond_the_usual_letters(wrong, text):
    assert mojibake.repair(f"x = {text.encode().decode(wrong)} end") == (f"x = {text} end", len(text.split()), 0)


def test_good_neighbours_in_one_span():
    bad = "é\ue000é".encode().decode("latin-1")
    assert mojibake.repair(f"a {bad} b")[:2] == ("a é" + "\ue000".encode().decode("latin-1") + "é b", 2)
    assert mojibake.repair("αβγδ".encode().decode("gbk"))[0] == "αβγδ"


@pytest.mark.parametrize("text", ["«слов…» и «остров»— да", "самостоятельно собран там", "стратегії» степі»", "voilà\u00a0» déjà !", "ВІН» ЛІН» НІК»", "Spaß… 2×…", "islã” ça…", "│Б││Б││", "cοmpαñíα.test", "Ñandú… ¿Qué?…»", "αβγ Ωμέγα όλων"])
def test_right_texts_of_other_letters_stay(text):
    assert mojibake.repair(text) == (text, 0, 0)


def test_misread_twice_and_wide_and_swapped():
    twice = "préparé".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice)[0] == "préparé"
    assert mojibake.repair("cachée fenêtre".encode().decode("gbk"))[:2] == ("cachée fenêtre", 2)
    swapped = "echo hello there".encode("utf-16-le").decode("utf-16-be")
    assert mojibake.repair(swapped)[0] == "echo hello there"


@pytest.mark.parametrize("text", [None, "", "plain", "NÃO APAGAR vérifié", "± 5 µs ©", "£ 40 – Löschung", "журнал запуск служба", "完了 更新 削除", "zażółć gęślą jaźń", "Übergabe „später“", "¿Qué señal?", "10 km² à 5 °C"])
def test_right_texts_stay(text):
    assert mojibake.repair(text) == (text, 0, 0)


@pytest.mark.parametrize("text", ["t\ufffdche", "gel”scht", "clΘ fenΩtre", "us³uga w³¹czona"])
def test_beyond_repair_is_found(text):
    _, fixed, lost = mojibake.repair(text)
    assert fixed or lost


def test_holdout_is_told_apart():
    words = frozenset("the of and to in is was that it for on not but he der die und das ist nicht dass wir el la que de y en le les et a du des est pas".split())
    prose = [t for t, y in HOLDOUT if y] * 8
    junk = [t for t, y in HOLDOUT if not y] * 8
    x, y, flow = quality.training_set(prose + junk, words)
    assert x.shape[1] == len(quality.NAMES) and set(y) == {0.0, 1.0}
    model = quality.Trees().fit(x, y)
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("text", [None, "", " \n\t", "...", "a", "x" * 300_000, "\ufffd" * 10])
def test_statistics_of_odd_texts(text):
    figures = quality.statistics(text, frozenset(["the"]))
    assert len(figures) == len(quality.NAMES) and np.isfinite(figures).all()


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    assert ((quality.Trees().fit(x, y).probability(x) >= 0.5) == y).mean() > 0.98


@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 3), st.integers(0, 5)), max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit(items):
    sizes, sources, clusters = [list(x) for x in zip(*items)] if items else ([], [], [])
    bins = packing.best_fit(sizes, sources, clusters, 100)
    held = {}
    for b, s, c in zip(bins, sizes, clusters):
        held.setdefault(b, []).append((s, c))
    for part in held.values():
        assert sum(s for s, _ in part) <= 100 and len({c for _, c in part}) == len(part)


def test_best_fit_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    bins = packing.best_fit(sizes, ["a"] * 3000, [None] * 3000, 100)
    assert len(set(bins)) <= sum(sizes) / 100 * 1.01 + 1


def test_windows_hash_substrings():
    t = "abcabcabcxyz" * 3
    for n in (1, 2, 3, 7, 12):
        h = passages.windows(passages.codes(t), n)
        by = {}
        for i, x in enumerate(h):
            by.setdefault(int(x), set()).add(t[i : i + n])
        assert len(h) == len(t) - n + 1 and all(len(s) == 1 for s in by.values()) and len(by) == len({t[i : i + n] for i in range(len(h))})
    assert len(passages.windows(passages.codes("ab"), 5)) == 0


def test_every_span_holds_a_selected_phrase():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(200))
    for _ in range(30):
        left, right = ("".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300))) for _ in range(2))
        a, b = (set(passages.selected(passages.codes(x), 200)[1].tolist()) for x in (left + shared + right, right + shared))
        assert a & b


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    cms, true = Sketch(256, 4), {}
    for _ in range(20):
        part = np.unique(rng.choice(keys, 500))
        w = rng.integers(1, 9, len(part))
        est = cms.add(part, w)
        for k, x, e in zip(part.tolist(), w.tolist(), est.tolist()):
            true[k] = true.get(k, 0) + x
            assert e >= true[k]


def test_runs_and_winnowing():
    words = "a b c d a b c".split()
    h = np.array([hash(w) & (2**63 - 1) for w in words], dtype=np.uint64)
    assert len(increment.runs_of(words, h)) == 4 and len(increment.runs_of(["a"], h[:1])) == 0
    prints, cover = increment.winnow(np.arange(100, dtype=np.uint64) * np.uint64(7919) % np.uint64(101))
    assert cover.sum() == 100 - increment.WINDOW + 1


def test_bloom_positions():
    rng = np.random.default_rng(0)
    held, other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = filters.Bloom(16 * 5000)
    b.add(held)
    assert b.has(held).all() and b.has(other).mean() < 0.02 and filters.Bloom.read(b.cells.tobytes()).has(held).all() and 0.1 < b.full() < 0.5
