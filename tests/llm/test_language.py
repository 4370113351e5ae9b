from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from undula.llm import language as L

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog while the weather is fine and nothing else matters to the old house on the hill",
    "de": "der schnelle braune fuchs springt über den faulen hund während das wetter schön ist und nichts anderes für das alte haus zählt",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку пока погода хорошая и больше ничего не имеет значения",
    "uk": "швидка коричнева лисиця стрибає через ледачого собаку поки погода гарна і більше нічого не має значення її",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
}
SCHEMA = "doc_id long, text string, lang string, source string, spans int, held_out string"


def table(spark, rows, extra=("x", 1, "clash")):
    return spark.createDataFrame([(i, t, y, *extra) for i, t, y in rows], SCHEMA)


def learned(spark, **options):
    return L.learn(table(spark, [(k, t, y) for k, (y, t) in enumerate(TEXTS.items())]), **options)


def groups_of(word):
    word = word.lower()
    padded = f" {word} "
    return [list(word)] + [[padded[i : i + k] for i in range(len(padded) - k + 1)] for k in (2, 3)]


def brute_scores(rows, words, smoothing=0.5, share=0.005):
    """Scores of words by the definition."""
    langs = sorted({y for _, _, y in rows})
    counts, scripts = {y: [Counter(), Counter(), Counter()] for y in langs}, {y: Counter() for y in langs}
    for _, text, y in rows:
        for w in re.findall(r"[^\W\d_]+", text):
            scripts[y][L.script_of(w)] += len(w)
            for k, groups in enumerate(groups_of(w)):
                counts[y][k].update(groups)
    kinds = [max(len(counts[y][k]) for y in langs) for k in range(3)]
    out = []
    for w in words:
        s = {}
        for y in langs:
            if scripts[y][L.script_of(w)] >= share * sum(scripts[y].values()) and scripts[y][L.script_of(w)]:
                s[y] = sum(math.log((counts[y][k][g] + smoothing) / (sum(counts[y][k].values()) + smoothing * (kinds[k] + 1))) for k in range(3) for g in groups_of(w)[k]) / 3
        top = max(s.values(), default=0)
        out.append([max(s[y] - top, -1e4) if y in s else -1e4 if s else 0.0 for y in langs])
    return langs, np.array(out)


def test_scores_against_definition(spark):
    rows = [(k, t, y) for k, (y, t) in enumerate(TEXTS.items())]
    words = ["fox", "Fuchs", "über", "ÜBER", "xyz", "a", "погода", "її", "сабака", "σκυλί", "漢字", "ß", "İstanbul", "q" * 500]
    langs, want = brute_scores(rows, words)
    model = learned(spark)
    assert model.langs == langs
    np.testing.assert_allclose(model.word_scores(words), want, atol=1e-9)


def test_paths_against_all_paths():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3):
        scores = np.round(rng.normal(0, 3, (20, k)), 1)
        sizes = np.array([6, 6, 5, 3, 1, 1])
        starts = np.cumsum(sizes) - sizes
        ids = rng.integers(0, 20, sizes.sum())
        got = L.best_paths(scores, ids, starts, sizes, 2.5)

        def value(path, words):
            return sum(scores[w, x] for w, x in zip(words, path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))

        for a, n in zip(starts, sizes):
            words = ids[a : a + n]
            best = max(value(p, words) for p in itertools.product(range(k), repeat=n))
            assert abs(value(got[a : a + n].tolist(), words) - best) < 1e-9


def spans(spark, model, texts, **options):
    rows = L.language_spans(table(spark, [(k, t, None) for k, t in enumerate(texts)]), model, **options).collect()
    return {r["doc_id"]: [(x["start"], x["end"], x["lang"], x["letters"]) for x in r["spans"]] for r in rows}


def test_mixed_text_and_odd_texts(spark):
    model = learned(spark)
    a, b = TEXTS["en"], TEXTS["de"]
    text = f"  {a}. {b}! {TEXTS['ru']}"
    cut, letters = len(a) + 2, lambda t: sum(map(str.isalpha, t))
    got = spans(spark, model, [text, None, "", "12 34 ½ _ ²", "漢字 漢字", "быстрая 漢字 быстрая", "fox 🦊 fox", "x" * 200_000])
    assert got[0] == [(2, cut, "en", letters(a)), (cut + 2, cut + 2 + len(b), "de", letters(b)), (len(text) - len(TEXTS["ru"]), len(text), "ru", letters(TEXTS["ru"]))]
    assert got[1] == got[2] == got[3] == []
    most = min(TEXTS, key=lambda y: (-letters(TEXTS[y]), y))
    assert got[4] == [(0, 5, most, 4)]  # nothing known: the language with the most letters
    assert [s[2:] for s in got[5]] == [("ru", 16)] and got[6] == [(0, 9, "en", 6)]
    assert len(got[7]) == 1 and got[7][0][3] == 200_000


def test_scripts_narrow_candidates(spark):
    model = learned(spark)
    s = model.word_scores(["собаку", "house", "σκυλί"])
    at = {y: k for k, y in enumerate(model.langs)}
    assert all(s[0, at[y]] == -1e4 for y in ("en", "de", "el")) and s[1, at["ru"]] == -1e4 and s[2, at["el"]] == 0
    assert L.script_of("日本語") == "Han" and L.script_of("ひらがな") == "Kana" and L.script_of("한국어") == "Hangul" and L.script_of("עברית") == "Hebrew"


def test_bounds_of_the_model(spark):
    small = learned(spark, groups=50, languages=2)
    assert len(small.langs) == 2 and len(small.groups) <= 50
    assert len(spans(spark, small, [TEXTS["de"]])[0]) >= 1


def test_query_on_odd_tables(spark, tmp_path):
    def run(rows, name):
        table(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in L.op13_language(spark, f"{tmp_path}/{name}").collect()), key=repr)

    assert run([], "empty") == []
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    free = [i for i in range(60) if i not in held]
    assert run([(held[0], "house", "en"), (free[0], None, "en"), (free[1], "12", "en"), (free[2], "house", None)], "nothing learned") == sorted(
        [(held[0], True, "und", 0.0), (free[0], False, "und", 0.0), (free[1], False, "und", 0.0), (free[2], False, "und", 0.0)], key=repr
    )
    rows = [(free[0], TEXTS["en"], "en"), (free[0], TEXTS["en"], "en"), (free[1], TEXTS["de"], "de"), (None, TEXTS["ru"], "ru"), (held[0], TEXTS["uk"], "uk"), (held[1], TEXTS["de"][:60], "en"), (held[1], "", "en")]
    got = run(rows, "some")
    assert (held[1], True, "de", 1.0) in got and (held[1], True, "und", 0.0) in got and len(got) == len(rows)
    assert {g[2] for g in got} <= {"en", "de", "und"}  # texts of held-out and null ids teach nothing


def test_main_language(spark):
    rows = [([(0, 3, "b", 3), (4, 7, "a", 3)],), ([(0, 3, "b", 3), (4, 7, "a", 3), (8, 9, "b", 1)],), ([],)]
    got = spark.createDataFrame(rows, f"s {L.SPANS}").select(L.main_language(L.F.col("s")).alias("m")).collect()
    assert [(r.m.lang_pred, round(r.m.score, 6)) for r in got] == [("a", 0.5), ("b", round(4 / 7, 6)), ("und", 0.0)]


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op13_language(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    random.seed(0)
    model = L.learn(docs)
    one, two = (sorted((r.doc_id, str(r.spans)) for r in L.language_spans(d, model).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
