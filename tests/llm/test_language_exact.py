"""Predictions of the filters against exact sets of n-grams."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.common import held_out
from emberlog.llm.language import MIN_SHARE, SLOTS_PER_GRAM, identify, learn, op8_language


def grams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    data = b"  " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in data) + b"  "
    return [data[i:i + 4] for i in range(len(data) - 3) if data[i + 1:i + 3] != b"  "]


def exact_sets(rows):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    return {lang: {g for g, n in c.items() if n >= MIN_SHARE * sum(c.values())} for lang, c in counts.items()}


def exact_shares(text, sets):
    found = grams(text)
    return {lang: sum(g in s for g in found) / max(1, len(found)) for lang, s in sets.items()}


def test_filters_against_exact_sets(spark, sf):
    """No n-gram is missed; scores differ from exact shares by false positives only; clear winners are the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("out"))
    rows = docs.collect()
    sets = exact_sets([(r.text, r.lang) for r in rows if not r.out])
    filters = learn(docs.filter("not out"))
    assert filters.languages == sorted(sets)
    for i, lang in enumerate(filters.languages):
        held = np.array([int.from_bytes(g, "little") for g in sets[lang]], np.uint32)
        assert (filters.masks(held)[:, 0] >> np.uint64(i) & np.uint64(1)).all()
    worst = (2 / SLOTS_PER_GRAM) ** 2
    assert (filters.false_positive < worst).all()
    got = {r.doc_id: r for r in op8_language(spark, sf).collect()}
    assert len(got) == len(rows)
    off, clear = [], 0
    for r in rows:
        mine = got[r.doc_id]
        assert mine.held_out == r.out
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        shares = exact_shares(r.text, sets)
        first, second = sorted(shares.values(), reverse=True)[:2]
        noise = 5 * math.sqrt(worst / len(set(grams(r.text)))) + worst
        assert mine.score >= (first - worst) / (1 - worst) - 1e-9 and mine.score <= first + noise
        off.append(abs(mine.score - first))
        if first - second > 2 * noise:
            clear += 1
            assert mine.lang_pred == max(shares, key=shares.get)
    assert clear > len(rows) / 2 and sum(off) / len(off) < worst


def test_small_languages_by_hand(spark):
    """Every n-gram of a small language is in its set, so the score of a text of known n-grams is 1."""
    rows = [("abcd efgh", "x"), ("ijkl mnop", "y"), ("abcd", "x")]
    filters = learn(spark.createDataFrame(rows, "text string, lang string"))
    tried = spark.createDataFrame([(1, "ABCD"), (2, "ijkl mnop"), (3, "abcd ijkl qrst"), (4, "12"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(tried, filters).collect()}
    sets = exact_sets(rows)
    assert got[1] == ("x", 1.0) and got[2] == ("y", 1.0) and got[4] == got[5] == ("und", 0.0)
    assert got[3][0] == "x" and abs(got[3][1] - exact_shares("abcd ijkl qrst", sets)["x"]) < 1e-3
