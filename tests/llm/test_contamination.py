"""Benchmark passages against a comparison of all windows."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import contamination, work

DOCS = "doc_id long, text string, item_id long, key string, words string, window string, at long, fp long, slot long"
ITEMS = "item_id long, text string, fp string, length string, doc_id long"


def words_of(text):
    kept = "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in text or "")
    return [w for w in kept.split(" ") if w]


def by_hand(docs, items, window):
    wanted = []
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        wanted += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w, hit, named = words_of(text), set(), set()
        for item, x in wanted:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    named |= {str(item)} - {"None"}
        out.append((doc, len(w), len(hit), sorted(named)))
    return sorted(out, key=str)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "k", "w", "i", 2, 3, 4) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "f", "l", 5) for r in items], ITEMS)
    found = contamination.contamination(d, i, **options)
    rows = found.select("doc_id", "n_words", contamination.hit_words(F.col("spans")).alias("n"), "items").collect()
    return sorted(((r.doc_id, r.n_words, r.n, list(r.items)) for r in rows), key=str)


@pytest.mark.parametrize(("window", "gram", "slots", "together"), [(10, 8, 1 << 20, 256), (10, 5, 1 << 20, 256), (4, 1, 8, 2), (5, 4, 1, 2)])
def test_passages_equal_brute_force(spark, monkeypatch, window, gram, slots, together):
    monkeypatch.setattr(contamination, "SLOTS", slots)  # few: all fingerprints pass
    monkeypatch.setattr(work, "TOGETHER", together)  # few: frequent windows are spread
    rng = random.Random(window * gram)
    say = lambda n, k=3: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(1, 2 * window)))) for i in range(12)] + [(3, "z y x"), (20, None), (21, "?!"), (None, " ".join(say(window)))]
    items += [(30, items[5][1]), (31, "A-b, C! " + items[6][1].upper())]
    docs = []
    for i in range(60):
        w = say(rng.randrange(4 * window), 8)
        for _ in range(rng.randrange(3)):
            own = words_of(rng.choice(items)[1])
            at, take = rng.randrange(len(w) + 1), rng.randrange(len(own) + 1)
            w[at:at] = own[:take] if rng.random() < 0.5 else own[len(own) - take :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "?"), (None, items[0][1]), (None, items[0][1]), (4, docs[4][1]), (4, items[1][1])]
    assert got(spark, docs, items, window=window, gram=gram) == by_hand(docs, items, window)


def test_words_keep_digits_and_other_scripts(spark):
    docs = [(1, "Été 1998: Köln_BONN the 5 É 日本 a b c d"), (2, "été 1998 köln bonn the 5 é 日本 a b c d")]
    items = [(7, "Été 1998 Köln bonn THE 5 É 日本 A b"), (8, "É 日本")]
    assert got(spark, docs, items) == by_hand(docs, items, 10) == [(1, 12, 10, ["7", "8"]), (2, 12, 0, [])]


def test_empty_tables(spark):
    docs, items = [(1, "a b c")], [(1, "b")]
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == [(1, 3, 0, [])]
    assert got(spark, docs, items) == [(1, 3, 1, ["1"])]
    with pytest.raises(ValueError):
        got(spark, docs, items, window=4, gram=4)


def test_long_texts(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    filler = [f"w{rng.randrange(50)}" for _ in range(300_000)]
    docs = [(1, " ".join(filler[:150_000]) + " " + passage + " " + " ".join(filler[150_000:])), (2, "x" * 2_000_000), (3, " \n" * 1_000_000), (4, "a " * 300_000)]
    items = [(9, passage), (10, "a " * 12)]
    assert got(spark, docs, items) == [(1, 300_030, 30, ["9"]), (2, 1, 0, []), (3, 0, 0, []), (4, 300_000, 300_000, ["10"])]


def test_grams_are_put_together_right(spark):
    df = spark.createDataFrame([(list("abcdefghijk"),), (list("abc"),), ([],)], "words array<string>")
    row, few, none = contamination.with_grams(df, [3, 7, 8, 9]).collect()
    assert set(row.asDict()) == {"words", "g3", "g7", "g8", "g9"}
    assert [len(row[f"g{n}"]) for n in (3, 7, 8, 9)] == [9, 5, 4, 3] and len(few.g3) == 1 and not few.g7 and not none.g3
    again = contamination.with_grams(spark.createDataFrame([(list("cdefghijk"),)], "words array<string>"), [3, 7, 8, 9]).first()
    assert again.g7 == row.g7[2:] and again.g9 == row.g9[2:] and again.g3 == row.g3[2:] and len(set(row.g3)) == 9
