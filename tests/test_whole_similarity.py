import difflib
import random

import haruspex.plans.queries2 as q
from haruspex.operators import leakage

FORM = "the outcome was yes"


def brute(t, f):
    words, w = t.split(), len(f.split())
    spans = [words[i : i + n] for n in (w - 1, w, w + 1) if w and n > 0 for i in range(len(words) - n + 1)]
    return max((difflib.SequenceMatcher(None, f, " ".join(x)).ratio() for x in spans), default=0.0)


def test_bounds_lose_no_window():
    rnd = random.Random(6)
    vocab = ["the", "outcome", "was", "yes", "no", "outcomes", "éé", "w", "saw", "", "come out"]
    for _ in range(300):
        t, f = (" ".join(rnd.choices(vocab, k=rnd.randrange(n))) for n in (40, 7))
        assert leakage._best_ratio(t, f) == brute(t, f)
    assert leakage._best_ratio("", FORM) == leakage._best_ratio("a b c d", "") == 0.0


def test_whole_texts_of_documents_are_scanned(spark, tmp_path):
    long = "filler words " * 3000 + "so the outcome was yes indeed"
    spark.createDataFrame([(1, long), (2, "nothing here"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "a", "short")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r.similarity for r in q.leak08(spark, str(tmp_path)).collect()}
    assert got[1] == 1.0 and got[2] < 0.9 and got.keys() == {1, 2, 3}


def test_ratio_is_that_of_difflib():
    rnd = random.Random(7)
    for _ in range(2000):
        f, t = ("".join(rnd.choices("ab c\U0001f600é", k=rnd.randrange(1, n))) for n in (30, 260))
        assert leakage._ratio(f, t) == difflib.SequenceMatcher(None, f, t).ratio()


def test_windows_of_long_words_and_forms_and_across_pieces(monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 3)
    rnd = random.Random(8)
    for k in range(300):
        words = ["".join(rnd.choices("abc", k=rnd.choice([1, 2, 5, 90 if k % 3 else 230]))) for _ in range(rnd.randrange(20))]
        t, f = " ".join(words), " ".join(rnd.choices([*words, "ab", "cab" * (40 if k % 5 == 0 else 2)], k=rnd.randrange(1, 6)))
        assert leakage._best_ratio(t, f) == brute(t, f)


def test_few_windows_of_random_syllables_are_compared(monkeypatch):
    rnd, compared = random.Random(9), []
    text = " ".join("".join(rnd.choices(["ta", "me", "so", "hu", "wa", "ye", "cor"], k=rnd.randrange(1, 4))) for _ in range(2000))
    sought, own = brute(text, FORM), difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: compared.append(1) or own(self))
    if ratio := getattr(leakage, "_ratio", None):
        monkeypatch.setattr(leakage, "_ratio", lambda *a: compared.append(1) or ratio(*a))
    assert leakage._best_ratio(text, FORM) == sought and len(compared) < 60
