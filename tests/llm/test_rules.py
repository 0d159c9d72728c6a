import numpy as np

from readsieve.llm import rules
from tests.llm.fixtures import TEXTS, documents

BLANKS = " \t\n\v\f\r"


def brute(text):
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in BLANKS:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(BLANKS) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_features_against_brute_force(monkeypatch):
    texts = [t for _, t, _, _ in TEXTS if t is None or len(t) < 6000]
    for text in [*texts, "a b c a b c a", "a a a a", "x\vy\fz w x\ny\n\ny\n y", "a b c\na b c\n"]:
        assert rules.text_features(text)[:5] == brute(text), text


def test_windows_with_many_kinds(monkeypatch):
    ids = np.array([5, 1 << 19, 7, 5, 1 << 19, 7, 9])
    assert rules._in_repeats(ids, 1 << 20) == rules._in_repeats(ids, 1 << 19 | 1) == 6


def test_estimates_find_the_planted_accuracies():
    rng = np.random.default_rng(3)
    n, right_good, right_bad = 200_000, [0.97, 0.95, 0.9, 0.93], [0.7, 0.6, 0.8, 0.5]
    good = rng.random(n) < 0.85
    votes = np.stack(
        [
            np.where(
                rng.random(n) < 0.2, -1, np.where(rng.random(n) < np.where(good, g, b), good, ~good).astype(int)
            )
            for g, b in zip(right_good, right_bad)
        ],
        axis=1,
    )
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.02
    assert np.abs(np.array(model.right_on_good) - right_good).max() < 0.02
    assert np.abs(np.array(model.right_on_bad) - right_bad).max() < 0.06
    p = rules.posterior(model, patterns)
    assert ((p > 0) & (p < 1)).all() and p[(patterns == 1).all(axis=1)] > 0.9 > p[(patterns == 0).all(axis=1)]


def test_no_votes_leave_the_start():
    model = rules.fit(np.zeros((0, 3), int), np.zeros(0))
    assert model.prior == 0.9 and model.rounds == 0


def test_judge(spark):
    found = rules.judge(documents(spark))
    rows = found.collect()
    assert len(rows) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for r in by_id.values():
        text = next(t for i, t, _, _ in TEXTS if i == r["doc_id"])
        if text is None or len(text) < 6000:
            assert tuple(r[f] for f in rules.FEATURES[:5]) == brute(text)
        n, again = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert not by_id[3]["kept"] and not by_id[4]["kept"] and not by_id[11]["kept"]
    assert rules.judge(documents(spark, [])).count() == 0


def test_bad_documents_go_and_clean_ones_stay(spark):
    clean = [(i, " ".join(f"word{(i * 31 + j * j) % 997}a{j}" for j in range(120)) + ".", "en", "a") for i in range(200)]
    noisy = [(1000 + i, " ".join(f"w{i}q{j}&&&" for j in range(120)), "en", "a") for i in range(20)]
    loud = [(2000 + i, " ".join(f"W{i}Q{j}!!" for j in range(20)), "en", "a") for i in range(20)]
    kept = {r["doc_id"] for r in rules.judge(documents(spark, clean + noisy + loud)).where("kept").collect()}
    assert kept == set(range(200))
