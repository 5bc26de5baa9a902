"""The compression classifier: held-out accuracy on invented texts, and its edge cases."""

import random

import pytest

from gradewell.llm import quality as Q

WORDS = "the picture was sharp and we could read the result at once thanks to the new camera in our clinic every patient liked it".split()


def good(rng):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(3, 300)))


def bad(rng):
    if rng.random() < 0.5:
        return " ".join([rng.choice(WORDS)] * rng.randint(20, 300))
    return " ".join(rng.choice(WORDS) + rng.choice(["###", "$$$", "%%%"]) for _ in range(rng.randint(5, 200)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    return [(i, good(rng) if i % 5 else bad(rng), int(i % 5 > 0)) for i in range(1200)]


def test_held_out_accuracy(spark, texts):
    feedback = spark.createDataFrame([(i, t) for i, t, _ in texts], "session_id int, free_text_feedback string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts if i < 800] + [(None, 1), (3, None), (5, 9)], "session_id int, quality int")
    model = Q.train_quality(feedback, labels)
    rows = [r for r in Q.score_quality(feedback, model).collect() if r["session_id"] >= 800]
    right = sum(r["predicted"] == texts[r["session_id"]][2] for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = Q.keep_good(feedback.filter("session_id >= 800"), model)
    assert kept.columns == feedback.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_edges(spark, texts):
    feedback = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "word " * 50_000, 1)], "session_id int, free_text_feedback string, score int")
    few = spark.createDataFrame([(1, 1), (2, 1)], "session_id int, quality int")
    model = Q.train_quality(feedback, few)
    assert [r["score"] for r in Q.score_quality(feedback, model).collect()] == [1.0] * 4
    none = Q.train_quality(feedback.limit(0), few.limit(0))
    assert [r["score"] for r in Q.score_quality(feedback, none).collect()] == [0.5] * 4
    assert Q.score_quality(feedback.limit(0), model).count() == 0


def test_nothing_is_rejected_without_a_model(spark, texts):
    feedback = spark.createDataFrame([(i, t) for i, t, _ in texts[:20]] + [(None, None)], "session_id int, free_text_feedback string")
    for labels in ([], [(0, 1)], [(i, 0) for i in range(20)]):
        model = Q.train_quality(feedback, spark.createDataFrame(labels, "session_id int, quality int"))
        assert Q.keep_good(feedback, model).count() == 21


def test_pieces_per_text(spark, monkeypatch):
    feedback = spark.createDataFrame([(i, f"{i} words " * 2000) for i in range(12)], "session_id int, free_text_feedback string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "session_id int, quality int")
    seen = []
    monkeypatch.setattr(Q, "build_dictionary", lambda pieces: seen.append(sum(map(len, pieces))) or b"-" * 8)
    Q.train_quality(feedback, labels, pieces_per_text=None)
    assert sum(seen[-2:]) == sum(len(f"{i} words ") * 2000 for i in range(12))


@pytest.mark.parametrize("size", [0, 1, 999, 1000, 1001, 12_345])
def test_pieces_are_the_whole_text(size):
    text = "äb" * size
    assert b"".join(Q.pieces_of(text)) == text.encode()
    assert len(Q.spread_pieces(text)) <= Q.PIECES_PER_TEXT
