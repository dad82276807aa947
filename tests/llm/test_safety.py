import numpy as np
import pytest

from cuewright.llm import safety
from cuewright.llm.safety import SEED_HARMLESS, SEED_OFFENSIVE, Ftrl, normal_token, offence_rates, offence_scores, passages, text_scores, train

OFFENSIVE = [
    "you are a worthless idiot", "u r such a p.a.t.h.e.t.i.c l0$er, you stupid m0r0n", "all immigrants are parasites and should be thrown out", "YOU FUUUUCKING BASTARD, go die",
    "du bist ein dummes Arschloch", "eres una mierda, cabrón", "what a f u c k i n g i d i o t", "you stu​pid id​iot", "தமிழ் நாயே, முட்டாள்", "she grabs his hard c*ck and moans",
]
HARMLESS = ["the dog had five puppies in the barn", "nobody should be called an idiot for asking", "turn left at the museum and ask for Maria", "she opened the door and waited for an hour", "2024-01-01 12:00:05 step finished"]


@pytest.fixture(scope="module")
def weights():
    return train([])


def test_disguises():
    for token, plain in {"M0R0N": "moron", "$tupid": "stupid", "iiidiooot": "idiot", "сrеtin": "cretin", "imbéciles": "imbeciles", "b1tch": "bitch", "moron": "moron", "நாயே": "நாயே", "2024": "2024"}.items():
        assert normal_token(token) == plain
    assert passages("a m.o.r.o.n here")[0] == ["a", "moron", "here"]
    assert passages("f u c k i n g b a s t a r d")[0] == ["fucking", "bastard"]


def test_seeds_alone_tell(weights):
    bad, _ = text_scores(OFFENSIVE, weights)
    good, _ = text_scores(HARMLESS, weights)
    assert (bad > 0.5).mean() >= 0.8
    assert good.max() < bad.min() + 0.4
    assert (good < 0.5).sum() >= 3


def test_a_passage_in_a_long_text(weights):
    calm = "The frame shows a quiet library at noon. " * 400
    score, worst = text_scores([calm + "you are a worthless idiot. " + calm, calm, "", None, "..."], weights)
    assert score[0] > 0.5 > score[1]
    assert "idiot" in worst[0]
    assert (score[2:] < 1e-6).all()


def test_learning_from_documents():
    labelled = [(f"We walked to the harbour number {i}. zorbling is a frumious thing to say.", True) for i in range(12)]
    labelled += [(f"We walked to the harbour number {i}. It was a fine day.", False) for i in range(30)]
    scores, _ = text_scores(["zorbling is a frumious thing", "We walked to the harbour number 77."], train(labelled))
    assert scores[0] > 0.5 > scores[1]


def test_ftrl_leaves_most_weights_at_zero(weights):
    assert (weights != 0).sum() < 0.02 * len(weights)
    model = Ftrl()
    import numpy as np

    for _ in range(50):
        model.update(np.array([1, 2]), 1.0)
        model.update(np.array([2, 3]), 0.0)
    w = model.weights(np.array([1, 2, 3]))
    assert w[0] > 0 > w[2]
    assert len(SEED_OFFENSIVE) and len(SEED_HARMLESS)


def test_tables(spark):
    rows = [(i, t, "Comment-Feed " if i % 2 else None) for i, t in enumerate([*OFFENSIVE, *HARMLESS, None, ""])] + [(3, OFFENSIVE[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, "abusive"), (11, "none"), (99, "sexual"), (None, "none"), (12, None)], "doc_id long, category string")
    got = offence_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    rates = {r.source: r for r in offence_rates(offence_scores(docs, labels)).collect()}
    assert set(rates) == {"comment_feed", "unknown", "x"}
    assert sum(r.documents for r in rates.values()) == len(rows)
    assert offence_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_batches_agree_with_passages_one_by_one():
    rng = np.random.default_rng(4)
    w = np.where(rng.random((1 << safety.BITS) + 1) < 0.05, rng.standard_normal((1 << safety.BITS) + 1), 0.0)
    words = ["you", "idiot", "i.d.i.o.t", "f u c k", "Idiôt!!", "im​migrants", "नाय", "நாயே", "1d10t", "***", "rats", "the", "cats."]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)] + [None, "", "... !!", "a"]
    got, worst = safety.text_scores(texts, w)
    for text, score, passage in zip(texts, got, worst):
        parts = safety.passages(text or "")
        each = [w[x].sum() for x in safety._split(parts)] if parts else [-30.0]
        assert abs(score - 1 / (1 + np.exp(-np.clip(max(each), -30, 30)))) < 1e-9
        assert passage is None if not parts else passage in {" ".join(p) for p in parts}


def test_long_labelled_documents_are_learned_from(spark):
    long = "the harbour was quiet and the boats came in. " * 3000 + "you flubbering zonkwit, we all despise your kind"
    docs = [(i, long if i % 2 else "the harbour was quiet and the boats came in. " * 40, "caption") for i in range(1, 41)]
    docs += [(100, "you flubbering zonkwit, we all despise your kind", "caption"), (101, "the boats came in", "caption")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "abusive" if i % 2 else "none") for i in range(1, 41)], "doc_id long, category string")
    got = {r.doc_id: r.score for r in safety.offence_scores(d, labels).where("doc_id >= 100").collect()}
    assert got[100] > 0.5 > got[101]
