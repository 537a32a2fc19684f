import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelode.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abeth ▁\n\té日🦄\x00<s>01.'ß́　", max_size=60))
def test_any_text(text):
    ids = LIBRARY.encode(text)
    codec = pieces.vocabulary(PATH)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == LIBRARY.decode(ids)


def test_blanks_and_unbroken_runs(vocabulary):
    random.seed(1)
    texts = [" " * n + "the" + " " * m for n in range(0, 40, 3) for m in range(0, 40, 5)]
    texts += ["".join(random.choices("abcdefgh", k=20_000)), "ab" * 9000, "the" * 9000, "=" * 5000, "日本🦄" * 3000]
    assert [vocabulary.encode(t) for t in texts] == LIBRARY.encode(texts)


def test_decoding_any_ids(vocabulary):
    random.seed(2)
    for _ in range(3000):
        ids = [random.choice((random.randrange(32_000), random.randrange(300))) for _ in range(random.randrange(7))]
        assert vocabulary.decode(ids) == LIBRARY.decode(ids)


def test_backtracking_takes_pieces_back(vocabulary):
    """Texts whose longest pieces are not their encoding, and some where a piece taken before has to go."""
    random.seed(4)
    other = 0
    for _ in range(3000):
        text = "▁" + "".join(random.choices("thaeinsr", k=9))
        greedy = [p for _, p in vocabulary.automaton.iter_long(text)]
        found = vocabulary.backtracked(text)
        assert found == vocabulary.merged(text)
        other += found != greedy
    assert other > 300


def test_tables_stay_bounded(vocabulary):
    kept = pieces._Kept(lambda k: k, 10)
    for i in range(1000):
        assert kept[str(i % 37)] == str(i % 37)
        assert len(kept) <= 10 and len(kept.older) <= 10
    assert "x" * 65 not in kept and kept["x" * 65] and "x" * 65 not in kept


def test_rows(spark, monkeypatch):
    texts = [None, "", " ", "plain words", "two\n\nlines  and   blanks ", "▁▁ a", "🦄" * 50, "long words and more " * 3000, "long words and more " * 3000]
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "")
        want.append((i or None, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(map(tuple, pieces.round_trip(df).collect()), key=str) == sorted(want, key=str)
    assert pieces.round_trip(df.limit(0)).count() == 0
    both = pieces.with_text(pieces.with_ids(df.select("doc_id", "text"), PATH), PATH, text="again").collect()
    assert all((r["text"] or "").replace("▁", " ") == r["again"] for r in both)
    codec = pieces.vocabulary(PATH)
    monkeypatch.setattr(pieces, "PART", 50)
    monkeypatch.setattr(pieces, "_parts", lambda text, most=50, f=pieces._parts: f(text, most))
    for t, w in zip(texts, want, strict=True):
        if len(t or "") < 3000:
            assert codec.digests(t or "") == w[1:]


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(pieces.Vocabulary, "words", lambda self, text: [text.lower()] if text else [])
    with pytest.raises(ValueError, match="normalises"):
        pieces.Vocabulary(PATH)
