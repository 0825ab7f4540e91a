"""Tests of what the findings of round 3 said of the training-data operators."""

import numpy as np

from quarrylight.llm import cross_tokens, substring_dedup
from quarrylight.llm import kernels as K


def _hashes(text):
    import pyarrow as pa

    return substring_dedup.shingles(K.Words(K.texts_of(pa.array([text]))))[0]


def test_frequent_shingles_are_counted_over_all_texts(spark):
    """one text more or less decides, so no sample will do; a text counts once, whatever it repeats."""
    often, seldom, repeated = ("a1 a2 a3 a4 a5", "b1 b2 b3 b4 b5", "c1 c2 c3 c4 c5")
    texts = [often] * 80 + [seldom] * 79 + [" ".join([repeated] * 300)] + [f"x{i} y{i} z{i} u{i} v{i}" for i in range(300)] + [None, ""]
    source = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    bits = substring_dedup.frequent_shingles(source)
    assert substring_dedup.is_frequent(bits, _hashes(often)).all()
    assert not substring_dedup.is_frequent(bits, np.concatenate([_hashes(seldom), _hashes(repeated), _hashes(texts[200])])).any()
    assert not substring_dedup.frequent_shingles(source.limit(0)).any()


def test_pairs_are_screened_together():
    """op1: many pairs at once give what each gives by itself, those without shingles too."""
    rng, pairs = np.random.default_rng(3), []
    for n in range(200):
        u = rng.integers(0, 1 << 31, rng.integers(0, 120)).astype(np.uint32)
        v = np.where(rng.random(len(u)) < n / 200, u, 7).astype(np.uint32)[: rng.integers(0, 121)]
        pairs.append((u, v))
    firsts = [np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]) for k in (0, 1)]
    got = substring_dedup._dense_pairs(np.concatenate([u for u, _ in pairs]), firsts[0], np.concatenate([v for _, v in pairs]), firsts[1], 46)
    want = [substring_dedup._dense(u, v, 46) for u, v in pairs]
    assert got.tolist() == want and 0 < sum(want) < 200
    none = np.zeros(0, dtype=np.uint32)
    assert substring_dedup._dense_pairs(none, np.array([0, 0]), none, np.array([0, 0]), 46).tolist() == [False]


def test_windows_are_led_by_half_values():
    """op1: values that differ in their lower half only lead the same windows as before."""
    rng = np.random.default_rng(4)
    a = (rng.integers(0, 3, 900).astype(np.uint64) << np.uint64(32)) + rng.integers(0, 1 << 20, 900).astype(np.uint64)
    first = np.array([0, 400, 400, 420, 900])
    got = sorted(zip(*(x.tolist() for x in substring_dedup.compact_windows(a, first, 46)), strict=True))
    want = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        work = [(low, high - 1)]
        while work:
            left, right = work.pop()
            if right - left + 1 >= 46:
                c = left + int(np.argmin(a[left : right + 1]))
                want.append((c, left, right))
                work += [(left, c - 1), (c + 1, right)]
    assert got == sorted(want)


def test_words_have_the_tokens_of_their_texts():
    """op12: words are tokenised once each, and a text's tokens are those of its words."""
    own = cross_tokens._Tokens(*cross_tokens.default_paths())
    parts = [*"a1.,!x", " ", "  ", "\n", "\n\n", "\t", " \t", "\xa0", "\x1c", "\x01", "\r\n", "'s", "don't", "é,", "汉字", "²", "<s>", "🙂", ").", "foo", " bar"]
    rng = np.random.default_rng(5)
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 12))) for _ in range(3000)] + ["The one, the other.\nThe one, the other, too! "]
    assert own.apart
    for text in texts:
        words = [cross_tokens.whole_word(w) for w in cross_tokens.cut_words(text)]
        assert "".join(words) == " " + text
        (a, _, n_a), (b, _, n_b) = own.of(words)
        assert a.tolist() == own.library.encode(" " + text, add_special_tokens=False).ids and b.tolist() == own.model.encode(text)
        assert n_a.all() and n_b.all()


def test_each_word_is_aligned_once(spark):
    """op12: what is tokenised and aligned are the distinct words of all rows, each with how often it occurs."""
    docs = spark.createDataFrame([(i, "one two, one\ntwo") for i in range(50)], "doc_id long, text string").repartition(5)
    rows = cross_tokens.texts_by_words(docs)
    found = {r.word: r.times for r in cross_tokens.aligned_words(rows).collect()}
    assert found == {"one": 100, "two": 50, "\x01,": 50, "\ntwo": 50}
