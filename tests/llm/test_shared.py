"""Word hashes, token ids and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from sparkcurves.llm import shared as S
from sparkcurves.llm import tokens as K

ODD = ["", "  a  b ", " a", "a ", "a\n b", "a \nb", "x's 'tis", "a  b c", "tab\t x  y   z", "a\x1c b", "it 's 9 9x ñé <|endoftext|> z",
       "\n\n a\r\n b", "日本 語 x", "a\nb\nc d", "\ta b", " ", "’s it’s ok “a” – b", "a b c d", "x" * 5000, "", "word " * 3000]
WORDS = re.compile(S.WORD_PATTERN)
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_words_and_shingles_are_those_of_plain_python():
    random.seed(3)
    texts = ODD + [" ".join(random.choice(["Ab", "ab", "c", "dé", "ÉF", "\n", "\x0b"]) for _ in range(random.randrange(40))) for _ in range(200)]
    data, offsets = S.text_buffer(pa.array(texts))
    hashes, at = S.word_hashes(data, offsets, most=50)
    words = [WORDS.findall(t.translate(LOWER)) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    named = dict(zip(hashes.tolist(), [w for x in words for w in x], strict=False))
    assert [named[h] for h in hashes.tolist()] == [w for x in words for w in x]
    for width in (2, 5):
        _, sizes = S.shingle_hashes(hashes, at, width)
        assert np.diff(sizes).tolist() == [n_shingles(w, width) for w in words]


def n_shingles(words, width):
    return len({tuple(words[i : i + width]) for i in range(len(words) - width + 1)}) if len(words) >= width else int(bool(words))


def test_batches_of_few_words():
    for width in range(1, 7):
        for texts in ([], [""], ["a"], ["a b"], ["", "a", "b"], ["a b c"], ["a b", "c d"], ["a b c d e"], ["a", "b c d e f"], ["a b c d e f"]):
            hashes, at = S.word_hashes(*S.text_buffer(pa.array(texts, pa.string())))
            shingles, sizes = S.shingle_hashes(hashes, at, width)
            assert np.diff(sizes).tolist() == [n_shingles(t.split(), width) for t in texts] and len(shingles) == sizes[-1]


def test_ids_are_those_of_the_tokenizer():
    encoder = K.Encoder(K.vocabulary_path())
    for batch in (ODD, ODD[::-1], ["", ""], []):
        ids, at = encoder.encode(pa.array(batch, pa.string()))
        assert len(at) == len(batch) + 1
        for i, text in enumerate(batch):
            own = ids[at[i] : at[i + 1]]
            assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert encoder.sizes[own].sum() == len(text.encode())


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 207)}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_joined_by_later_edges(spark):
    def components(edges):
        return S.components(spark.createDataFrame(edges, "a long, b long"))

    random.seed(2)
    first = [(random.randrange(200), random.randrange(200)) for _ in range(90)]
    of = components(first)
    root = {r["node"]: r["root"] for r in of.collect()}
    later = [(random.randrange(230), random.randrange(230)) for _ in range(60)]  # some between nodes that had no edge
    joined = S.joined_components(of, components([(root.get(a, a), root.get(b, b)) for a, b in later])).collect()
    assert sorted(map(tuple, joined)) == sorted((r["node"], r["root"]) for r in components(first + later).collect())
    none = components([])
    assert sorted(map(tuple, S.joined_components(of, none).collect())) == sorted(root.items())
    assert sorted(map(tuple, S.joined_components(none, of).collect())) == sorted(root.items())
