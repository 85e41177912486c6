import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm.bpe import LATIN, WordBPE, encode_digests, encode_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\t", "Hello, World's best 123!", "l'été ÉTÉ é", "ΣΑΣ ΟΔΟΣ", "İstanbul", "a<|endoftext|>B <|startoftext|>", "<|endoftext|><|endoftext|>",
    "日本語テキスト", "🙂🙂 x", "a\x1cb\u0085c　d", "½²³", "we'll they've I'M", "x" * 5000, "\u0000", "<|endoftext|", "ﬁ ß ẞ", "i̇", "a­b​c⁠",
]


@pytest.fixture(scope="module")
def pair():
    return WordBPE(PATH), Tokenizer.from_file(PATH)


def test_encodes_and_decodes_as_the_library(pair):
    bpe, lib = pair
    rng = random.Random(5)
    alphabet = "abcdeABCDE  éÉßñ'.,!?0123\n\t-_" + "ΣσςİIıǅ中🙂½́‍"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == want, repr(t)
        assert bpe.decode(want) == lib.decode(want, skip_special_tokens=False), repr(t)


def test_rows(spark, pair):
    _, lib = pair
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "y"), (3, None, "z"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens) for r in encode_digests(df).collect()}
    assert got == {(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows}
    assert encode_digests(df).count() == len(rows)
    assert encode_ids(df.where("doc_id = 3 AND text IS NOT NULL")).first().decoded == lib.decode(lib.encode(ODD[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert encode_digests(df.limit(0)).count() == 0


def test_code_points_as_the_library(pair):
    """Alone, after a letter, after a mark, and between marks: all below U+3000, and every 17th beyond."""
    bpe, lib = pair
    points = [*range(0x3000), *range(0x3000, 0xD800, 17), *range(0xE000, 0x110000, 17)]
    for at in range(0, len(points), 64):
        text = " ".join("{0} a{0} á{0} a{0}̖́b".format(chr(c)) for c in points[at : at + 64])
        assert bpe.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_lower_case_of_plain_letters(pair):
    bpe, _ = pair
    for c in range(LATIN):
        assert chr(c).lower() == bpe.normaliser.normalize_str(chr(c)) or chr(c).isspace(), hex(c)
