import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import pieces as S
from lexloom.llm import tokens as T

ALPHABET = ["a", "B", " ", "  ", "\n", "'s", "'re", "'", "r", "e", "1", "é", "日", "!", "--", "\t", "ll", "'ll", "\u00a0", "\u3000", "🎉", "́", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60), st.integers(1, 9))
def test_tree_equals_whole(parts, size):
    text = "".join(parts)
    ids = T.tree(text, size=size).ids
    assert ids == T.encoder().encode_ordinary(text)
    assert T.decode(ids) == text


@pytest.mark.parametrize("text", [" " * 5000 + "x", "a" * 5000, "\n" * 3000, "ab " * 4000, "'" * 3001, "日本" * 2500])
def test_long_runs(text):
    assert T.tree(text, size=512).ids == T.encoder().encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=80), st.integers(1, 20))
def test_tree_of_any_text(text, size):
    text = text.encode("utf-8", "ignore").decode()
    assert T.tree(text, size=size).ids == T.encoder().encode_ordinary(text)


def test_certain_borders():
    """Wherever a text is cut at a certain border, both sides encode as they do together."""
    rnd = random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choice(ALPHABET) for _ in range(30))
        whole = T.encoder().encode_ordinary(text)
        for m in T.CERTAIN.finditer(text):
            assert T.encoder().encode_ordinary(text[: m.start()]) + T.encoder().encode_ordinary(text[m.start() :]) == whole


def test_join_is_associative():
    rnd = random.Random(2)
    for _ in range(60):
        a, b, c = (T.leaf("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(12)))) for _ in range(3))
        left, right = T.join(T.join(a, b), c), T.join(a, T.join(b, c))
        assert left.ids == right.ids and left.text == right.text


def test_same_as_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello  world, it's 42!\n\n  x", "naïve — 日本語 🎉", "<|endoftext|>", " \t\n "):
        assert T.tree(text, size=4).ids == t.encode(text, add_special_tokens=False).ids


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hello world", "z"), (2, "", None), (3, None, "z"), (1, "hello world", "z"), (4, " \n", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in T.encode_column(df, "doc_id", "text").collect())
    assert got[0] == got[1] and got[2:4] == [(2, ()), (3, ())] and len(got[4][1]) > 0
    assert T.encode_column(df.limit(0), "doc_id", "text").count() == 0


def check(text, limit=1024, overlap=64):
    got = S.split_text(text, limit, overlap)
    e = T.encoder()
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for s, t, n, _ in got:
        assert n == len(e.encode_ordinary(text[s:t])) <= limit
    for (a, b, _, _), (c, d, _, x) in zip(got, got[1:]):
        assert c == b - x and a < c <= b < d and len(e.encode_ordinary(text[c:b])) <= overlap
    return got


@pytest.mark.parametrize("text", ["a" * 20000, "日本語" * 3000, " " * 9000, "x " * 5000, "word" * 10 + "\n" * 4000 + "end. " * 1000, "🎉" * 3000])
def test_unnatural_texts(text):
    assert len(check(text)) > 1


def test_random_texts():
    rnd = random.Random(4)
    for _ in range(5):
        check("".join(rnd.choice(["lorem ", "ipsum. ", "\n\n", "# h\n", "x" * 50, "日", "🎉", ", "]) for _ in range(4000)))


def test_natural_boundaries():
    text = "\n\n".join(f"Paragraph {k} has a sentence. " + "It goes on for a while here. " * 12 for k in range(60))
    got = check(text, 300, 30)
    for s, t, _, _ in got[:-1]:
        assert text[:t].rstrip()[-1] == "."
    for s, *_ in got[1:]:
        assert text[s - 1].isspace()


def test_split_column(spark):
    df = spark.createDataFrame([(1, "short", "a"), (2, "", "a"), (3, None, "a"), (4, "word " * 3000, "a")], "doc_id long, text string, piece_no string")
    got = S.split_column(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {1, 4} and max(r["n_tokens"] for r in got) <= 1024
    assert [r["n_pieces"] for r in got if r["doc_id"] == 1] == [1]
    joined = "".join(r["text"][r["shared"] :] for r in sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["piece_no"]))
    assert joined == "word " * 3000


def test_words_are_packed_and_code_stays():
    text = "lorem ipsum dolor " * 4000
    sizes = [n for _, _, n, _ in check(text)]
    assert min(sizes[:-1]) > 0.9 * 1024
    code = "```\n" + "x = 1\n\n" * 40 + "```"
    text = "\n\n".join(["Some words here, and more of them. " * 12] * 6 + [code] + ["The end comes late. " * 20] * 6)
    at = text.index("```"), text.rindex("```") + 3
    assert all(not at[0] < e < at[1] for _, e, _, _ in check(text, 300, 20))
    assert not [m for m in S.SENTENCE.finditer("see e.g. this and J. Doe")] and len(S.SENTENCE.findall("One. Two! Three.\nFour")) == 3


def test_checked(spark, tmp_path):
    from lexloom.llm import queries

    spark.createDataFrame([(1, "short"), (2, "word. " * 3000), (3, None), (4, ""), (2, "word. " * 3000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.p9_checked(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and all(r["whole"] and r["most_tokens"] <= 1024 for r in got.values()) and got[2]["n_pieces"] > 2
