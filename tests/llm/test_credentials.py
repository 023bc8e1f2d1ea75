"""Names of credentials in contexts."""

import math
import random

import pytest

from glyphmill.llm import credentials


@pytest.mark.parametrize("text, value", [
    ("client_secret: k#9vP!2xQz$7", "k#9vP!2xQz$7"), ("DB_PASSWORD=x#9$kL!q2@Wz", "x#9$kL!q2@Wz"), ('access_token = "q!7#Zp$2&mN"', "q!7#Zp$2&mN"), ("userPassword: k#9vP!2xQz$7", "k#9vP!2xQz$7"),
    ("secret_key=k#9vP!2xQz$7", "k#9vP!2xQz$7"), ("auth_token: k#9vP!2xQz$7", "k#9vP!2xQz$7"), ("user-pin: k#9vP!2xQz$7", "k#9vP!2xQz$7"), ("aws.loginName=k#9vP!2xQz$7", "k#9vP!2xQz$7"),
])
def test_credential_names_have_prefixes_and_suffixes(text, value):
    assert [text[a:b] for a, b, _ in credentials.guess_spans(text)] == [value]


def test_words_that_only_hold_a_short_name_are_no_contexts():
    assert not list(credentials.guess_spans("the opinion is k#9vP!2xQz$7, the author: k#9vP!2xQz$7"))
    import time

    began = time.perf_counter()
    assert not list(credentials.guess_spans("password" * 30_000))
    assert time.perf_counter() - began < 2


def by_enumeration(value, words):
    """The least cost over every segmentation, each segment costed by its definition."""
    n, low = len(value), value.lower()
    plain, keys = low.translate(credentials._LEET), "".join(credentials.SHIFTED.get(c, c) for c in low)

    def costs(i, j):
        yield sum(map(credentials._brute, value[i:j]))
        if 3 <= j - i and plain[i:j] in words:
            yield math.log10(words[plain[i:j]] + 1) + 0.3 * sum(a != b for a, b in zip(value[i:j], plain[i:j]))
        m = credentials.DATE.match(value, i)
        if m and m.end() == j:
            yield 2.2 if j - i == 4 else 4.6
        if j - i >= 3 and all(keys[k : k + 2] in credentials._NEXT for k in range(i, j - 1)):
            yield 1.7 + math.log10(j - i)
        for w in (1, 2, 3, 4):
            if j - i >= max(3, 2 * w) and (j - i) % w == 0 and low[i:j] == low[i : i + w] * ((j - i) // w):
                yield sum(map(credentials._brute, low[i : i + w])) + math.log10((j - i) // w)

    best = [[math.inf] * (n + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for k in range(n):
        for i in range(n):
            if best[k][i] < math.inf:
                for j in range(i + 1, n + 1):
                    best[k + 1][j] = min(best[k + 1][j], best[k][i] + min(costs(i, j)))
    return min(best[k][n] + math.lgamma(k + 1) / math.log(10) for k in range(1, n + 1))


def test_guess_cost_is_the_minimum():
    rng = random.Random(8)
    parts = ["qwe", "qwerty", "11", "aaa", "abab", "2019", "1999-12-31", "dragon", "p4ss", "pass", "word", "x", "Z", "7", "#", "1qaz", "zaq1", "poi", "789", "love", "Love", "é", "a", "123123"]
    words = credentials.dictionary(["pass", "word", "dragons", "rag"])
    for _ in range(400):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))[:18]
        got, segments = credentials.guess_digits(value, words)
        assert got == pytest.approx(by_enumeration(value, words), abs=1e-9), value
        assert "".join(value[a:b] for _, a, b in segments) == value
        assert credentials.guess_digits(value, words, 8.0)[0] >= 8.0 if got >= 8.0 else credentials.guess_digits(value, words, 8.0)[0] == pytest.approx(got)


def test_long_repeats_walks_and_placeholders_are_no_secrets():
    walk = "qwertyuiop" + "poiuytrewq" * 40
    for value in ("a" * 1000, "ab" * 200, "a" * 100_000, walk[:300], "1qaz2wsx", "os.environ.get", "${PASSWORD}", "chocolate", "elephant", "configuration", "xxxxxxxx", "%s"):
        assert not credentials.is_secret(value), value
    rng = random.Random(1)
    assert credentials.is_secret("x7Qp!9zR") and credentials.is_secret("".join(rng.choice("abcdefghijk0123456789") for _ in range(20_000)))


def test_dictionary_of_the_corpus(spark):
    docs = spark.createDataFrame([(k, "Maison blanche. password: maisonblanche pin=Rk8#" + ("z" if k == 3 else "")) for k in range(12)] + [(99, None), (100, "")], "doc_id long, text string")
    assert credentials.ranked_words(docs) == ["blanche", "maison", "maisonblanche", "password"] and credentials.ranked_words(docs.limit(0)) == []
    assert credentials.ranked_words(docs.unionByName(docs.filter("doc_id < 6").selectExpr("doc_id + 50 AS doc_id", "'maison' AS text")), most=3) == ["maison"]
    got = {r.doc_id: r.n_guess for r in credentials.scan(docs).collect()}
    assert set(got.values()) == {0}
    assert {r.n_guess for r in credentials.scan(docs, ranked=0).filter("doc_id < 12").collect()} == {1}
