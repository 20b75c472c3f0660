"""Small documents with every edge case: null, empty, long, ties, copies, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, ids string, words string, score double"


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["the", "of", "ing", "Straße", "naïve", "ÉTÉ", "été", "don't", "we'll", "42", "3.14", "日本語", "x\ty", "and,", "“quote”", "é", "ﬁne", "a b"]
    body = [" ".join(rng.choice(words) + rng.choice(["", "", "er", "tion"]) for _ in range(n)) for n in (3, 40, 200, 60, 500)]
    return [
        None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a \n b", "a\n b", "a\n\n  b", " \n", "x\n \ny", "tab\t \tz", " a  b", "\u0085 \u0085",
        "a\x1cb \x1d c", "'s 's't", "x's", *body, body[1], body[1].upper(), body[1].replace(" ", "\n"), "<|endoftext|> <|startoftext|>x", "z" * 3000, "ab" * 200, "🙂🙂 🙂",
        "mail bob.smith+x@mail.example.com, a@b@c.de x@y. call +1 (555) 555-0100 or +123 now",
        "ip 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 1.2.3 card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4316522678525456",
        'token = "d7c90f3602a3d0b907ff" https://bob:pw9@host/x IBAN: DE89370400440532013000', "+1 +12 +1234567890 ++1 (2)3.4-5 67890 1",
        " ".join(f"bench{i}" for i in range(40)), "prefix " + " ".join(f"bench{i}" for i in range(5, 25)) + " suffix", "Only, SHORT item! inside only short item",
    ]


def docs(spark):
    rows = [(i * 3 - 5, t, "en", "s", len(t or ""), 1, "clash", "clash", 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_id() -> dict[int, str]:
    return {i * 3 - 5: t or "" for i, t in enumerate(texts())}
