"""Secret scan: ordinary words in credential contexts are clean, secrets are not."""
from tests.llm import fixtures as X
from tollgate.llm import secret_scan


def guesses(spark, texts):
    rows = secret_scan.scan(X.simple(spark, list(enumerate(texts)))).collect()
    return {r.doc_id for r in rows if any(s.kind == "guess" for s in r.spans)}


def test_ordinary_words_are_clean_and_secrets_stay(spark):
    clean = ["the password is required", "the secret is something else", "your password is incorrect", "Token is Available",
             "credentials: authentication", "the passphrase is mandatory."]
    secret = ["the password is xK9#vTq2Lm!z", "secret = fjqzxkwvbp", "passphrase => correct#horse!battery9", "token: 8f3Kd0aQz7Rw"]
    assert guesses(spark, clean + secret) == set(range(len(clean), len(clean) + len(secret)))


def test_words_of_the_table_are_clean_unless_they_are_values(spark):
    known = ["the frobnicatorium stands here"] * 25
    repeated = ["password: qzxwvkjhgfpl"] * 25
    texts = known + repeated + ["the secret is frobnicatorium"]
    assert guesses(spark, texts) == set(range(25, 50))
    assert guesses(spark, texts[25:]) == set(range(26))
