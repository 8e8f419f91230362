"""The encoder's search for special tokens: a name that no text asks for, ordinary text where it occurs."""
import time

from tollgate.llm import packing


def test_ids_are_those_of_plain_encoding():
    enc = packing._encoder(packing.default_ranks())
    texts = ["", "plain words", packing.NO_TOKEN, f"a {packing.NO_TOKEN}b{packing.NO_TOKEN}é", "\x00no token", "<|endoftext|> á \U0001f600\r\n  x", "\x00\x00no token\x00é"]
    for text in texts:
        assert enc.encode_to_numpy(text, disallowed_special=()).tolist() == enc.encode_ordinary(text)
    assert enc.n_vocab == max(enc._mergeable_ranks.values()) + 1


def test_search_for_special_tokens_does_not_stop_at_every_character():
    enc = packing._encoder(packing.default_ranks())
    text = "some words of a text, and others; " * 3000
    spent = {}
    for name, f in (("arrays", lambda: enc.encode_to_numpy(text, disallowed_special=())), ("lists", lambda: enc.encode_ordinary(text))):
        f()
        runs = []
        for _ in range(7):
            began = time.process_time()
            f()
            runs.append(time.process_time() - began)
        spent[name] = min(runs)
    assert spent["arrays"] < spent["lists"] * 1.15
