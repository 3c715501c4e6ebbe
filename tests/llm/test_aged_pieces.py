"""An encoder that ages what it remembers: pieces that are met again stay, results never depend on it."""

import random

import public_tokenizers

from corpusloom.llm import bpe, records


def test_pieces_met_again_are_not_merged_again():
    merged = []
    enc = bpe.Encoder(lambda words: merged.extend(words) or [w.rjust(8) for w in words], {}, None, 40, aged=True)
    often = [f"often{k}x" for k in "abcde"]
    for k in range(60):
        enc.encode_many([" ".join([*often, *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcdefgh")])])
        assert len(enc.heads) + len(enc.inner) + len(enc.words) <= 40
    assert all(merged.count(f" {w}".encode()) == 1 for w in often[1:])


def test_library_ids_with_little_memory(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, rng = records.library_encoder(path), random.Random(5)
    monkeypatch.setattr(enc, "entries", 60)
    words = [*("a é 漢字 don't x, y. 12,3 \n \n\n  \t end! #! \x00".split(" ")), "", *(f"w{k}'s," for k in range(99))]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(200)]
    lib = Tokenizer.from_file(path)
    for lo in range(0, 200, 10):
        for text, ids in zip(texts[lo : lo + 10], enc.encode_many(texts[lo : lo + 10])):
            assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == lib.encode(text, add_special_tokens=False).ids
    enc.forget()
