"""Pieces that are met for the first time are made where they are missing, without sets of a block's pieces."""

import public_tokenizers

from corpusloom.llm import bpe, records


def test_a_block_is_looked_up_once(monkeypatch):
    def learned(self, cuts):
        raise AssertionError("pieces are gathered before they are looked up")

    monkeypatch.setattr(bpe.Encoder, "_learn", learned)
    asked = []
    enc = bpe.Encoder(lambda words: asked.extend(words) or [w + b";" for w in words], {}, None, 1000, aged=True)
    assert enc.encode_many(["ab cd cd!? cd", None, "", "ab\ncd"]) == [b"ab; cd; cd;!?; cd;", b"", b"", b"ab;\n;cd;"]
    assert len(asked) == len(set(asked))


def test_ids_of_signs_and_scripts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, lib = records.LibraryEncoder(path), Tokenizer.from_file(path)
    ends = ["", "'", "'s", "'s!", "!'s", "$$$", ",%%%", "_", "_a", ".1", "\x7f", "\x00", "\u00a0", "é,", "漢。", "²", "\u0345!", "'\u2019"]
    texts = [f"{a}{w}{e}{b}" for a in ("", "x ", "x  ", "\n", "(") for w in ("can", "été", "漢字", "12", "", "Ⅷ") for e in ends for b in ("", " y", "\ty")]
    for text, ids in zip(texts, enc.encode_many(texts)):
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == lib.encode(text, add_special_tokens=False).ids, repr(text)
