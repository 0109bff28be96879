"""Pieces of a text: each is looked up in the library's model once, and spelt as the library spells it."""

from tessera.llm import token_files


def encoder():
    import public_tokenizers

    return token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_of_a_rare_vocabulary_are_looked_up_once():
    asked = []
    known = token_files._Pieces(lambda piece: asked.append(piece) or b"")
    for _ in range(2):
        for i in range(390_000):
            known[str(i)]
    assert len(asked) == 390_000  # 570,000 and more with 200,000 remembered


def test_spelling_of_pieces_is_the_librarys():
    odd = ["word", " word", "éte", " été", " a", "a", " ", "  ", "\t", "\nab", "'s", " 12", "12", "!?", " !?", "\x00", "\x7f", "ß", " ñandú", "\xa0",
           "\x85x", "Ż", " -", "ab1"]
    own = encoder()
    for text in odd:
        want = [t.id for t in own.model.tokenize("".join(own.alphabet[b] for b in text.encode()))]
        assert own.piece(text) == b"".join(i.to_bytes(2, "little") for i in want)
        assert own.encode(text) == b"".join(i.to_bytes(2, "little") for i in own.tokenizer.encode(text, add_special_tokens=False).ids)
