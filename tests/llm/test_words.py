import xxhash

from plumbline.llm import jaccard


def test_words_hashed_at_once(monkeypatch):
    """A word has one hash, wherever it stands and however long the text is; different words differ."""
    monkeypatch.setattr(jaccard, "PIECE", 200)
    known = jaccard.Words()
    words = [b"w%d" % (k % 300) for k in range(2000)] + [b"x" * 65, b"y" * 500, b"\xc3\xa4", b"AbC", b"aBc"]
    got = known.hashes(b" \t" + b"\r\n ".join(words) + b"\x0b")
    alone = [int(known.hashes(w)[0]) for w in words]
    assert got.tolist() == alone and len(set(alone)) == len({w.lower() for w in words}) and alone[2001] == xxhash.xxh64_intdigest(b"y" * 500)
    assert len(known.hashes(b"")) == len(known.hashes(b" \n ")) == 0
