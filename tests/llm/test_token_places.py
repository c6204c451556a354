"""Single documents by id from a shard."""
import io

import numpy as np

from strandframe.llm.token_store import ShardReader, ShardWriter


def test_places():
    f = io.BytesIO()
    w = ShardWriter(f, frame_bytes=16)
    for i, n in ((None, 3), (None, 1), (2, 5), (2, 2), (9, 400), (11, 0)):
        w.add(i, np.arange(n, dtype=np.uint32))
    w.close()
    r = ShardReader(f)
    assert [list(r.places(i)) for i in (2, 3, 9, 11, 0)] == [[2, 3], [], [4], [5], []]
    assert r.ids(r.places(9)[0]).tolist() == list(range(400)) and r.ids(5).tolist() == []


def test_plain_split():
    import random

    import public_tokenizers

    from strandframe.llm.token_store import encoder

    enc, rnd = encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    alphabet = "aZéß ªµ09²½  \t\n\r\f\v\x1c\x85\xa0.,'!_-×÷中ⅷ\u0301's'll've"
    plain = 0
    for _ in range(20000):
        s = "".join(rnd.choice(alphabet[: rnd.choice([9, 16, 30, len(alphabet)])]) for _ in range(rnd.randrange(12)))
        plain += bool(enc.plain(s))
        assert enc.pieces(s) == enc.any_split(s), s
    assert plain > 2000
