"""Packing on counted tokens."""

from murmurlake.llm import packing
from test_map_operators import encoding


def test_pack_counts_tokens_of_the_vocabulary(spark):
    rows = [(i, "¿Qué señalización había? " * (i % 17) + "w" * (i % 5)) for i in range(90)] + [(None, "naïve 日本語 text"), (200, None), (201, ""), (202, "x1 " * 700)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=100, group_rows=40).collect()
    own = encoding()
    want = {d: len(own.encode_ordinary(t or "")) for d, t in rows}
    have, room = {}, {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.piece)):
        assert r.first_token == have.get(r.doc_id, 0) == 100 * r.piece
        assert r.cost == packing.LINEAR * r.n_tokens + packing.QUADRATIC * r.n_tokens**2
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.n_tokens
    assert have == {d: n for d, n in want.items() if n}
    assert max(room.values()) <= 100
